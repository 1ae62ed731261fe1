"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from gridlens.llm import bpe, caps, html, jaccard, licenses, linededup, packing, pii, quality, shards
from gridlens.llm.components import components

ODD = [None, "", " \t\n", "a", "A", "é à\nÉ", "x" * 30_000, "ab" * 2_000 + "\n" + "!" * 900, "one two three four five six", "one two three four five six", "😀👨‍👩‍👧 Ünï\r\nß"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "spans string, quality double, n_words long, _id string, _digest string, _covered string, n_lines int, kept string"


def documents(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


def prose(seed, count=120):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["the", "and", "of", "license", "mit"]
    base = [[draw.choice(words) for _ in range(draw.randint(2, 70))] for _ in range(25)]
    out = []
    for _ in range(count):
        own = list(draw.choice(base))
        for _ in range(draw.randint(0, 3)):
            own[draw.randrange(len(own))] = draw.choice(words)
        out.append("\n".join(" ".join(own[i : i + 9]) for i in range(0, len(own), 9)))
    return out


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def clashing(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, ODD)
    for field in CLASHING.split(", "):
        name, kind = field.split()
        docs = docs.withColumn(name, F.lit(None).cast(kind))
    return docs


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_bpe_is_the_library_s_and_round_trips(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.Vocabulary.read(path).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(bpe.digests(odd, path, public_tokenizers.PATTERN))
    for k, text in enumerate(ODD):
        ids = library.encode_ordinary(text or "")
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(none, path, public_tokenizers.PATTERN).count() == 0
    back = rows(bpe.decode(bpe.encode(odd, path, public_tokenizers.PATTERN), path))
    assert all(bytes(back[k]["bytes"]) == (t or "").encode() for k, t in enumerate(ODD))


def test_bpe_of_pieces_of_every_length_is_the_library_s():
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    draw = random.Random(6)
    pieces = ["".join(draw.choice(draw.choice(["ab", "aaab", "theinga", "01", " \n", "éà", "=-_"])) for _ in range(draw.randint(1, draw.choice([4, 40, 300])))).encode() for _ in range(3000)]
    pieces += [b"x" * 60_000, b"ab" * 40_001, "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)).encode(), b"thequickbrownfox" * 3000]
    assert [ids.tolist() for ids in vocabulary.encode_pieces(pieces)] == [library._core_bpe.encode_single_piece(p) for p in pieces]


def test_bpe_on_random_pieces():
    coder = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, cached=50)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.vocabulary.ranks, special_tokens={})
    draw = random.Random(5)
    texts = ["".join(draw.choice("thein gaé \n!9") for _ in range(draw.randint(0, 600))) for _ in range(200)]
    texts += ["".join(draw.choice("theinga") for _ in range(n)) for n in (255, 256, 257, 3000)]
    for part in bpe.text_slices(texts, 500):
        assert [ids.tolist() for ids, _ in coder.encode(part)] == [library.encode_ordinary(t) for t in part]


def test_shards(spark, odd, none):
    got = shards.assign(documents(spark, [f"t{k % 50}" for k in range(3000)] + [None]), 24).collect()
    assert {r["law"] for r in got} == {"key"} and len(got) == 3001
    for r in got:
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24
    moved = sum(r["grown_shard"] == 24 for r in got)
    assert 3001 / 25 * 0.6 < moved < 3001 / 25 * 1.5
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = {r["doc_id"]: r["shard"] for r in shards.assign(documents(spark, ["x"] * 3001), 24).collect()}
    assert all(again[r["doc_id"]] == r["shard"] for r in got)
    for k, r in rows(shards.assign(odd, 24)).items():
        raw = (ODD[k] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    assert shards.assign(none, 24).count() == 0
    same = shards.assign(documents(spark, ["a"] * 40, [None] * 20 + [7] * 20), 3).collect()
    assert sorted(r["slot"] for r in same if r["doc_id"] is None) != [] and len({r["shard"] for r in same if r["doc_id"] == 7}) == 1


LICENSE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_license_scan(spark, odd, none):
    texts = [*ODD, *prose(3), "Released under the MIT License.", "x mit\nlicense Apache-License general public license mit license", "Licensed under CC BY-NC 4.0.", "licensed under cc", "word " * 400 + "licensed under the apache license, version 2.0 " + "word " * 400]
    got = rows(licenses.scan(documents(spark, texts)))
    members = [(label, set(LICENSE_WORD.findall(t))) for label, t in licenses.TEMPLATES]
    for k, text in enumerate(texts):
        words = LICENSE_WORD.findall((text or "").translate(LOWER))
        hits = [(i, label) for label, p in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = got[k]
        base = {label for _, label in hits}
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(hits), ",".join(sorted(base)))
        assert (r["first_word"], r["last_word"]) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        labels, score = set(base), float(bool(hits))
        for line in (text or "").translate(LOWER).split("\n"):
            own = LICENSE_WORD.findall(line)
            half = licenses.BLOCK_WORDS // 2
            for i in range(0, max(1, len(own)), half):
                block = set(own[i : i + 2 * half])
                for label, template in members:
                    share = len(block & template) / len(template)
                    if share >= licenses.THRESHOLD - 1e-9:
                        labels.add(label)
                        score = max(score, share)
        assert r["labels"] == ",".join(sorted(labels)) and abs(r["score"] - score) < 1e-9
    assert got[len(texts) - 3]["labels"] == "cc-by-nc"
    assert licenses.scan(none).count() == 0


def test_license_scan_of_wrapped_notices(spark):
    wrapped = {
        "mit": "/* Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the Software), to deal */",
        "apache": "# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#   http://example.com",
        "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public\nLicense",
        "bsd": "Redistribution and use in source and binary forms,\r\nwith or without modification, are permitted\r\nprovided that the following conditions are met:",
    }
    before = "a line of code\n" * 60
    texts = [*wrapped.values(), *[before * k + t + "\n" + before for k, t in enumerate(wrapped.values(), 1)]]
    got = rows(licenses.scan(documents(spark, texts)))
    assert [got[k]["labels"] for k in range(len(texts))] == [*wrapped, *wrapped]
    assert all(r["score"] == 1 for r in got.values())


def test_license_scan_tells_licenses_apart(spark):
    work = "This work is licensed under a Creative Commons Attribution"
    free = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU"
    published = "General Public License as published by the Free Software Foundation"
    cases = [
        ("Released under the Apache License, Version 2.0.", "apache"),
        ("Released under the BSD License.", ""),
        ("Licensed under CC BY 4.0.", ""),
        ("Licensed under CC BY-SA 4.0.", ""),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("Licensed under the MIT License, Version 2.0", "mit"),
        ("It was released in May under pressure, and the owner of the shop lost a license; mit is German for with.", ""),
        ("released under\n" + "a line of code\n" * 60 + "the mit", ""),
        ("Released under MIT license", "mit"),
        (f"{work}-NonCommercial 4.0 International License.", "cc-by-nc"),
        (f"{work}-Non-Commercial 4.0 International License.", "cc-by-nc"),
        (f"{work}-ShareAlike 4.0 International License.", "cc-by-sa"),
        (f"{work}-NoDerivatives 4.0 International License.", ""),
        (f"{work} 4.0 International License.", "cc-by"),
        (f"{work}-NonCommercial 4.0 International License.\n{work} 4.0 International License.", "cc-by,cc-by-nc"),
        (f"{work} 4.0 International License.\n{work}-NonCommercial 4.0 International License.", "cc-by,cc-by-nc"),
        (f"{free} {published}", "gpl"),
        (f"{free} Lesser {published}", "gpl,lgpl"),
        (f"{free} Library {published}", "gpl,lgpl"),
        (f"{free} Affero {published}", "agpl,gpl"),
        ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software", "boost"),
        ("Licensed under the Educational Community License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "ecl"),
        ("Licensed under the ECL 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at", ""),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", "0bsd"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", "isc"),
        ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "ofl"),
        ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "mpl"),
        ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "gpl"),
        ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "gpl,lgpl"),
    ]
    got = rows(licenses.scan(documents(spark, [text for text, _ in cases])))
    assert [(text, got[k]["labels"]) for k, (text, _) in enumerate(cases)] == cases
    for k, (_, template) in enumerate(licenses.TEMPLATES):
        index = licenses.Index([licenses.TEMPLATES[k]], {}, licenses.THRESHOLD)
        hashes = np.array(licenses.run_hash(template, licenses.ALNUM), np.uint64)
        assert index.containment(0, index.tokens(hashes).tolist(), hashes) == 1


def test_packing_plan_packs_all_and_near_the_bound():
    for seed in range(12):
        draw = np.random.default_rng(seed)
        limit = int(draw.choice([5, 16, 64, 4096]))
        lengths = np.clip(draw.exponential(limit / float(draw.choice([1.5, 4, 20])), int(draw.integers(0, 3000))).astype(int) + 1, 1, limit)
        planned, packed = packing.plan(dict(Counter(lengths.tolist())), limit), Counter()
        for held, times in planned:
            assert sum(held) <= limit and times > 0
            for x in held:
                packed[x] += times
        assert packed == Counter(lengths.tolist())
        assert sum(t for _, t in planned) <= -(-int(lengths.sum()) // limit) * 1.12 + 1


def test_packing_of_documents(spark, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*ODD, *prose(4), "don't <|endoftext|> a<|endoftext|>b", "w" * 9000 + " 7" * 9000, "same", "same"]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    want = [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    got = defaultdict(list)
    spans = defaultdict(list)
    for r in packing.pack(packing.pieces(documents(spark, texts), path)).collect():
        got[r["doc_id"]].append(r)
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, ids in enumerate(want):
        pieces = sorted(got[k], key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == list(range(0, len(ids), 4096))
        for r in pieces:
            cut = np.array(ids[r["start"] : r["start"] + 4096], "<u4")
            assert (r["length"], r["ids_crc32"]) == (len(cut), zlib.crc32(cut.tobytes()))
    for held in spans.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(packing.pieces(none, path)).count() == 0


QUALITY_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_signals(text):
    text = text or ""
    words = QUALITY_WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if QUALITY_WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_signals(spark, clashing, none):
    texts = [*ODD, *prose(5), "a a a a", "x\n\nx\n x\nx", "# é | <>&"]
    got = rows(quality.digests(documents(spark, texts)))
    for k, text in enumerate(texts):
        want = brute_signals(text)
        assert tuple(got[k][f] for f in quality.FEATURES) == want
        assert got[k]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[k]["kept"] and got[k]["base_failed"])
    assert quality.digests(none).count() == 0
    judged = quality.judge(clashing)
    assert judged.count() == len(ODD) and {"quality", "kept", "_id"} <= set(judged.columns)


def test_quality_agrees_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    both = quality.digests(docs).drop("quality").join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    count = {(r["quality"], r["kept"]): r["count"] for r in both}
    assert count.get((1, False), 0) <= 0.01 * count[(1, True)] and count.get((0, True), 0) <= 0.1 * count[(0, False)]


def test_expectation_maximisation_finds_accuracies():
    draw = random.Random(8)
    patterns = Counter()
    for _ in range(5000):
        good = draw.random() < 0.7
        code = 0
        for j in range(len(quality.RULES)):
            right = draw.random() < 0.75 + 0.02 * j
            code = code * 3 + (1 if draw.random() < 0.1 else 2 * (good == right))
        patterns[code] += 1
    _, found = quality.expectation_maximisation(patterns)
    assert abs(found["good"] - 0.7) < 0.05
    for j, name in enumerate(quality.RULES):
        good, bad = found["votes"][name]
        assert abs(good - (0.75 + 0.02 * j)) < 0.06 and abs(1 - bad - (0.75 + 0.02 * j)) < 0.06


def test_main_text_of_pages(spark):
    field = html.trained()
    wrong = total = 0
    for page in html.labelled_pages(60, seed=99):
        blocks = html.leaf_blocks(page)
        wrong += sum(b.label != label for b, label in zip(blocks, field.decode(blocks), strict=True))
        total += len(blocks)
    assert wrong <= 0.03 * total
    page = '<html><head><title>t</title><script>var x="<p>no</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>A  title</h1><p>First &amp; <b>bold</b>\n text.<br>More<p>Second &eacute; paragraph with words.</p></article><footer>&copy; us</footer>'
    table = spark.createDataFrame([(1, None, page), (2, "u", None), (3, "u", ""), (4, "u", "<p"), (1, None, page), (5, "u", "<a <b <" * 500)], "page_id long, url string, html string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html.extract(table).collect()]
    text = "A title\nFirst & bold text. More\nSecond é paragraph with words."
    assert got.count((1, text, len(text))) == 2 and (2, "", 0) in got and (3, "", 0) in got and len(got) == 6
    assert html.extract(table.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<body><p>one<select><option>a<option>b</select> two</p><p>three", ["one two", "three"]),
        ("<p>one<select><optgroup><option>a<optgroup><option>b<option>c</select> two", ["one two"]),
        ("<div><option>a</div><p>two", ["two"]),
        ("<datalist><option>a<option>b</datalist><p>two", ["two"]),
        *[(f"<div><p>one <{x}>gone</div><p>two", ["one", "two"]) for x in ("button", "object", "canvas", "noscript", "video", "iframe", "svg")],
        ("<div><p>one<canvas>gone<p>two</div>", ["one", "two"]),
        ("<ul><li>one<button>gone<li>two<button>gone</button> three</ul>", ["one", "two three"]),
        ("<p>one<noscript><p>gone</p>gone</noscript>", ["one"]),
        ("<div>one<object>gone<object>gone</object>gone</object> two</div>", ["one two"]),
        ("<div>one<iframe></div>gone</iframe> two</div>", ["one two"]),
        ("<div><noscript><div>gone</noscript>one</div>", ["one"]),
        ("<html><head><title>t</title><meta charset=x><p>one", ["one"]),
        ("<head><title>t</title><noscript><img src=x>gone</noscript><link rel=x>\n<h1>one</h1>two", ["one", "two"]),
        ("<head><title>t</title>one<p>two", ["one", "two"]),
        ("<head><noscript>gone<body>one", ["one"]),
        ("<head><style>gone</style></head>one", ["one"]),
    ],
)
def test_skipped_elements_end_with_their_parents(page, texts):
    assert [b.text for b in html.leaf_blocks(page)] == texts


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p title=it's>Hello there</p><p>don't stop</p>", ["Hello there", "don't stop"]),
        ("<p>a <math><mi>x</mi></math> b</p>", ["a x b"]),
        ('<p a="x>y" b=\'>\'>t</p>', ["t"]),
        ('<p title="a>b</p><p>c</p>', ["b", "c"]),
        ("<!-->x<p>y<!-- > -->z", ["x", "yz"]),
        ("one < two <3 <p>a<b", ["one < two <3", "a<b"]),
    ],
)
def test_tags_and_quotes(page, texts):
    assert [b.text for b in html.leaf_blocks(page)] == texts


def test_references_do_not_reach_over_tags_and_comments():
    pages = {"<p>AT&<b>amp;</b>T": "AT&amp;T", "<p>a&<!-- x -->lt;b": "a&lt;b", "<p>AT&amp;T &lt;i&gt; &#233;&nbsp;x": "AT&T <i> é x", "<p>&am<i>p;</i>": "&amp;"}
    for page, text in pages.items():
        assert [b.text for b in html.leaf_blocks(page)] == [text]


def test_pages_of_odd_markup_are_read_in_linear_time():
    import time

    began = time.time()
    for part in ("<a ", '<a x=">" ', "<div>x", "<object>", "<object><div>", "<button>x", "<!--", "<li>x", "<option>x", '<a b="', "<", "<iframe>", "<style>x</style>"):
        html.leaf_blocks("<p>" + part * (600_000 // len(part)))
        html.leaf_blocks("<ul>" + part * (300_000 // len(part)) + '">')
    assert time.time() - began < 60


def test_main_text_of_the_pages_table(spark):
    """Each page's article, read by another reader: the table's pages hold one, between menus, adverts and footers."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.out, self.part = 0, [], []

        def end_block(self):
            text = " ".join("".join(self.part).split())
            self.part = []
            if text and self.inside:
                self.out.append(text)

        def handle_starttag(self, tag, attrs):
            if tag in html.BLOCK:
                self.end_block()
            self.part += [" "] if tag == "br" else []
            self.inside += tag == "article"

        def handle_endtag(self, tag):
            if tag in html.BLOCK:
                self.end_block()
            self.inside -= tag == "article"

        def handle_data(self, data):
            self.part.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        reader = Article()
        reader.feed(r["html"] or "")
        reader.close()
        reader.end_block()
        want[r["page_id"]] = "\n".join(reader.out)
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert sum(got[k] == t for k, t in want.items()) >= 0.99 * len(want)


def test_caps_of_pairs_at_the_threshold():
    """Pairs planted at cosine 0.95 to 0.96 share a filter, alike at both sizes."""
    for size in (2_000, 16_000):
        draw = np.random.default_rng(size)
        base, other = draw.standard_normal((size, 64)), draw.standard_normal((size, 64))
        base = base / np.linalg.norm(base, axis=1)[:, None]
        other -= (other * base).sum(1)[:, None] * base
        other /= np.linalg.norm(other, axis=1)[:, None]
        near = 0.95 + 0.01 * draw.random((size, 1))
        held = caps.list_size(2 * size)
        filters = [caps.list_decode(x, caps.code_size(2 * size), held) for x in (base, near * base + np.sqrt(1 - near**2) * other)]
        keys = [set((v * 10**9 + f).tolist()) for v, f in filters]
        shared = {k // 10**9 for k in keys[0] & keys[1]}
        assert len(shared) >= 0.95 * size


def test_caps_against_brute_force(spark):
    draw = np.random.default_rng(3)
    base = draw.standard_normal((40, 16))
    points = np.concatenate([base[draw.integers(0, 40, 900)] + 0.12 * draw.standard_normal((900, 16)), np.repeat(base[:1], 60, 0), 2 * base[1:4]]).astype(np.float32)
    data = [(k, x.tolist(), 0) for k, x in enumerate(points)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 0.0]]
    data += [(2000 + k, x, None) for k, x in enumerate(odd)]
    got = {r["vec_id"]: r for r in caps.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)).collect()}
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    found = sum(got[k]["n_links"] for k in range(len(points)))
    assert found >= 0.99 * near.sum() and all(got[k]["n_links"] <= near[k].sum() for k in range(len(points)))
    label = np.arange(len(points))
    while (new := np.minimum(label, np.where(near, label[None, :], 10**6).min(1))).tolist() != label.tolist():
        label = new
    assert np.mean([got[k]["component_id"] == label[k] for k in range(len(points))]) > 0.99
    for k in range(len(odd)):
        assert (got[2000 + k]["n_links"], got[2000 + k]["component_id"], got[2000 + k]["kept"]) == (0, 2000 + k, True)
    assert caps.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("block", [64, 1 << 22])
def test_caps_tells_pairs_with_a_smaller_filter(monkeypatch, block):
    """Blocks against all rows, whatever the number of columns laid out at a time, are the plain intersections."""
    monkeypatch.setattr(caps, "BLOCK", block)
    draw = np.random.default_rng(5)
    lists = [np.unique(draw.integers(0, 300, draw.integers(0, 9))) for _ in range(40)]
    row, number = np.repeat(np.arange(40), [len(x) for x in lists]), np.concatenate(lists)
    for first, size in ((0, 40), (0, 7), (33, 7)):
        want = [[bool(set(lists[a].tolist()) & set(lists[b].tolist())) for b in range(40)] for a in range(first, first + size)]
        assert caps._share(row, number, first, size, 40).tolist() == want
    assert not caps._share(row[:0], number[:0], 0, 3, 40).any()


@pytest.mark.parametrize("block", [512, 1 << 22])
def test_caps_splits_full_filters(spark, monkeypatch, block):
    monkeypatch.setattr(caps, "BLOCK", block)
    monkeypatch.setattr(caps, "CELL", 16)
    draw = np.random.default_rng(4)
    points = (np.ones((120, 8)) + 0.05 * draw.standard_normal((120, 8))).astype(np.float32)
    got = caps.near_duplicates(spark.createDataFrame([(k, x.tolist(), 0) for k, x in enumerate(points)], "vec_id long, embedding array<float>, label int")).collect()
    assert {r["n_links"] for r in got} == {119} and {r["component_id"] for r in got} == {0}


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def brute_spans(text):
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            yield f"{kind}:{m.start()}:{m.end()}"


def test_personal_data(spark, clashing, none):
    draw = random.Random(3)
    bits = ["a.b@c.d", "x@y.z_q@r.s", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 123-4567", " ", "é", "😀", "\n", "x", "+49.30.1234567.", "4111111111111111", "@", "a@b", "-", "12345678901234567"]
    texts = [*ODD, *["".join(draw.choices(bits, k=draw.randint(1, 12))) for _ in range(600)], "a@b" + ".c" * 20_000, "1" * 50_000, "1 " * 20_000, "a" * 100_000, "a.b@c.d_" * 500]
    texts += [f"the aws key AKIA{k:02d}IOSFODNN7EXAMPL is" for k in range(20)]
    got = rows(pii.digests(documents(spark, texts)))
    for k, text in enumerate(texts):
        want = list(brute_spans(text))
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), repr(text)[:200]
        assert [got[k][f"n_{kind}"] for kind in PLAIN] == [sum(w.startswith(kind) for w in want) for kind in PLAIN]
        assert set(want) <= set(got[k]["spans"].split(","))
    assert got[len(texts) - 1]["spans"] == "secret:12:33"
    assert pii.digests(none).count() == 0
    assert pii.find(clashing).count() == len(ODD)
    hidden = pii.redact(documents(spark, ["mail a.b@c.de or +1 (555) 123-4567.", None, "none"])).orderBy("doc_id").collect()
    assert [r["text"] for r in hidden] == ["mail [EMAIL] or [PHONE].", None, "none"]


def brute_components(texts):
    sets = {}
    for k, text in enumerate(texts):
        words = QUALITY_WORD.findall((text or "").translate(LOWER))
        sets[k] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_pairs_of_one_list_are_found_without_laying_out_all():
    rng = np.random.default_rng(5)
    for n in (1, 2, 60):
        size = rng.integers(5, 60, n)
        root, lone, side = rng.integers(0, max(1, n // 3), n), rng.integers(0, 4, n), rng.integers(-1, 3, n)
        ids, count = np.unique(root, return_counts=True)
        largest = ids[count.argmax()]
        alike = lambda i, j: 75 * max(size[i], size[j]) <= 100 * min(size[i], size[j]) and 175 * min(size[i] - lone[i], size[j] - lone[j]) >= 75 * (size[i] + size[j]) and (side[i] < 0 or side[i] != side[j])
        want = {(i, j) for i in range(n) for j in range(n) if root[i] != largest and root[j] != root[i] and (root[j] == largest or j > i) and alike(i, j)}
        asking, found = jaccard.unlike(root, size, lone, side)
        assert len(asking) == len(want) and set(zip(asking.tolist(), found.tolist(), strict=True)) == want
    size = np.arange(1, 4001) ** 3  # eight million pairs, few of them alike in size
    none = np.zeros(len(size), np.int64)
    tracemalloc.start()
    asking, _ = jaccard.unlike(np.arange(len(size)), size, none, none - 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(asking) > 0 and most < 40 * len(asking) + 4_000_000


def test_pairs_that_leave_by_and_by_are_the_same(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    rng = random.Random(3)
    texts = [" ".join(words[i % 7 : 34] + [rng.choice(words) for _ in range(3)]) for i in range(60)]
    once = rows(jaccard.near_duplicates(documents(spark, texts)))
    monkeypatch.setattr(jaccard, "PAIRS", 2)
    assert rows(jaccard.near_duplicates(documents(spark, texts))) == once and len({r["component_id"] for r in once.values()}) < 60


def test_jaccard_against_brute_force(spark, none, monkeypatch):
    texts = [*ODD, *prose(6, 250), "A b c", "a  B\nC"]
    got = rows(jaccard.near_duplicates(documents(spark, texts)))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == brute_components(texts)
    assert jaccard.near_duplicates(none).count() == 0
    # Lists held often are cut into parts, buckets are small, the other lists are merged and probed: the same components.
    monkeypatch.setattr(jaccard, "PART", 4)
    again = rows(jaccard.near_duplicates(documents(spark, texts), limit=400, postings=500))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in again.items()} == brute_components(texts)
    twice = jaccard.near_duplicates(documents(spark, ["p q r s t u"] * 3, [4, 4, None])).collect()
    assert len(twice) == 3 and {r["component_id"] for r in twice} == {4}


def test_overlap_from_merged_and_probed_lists():
    draw = random.Random(12)
    for _ in range(300):
        order = draw.sample(range(10**6), 200)
        place = {v: i for i, v in enumerate(order)}
        x, y = (np.array(sorted(draw.sample(order, draw.randint(1, 150)), key=place.get), np.uint64) for _ in range(2))
        short = draw.randint(0, len(x)), draw.randint(0, len(y))
        seen = len(set(x[: short[0]].tolist()) & set(y[: short[1]].tolist()))
        assert jaccard.overlap(x, y, *short, seen) == len(set(x.tolist()) & set(y.tolist()))
    assert all(1 <= jaccard.merged(t, m) <= jaccard.occurrences(t) for t in range(1, 400) for m in (1, 100, 1e12))


def test_frequent_values_are_found():
    draw = np.random.default_rng(2)
    often = jaccard.Frequent(50)
    values = np.concatenate([draw.integers(0, 10**6, 20_000), np.repeat(np.arange(5), 1200)]).astype(np.uint64)
    draw.shuffle(values)
    for part in np.array_split(values, 40):
        often.add(part)
    assert set(range(5)) <= set(often.value.tolist()) and len(often.value) <= 50


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (None, 3), (301, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)} | {300: 300, 301: 300}


def brute_lines(texts):
    lines = [(t.split("\n") if t is not None else None) for t in texts]
    filled = [[i for i, x in enumerate(own or []) if x.strip(" \t\x0b\f\r")] for own in lines]
    seen, gone = set(), defaultdict(set)
    for k, places in enumerate(filled):
        for j in range(len(places) - 2):
            window = tuple(lines[k][i] for i in places[j : j + 3])
            if window in seen:
                gone[k] |= set(places[j : j + 3])
            seen.add(window)
    return {k: (None if own is None else "\n".join(x for i, x in enumerate(own) if i not in gone[k]), len(filled[k]), len(gone[k])) for k, own in enumerate(lines)}


def test_line_dedup(spark, clashing, none):
    draw = random.Random(9)
    texts = [*ODD, *["\n".join(draw.choice(["a", "b", "c", "", " ", "d"]) for _ in range(draw.randint(1, 14))) for _ in range(120)]]
    got = rows(linededup.dedup_lines(documents(spark, texts)))
    assert {k: (r["text"], r["n_lines"], r["n_removed"]) for k, r in got.items()} == brute_lines(texts)
    assert linededup.dedup_lines(none).count() == 0
    assert linededup.dedup_lines(clashing).count() == len(ODD)
    same = linededup.dedup_lines(documents(spark, ["a\nb\nc"] * 2, [5, 5])).collect()
    assert [r["text"] for r in same] == ["a\nb\nc"] * 2


def test_short_copies_in_the_pipeline(spark):
    texts = ["a b", "\na b\n \n", "a b\nc", "a b\nc", "a b\nc\nd", "c", "", None, " ", "c\na b", "x\na b\nc\nd"]
    docs = documents(spark, texts)
    want = {k: t for k, t in enumerate(texts) if k not in (1, 3)} | {10: "x"}
    got = rows(corpus_pipeline.drop_repeated_lines(spark, docs, ""))
    assert {k: r["text"] for k, r in got.items()} == want
    assert {k: r["n_removed"] for k, r in rows(linededup.dedup_lines(docs, short=True)).items() if r["n_removed"]} == {1: 1, 3: 2, 10: 3}
    assert {k: r["n_removed"] for k, r in rows(linededup.dedup_lines(docs)).items() if r["n_removed"]} == {10: 3}


def test_long_texts_in_linear_time(spark):
    lines = "\n".join(f"line {k % 10_000} of {k % 7}" for k in range(20_000))
    mails = " and ".join(f"mail{k}@host{k % 50}.example.com" for k in range(10_000))
    done = linededup.dedup_lines(documents(spark, [lines, lines + "\nlast"])).orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_removed"]) for r in done] == [(20_000, 0), (20_001, 20_000)] and done[1]["text"] == "last"
    assert pii.digests(documents(spark, [mails])).first()["n_email"] == 10_000
    assert pii.redact(documents(spark, [mails + " end"])).first()["text"] == " and ".join(["[EMAIL]"] * 10_000) + " end"


def pipeline_texts():
    good = "The house and the garden of the old town were in the light of the sun. "
    own = [good.replace("old", f"old{k}").replace("house", f"house{k}") + " ".join(f"word{k}x{j} of the day{j * k + j}." for j in range(70)) for k in range(30)]
    return [*own, own[3], own[4].replace("day10", "night10"), "short", None, "buy !! " * 80, own[7] + " mail me at some.body@mail1.example.com today."]


EXTRA = {"spans": "s", "_first": "f", "quality": "q", "kept": "k", "n_words": "w", "n_lines": "l", "n_removed": "r", "name": "n", "root": "o", "size": "z", "bucket": "b", "key": "y", "shard": "h", "slot": "t", "row": "x", "_rank": "a", "_part": "p", "component_id": "c", "_id": "i", "_whole_row": "e"}


def crowded(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(v).alias(k) for k, v in EXTRA.items()])


def test_stages_keep_columns_of_any_name_and_take_nulls_and_empty_tables(spark):
    texts = pipeline_texts()
    docs = crowded(documents(spark, texts, [None, 2**53 + 1, *range(2, len(texts) - 1), None]))
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), "")
        assert empty.count() == 0
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, ""))
        if name != "best-fit packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
            assert {tuple(r[k] for k in EXTRA) for r in docs.collect()} == {tuple(EXTRA.values())}
    assert {None, 2**53 + 1, 2, 3} <= {r["doc_id"] for r in docs.collect()}


def test_operators_ignore_columns_of_any_name_and_keep_large_and_null_ids(spark):
    ids = [None, 2**53 + 1, 2**53 + 3]
    docs = crowded(documents(spark, ["a b c d e f", "x\ny\nz", None], ids))
    path, words = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
    for found in (bpe.digests(docs, path, public_tokenizers.PATTERN), bpe.encode(docs, path, public_tokenizers.PATTERN), shards.assign(docs, 24), licenses.scan(docs), packing.pack(packing.pieces(docs, words)), quality.digests(docs), pii.digests(docs), jaccard.near_duplicates(docs), linededup.dedup_lines(docs)):
        assert sorted((r["doc_id"] for r in found.collect()), key=str) == sorted(ids, key=str)
    pages = crowded(spark.createDataFrame([(i, None, "<article><p>It is so.</p></article>") for i in ids], "page_id long, url string, html string"))
    assert sorted((r["page_id"] for r in html.extract(pages).collect()), key=str) == sorted(ids, key=str)
    vectors = crowded(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in ids], "vec_id long, embedding array<float>, label int"))
    assert {r["n_links"] for r in caps.near_duplicates(vectors).collect()} == {2}


def test_jump_hash_is_the_plain_one():
    def plain(key, shards_):
        b, j = -1, 0
        while j < shards_:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
        return b

    keys = np.random.default_rng(1).integers(0, 2**63, 2000).astype(np.uint64)
    for count in (1, 2, 24, 25, 1000):
        assert shards.jump_hash(keys.copy(), count).tolist() == [plain(int(k), count) for k in keys.tolist()]


def brute_posteriors(patterns, rounds=200):
    """The expectation-maximisation of the quality rules, written for one pattern and rule at a time."""
    votes = {c: quality.pattern_votes(c) for c in patterns}
    good = {}
    for c, v in votes.items():
        good[c] = min(0.98, max(0.02, 0.5 + 0.5 * sum(v) / max(1, sum(x != 0 for x in v))))
        if sum(x < 0 for x in v) >= 2:
            good[c] = min(good[c], 0.3)
    for _ in range(rounds):
        weight = {c: (n * (1 - good[c]), n * good[c]) for c, n in patterns.items()}
        share = (sum(w[1] for w in weight.values()) + 1) / (sum(patterns.values()) + 2)
        chance = [[(sum(weight[c][k] for c in votes if votes[c][j] > 0) + 1) / (sum(weight[c][k] for c in votes if votes[c][j]) + 2) for j in range(len(quality.RULES))] for k in (0, 1)]
        for c, v in votes.items():
            odds = share / (1 - share)
            for j, x in enumerate(v):
                odds *= chance[1][j] / chance[0][j] if x > 0 else (1 - chance[1][j]) / (1 - chance[0][j]) if x < 0 else 1
            good[c] = odds / (1 + odds)
    return good


def test_quality_verdicts_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    patterns = quality.pattern_counts(docs)
    want = brute_posteriors(patterns)
    got, _ = quality.expectation_maximisation(patterns)
    assert all(abs(got[c] - want[c]) < 1e-5 for c in patterns)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.digests(docs).collect():
        raw = np.frombuffer((texts[r["doc_id"]] or "").encode(), np.uint8)
        code = int(quality.pattern_of(quality.votes(quality.measure(raw, np.array([0, len(raw)]))))[0])
        if abs(want[code] - 0.5) > 1e-4:
            assert r["kept"] == (not r["base_failed"] and want[code] >= 0.5)


def test_near_duplicates_go_by_row_whatever_their_ids(spark):
    """Null and repeated ids are rows like others: of each group one stays, and no row stays because of another's id."""
    base, other, third = (" ".join(f"{p}{k}" for k in range(40)) for p in "tuv")
    rows = [(5, base), (None, base + " x"), (None, other), (7, third), (7, base + " q"), (None, other + " z"), (9, third), (9, third), (None, None), (4, "   "), (None, "few"), (None, "few")]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    got = corpus_pipeline.keep_one_of_each(spark, docs, "").select("doc_id", "text").collect()
    first = min([other, other + " z"], key=lambda t: f"{len(t)}:{hashlib.md5(t.encode()).hexdigest()}")
    assert sorted(map(tuple, got), key=repr) == sorted([(5, base), (None, first), (7, third), (None, None), (4, "   "), (None, "few")], key=repr)


def test_pipeline_stages(spark, monkeypatch):
    texts = pipeline_texts()
    docs = documents(spark, texts)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, ""))
        if name == "quality rules":
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {*range(32), 35}
        if name == "n-gram Jaccard join":
            kept = {r["doc_id"]: r["text"] for r in before.collect()}
            components_ = brute_components([kept.get(k) for k in range(len(texts))])
            assert {r["doc_id"] for r in docs.collect()} == {k for k in kept if components_[k][1] == k}
        if name == "PII":
            assert not docs.where("text like '%@%'").count()
        assert name == "best-fit packing" or docs.columns == before.columns
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)
