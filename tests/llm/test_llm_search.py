"""Decontamination, the prefix trie and lexical search against brute force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridlens.llm import decontam, lexical, trie
from gridlens.llm.fmindex import FMIndex, suffix_order
from gridlens.llm.textvec import run_hash

DOCS = "doc_id long, text string, item_id string, spans string, n_words int, _row int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_TO_Z = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(A_TO_Z))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, None) for i, t in rows], DOCS).repartition(3)


def texts(seed, count=60, vocabulary=9):
    draw = random.Random(seed)
    out = [None, "", " .,\n", "É é ß", "word", "x" * 5000, "A a A a " * 300]
    out += ["".join(draw.choice(["w%d " % draw.randrange(vocabulary), "W0, ", "other\n"]) for _ in range(draw.randrange(1, 120))) for _ in range(count)]
    return out + out[-3:]


def test_suffixes_stand_in_order():
    draw = random.Random(3)
    for size in (2, 3, 900):
        for n in (1, 2, 70, 400):
            symbols = np.array([draw.randrange(size) if draw.random() < 0.95 else 0 for _ in range(n)] + [0])
            ends = np.flatnonzero(symbols == 0)
            key = lambda p: [*symbols[p : (e := ends[np.searchsorted(ends, p)])].tolist(), -len(symbols) + int(e)]  # noqa: E731,B023
            want = sorted(range(len(symbols)), key=lambda p: [(0, s) if s < 0 else (1, s) for s in key(p)])
            assert suffix_order(symbols, max(1, (size - 1).bit_length())).tolist() == want


def test_index_finds_and_locates_every_place():
    draw = random.Random(4)
    symbols = np.array([draw.choice([0, 1, 1, 2, 3, 1, 2]) for _ in range(3000)] + [0])
    index = FMIndex(symbols, 4)
    for length in (1, 2, 5):
        phrases = np.array([[draw.randint(1, 3) for _ in range(length)] for _ in range(60)])
        low, high = index.search(phrases, length)
        for phrase, lo, hi in zip(phrases, low, high, strict=True):
            want = [p for p in range(len(symbols) - length + 1) if (symbols[p : p + length] == phrase).all()]
            assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


def brute_hits(docs, items, window):
    parts = {}
    for item, text in items:
        own = words(text)
        size = min(window, len(own))
        for k in range(len(own) - size + 1) if own else ():
            parts.setdefault(tuple(own[k : k + size]), set()).add(item)
    out = []
    for doc, text in docs:
        own, covered, found = words(text), set(), set()
        for size in {len(p) for p in parts}:
            for k in range(len(own) - size + 1):
                if (who := parts.get(tuple(own[k : k + size]))) is not None:
                    covered |= set(range(k, k + size))
                    found |= {str(i) for i in who if i is not None}
        out.append((doc, len(own), len(covered), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [decontam.BLOCK, 40])
def test_decontamination_is_brute_force_s(spark, block):
    docs = [(k % 50 if k != 9 else None, t) for k, t in enumerate(texts(1))]
    some = texts(2, 12)
    items = [(k % 14 if k else None, t) for k, t in enumerate([*some, "w1", "w2 w0", docs[30][1], docs[31][1]])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.scan(docs_of(spark, docs), bench, 6, block).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in found), key=repr) == brute_hits(docs, items, 6)
    assert all(r["n_hit"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in found)
    assert all(a["end"] < b["start"] for r in found for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_shards_cut_in_pieces_lose_nothing(spark):
    own = [run_hash(t, decontam._WORD) for t in ("w1 w2 w3", "w2 w2", "w0")]
    listed = spark.createDataFrame([(str(k), [h - (1 << 64) if h >> 63 else h for h in o]) for k, o in enumerate(own)], "item string, words array<long>").toArrow()
    phrases = decontam.Phrases(listed)
    draw = random.Random(6)
    hashes = np.array([draw.choice([h for o in own for h in o] + [5]) for _ in range(900)], np.uint64)
    row = np.sort(np.array([draw.randrange(20) for _ in range(900)]))
    whole, pieces = (decontam.shard_hits(phrases.symbols(hashes), row, phrases, limit) for limit in (1 << 20, 11))
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all() and whole[0].any()


def test_decontamination_removes_spans_and_keeps_the_rest(spark):
    bench = spark.createDataFrame([(1, "one two Three four"), (2, None), (3, "é")], "item_id long, text string")
    docs = docs_of(spark, [(1, "a one, TWO-three\nfour b"), (2, None), (3, "x É é y"), (4, "one two")])
    got = {r["doc_id"]: r["text"] for r in decontam.remove(docs, bench, 4).collect()}
    assert got == {1: "a  b", 2: None, 3: "x É  y", 4: "one two"}
    assert decontam.remove(docs, bench, 4).columns == docs.columns


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of(spark, [(1, "a b"), (None, None)])
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, decontam.digests(docs, none).collect()), key=repr) == [(1, 2, 0, 0, empty, False), (None, 0, 0, 0, empty, False)]
    assert decontam.digests(docs_of(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


TURNS = "conv_id long, turn long, role string, text string, depth string, owner string, place int"


def brute_trie(rows, shared):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(own)] for c, own in convs.items()}
    if shared:
        first = lambda c: zlib.crc32(str(c).encode()) % 4
        convs = {c: convs.get(c - int(math.fmod(c, 20)), [])[: first(c)] + own[first(c) :] for c, own in convs.items()}
    members = {}
    for c, own in convs.items():
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    below = lambda p: [q for q in members if q[: len(p)] == p]
    size = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, who in members.items():
        done = ",".join(str(c) for c in sorted(c for c in who if len(convs[c]) == len(p)))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(who), len(p), parent, len(who), kids[p], sum(not kids[q] for q in below(p)), sum((len(members[q]) - 1) * size(q) for q in below(p)), hashlib.sha256(done.encode()).hexdigest()))
    return sorted(out)


def conversations(seed):
    draw = random.Random(seed)
    rows = []
    for c in [*range(70), -3, -20, 1 << 40, (1 << 40) + 1]:
        for k in range(draw.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, draw.choice([k, k, k, None, 1]), draw.choice(["user", "assistant", None, ""]), draw.choice(["a b", "a", None, "", "c  d\te", "user:a"])))
    rows += [(None, 1, "user", "lost"), (60, 1, "user", "again"), (60, 1, "user", "again")]
    return [*rows, *[(c, k, "user", f"turn {k}") for c in (500, 501, 520) for k in range(150 + c % 10)]]


@pytest.mark.parametrize("shared", [False, True])
def test_trie_is_brute_force_s(spark, shared):
    rows = conversations(7)
    table = spark.createDataFrame([(*r, None, None, None) for r in rows], TURNS).repartition(5)
    got = (trie.build_rebuilt if shared else trie.build)(table).collect()
    assert sorted(map(tuple, got)) == brute_trie(rows, shared)


def test_trie_of_nothing_and_of_copies(spark):
    assert trie.build_rebuilt(spark.createDataFrame([], TURNS)).count() == 0
    rows = [(c, 0, "user", "same words") for c in range(0, 40_000, 20)]
    got = sorted(map(tuple, trie.build(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    none, ends = (hashlib.sha256(s.encode()).hexdigest() for s in ("", ",".join(str(r[0]) for r in rows)))
    assert got == [(0, 0, None, 2000, 1, 1, 3998, none), (0, 1, 0, 2000, 0, 1, 3998, ends)]


def brute_ranks(docs, items, k):
    counted = [(d, Counter(words(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counted:
            m = 75 + 25 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, at + 1, None if none else d, -s) for at, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [lexical.BLOCK, 7])
def test_search_is_brute_force_s(spark, block):
    docs = [(k if k != 20 else None, t) for k, t in enumerate(texts(8, 90, 30))]
    items = list(enumerate([None, "", "nowhere", "w1 w1 W2 é word", "other w0 w7", *texts(9, 6, 40)[7:]]))
    index = lexical.build_index(docs_of(spark, docs)).cache()
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), 5, block)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_ranks(docs, items, 5)


def test_search_goes_through_windows(spark):
    docs = [(k, f"w{k % 7} w{k % 11} all") for k in range(300)]
    items = [(1, "w3 all w5"), (2, "w9 w1 w1")]
    index = lexical.build_index(docs_of(spark, docs).coalesce(1))
    row = index.collect()[0].asDict()
    queries = lexical.Queries(lexical.query_terms(spark.createDataFrame(items, "item_id long, text string")).toArrow())
    df = Counter(t for _, text in docs for t in set(words(text)))
    held = {h - (1 << 64) if h >> 63 else h: n for t, n in df.items() for h in run_hash(t, lexical._WORD)}
    queries.weigh(held, 300)
    found = dict(lexical.best(lexical.Segment(row), queries, 300, 900, 4, window=16))
    got = sorted(((queries.items[q], -i, s) for q, heap in found.items() for s, _, i in heap), key=repr)
    assert got == sorted(((i, d, s) for i, _, d, s in brute_ranks(docs, items, 4)), key=repr)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.rank_items(docs_of(spark, [(1, "a")]), none).count() == 0
    assert lexical.rank_items(docs_of(spark, []), one).count() == 0
    assert lexical.rank_items(docs_of(spark, [(1, None), (2, "")]), one).count() == 0


def test_lengths_beyond_64_bits():
    assert lexical._norms(np.array([10**8, 1]), 10**12, 10**13).tolist() == [75 + 25 * 10**20 // 10**13, 77]
