"""License scan: exact set-containment join of text blocks with license templates.

Words are compared as sets. Tokens are ordered by how many blocks of the whole corpus they occur in, rarest first. A
block contains a template if at least ceil(threshold x template size) of the template's tokens are in it. Then it must hold one
of the template's first tokens in that order (prefix filter), be large enough (length filter), and after its first
match enough tokens must be left on both sides (positional filter). Survivors are verified: enough of the tokens must
stand in a run of `SPAN` times the template's words, with a word that tells the license from others and without one
that tells a rival; containment is counted over such runs. Templates are few and fixed, so their index goes to every
task; only counts of template tokens come back.

A block is a window of `BLOCK_WORDS` words of a text, at half steps, whatever line breaks lie in it: notices are wrapped.
Every run of half as many words lies within one. Null and empty texts have no words, labels or score; copies have equal
results; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.textvec import ALNUM, LOWER, Runs, flat_bytes, run_hash, slices

THRESHOLD, BLOCK_WORDS, SPAN, LEAD = 0.8, 256, 1.5, 24

#: The phrases of the base scan.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Notices, characteristic sentences and whole texts of well-known licenses.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2.0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("ecl", "licensed under the educational community license version 2.0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("mpl", "the contents of this file are subject to the mozilla public license version 1.1 the license you may not use this file except in compliance with the license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("ofl", "this font software is licensed under the sil open font license version 1.1"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    (
        "0bsd",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties "
        "with regard to this software including all implied warranties of merchantability and fitness",
    ),
    ("artistic", "you may distribute under the terms of either the gnu general public license or the artistic license"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    (
        "apache",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
    (
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2.0"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    (
        "ofl",
        "permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy merge embed modify redistribute and sell modified and unmodified copies of the font software "
        "subject to the following conditions neither the font software nor any of its individual components in original or modified versions may be sold by itself",
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version "
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
    ),
    (
        "apache",
        "apache license version 2.0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution 1 definitions license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    ),
    ("gpl", "gnu general public license version 3 29 june 2007 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("lgpl", "gnu lesser general public license version 3 29 june 2007 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("agpl", "gnu affero general public license version 3 19 november 2007 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]
#: Words that tell a license from others. A template that holds one of its label's is found only with one of them.
TELLING = {
    "mit": ["mit"],
    "apache": ["apache"],
    "gpl": ["general"],
    "lgpl": ["lesser", "library general"],
    "agpl": ["affero"],
    "cc-by-nc": ["nc", "noncommercial", "non commercial"],
    "cc-by-sa": ["sa", "sharealike", "share alike"],
    "mpl": ["mozilla"],
    "ecl": ["educational community"],
    "ofl": ["font"],
    "epl": ["eclipse"],
    "artistic": ["artistic"],
}
#: Words of rivals, which a label's templates do not hold.
RIVAL = {"mit": ["accompanying documentation", "font software"], "0bsd": ["provided that"], "apache": ["ecl", "educational community", "mozilla"], "gpl": ["lesser", "affero"], "cc-by": [*TELLING["cc-by-nc"], *TELLING["cc-by-sa"], "nd", "noderivatives", "noderivs", "no derivatives", "no derivs"]}


class Index:
    """Templates as token sets, and the prefix index over them in a global order."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[int, int], threshold: float):
        self.labels = [label for label, _ in templates]
        sets = [sorted(set(run_hash(text, ALNUM))) for _, text in templates]
        #: Rarest first; ties by hash. The place of a token here is its place in the global order.
        self.order = sorted({t for s in sets for t in s}, key=lambda t: (frequency.get(t, 0), t))
        place = {t: i for i, t in enumerate(self.order)}
        self.sets = [sorted(place[t] for t in s) for s in sets]
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in self.sets]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (tokens, need) in enumerate(zip(self.sets, self.need, strict=True)):
            for i, token in enumerate(tokens[: len(tokens) - need + 1]):
                self.prefix.setdefault(token, []).append((k, i))
        hashes = np.array(self.order, np.uint64)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        self.members = [frozenset(s) for s in self.sets]
        words = [run_hash(text, ALNUM) for _, text in templates]
        self.span = [math.ceil(SPAN * len(w)) for w in words]
        hashed = lambda phrases: [run_hash(p, ALNUM) for p in phrases]
        own = [hashed(TELLING.get(label, [])) for label in self.labels]
        self.telling = [tells if any(_places(np.array(w, np.uint64), t) for t in tells) else [] for tells, w in zip(own, words, strict=True)]
        self.rival = [hashed(RIVAL.get(label, [])) for label in self.labels]
        #: A sentence that names no license, of a license that has a name, is also barred by a rival shortly before it.
        self.lead = [LEAD if tells and not found else 0 for tells, found in zip(own, self.telling, strict=True)]
        #: Every run of a template's span must lie within one block.
        self.block_words = max([BLOCK_WORDS, *(2 * n for n in self.span)])

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place in the global order, -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.by_hash[at], -1)

    def candidates(self, block: list[int], size: int) -> list[int]:
        """Templates contained in a block's distinct template tokens in global order, given its count of distinct words."""
        out, seen = [], set()
        for j, token in enumerate(block):
            for k, i in self.prefix.get(token, ()):
                if k in seen:
                    continue
                seen.add(k)  # the first common token decides: earlier ones would have been met
                need, total = self.need[k], len(self.sets[k])
                if size < need or 1 + min(total - i - 1, len(block) - j - 1) < need:
                    continue
                if sum(t in self.members[k] for t in block) >= need:
                    out.append(k)
        return out

    def containment(self, k: int, tokens: list[int], hashes: np.ndarray) -> float:
        """The largest containment of template k in a run of its span in a block's words; 0 if no run holds enough and tells."""
        members, span = self.members[k], self.span[k]
        tells = [(i, i + len(t)) for t in self.telling[k] for i in _places(hashes, t)]
        if self.telling[k] and not tells:
            return 0.0
        bars = sorted(i for t in self.rival[k] for i in _places(hashes, t))
        most = 0
        for start in sorted({i for i, t in enumerate(tokens) if t in members} | {i for i, _ in tells}):
            if any(start - self.lead[k] <= i < start for i in bars):
                continue
            stop = min([start + span, *(i for i in bars if i >= start)])
            if not self.telling[k] or any(start <= i and j <= stop for i, j in tells):
                most = max(most, len(members.intersection(tokens[start:stop])))
        return most / len(members) if most >= self.need[k] else 0.0


def _places(hashes: np.ndarray, phrase: list[int]) -> list[int]:
    """Where the words of a phrase stand in a row."""
    size = len(hashes) - len(phrase) + 1
    if size < 1:
        return []
    hit = np.ones(size, bool)
    for k, word in enumerate(phrase):
        hit &= hashes[k : k + size] == np.uint64(word)
    return np.flatnonzero(hit).tolist()


def blocks(words: Runs, size: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(word, block) pairs: every word in its text's one or two blocks; block numbers rise with the words' places."""
    step = size // 2
    part = words.place() // step
    parts = -(-words.per_row // step)
    base = (np.cumsum(parts) - parts)[words.row]
    early = np.flatnonzero(part > 0)
    return np.concatenate([np.arange(len(words)), early]), np.concatenate([base + part, (base + part)[early] - 1])


def _each_slice(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        data, offsets = flat_bytes(batch.column("text"))
        for i, j in slices(offsets):
            folded = LOWER[data[offsets[i] : offsets[j]]]
            words = Runs(folded, offsets[i : j + 1] - offsets[i], ALNUM)
            yield batch.slice(i, j - i), words, words.hashes()


def token_frequencies(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[int, int]:
    """In how many blocks of all documents each template token occurs; as many rows as the templates have tokens."""
    index = Index(templates, {}, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, hashed in _each_slice(batches):
            token = index.tokens(hashed)
            word, block = blocks(words, index.block_words)
            held = token[word] >= 0
            pair = np.unique(block[held] * len(index.order) + token[word][held])
            found, n = np.unique(pair % len(index.order), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    rows = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {index.order[r["token"]]: r["n"] for r in rows}


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest containment of a template found, 1 where a base phrase stands, else 0.
    """
    templates = TEMPLATES if templates is None else templates
    index = Index(templates, token_frequencies(docs, templates), threshold)
    phrases = [(label, run_hash(text, ALNUM)) for label, text in PHRASES.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, hashed in _each_slice(batches):
            n = part.num_rows
            place = words.place()
            count, first, last = np.zeros(n, np.int64), np.full(n, 2**62), np.full(n, -1)
            base: list[set[str]] = [set() for _ in range(n)]
            for label, phrase in phrases:
                size = len(hashed) - len(phrase) + 1
                if size < 1:
                    continue
                hit = words.row[:size] == words.row[len(phrase) - 1 :]
                for k, word in enumerate(phrase):
                    hit = hit & (hashed[k : k + size] == np.uint64(word))
                at = np.flatnonzero(hit)
                np.add.at(count, words.row[at], 1)
                np.minimum.at(first, words.row[at], place[at])
                np.maximum.at(last, words.row[at], place[at])
                for row in np.unique(words.row[at]).tolist():
                    base[row].add(label)
            labels, score = [set(b) for b in base], np.where(count > 0, 1.0, 0.0)
            word, block = blocks(words, index.block_words)
            token = index.tokens(hashed)
            # Only blocks with a prefix token of some template can match.
            lead = np.zeros(len(index.order) + 1, bool)
            lead[list(index.prefix)] = True
            chosen = np.unique(block[lead[token[word]]])
            held = np.isin(block, chosen)
            word, block = word[held], block[held]
            order = np.argsort(block, kind="stable")
            word, block = word[order], block[order]
            cuts = np.flatnonzero(np.diff(block)) + 1
            for group in np.split(word, cuts) if len(word) else []:
                inside = np.unique(token[group])
                for k in index.candidates(inside[inside >= 0].tolist(), len(np.unique(hashed[group]))):
                    row = int(words.row[group[0]])
                    if share := index.containment(k, token[group].tolist(), hashed[group]):
                        labels[row].add(index.labels[k])
                        score[row] = max(score[row], share)
            none = pa.array(count == 0)
            cleared = lambda values: pc.if_else(none, pa.scalar(None, pa.int64()), pa.array(values.astype(np.int64)))
            joined = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(words.per_row.astype(np.int64)), pa.array(count), cleared(first), cleared(last), joined(base), joined(labels), pa.array(score.astype(float))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
