"""Byte-level BPE encoding and decoding in length-bucketed padded matrices.

Distinct pieces of text (matches of the split pattern) are put in matrices of equal padded length, a power of two. In
each round every row finds the ranks of its adjacent pairs in a hash table, merges its leftmost pair of the lowest rank
and is compacted; rows without a pair leave. Where that pair stands in a row more than once, the places to the right
are merged in the same round, one after the other, up to the first merge that makes a pair of that rank or a lower one:
just these would be the next merges of a round each. So a long piece takes few rounds, and all lengths one way.

Null texts are empty: no ids. Repeated rows are encoded alike; a null key stays null. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.textvec import mix

NO_RANK = np.int32(2**31 - 1)
CACHED_PIECES = 300_000
ROWS = 1 << 16


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, NO_RANK, np.int32)
        key = (left.astype(np.int64) << 32) | right
        at, todo = self._home(key), np.arange(len(key))
        while len(todo):
            free = self.key[at] == -1
            slot, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.key[slot], self.value[slot] = key[todo[won]], merged[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, NO_RANK where the pair is none. Negative ids are padding."""
        flat_l, flat_r = left.ravel(), right.ravel()
        out = np.full(len(flat_l), NO_RANK, np.int32)
        live = np.flatnonzero((flat_l >= 0) & (flat_r >= 0))
        key = (flat_l[live].astype(np.int64) << 32) | flat_r[live]
        at = self._home(key)
        while len(live):
            seen = self.key[at]
            hit = seen == key
            out[live[hit]] = self.value[at[hit]]
            on = ~hit & (seen != -1)
            live, key, at = live[on], key[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


class Vocabulary:
    """Ranks of a rank file: bytes of each id, and the pairs that merge to each id."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.ranks = ranks
        # Every split of a token into two tokens is a pair whose merge has the token's rank.
        triples = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = PairTable(*np.array(triples, np.int64).reshape(-1, 3).T)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        if not len(ids):
            return b""
        size = self.length[ids]
        first = np.cumsum(size) - size
        return self.bytes[np.arange(int(size.sum())) - np.repeat(first - self.start[ids], size)].tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        length = np.array([len(p) for p in pieces], np.int64)
        low, width, longest = 0, 2, int(length.max(initial=0))
        while low < longest:
            chosen = np.flatnonzero((length > low) & (length <= width))
            step = max(1, ROWS * 8 // width)
            for i in range(0, len(chosen), step):
                self._matrix([pieces[k] for k in chosen[i : i + step]], chosen[i : i + step], width, out)
            low, width = width, 2 * width
        return out

    def _matrix(self, pieces: list[bytes], names: np.ndarray, width: int, out: list[np.ndarray]) -> None:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        left = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < left[:, None], self.single[raw], np.int32(-1))
        rank = np.full(ids.shape, NO_RANK, np.int32)
        rank[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(ids):
            best = rank.min(axis=1)
            done = best == NO_RANK
            if done.any():
                for row, name, n in zip(ids[done], names[done], left[done], strict=True):
                    out[name] = row[:n].copy()
                on = ~done
                ids, rank, names, left, best = ids[on], rank[on], names[on], left[on], best[on]
                if not len(ids):
                    return
            width = ids.shape[1]
            row, at = np.nonzero(rank == best[:, None])
            row, at = self._apart(row, at)
            # Each merge makes a pair with what is before it, merged or not, and one with what is after it, not yet merged.
            token = best[row]
            flat, flat_rank = ids.ravel(), rank.ravel()
            here = row * width + at
            after_merge = np.zeros(len(row), bool)
            after_merge[1:] = here[1:] - here[:-1] == 2
            after_merge &= at > 1
            before = np.where(at > 0, np.where(after_merge, token, flat[here - 1]), -1)
            after = np.where(at + 2 < width, flat[np.minimum(here + 2, len(flat) - 1)], -1)
            low, high = self.pairs.find(before, token), self.pairs.find(token, after)
            # A merge that makes a pair of its rank or a lower one is the last of its row in this round.
            stop = np.minimum(low, high) <= token
            first = np.searchsorted(row, np.arange(len(ids)))
            stops = np.cumsum(stop) - stop
            keep = stops == stops[first[row]]
            row, at, here, low, high, token, after_merge = (x[keep] for x in (row, at, here, low, high, token, after_merge))
            flat[here] = token
            flat_rank[here] = high
            # The pair before stands where the merge before it stands, or one place to the left.
            flat_rank[(here - 1 - after_merge)[at > 0]] = low[at > 0]
            # Compaction: what a merge has taken in goes, the rest moves to the left.
            stays = np.ones(ids.shape, bool)
            stays.ravel()[here + 1] = False
            left = left - np.bincount(row, minlength=len(ids))
            most = int(left.max())
            stays &= ids >= 0
            size = stays.sum(1)
            to_row = np.repeat(np.arange(len(ids)), size)
            to = to_row * most + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            new_ids, new_rank = np.full(len(ids) * most, np.int32(-1)), np.full(len(ids) * most, NO_RANK)
            chosen = stays.ravel()
            new_ids[to], new_rank[to] = flat[chosen], flat_rank[chosen]
            ids, rank = new_ids.reshape(-1, most), new_rank.reshape(-1, most)

    @staticmethod
    def _apart(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without the places that overlap the merge before them: every second one of a run of neighbours."""
        if not len(at):
            return row, at
        new = np.ones(len(at), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
        start = np.flatnonzero(new)
        nth = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
        return row[nth % 2 == 0], at[nth % 2 == 0]


class Encoder:
    """Encodes texts piece by piece; ids of pieces seen before are kept, a bounded number of them."""

    def __init__(self, path: str, pattern: str, cached: int = CACHED_PIECES):
        self.vocabulary, self.pattern, self.cached = Vocabulary.read(path), regex.compile(pattern), cached
        #: The ids of each piece as bytes, and in decimal.
        self.known: dict[str, bytes] = {}
        self.decimal: dict[str, str] = {}

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """(ids, decimal ids joined by spaces) of each text."""
        if len(self.known) > self.cached:
            self.known, self.decimal = {}, {}
        pieces = [self.pattern.findall(t) if t else [] for t in texts]
        new = list(set().union(*pieces) - self.known.keys())
        for piece, ids in zip(new, self.vocabulary.encode_pieces([p.encode() for p in new]), strict=True):
            self.known[piece] = ids.astype("<i4").tobytes()
            self.decimal[piece] = " ".join(map(str, ids.tolist()))
        raw, decimal = self.known.__getitem__, self.decimal.__getitem__
        for found in pieces:
            yield np.frombuffer(b"".join(map(raw, found)), "<i4"), " ".join(map(decimal, found))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path, pattern)


def text_slices(texts: list[str | None], limit: int = 1 << 20) -> Iterator[list[str | None]]:
    """Consecutive texts of about `limit` characters, each whole."""
    part: list[str | None] = []
    size = 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of every whole text; a null text has none. `vocabulary` is a rank file every executor can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, pattern)
        for batch in batches:
            at = 0
            for part in text_slices(batch.column("_t").to_pylist()):
                ids = pa.array([ids for ids, _ in coder.encode(part)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("_k").slice(at, len(part)), ids], ["k", "ids"])
                at += len(part)

    kind = docs.schema[key].dataType.simpleString()
    return docs.selectExpr(f"`{key}` as _k", f"`{text}` as _t").mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """Adds the bytes of each id sequence (null for null)."""
    @F.pandas_udf("binary")
    def to_bytes(column: pd.Series) -> pd.Series:
        words = encoder(vocabulary, r"\S+").vocabulary
        return column.map(lambda x: None if x is None else words.decode(np.asarray(x, np.int64)))

    return encoded.withColumn(out, to_bytes(ids))


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per document: the number of ids, the hash of the ids, and the hash of the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, pattern)
        for batch in batches:
            n, coded, back = [], [], []
            for part in text_slices(batch.column("text").to_pylist()):
                for ids, decimal in coder.encode(part):
                    n.append(len(ids))
                    coded.append(hashlib.sha256(decimal.encode()).hexdigest())
                    back.append(hashlib.sha256(coder.vocabulary.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
