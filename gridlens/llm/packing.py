"""Best-fit packing of tokenised documents into sequences of fixed length, by exact complements.

Pieces matter only by length, so the plan is made from the counts of each length: at most `limit` numbers, whatever
the corpus. From the longest length down, the gap a piece leaves is looked up among the sums of single lengths, pairs
and triples; a combination found is consumed as often as all its lengths are still available. Every such step uses up
a length, so there are at most `limit` of them. What remains is packed by best fit. The plan then meets the pieces:
the r-th piece of a length takes the r-th place planned for that length.

A null or empty text is a document of its end token alone; a null doc_id stays null; repeated rows are packed each. Of
`pieces` other columns of the documents are ignored, in `pack` they stay. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.frames import gapless_rank, stored

LIMIT = 4096
CACHED_PARTS = 700_000
RANK_PARTS = 256


class WordCoder:
    """Ids of the parts that a text falls into before the merges; each distinct part is coded once, many to a call.

    A text of plain characters is lowered and cut here just as the tokenizer would; any other is cut at ASCII white
    space only, across which the tokenizer never joins. What is kept is bounded in number; parts are short but for a few.
    """

    #: Characters that no normalisation joins with others and that have one lower-case form each, and how they are cut.
    PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
    CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _code(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(c.ids, "<u4") for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.PLAIN.fullmatch(text) and "<|" not in text:
            return self.CUT.findall(text.lower())
        return [w.decode() for w in text.encode().split()]

    def learn(self, parts: set[str]) -> None:
        """Codes the parts that are not known; afterwards all of them are."""
        new = list(parts - self.known.keys())
        if len(self.known) + len(new) > CACHED_PARTS:
            self.known, new = {}, list(parts)
        # A part of plain letters ends in a token that ends a word, so many can be told apart in one text.
        simple = [p for p in new if p.isalpha() and self.PLAIN.fullmatch(p)]
        for i in range(0, len(simple), 8192):
            some = simple[i : i + 8192]
            ids = np.concatenate(self._code([" ".join(some[k : k + 64]) for k in range(0, len(some), 64)]))
            cuts = np.concatenate([[0], np.flatnonzero(self.last[ids]) + 1]) * 4
            raw = ids.tobytes()
            self.known.update(zip(some, [raw[lo:hi] for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], strict=True))
        rest = [p for p in new if p not in self.known]
        for i in range(0, len(rest), 8192):
            for part, ids in zip(rest[i : i + 8192], self._code(rest[i : i + 8192]), strict=True):
                self.known[part] = ids.tobytes()


@lru_cache(maxsize=2)
def _coder(path: str) -> WordCoder:
    return WordCoder(path)


def token_ids(texts: list[str | None], path: str, end_id: int) -> Iterator[np.ndarray]:
    """Ids of each text, then `end_id`."""
    coder = _coder(path)
    cut = [coder.cut(t) for t in texts]
    coder.learn(set().union(*cut))
    get, end = coder.known.__getitem__, np.array([end_id], "<u4").tobytes()
    for parts in cut:
        yield np.frombuffer(b"".join(map(get, parts)) + end, "<u4")


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every whole document cut only where it exceeds `limit` tokens."""
    from gridlens.llm.bpe import text_slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, rows = 0, []
            for part in text_slices(batch.column("text").to_pylist()):
                for ids in token_ids(part, tokenizer, end_id):
                    for piece, start in enumerate(range(0, len(ids), limit)):
                        cut = ids[start : start + limit]
                        rows.append((row, piece, start, len(cut), zlib.crc32(cut.tobytes())))
                    row += 1
            own, piece, start, length, check = (list(c) for c in zip(*rows, strict=True)) if rows else ([],) * 5
            ids = batch.column("doc_id").take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, check)]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Sums:
    """Lengths with pieces left, and which pairs of them sum to what; the pair index may be stale and is checked on use."""

    def __init__(self, counts: dict[int, int], limit: int):
        self.count = np.zeros(limit + 1, np.int64)
        for length, n in counts.items():
            self.count[length] = n
        there = (self.count > 0).astype(np.float64)
        size = 1 << (2 * limit + 2).bit_length()
        both = np.fft.irfft(np.fft.rfft(there, size) ** 2, size)[: limit + 1]
        self.pair_sum = both > 0.5

    def pair(self, gap: int) -> tuple[int, int] | None:
        """Two lengths that sum to gap, the longer as long as can be."""
        if gap < 2 or not self.pair_sum[gap]:
            return None
        low = self.count[1 : gap // 2 + 1]
        good = np.flatnonzero((low > 0) & (self.count[gap - 1 : gap - gap // 2 - 1 : -1] > 0)) + 1
        if gap % 2 == 0 and len(good) and good[-1] == gap // 2 and self.count[gap // 2] < 2:
            good = good[:-1]
        if not len(good):
            self.pair_sum[gap] = False
            return None
        return int(good[0]), gap - int(good[0])

    def find(self, length: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill exactly what `length` leaves."""
        gap = len(self.count) - 1 - length
        if gap < 1:
            return ()
        if self.count[gap] > (gap == length):
            return (gap,)
        if found := self.pair(gap):
            return found
        first = np.flatnonzero(self.count[1 : gap - 1] > 0) + 1
        for a in first[self.pair_sum[gap - first]][::-1].tolist():
            if self.pair_sum[gap - a] and (found := self.pair(gap - a)):
                return (a, *found)
        return None


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for the given counts of each length from 1 to limit."""
    sums = _Sums(counts, limit)
    count, out = sums.count, []
    for length in range(limit, 0, -1):
        while count[length]:
            found = sums.find(length)
            if found is None:
                break
            need = Counter((length, *found))
            times = min(int(count[x]) // k for x, k in need.items())
            if not times:
                break
            for x, k in need.items():
                count[x] -= k * times
            out.append(((length, *found), times))
    # Best fit of the rest, longest first; sequences with equal gaps and contents stand as one entry with a count.
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(limit, 0, -1):
        left = int(count[length])
        while left:
            gap = min((g for g, held in open_by_gap.items() if g >= length and held), default=0)
            held, times = open_by_gap[gap].pop() if gap else ((), left)
            room = (gap or limit) // length
            full = min(times, left // room)
            if full:
                open_by_gap.setdefault((gap or limit) - room * length, []).append(((*held, *[length] * room), full))
                left -= full * room
                if gap and times > full:
                    open_by_gap[gap].append((held, times - full))
            else:  # fewer pieces are left than one sequence takes
                open_by_gap.setdefault((gap or limit) - left * length, []).append(((*held, *[length] * left), 1))
                if gap and times > 1:
                    open_by_gap[gap].append((held, times - 1))
                left = 0
    return out + [entry for held in open_by_gap.values() for entry in held]


def places(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, step, offset): the places for each length, in ranks of its pieces."""
    out, sequence, used = [], 0, Counter()
    for lengths, times in planned:
        offset = 0
        for length in lengths:
            out.append((length, used[length], used[length] + times, sequence, 1, offset))
            used[length] += times
            offset += length
        sequence += times
    return out


def pack(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds sequence_id and offset to pieces with a `length` from 1 to limit.

    The counts that reach the driver are at most `limit` rows; the places sent to the tasks a few times as many.
    """
    held = stored(cut)
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    spread = F.struct(*[c for c in ("doc_id", "piece", "ids_crc32") if c in held.columns])
    ranked = gapless_rank(held, "length", [F.col(c) for c in ("doc_id", "piece", "ids_crc32") if c in held.columns], spread, RANK_PARTS, "_rank")
    table: dict[int, list[tuple[int, ...]]] = {}
    for length, low, high, sequence, _, offset in places(plan(counts, limit)):
        table.setdefault(length, []).append((low, high, sequence, offset))
    arrays = {length: np.array(rows, np.int64) for length, rows in table.items()}
    names = held.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for value in np.unique(length):
                here = np.flatnonzero(length == value)
                rows = arrays[int(value)]
                entry = rows[np.searchsorted(rows[:, 0], rank[here], side="right") - 1]
                sequence[here], offset[here] = entry[:, 2] + rank[here] - entry[:, 0], entry[:, 3]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
