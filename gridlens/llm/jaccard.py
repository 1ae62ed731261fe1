"""Near-duplicates by n-gram Jaccard similarity, as a T-occurrence search over inverted lists.

A document is the set of its distinct word shingles; equal sets are one class. To link, two classes must share
T = ceil(similarity x larger size) shingles at least. The search is DivideSkip: a class's lists are put in one order for
the whole corpus, short lists first, and divided. The L longest are not merged. The short rest is merged with a heap; a
class that stands on T - L of them at least is a candidate, for only L of the shared lists can be among the long ones.
Then the long lists are probed for the candidate by binary search, and it is retained if it reaches the overlap. Both
sides merge their short lists, so a candidate is met on the first T - L lists that the two share.

Components do not need every link, so the search runs twice. First each class on a list asks for the list's head only;
this links most of a large group of near copies without its pairs. Then all classes on the lists that still hold more
than one component ask for each other, across components: no link between different components is missed, by any cut.

Dealing: lists that hold many of all postings are found first by mergeable counters (`HOT` of them at most). Their
postings go to their classes at once, in no one place. Where postings are merged, every list of more than `PART` classes
is cut into parts, and each two parts meet in a task. All other lists are grouped in buckets whose number grows with the postings, about
`POSTINGS` a bucket. Postings travel packed: one row holds a bucket's postings from a slice of texts.

Texts that are null or have no words have no set and link with nothing; with fewer than n words the whole sequence is
the one shingle. Shingles are compared by 64-bit hashes, sets by 128 bits: two sets under one 64-bit name are told apart
by a second hash, and get that as their name. Rows with equal doc_id are separate rows of one document; a null doc_id
gets the smallest doc_id linked with it, if any. An empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from gridlens.llm.components import components
from gridlens.llm.frames import dealt_join, parallelism, stored
from gridlens.llm.textvec import LOWER, NOT_SPACE, Runs, flat_bytes, mix, slices, windows

WORDS, PERCENT = 5, 75
HOT, POSTINGS, PART = 4096, 2_000_000, 1 << 17
#: Pairs of a bucket that are held before they go on, and buckets of asking classes for each bucket of postings.
PAIRS, ASKS = 1 << 20, 4
#: How much dearer it is to merge a list than to probe it, for each doubling of the longest list.
PROBE_COST = 0.0085
_SEEDS = mix(np.arange(1, 65, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles in order of row, row of each, set size of each row)."""
    words = Runs(data, offsets, NOT_SPACE, LOWER)
    hashed = words.hashes()
    shingle, first = windows(hashed, words.row, n)
    row = words.row[first]
    brief = np.flatnonzero((words.per_row > 0) & (words.per_row < n))
    if len(brief):
        start = np.cumsum(words.per_row) - words.per_row
        whole = []
        for r in brief.tolist():
            own = hashed[start[r] : start[r] + words.per_row[r]]
            whole.append(windows(own, np.zeros(len(own), np.int64), len(own))[0][0] ^ _SEEDS[len(own)])
        shingle, row = np.concatenate([shingle, np.array(whole, np.uint64)]), np.concatenate([row, brief])
    order = np.lexsort((shingle, row))
    shingle, row = shingle[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (row[1:] != row[:-1])
    return shingle[new], row[new], np.bincount(row[new], minlength=len(offsets) - 1)


def set_names(shingle: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's set."""
    end = np.cumsum(size)
    out = []
    for seed in _SEEDS[:2]:
        total = np.zeros(len(shingle) + 1, np.uint64)
        np.cumsum(mix(shingle ^ seed), out=total[1:])
        out.append(mix((total[end] - total[end - size]) ^ mix(size.astype(np.uint64))))
    return out[0], out[1]


def _sets(batches: Iterator[pa.RecordBatch], n: int):
    for batch in batches:
        data, offsets = flat_bytes(batch.column("text"))
        for i, j in slices(offsets):
            shingle, row, size = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
            yield batch.slice(i, j - i), shingle, row, size, *set_names(shingle, size)


class Frequent:
    """Counters of values that a stream holds often: of N values, those with 2 N / limit at least are among those given out."""

    def __init__(self, limit: int = HOT):
        self.limit, self.value, self.count = limit, np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, values: np.ndarray, counts: np.ndarray | None = None) -> None:
        both = np.concatenate([self.value, values])
        found, at = np.unique(both, return_inverse=True)
        total = np.bincount(at, np.concatenate([self.count, np.ones(len(values), np.int64) if counts is None else counts]), len(found)).astype(np.int64)
        if len(found) > self.limit:
            total -= np.partition(total, -self.limit - 1)[-self.limit - 1]
        self.value, self.count = found[total > 0], total[total > 0]


def sets(docs: DataFrame, n: int = WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, name, second) for each document, nameless if its set is empty; (shingle, seen) for shingles that a task met often.

    The columns named in `keep` go with the documents.
    """
    names = ["doc_id", "n_shingles", "name", "second", "shingle", "seen", *keep]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    types = to_arrow_schema(slim.select(*keep).schema).types if keep else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = Frequent()
        for part, shingle, _, size, name, second in _sets(batches, n):
            often.add(shingle)
            none, gap = size == 0, pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(name.view(np.int64), mask=none), pa.array(second.view(np.int64), mask=none), gap, gap, *[part.column(c).cast(t) for c, t in zip(keep, types, strict=True)]], names)
        gap = pa.nulls(len(often.value), pa.int64())
        yield pa.RecordBatch.from_arrays([gap, gap, gap, gap, pa.array(often.value.view(np.int64)), pa.array(often.count), *[pa.nulls(len(often.value), t) for t in types]], names)

    own = StructType([StructField(c, LongType()) for c in names[:6]] + [StructField(f.name, f.dataType) for f in slim.select(*keep).schema.fields])
    return slim.mapInArrow(run, own)


_BLOCK = "bucket int, names binary, counts binary, shingles binary, lengths binary"


def _blocks(bucket: np.ndarray, name: np.ndarray, shingle: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """Postings packed by bucket; within it each class once, with its count of shingles."""
    order = np.lexsort((name, bucket))
    bucket, name, shingle, length = bucket[order], name[order], shingle[order], length[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (bucket[1:] != bucket[:-1])
    new[:: 1 << 15] = True
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(name)))
    found, first = np.unique(bucket, return_index=True)
    cut, cut_head = np.append(first, len(name)), np.append(np.searchsorted(head, first), len(head))
    columns: dict[str, list] = {"bucket": found.astype(np.int32), "names": [], "counts": [], "shingles": [], "lengths": []}
    for k in range(len(found)):
        h = slice(cut_head[k], cut_head[k + 1])
        columns["names"].append(name[head[h]].astype(np.uint64).tobytes())
        columns["counts"].append(count[h].astype(np.uint16).tobytes())
        columns["shingles"].append(shingle[cut[k] : cut[k + 1]].astype(np.uint64).tobytes())
        columns["lengths"].append(length[cut[k] : cut[k + 1]].astype(np.uint8).tobytes())
    types = [pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), types, strict=True)], list(columns))


def _column(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, shingle, length class) of each posting of a bucket."""
    return np.repeat(_column(table, "names", np.uint64), _column(table, "counts", np.uint16)), _column(table, "shingles", np.uint64), _column(table, "lengths", np.uint8)


def occurrences(size: np.ndarray | int, percent: int = PERCENT):
    """T: the shingles a set of this size must share with any partner."""
    return (percent * size + 99) // 100


def merged(size: np.ndarray | int, longest: float, percent: int = PERCENT):
    """T - L: how often a candidate must stand on the merged lists. L, the long lists left out, is T / (PROBE_COST x log2(longest) + 1)."""
    t = occurrences(size, percent)
    return np.maximum(1, t - np.floor(t / (1 + PROBE_COST * math.log2(max(2.0, longest)))).astype(np.int64))


def _scale(length: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.floor(8 * np.log2(np.maximum(length, 1)))).astype(np.uint8)


class Plan:
    """What every task must know: how many buckets there are, the hot lists, and the sets that need their second name."""

    def __init__(self, buckets: int, longest: float, hot: dict[int, int], clashing: list[int]):
        self.buckets, self.longest = buckets, longest
        self.hot = np.array(sorted(hot), np.uint64)
        self.held = np.array([hot[h] for h in sorted(hot)], np.int64)
        self.clashing = np.array(sorted(clashing), np.int64).view(np.uint64)

    def bucket(self, values: np.ndarray, times: int = 1) -> np.ndarray:
        return ((values >> np.uint64(33)).astype(np.int64) % (times * self.buckets)).astype(np.int32)

    def held_by(self, shingle: np.ndarray) -> np.ndarray:
        """The postings of hot lists, 0 for others."""
        if not len(self.hot):
            return np.zeros(len(shingle), np.int64)
        at = np.minimum(np.searchsorted(self.hot, shingle), len(self.hot) - 1)
        return np.where(self.hot[at] == shingle, self.held[at], 0)

    def name(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return np.where(np.isin(first, self.clashing), second, first) if len(self.clashing) else first


def planned(facts: DataFrame, limit: int = HOT, postings: int = POSTINGS) -> Plan:
    """The plan for the sets of a corpus, from `limit` hot lists at most and as many clashing names as two in 2^64 give."""
    named = facts.where("seen is null")
    total, documents = named.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("name")).first()
    often = facts.where("seen is not null").groupBy("shingle").agg(F.sum("seen").alias("n")).where(F.col("n") >= total / limit).collect()
    clashing = named.where("name is not null").groupBy("name").agg(F.min("second").alias("low"), F.max("second").alias("high")).where("low <> high").select("name").limit(100_001).collect()
    if len(clashing) > 100_000:
        raise RuntimeError("more sets under one name than hashes explain")
    buckets = max(2 * parallelism(facts.sparkSession), -(-total // postings))
    return Plan(buckets, float(documents), {r["shingle"] % 2**64: r["n"] for r in often}, [r["name"] for r in clashing])


def classes_of(docs: DataFrame, named: DataFrame, plan: Plan, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(name, size, lone, shingles, lengths): the classes that share T lists at least, and these lists, short ones first, with their lengths by `_scale`; `lone` lists are theirs alone."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shingle, row, size, name, second in _sets(batches, n):
            name = plan.name(name, second)
            kept = np.zeros(len(name), bool)
            kept[np.unique(name, return_index=True)[1]] = True  # a class once for a slice
            own = kept[row]
            shingle, row = shingle[own], row[own]
            if len(row):
                held = plan.held_by(shingle)
                bucket = np.where(held > 0, -1 - plan.bucket(name[row]), plan.bucket(shingle))
                yield _blocks(bucket, name[row], shingle, np.where(held > 0, _scale(held), 0))

    def lists(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:  # postings of hot lists, dealt by class
            return table.set_column(0, "bucket", pa.array(-1 - table.column("bucket").to_numpy(), pa.int32()))
        name, shingle, _ = _unpacked(table)
        order = np.lexsort((name, shingle))
        name, shingle = name[order], shingle[order]
        new = np.ones(len(name), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (name[1:] != name[:-1])
        name, shingle = name[new], shingle[new]
        length = np.diff(np.append(np.flatnonzero(np.diff(shingle, prepend=shingle[:1] + np.uint64(1))), len(shingle)))
        length = np.repeat(length, length)
        shared = length > 1
        return pa.Table.from_batches([_blocks(plan.bucket(name[shared]), name[shared], shingle[shared], _scale(length[shared]))])

    def gather(posted: pa.Table, sized: pa.Table) -> pa.Table:
        name, shingle, length = _unpacked(posted)
        order = np.lexsort((shingle, length, name))
        name, shingle, length = name[order], shingle[order], length[order]
        new = np.ones(len(name), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (name[1:] != name[:-1])
        name, shingle, length = name[new], shingle[new], length[new]
        found, first, count = np.unique(name, return_index=True, return_counts=True)
        known = sized.column("name").to_numpy().view(np.uint64)
        by_name = np.argsort(known)
        size = sized.column("size").to_numpy()[by_name[np.searchsorted(known[by_name], found)]] if len(found) else np.empty(0, np.int64)
        enough = np.flatnonzero(count >= occurrences(size, percent))
        own = [[x[first[k] : first[k] + count[k]].tobytes() for k in enough] for x in (shingle, length)]
        return pa.table([pa.array(found[enough].view(np.int64)), pa.array(size[enough]), pa.array((size - count)[enough]), *[pa.array(o, pa.binary()) for o in own]], ["name", "size", "lone", "shingles", "lengths"])

    posted = docs.select("text").mapInArrow(post, _BLOCK).groupBy("bucket").applyInArrow(lists, _BLOCK)
    bucket = (F.shiftrightunsigned("name", 33) % plan.buckets).cast("int").alias("bucket")
    sized = named.where("name is not null").select("name", F.col("n_shingles").alias("size")).distinct().select(bucket, "name", "size")
    return posted.groupBy("bucket").cogroup(sized.groupBy("bucket")).applyInArrow(gather, "name long, size long, lone long, shingles binary, lengths binary")


def _runs(keys: np.ndarray) -> np.ndarray:
    """Edges of the runs of equal values in sorted keys."""
    return np.append(np.flatnonzero(np.diff(keys, prepend=keys[:1] + keys.dtype.type(1))), len(keys)) if len(keys) else np.zeros(1, np.int64)


def _possible(asking: np.ndarray | int, found: np.ndarray, size: np.ndarray, lone: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Whether neither the sizes nor the lists shared with anyone rule a pair out; these tests are the same on every list."""
    most = np.minimum(size[asking] - lone[asking], size[found] - lone[found])
    good = (percent * np.maximum(size[asking], size[found]) <= 100 * np.minimum(size[asking], size[found])) & ((side[asking] < 0) | (side[asking] != side[found]))
    return good & ((100 + percent) * most >= percent * (size[asking] + size[found]))


def unlike(root: np.ndarray, size: np.ndarray, lone: np.ndarray, side: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(asking, found): the possible pairs on one list of each class outside its largest component with classes of other components; of two such, once.

    A list may hold many classes of components of their own, so its pairs are not laid out to be tested: a class is
    held against those of sizes like its own, and only what passes is kept.
    """
    ids, count = np.unique(root, return_counts=True)
    largest = ids[count.argmax()]
    by_size = np.argsort(size, kind="stable")
    ranked = size[by_size]
    low = np.searchsorted(ranked, -(-percent * size // 100), "left")
    high = np.searchsorted(ranked, 100 * size // percent, "right")
    asking, found = [], []
    for o in np.flatnonzero(root != largest).tolist():
        other = by_size[low[o] : high[o]]
        other = other[(root[other] != root[o]) & ((root[other] == largest) | (other > o))]
        other = other[_possible(o, other, size, lone, side, percent)]
        if len(other):
            asking.append(np.full(len(other), o))
            found.append(other)
    return (np.concatenate(asking), np.concatenate(found)) if asking else (np.empty(0, np.int64), np.empty(0, np.int64))


_POST = "bucket int, list binary, name binary, root binary, size binary, lone binary, part binary"
_ASKED = "bucket int, asks binary, size binary, held binary, found binary, sizes binary"


def search(classes: DataFrame, plan: Plan, roots: DataFrame | None = None, percent: int = PERCENT) -> DataFrame:
    """(a, b): links of classes. Without components, those of each class with the heads of its lists; with components (node, root),
    every link between classes of different ones."""
    across, part_size = roots is not None, PART
    whole = classes.join(roots.select(F.col("node").alias("name"), "root"), "name", "left").withColumn("root", F.coalesce("root", "name")) if across else classes.withColumn("root", F.col("name"))

    def short_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, size, root, lone = (batch.column(c).to_numpy() for c in ("name", "size", "root", "lone"))
            shared = [np.frombuffer(b, np.uint64) for b in batch.column("shingles").to_pylist()]
            # Lists of the class alone are its shortest: they take the first places, and meet no one.
            count = np.clip(size - occurrences(size, percent) + merged(size, plan.longest, percent) - lone, 0, None)
            shingle = np.concatenate([s[:k] for s, k in zip(shared, count.tolist(), strict=True)]) if len(shared) else np.empty(0, np.uint64)
            length = np.concatenate([np.frombuffer(b, np.uint8)[:k] for b, k in zip(batch.column("lengths").to_pylist(), count.tolist(), strict=True)]) if len(shared) else np.empty(0, np.uint8)
            at = np.repeat(np.arange(len(name)), np.minimum(count, [len(s) for s in shared]))
            # A long list, whatever its share of all postings, is cut into parts by class; its postings go to a cell for each two parts.
            parts = np.maximum(1, np.ceil(2 ** ((length + 1.0) / 8) / part_size)).astype(np.int64)
            part = (mix(name[at].view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
            copy = np.repeat(np.arange(len(at)), parts)
            other = np.arange(len(copy)) - np.repeat(np.cumsum(parts) - parts, parts)
            cell = np.minimum(part[copy], other) * parts[copy] + np.maximum(part[copy], other)
            key = np.where(parts[copy] > 1, mix(shingle[copy] ^ mix(cell.astype(np.uint64) + np.uint64(1))), shingle[copy])
            # In a cell of two parts only classes of unlike parts meet; in a cell of one, and elsewhere, all do.
            side = np.where(part[copy] == other, -1, part[copy])
            at = at[copy]
            bucket = plan.bucket(key)
            order = np.argsort(bucket, kind="stable")
            edges = _runs(bucket[order])
            rows = [(int(bucket[o[0]]), key[o].tobytes(), *(x[at[o]].tobytes() for x in (name, root, size, lone)), side[o].tobytes()) for o in (order[lo:hi] for lo, hi in zip(edges[:-1], edges[1:], strict=True))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32()] + [pa.binary()] * 6, strict=True)], [f.split()[0] for f in _POST.split(", ")])

    def met(name: np.ndarray, root: np.ndarray, size: np.ndarray, lone: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the asking class, place of a class found) on one list, which is in order of names."""
        if across:
            asking, found = unlike(root, size, lone, side, percent)
        else:
            head = int(np.lexsort((name, lone))[0])
            asking, found = np.delete(np.arange(len(name)), head), np.full(len(name) - 1, head)
            good = _possible(asking, found, size, lone, side, percent)
            asking, found = asking[good], found[good]
        asking, found = np.minimum(asking, found), np.maximum(asking, found)
        order = np.lexsort((found, asking))
        return asking[order], found[order]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        key = _column(table, "list", np.uint64)
        name, root, size, lone, side = (_column(table, c, np.int64) for c in ("name", "root", "size", "lone", "part"))
        order = np.lexsort((name, key))
        key, name, root, size, lone, side = (x[order] for x in (key, name, root, size, lone, side))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        key, name, root, size, lone, side = (x[new] for x in (key, name, root, size, lone, side))
        edges = _runs(key)
        first = np.repeat(edges[:-1], np.diff(edges))
        mixed = np.add.reduceat((root != root[first]).astype(np.int64), edges[:-1]) > 0 if len(key) else np.zeros(0, bool)
        asks, found, held, pairs = [], [], [], 0
        for lo, hi in zip(edges[:-1][mixed].tolist(), edges[1:][mixed].tolist(), strict=True):
            q, p = met(name[lo:hi], root[lo:hi], size[lo:hi], lone[lo:hi], side[lo:hi])
            if len(q):
                runs = _runs(q)
                asks.append(lo + q[runs[:-1]])
                held.append(np.diff(runs))
                found.append(lo + p)
                pairs += len(p)
            if pairs >= PAIRS:  # A bucket's pairs leave by and by; how many they are depends on its lists.
                yield packed(name, size, asks, held, found)
                asks, found, held, pairs = [], [], [], 0
        if asks:
            yield packed(name, size, asks, held, found)

    def packed(name: np.ndarray, size: np.ndarray, asks: list[np.ndarray], held: list[np.ndarray], found: list[np.ndarray]) -> pa.RecordBatch:
        """Asking classes with the classes found on a list each, by bucket of the asking class."""
        at, held, found = np.concatenate(asks), np.concatenate(held), np.concatenate(found)
        bucket = plan.bucket(mix(name[at].view(np.uint64)), ASKS)
        order = np.argsort(bucket, kind="stable")
        start = np.cumsum(held) - held
        edges = _runs(bucket[order])
        rows = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            o = order[lo:hi]
            take = found[np.repeat(start[o] - (np.cumsum(held[o]) - held[o]), held[o]) + np.arange(int(held[o].sum()))]
            rows.append((int(bucket[o[0]]), name[at[o]].tobytes(), size[at[o]].tobytes(), held[o].tobytes(), name[take].tobytes(), size[take].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32()] + [pa.binary()] * 5, strict=True)], [f.split()[0] for f in _ASKED.split(", ")])

    def merge(table: pa.Table) -> pa.Table:
        """Heap-merges the short lists of each asking class and keeps who stands on enough of them."""
        asks, size, held, found, sizes = (_column(table, c, np.int64) for c in ("asks", "size", "held", "found", "sizes"))
        stop = np.cumsum(held)
        order = np.argsort(asks, kind="stable")
        edges = _runs(asks[order])
        # With fewer occurrences the long lists cannot make up for the rest; and a pair meets on so many lists at least.
        own = np.repeat(size, held)
        least = np.ones(len(found), np.int64)
        if across:
            left = lambda n: occurrences(n, percent) - merged(n, plan.longest, percent)
            least = np.maximum(merged(np.minimum(own, sizes), plan.longest, percent), -(-percent * (own + sizes) // (100 + percent)) - np.maximum(left(own), left(sizes)))
        out: list[tuple[int, int, int]] = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            lists = [(found[stop[k] - held[k] : stop[k]].tolist(), least[stop[k] - held[k] : stop[k]].tolist()) for k in order[lo:hi].tolist()]
            query = int(asks[order[lo]])
            for (partner, need), times in groupby(heapq.merge(*[zip(*x, strict=True) for x in lists])):
                seen = sum(1 for _ in times)
                if seen >= need:
                    out.append((query, partner, seen))
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["a", "b", "seen"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Binary-probes the long lists for each candidate. It is on a list if the list is among its own, so these are searched."""
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy().tolist()
            good = []
            for a, b, n, m, x_lone, y_lone, seen in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), get("n"), get("m"), get("x_lone"), get("y_lone"), get("seen"), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                short = (divide(n, x_lone), divide(m, y_lone)) if across else (0, 0)
                good.append((100 + percent) * overlap(x, y, *short, seen if across else 0) >= percent * (n + m))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    def divide(size: int, lone: int) -> int:
        return max(0, size - occurrences(size, percent) + int(merged(size, plan.longest, percent)) - lone)

    posted = whole.mapInArrow(short_lists, _POST).groupBy("bucket").applyInArrow(ask, _ASKED)
    pairs = stored(posted.groupBy("bucket").applyInArrow(merge, "a long, b long, seen long"))
    side = lambda k, s, n, u: classes.select(F.col("name").alias(k), F.col("shingles").alias(s), F.col("size").alias(n), F.col("lone").alias(u))
    one = dealt_join(pairs, side("a", "x", "n", "x_lone"), "a", F.col("b"))
    return dealt_join(one, side("b", "y", "m", "y_lone"), "b", F.col("a"), counted=pairs).mapInArrow(probe, "a long, b long")


def overlap(x: np.ndarray, y: np.ndarray, short_x: int, short_y: int, seen: int) -> int:
    """How many lists two classes share, given that they share `seen` of the first short_x of x and the first short_y of y.

    x and y stand in one order of all lists. So the short lists of one class end first, and what it shares up to there is
    all among those seen: no list is short for it and long for the other. The probes of its long lists give the rest; the
    other class's probes give no more than that.
    """
    return seen + max(_hits(x[short_x:], y), _hits(y[short_y:], x))


def _hits(lists: np.ndarray, held: np.ndarray) -> int:
    """How many of the lists are among those held, by binary search."""
    if not len(lists) or not len(held):
        return 0
    held = np.sort(held)
    return int((held[np.minimum(np.searchsorted(held, lists), len(held) - 1)] == lists).sum())


def labelled(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, limit: int = HOT, postings: int = POSTINGS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, name, root) and `keep`, per row: its class and that class's component, null without words. Stored."""
    facts = stored(sets(docs, n, keep))
    plan = planned(facts, limit, postings)
    name: Column = F.col("name")
    if len(plan.clashing):
        name = F.when(name.isin(plan.clashing.view(np.int64).tolist()), F.col("second")).otherwise(name)
    named = facts.where("seen is null").select("doc_id", "n_shingles", name.alias("name"), *keep)
    classes = stored(classes_of(docs, named, plan, n, percent))
    near = stored(search(classes, plan, None, percent))
    links = stored(near.unionByName(search(classes, plan, components(near), percent)))
    roots = components(links)
    return stored(dealt_join(named, roots.select(F.col("node").alias("name"), "root"), "name", F.struct("doc_id", "n_shingles", *keep), "left").withColumn("root", F.coalesce("root", "name")))


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, limit: int = HOT, postings: int = POSTINGS) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest doc_id reachable by links."""
    rows = labelled(docs, n, percent, limit, postings)
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return dealt_join(rows, least, "root", F.struct("doc_id", "name"), "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
