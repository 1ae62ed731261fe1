"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a structured random product code: after a random rotation a vector is cut in two halves, each
half has its own random codebook, and every pair of code words is a direction. List decoding finds, for each vector,
all directions whose inner product exceeds a threshold, from the sorted scores of the halves. Vectors that share a
filter are compared; a pair is counted at the smallest filter it shares.

The codebooks grow with the square root of the number of vectors, so a filter holds about `FILL` vectors at every size.
The caps get narrower with them, by which a pair at the threshold shares fewer filters of a given number; the number
of filters a vector has grows by the same factor, so what a pair shares stays the same.

Equal vectors are one class, found by grouping first. A class travels once for each left word of its filters, as 16-bit
numbers. Products of these tell links from others but for a narrow band around the threshold; the few pairs in it are
decided in double precision on the vectors themselves. A left word with more than `CELL` classes is cut into parts, and
each two parts meet in a task of their own; only counts, spanning links and pairs of the band leave a task.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different length
neither. Equal vectors are told by 128 bits. A null vec_id counts as a vector; `label` and other columns do not matter.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.components import components
from gridlens.llm.frames import dealt_join, stored

COSINE = 0.95
#: Filters of a vector on average at 10,000 vectors, and at least; classes of a filter on average; classes of a task.
LIST, LEAST, FILL, CELL = 12, 6, 64, 32_768
BLOCK = 1 << 22
FULL = 32_767


def list_size(vectors: int, cosine: float = COSINE) -> int:
    """Filters of a vector on average: what a pair at the threshold shares falls with the size of a cap, by this power of it."""
    return int(np.ceil(LIST * max(1.0, vectors / 10_000) ** ((1 - cosine) / (1 + cosine))))


def code_size(vectors: int, cosine: float = COSINE) -> int:
    """Words in each codebook, so that a filter holds about FILL of the vectors."""
    return max(12, int(np.ceil(np.sqrt(vectors * list_size(vectors, cosine) / FILL))))


@lru_cache(maxsize=8)
def _code(dim: int, words: int, held: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The rotation, the two codebooks and the threshold; the same in every task."""
    draw = np.random.default_rng((seed, dim, words))
    rotation = np.linalg.qr(draw.standard_normal((dim, dim)))[0]
    books = []
    for size in (dim // 2, dim - dim // 2):
        book = draw.standard_normal((words, size)) if size else np.zeros((words, 1))
        books.append(book / np.maximum(np.linalg.norm(book, axis=1, keepdims=True), 1e-12))
    # The level that `held` directions exceed on average, from random vectors and the best scores of their halves.
    trial = _unit(draw.standard_normal((128, dim)))
    halves = (trial[:, : dim // 2] @ books[0].T if dim > 1 else np.zeros((128, words))), trial[:, dim // 2 :] @ books[1].T
    best = [np.sort(scores, axis=1)[:, -256:] for scores in halves]
    sums = np.sort((best[0][:, :, None] + best[1][:, None, :]).ravel())
    return rotation, books[0], books[1], float(sums[-min(len(sums), 128 * held)])


def list_decode(unit: np.ndarray, words: int, held: int = LIST, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(vector, filter) for all directions that exceed the threshold, in order; each vector has its LEAST best directions at least."""
    dim = unit.shape[1]
    rotation, left, right, level = _code(dim, words, held, seed)
    turned = unit @ rotation
    half = dim // 2
    a = turned[:, :half] @ left.T if half else np.zeros((len(unit), words))
    b = turned[:, half:] @ right.T
    order = np.argsort(-b, axis=1)
    ranked = np.take_along_axis(b, order, 1)
    # A word of the left half counts if the best of the right half can lift it over the level.
    tops = np.sort(a, axis=1)[:, : -LEAST - 1 : -1]
    sums = np.sort((tops[:, :, None] + ranked[:, None, :LEAST]).reshape(len(unit), -1), axis=1)
    level = np.minimum(level, sums[:, -LEAST])
    row, word = np.nonzero(a + ranked[:, :1] >= level[:, None])
    rest = level[row] - a[row, word]
    # How many of the right half's sorted scores reach the rest, by bisection in all rows at once.
    low, high = np.zeros(len(row), np.int64), np.full(len(row), words)
    while (low < high).any():
        middle = (low + high) // 2
        enough = ranked[row, np.minimum(middle, words - 1)] >= rest
        open_ = low < high
        low = np.where(open_ & enough, middle + 1, low)
        high = np.where(open_ & ~enough, middle, high)
    vector = np.repeat(row, low)
    nth = np.arange(int(low.sum())) - np.repeat(np.cumsum(low) - low, low)
    found = np.repeat(word, low) * words + order[vector, nth]
    by = np.lexsort((found, vector))
    return vector[by], found[by]


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of each vector length of a batch of classes."""
    column = batch.column("embedding")
    length = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(length) - length
    for dim in np.unique(length):
        rows = np.flatnonzero(length == dim)
        yield rows, _unit(flat[first[rows][:, None] + np.arange(dim)].astype(float))


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that squares neither vanish nor overflow."""
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, key) of every row, key null for vectors that cannot link; (name, key, n, embedding) of the classes, name a number of its own."""
    value = F.col("embedding")
    fine = value.isNotNull() & (F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    hashes = [F.lpad(F.hex(F.xxhash64(*seed, value)), 16, "0") for seed in ((), (F.lit(1),))]
    named = vectors.select("vec_id", F.when(F.coalesce(fine, F.lit(False)), F.unhex(F.concat(*hashes))).alias("key"), value)
    classes = named.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    return named.drop("embedding"), stored(classes.withColumn("name", F.monotonically_increasing_id()))


def _decoded(batch: pa.RecordBatch, words: int, held: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, unit vectors, vector of each match, its filter) for a bounded number of rows at a time."""
    for rows, unit in _vectors(batch):
        step = max(16, BLOCK // max(words, unit.shape[1]) // 8)
        for i in range(0, len(rows), step):
            yield rows[i : i + step], unit[i : i + step], *list_decode(unit[i : i + step], words, held)


def _lefts(vector: np.ndarray, found: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, left word, end among the matches) of each left word that a vector has."""
    left = found // words
    last = np.flatnonzero((np.diff(vector, append=-1) != 0) | (np.diff(left, append=-1) != 0))
    return vector[last], left[last], last + 1


_FOUND = "name long, links long, root long, other long"


def link_counts(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(name, links, root): of classes with links met in a task, how many vectors they link to there and a class of their component."""
    total = classes.count()
    words, held = code_size(total, cosine), list_size(total, cosine)
    small = np.uint16 if words * words <= 1 << 16 else np.uint32

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, unit, vector, found in _decoded(batch, words, held):
                number, n = np.unique(_lefts(vector, found, words)[1] + words * unit.shape[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(n.astype(np.int64))], ["left", "held"])

    def posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, n = batch.column("name").to_numpy(), batch.column("n").to_numpy()
            for rows, unit, vector, found in _decoded(batch, words, held):
                body = [x.tobytes() for x in np.rint(unit * FULL).astype(np.int16)]
                first = np.searchsorted(vector, np.arange(len(rows)))
                v, left, end = _lefts(vector, found, words)
                lists = found.astype(small)
                for i in range(0, len(v), 10_000):
                    part = slice(i, i + 10_000)
                    # The filters up to this left word: its own, and the smaller ones that tell which pairs were met before.
                    own = [lists[lo:hi].tobytes() for lo, hi in zip(first[v[part]], end[part], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(left[part] + words * unit.shape[1]), pa.array(name[rows[v[part]]]), pa.array(n[rows[v[part]]].astype(np.int32)), pa.array([body[k] for k in v[part]], pa.binary()), pa.array(own, pa.binary())],
                        ["left", "name", "n", "vector", "filters"],
                    )

    def compare(table: pa.Table) -> pa.Table:
        name, n, part = (table.column(c).to_numpy() for c in ("name", "n", "part"))
        order = np.argsort(name, kind="stable")
        name, n, part = name[order], n[order], part[order]
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.int16).reshape(len(name), -1)[order].astype(float) / FULL
        lists = [np.frombuffer(x, small).astype(np.int64) for x in table.column("filters").to_pylist()]
        lists = [lists[k] for k in order]
        length = np.linalg.norm(vectors, axis=1)
        vectors = vectors / length[:, None]
        # How far the product of two rounded vectors can lie from the true one.
        doubt = 4 * (0.5 / FULL * np.sqrt(vectors.shape[1]) / float(length.min())) + 1e-12
        left = table.column("left")[0].as_py() % words
        apart = table.column("first")[0].as_py() != table.column("second")[0].as_py()
        holder, number = np.repeat(np.arange(len(name)), [len(x) for x in lists]), np.concatenate(lists)
        by = np.lexsort((holder, number))
        number, holder = number[by], holder[by]
        edges = np.append(np.flatnonzero(np.diff(number, prepend=-1)), len(number))
        links, ends, doubted = np.zeros(len(name), np.int64), [], []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if hi - lo < 2 or number[lo] // words != left:
                continue
            rows = holder[lo:hi]
            before = None
            for i in range(0, len(rows), max(1, BLOCK // len(rows))):
                block = rows[i : i + max(1, BLOCK // len(rows))]
                near = vectors[block] @ vectors[rows].T
                close = near >= cosine - doubt
                close[np.arange(len(block)), i + np.arange(len(block))] = False
                if apart:
                    close &= part[block][:, None] != part[rows][None, :]
                if not close.any():
                    continue
                if before is None:
                    smaller = [lists[r][: np.searchsorted(lists[r], number[lo])] for r in rows]
                    before = np.repeat(np.arange(len(rows)), [len(x) for x in smaller]), np.concatenate(smaller)
                close &= ~_share(*before, i, len(block), len(rows))  # pairs that share a smaller filter are counted there
                sure = close & (near >= cosine + doubt)
                links[block] += sure @ n[rows]
                a, b = np.nonzero(close & ~sure)
                a, b = block[a], rows[b]
                doubted.append((a[a < b], b[a < b]))
                a, b = np.nonzero(sure)
                a, b = block[a], rows[b]
                ends.append(_spanning(a, b))
        a, b = (np.concatenate(c) for c in zip(*ends, strict=True)) if ends else (np.empty(0, np.int64),) * 2
        a, b = _spanning(a, b)
        x, y = (np.concatenate(c) for c in zip(*doubted, strict=True)) if doubted else (np.empty(0, np.int64),) * 2
        some = np.flatnonzero(links)
        gap = lambda k: pa.nulls(k, pa.int64())
        columns = [[pa.array(name[some]), pa.array(name[a]), pa.array(name[x])], [pa.array(links[some]), gap(len(a)), gap(len(x))], [gap(len(some)), pa.array(name[b]), gap(len(x))], [gap(len(some)), gap(len(a)), pa.array(name[y])]]
        return pa.table([pa.concat_arrays(c) for c in columns], [f.split()[0] for f in _FOUND.split(", ")])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                good.append(float(_unit(np.array([x], float))[0] @ _unit(np.array([y], float))[0]) >= cosine)
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b", "m", "n"])

    full = classes.select("embedding").mapInArrow(sizes, "left long, held long").groupBy("left").agg(F.sum("held").alias("held")).where(F.col("held") > CELL)
    posted = classes.select("name", "n", "embedding").mapInArrow(posts, "left long, name long, n int, vector binary, filters binary")
    parts = F.greatest(F.ceil(F.coalesce("held", F.lit(0)) / CELL).cast("int"), F.lit(1))
    cells = (
        posted.join(F.broadcast(full), "left", "left")  # no more rows than the codebook has words for each vector length
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"first": F.least("part", "other"), "second": F.greatest("part", "other")})
    )
    met = stored(cells.select("left", "first", "second", "name", "n", "part", "vector", "filters").groupBy("left", "first", "second").applyInArrow(compare, _FOUND))
    doubted = met.where("other is not null").select(F.col("name").alias("a"), F.col("other").alias("b"))
    side = lambda k, n, v: classes.select(F.col("name").alias(k), F.col("n").alias(n), F.col("embedding").alias(v))
    decided = stored(doubted.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b").mapInArrow(decide, "a long, b long, m long, n long"))
    both = decided.select(F.col("a").alias("name"), F.col("n").alias("links"), F.col("b").alias("root")).unionByName(decided.select(F.col("b").alias("name"), F.col("m").alias("links"), F.col("a").alias("root")))
    return met.where("other is null").select("name", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "name").alias("root")).unionByName(both)


def _share(row: np.ndarray, number: np.ndarray, first: int, size: int, rows: int) -> np.ndarray:
    """Which of `size` rows from `first` on share a number with which of all `rows`, for sorted (row, number).

    Only the block's own numbers count, and they are laid out a bounded number of columns at a time.
    """
    lo, hi = np.searchsorted(row, [first, first + size])
    own = np.unique(number[lo:hi])
    shared = np.zeros((size, rows), bool)
    if not len(own):
        return shared
    at = np.searchsorted(own, number)
    held = own[np.minimum(at, len(own) - 1)] == number
    row, at = row[held], at[held]
    step = max(1, BLOCK // rows)
    for k in range(0, len(own), step):
        here = (at >= k) & (at < k + step)
        laid = np.zeros((rows, min(step, len(own) - k)), np.float32)
        laid[row[here], at[here] - k] = 1
        shared |= laid[first : first + size] @ laid.T > 0
    return shared


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the smallest of its component, for the links (a, b)."""
    if not len(a):
        return a, b
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(ids)))
    return ids[far], ids[label[far]]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per vector: vec_id, n_links, component_id (the smallest vec_id reachable by links) and kept (it is that one)."""
    named, classes = classes_of(vectors)
    found = stored(link_counts(classes, cosine))
    links = found.groupBy("name").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("name").alias("a"), F.col("root").alias("b")))
    known = (
        classes.select("name", "key", "n").join(links, "name", "left").join(roots.select(F.col("node").alias("name"), "root"), "name", "left")
        .select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "name").alias("root"))
    )
    labelled = stored(dealt_join(named, known, "key", F.col("vec_id"), "left").drop("key"))
    least = labelled.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    component = F.coalesce("least", "vec_id")
    whole = dealt_join(labelled, least, "root", F.col("vec_id"), "left")
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
