"""Ranked lexical search: an inverted index in segments, scored window by window.

`build_index` writes one row a segment: some thousand documents, each with a number in its segment, and the postings of
every term, in order of term and number. Nothing is shuffled, and every word of every text is indexed. `search` takes
queries in blocks of `BLOCK` terms at most, so that what is sent to the tasks is bounded. A task goes through a segment in
fixed windows of `WINDOW` document numbers; for each query it adds the weighted impacts of the window's postings to an
array of that size, ORs the postings' occupancy bits, and harvests the occupied places into a heap of the best k. The heaps
of all segments are ranked in two steps, by groups of segments and then by query.

Terms are compared by 64-bit hashes. Null texts and texts without terms are in no result and do not count. Documents that
share a doc_id are ranked each for itself; a null doc_id comes last among equal scores. Repeated terms of a query count
each time. Queries that share an item_id are separate, and told apart by nothing but it; a null item_id is an item like
others. Queries without terms, or with terms that no document holds, have no rows. Other columns do not matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.llm.frames import stored
from gridlens.llm.textvec import ALNUM, LOWER, Runs, flat_bytes, slices

TOP = 20
#: Documents in a window: their scores take 32 kB.
WINDOW = 4096
SEGMENT_BYTES = 4 << 20
BLOCK = 1 << 20
#: Segments whose heaps are ranked together first.
GROUP = 256
_WORD = ALNUM[LOWER]

INDEX = "n_docs long, n_words long, doc_ids array<long>, lengths array<long>, terms binary, edges binary, docs binary, times binary"


def segment(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, terms in order, edges of their postings, document numbers, times) of a slice of texts."""
    words = Runs(data, offsets, _WORD, LOWER)
    hashed = words.hashes()
    # Words come in order of document, so a stable sort by term leaves each term's documents in order.
    order = np.argsort(hashed, kind="stable")
    term, doc = hashed[order], words.row[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    term, doc, times = term[first], doc[first], np.diff(np.append(first, len(hashed)))
    head = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.empty(0, np.int64)
    return words.per_row, term[head], np.append(head, len(term)), doc, times


def build_index(docs: DataFrame) -> DataFrame:
    """The segments of all documents; a text longer than a segment has one of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in INDEX.split(", ")]
        for batch in batches:
            data, offsets = flat_bytes(batch.column("text"))
            for i, j in slices(offsets, SEGMENT_BYTES):
                length, terms, edges, doc, times = segment(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids, held = batch.column("doc_id").slice(i, j - i).to_pylist(), length.astype(np.int64)
                packed = [x.tobytes() for x in (terms, edges.astype(np.uint32), doc.astype(np.uint32), times.astype(np.uint32))]
                row = [int((length > 0).sum()), int(length.sum()), ids, held.tolist(), *packed]
                types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())] + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


class Segment:
    """A row of the index, unpacked."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.lengths = np.array(row["lengths"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.edges, self.docs, self.times = (np.frombuffer(row[c], np.uint32).astype(np.int64) for c in ("edges", "docs", "times"))

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the terms it holds, their places)."""
        if not len(self.terms):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        held = np.flatnonzero(self.terms[at] == terms)
        return held, at[held]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Segment({c: batch.column(c)[k].as_py() for c in ("doc_ids", "lengths", "terms", "edges", "docs", "times")})


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, part, terms, times): the distinct terms of each item and how often it holds them, in parts of 2^12 terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_bytes(batch.column("text"))
            words = Runs(data, offsets, _WORD, LOWER)
            hashed, ends = words.hashes(), np.cumsum(words.per_row)
            own = [np.unique(hashed[e - n : e], return_counts=True) for e, n in zip(ends.tolist(), words.per_row.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([t.view(np.int64) for t, _ in own], pa.list_(pa.int64())), pa.array([n for _, n in own], pa.list_(pa.int64()))], ["item_id", "terms", "times"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, terms array<long>, times array<long>").where("size(terms) > 0")


def _top(keys: list, k: int, more) -> None:
    """Adds (score, rank of ties, doc_id) rows to a heap of the best k."""
    for row in more:
        if len(keys) < k:
            heapq.heappush(keys, row)
        elif row > keys[0]:
            heapq.heapreplace(keys, row)


def _norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """A document's m, in whole numbers; where 64 bits do not hold 25 n N, without them."""
    if int(lengths.max(initial=0)) * 25 * n < 1 << 62:
        return 75 + (25 * lengths * n) // total
    return np.array([75 + (25 * v * n) // total for v in lengths.tolist()], np.int64)


class Queries:
    """A block of queries: its terms in order, and for each query the places of its terms, their weights times repeats."""

    def __init__(self, listed: pa.Table):
        lists = [np.array(t, np.int64).view(np.uint64) for t in listed.column("terms").to_pylist()]
        self.items = listed.column("item_id").to_pylist()
        self.terms = np.unique(np.concatenate(lists)) if lists else np.empty(0, np.uint64)
        self.own = [np.searchsorted(self.terms, t) for t in lists]
        self.times = [np.array(t, np.int64) for t in listed.column("times").to_pylist()]

    def weigh(self, held: dict[int, int], n: int) -> None:
        """Sets the weights from the number of documents that hold each term, of n."""
        weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * held.get(t, 0) + 1))) for t in self.terms.view(np.int64).tolist()]
        self.weights = [np.array(weight, np.int64)[own] * times for own, times in zip(self.own, self.times, strict=True)]


def best(seg: Segment, queries: Queries, n: int, total: int, k: int, window: int = WINDOW) -> Iterator[tuple[int, list]]:
    """(query, its best k documents of the segment)."""
    held, place = seg.find(queries.terms)
    at = np.full(len(queries.terms), -1)
    at[held] = np.arange(len(held))
    m = _norms(seg.lengths, n, total)
    heaps: dict[int, list] = {}
    score = np.zeros(window, np.int64)
    cursor = seg.edges[place]
    for begin in range(0, len(seg.lengths), window):
        # This window's part of each postings list, its impacts, and its occupancy bits.
        lists, bits = [], np.zeros((len(held), window // 8), np.uint8)
        for q in range(len(held)):
            stop = cursor[q] + int(np.searchsorted(seg.docs[cursor[q] : seg.edges[place[q] + 1]], begin + window))
            doc, times = seg.docs[cursor[q] : stop], seg.times[cursor[q] : stop]
            lists.append((doc - begin, (1_000_000_000 * times) // (1000 * times + 12 * m[doc])))
            here = np.zeros(window, bool)
            here[doc - begin] = True
            bits[q] = np.packbits(here, bitorder="little")
            cursor[q] = stop
        for query, (own, weights) in enumerate(zip(queries.own, queries.weights, strict=True)):
            occupied = np.zeros(window // 8, np.uint8)
            for q, weight in zip(at[own].tolist(), weights.tolist(), strict=True):
                if q >= 0 and len(lists[q][0]):
                    doc, impact = lists[q]
                    score[doc] += weight * impact
                    occupied |= bits[q]
            places = np.flatnonzero(np.unpackbits(occupied, bitorder="little"))
            if len(places):
                found = score[places]
                score[places] = 0
                heap = heaps.setdefault(query, [])
                least = max(1, heap[0][0] if len(heap) == k else 1)
                if len(found) > k:
                    least = max(least, int(np.partition(found, -k)[-k]))
                good = np.flatnonzero(found >= least)
                ids = [seg.doc_ids[begin + p] for p in places[good].tolist()]
                _top(heap, k, ((s, i is not None, -i if i is not None else 0) for s, i in zip(found[good].tolist(), ids, strict=True)))
    yield from heaps.items()


def _rank(found: DataFrame, k: int, *key: str) -> DataFrame:
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = TOP, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item. `index` is read several times: a stored table."""
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    listed = stored(query_terms(items).withColumn("query", F.monotonically_increasing_id()))
    size = listed.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    count = 1 if size <= block else -(-2 * size // block)
    parts = []
    for b in range(count):
        own = listed if count == 1 else listed.where(F.pmod(F.xxhash64("query"), F.lit(count)) == b)
        asked = own.select("query", "item_id", "terms", "times").toArrow()
        queries, numbers = Queries(asked), asked.column("query").to_pylist()

        def count_docs(batches: Iterator[pa.RecordBatch], queries: Queries = queries) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(queries.terms), np.int64)
            for seg in _segments(batches):
                held, place = seg.find(queries.terms)
                total[held] += seg.edges[place + 1] - seg.edges[place]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(queries.terms[some].view(np.int64)), pa.array(total[some])], ["term", "n"])

        # As many rows as the block has terms.
        held = {r["term"]: r["n"] for r in index.mapInArrow(count_docs, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        queries.weigh(held, n)

        def score(batches: Iterator[pa.RecordBatch], queries: Queries = queries, numbers: list[int] = numbers) -> Iterator[pa.RecordBatch]:
            heaps: dict[int, list] = {}
            for seg in _segments(batches):
                for query, found in best(seg, queries, n, total, k):
                    _top(heaps.setdefault(query, []), k, found)
            rows = [(numbers[q], queries.items[q], -i if known else None, s) for q, heap in heaps.items() for s, known, i in heap]
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "item_id", "doc_id", "score"])

        parts.append(index.mapInArrow(score, "query long, item_id long, doc_id long, score long").withColumn("_task", F.expr("spark_partition_id() div " + str(GROUP))))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return _rank(_rank(found, k, "query", "_task").drop("rank"), k, "query").select("item_id", "rank", "doc_id", "score")


def rank_items(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The k best documents of each item, over an index of all documents."""
    return search(stored(build_index(docs)), items, k)


#: DuckDB SQL for item_id, rank, doc_id and score.
ORACLE_SQL = r"""
with words as (
  select r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term
  from (select *, row_number() over () as r from documents)
), asked as (
  select q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term
  from (select *, row_number() over () as q from benchmark)
), repeats as (select q, item_id, term, count(*) as qtf from asked group by all
), tfs as (select r, doc_id, term, count(*) as tf from words where term in (select term from asked) group by all
), sizes as (select r, count(*) as n from words group by r
), whole as (select count(*) as docs, sum(n)::bigint as total from sizes
), dfs as (select term, count(*) as df from tfs group by term
), weights as (select term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double)) as bigint) as w from dfs, whole
), scored as (
  select q, item_id, r, doc_id, cast(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total)))) as bigint) as score
  from repeats join weights using (term) join tfs using (term) join sizes using (r), whole group by q, item_id, r, doc_id
)
select item_id, cast(row_number() over (partition by q order by score desc, doc_id nulls last) as int) as rank, doc_id, score from scored where score > 0
qualify rank <= 20
"""
