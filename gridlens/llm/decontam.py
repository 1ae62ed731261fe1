"""Benchmark decontamination: the words of documents that stand in ten consecutive words of a benchmark item.

Each task cuts its documents into training shards and builds one FM-index a shard (`fmindex`): the words that the
benchmark has are its symbols, all others end a run. Every window of the benchmark is searched backwards, its
occurrences are located by sampled positions, and the covered words are merged into removal spans. Documents are not
shuffled. The benchmark is cut into blocks of `BLOCK` windows at most, and only a block is sent to the tasks at once; with
more than one block the corpus is scanned for each, and the results of a row are merged by its number.

A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Words are compared
by 64-bit hashes. Null texts have no words; a null item_id hits words, but is no item that could be counted or listed; rows
that share an item_id are one item, rows that share a doc_id are separate documents. Without documents or windows there is
no hit. A text of any length is searched whole, in pieces that overlap by a window. Other columns do not matter to `scan`,
and `remove` passes them through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.fmindex import LIMIT, FMIndex
from gridlens.llm.frames import stored
from gridlens.llm.textvec import ALNUM, LOWER, Runs, flat_bytes, slices

WINDOW = 10
BLOCK = 1 << 20
SHARD_BYTES = 8 << 20
#: Occurrences located at once, and windows searched at once.
LOCATED, SEARCHED = 1 << 20, 1 << 18
_WORD = ALNUM[LOWER]


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, words): the distinct windows of each item as word hashes; at most `window` of them each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_bytes(batch.column("text"))
            words = Runs(data, offsets, _WORD, LOWER)
            hashed = words.hashes().view(np.int64)
            ends = np.cumsum(words.per_row)
            for r in np.flatnonzero(words.per_row).tolist():
                own = hashed[ends[r] - words.per_row[r] : ends[r]]
                parts = np.unique(np.lib.stride_tricks.sliding_window_view(own, min(window, len(own))), axis=0)
                item = batch.column("item").slice(r, 1)[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(list(parts), pa.list_(pa.int64()))], ["item", "words"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "item string, words array<long>").distinct()


class Phrases:
    """A block of windows: the words by their number from 1, the distinct windows by length, and the items of each."""

    def __init__(self, listed: pa.Table):
        lists = listed.column("words").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy().view(np.uint64)
        self.words, symbol = np.unique(flat, return_inverse=True)
        ends = np.cumsum(lengths)
        items = listed.column("item").to_pylist()
        self.items = sorted({i for i in items if i is not None})
        number = {item: k for k, item in enumerate(self.items)}
        item = np.array([number.get(i, -1) for i in items], np.int64)
        #: For each length: the phrases, and the items of phrase k at items[edges[k]:edges[k + 1]].
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            rows = symbol[(ends[own] - length)[:, None] + np.arange(length)] + 1
            phrases, which = np.unique(rows, axis=0, return_inverse=True)
            which = which.ravel()
            order = np.argsort(which, kind="stable")
            edges = np.append(0, np.cumsum(np.bincount(which, minlength=len(phrases))))
            self.by_length[length] = (phrases, edges, item[own[order]])

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of words, 0 for words of no window."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, 0)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1 ... for each k, count[k] of them."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def shard_hits(symbols: np.ndarray, row: np.ndarray, phrases: Phrases, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(covered, pairs) of one shard, given each word's symbol and row: which words are hit, and the distinct (row, item)."""
    known = np.flatnonzero(symbols)
    change = np.zeros(len(symbols) + 1, np.int64)
    if not len(known) or not phrases.by_length:
        return np.zeros(len(symbols), bool), np.empty((0, 2), np.int64)
    fresh = np.ones(len(known), bool)
    fresh[1:] = (known[1:] != known[:-1] + 1) | (row[known[1:]] != row[known[:-1]])
    place = np.arange(len(known)) + np.cumsum(fresh) - 1
    text = np.zeros(int(place[-1]) + 2, np.int64)
    text[place] = symbols[known]
    word = np.zeros(len(text), np.int64)
    word[place] = known
    longest, n_items = max(phrases.by_length), len(phrases.items)
    pairs = [np.empty(0, np.int64)]
    step = limit - longest
    for begin in range(0, max(1, len(text) - longest), step):
        piece = text[begin : begin + limit]
        index = FMIndex(np.append(piece, 0) if piece[-1] else piece, len(phrases.words) + 1)
        for length, (rows, edges, items) in phrases.by_length.items():
            for first in range(0, len(rows), SEARCHED):
                low, high = index.search(rows[first : first + SEARCHED], length)
                found = np.flatnonzero(low < high)
                held = (high - low)[found]
                upto = np.cumsum(held)
                done = 0
                while done < len(found):
                    # As many phrases as have LOCATED occurrences together, one at least.
                    base = int(upto[done - 1]) if done else 0
                    stop = max(done + 1, int(np.searchsorted(upto, base + LOCATED, side="right")))
                    own, count = found[done:stop], held[done:stop]
                    at = word[begin + index.locate(_ranges(low[own], count))]
                    np.add.at(change, at, 1)
                    np.add.at(change, at + length, -1)
                    phrase = np.repeat(first + own, count)
                    seen = np.unique(row[at] * len(rows) + phrase)
                    seen_row, phrase = np.divmod(seen, len(rows))
                    of = edges[phrase + 1] - edges[phrase]
                    item = items[_ranges(edges[phrase], of)]
                    pairs.append(np.unique((np.repeat(seen_row, of) * n_items + item)[item >= 0]))
                    done = stop
    both = np.unique(np.concatenate(pairs))
    return np.cumsum(change[:-1]) > 0, np.stack(np.divmod(both, max(1, n_items)), axis=1)


class Shard:
    """The words of a slice of texts, those that are hit, and the items of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, phrases: Phrases):
        self.words = Runs(data, offsets, _WORD, LOWER)
        self.covered, pairs = shard_hits(phrases.symbols(self.words.hashes()), self.words.row, phrases)
        edges = np.searchsorted(pairs[:, 0], np.arange(len(offsets)))
        self.items = [[phrases.items[k] for k in pairs[lo:hi, 1].tolist()] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        row, hit = self.words.row, self.covered
        begins, ends = hit.copy(), hit.copy()
        begins[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
        ends[:-1] &= ~hit[1:] | (row[1:] != row[:-1])
        #: First and last word of each removal span, numbered over all texts of the slice.
        self.first, self.last = np.flatnonzero(begins), np.flatnonzero(ends)
        self.span_row = row[self.first]
        self.n_hit = np.bincount(row[hit], minlength=len(offsets) - 1)


_FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _finder(phrases: Phrases, key: str, all_rows: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_bytes(batch.column("text"))
            for i, j in slices(offsets, SHARD_BYTES):
                shard = Shard(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], phrases)
                place = shard.words.place()
                edges = np.searchsorted(shard.span_row, np.arange(j - i + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(place[shard.first]), pa.array(place[shard.last] + 1)], fields=list(_SPAN))
                columns = [batch.column(key).slice(i, j - i), pa.array(shard.words.per_row.astype(np.int64)), pa.array(shard.n_hit.astype(np.int64)), pa.array(shard.items, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(edges), spans)]
                out = pa.RecordBatch.from_arrays(columns, [key, "n_words", "n_hit", "items", "spans"])
                yield out if all_rows else out.filter(pa.array(shard.n_hit > 0))

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of several blocks as one list a row, and the words under it."""
    for batch in batches:
        hits, merged = [], []
        for spans in batch.column("spans").to_pylist():
            own: list[dict] = []
            for span in sorted(spans, key=lambda s: s["start"]):
                if own and span["start"] <= own[-1]["end"]:
                    own[-1]["end"] = max(own[-1]["end"], span["end"])
                else:
                    own.append(dict(span))
            merged.append(own)
            hits.append(sum(s["end"] - s["start"] for s in own))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), batch.column("items"), pa.array(merged, pa.list_(_SPAN))], ["doc_id", "n_words", "n_hit", "items", "spans"])


def _blocks(benchmark: DataFrame, window: int, block: int) -> list[DataFrame]:
    """The windows in blocks; the hash deals them evenly, at half the size that a block may have."""
    listed = stored(windows_of(benchmark, window))
    total = listed.count()
    if total <= block:
        return [listed]
    count = -(-2 * total // block)
    return [listed.where(F.pmod(F.xxhash64("item", "words"), F.lit(count)) == k) for k in range(count)]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, the items with occurring windows in order, and the spans of hit words."""
    blocks = _blocks(benchmark, window, block)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if len(blocks) == 1:
        return docs.mapInArrow(_finder(Phrases(blocks[0].toArrow()), "doc_id"), f"doc_id long, {_FOUND}")
    numbered = stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = None
    for k, own in enumerate(blocks):
        part = numbered.mapInArrow(_finder(Phrases(own.toArrow()), "_row", k == 0), f"_row long, {_FOUND}")
        found = part if found is None else found.unionByName(part)
    # A row has as many results as there are blocks, at most.
    whole = found.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    return numbered.select("doc_id", "_row").join(whole, "_row").drop("_row").mapInArrow(_merge, f"doc_id long, {_FOUND}")


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The documents without the hit words: each span goes from its first word to its last, whatever stands between."""
    for own in _blocks(benchmark, window, block):
        phrases = Phrases(own.toArrow())

        def cut(batches: Iterator[pa.RecordBatch], phrases: Phrases = phrases) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = flat_bytes(batch.column("text"))
                texts = batch.column("text").to_pylist()
                for i, j in slices(offsets, SHARD_BYTES):
                    shard = Shard(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], phrases)
                    start, end = shard.words.start[shard.first] + offsets[i], shard.words.end[shard.last] + offsets[i]
                    edges = np.searchsorted(shard.span_row, np.arange(j - i + 1))
                    for r in np.flatnonzero(np.diff(edges)).tolist():
                        own = slice(edges[r], edges[r + 1])
                        lo, hi = np.append(offsets[i + r], end[own]), np.append(start[own], offsets[i + r + 1])
                        texts[i + r] = b"".join(data[a:b].tobytes() for a, b in zip(lo, hi, strict=True)).decode()
                yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

        docs = docs.mapInArrow(cut, docs.schema)
    return docs


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the ids joined by commas) and contaminated."""
    found = scan(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: DuckDB SQL for the columns of `digests`.
ORACLE_SQL = r"""
with words as (
  select doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w, row_number() over () as r from documents
), items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), phrases as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') as phrase
  from items, lateral (select unnest(range(1, len(w) - least(len(w), 10) + 2)) as p) where len(w) > 0
), sizes as (select distinct n from phrases
), places as (
  select r, n, p, array_to_string(w[p : p + n - 1], ' ') as phrase
  from words, sizes, lateral (select unnest(range(1, len(w) - n + 2)) as p) where len(w) >= n
), hits as (select r, p, n, item_id from places join phrases using (n, phrase)
), covered as (select r, count(distinct p + k) as n_hit from (select r, p, unnest(range(n)) as k from (select distinct r, p, n from hits)) group by r
), named as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hits group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join covered using (r) left join named using (r)
"""
