"""Removal of repeated lines: overlapping three-line windows, kept only where they stand first.

Windows run over a document's lines that are not blank. Each window is hashed (MD5 of its lines); the first place of a
window is the smallest (doc_id, place), nulls first; every later occurrence covers its three lines, and covered lines go.
DataFrame functions only: the texts are shuffled once, to meet their covered places; hot windows are counted before any
shuffle and split by the skew join.

Null texts stay null, texts with fewer than three lines that are not blank stay whole, unless `short` asks for one window
of all their lines, so that whole copies of short texts go as well; blank lines stay. Rows alike in
doc_id and text count as one document and are treated alike. Other columns pass through; clashing ones (`_...`) too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3
_BLANK = r"^[ \t\x0B\f\r]*$"


def _filled(text: Column) -> Column:
    """The lines that are not blank, in order."""
    return F.filter(F.split(text, "\n"), lambda line: ~line.rlike(_BLANK))


def _row_key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.md5("text").alias("_digest")]


def covered_places(docs: DataFrame, window: int = WINDOW, short: bool = False) -> DataFrame:
    """(_id, _digest, _covered): for each document with later occurrences, the sorted places of the lines they cover."""
    # The lines of a window hold no line break, so windows of unlike numbers of lines are unlike.
    hashed = lambda lines: F.transform(F.sequence(F.lit(1), F.greatest(F.size(lines) - (window - 1), F.lit(1))), lambda at: F.unhex(F.md5(F.array_join(F.slice(lines, at, window), "\n"))))
    # Bound in a one-element array, so that a text is split once, not for each window.
    found = F.get(F.transform(F.array(_filled(F.col("text"))), lambda lines: F.struct(F.size(lines).alias("n"), hashed(lines).alias("windows"))), F.lit(0))
    lines = docs.where("text is not null").select("doc_id", *_row_key(), found.alias("_found")).where(F.col("_found.n") >= (1 if short else window))
    placed = lines.select("doc_id", "_id", "_digest", F.least(F.col("_found.n"), F.lit(window)).alias("_size"), F.posexplode("_found.windows").alias("_place", "_window"))
    here = F.struct(F.col("doc_id"), F.col("_place"), F.col("_digest")).alias("_here")
    first = placed.groupBy("_window").agg(F.min(here).alias("_first"), F.max(here).alias("_last")).where(~F.col("_first").eqNullSafe(F.col("_last"))).drop("_last")
    later = placed.join(first, "_window").where(~here.eqNullSafe(F.col("_first"))).select("_id", "_digest", "_place", "_size")
    # The places of one document are as many as its lines at most.
    spans = later.select("_id", "_digest", F.explode(F.sequence(F.col("_place"), F.col("_place") + F.col("_size") - 1)).alias("_at"))
    return spans.groupBy("_id", "_digest").agg(F.array_sort(F.collect_set("_at")).alias("_covered"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, short: bool = False) -> DataFrame:
    """Replaces `text` by what is left of it; adds n_lines (not blank, before) and n_removed."""
    moved = {c: f"__{c}" for c in docs.columns if c.lower() in ("_id", "_digest", "_covered", "_result", "n_lines", "n_removed")}
    own = docs.withColumnsRenamed(moved)
    joined = own.withColumns({"_id": _row_key()[0], "_digest": _row_key()[1]}).join(covered_places(docs.select("doc_id", "text"), window, short), ["_id", "_digest"], "left")
    # Bound in a one-element array, so that a text is split once, not for each line.
    held = F.struct(F.split("text", "\n").alias("lines"), F.coalesce("_covered", F.array().cast("array<int>")).alias("covered"))
    result = F.get(F.transform(F.array(held), lambda h: _without(h["lines"], h["covered"])), F.lit(0))
    done = joined.withColumn("_result", F.when(F.col("text").isNotNull(), result))
    done = done.withColumns({"n_lines": F.coalesce("_result.n_lines", F.lit(0)).cast("long"), "n_removed": F.size(F.coalesce("_covered", F.array().cast("array<int>"))).cast("long"), "text": F.when(F.col("_covered").isNull(), F.col("text")).otherwise(F.col("_result.text"))})
    back = {v: k for k, v in moved.items() if k.lower() not in ("n_lines", "n_removed")}
    return done.drop("_id", "_digest", "_covered", "_result").withColumnsRenamed(back)


def _without(lines: Column, covered: Column) -> Column:
    """(n_lines, text): the lines but those that are not blank and whose number among these is covered; in linear time."""
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    numbered = F.filter(places, lambda i: ~F.get(lines, i).rlike(_BLANK))

    def cut(filled: Column) -> Column:
        kept = F.array_except(places, F.transform(covered, lambda k: F.get(filled, k)))
        return F.struct(F.size(filled).alias("n_lines"), F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"))

    return F.get(F.transform(F.array(numbered), cut), F.lit(0))


#: DuckDB SQL for doc_id, text, n_lines and n_removed.
ORACLE_SQL = r"""
with lines as (
  select d.doc_id, l.line, l.pos, case when regexp_full_match(l.line, '[ \t\x0B\f\r]*') then null else 1 end as filled
  from documents d, lateral (select unnest(string_split(d.text, chr(10))) as line, unnest(range(len(string_split(d.text, chr(10))))) as pos) l
), numbered as (
  select *, case when filled = 1 then count(filled) over (partition by doc_id order by pos) - 1 end as place from lines
), windows as (
  select a.doc_id, a.place, a.line || chr(10) || b.line || chr(10) || c.line as w
  from numbered a join numbered b on b.doc_id = a.doc_id and b.place = a.place + 1 join numbered c on c.doc_id = a.doc_id and c.place = a.place + 2
), ranked as (
  select doc_id, place, row_number() over (partition by w order by doc_id, place) as k from windows
), covered as (
  select distinct doc_id, place + o.step as place from ranked, (values (0), (1), (2)) o(step) where k > 1
)
select n.doc_id, coalesce(string_agg(n.line, chr(10) order by n.pos) filter (c.place is null), '') as text,
  cast(count(n.place) as bigint) as n_lines, cast(count(c.place) as bigint) as n_removed
from numbered n left join covered c on c.doc_id = n.doc_id and c.place = n.place group by n.doc_id
union all select doc_id, text, 0, 0 from documents where text is null
"""
