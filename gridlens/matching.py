"""Greedy one-to-one matching in order, for groups of any size, a bounded block at a time.

What a label takes depends on all that labels before it took, so a group is matched in order of its labels; groups are
independent. In a round every group gives its next `BLOCK` labels, and the items that these may take: as many of its first
free items as there are labels, then for each second key as many of the others as labels hold it, and for each pair of
second and third key likewise. No label can go beyond these: it takes from the first set, unless it is bound to a key, and
there no more items are taken than labels hold the key. So a task gets three times a block of items at most, of four short columns.
The scan of a block is the one step that no composition of joins and windows gives; it is a helper over Arrow columns.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from gridlens.session import stored

BLOCK, BUCKET = 1 << 18, 1 << 16


def scan(labels: list[tuple], items: list[tuple]) -> list[tuple]:
    """(label, item) of labels and items (number, second key, third key), both in order."""
    queues: dict[tuple, deque] = {}
    for number, second, third in items:
        queues.setdefault((), deque()).append(number)
        if second is not None:
            queues.setdefault((second,), deque()).append(number)
            if third is not None:
                queues.setdefault((second, third), deque()).append(number)
    used: set = set()
    pairs = []
    for number, second, third in labels:
        for bound in ((second, third) if third is not None else None, (second,), ()):
            if bound is None or bound and second is None:
                continue
            free = queues.get(bound, deque())
            while free and free[0] in used:
                free.popleft()
            if free:
                used.add(free[0])
                pairs.append((number, free.popleft()))
                break
    return pairs


def _candidates(free: DataFrame, labels: DataFrame, group: list[str]) -> DataFrame:
    """The free items that a block of labels may take."""
    out, rest = None, free
    for keys in ([], ["_k1"], ["_k1", "_k2"]):
        held = labels.groupBy(*group, *keys).agg(F.count(F.lit(1)).alias("_n"))
        rank = F.row_number().over(Window.partitionBy(*group, *keys).orderBy("_i"))
        ranked = rest.withColumn("_at", rank).join(held, [*group, *keys], "left")
        first = F.coalesce(F.col("_at") <= F.col("_n"), F.lit(False))
        own = ranked.where(first).drop("_at", "_n")
        out, rest = own if out is None else out.unionByName(own), ranked.where(~first).drop("_at", "_n")
    return out


def greedy(labels: DataFrame, items: DataFrame, group: list[str], block: int = BLOCK) -> DataFrame:
    """(group, _l, _i): pairs of labels (group, _l, _k1, _k2) and items (group, _i, _k1, _k2), numbered within their group.

    A group with a null key has no pairs. Numbers that are alike are taken in any order.
    """
    there = " and ".join(f"`{g}` is not null" for g in group)
    labels, items = (df.select(*group, number, "_k1", "_k2").where(there) for df, number in ((labels, "_l"), (items, "_i")))
    kinds = labels.select(*group, "_l").schema.fields + items.select("_i").schema.fields
    schema = StructType([StructField(f.name, f.dataType) for f in kinds])

    size = len(group)

    def grouped(table: pa.Table, number: str) -> dict[tuple, list[tuple]]:
        ordered, out = table.sort_by(number), {}
        for row in zip(*(ordered.column(c).to_pylist() for c in (*group, number, "_k1", "_k2")), strict=True):
            out.setdefault(row[:size], []).append(row[size:])
        return out

    def match(asked: pa.Table, free: pa.Table) -> pa.Table:
        own = grouped(free, "_i")
        rows = [(*key, *pair) for key, held in grouped(asked, "_l").items() if key in own for pair in scan(held, own[key])]
        types = [*[asked.schema.field(g).type for g in group], asked.schema.field("_l").type, free.schema.field("_i").type]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)], schema.names)

    numbered = stored(labels.withColumn("_block", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy("_l")) - 1) / block)))
    last, total = numbered.agg(F.max("_block"), F.count(F.lit(1))).first()
    # Groups go to Python by the bucket: many small ones at once, a large one with few others.
    buckets = max(2 * int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-total // BUCKET))
    bucket = F.pmod(F.xxhash64(*group), F.lit(buckets)).alias("_bucket")
    pairs = None
    for k in range(0 if last is None else last + 1):
        asked = numbered.where(F.col("_block") == k).drop("_block")
        if pairs is None:
            # A group whose items are no more than its labels sends them all; the ranks tell which, in one pass.
            free = items
        else:
            free = stored(free.join(pairs, [*group, "_i"], "left_anti"))
        found = asked.groupBy(bucket).cogroup(_candidates(free, asked, group).groupBy(bucket)).applyInArrow(match, schema)
        pairs = stored(found) if pairs is None else stored(pairs.unionByName(found))
    return labels.sparkSession.createDataFrame([], schema) if pairs is None else pairs
