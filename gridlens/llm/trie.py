"""The trie of conversation prefixes: which turns conversations share, and what a cache of shared prefixes saves.

Every conversation gets a chain of SHA-256 digests, one for each prefix: the digest of d turns is that of the digest of d - 1
turns and the d-th turn's own. A task streams through its conversations in order, so a conversation of any length needs no
memory but its last digest. The prefixes, one row each, are grouped by (depth, digest): these are the nodes.

A node is named by its smallest member and its depth. The nodes that share a smallest member are a chain, each the parent of
the next, so what lies below a node is summed in two steps: along its chain, and from each chain to all its ancestors. A
chain has at most as many ancestors as its smallest member has turns; so the explode stays within the number of turns,
where exploding node by node grows with the square of a conversation's length.

Turns are ordered by turn, nulls first; turns alike in number by role, then text. Null roles and texts are empty ones. Rows
without conv_id belong to no conversation and count nowhere. An empty table has no nodes, not even a root. Other columns do
not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.llm.frames import dealt_join, stored

#: Conversation ids that differ only in so many low bits are joined to one text before the ends of a node are hashed.
ID_BITS = 14
WORD = r"[^\x20\x09-\x0D]+"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, n_words): every turn with its place in its conversation, from 1; texts are not shuffled."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = F.sha2(F.concat_ws(":", F.length(role), F.concat(role, text)), 256)
    slim = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(own).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), role.alias("_role"), F.substring(text, 1, 32).alias("_head"), F.sha2(text, 256).alias("_tail"))
    order = [F.col("turn").asc_nulls_first(), "_role", "_head", "_tail"]
    return slim.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long")).select("conv_id", "place", "digest", "n_words")


def rebuilt(turns: DataFrame, base: Column, shared: Column) -> DataFrame:
    """The turns of every conversation after its first `shared` places were replaced by those of conversation `base`, at most three.

    Places keep their order and may have gaps. A conversation without any turn left has one row with a null place.
    """
    convs = turns.select("conv_id").distinct().select("conv_id", base.alias("_base"), shared.cast("long").alias("_shared"))
    heads = turns.where("place <= 3").select(F.col("conv_id").alias("_base"), "place", "digest", "n_words")
    first = convs.join(heads, "_base").where("place <= _shared").select("conv_id", "place", "digest", "n_words")
    own = turns.where(F.col("place") > shared)
    none = convs.select("conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_words"))
    return first.unionByName(own).unionByName(none)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of every prefix; conversations come whole and in order, each led by its row without a place."""
    conv, depth, state = None, 0, b""
    for batch in batches:
        depths, digests = [], []
        for c, digest in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist(), strict=True):
            if c != conv:
                conv, depth, state = c, 0, b""
            else:
                depth, state = depth + 1, hashlib.sha256(state + digest).digest()
            depths.append(depth)
            digests.append(state)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(depths, pa.int64()), pa.array(digests, pa.binary()), batch.column("n_words")], ["conv_id", "depth", "digest", "n_words"])


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, n_words, is_last): one row for each prefix of each conversation, the empty one included."""
    chained = turns.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("place").asc_nulls_first()).mapInArrow(_chain, "conv_id long, depth long, digest binary, n_words long")
    follow = F.lead("depth").over(Window.partitionBy("conv_id").orderBy("depth"))
    return chained.withColumn("is_last", follow.isNull())


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node from its texts of ids, which come in order; no node's ids are held together."""
    node, running = None, hashlib.sha256()
    for batch in batches:
        done = []
        for owner, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ids")), strict=True):
            if (owner, depth) != node:
                if node is not None:
                    done.append((*node, running.hexdigest()))
                node, running = (owner, depth), hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield _ended(done)
    yield _ended([(*node, running.hexdigest())] if node is not None else [])


def _ended(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    owner, depth, digest = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(depth, pa.int64()), pa.array(digest, pa.string())], ["owner", "depth", "ends_sha256"])


def ends(owned: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of the nodes at which conversations end."""
    part = F.shiftright("conv_id", ID_BITS).alias("part")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    texts = owned.where("is_last").groupBy("owner", "depth", part).agg(ids)
    return texts.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "part").mapInArrow(_hash_ends, "owner long, depth long, ends_sha256 string")


def nodes(turns: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    members = stored(prefixes(turns))
    grouped = stored(members.groupBy("depth", "digest").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("n_words").alias("n_words")))
    # A digest is of one depth only, but for the empty text's: the root's.
    owned = stored(dealt_join(members.drop("n_words"), grouped.select("digest", "owner"), "digest", F.col("conv_id")).drop("digest"))
    path = Window.partitionBy("conv_id").orderBy("depth")
    stepped = owned.withColumns({"parent": F.lag("owner").over(path), "next_owner": F.lead("owner").over(path)})
    stepped = stored(stepped)
    own = stepped.where("owner = conv_id").select("owner", "depth", F.col("parent").alias("parent_conv_id"))
    kids = own.where("parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    known = grouped.select("owner", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"))
    node = stored(own.join(known, ["owner", "depth"]).join(kids, ["owner", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    # What each chain holds, and the last node of every ancestor chain on the way to the root: there it is added.
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    held = node.groupBy("owner").agg(F.sum("saved").alias("saved"), F.sum(leaf).alias("leaves"))
    above = stepped.where("owner <> conv_id and next_owner <> owner").select(F.col("conv_id").alias("below"), F.col("owner"), "depth")
    added = above.join(held.withColumnRenamed("owner", "below"), "below").groupBy("owner", "depth").agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    down = Window.partitionBy("owner").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    nothing = F.lit(0).cast("long")
    summed = node.join(added, ["owner", "depth"], "left").withColumns(
        {"n_leaves": F.sum(leaf + F.coalesce("more_leaves", nothing)).over(down), "saved_tokens": F.sum(F.col("saved") + F.coalesce("more_saved", nothing)).over(down)}
    )
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return summed.join(ends(owned), ["owner", "depth"], "left").select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


def build(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of the conversations as they are."""
    turns = turns_of(conversations)
    none = turns.select("conv_id").distinct().select("conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_words"))
    return nodes(turns.unionByName(none))


def build_rebuilt(conversations: DataFrame) -> DataFrame:
    """The nodes over conversations that begin with up to three turns of the conversation whose id is the next lower multiple of 20."""
    turns = stored(turns_of(conversations))
    return nodes(rebuilt(turns, F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string")) % 4))


#: DuckDB SQL for the columns of `build_rebuilt`; CRC-32 bit by bit.
ORACLE_SQL = r"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place
  from conversations where conv_id is not null
), ids as (select distinct conv_id from turns
), bytes as (
  select conv_id, list_concat([4294967295::bigint], flatten(list_transform(string_split(cast(conv_id as varchar), ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))) as ops from ids
), convs as (
  select conv_id, conv_id - conv_id % 20 as base, xor(list_reduce(ops, lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295) % 4 as h from bytes
), rebuilt as (
  select c.conv_id, t.place, t.role, t.text from convs c join turns t on t.conv_id = c.base and t.place <= c.h
  union all select c.conv_id, t.place, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.place > c.h
), numbered as (
  select *, row_number() over w as depth, count(*) over (partition by conv_id) as n, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over w as path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words
  from rebuilt window w as (partition by conv_id order by place)
), members as (
  select conv_id, depth, path, words, n = depth as last from numbered
  union all select conv_id, 0, '', 0, not exists (select 1 from rebuilt r where r.conv_id = i.conv_id) from ids i
), nodes as (
  select depth, path, min(conv_id) as owner, count(*) as n_convs, min(words) as words, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (last), '') as ends from members group by depth, path
), parents as (
  select n.*, p.owner as parent, p.path as parent_path from nodes n join members m on m.conv_id = n.owner and m.depth = n.depth
  left join members pm on pm.conv_id = n.owner and pm.depth = n.depth - 1 left join nodes p on p.depth = pm.depth and p.path = pm.path
), kids as (select depth - 1 as depth, parent_path as path, count(*) as n_children from parents where parent is not null group by all
), whole as (select p.*, coalesce(n_children, 0) as n_children from parents p left join kids k on k.depth = p.depth and k.path = p.path
), above as (
  select m.depth, m.path, sum((w.n_convs - 1) * w.words) as saved, count(*) filter (w.n_children = 0) as leaves from whole w join members m on m.conv_id = w.owner and m.depth <= w.depth group by m.depth, m.path
)
select cast(owner as bigint) as conv_id, cast(depth as bigint) as depth, cast(parent as bigint) as parent_conv_id, n_convs, cast(n_children as bigint) as n_children, cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(ends) as ends_sha256
from whole join above using (depth, path)
"""
