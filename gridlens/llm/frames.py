"""Small DataFrame helpers: cutting lineage, joins with hot keys, gapless ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key with more than one in so many rows is dealt out; so there are fewer such keys than this.
SHARES = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's spark.checkpoint.dir.

    Where that is unset, a local session gets a folder of its own; a cluster must name one, as its machines share no disk.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-gridlens-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where}/gridlens-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Deletes the session's intermediate tables; results that were not yet written elsewhere are lost with them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    """How many reduce tasks the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def dealt_join(many: DataFrame, one: DataFrame, key: str, spread: Column, how: str = "inner", shares: int = SHARES, counted: DataFrame | None = None) -> DataFrame:
    """Joins `many`, in which a key may hold any share of the rows, with `one`, one row a key.

    Keys with more than 1 / shares of the rows are told to every task (fewer than `shares` of them); their rows are
    dealt over as many parts as they hold shares, by the hash of `spread`, and their row of `one` is repeated for each.
    Null keys match nothing and are dealt out too. The keys are counted in a pass of their own: over `counted`, if `many`
    is no stored table.
    """
    counted = many if counted is None else counted
    total = counted.count()
    least = max(total / shares, 8.0)
    parts = F.ceil(F.col("_n") / F.lit(least)).cast("int").alias("_parts")
    hot = F.broadcast(counted.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > least) & F.col(key).isNotNull()).select(key, parts))
    own = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(shares))).when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(spread), F.col("_parts"))).otherwise(F.lit(0))
    left = many.join(hot, key, "left").withColumn("_deal", own.cast("int")).drop("_parts")
    right = one.join(hot, key, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [key, "_deal"], how).drop("_deal")


def gapless_rank(df: DataFrame, group: str, order: list[Column], spread: Column, buckets: int, out: str) -> DataFrame:
    """Adds `out`, numbers 0, 1, 2 ... without gaps within each `group`, in order of (spread bucket, order).

    No group is numbered in one task: rows are dealt over `buckets` parts of each group by the hash of `spread`, which
    must be a function of the row; the parts' offsets come from counts, at most `buckets` rows a group.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int")).repartition(F.col(group), F.col("_part"))
    counts = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1)
    return local.join(base, [group, "_part"]).withColumn(out, F.col("_base") + F.col("_at")).drop("_part", "_base", "_at")
