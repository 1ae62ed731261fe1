"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


SHEET = ["workbook_id", "sheet"]
#: How many times its Parquet bytes a table of sheets and rows takes in memory: 26 for cells, 125 for roles.
UNPACKED = 100
#: The names of bucketed tables by application.
_NAMES: dict[str, list[str]] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the settings the library is tested under; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gridlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.driver.memory", os.environ.get("GRIDLENS_DRIVER_MEMORY", "8g"))
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder; columns are pruned by the optimiser."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's folder for intermediate tables, in the cluster's spark.checkpoint.dir.

    Where that is unset, a local session gets a folder of its own; a cluster must name one, as its machines share no disk.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-gridlens-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where}/grids-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """The rows written once as Parquet and read from there: later plans are short, and a lost executor costs no recomputation.

    With a number of buckets, rows of sheets are stored in so many buckets of sheets.
    """
    if buckets and set(SHEET) <= set(df.columns):
        return clustered(df, SHEET, buckets)
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clustered(df: DataFrame, keys: list[str], n: int, order: list[str] | None = None) -> DataFrame:
    """The rows written once in n buckets by keys: windows, groups and joins that hold the keys need no shuffle of them.

    Joins by the keys and more (a sheet and a row) keep the buckets too, so these must stay small: choose n by the size of the data.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # Else the planner gives up buckets under an explode, and what was exploded is shuffled.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    # Names of sheets and roles take up to a hundred times their Parquet bytes once they are rows: else tables far over the threshold are sent through the driver to all executors.
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(UNPACKED))
    name = f"gridlens_{uuid.uuid4().hex}"
    writer = df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).option("path", f"{shared_dir(spark)}/{name}")
    (writer.sortBy(*order) if order else writer).saveAsTable(name)
    _NAMES.setdefault(spark.sparkContext.applicationId, []).append(name)
    return spark.table(name)


def discard(spark: SparkSession) -> None:
    """Deletes the session's intermediate tables."""
    for name in _NAMES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"drop table if exists {name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stamp(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Name, length and time of change of the files at a path: other files make another stamp."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in listed))
