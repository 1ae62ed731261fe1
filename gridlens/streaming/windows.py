"""Event-time windows that run alike over a stored table and over a stream.

On a stream a watermark bounds the state: rows later than it are dropped, and a window is given out once it is past.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.session import stored


def marked(events: DataFrame, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """A timestamp with a watermark on streams; stored tables have no late rows."""
    typed = events.withColumn(time, F.col(time).cast("timestamp"))
    return typed.withWatermark(time, late) if events.isStreaming else typed


def tumbling(events: DataFrame, size: str, keys: list[str], value: str = "value") -> DataFrame:
    """Count, sum and largest value of each window and key."""
    return _measured(events, F.window("ts", size), keys, value)


def sliding(events: DataFrame, size: str, step: str, keys: list[str], value: str = "value") -> DataFrame:
    return _measured(events, F.window("ts", size, step), keys, value)


def sessions(events: DataFrame, gap: str, keys: list[str], value: str = "value") -> DataFrame:
    """Runs of a key's events with less than `gap` between neighbours."""
    return _measured(events, F.session_window("ts", gap), keys, value)


def _measured(events: DataFrame, window, keys: list[str], value: str) -> DataFrame:
    grouped = marked(events).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"), F.max(value).alias("largest"))
    return grouped.select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), *keys, "n", "total", "largest")


def first_of_each(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each path once: repeats that arrive within the watermark are dropped."""
    return files.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["path"]) if files.isStreaming else files.dropDuplicates(["path"])


def each_batch(stream: DataFrame, sink, checkpoint: str):
    """Starts a query that hands every micro-batch of what has arrived to `sink(batch, id)` and ends; files are taken once by the checkpoint."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals_sink(out: str):
    """A sink for `each_batch` that extracts a batch of workbooks into `out`, exactly once.

    Outputs are keyed by batch and workbook (batch=.../stem=...), and a batch that is run again, as it is after a failure
    between its output and its commit, replaces what it wrote before. Each write is committed whole.
    """
    from gridlens.operators import extract
    from gridlens.sources import xlsx

    def work(batch: DataFrame, number: int) -> None:
        rows = stored(xlsx.parse(batch))
        results = extract.extract(xlsx.cells(rows), xlsx.merges(rows), xlsx.extents(rows), xlsx.errors(rows))
        outputs = extract.envelopes(results).withColumns({"batch": F.lit(number), "stem": xlsx.stem(F.col("workbook_id"))}).drop("workbook_id")
        outputs.write.partitionBy("batch", "stem").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(out)

    return work


def extract_arrivals(spark: SparkSession, path: str, out: str, checkpoint: str):
    """Starts a query that extracts all workbooks that have arrived under a path, each exactly once, into `out`."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path)
    return each_batch(stream, arrivals_sink(out), checkpoint)


def spread(events: DataFrame, size: str, keys: list[str], value: str = "value", shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Percentiles of each window and key, exact to one in ten thousand rows."""
    found = F.percentile_approx(value, [float(s) for s in shares], 10_000)
    grouped = marked(events).groupBy(F.window("ts", size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), found.alias("p"))
    return grouped.select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), *keys, "n", *[F.get("p", F.lit(k)).alias(f"p{round(100 * s)}") for k, s in enumerate(shares)])


def histogram(events: DataFrame, bounds: list[float], keys: list[str], value: str = "value") -> DataFrame:
    """(bucket, n, total): how many values of each key are at most each bound and over the one before; the last bucket has no bound."""
    bucket = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        bucket = F.when(F.col(value) <= bounds[k], k).otherwise(bucket)
    return events.groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))


def levels(events: DataFrame, up: str, down: str, keys: list[str], kind: str = "event_type") -> DataFrame:
    """(level): the events of kind `up` less those of kind `down`, for each key."""
    change = F.when(F.col(kind) == up, 1).when(F.col(kind) == down, -1).otherwise(0)
    return events.groupBy(*keys).agg(F.sum(change).alias("level"))


def durations(events: DataFrame, phase: str, value: str = "value") -> DataFrame:
    """Count, mean and largest duration of each phase."""
    return events.groupBy(phase).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.max(value), 6).alias("largest"))


def sliding_durations(events: DataFrame, size: str, step: str, phase: str, value: str = "value") -> DataFrame:
    """Count, mean and largest duration of each phase in windows of `size` that begin every `step`: a moving average."""
    grouped = marked(events).groupBy(F.window("ts", size, step).alias("w"), phase).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.max(value), 6).alias("largest"))
    return grouped.select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), phase, "n", "mean", "largest")
