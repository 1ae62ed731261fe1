"""Evaluation of extraction over a corpus of labelled workbooks.

    python -m gridlens.evaluation --labels DIR --workbooks DIR --runs DIR [--replay OUTPUTS] [--smoke FILE]

A run extracts all workbooks that have a label, stores the outputs, and scores them; a replay scores stored outputs
again. A workbook that cannot be read scores nothing and stops no other. Each run has a folder of its own with the
scores (matrix) and, unless it is a replay, the outputs.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.operators import evaluate, extract, findings
from gridlens.session import stored
from gridlens.sources import labels as label_files
from gridlens.sources import xlsx

#: Anything that gives results for the rows of workbooks.
Extractor = Callable[[DataFrame], extract.Results]


def extract_rows(rows: DataFrame) -> extract.Results:
    """The results of workbooks as `xlsx.parse` gives them."""
    return extract.extract(xlsx.cells(rows), xlsx.merges(rows), xlsx.extents(rows), xlsx.errors(rows))


def _wanted(files: DataFrame, stems: Iterable[str] | None) -> DataFrame:
    return files.where(F.col("stem").isin(list(stems))) if stems is not None else files


def _label_items(files: DataFrame) -> DataFrame:
    return label_files.items(files).withColumn("stage_names", F.coalesce(F.transform("stages", lambda s: s["name"]), F.array().cast("array<string>")))


def score_outputs(wanted: DataFrame, outputs: DataFrame, rows: DataFrame) -> DataFrame:
    """Scores of stored outputs (stem and envelope) against labels; a workbook without rows has its cell scores at 0."""
    items = outputs.select("stem", "format", F.posexplode("plis").alias("ord", "item")).select("stem", "format", "ord", "item.*")
    items = label_files.plain(items).withColumn("stage_names", F.coalesce(F.transform("stages", lambda s: s["name"]), F.array().cast("array<string>")))
    cells = xlsx.cells(rows).withColumn("stem", xlsx.stem(F.col("workbook_id")))
    read = rows.select(xlsx.stem(F.col("workbook_id")).alias("stem"), "workbook_id").distinct()
    where = items.join(read, "stem", "left").select("*", F.col("source.sheet").alias("sheet"), F.col("source.cells").alias("cells"), F.col("ord").alias("number"))
    fields = findings.item_fields(where.where("workbook_id is not null")).join(read, "workbook_id").join(outputs.select("stem", "format"), "stem")
    files = wanted.select("stem").join(outputs.select("stem", "error"), "stem").join(read.select("stem", F.lit(True).alias("has_workbook")).distinct(), "stem", "left").na.fill(False, ["has_workbook"])
    return evaluate.file_scores(_label_items(wanted), items, fields, cells.drop("stem"), files)


def run(spark: SparkSession, labels: str, workbooks: str, runs: str, stems: Iterable[str] | None = None, extractor: Extractor = extract_rows) -> DataFrame:
    """Extracts, stores and scores all labelled workbooks; labels without a workbook are left out."""
    began = time.time()
    known = _wanted(label_files.load(spark, labels), stems)
    rows = xlsx.load(spark, workbooks).withColumn("stem", xlsx.stem(F.col("workbook_id")))
    rows = stored(rows.join(known.select("stem"), "stem", "left_semi").drop("stem"))
    place = f"{runs}/{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}"
    outputs = extract.envelopes(extractor(rows)).withColumn("stem", xlsx.stem(F.col("workbook_id"))).drop("workbook_id")
    label_files.save(outputs, f"{place}/outputs")
    scores = score_outputs(known, label_files.stored(spark, f"{place}/outputs"), rows)
    return _recorded(scores.withColumn("duration_seconds", F.round(F.lit(time.time() - began) / F.greatest(F.lit(1), F.lit(known.count())), 1)), f"{place}/matrix")


def replay(spark: SparkSession, outputs: str, labels: str, workbooks: str, runs: str, stems: Iterable[str] | None = None) -> DataFrame:
    """Scores stored outputs again, without extracting; labels without an output are left out, workbooks may be missing."""
    known = _wanted(label_files.load(spark, labels), stems)
    rows = xlsx.load(spark, workbooks).withColumn("stem", xlsx.stem(F.col("workbook_id")))
    rows = stored(rows.join(known.select("stem"), "stem", "left_semi").drop("stem"))
    scores = score_outputs(known, label_files.stored(spark, outputs), rows).withColumn("duration_seconds", F.lit(0.0))
    return _recorded(scores, f"{runs}/{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}-replay/matrix")


def _recorded(scores: DataFrame, path: str) -> DataFrame:
    scores.orderBy("stem").write.json(path)
    return scores.sparkSession.read.schema(scores.schema).json(path)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("labels", "workbooks", "runs"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--replay")
    parser.add_argument("--smoke", help="a file with the stems of a short run, one a line")
    given = parser.parse_args()
    spark = SparkSession.builder.appName("gridlens evaluation").getOrCreate()
    stems = [r["value"] for r in spark.read.text(given.smoke).where("trim(value) <> ''").collect()] if given.smoke else None
    scores = replay(spark, given.replay, given.labels, given.workbooks, given.runs, stems) if given.replay else run(spark, given.labels, given.workbooks, given.runs, stems)
    for row in evaluate.rendered(scores).orderBy("place").toLocalIterator():
        print(row["line"])


if __name__ == "__main__":
    main()
