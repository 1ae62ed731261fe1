"""From raw documents to packed training sequences: five stages over the operators of gridlens.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents, whatever
their names: a stage hands its operator doc_id and text, with the whole row beside them as one value. `run` writes each
result as Parquet and reads it again for the next. Null texts have no words and fail the quality rules; rows with a null
doc_id are documents like others; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm import jaccard, linededup, packing, pii, quality
from gridlens.llm.frames import stored

_ROW = "_whole_row"


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(_ROW))


def _rows(done: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The whole rows again, with a new text and its length if given."""
    row = F.col(_ROW)
    if text is not None:
        row = row.withField("text", text)
        if "n_chars" in docs.columns:
            row = row.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return done.select(row.alias(_ROW)).select(f"{_ROW}.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _rows(quality.judge(_slim(docs)).where("kept"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stood before; one with nothing left was a copy and goes."""
    done = linededup.dedup_lines(_slim(docs), short=True).where("n_removed = 0 or n_removed < n_lines")
    return _rows(done, docs, F.col("text"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id, nulls last; of rows equal in doc_id and text, one.

    Groups are of rows, not of ids: a row is known by its doc_id and its text's digest, so rows without a doc_id, or that
    share one, are told apart. Rows without words stay.
    """
    keys = {"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_digest": F.concat_ws(":", F.length("text"), F.md5("text"))}
    rows = jaccard.labelled(docs.select("doc_id", "text", *[v.alias(k) for k, v in keys.items()]), keep=tuple(keys))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_digest", "_id")).alias("f")
    kept = rows.where("root is not null").groupBy("root").agg(first).select("f._id", "f._digest").unionByName(rows.where("root is null").select("_id", "_digest"))
    return _rows(_slim(docs).withColumns(keys).join(kept, ["_id", "_digest"], "left_semi").dropDuplicates(["_id", "_digest"]), docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by the kind of each span."""
    return _rows(pii.redact(_slim(docs)), docs, F.col("text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("PII", hide_personal_data),
    ("best-fit packing", pack_sequences),
]

#: No SQL: the quality verdict is an estimate by expectation-maximisation and the tokens come from a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
