"""Labels and stored outputs as JSON, one file a workbook. Keys that the schema does not know are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.functions import scalars

STAGE = "struct<name:string,planned_date:date,quantity:bigint,section:string,metadata:map<string,string>,confidence:double>"
ITEM = f"struct<io_number:string,style_code:string,style_name:string,color_code:string,color_name:string,fabric_code:string,delivery_date:date,quantity:bigint,stages:array<{STAGE}>,confidence:map<string,double>,metadata:map<string,variant>,source:struct<sheet:string,rows:array<int>,cells:map<string,string>>>"
SCHEMA = f"plis array<{ITEM}>, warnings array<string>, format string, confidence double, source_file string, error string"


def load(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: its stem, items, warnings and the rest of the envelope. A file that is no JSON has null items."""
    found = spark.read.schema(SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    name = F.url_decode(F.replace(F.expr("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # names are given as in a URL
    stem = F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)
    return found.select(stem.alias("stem"), "*")


def items(files: DataFrame) -> DataFrame:
    """One row an item: stem, its order in the file, and its fields; null confidences are dropped, empty texts are null.

    Metadata is held in files as JSON has it, so numbers and booleans stay what they were; here it is texts and their kinds.
    """
    each = plain(files.select("stem", F.posexplode("plis").alias("ord", "item")).select("stem", "ord", "item.*"))
    texts = {c: F.nullif(c, F.lit("")) for c in ("io_number", "style_code", "style_name", "color_code", "color_name", "fabric_code")}
    return each.withColumns(texts).withColumn("confidence", F.map_filter("confidence", lambda _, v: v.isNotNull()))


def plain(items: DataFrame) -> DataFrame:
    """Items with their typed metadata as texts (metadata) and kinds (metadata_kinds)."""
    held = F.map_filter("metadata", lambda _, v: ~F.is_variant_null(v))
    return items.withColumns({"metadata": scalars.texts_of(held), "metadata_kinds": scalars.kinds_of(held)})


def parsed_warnings(files: DataFrame) -> DataFrame:
    """(stem, message, severity): warnings given as plain texts, or as JSON objects with a message."""
    one = F.from_json("w", "message string, severity string")
    each = files.select("stem", F.explode("warnings").alias("w"))
    return each.select("stem", F.coalesce(one["message"], "w").alias("message"), F.coalesce(one["severity"], F.lit("warning")).alias("severity"))


def save(results: DataFrame, path: str) -> None:
    """Stored outputs, one folder a stem, so that `stored` reads them again without extracting."""
    results.write.partitionBy("stem").mode("overwrite").json(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, stem string").json(path)
