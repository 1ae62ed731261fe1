"""Scalar functions on cell text and values, all built from Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shapes of text that count as a date.
DATE_SHAPES = (r"\d{1,2}[-/]\w{3}[-/]\d{2,4}", r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}")
#: The date formats read, in order; those with two-digit years are marked. ISO dates come last.
DATE_FORMATS = (("d-MMM-yyyy", False), ("d-MMM-yy", True), ("d MMM yyyy", False), ("d/M/yyyy", False), ("d/M/yy", True), ("d.M.yyyy", False), ("d-M-yyyy", False), ("yyyy-MM-dd", False))


def norm(text: Column) -> Column:
    """Trimmed, lower case, with one space for each run of (Unicode) white space; null stays null."""
    # Texts of visible ASCII alone, most of a grid, have no white space to look for.
    return F.trim(F.lower(F.when(text.rlike("[^!-~]"), F.regexp_replace(text, r"(?U)\s+", " ")).otherwise(text)))


def norm_or_empty(text: Column) -> Column:
    return F.coalesce(norm(text), F.lit(""))


def is_date_text(text: Column) -> Column:
    """Whether a text has one of the date shapes."""
    return text.rlike(r"(?U)^\s*(?:" + "|".join(DATE_SHAPES) + r")\s*$")


def is_date_cell(dtype: Column, sval: Column) -> Column:
    """A native date, or a text shaped like one."""
    return F.coalesce((dtype == "date") | ((dtype == "str") & is_date_text(sval)), F.lit(False))


def flexible_date(text: Column) -> Column:
    """The first format that reads the trimmed text; two-digit years from 69 on are in the 1900s. Null if none does."""
    clean = F.trim(text)

    def read(pattern: str, short: bool) -> Column:
        day = F.try_to_date(clean, pattern) if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(clean, F.lit(pattern)))
        return F.when((F.year(day) % 100 >= 69) & (F.year(day) >= 2000), F.add_months(day, -1200)).otherwise(day) if short else day

    return F.coalesce(*[read(p, s) for p, s in DATE_FORMATS])


def coerce_text(dtype: Column, sval: Column, nval: Column) -> Column:
    """A text field: whole numbers lose their fraction, everything else is its rendering."""
    whole = (dtype == "float") & (nval == F.floor(nval))
    return F.when(whole, nval.cast("bigint").cast("string")).otherwise(sval)


def coerce_int(dtype: Column, sval: Column, nval: Column) -> Column:
    """A whole-number field: booleans are none, numbers are cut, texts are read without commas, else none."""
    return F.when(dtype == "bool", F.lit(None).cast("bigint")).when(dtype.isin("int", "float"), nval.cast("bigint")).otherwise(F.trim(F.replace(sval, F.lit(","), F.lit(""))).try_cast("bigint"))


def values_equal(left: Column, right: Column) -> Column:
    """Equality after reading ISO dates and trimming other texts; two missing values are equal."""

    def plain(x: Column) -> Column:
        clean = F.trim(x)
        day = F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]00:00:00)?$"), F.left(clean, F.lit(10)))
        return F.coalesce(day, clean)

    return plain(left).eqNullSafe(plain(right))


def token_coverage(label: Column, names: Column) -> Column:
    """The largest share of the label's words that are substrings of one of the names; 0 without words or names."""
    words = F.filter(F.split(norm_or_empty(label), " "), lambda w: w != "")
    share = F.transform(names, lambda n: F.size(F.filter(words, lambda w: F.contains(F.lower(n), w))) / F.size(words))
    return F.when((F.size(words) > 0) & (F.size(names) > 0), F.array_max(share)).otherwise(F.lit(0.0))


def cell_dtype(value: Column) -> Column:
    """The type tag of a text read from an untyped source."""
    return (
        F.when(value.isNull(), "empty").when(F.lower(value).isin("true", "false"), "bool").when(value.rlike(r"^[+-]?\d+$"), "int")
        .when(value.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "float").when(value.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), "date")
        .when(value.startswith("#") & value.endswith("!"), "error").otherwise("str")
    )


def typed_values(texts: Column, kinds: Column) -> Column:
    """A map of texts as variants: numbers and booleans by their kinds, all else as text, dates too."""

    def one(name: Column, text: Column) -> Column:
        kind = F.try_element_at(kinds, name)
        number = F.when(kind == "int", F.try_parse_json(text)).when(kind == "float", text.try_cast("double").cast("variant")).when(kind == "bool", (text == "True").cast("variant"))
        return F.coalesce(number, text.cast("variant"))

    return F.transform_values(texts, one)


def kinds_of(typed: Column) -> Column:
    """The kinds of a map of variants; a text that shows a day and a time of day is a date."""

    def one(_: Column, value: Column) -> Column:
        schema = F.schema_of_variant(value)
        text = F.when(value.cast("string").rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), "date").otherwise("str")
        return F.when(schema == "BIGINT", "int").when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "float").when(schema == "BOOLEAN", "bool").when(schema == "STRING", text).otherwise("str")

    return F.transform_values(typed, one)


def texts_of(typed: Column) -> Column:
    """The texts of a map of variants, as cells show them."""

    def one(_: Column, value: Column) -> Column:
        schema = F.schema_of_variant(value)
        real = F.when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), value.cast("double").cast("string"))
        return F.coalesce(real, F.when(schema == "BOOLEAN", F.initcap(value.cast("string"))), value.cast("string"))

    return F.transform_values(typed, one)


def severity(value: Column) -> Column:
    """Finding severities as warning severities."""
    return F.when(value == "warn", "warning").otherwise(value)
