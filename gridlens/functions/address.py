"""A1 addresses: letters for columns, numbers for rows, both from 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column_letters(number: Column) -> Column:
    """A, B ... Z, AA ... for a column number up to three letters."""
    n = number.cast("int") - 1
    letter = lambda x: F.char(F.lit(65) + x)
    second, third = F.floor(n / 26) - 1, F.floor((F.floor(n / 26) - 1) / 26) - 1
    return F.when(n < 26, letter(n)).when(n < 702, F.concat(letter(second), letter(n % 26))).otherwise(F.concat(letter(third), letter(second % 26), letter(n % 26)))


def address(row: Column, column: Column) -> Column:
    return F.concat(column_letters(column), row.cast("string"))


def column_of(addr: Column) -> Column:
    """The column number of an address."""
    letters = F.split(F.upper(F.regexp_extract(addr, "^[A-Za-z]+", 0)), "")
    return F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0), lambda n, x: n * 26 + (F.ascii(x) - 64))


def row_of(addr: Column) -> Column:
    """The row number of an address."""
    return F.regexp_extract(addr, r"\d+$", 0).try_cast("int")
