"""Cell coordinates and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column_number(letters: Column) -> Column:
    """1 for A, 27 for AA."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda n, c: n * 26 + F.when(c == "", 0).otherwise(F.ascii(c) - 64))


def column_letters(number: Column) -> Column:
    """Letters of a column up to XFD, the inverse of column_number."""
    letter = lambda n: F.when(n > 0, F.char(F.lit(65).cast("long") + (n - 1) % 26)).otherwise("")
    second = F.floor((number - 1) / 26)
    third = F.floor((second - 1) / 26)
    return F.concat(F.when(second > 0, letter(third)).otherwise(""), letter(second), letter(number))


def reference(text: Column) -> Column:
    """$A$1 as A1."""
    return F.upper(F.regexp_replace(text, r"\$", ""))


def row_of(ref: Column) -> Column:
    return F.regexp_extract(ref, r"^[A-Z]+([0-9]+)$", 1).try_cast("int")


def column_of(ref: Column) -> Column:
    return column_number(F.regexp_extract(ref, r"^([A-Z]+)[0-9]+$", 1))


def cell_range(refs: Column) -> Column:
    """First and last cell of an array of references in row-major order."""
    place = lambda r: F.struct(row_of(r).alias("row"), column_of(r).alias("col"), r.alias("ref"))
    placed = F.transform(F.filter(F.transform(refs, reference), lambda r: r.rlike("^[A-Z]+[0-9]+$")), place)
    first, last = F.array_min(placed)["ref"], F.array_max(placed)["ref"]
    return F.when(first == last, first).otherwise(F.concat_ws(":", first, last))


def plain_xpath(xpath: Column) -> Column:
    """An XPath without positions."""
    return F.regexp_replace(xpath, r"\[\d+\]", "")


def xpath_owner(xpath: Column) -> Column:
    """The element that a leaf or attribute belongs to."""
    return F.regexp_extract(xpath, r"^(.*)/[^/]+$", 1)


def logical_id(source_path: Column, schema_id: Column, xpath: Column) -> Column:
    """source:schema:xpath for a record of a known schema with an absolute path; else null."""
    return F.when((schema_id != "") & xpath.startswith("/"), F.concat_ws(":", source_path, schema_id, xpath))
