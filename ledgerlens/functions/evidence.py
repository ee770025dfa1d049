"""Predicates on evidence columns: source_path, locator, sheet, cell_range, page, xpath, line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import trimmed

FIELDS = {"source_path": "string", "locator": "string", "sheet": "string", "page": "int", "cell_range": "string", "xpath": "string", "line": "int"}


def _has(text: Column) -> Column:
    return F.coalesce(trimmed(text) != "", F.lit(False))


def with_evidence(rows: DataFrame) -> DataFrame:
    """rows with the evidence columns they lack, as nulls."""
    return rows.withColumns({n: F.lit(None).cast(t) for n, t in FIELDS.items() if n not in rows.columns})


def precise() -> Column:
    """A source and a locator, and a cell range, a page, an absolute XPath or a line."""
    c = F.col
    cell = _has(c("sheet")) & _has(c("cell_range"))
    place = cell | F.coalesce(c("page") > 0, F.lit(False)) | F.coalesce(c("xpath").startswith("/"), F.lit(False)) | F.coalesce(c("line") > 0, F.lit(False))
    return _has(c("source_path")) & _has(c("locator")) & place


def reliable() -> Column:
    return F.coalesce(F.col("reliability"), F.lit("reliable")) == "reliable"


def verified(flag: str = "source_fields_verified_complete") -> Column:
    """The flag is true and the evidence precise."""
    return F.coalesce(F.col(flag), F.lit(False)) & precise()
