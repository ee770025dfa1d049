"""Groups streamed through Arrow: many small groups without a pandas call for each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

ROWS = 4096


def by_group(rows: DataFrame, key: str, fold: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """fold over each group of rows (tuples in column order) that share `key`, which is the first column.

    One shuffle brings a group together; a group must be bounded by its nature (a sheet, a page).
    """
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType) and rows.columns[0] == key
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][0] != row[0]:
                    out.extend(fold(held))
                    held = []
                    if len(out) >= ROWS:
                        yield packed()
                        out.clear()
                held.append(row)
        if held:
            out.extend(fold(held))
        if out:
            yield packed()

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, kind)
