"""Exact decimals: parsing, products without lost digits, and their text form."""

from __future__ import annotations

import decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Significant digits of the context in which products are rounded.
DIGITS = 28
NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$"
# Fixed value: numbers as documents write them: groups of three by space or no-break space, comma or dot.
WRITTEN = r"^[+-]?(?:(?:[0-9]{1,3}(?:[  ][0-9]{3})+)|[0-9]+)(?:[.,][0-9]+)?$"


def cleaned(text: Column) -> Column:
    """A number's text without spaces, a dot for the comma; null where it is no finite number."""
    plain = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    plain = F.regexp_replace(plain, r"^[\t\n\r\f\x0B]+|[\t\n\r\f\x0B]+$", "")
    return F.when(plain.rlike(NUMBER), F.replace(plain, F.lit("_"), F.lit("")))


def parse(text: Column, precision: int = 38, scale: int = 18) -> Column:
    """The number as a decimal; null where it isn't one or has more digits than fit exactly."""
    clean = cleaned(text)
    fraction = F.length(F.regexp_extract(clean, r"^[^.eE]*\.([0-9]*)", 1))
    power = F.coalesce(F.regexp_extract(clean, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    return F.when(fraction - power <= scale, clean.try_cast(f"decimal({precision},{scale})"))


def written(text: Column) -> Column:
    return F.coalesce(text.rlike(WRITTEN), F.lit(False))


def _context() -> decimal.Context:
    return decimal.Context(prec=DIGITS, rounding=decimal.ROUND_HALF_EVEN)


def product_text(declared: Column, operands: Column) -> Column:
    """Product of operand texts in the context, its difference to the declared text, plain notation with scale kept."""

    @F.pandas_udf("expected string, difference string, equal boolean")
    def run(declared: pd.Series, operands: pd.Series) -> pd.DataFrame:
        out, ctx = [], _context()
        for d, ops in zip(declared, operands, strict=True):
            if d is None or ops is None or any(o is None for o in ops):
                out.append((None, None, None))
                continue
            value = decimal.Decimal(1)
            for o in ops:
                value = ctx.multiply(value, decimal.Decimal(o))
            stated = decimal.Decimal(d)
            out.append((format(value, "f"), format(ctx.subtract(stated, value), "f"), stated == value))
        return pd.DataFrame(out, columns=["expected", "difference", "equal"])

    return run(declared, operands)


def narrow(rows: DataFrame, fields: list[str]) -> bool:
    """Whether any product of these columns is exact: all are decimals of DIGITS digits together at most."""
    kinds = [rows.schema[f].dataType for f in fields]
    return all(isinstance(k, T.DecimalType) for k in kinds) and sum(k.precision for k in kinds) <= DIGITS


def product(factors: list[Column]) -> Column:
    """A product by native decimal arithmetic; needs allowPrecisionLoss=false and narrow operands."""
    return reduce(lambda a, b: a * b, factors)
