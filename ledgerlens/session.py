"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Exact decimals need full scale; everything else is AQE and a fixed zone.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.decimalOperations.allowPrecisionLoss": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS; master and extra settings are for tests and benchmarks."""
    builder = SparkSession.builder.appName("ledgerlens").config(map=SETTINGS | extra)
    return (builder.master(master) if master else builder).getOrCreate()
