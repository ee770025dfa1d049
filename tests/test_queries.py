"""Every query of the engine against its SQL on the smallest tables, as the driver does on larger ones."""

import glob
import os

import duckdb
import pytest

from ledgerlens.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLE[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in want.description], want.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE)


@pytest.mark.parametrize("parts", [2, 3, 8])
@pytest.mark.parametrize("name", ["dup_exact", "dup_semantic", "archive_budget", "table_islands"])
def test_orders_do_not_depend_on_partitions(spark, name, parts):
    """On larger tables, where sampled ranges differ from run to run."""
    larger = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for p in glob.glob(f"{larger}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = catalogue.QUERIES[name](spark, larger)
        want = c.execute(catalogue.ORACLE[name])
        assert table(df.columns, df.collect()) == table([d[0] for d in want.description], want.fetchall())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_page_budget_against_a_loop(spark):
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", F.length("text").alias("size")).orderBy("conv_id", "turn").collect()
    want = {}
    for p in pages:
        n, used, seen = want.get(p.conv_id, (0, 0, 0))
        fits = used + p["size"] <= 1500
        want[p.conv_id] = (n + fits, used + p["size"] * fits, seen + 1)
    got = {r.conv_id: (r.accepted, r.used, r.n) for r in catalogue.QUERIES["page_budget_nonmonotone"](spark, SF).collect()}
    assert got == want


def test_formulas_of_one_kind_are_compiled_once(monkeypatch):
    import decimal

    from ledgerlens.operators import formulas

    real, calls = formulas.scan, []
    monkeypatch.setattr(formulas, "scan", lambda f: calls.append(f) or real(f))
    for i in range(20):
        own = formulas.Evaluator({f"B{n}": decimal.Decimal(n + i) for n in (7, 8, 9)}, {"C91": "=SUM(B7:$B$9)*91"})
        assert own.cell("C91") == (24 + 3 * i) * 91
    assert calls == ["=SUM(B7:$B$9)*91"]
