import __spark_entry__


def test_entry_and_names(spark):
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 40
    assert __spark_entry__.entry(spark).limit(5).count() == 5


def test_arithmetic_plan_is_native(spark):
    from ledgerlens.plans import catalogue

    plan = catalogue.QUERIES["arith_rows"](spark, __spark_entry__.SF_SMOKE)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "ReadSchema: struct<l_orderkey" in plan
