"""Plan shape of every registered query: no row-at-a-time Python UDF, no cartesian product,
no nested-loop join, and wide tables are never read whole."""

import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
# wide tables: no registered query needs all of their columns
WIDE = {"documents": 5, "lineitem": 11}


def _fields(schema_text: str) -> int:
    """Number of top-level fields in a printed ``struct<...>`` body."""
    depth, n = 0, 1
    for ch in schema_text:
        if ch == "<":
            depth += 1
        elif ch == ">":
            if depth == 0:
                break
            depth -= 1
        elif ch == "," and depth == 0:
            n += 1
    return n


def scans(plan: str):
    for m in re.finditer(r"Location: [^\[\n]*\[file:[^\]]*/(\w+)\.parquet\][^\n]*?ReadSchema: struct<", plan):
        yield m.group(1), _fields(plan[m.end():])


def test_scan_parser_sees_scans(spark):
    plan = E.queries()["control_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert list(scans(plan)) == [("lineitem", 3)]


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_plan_shape(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")  # whole schemas in the printed plan
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for table, n in scans(plan):
        if table in WIDE:
            assert n < WIDE[table], (table, n)


@pytest.mark.parametrize("name,scans_of", [("match_exact", 1), ("match_contains", 9), ("match_rates", 9), ("vector_diff", 9),
                                           ("paired_wc_diff", 0), ("ols_one_control", 0)])
def test_texts_cross_no_shuffle_but_to_their_distinct_values(spark, name, scans_of):
    """Without broadcasts: an exchange of a text is the one on its two hashes, and all of those are the same."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = E.queries()[name](spark, SF)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    for line in plan.split("\n"):
        if "Exchange hashpartitioning" in line:
            assert not re.search(r"hashpartitioning\((?!_r1|_r2)[^)]*\b(text|_raw|n)#", line), line
    assert plan.count("/documents.parquet") <= scans_of
