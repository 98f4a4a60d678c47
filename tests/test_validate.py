"""Validation: golden check fails on missing, key coverage, null guard."""

import pytest

from textcontrols.operators import validate as V


def test_golden_missing_fails(spark):
    golden = spark.createDataFrame([("F", "wc", "Intercept", 0.796, 0.12)],
                                   "experiment string, model string, parameter string, gt_est double, gt_se double")
    actual = spark.createDataFrame([], "experiment string, model string, parameter string, estimate double, est_error double")
    chk = V.golden_check(golden, actual, ["experiment", "model", "parameter"])
    assert chk.collect()[0]["status"] == "MISSING"
    s = V.golden_summary(chk).collect()[0]
    assert s.n_missing == 1 and s.all_ok is False


def test_golden_tolerance(spark):
    golden = spark.createDataFrame([("F", "m", "b", 0.796, 0.120)],
                                   "experiment string, model string, parameter string, gt_est double, gt_se double")
    actual = spark.createDataFrame([("F", "m", "b", 0.79649, 0.1204)],
                                   "experiment string, model string, parameter string, estimate double, est_error double")
    assert V.golden_check(golden, actual, ["experiment", "model", "parameter"]).collect()[0]["status"] == "MATCH"


def test_null_guard_raises(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "INTN1 double")
    with pytest.raises(ValueError):
        V.assert_no_missing(df, ["INTN1"])
