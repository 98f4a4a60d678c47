"""Driver contract: entry runs, every oracle has a query, representative queries equal their oracles."""

import os
import sys

import pytest

import __spark_entry__ as E

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from oracle_compare import duck, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = ["text_normalize", "word_count", "match_contains", "vector_diff", "lenient_cast", "filter_funnel",
          "label_encode", "variation_assemble", "design_check", "model_suite", "looic", "summary_table",
          "posterior_diff", "centroid_classify", "classification_metrics", "residual_gram", "golden_check",
          "draws_rhat", "ols_general", "holdout_accuracy"]


def test_entry_and_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "estimate" in df.columns
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]) == rows_of(dcols, res.fetchall())
