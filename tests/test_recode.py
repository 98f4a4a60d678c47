"""Recodes and casts: null flags, lenient casts, factors, survey CSV reading."""

import os
import tempfile

from pyspark.sql import functions as F

from textcontrols.functions.recode import (
    factor_level, factor_position, lenient_bool, lenient_double, recode_map, reverse_score,
)
from textcontrols.sources.survey import read_analysis_csv, read_survey_csv


def test_reverse_score_null_flag(spark):
    df = spark.createDataFrame([(1, 6), (0, 6), (None, 6), (0, 4)], "flag int, rating int")
    out = [r[0] for r in df.select(reverse_score("flag", "rating")).collect()]
    assert out == [2.0, -2.0, None, 0.0]


def test_lenient_cast(spark):
    df = spark.createDataFrame([("abc",), (" 5 ",), ("",), ("NA",), ("NaN",)], "x string")
    out = [r[0] for r in df.select(lenient_double("x")).collect()]
    assert out[:4] == [None, 5.0, None, None] and out[4] != out[4]  # NaN


def test_lenient_bool(spark):
    df = spark.createDataFrame([("True",), ("False",), ("yes",), (None,)], "x string")
    assert [r[0] for r in df.select(lenient_bool("x")).collect()] == [True, False, None, None]


def test_lenient_spellings(spark):
    df = spark.createDataFrame([(x,) for x in ("5d", "5f", "1e3", " .5 ", "-Inf", "0x1", "five")], "x string")
    assert [r[0] for r in df.select(lenient_double("x")).collect()] == [None, None, 1000.0, 0.5, float("-inf"), None, None]
    df = spark.createDataFrame([(x,) for x in ("t", "f", "tRuE", " True ", "T", "FALSE")], "x string")
    assert [r[0] for r in df.select(lenient_bool("x")).collect()] == [None, None, None, None, True, False]


def test_factor_outside_levels_kept(spark):
    df = spark.createDataFrame([("BaseFT",), ("MidFT",), ("LongFT",)], "c string")
    out = df.select(factor_level("c", ["BaseFT", "ShortFT", "LongFT"]).alias("f"),
                    factor_position("c", ["BaseFT", "ShortFT", "LongFT"]).alias("p")).collect()
    assert [(r.f, r.p) for r in out] == [("BaseFT", 1), (None, None), ("LongFT", 3)]


def test_recode_map_unmapped_null(spark):
    df = spark.createDataFrame([("organic",), ("unknown",)], "t string")
    out = [r[0] for r in df.select(recode_map("t", {"organic": "certified"})).collect()]
    assert out == ["certified", None]


def test_survey_csv_metadata_rows(spark):
    d = tempfile.mkdtemp(prefix="tc-csv-")
    path = os.path.join(d, "survey.csv")
    with open(path, "w") as f:
        f.write("StartDate,Q_TerminateFlag,Text_Base\n")
        f.write('Start Date,"Terminate ""flag""\nsecond line",Base text\n')
        f.write('"{""ImportId"":""startDate""}","{""ImportId"":""QID1""}",x\n')
        f.write("2025-01-01 10:00:00,Complete,a\n2025-01-01 11:00:00,NA,b\n2025-01-02 09:00:00,Complete,c\n")
    rows = read_survey_csv(spark, path).orderBy("StartDate").collect()
    assert [r.Text_Base for r in rows] == ["a", "b", "c"]
    assert rows[1].Q_TerminateFlag is None  # pandas null token


def test_analysis_csv_na_only(spark):
    d = tempfile.mkdtemp(prefix="tc-csv-")
    path = os.path.join(d, "a.csv")
    with open(path, "w") as f:
        f.write("a,b\nNA,\nx,y\n")
    rows = read_analysis_csv(spark, path).collect()
    assert rows[0].a is None and rows[0].b == ""


def test_label_encode_distributed_rank(spark):
    from textcontrols.operators.describe import label_encode
    rows = [(f"v{i:05d}", "x" if i % 3 else "y") for i in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string")
    out = {(r.attribute, r.level): r.code for r in label_encode(df, ["a", "b"]).collect()}
    assert out[("a", "v00000")] == 0 and out[("a", "v02999")] == 2999 and out[("b", "x")] == 0 and out[("b", "y")] == 1
    codes = sorted(v for (a, _), v in out.items() if a == "a")
    assert codes == list(range(3000))
