"""Splittable reading of quoted CSV: the same rows as Spark's whole-file reader, wherever the ranges are cut."""

import csv
import io
import random

import pytest

from textcontrols.sources.csv_ranges import ends_quoted, read_csv_ranges, records

AWKWARD = ('id,"text, with\nline",last\n1,"two\nlines ""quoted"", and\r\na third",x\n2,5" tall,""\n\n3,"","a""\n""b"\n'
           '4,NA,\n"5","\n\n\n",é漢🙂\n6,plain,"ends here"\n7,"x\ny",z')


@pytest.fixture()
def cut(spark):
    """Sets the size of ranges."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def put(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield put
    for n, v in before.items():
        spark.conf.set(n, v)


def whole_file(spark, path, **options):
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    for k, v in options.items():
        r = r.option(k, v)
    return r.csv(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_ranges_cut_anywhere(spark, cut, tmp_path, size):
    """With ranges of one byte the file is cut at every byte."""
    path = tmp_path / "a.csv"
    path.write_bytes(AWKWARD.encode())
    want = whole_file(spark, str(path))
    cut(size)
    got = read_csv_ranges(spark, str(path))
    assert got.columns == want.columns and rows(got) == rows(want) and len(rows(got)) == 7
    plain = read_csv_ranges(spark, str(path), nullValue="\u0000")
    assert rows(plain) == rows(whole_file(spark, str(path), nullValue="\u0000"))


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_many_ranges_of_one_file(spark, cut, tmp_path, ends):
    rng = random.Random(1)
    bits = ["a", ",", '"', "\n", "\r\n", "word ", "é", "\n\n"]
    want = [[str(i), "".join(rng.choice(bits) for _ in range(rng.randint(0, 30))), rng.choice(["", "NA", "x\ny"])] for i in range(3000)]
    for k in range(2):
        with open(tmp_path / f"{k}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator=ends)
            w.writerow(["id", "text", "more"])
            w.writerows(want[k::2])
    cut(2000)
    df = read_csv_ranges(spark, str(tmp_path), nullValue="\u0000")
    assert df.rdd.getNumPartitions() > 8
    assert sorted((r["id"], r["text"] or "", r["more"] or "") for r in df.collect()) == sorted(map(tuple, want))
    n = records(spark, str(tmp_path)).groupBy("file", "start", "nth").count().where("count > 1").count()
    assert n == 0


def test_state_of_lines():
    for line, out, inside in [("", False, True), ("a,b", False, True), ('a,"b', True, False), ('"a""', True, False), ('a"b,c', False, False),
                              ('","', False, True), ('"x",y"z', False, False), ('a"', False, False), ('"",""', False, True)]:
        assert (ends_quoted(line, False), ends_quoted(line, True)) == (out, inside), line
    for text in ['a,"b\nc",d', '"x""\n""y",z', '5" tall,"\n"']:
        state = False
        for line in text.split("\n"):
            state = ends_quoted(line, state)
        assert state is False and len(list(csv.reader(io.StringIO(text)))) == 1


def test_header_names_and_no_rows(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("﻿a,,A,b`c\n1,2,3,4\n", encoding="utf-8")
    df = read_csv_ranges(spark, str(path))
    assert df.columns == ["a0", "_c1", "A2", "b`c"] and rows(df) == [("1", "2", "3", "4")]
    (tmp_path / "e.csv").write_text("a,b\n")
    assert read_csv_ranges(spark, str(tmp_path / "e.csv")).collect() == []
    (tmp_path / "n.csv").write_text("")
    assert read_csv_ranges(spark, str(tmp_path / "n.csv")).columns == []
