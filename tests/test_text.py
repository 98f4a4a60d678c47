from pyspark.sql import functions as F

from textcontrols.functions.text import normalize_text, word_count


def _one(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_word_count_blanks(spark):
    vals = [" a b c\n", "", None, " x ", "  "]
    assert _one(spark, vals, word_count) == [3, 0, 0, 1, 0]


def test_word_count_control_chars(spark):
    vals = ["a\u001cb", "a　b", "a​b"]
    assert _one(spark, vals, word_count) == [2, 2, 1]


def test_word_count_equals_python_split(spark):
    vals = ["one two\tthree", "\x1c lead", "tail \x1f", "a\x0bb\x0cc", " x y\u0085z"]
    assert _one(spark, vals, word_count) == [len(v.split()) for v in vals]


def test_normalize_keeps_trailing_blank_after_symbol(spark):
    assert _one(spark, [" DELTA ®"], normalize_text) == ["delta "]


def test_normalize_damaged_apostrophe_order(spark):
    # the trade-mark sign is deleted first, so the damaged form loses only its tail
    assert _one(spark, ["teaâ€™s"], normalize_text) == ["teaâ€s"]


def test_normalize_null_and_strip(spark):
    vals = [None, "\x1c Mixed Case \t", "Certified™ Product"]
    assert _one(spark, vals, normalize_text) == ["", "mixed case", "certified product"]


def test_normalize_sequential_deletion_creates_match(spark):
    # deleting the registered sign joins the pieces of a later pattern
    assert _one(spark, ["xâ®„¢y"], normalize_text) == ["xy"]


def test_lowercase_matches_python(spark):
    vals = ["İstanbul", "ΟΔΟΣ", "Straße", "ÀÉÎÕÜ"]
    assert _one(spark, vals, normalize_text) == [v.strip().lower() for v in vals]
