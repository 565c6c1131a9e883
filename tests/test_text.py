"""Text functions on hard cases."""

import pytest
from pyspark.sql import functions as F

from loomlog.functions import text as T


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr().alias("x")).first()[0]


@pytest.mark.parametrize(
    "expr,value,exp",
    [
        (lambda: T.fold(F.col("v")), "ÀBcÉ", "ÀbcÉ"),
        (lambda: T.strip(F.col("v")), "\u3000 a b\n\u00a0", "a b"),
        (lambda: T.tail(F.col("v"), 3), " ab\n\tcde ", "…cde"),
        (lambda: T.middle(F.col("v"), 6), "0123456789", "0123 … 89"),
        (lambda: T.clip_middle(F.col("v"), 6), "0123456789", "0123 … [4 characters left out] … 89"),
        (lambda: T.clip_head(F.col("v"), 4), "0123456789", "0123 … [6 more characters]"),
        (lambda: T.truncate(F.col("v"), 0), "0123456789", "0123456789"),
        (lambda: T.one_line(F.col("v")), " a\t b \n\n c\x1b[31m red\x1b[0m ", "a b / c red"),
        (lambda: T.normalize(F.col("v")), "Ａ b\u3000Ｃ", "abc"),
        (lambda: T.project_from_cwd(F.col("v")), "C:\\Users\\x\\repo\\", "x/repo"),
        (lambda: T.project_from_cwd(F.col("v")), "file:///home/a%20b/c+d", "a b/c+d"),
        (lambda: T.project_from_cwd(F.col("v")), "/", ""),
        (lambda: F.array_join(T.hex_names(F.col("v")), ","), "see deadbee and DEADBEE 1234567 abc-deadbeef deadbee feedface0", "deadbee,DEADBEE,feedface0"),
        (lambda: F.array_join(T.pieces(F.col("v"), 4, 1, 5), ","), "0123456789", "0,3,6"),
        (lambda: T.snippet(F.col("v"), F.lit("X"), 2, True), "abxcd é", "abxcd"),
        (lambda: T.clip_middle(F.col("v"), 6), None, None),
        (lambda: T.one_line(F.col("v")), "", ""),
    ],
)
def test_columns(spark, expr, value, exp):
    assert one(spark, expr, value) == exp


def test_page_functions():
    assert T.byte_snippet("ああabcああ", 6, 3, 2) == "あabcあ"
    assert T.values_head(["a", "b"]) == ("a\nb", False) and T.values_head([" ", "\n"]) == (None, False) and T.values_head(["あ" * 100], 7) == ("ああ", True)
    assert T.spacing_variants("CSV取り込み") == ["CSV 取り込み"] and T.spacing_variants("CSV 取り込み") == ["CSV取り込み"] and T.spacing_variants("plain") == []
    assert T.window("x" * 50 + "needle" + "y" * 50, ["NEEDLE"], 40).count("needle") == 1
    assert T.quote_found("the Cat … on a / mat", "The cat sat\non a\nmat.") and not T.quote_found("mat … cat", "cat mat") and not T.quote_found("", "x")
    assert T.distinct_terms(["A", " a ", "", "b"]) == ["A", "b"]
