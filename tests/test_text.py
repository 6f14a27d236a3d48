"""Literal cases of the text predicates and normalisation (FIXTURES A and D)."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as tx


def _eval(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_is_blank(spark):
    assert _eval(spark, ["Hello, World!", "   ", "\t\n", ""], tx.is_blank) == [False, True, True, True]


def test_is_only_numeric(spark):
    vals = ["123456", "abc123", "123abc", "", "1.2.3", "...", "-1", "１２"]
    assert _eval(spark, vals, tx.is_only_numeric) == [True, False, False, False, True, False, False, False]


def test_is_only_numeric_numeric_type(spark):
    df = spark.createDataFrame([(1.5,)], "x double")
    assert df.select(tx.is_only_numeric("x", df.schema["x"].dataType)).first()[0] is True


@pytest.mark.parametrize("text,lo,hi,expected", [("Hello", 1, 10, False), ("Hello", 6, 10, True),
                                                  ("Hello", 1, 4, True), ("", 1, 10, True)])
def test_is_out_of_length_range(spark, text, lo, hi, expected):
    assert _eval(spark, [text], lambda c: tx.is_out_of_length_range(c, lo, hi)) == [expected]


def test_is_include_url(spark):
    vals = ["http://example.com", "https://example.com", "not_a_url", "", "data:image/png;base64,AAAA"]
    assert _eval(spark, vals, tx.is_include_url) == [True, True, False, False, True]


def test_is_include_email(spark):
    vals = ["hoge@example.com", "test@domain.com", "invalid-email", ""]
    assert _eval(spark, vals, tx.is_include_email) == [True, True, False, False]


def test_time_schedule(spark):
    vals = ["9:00 10:00 11:00", "10:20:30"]
    assert _eval(spark, vals, lambda c: tx.include_time_schedule(c, 3)) == [True, False]
    assert _eval(spark, vals, tx.time_count) == [3, 1]


def test_normalisation_literals(spark):
    vals = ["Hello, World!", "  Hello   World!  ", "\tHello\nWorld!\t", "Unicode: ñ, ü, é",
            "Special chars: @#$%^&*()", "", "   "]
    expected = ["Hello, World!", "Hello World!", "Hello World!", "Unicode: ñ, ü, é",
                "Special chars: @#$%^&*()", "", ""]
    assert _eval(spark, vals, tx.clean_text) == expected


def test_nfkc_and_strip_agree_with_python(spark):
    vals = ["ﬁ", "ｶﾞ", "①", "é", "　x　", "\x1c\x1dy\x85", "𝔸", "plain ascii", None]
    got = _eval(spark, vals, tx.nfkc)
    assert got == [None if v is None else unicodedata.normalize("NFKC", v) for v in vals]
    got = _eval(spark, vals, tx.py_strip)
    assert got == [None if v is None else v.strip() for v in vals]
    got = _eval(spark, vals, tx.collapse_whitespace)
    assert got == [None if v is None else " ".join(v.split()) for v in vals]


def test_whitespace_rule_matches_python():
    assert set(tx.WS_CHARS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_cleanse_text(spark):
    vals = ["  keep me  ", "   ", "123", "mail a@b.com", "see http://x.y", "1:00 2:00 3:00", None]
    assert _eval(spark, vals, tx.cleanse_text) == ["keep me", None, None, None, None, None, None]
    keep_urls = _eval(spark, vals, lambda c: tx.cleanse_text(c, do_rm_include_url_text=False))
    assert keep_urls[4] == "see http://x.y"


def test_regex_builders(spark):
    assert tx.unmatched_group("a|b") == "(?:a|b)"
    assert tx.unmatched_group("") == "(?:)"
    assert tx.concat_patterns(["a", "b"]) == "(?:a|b)"
    assert tx.concat_patterns(["a", "b"], True) == "a|b"
    assert tx.concat_patterns([]) == "(?:)"
    cases = [("abc123", r"\d+", True), ("abcdef", r"\d+", False), ("", ".*", True),
             ("test@example.com", "@", True), ("Hello World", "[a-z]+", True)]
    for text, pat, expected in cases:
        assert _eval(spark, [text], lambda c: tx.is_match_pattern(c, pat)) == [expected]
