"""Text predicates and string functions as Catalyst expressions.

Every function takes a Column (or a column name) and returns a Column, so a
whole cleansing rule set compiles into one projection inside whole-stage
codegen.  Only NFKC needs Python (no JVM built-in); it runs as an Arrow
``pandas_udf`` and only for rows holding a character NFKC could change (an
exact quick-check guard evaluated in the JVM).
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the reference's behaviour, so they are stated
# here as plain text.  Python's ``\w`` is written as ``[\p{L}\p{N}_]`` so the
# same pattern means the same thing in Java regex and in RE2 (DuckDB).
# ---------------------------------------------------------------------------
# Python str.isspace() / str.split() whitespace, as one character class.
WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# time of day "digits:digits"
TIME_REGEX = r"\p{Nd}+:\p{Nd}+"
# e-mail: local part, "@", domain, ".", letters
EMAIL_REGEX = r"[\p{L}\p{N}_\-._]+@[\p{L}\p{N}_\-._]+\.[A-Za-z]+"
# http(s) URL followed by at least one URL character
HTTP_URL_REGEX = r"https?://[\p{L}\p{N}_!?/+\-_~;.,*&@#$%()\[\]]+"
# data URL: data:<mediatype>?(;(base64)?)?,<payload>
DATA_URL_REGEX = r"data:(?:[\p{L}\p{N}_/+.-]+)?(?:;(?:base64)?)?,(?:[\p{L}\p{N}_+/=]+)"
URL_REGEX = r"(?:" + HTTP_URL_REGEX + "|" + DATA_URL_REGEX + ")"
# word tokens for lexical retrieval (letters and digits, lower-cased first)
WORD_REGEX = r"[\p{L}\p{N}]+"
NUMERIC_REGEX = r"\A[0-9]+\z"
NON_ASCII_REGEX = r"[^\x00-\x7F]"


# Derived by rule (not fixed lists): the characters Python's str.isspace()
# accepts, and the characters that can make a string differ from its NFKC
# form — not NFKC-stable on their own, non-zero combining class, the second
# character of a canonical pair, or a Hangul medial/final jamo.  A string
# without any of the latter is already NFKC (the Unicode quick-check rule).
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


@lru_cache(maxsize=None)
def nfkc_unstable_chars() -> str:
    cps = set()
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if unicodedata.combining(ch) or not unicodedata.is_normalized("NFKC", ch):
            cps.add(cp)
        dec = unicodedata.decomposition(ch)
        if dec and not dec.startswith("<"):
            parts = dec.split()
            if len(parts) == 2:
                cps.add(int(parts[1], 16))
    cps.update(range(0x1161, 0x1176))   # Hangul V jamo (VBase, VCount 21)
    cps.update(range(0x11A8, 0x11C3))   # Hangul T jamo (TBase + 1, TCount 28)
    return "".join(chr(c) for c in sorted(cps))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- regex builders (driver-side string helpers) ----------------------------

def unmatched_group(regex: str) -> str:
    """Wrap a pattern in a non-capturing group."""
    return "(?:" + regex + ")"


def concat_patterns(regexes, without_grouping: bool = False) -> str:
    """Alternation of patterns, grouped unless ``without_grouping``."""
    joined = "|".join(regexes)
    return joined if without_grouping else unmatched_group(joined)


def is_match_pattern(c, pattern: str) -> Column:
    """True when ``pattern`` is found anywhere in the text (search semantics)."""
    return _c(c).rlike(pattern)


# --- string functions -------------------------------------------------------

def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace (no regex scan)."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def collapse_whitespace(c) -> Column:
    """``' '.join(text.split())``: strip and collapse whitespace runs."""
    return py_strip(F.regexp_replace(_c(c), WS + "+", " "))


@F.pandas_udf(T.StringType())
def _nfkc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def may_change_under_nfkc(c) -> Column:
    """True when the text holds a character that NFKC could change (exact guard)."""
    col = _c(c)
    return F.length(F.translate(col, nfkc_unstable_chars(), "")) != F.length(col)


def nfkc(c) -> Column:
    """Unicode NFKC; rows that are already NFKC skip the Python round trip."""
    col = _c(c)
    return F.when(may_change_under_nfkc(col), _nfkc_udf(col)).otherwise(col)


def clean_text(c) -> Column:
    """NFKC then whitespace collapse (the normalisation step)."""
    return collapse_whitespace(nfkc(c))


def newline_to_space(c) -> Column:
    return F.translate(_c(c), "\n", " ")


def words(c) -> Column:
    """Lower-cased word tokens, in text order."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(WORD_REGEX), 0)


def explode_items(df, keep: list, arr, name: str, pos: str | None = None):
    """Explode an array that is costly to compute (regex tokens, characters).

    The array is projected once before the generator, and the ``_outer`` form
    is used so Spark does not infer a ``size(array) > 0`` filter that would
    evaluate the array a second time below the exchange.
    """
    base = df.select(*keep, arr.alias("_cm_arr"))
    gen = F.posexplode_outer("_cm_arr").alias(pos, name) if pos else F.explode_outer("_cm_arr").alias(name)
    return base.select(*keep, gen).where(F.col(name).isNotNull())


def chars(c) -> Column:
    """Characters of a text (code points), in order."""
    return F.filter(F.split(_c(c), ""), lambda x: x != "")


# --- predicates -------------------------------------------------------------

def is_blank(c) -> Column:
    return py_strip(c) == ""


def is_only_numeric(c, dtype: T.DataType | None = None) -> Column:
    """Numeric-typed values are numeric; strings: ASCII digits once dots are removed."""
    if dtype is not None and isinstance(dtype, T.NumericType):
        return F.lit(True)
    return F.replace(_c(c), F.lit("."), F.lit("")).rlike(NUMERIC_REGEX)


def is_out_of_length_range(c, min_str_len: int = 0, max_str_len: int | None = None) -> Column:
    n = F.char_length(_c(c))
    out = n < F.lit(min_str_len)
    if max_str_len is not None:
        out = out | (n > F.lit(max_str_len))
    return out


def is_include_url(c) -> Column:
    # literal prefilter (every match holds "://" or "data:") short-circuits the regex
    col = _c(c)
    return (col.contains("://") | col.contains("data:")) & col.rlike(URL_REGEX)


def is_include_email(c) -> Column:
    col = _c(c)
    return col.contains("@") & col.rlike(EMAIL_REGEX)


def time_count(c, pattern: str = TIME_REGEX) -> Column:
    return F.regexp_count(_c(c), F.lit(pattern))


def include_time_schedule(c, threshold: int = 3, pattern: str = TIME_REGEX) -> Column:
    if pattern == TIME_REGEX and threshold > 0:
        return _c(c).contains(":") & (time_count(c, pattern) >= F.lit(threshold))
    return time_count(c, pattern) >= F.lit(threshold)


def cleanse_text(c, do_rm_time_schedule: bool = True, rm_time_schedule_threshold: int = 3,
                 do_rm_only_numeric: bool = True, do_rm_include_url_text: bool = True,
                 do_rm_include_email_text: bool = True) -> Column:
    """Stripped text, or null when blank or when a switched-on rule fires."""
    stripped = py_strip(c)
    bad = stripped == ""
    if do_rm_only_numeric:
        bad = bad | is_only_numeric(stripped)
    if do_rm_time_schedule:
        bad = bad | include_time_schedule(stripped, rm_time_schedule_threshold)
    if do_rm_include_url_text:
        bad = bad | is_include_url(stripped)
    if do_rm_include_email_text:
        bad = bad | is_include_email(stripped)
    return F.when(bad, F.lit(None).cast("string")).otherwise(stripped)
