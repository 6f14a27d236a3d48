"""DuckDB SQL spellings of the text expressions, for the oracle strings.

They use the same pattern constants as the Catalyst expressions, so a change
of a pattern changes both sides.
"""

from __future__ import annotations

from ..functions.text import EMAIL_REGEX, NUMERIC_REGEX, TIME_REGEX, URL_REGEX, WORD_REGEX, WS


def q(s: str) -> str:
    """SQL string literal (standard SQL: only quotes are escaped)."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(chr(92) + 'A' + WS + '+|' + WS + '+' + chr(92) + 'z')}, '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, {q(WS + '+')}, ' ', 'g')")


def only_numeric(x: str) -> str:
    return f"regexp_matches(replace({x}, '.', ''), {q(NUMERIC_REGEX)})"


def time_count(x: str) -> str:
    return f"len(regexp_extract_all({x}, {q(TIME_REGEX)}))"


def has_url(x: str) -> str:
    return f"regexp_matches({x}, {q(URL_REGEX)})"


def has_email(x: str) -> str:
    return f"regexp_matches({x}, {q(EMAIL_REGEX)})"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(WORD_REGEX)})"


def cleanse(x: str, time_threshold: int = 3) -> str:
    s = strip(x)
    bad = f"({s} = '' OR {only_numeric(s)} OR {time_count(s)} >= {time_threshold} OR {has_url(s)} OR {has_email(s)})"
    return f"CASE WHEN {bad} THEN NULL ELSE {s} END"


def shuffle_key(seed: int, id_expr: str) -> str:
    return f"md5('{seed}:' || CAST({id_expr} AS VARCHAR))"


def char_set(x: str) -> str:
    """Sorted distinct characters joined: DuckDB spelling of char_set_key."""
    return f"array_to_string(list_sort(list_distinct(list_filter(string_split({x}, ''), lambda c: c <> ''))), '')"
