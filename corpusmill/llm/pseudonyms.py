"""PII: format-preserving Feistel pseudonyms.

Personal numbers are found by pattern, **validated** (check digits, octet and
calendar ranges), and replaced by a keyed permutation *within their own format*:
a card number stays a card number with a right check digit and the same
grouping, a date a real date, an address an address.  The permutation is a
balanced Feistel network over the domain's numbers (HMAC-SHA256 rounds), cycle
walked until the value falls inside the domain; so it is a bijection for a key,
equal values stay linked across documents, and different values never merge.

The value's class (its separators, letter case, length) picks the domain; the
digits are ranked, permuted and written back into the same places.

Kinds: ``card`` (13 to 19 digits, Luhn), ``iban`` (mod 97), ``ssn``, ``phone``, ``ipv4``,
``date`` (ISO, day.month.year, month/day/year, years 1900-2099), ``email`` (letters and digits of the
local part are permuted, the domain stays), ``secret`` (hex strings of 32 and more characters, of 12 and
more behind an equals sign or colon, and access key ids).

Decimal digits of any script count: a card number, ssn, phone, ipv4 or date in full-width,
Arabic-Indic or other digits is found by its value and written back in the script
of its digits (of its first digit, where scripts are mixed and the width changes), so
equal values stay linked across scripts.  IBANs, e-mails and secrets are ASCII.

One narrow pass; no shuffle.  Candidates come from one scan per kind and texts
without a digit or "@" skip all of them.

Defined cases: null stays null; an invalid number (Luhn, octet over 255, 30
February) is no personal data and stays; overlapping candidates: the leftmost,
then the longest, then the kind earlier in this list; repeated rows give equal
results; an empty table an empty one.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

KINDS = ("card", "iban", "ssn", "phone", "ipv4", "date", "email", "secret")
ROUNDS = 8

# The formats looked for.
PATTERNS = {
    "card": re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ -])\d{6}\2\d{4,5})(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "phone": re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?!\w)"),
    "ipv4": re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"),
    "date": re.compile(r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w/-])"),
    "email": re.compile(r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?!\w)"),
    "secret": re.compile(r"(?:(?<![\w-])[0-9a-fA-F]{32,64}|(?:(?<=[=:])|(?<=[=:][\"' ])|(?<=[=:] [\"']))[0-9a-fA-F]{12,31}"
                         r"|(?<!\w)A[KS]IA[A-Z0-9]{16})(?![\w-])"),
}
_MAYBE = re.compile(r"[\d@]")
_OTHER_DIGIT = re.compile(r"[^\D0-9]")
_ANY_SCRIPT = {"card", "ssn", "phone", "ipv4", "date"}
_FIRST_DAY, _DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Permutation:
    """Keyed bijection of range(size), for any size, per tweak."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, no: int, value: int, bits: int) -> int:
        need = (bits + 7) // 8
        out, block = b"", 0
        message = tweak + bytes([no]) + value.to_bytes(need, "big")
        while len(out) < need:
            out += hmac.digest(self.key, bytes([block]) + message, "sha256")
            block += 1
        return int.from_bytes(out[:need], "big") & ((1 << bits) - 1)

    def __call__(self, value: int, size: int, tweak: str, back: bool = False) -> int:
        """The image of value (or, with ``back``, its origin); both lie in range(size)."""
        if size < 2:
            return value
        half = ((size - 1).bit_length() + 1) // 2
        mark = tweak.encode() + size.to_bytes((size.bit_length() + 7) // 8, "big")
        mask = (1 << half) - 1
        while True:  # cycle walking: the domain is at least a quarter of the network's
            left, right = value >> half, value & mask
            for no in (reversed(range(ROUNDS)) if back else range(ROUNDS)):
                if back:
                    left, right = right ^ self._round(mark, no, left, half), left
                else:
                    left, right = right, left ^ self._round(mark, no, right, half)
            value = left << half | right
            if value < size:
                return value


def luhn(digits: str) -> int:
    """Sum that is divisible by ten for a valid number."""
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2)
               for i, c in enumerate(reversed(digits)))


def _put(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if "0" <= c <= "9" else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _card(p: Permutation, s: str, back: bool) -> str | None:
    d = _digits(s)
    if luhn(d) % 10 or len(set(d)) == 1:
        return None
    n = len(d) - 1
    while True:  # one repeated digit is no card number: walk on
        body = str(p(int(d[:-1]), 10 ** n, "card", back)).zfill(n)
        d = body + str(-luhn(body + "0") % 10)
        if len(set(d)) > 1:
            return _put(s, d)


def _iban_check(country: str, rest: str) -> int:
    return int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _iban(p: Permutation, s: str, back: bool) -> str | None:
    flat = s.replace(" ", "")
    if not 15 <= len(flat) <= 34 or 98 - _iban_check(flat[:2], flat[4:]) != int(flat[2:4]):
        return None
    rest = _mixed(p, flat[4:], "iban" + flat[:2], back)
    new = iter(f"{flat[:2]}{98 - _iban_check(flat[:2], rest):02d}{rest}")
    return "".join(" " if c == " " else next(new) for c in s)


def _mixed(p: Permutation, s: str, tweak: str, back: bool) -> str:
    """Letters and digits permuted within their own alphabet, other characters kept in place."""
    sizes = [10 if c.isdigit() else 26 if c in _LOWER or c in _UPPER else 1 for c in s]
    value, total = 0, 1
    for c, n in zip(s, sizes):
        if n > 1:
            value = value * n + (int(c) if n == 10 else (_LOWER + _UPPER).index(c) % 26)
            total *= n
    shape = "".join("9" if n == 10 else "a" if c in _LOWER else "A" if n == 26 else c for c, n in zip(s, sizes))
    value, out = p(value, total, tweak + shape, back), []
    for c, n in zip(reversed(s), reversed(sizes)):
        if n == 1:
            out.append(c)
        else:
            value, at = divmod(value, n)
            out.append(str(at) if n == 10 else (_LOWER if c in _LOWER else _UPPER)[at])
    return "".join(reversed(out))


def _ssn(p: Permutation, s: str, back: bool) -> str | None:
    area, group, serial = map(int, s.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rank = p(rank, 898 * 99 * 9999, "ssn", back)
    rank, serial = divmod(rank, 9999)
    area, group = divmod(rank, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(p: Permutation, s: str, back: bool) -> str | None:
    # the country code stays; the rest is permuted as one number of that many digits
    head = re.match(r"\+\d{1,3}(?=\D)|", s).group()
    rest = s[len(head):]
    d = _digits(rest)
    if not 7 <= len(d) <= 14 or len(set(d)) == 1:
        return None
    while True:
        d = str(p(int(d), 10 ** len(d), "phone" + head, back)).zfill(len(d))
        if len(set(d)) > 1:
            return head + _put(rest, d)


def _ipv4(p: Permutation, s: str, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    value = 0
    for x in parts:
        value = value << 8 | int(x)
    value = p(value, 1 << 32, "ipv4", back)
    return ".".join(str(value >> shift & 255) for shift in (24, 16, 8, 0))


def _date(p: Permutation, s: str, back: bool) -> str | None:
    if "-" in s:
        order, wide = "ymd", True
    elif "." in s:
        order, wide = "dmy", None
    else:
        order, wide = "mdy", None
    parts = dict(zip(order, map(int, re.split(r"[./-]", s))))
    try:
        day = dt.date(parts["y"], parts["m"], parts["d"]).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    new = dt.date.fromordinal(p(day, _DAYS, "date", back) + _FIRST_DAY)
    sep = "-" if wide else "." if "." in s else "/"
    # a date without leading zeros is written without them
    padded = wide or not any(len(x) == 1 for x in s.split(sep))
    return sep.join(f"{new.year:04d}" if c == "y" else f"{(new.month if c == 'm' else new.day):{'02d' if padded else 'd'}}"
                    for c in order)


def _email(p: Permutation, s: str, back: bool) -> str | None:
    local, domain = s.rsplit("@", 1)
    return f"{_mixed(p, local, 'email' + domain.lower(), back)}@{domain}"


def _secret(p: Permutation, s: str, back: bool) -> str | None:
    if len(s) == 20 and s[:4] in ("AKIA", "ASIA"):
        return s[:4] + _mixed(p, s[4:], "access key", back)
    low = s.lower()
    if s not in (low, s.upper()) or s.isdigit() or s.isalpha():
        return None
    value = f"{p(int(low, 16), 16 ** len(s), 'secret', back):0{len(s)}x}"
    return value if s == low else value.upper()


_MAKERS = {"card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "ipv4": _ipv4, "date": _date, "email": _email,
           "secret": _secret}


def _zero(c: str) -> str:
    """The zero of a digit's script; a script's ten digits are neighbours in Unicode."""
    return chr(ord(c) - unicodedata.decimal(c))


def _in_script(shape: str, new: str) -> str:
    """``new``, which has ASCII digits, in the digits of ``shape``."""
    zeros = [_zero(c) for c in shape if c.isdecimal()]
    places = iter(zeros if len(new) == len(shape) else zeros[:1] * len(new))
    return "".join(chr(ord(next(places)) + int(c)) if "0" <= c <= "9" else c for c in new)


def replace_all(text: str, p: Permutation, known=None, back: bool = False) -> tuple[str, dict[str, int], list]:
    """(text with pseudonyms, count by kind, spans [(start, end, kind)] in the given text)."""
    if not _MAYBE.search(text):
        return text, {}, []
    make = known or (lambda kind, s: _MAKERS[kind](p, s, back))
    found = []
    # one character for one, so places in the folded text are places in the text
    folded = text if text.isascii() else _OTHER_DIGIT.sub(lambda m: str(unicodedata.decimal(m.group())), text)
    for no, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text:
            continue
        for m in PATTERNS[kind].finditer(folded if kind in _ANY_SCRIPT else text):
            new = make(kind, m.group())
            if new is not None:
                shape = text[m.start():m.end()]
                if shape != m.group():
                    new = _in_script(shape, new)
                found.append((m.start(), -m.end(), no, kind, new))
    found.sort()
    out, at, counts, spans = [], 0, {}, []
    for start, end, _, kind, new in found:
        if start >= at:
            out += [text[at:start], new]
            at = -end
            counts[kind] = counts.get(kind, 0) + 1
            spans.append((start, at, kind))
    return "".join(out) + text[at:], counts, spans


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", prefix: str = "_cm_") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``; adds (behind ``prefix``) found array<struct<start, end, kind>>."""
    secret = hashlib.sha256(key.encode()).digest()

    @F.pandas_udf("struct<text: string, found: array<struct<start: int, end: int, kind: string>>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        p = Permutation(secret)
        known = lru_cache(maxsize=50_000)(lambda kind, s: _MAKERS[kind](p, s, False))
        rows = []
        for t in texts:
            if t is None:
                rows.append((None, []))
            else:
                new, _, spans = replace_all(t, p, known)
                rows.append((new, [{"start": a, "end": b, "kind": k} for a, b, k in spans]))
        return pd.DataFrame(rows, columns=["text", "found"])

    done = docs.withColumn("_cm_done", run(F.col(f"`{text_col}`")))
    keep = [F.col("_cm_done.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return done.select(*keep, F.col("_cm_done.found").alias(prefix + "found"))


def query(spark, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_found, one count a kind): every document with its pseudonyms."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = pseudonymise(docs, "corpus key 1")
    kinds = F.col("_cm_found.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return done.select("doc_id", "text", F.size("_cm_found").cast("long").alias("n_found"), *counts)
