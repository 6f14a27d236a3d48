"""MinHash / LSH near-duplicate detection over sets of shingles.

Shingles are the distinct characters of a text by default (the reference's
choice); ``shingle=("char", k)`` or ``("word", k)`` takes k-character pieces or
runs of k words instead.  The plan:

* texts collapse to distinct shingle sets first (``set_key``: the sorted distinct
  characters, or the digest of the sorted distinct shingles), so the expensive
  part scales with distinct sets, not rows;
* permutation hashes are computed once per distinct shingle (``md5('i:shingle')``,
  first 15 hex digits); AQE broadcasts that table when it turns out small and
  joins it by shuffle, splitting hot shingles, when not;
* the signature is ``num_perm`` ``min`` aggregates (partial + final);
* without verification the LSH query "is there an earlier text in one of my
  buckets" is a ``min(first position)`` per bucket joined back: a star join, so a
  bucket holding a third of the corpus costs one aggregate row, not n^2 pairs;
* with ``verify=True`` a set is compared with **every** earlier distinct set of
  its buckets, inside the join: only pairs whose exact Jaccard similarity reaches
  the threshold leave it, and a ``min`` per set reduces these on the map side;
* ``exact_near_duplicate_flags`` has no bands and so no recall to lose: a prefix
  filter over globally ordered shingles, rare ones first, finds every pair.

A row is a near duplicate iff a text with a smaller position shares a band
bucket (and, verified, is similar enough).  The earliest row of every cluster
survives; identical shingle sets always collide.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chars, explode_items, words
from ..session import materialize, ship_package
from .position import input_bytes
from .retrieval import small_enough


def _integrate(f, a: float, b: float, n: int = 200) -> float:
    if b <= a:
        return 0.0
    h = (b - a) / n
    s = f(a) + f(b)
    for k in range(1, n):
        s += (4 if k % 2 else 2) * f(a + k * h)
    return s * h / 3


@lru_cache(maxsize=None)
def optimal_bands(threshold: float, num_perm: int, fp_weight: float = 0.5, fn_weight: float = 0.5):
    """(bands, rows) minimising weighted false-positive + false-negative area."""
    best, best_err = (1, 1), math.inf
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            fp = _integrate(lambda s: 1 - (1 - s ** r) ** b, 0.0, threshold)
            fn = _integrate(lambda s: (1 - s ** r) ** b, threshold, 1.0)
            err = fp * fp_weight + fn * fn_weight
            if err < best_err:
                best, best_err = (b, r), err
    return best


CHARACTERS = ("char", 1)


def char_set_key(c) -> F.Column:
    """Sorted distinct characters joined into one string: equal iff equal sets."""
    return F.concat_ws("", F.array_sort(F.array_distinct(chars(c))))


def shingles(c: F.Column, shingle: tuple[str, int] = CHARACTERS) -> F.Column:
    """Sorted distinct shingles of a text; one that is shorter than a shingle is one itself, an empty one has none."""
    return _runs(_units(c, shingle), shingle)


def _units(c: F.Column, shingle: tuple[str, int]) -> F.Column:
    kind, k = shingle
    if kind not in ("char", "word") or k < 1:
        raise ValueError("a shingle is ('char', k) or ('word', k)")
    return chars(c) if kind == "char" else words(c)


def _runs(units: F.Column, shingle: tuple[str, int]) -> F.Column:
    kind, k = shingle
    glue = "" if kind == "char" else " "
    n = F.size(units)
    runs = F.when(n > k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))),
                                     lambda i: F.array_join(F.slice(units, i, F.lit(k)), glue)))
    whole = F.when(n > 0, F.array(F.array_join(units, glue))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(units if k == 1 else F.coalesce(runs, whole)))


def _keyed_sets(df: DataFrame, col: str, order_col: str, shingle: tuple[str, int]) -> tuple[DataFrame, DataFrame]:
    """(texts(_cm_o, set_key), sets(set_key, set_first, items))."""
    base = df.where(F.col(col).isNotNull())
    if tuple(shingle) == CHARACTERS:
        texts = base.select(F.col(order_col).alias("_cm_o"), char_set_key(F.col(col)).alias("set_key"))
        sets = texts.groupBy("set_key").agg(F.min("_cm_o").alias("set_first"))
        return texts, sets.withColumn("items", chars(F.col("set_key")))
    # the texts' shingles are needed by several branches below: written once
    # and their units projected first: inside the lambda they would be split anew for every run
    units = base.select(F.col(order_col).alias("_cm_o"), _units(F.col(col), shingle).alias("_cm_u"))
    texts = materialize(units.select("_cm_o", _runs(F.col("_cm_u"), shingle).alias("items"))
                        .withColumn("set_key", F.md5(F.concat_ws("\x1f", "items")))
                        .withColumn("_cm_row", F.monotonically_increasing_id()), "shingles")
    # the shingles of a set are those of its first row: they are shuffled once, to the tasks that sign them
    first = F.min(F.struct(F.col("_cm_o").isNull().alias("none"), "_cm_o", "_cm_row")).alias("f")
    firsts = texts.groupBy("set_key").agg(first).select(F.col("f._cm_row").alias("_cm_row"), F.col("f._cm_o").alias("set_first"))
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(texts) // SIGN_BYTES))
    sets = texts.select("_cm_row", "set_key", "items").repartition(n, "_cm_row").join(firsts, "_cm_row").drop("_cm_row")
    return texts.select("_cm_o", "set_key"), sets.select("set_key", "set_first", "items")


def perm_hashes(ch: F.Column, num_perm: int) -> F.Column:
    """array<bigint>[num_perm]: h_i(ch) = first 15 hex digits of md5('i:ch')."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(num_perm - 1)),
        lambda i: F.conv(F.substring(F.md5(F.concat(i.cast("string"), F.lit(":"), ch)), 1, 15), 16, 10)
                   .cast("bigint"))


def set_signatures(sets: DataFrame, num_perm: int = 128) -> DataFrame:
    """(set_key, items) -> (set_key, sig array<bigint>); one row per distinct set that has shingles."""
    members = explode_items(sets, ["set_key"], F.col("items"), "item")
    alphabet = members.select("item").distinct().withColumn("h", perm_hashes(F.col("item"), num_perm))
    hashed = members.join(alphabet, "item")
    return hashed.groupBy("set_key").agg(
        F.array(*[F.min(F.col("h")[i]) for i in range(num_perm)]).alias("sig"))


#: Bytes of written shingle sets that one task gets for signing, and shingles whose digests are computed side by side.
SIGN_BYTES, SIGN_ROWS = 4 << 20, 16384
#: The constants of MD5 (RFC 1321): sines, rotations, the message word of every step, the initial state.
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
_TURNS = [x for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in row * 4]
_WORDS = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_START = tuple(np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))


def _md5_halves(first: np.ndarray, rest: list) -> np.ndarray:
    """First 8 bytes of the MD5 digests of one-block messages, as big-endian numbers.

    ``first`` is word 0 of every message, ``rest`` what each of the 64 steps adds beside it.
    """
    a, b, c, d = (np.full(len(first), x) for x in _START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif i < 32:
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif i < 48:
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        np.add(f, a, f)
        np.add(f, rest[i], f)
        if _WORDS[i] == 0:
            np.add(f, first, f)
        np.left_shift(f, _TURNS[i], t)
        np.right_shift(f, 32 - _TURNS[i], f)
        np.bitwise_or(f, t, f)
        np.add(f, b, f)
        a, b, c, d, f = d, f, b, c, a
    high, low = (a + _START[0]).byteswap(), (b + _START[1]).byteswap()
    return high.astype(np.uint64) << np.uint64(32) | low


def _digests(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, num_perm: int):
    """h_0, h_1, ... of the strings data[start:start + size]: of each the first 15 hex digits of md5('i:string')."""
    prefixes = [f"{i}:".encode() for i in range(num_perm)]
    long = np.zeros(len(sizes), dtype=bool)
    steps: list = []
    for i, prefix in enumerate(prefixes):
        if not i or len(prefix) != len(prefixes[i - 1]):
            # a block holds 55 bytes; words that no message reaches are left out of the sums
            long = sizes + len(prefix) > 55 if len(prefix) <= 4 else np.ones(len(sizes), dtype=bool)
            held = np.where(long, 0, sizes)
            at = np.arange(held.max(initial=0))
            blocks = np.zeros((len(sizes), 64), dtype=np.uint8)
            if len(at):
                reach = np.minimum(starts[:, None] + at, len(data) - 1)
                blocks[:, len(prefix):len(prefix) + len(at)] = np.where(at < held[:, None], data[reach], 0)
            blocks[np.arange(len(sizes)), len(prefix) + held] = 0x80
            words = np.ascontiguousarray(blocks.view("<u4").T)
            words[14] = 8 * (held + len(prefix))
            used = words.any(axis=1)
            steps = [words[w] + _SINES[j] if used[w] and w else _SINES[j] for j, w in enumerate(_WORDS)]
        h = _md5_halves(words[0] + np.uint32(int.from_bytes(prefix[:4], "little")), steps)
        for x in np.flatnonzero(long):
            h[x] = int.from_bytes(hashlib.md5(prefix + data[starts[x]:starts[x] + sizes[x]].tobytes()).digest()[:8], "big")
        yield (h >> np.uint64(4)).astype(np.int64)


def signatures(items: pa.Array, num_perm: int) -> np.ndarray:
    """The minima of the ``num_perm`` permutation hashes over every non-empty list of strings, a row per list."""
    flat = pc.list_flatten(items).cast(pa.large_string()).cast(pa.large_binary())
    ends = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset:flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", dtype=np.uint8)
    owner = np.repeat(np.arange(len(items)), pc.list_value_length(items).to_numpy())
    out = np.full((len(items), num_perm), np.iinfo(np.int64).max)
    for lo in range(0, len(flat), SIGN_ROWS):
        own = owner[lo:lo + SIGN_ROWS]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        starts = ends[lo:lo + len(own)]
        for i, h in enumerate(_digests(data, starts, ends[lo + 1:lo + len(own) + 1] - starts, num_perm)):
            out[own[first], i] = np.minimum(out[own[first], i], np.minimum.reduceat(h, first))
    return out


def signed_sets(sets: DataFrame, num_perm: int, written: DataFrame | None = None) -> DataFrame:
    """(set_key, set_first, items array<bigint>, sig): signatures inside the row, for shingles that seldom recur.

    Equal to ``set_signatures`` without a row per shingle; the digests of many shingles are computed side by side.
    ``items`` are the shingles' 64-bit hashes.  Sets without shingles are left out.
    Sets are signed where they lie (``written``, the shingles' table, no longer decides on the tasks).
    """

    def sign(batches):
        for b in batches:
            sig = signatures(b.column(2), num_perm)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * num_perm, pa.int32()), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), lists], ["set_key", "set_first", "items", "sig"])

    ship_package(sets.sparkSession)
    kinds = dict(sets.dtypes)
    src = sets.where(F.size("items") > 0).select(
        "set_key", "set_first", "items", F.transform("items", lambda s: F.xxhash64(s)).alias("hashes"))
    return materialize(src.mapInArrow(sign, f"set_key {kinds['set_key']}, set_first {kinds['set_first']}, items array<bigint>, sig array<bigint>"), "signed")


def band_hashes(sig: F.Column, bands: int, rows: int) -> F.Column:
    """array<string>[bands]: md5 of the '|'-joined signature slice of each band."""
    return F.array(*[
        F.md5(F.concat_ws("|", F.transform(F.slice(sig, b * rows + 1, rows), lambda x: x.cast("string"))))
        for b in range(bands)])


def _set_earliest(df: DataFrame, col: str, order_col: str, threshold: float, num_perm: int,
                  bands: int | None, rows: int | None, verify: bool, shingle: tuple[str, int] = CHARACTERS):
    """(texts(_cm_o, set_key), best(set_key, set_first, _cm_e))."""
    if bands is None or rows is None:
        bands, rows = optimal_bands(threshold, num_perm)
    texts, sets = _keyed_sets(df, col, order_col, shingle)
    if tuple(shingle) == CHARACTERS:
        signed = sets.join(set_signatures(sets.select("set_key", "items"), num_perm), "set_key")
    else:
        signed = signed_sets(sets, num_perm)
    set_bands = (signed
                 .select("set_key", "set_first", *(["items"] if verify else []),
                         F.posexplode(band_hashes(F.col("sig"), bands, rows)).alias("band_no", "band_hash")))
    if not verify:
        bucket = set_bands.groupBy("band_no", "band_hash").agg(F.min("set_first").alias("bucket_first"))
        best = (set_bands.join(bucket, ["band_no", "band_hash"])
                .groupBy("set_key").agg(F.min("bucket_first").alias("_cm_e"), F.min("set_first").alias("set_first")))
    else:
        if tuple(shingle) != CHARACTERS:
            # only sets that share a bucket can have a match: the others' shingles are not shuffled
            bands_of = set_bands.select("set_key", "band_no", "band_hash")
            shared = bands_of.groupBy("band_no", "band_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
            set_bands = materialize(bands_of.join(shared, ["band_no", "band_hash"])
                                    .join(signed.select("set_key", "set_first", "items"), "set_key")
                                    .select(*set_bands.columns), "mates")
        mates = set_bands.select(*[F.col(c).alias(f"_b_{c}") for c in set_bands.columns])
        a, b = F.col("items"), F.col("_b_items")
        small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
        common = F.size(F.array_intersect(a, b))
        alike = ((F.col("_b_set_first") < F.col("set_first")) & (small >= F.lit(threshold) * large)
                 & (common / (F.size(a) + F.size(b) - common) >= F.lit(threshold)))
        verified = (set_bands.join(mates, (F.col("band_no") == F.col("_b_band_no"))
                                   & (F.col("band_hash") == F.col("_b_band_hash")) & alike)
                    .groupBy("set_key").agg(F.min("_b_set_first").alias("v_first")))
        best = (sets.join(verified, "set_key", "left")
                .select("set_key", "set_first", F.least("set_first", "v_first").alias("_cm_e")))
    return texts, best


def earliest_candidates(df: DataFrame, col: str, order_col: str, threshold: float = 0.95,
                        num_perm: int = 128, bands: int | None = None, rows: int | None = None,
                        verify: bool = False, out_col: str = "earliest",
                        shingle: tuple[str, int] = CHARACTERS) -> DataFrame:
    """Add ``out_col``: the smallest ``order_col`` among texts sharing an LSH bucket.

    The text's own character set is included, so ``out_col < order_col`` means
    an earlier near duplicate exists.  Null texts get null.
    """
    texts, best = _set_earliest(df, col, order_col, threshold, num_perm, bands, rows, verify, shingle)
    keyed = texts.join(best, "set_key").select(F.col("_cm_o"), F.col("_cm_e"))
    out = df.join(keyed, df[order_col] == keyed["_cm_o"], "left")
    return out.select(*[F.col(c) for c in df.columns], F.col("_cm_e").alias(out_col))


def near_duplicate_flags(df: DataFrame, col: str, order_col: str, flag_col: str = "is_near_dup",
                         threshold: float = 0.95, num_perm: int = 128, bands: int | None = None,
                         rows: int | None = None, verify: bool = False,
                         shingle: tuple[str, int] = CHARACTERS) -> DataFrame:
    """Add ``flag_col``: true when an earlier text (by ``order_col``) is a near duplicate.

    A non-null row survives iff it is the first row of its character set and
    no earlier set shares a bucket with it, so the survivors are one id per
    surviving set; rows are matched back on the (unique) ``order_col``, not on
    the character-set string.  Null texts get false.
    """
    _, best = _set_earliest(df, col, order_col, threshold, num_perm, bands, rows, verify, shingle)
    survivors = best.where(F.col("_cm_e") >= F.col("set_first")).select(F.col("set_first").alias("_cm_surv"),
                                                                         F.lit(True).alias("_cm_keep"))
    out = df.join(survivors, df[order_col] == survivors["_cm_surv"], "left")
    flag = F.col(col).isNotNull() & F.col("_cm_keep").isNull()
    return out.select(*[F.col(c) for c in df.columns], flag.alias(flag_col))


def _possible(threshold: float):
    """Column function: sizes and sketches of two sets -> whether they can be as similar as ``threshold``.

    The sketches' differing bits, the wider one folded, are no more than the shingles of only one set.
    """
    @F.pandas_udf("boolean")
    def run(n: pd.Series, sketch: pd.Series, other_n: pd.Series, other_sketch: pd.Series) -> pd.Series:
        out = []
        for a, x, b, y in zip(n, sketch, other_n, other_sketch):
            x, y = np.frombuffer(x, dtype="uint8"), np.frombuffer(y, dtype="uint8")
            w = min(len(x), len(y))
            x, y = np.bitwise_xor.reduce(x.reshape(-1, w)), np.bitwise_xor.reduce(y.reshape(-1, w))
            overlap = min(a, b, (a + b - int(np.unpackbits(x ^ y).sum())) / 2)
            # lowered by a hair so that rounding never drops a pair
            out.append(overlap >= threshold / (1 + threshold) * (a + b) - 1e-6)
        return pd.Series(out, dtype="bool")

    return run


def _alike(texts: DataFrame, thin: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(set_first): the sets of ``pairs(set_first, other)`` that are as similar as ``threshold`` to the other one.

    Sketches first; the shingles are fetched for the sets of the few pairs that these leave.
    """
    own = thin.select("set_first", "n", "sketch")
    mate = thin.select(F.col("set_first").alias("other"), F.col("n").alias("_b_n"), F.col("sketch").alias("_b_sketch"))
    pairs = materialize(pairs.join(own, "set_first").join(mate, "other")
                        .where(_possible(threshold)("n", "sketch", "_b_n", "_b_sketch"))
                        .select("set_first", "other").distinct(), "possible")
    ids = pairs.select(F.col("set_first").alias("_cm_o")).union(pairs.select("other")).distinct()
    wanted = texts.select("_cm_o", "items").join(F.broadcast(ids) if small_enough(ids) else ids, "_cm_o", "left_semi")
    a = wanted.withColumnRenamed("_cm_o", "set_first")
    b = wanted.select(F.col("_cm_o").alias("other"), F.col("items").alias("_b_items"))
    common = F.size(F.array_intersect("items", "_b_items"))
    return (pairs.join(a, "set_first").join(b, "other")
            .where(common / (F.size("items") + F.size("_b_items") - common) >= F.lit(threshold))
            .select("set_first").distinct())


def _hashed_runs(k: int):
    """Column function: unit hashes array<bigint> -> (set_key, items): the distinct 64-bit hashes of the runs of k, sorted."""
    @F.pandas_udf("struct<set_key: binary, items: array<bigint>>")
    def run(units: pd.Series) -> pd.DataFrame:
        keys, items = [], []
        for u in units:
            w = np.asarray(u, dtype="int64").view("uint64")
            m = min(k, len(w))
            h = np.full(len(w) - m + 1 if m else 0, m, dtype="uint64")
            for j in range(m):
                h = (h ^ w[j:j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            h = np.unique(h.view("int64"))
            keys.append(hashlib.md5(h.tobytes()).digest())
            items.append(h)
        return pd.DataFrame({"set_key": keys, "items": items})

    return run


def _thinned(threshold: float, common: dict[int, int]):
    """Column function: items -> (n, p, sketch).

    ``p``: the first ``n - ceil(threshold * n) + 1`` items, common ones last and then by hash.  ``sketch``: bit i is
    the parity of the items that are i modulo its width, the least power of two of n bits or more (64 at least).
    """
    known = np.array(sorted(common), dtype="int64")
    held = np.array([common[x] for x in sorted(common)], dtype="int64")

    @F.pandas_udf("struct<n: int, p: array<bigint>, sketch: binary>")
    def run(sets: pd.Series) -> pd.DataFrame:
        sizes, out, sketches = [], [], []
        for x in sets:
            x = np.asarray(x, dtype="int64")
            count = np.zeros(len(x), dtype="int64")
            if len(known):
                at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                count = np.where(known[at] == x, held[at], 0)
            # the product is lowered by a hair so that rounding never shortens a prefix
            need = int(np.ceil(len(x) * threshold - 1e-6))
            out.append(x[np.lexsort((x, count))][:len(x) - need + 1])
            width = max(64, 1 << (len(x) - 1).bit_length())
            sketches.append(np.packbits((np.bincount(x & (width - 1), minlength=width) & 1).astype("uint8")).tobytes())
            sizes.append(len(x))
        return pd.DataFrame({"n": np.array(sizes, dtype="int32"), "p": out, "sketch": sketches})

    return run


#: One text in so many is looked at for common shingles; of these, so many at most are put last.
COMMON_SAMPLE, COMMON_MAX = 16, 200_000
#: Bytes of written shingle sets whose prefixes one task takes.
PREFIX_BYTES = 16 << 20


def exact_near_duplicate_flags(df: DataFrame, col: str, order_col: str, flag_col: str = "is_near_dup",
                               threshold: float = 0.8, shingle: tuple[str, int] = ("word", 5)) -> DataFrame:
    """Add ``flag_col``: true when an earlier text has the same shingles or a Jaccard similarity of ``threshold`` to it.

    Exact, without bands.  Two sets that are similar enough share a shingle among the first
    ``n - ceil(threshold * n) + 1`` of each, in any order common to all sets.  The order here puts the shingles that
    a sample finds common last, by their count, and the others by their hash: the sample decides how many
    pairs are compared, never which are found.  Only prefixes and sketches (a fiftieth of a set or so) are shuffled,
    and the shingles of pairs whose sketches allow the threshold.
    A set is first compared with the earliest holder of each of its prefix shingles (a star join); only those
    without a match there meet every earlier holder whose size and place still allow the threshold.  Shingles are
    compared by their 64-bit hashes.  ``order_col`` is unique; null texts get false.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and is at most 1")
    # the units are projected first: inside the lambda they would be split anew for every unit
    units = df.where(F.col(col).isNotNull()).select(F.col(order_col).alias("_cm_o"), _units(F.col(col), shingle).alias("u"))
    texts = units.select("_cm_o", _hashed_runs(shingle[1])(F.transform("u", lambda x: F.xxhash64(x))).alias("r"))
    texts = materialize(texts.select("_cm_o", "r.set_key", "r.items"), "hashed")
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(texts) // PREFIX_BYTES))
    firsts = texts.groupBy("set_key").agg(F.min("_cm_o").alias("set_first")).select("set_first")

    sample = (texts.where(F.pmod(F.xxhash64("set_key"), F.lit(COMMON_SAMPLE)) == 0)
              .groupBy("set_key").agg(F.any_value("items").alias("items")).select(F.explode("items").alias("item")))
    common = dict(sample.groupBy("item").agg(F.count("*").alias("c")).where("c > 2")
                  .orderBy(F.col("c").desc(), "item").limit(COMMON_MAX).collect())
    # thinned before anything is shuffled: the sets themselves stay where they were written
    thin = texts.select("_cm_o", _thinned(threshold, common)(F.col("items")).alias("t")).select("_cm_o", "t.*")
    thin = materialize(thin.repartition(n, "_cm_o").join(firsts, F.col("_cm_o") == firsts["set_first"])
                       .select("set_first", "n", "p", "sketch"), "thin")
    prefix = (thin.select("set_first", "n", F.posexplode("p").alias("at", "item"))
              .select("set_first", "n", (F.col("n") - F.col("at")).alias("rest"), "item"))
    # a shingle in one prefix only leads nowhere
    held = prefix.select("item").repartition(n, "item").groupBy("item").agg(F.count("*").alias("c")).where("c > 1")
    prefix = materialize(prefix.repartition(n, "item").join(held.select("item"), "item", "left_semi"), "prefix")

    star = prefix.groupBy("item").agg(F.min("set_first").alias("other"))
    pairs = prefix.join(star, "item").where("other < set_first").select("set_first", "other").distinct()
    found = materialize(_alike(texts, thin, pairs, threshold), "found")
    mates = prefix.select("item", F.col("set_first").alias("other"), F.col("n").alias("_b_n"), F.col("rest").alias("_b_rest"))
    both = F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("_b_n")) - F.lit(1e-6)   # the overlap needed
    # any overlap lies from the first common prefix shingle on, so one pair row has the room; all rows have less or as much
    left = (prefix.join(found, "set_first", "left_anti").join(mates, "item")
            .where((F.col("other") < F.col("set_first")) & (F.least("rest", "_b_rest") >= both))
            .select("set_first", "other").distinct())
    late = _alike(texts, thin, left, threshold)
    lost = found.unionByName(late)
    survivors = thin.select("set_first").join(lost, "set_first", "left_anti") \
        .select(F.col("set_first").alias("_cm_surv"), F.lit(True).alias("_cm_keep"))
    # known before the join, so that a caller who drops the texts does not shuffle them
    rows = df.withColumn("_cm_some", F.col(col).isNotNull())
    out = rows.join(survivors, rows[order_col] == survivors["_cm_surv"], "left")
    flag = F.col("_cm_some") & F.col("_cm_keep").isNull()
    return out.select(*[F.col(c) for c in df.columns], flag.alias(flag_col))


def drop_near_duplicates(df: DataFrame, col: str, order_col: str, **kw) -> DataFrame:
    """Column form: near-duplicate texts become null (rows are kept)."""
    flagged = near_duplicate_flags(df, col, order_col, flag_col="_cm_nd", **kw)
    return flagged.select(*[F.when(~F.col("_cm_nd"), F.col(c)).alias(c) if c == col else F.col(c)
                            for c in df.columns])


def dedup_counts(df: DataFrame, col: str, order_col: str, by_minhash: bool = True, **kw) -> DataFrame:
    """DD-8 / AGG-8: one row with the texts that each method removes.

    ``before_nulls`` (texts missing from the start), ``removed_exact``,
    ``removed_minhash`` (after the exact pass) and their sum ``removed``.
    """
    from .dedup import dedup_column

    exact = dedup_column(df.select(order_col, col, F.col(col).isNull().alias("_cm_was")), col, [order_col])
    if by_minhash:
        exact = near_duplicate_flags(exact, col, order_col, flag_col="_cm_nd", **kw)
    else:
        exact = exact.withColumn("_cm_nd", F.lit(False))
    return exact.agg(F.count_if("_cm_was").alias("before_nulls"),
                     F.count_if(F.col(col).isNull() & ~F.col("_cm_was")).alias("removed_exact"),
                     F.count_if("_cm_nd").alias("removed_minhash")).withColumn(
        "removed", F.col("removed_exact") + F.col("removed_minhash"))


def minhash_signatures(df: DataFrame, col: str, id_col: str, num_perm: int = 128,
                       shingle: tuple[str, int] = CHARACTERS) -> DataFrame:
    """(id, sig) per non-null text with shingles; signatures are shared by equal shingle sets."""
    texts, sets = _keyed_sets(df, col, id_col, shingle)
    return texts.join(set_signatures(sets.select("set_key", "items"), num_perm), "set_key").select(
        F.col("_cm_o").alias(id_col), "sig")


def lsh_buckets(df: DataFrame, col: str, id_col: str, threshold: float = 0.95, num_perm: int = 128,
                bands: int | None = None, rows: int | None = None, shingle: tuple[str, int] = CHARACTERS) -> DataFrame:
    """(id, band_no, band_hash) per non-null text: the LSH index."""
    if bands is None or rows is None:
        bands, rows = optimal_bands(threshold, num_perm)
    sig = minhash_signatures(df, col, id_col, num_perm, shingle)
    return sig.select(id_col, F.posexplode(band_hashes(F.col("sig"), bands, rows)).alias("band_no", "band_hash"))
