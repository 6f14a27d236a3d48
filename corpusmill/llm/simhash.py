"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint is the 64-bit majority vote of the XXH64 hashes of its
word shingles.  Two documents link when their fingerprints differ in at most
``max_bits`` bits; a component is what links reach.

Candidate search uses *anchor points*: the words of a covering code.  The code
here is the direct sum of two perfect binary Golay [23,12,7] codes on bits 0-22
and 23-45 and of the zero word on the other 18 bits, so there are 2^24 anchors.
Every 23-bit block lies within radius 3 of exactly one Golay word, hence every
fingerprint has exactly one *home* anchor within the covering radius
(3, 3, 18 bits by block).  If x and y differ in at most t bits, then y is
within radius + t of x's home, the excess over the radius summed over blocks
being at most t.  So every fingerprint is replicated to **all** anchors within
covering radius + t (61 on average for t = 2, whatever the corpus), homes meet
replicas in one equi-join on the anchor, and the exact bit distance is checked
per anchor inside that join.  No link is lost and none is found twice (only
the home of the smaller fingerprint is used).

Scale: documents collapse to distinct fingerprints before replication (map-side
aggregate), so a group of copies of any size is one row there.  A set of
fingerprints that are pairwise within two bits has at most 65 members, and a
fingerprint has at most 2080 partners, so links grow linearly.  Components come
from large-star / small-star rounds over links: aggregates and equi-joins only,
each round written to the shared checkpoint folder.

Defined cases: null, empty and blank texts have fingerprint zero and link like
any other; a text of fewer words than the shingle length is one shingle; equal
texts have equal fingerprints; rows with a null id take part, but a null id is
never a component id unless the whole component has no other; repeated rows
are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release
from .common import cut, need, text_bytes

# The Golay generator polynomial x^11+x^9+x^7+x^6+x^5+x+1, the block width, the code's radius.
GOLAY_POLY, BLOCK, RADIUS = 0b101011100011, 23, 3

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CHUNK = 1 << 18


def shingle_hashes(words: list[bytes], k: int, seed: int = 42) -> list[int]:
    """XXH64 of every k-word shingle, repeats included; fewer than k words make one shingle."""
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the uint64 hashes have each of the 64 bits (little-endian bit order)."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[lo:lo + _CHUNK].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        full = len(bits) // 255 * 255
        if full:  # sums of 255 bits fit a byte, which keeps the adds in vector registers
            total += np.add.reduce(bits[:full].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[full:].sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes | None, k: int = 3) -> int:
    """Signed 64-bit SimHash of UTF-8 bytes (A-Z lower-cased, ASCII white space separates words)."""
    hashes = shingle_hashes((text or b"").translate(_LOWER).split(), k)
    if not hashes:
        return 0
    ones = bit_counts(np.array(hashes, dtype=np.uint64)) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, th, fp) per row: th is Spark's xxhash64 of the text, fp the signed fingerprint."""

    def run(batches):
        for b in batches:  # Arrow, not pandas: a null among the ids must not turn the others into floats
            prints = pa.array([fingerprint(t.as_py(), k) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), prints], names=["id", "th", "fp"])

    src = need(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"),
                                              F.xxhash64(F.col(f"`{text_col}`")).alias("th"),
                                              text_bytes(text_col).alias("t"))
    kind = dict(src.dtypes)["id"]
    return src.mapInArrow(run, f"id {kind}, th long, fp long")


def _golay_errors() -> list[list[np.ndarray]]:
    """[excess][syndrome]: the error words of weight 3 + excess (excess 0: at most 3) by syndrome."""
    def syndrome(words: np.ndarray) -> np.ndarray:
        rest = words.copy()
        for bit in range(BLOCK - 1, 10, -1):
            rest = np.where(rest >> bit & 1, rest ^ (GOLAY_POLY << (bit - 11)), rest)
        return rest

    out = []
    for weights in ((0, 1, 2, 3), (4,), (5,)):
        words = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(BLOCK), w)], np.int64)
        s = syndrome(words)
        order = np.argsort(s, kind="stable")
        starts = np.searchsorted(s[order], np.arange(2049))
        out.append((words[order], starts))
    # syndrome of every 23-bit word is linear: table by the low and high half
    low, high = syndrome(np.arange(1 << 12, dtype=np.int64)), syndrome(np.arange(1 << 11, dtype=np.int64) << 12)
    return out, low, high


def anchors(fps: np.ndarray, max_bits: int, tables=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, excess) of every anchor within covering radius + max_bits of each fingerprint."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the Golay tables reach an excess of 2 bits")
    errors, low, high = tables or _golay_errors()
    u = fps.astype(np.int64).view(np.uint64)
    mask = np.uint64((1 << BLOCK) - 1)
    blocks = [(u & mask).astype(np.int64), ((u >> np.uint64(BLOCK)) & mask).astype(np.int64)]
    syn = [low[b & 0xFFF] ^ high[b >> 12] for b in blocks]
    rows, ids, over = [], [], []
    for a in range(max_bits + 1):
        for c in range(max_bits + 1 - a):
            (wa, sa), (wc, sc) = errors[a], errors[c]
            na, nc = sa[syn[0] + 1] - sa[syn[0]], sc[syn[1] + 1] - sc[syn[1]]
            n = na * nc
            row = np.repeat(np.arange(len(u)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            e0 = wa[sa[syn[0][row]] + at // nc[row]]
            e1 = wc[sc[syn[1][row]] + at % nc[row]]
            rows.append(row)
            ids.append((blocks[0][row] ^ e0) | (blocks[1][row] ^ e1) << BLOCK)
            over.append(np.full(len(row), a + c, np.int32))
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(over)


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """(u, v), u < v: every pair of distinct fingerprints (column fp) at most max_bits bits apart, once."""

    def spread(batches):
        tables = _golay_errors()
        for b in batches:
            fps = b["fp"].to_numpy()
            for lo in range(0, len(fps), 4096):
                part = fps[lo:lo + 4096]
                row, anchor, over = anchors(part, max_bits, tables)
                yield pd.DataFrame({"anchor": anchor, "y": part[row]})

    def home(batches):
        tables = _golay_errors()
        for b in batches:
            fps = b["fp"].to_numpy()
            row, anchor, _ = anchors(fps, 0, tables)
            yield pd.DataFrame({"home": anchor, "x": fps[row]})

    replicas = distinct.select("fp").mapInPandas(spread, "anchor long, y long")
    homes = distinct.select("fp").mapInPandas(home, "home long, x long")
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits
    # Spark sizes the replicas like their input, 61 times too low, and would send them to the driver for a broadcast
    return (homes.hint("merge").join(replicas.hint("merge"), (F.col("home") == F.col("anchor")) & (F.col("x") < F.col("y")) & near)
            .select(F.col("x").alias("u"), F.col("y").alias("v")))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) of every node of the undirected edges; root is the component's smallest node.

    Large-star and small-star rounds until the edge set stands still, O(log^2)
    rounds at most.  Neighbourhood minima are aggregates joined back, so a
    centre with any number of neighbours is never one group in memory.
    """
    state = cut(edges.select(F.least(u, v).alias("lo"), F.greatest(u, v).alias("hi")).where("lo < hi").distinct(), "cc")
    before = None
    while True:
        both = state.select(F.col("lo").alias("a"), F.col("hi").alias("b")).union(state.select("hi", "lo"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("hi"), F.col("m").alias("lo"))
        down = large.where("hi > lo").distinct()
        least = down.groupBy(F.col("hi").alias("a")).agg(F.min("lo").alias("m"))
        small = down.join(least, down["hi"] == least["a"]).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        small = small.union(least.select(F.col("a").alias("hi"), F.col("m").alias("lo")))
        last, state = state, cut(small.where("hi > lo").select("lo", "hi").distinct(), "cc")
        release(last)
        now = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    return state.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        state.select("lo", "lo").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3,
                    max_bits: int = 2) -> DataFrame:
    """(id, th, fp, component_id, first_th) per row of ``docs``.

    ``component_id`` is the smallest id in the component and ``first_th`` the
    text hash of its document (of the smallest one if ids repeat); they name
    the document that stays when one of each group does.
    """
    prints = cut(fingerprints(docs, id_col, text_col, k), "simhash")
    # smallest id, null ids last; th breaks ties between rows that share an id
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("th").alias("th")))
    distinct = cut(prints.groupBy("fp").agg(first.alias("first")), "simhash-fp")
    comp = components(links(distinct, max_bits))
    rooted = distinct.join(comp, distinct["fp"] == comp["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    named = rooted.join(best, "root").select(F.col("fp").alias("f"), "best")
    return prints.join(named, prints["fp"] == named["f"]).select(
        "id", "th", "fp", F.col("best.id").alias("component_id"), F.col("best.th").alias("first_th"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each near-duplicate group, all its columns unchanged."""
    found = near_duplicates(docs, id_col, text_col, k, max_bits)
    stay = (found.where(F.col("id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("first_th")))
            .select(F.col("id").alias("_cm_id"), F.col("th").alias("_cm_th")).distinct())
    hashed = docs.withColumn("_cm_text", F.xxhash64(F.col(f"`{text_col}`")))
    same = hashed[id_col].eqNullSafe(stay["_cm_id"]) & (hashed["_cm_text"] == stay["_cm_th"])
    once = hashed.join(stay, same, "left_semi").dropDuplicates([id_col, "_cm_text"])
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component_id"))
