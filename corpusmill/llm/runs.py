"""Periodic runs of words, by enumeration of maximal pairs on an LCP-interval tree.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), at least ``max(min_length, min_exponent * q)`` words long, that no
neighbouring word extends keeping period q.

A *maximal pair* is two occurrences i < j of the same l words that differ in the
word before and in the word after.  If j - i = q and l + q is long enough, the
stretch from i to j + l is exactly a run, with no extension needed: the words
before differ, the words after differ, and the l equal words make it q-periodic.
So for every document

1. suffixes are **named** by prefix doubling (arrays of numbers, many documents of
   a batch together; the document's number is part of each name, so that nothing
   crosses its borders);
2. suffixes that share their first words with no other suffix of the document are
   leaves below the root of the LCP-interval tree and can be in no pair long enough;
   they are left out, the others are sorted, and the LCP of neighbours is read off
   the names by binary descent;
3. the **LCP-interval tree** is walked bottom-up with a stack.  Every interval has
   its occurrences in text order, each with its **left-word class**; where two
   children meet, each occurrence of the smaller one is held against its neighbours
   in the larger one, and a pair of different classes whose distance satisfies the
   length constraints is reported.

Neighbours are enough: were an occurrence d words after i between i and j = i + q,
the l >= 3q common words would have the periods d and q, hence gcd(d, q) < q.
Without this the class lists of a node would have to be crossed in full, which is
quadratic in a phrase repeated a thousand times.  Pairs of the same stretch with a
multiple of its smallest period are dropped by (start, end).  Merging the smaller
child into the larger gives O(n log n) steps for n words, whatever repeats.

Scale: one narrow pass; a document is the unit, batches are cut by bytes
(``SLICE_BYTES``), so memory follows the longest document, not the row count.
No row is dropped and texts are processed whole.

Defined cases: a null or empty text, or one of white space only, has no words, no
run, and collapses to the empty text; rows that repeat, and null ids, are kept and
each treated alone; of runs with equal exponents the first (start, then period) is
the top one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, text_bytes

#: Bytes of text that are named together (a longer document stands alone); positions in a block of a place list.
SLICE_BYTES, PLACES = 2 << 20, 512


class Places:
    """Positions in text order: sorted blocks, so that adding one does not move all that follow."""

    __slots__ = ("blocks", "tops", "size")

    def __init__(self, position: int):
        self.blocks, self.tops, self.size = [[position]], [position], 1

    def add(self, position: int) -> None:
        k = min(bisect_left(self.tops, position), len(self.tops) - 1)
        block = self.blocks[k]
        insort(block, position)
        self.size += 1
        if len(block) > PLACES:
            half = len(block) // 2
            self.blocks[k:k + 1] = [block[:half], block[half:]]
            self.tops[k:k + 1] = [block[half - 1], block[-1]]
        else:
            self.tops[k] = block[-1]

    def around(self, position: int) -> tuple[int, int]:
        """(the position before, the position after), -1 where there is none; ``position`` itself is not held."""
        k = bisect_left(self.tops, position)
        if k == len(self.tops):
            return self.tops[-1], -1
        block = self.blocks[k]
        i = bisect_left(block, position)
        before = block[i - 1] if i else (self.tops[k - 1] if k else -1)
        return before, block[i]

    def __iter__(self):
        for block in self.blocks:
            yield from block


def suffix_order(codes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, LCP with the one before) of those that share their first ``base`` symbols with another.

    ``codes`` ends in a symbol that stands nowhere else; ``base`` is a power of two.
    """
    n = len(codes)
    names = np.unique(codes, return_inverse=True)[1]
    levels, width = [names.astype(np.int32)], 1
    while width < base:  # level k names every position by its first 2^k symbols
        after = np.append(names[width:], np.full(width, -1))
        names = np.unique(names * (n + 1) + after + 1, return_inverse=True)[1]
        levels.append(names.astype(np.int32))
        width *= 2
    counts = np.bincount(names)
    some = alive = np.flatnonzero(counts[names] > 1)
    names = (np.cumsum(counts) - counts)[names].astype(np.int32)  # a group's name: how many suffixes come before it
    while len(alive):  # only groups of several suffixes are refined
        held, after = names[alive], names[alive + width]
        order = np.lexsort((after, held))
        a, b = held[order], after[order]
        head = np.append(True, a[1:] != a[:-1])
        step = head | np.append(True, b[1:] != b[:-1])
        spot = np.arange(len(a))
        shift = np.maximum.accumulate(np.where(step, spot, 0)) - np.maximum.accumulate(np.where(head, spot, 0))
        names = names.copy()
        names[alive[order]] = a + shift
        levels.append(names)
        width *= 2
        alive = alive[order][~(step & np.append(step[1:], True))]
    some = some[np.argsort(names[some], kind="stable")]
    common = np.zeros(len(some), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = some[1:] + common[1:], some[:-1] + common[1:]
        common[1:] += (levels[k][i] == levels[k][j]).astype(np.int64) << k
    return some, common


def runs_of(codes: np.ndarray, left: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in the text of ``codes``; ``left`` is the class of the word before."""
    if min_exponent < 3:
        raise ValueError("neighbouring occurrences give all runs from three periods on")
    # the shortest common prefix that a pair of any distance q can have
    least = min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, max(min_length, 2)))
    order, lcp = suffix_order(codes, 1 << (least.bit_length() - 1))
    places, depths = order.tolist(), lcp.tolist()
    depths.append(0)
    classes = left.tolist()
    best: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, Places]] = []
    for k, position in enumerate(places):
        node = Places(position)
        depth = depths[k + 1]
        while stack and stack[-1][0] >= depth:
            common, large = stack.pop()
            if common < least:
                continue
            small = node
            if small.size > large.size:
                small, large = large, small
            farthest = common // (min_exponent - 1)
            for x in small:
                before, after = large.around(x)
                for i, j in ((before, x), (x, after)):
                    if i < 0 or j < 0:
                        continue
                    q = j - i
                    if q <= farthest and q + common >= min_length and classes[i] != classes[j]:
                        key = (i, j + common)
                        if q < best.get(key, q + 1):
                            best[key] = q
            for x in small:
                large.add(x)
            node = large
        stack.append((depth, node))
    return sorted((start, stop - start, q) for (start, stop), q in best.items())


def batch_runs(words: list[list[bytes]], min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of every text of a batch, each as (start, length, period) in order."""
    sizes = np.array([len(w) for w in words], np.int64)
    out: list[list] = [[] for _ in words]
    flat = pa.array([x for w in words for x in w], pa.binary())
    if not len(flat):
        return out
    word = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    begin = np.cumsum(sizes) - sizes
    span = int(word.max()) + 1
    # a word of one document is another symbol than the same word of another; the last symbol stands for the end
    codes = np.append(owner * span + word, len(words) * span)
    left = np.append(-1, word)
    left[begin] = -1
    for start, length, period in runs_of(codes, left, min_length, min_exponent):
        doc = int(owner[start])
        out[doc].append((start - int(begin[doc]), length, period))
    return out


def top_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties: smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats: of every run only the first period stays (unless another run drops it)."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period:start + length] = True
    return b" ".join([w for w, g in zip(words, gone) if not g])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6,
                  min_exponent: int = 4) -> DataFrame:
    """(id, n_words, runs, top, collapsed) per row: all runs, the strongest one (or null), the text without repeats."""
    kind = dict(docs.dtypes)[id_col]
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches):
        for b in batches:
            for part in _slices(b):
                words = [t.as_py().split() if t.is_valid else [] for t in part.column(1)]
                found = batch_runs(words, min_length, min_exponent)
                as_row = lambda r: dict(zip(("start", "length", "period"), r))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(w) for w in words], pa.int64()),
                     pa.array([[as_row(r) for r in x] for x in found], pa.list_(run)),
                     pa.array([as_row(top_run(x)) if x else None for x in found], run),
                     pa.array([collapsed(w, x) for w, x in zip(words, found)], pa.binary())],
                    ["id", "n_words", "runs", "top", "collapsed"])

    one = "struct<start: long, length: long, period: long>"
    src = docs.select(F.col(f"`{id_col}`").alias("id"), text_bytes(text_col).alias("t"))
    done = src.mapInArrow(work, f"id {kind}, n_words long, runs array<{one}>, top {one}, collapsed binary")
    return done.withColumn("collapsed", F.col("collapsed").cast("string"))


def _slices(batch: pa.RecordBatch):
    """Parts of a batch of at most SLICE_BYTES of text each, or of one row."""
    sizes = [len(t.as_py()) if t.is_valid else 0 for t in batch.column(1)]
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > SLICE_BYTES:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): about a tenth of the texts turned periodic from some word on, as the query's contract says."""
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    words = F.filter(F.split(F.col(f"`{text_col}`"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                      F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w")
    src = src.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn(
        "p", F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    turned = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.element_at("w", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))))
    return src.select("doc_id", F.when(n > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's rows."""
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                   F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"),
        F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.floor(F.expr("(1000 * top.length) div top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(planted(read(spark, sf_dir, "documents"))))
