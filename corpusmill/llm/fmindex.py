"""Benchmark decontamination with one FM-index per training shard.

A shard is a bounded run of consecutive documents inside one Spark task (at
most ``SHARD_WORDS`` words; a longer document is cut into overlapping pieces,
so no window is lost).  Its index is built over words, not bytes:

* a word that no test phrase holds can be part of no match; such words (and
  document ends) act as sentinels, each smaller than every word and ordered by
  position, so only words of test phrases are sorted;
* suffixes are sorted by packed leading words, then by rank doubling on the
  groups that are still tied;
* the Burrows-Wheeler sequence is held in a wavelet tree with rank counts
  (level by level, zeros before ones);
* every test window is found by **backward search**: one LF step a word, all
  windows of a shard side by side;
* occurrences are located by walking LF to the next **sampled suffix position**
  (every ``SAMPLE``-th one, and every one behind a sentinel);
* their word spans are merged into removal spans.

The test phrases go to the tasks in blocks of bounded size (``BLOCK_BYTES`` of
text), one pass over the documents a block, so neither the driver nor a
broadcast ever holds an unbounded benchmark.  Everything else is narrow: no
document is shuffled.

Defined cases: a null, empty or word-free text has no words and no hits; a null
or word-free item gives no window; items that share an id are one item; an item
with a null id removes text but has no id to list; repeated rows are all
returned with equal results; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import read

#: Words of one shard's index; every how many positions a suffix is sampled; test text broadcast at once.
SHARD_WORDS, SAMPLE, BLOCK_BYTES = 1 << 20, 8, 16_000_000

# lower-case A-Z; every other ASCII character that is no letter or digit separates words
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text`` (0 is a sentinel; sentinels are smallest, ordered by position; the last is one)."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    take = max(1, 62 // bits)
    key, stopped = np.zeros(n, np.int64), np.zeros(n, bool)
    for step in range(take):  # leading words, cut at the first sentinel
        shifted = np.zeros(n, np.int64)
        shifted[: max(0, n - step)] = text[step:]
        stopped |= shifted == 0
        key = key << bits | np.where(stopped, 0, shifted)
    order = np.argsort(key, kind="stable")
    first = np.ones(n, bool)
    sorted_key = key[order]
    first[1:] = (sorted_key[1:] != sorted_key[:-1]) | stopped[order[1:]] | stopped[order[:-1]]
    slot = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, slot, 0))
    size, tied = take, np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(tied):  # rank doubling, on tied slots only
        who = order[tied]
        nxt = rank[who + size]  # inside the text: no sentinel stands within the tied words
        again = np.lexsort((nxt, rank[who]))
        who, a, b = who[again], rank[who][again], nxt[again]
        order[tied] = who
        new = np.ones(len(tied), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rank[who] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        tied = tied[~(new & np.append(new[1:], True))]
        size *= 2
    return order


class WaveletTree:
    """Rank and access over a sequence of small integers, level by level from the highest bit."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            zeros = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(~bit, out=zeros[1:])
            self.levels.append((level, zeros, int(zeros[-1])))
            seq = np.concatenate((seq[~bit], seq[bit]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands before position at (vectorised)."""
        lo, hi = np.zeros_like(at), at
        for level, zeros, total in self.levels:
            one = (symbol >> level & 1).astype(bool)
            zlo, zhi = zeros[lo], zeros[hi]
            lo, hi = np.where(one, total + lo - zlo, zlo), np.where(one, total + hi - zhi, zhi)
        return hi - lo

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at position, its rank before the position)."""
        lo, hi, symbol = np.zeros_like(at), at, np.zeros_like(at)
        for level, zeros, total in self.levels:
            zhi, zlo = zeros[hi], zeros[lo]
            one = zeros[hi + 1] == zhi
            symbol = symbol | one.astype(symbol.dtype) << level
            lo, hi = np.where(one, total + lo - zlo, zlo), np.where(one, total + hi - zhi, zhi)
        return symbol, hi - lo


class FMIndex:
    """Words of one shard: count and locate word sequences."""

    def __init__(self, text: np.ndarray):
        order = suffix_order(text)
        self.bwt = text[order - 1]          # order 0 wraps to the closing sentinel
        symbols = int(text.max()) + 1
        self.tree = WaveletTree(self.bwt, max(1, (symbols - 1).bit_length()))
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        sampled = (order % SAMPLE == 0) | (self.bwt == 0)
        self.before = np.concatenate(([0], np.cumsum(sampled)))  # sampled rows before a row
        self.samples = order[sampled]

    def ranges(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) rows whose suffixes begin with each window (rows of equal length, last word first searched)."""
        last = windows[:, -1]
        low, high = self.starts[last], self.starts[last + 1]
        live = np.flatnonzero(low < high)
        for col in range(windows.shape[1] - 2, -1, -1):
            word = windows[live, col]
            low[live] = self.starts[word] + self.tree.rank(word, low[live])
            high[live] = self.starts[word] + self.tree.rank(word, high[live])
            live = live[low[live] < high[live]]
        high[np.setdiff1d(np.arange(len(low)), live, assume_unique=True)] = 0
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(live):
            known = self.before[at + 1] > self.before[at]
            out[live[known]] = self.samples[self.before[at[known]]] + steps[live[known]]
            live, at = live[~known], at[~known]
            symbol, rank = self.tree.step(at)
            at = self.starts[symbol] + rank
            steps[live] += 1
        return out


class Windows:
    """Test windows of one block: word ids from 1, and the windows of each length with their items."""

    def __init__(self, items: list[tuple[int, list[bytes]]], length: int):
        self.ids: dict[bytes, int] = {}
        found: dict[int, dict[tuple, set]] = {}
        for item, words in items:
            row = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            if row:
                size = min(length, len(row))
                for at in range(len(row) - size + 1):
                    found.setdefault(size, {}).setdefault(tuple(row[at:at + size]), set()).add(item)
        self.by_length = {size: (np.array(list(some), np.int64), list(some.values())) for size, some in found.items()}
        self.longest = max(self.by_length, default=1)


def search(text: np.ndarray, windows: Windows):
    """(position, length, items) arrays of every occurrence of every window in a sentinel-closed word sequence."""
    if not text.any():
        return
    index, here = None, np.zeros(len(windows.ids) + 1, bool)
    here[text] = True
    for size, (rows, items) in windows.by_length.items():
        some = np.flatnonzero(here[rows].all(axis=1))  # windows with a word that the shard lacks can't occur
        if not len(some):
            continue
        if index is None:
            # dense word ids of this shard keep the wavelet tree as low as its own vocabulary allows
            dense = np.cumsum(here) - here + (0 if here[0] else 1)
            dense[0] = 0
            index = FMIndex(dense[text])
        low, high = index.ranges(dense[rows[some]])
        count = high - low
        hit = np.repeat(np.arange(len(some)), count)
        row = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(hit))
        yield index.locate(row), size, [items[i] for i in some[hit].tolist()]


def scan_texts(texts: list[bytes | None], windows: Windows) -> list[tuple[int, np.ndarray | None, set]]:
    """(word count, hit mask or None, items) per text: shards of bounded size, one FM-index each."""
    result: list = []
    shard: list[np.ndarray] = []     # word ids of pieces, each closed by a sentinel
    places: list[tuple[int, int, int]] = []   # (text, first word, piece length)
    held = 0
    get, overlap = windows.ids.get, windows.longest - 1

    def flush():
        nonlocal held
        if not shard:
            return
        joined = np.concatenate(shard)
        starts = np.cumsum([0] + [len(p) for p in shard])
        # runs of sentinels say no more than one of them
        keep = (joined != 0) | np.append(True, joined[:-1] != 0)
        where = np.flatnonzero(keep)
        for position, size, items in search(joined[keep], windows):
            position = where[position]
            piece = np.searchsorted(starts, position, side="right") - 1
            for at, part, got in zip((position - starts[piece]).tolist(), piece.tolist(), items):
                doc, first, _ = places[part]
                count, mask, mine = result[doc]
                if mask is None:
                    mask = np.zeros(count, bool)
                    result[doc] = (count, mask, mine)
                mask[first + at:first + at + size] = True
                mine.update(got)
        shard.clear()
        places.clear()
        held = 0

    for doc, text in enumerate(texts):
        words = words_of(text)
        result.append((len(words), None, set()))
        if not words or not windows.ids:
            continue
        ids = np.array([get(w, 0) for w in words], np.int64)
        for first in range(0, len(ids), SHARD_WORDS):
            piece = ids[first:first + SHARD_WORDS + overlap]
            if held and held + len(piece) > SHARD_WORDS:
                flush()
            shard.append(np.append(piece, 0))
            places.append((doc, first, len(piece)))
            held += len(piece)
    flush()
    return result


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs [start, end) of hit words: occurrences that touch or overlap are one."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _byte_runs(text: bytes, mask: np.ndarray) -> list[tuple[int, int]]:
    """The same runs as byte spans, from the first word's start to the last one's end."""
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    return [(at[a][0], at[b - 1][1]) for a, b in _runs(mask)]


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Lists of (item number, words) of at most about BLOCK_BYTES of test text, with the items' ids as text."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"),
                             F.col(f"`{text_col}`").cast("binary").alias("t")).where("t is not null")
    block: list = []
    size = 0
    for row in items.toLocalIterator():
        block.append((row["item"], words_of(bytes(row["t"]))))
        size += len(row["t"])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", length: int = 10, prefix: str = "_cm_",
                       keep_text: bool = True) -> DataFrame:
    """Add to every row of ``docs``: n_words, the merged removal spans (words and UTF-8 bytes) and the items found.

    Added columns (each behind ``prefix``): ``n_words`` long, ``words`` and
    ``bytes`` array<struct<start, end>>, ``items`` array<string>.  Narrow for one
    block of test phrases; every further block is a further narrow pass whose
    spans are merged with the earlier ones.
    """
    spark = docs.sparkSession
    span = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
    names = [prefix + x for x in ("n_words", "words", "bytes", "items")]
    added = dict(zip(names, ("long", span, span, "array<string>")))
    order = [c for c in docs.columns if c != text_col or keep_text]
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text_col],
                      *[F.lit(None).cast(kind).alias(c) for c, kind in added.items()],
                      F.col(f"`{text_col}`").cast("binary").alias("_cm_raw"))

    def one_pass(frame: DataFrame, shared, with_text: bool) -> DataFrame:
        def run(batches):
            windows = Windows(shared.value, length)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

            def spans(edges) -> list[dict]:
                return [{"start": a, "end": b} for a, b in edges]

            for b in batches:
                raw = b.column(b.schema.get_field_index("_cm_raw"))
                texts = raw.to_pylist()
                earlier = b.column(b.schema.get_field_index(names[1])).to_pylist()
                known = b.column(b.schema.get_field_index(names[3])).to_pylist()
                count, words, places, items = [], [], [], []
                for text, was, ids, (n, mask, got) in zip(texts, earlier, known, scan_texts(texts, windows)):
                    if was and mask is None:
                        mask = np.zeros(n, bool)
                    for s in was or ():
                        mask[s["start"]:s["end"]] = True
                    count.append(n)
                    items.append(sorted(set(ids or ()) | {x for x in got if x is not None}))
                    words.append([] if mask is None else spans(_runs(mask)))
                    places.append([] if mask is None else spans(_byte_runs(text, mask)))
                new = [pa.array(count, pa.int64()), pa.array(words, kind), pa.array(places, kind),
                       pa.array(items, pa.list_(pa.string()))]
                rest = b.drop_columns(["_cm_raw", *names])
                text_out, text_name = ([raw], ["_cm_raw"]) if with_text else ([], [])
                yield pa.RecordBatch.from_arrays([*rest.columns, *new, *text_out],
                                                 names=[*rest.schema.names, *names, *text_name])

        return frame.mapInArrow(run, frame.schema if with_text else frame.drop("_cm_raw").schema)

    blocks = _item_blocks(benchmark, item_col, item_text_col)
    block = next(blocks, [])
    while block is not None:
        after = next(blocks, None)
        out = one_pass(out, spark.sparkContext.broadcast(block), keep_text or after is not None)
        block = after
    kind = docs.schema[text_col].dataType
    return out.select(*[F.col("_cm_raw").cast(kind).alias(c) if c == text_col else F.col(f"`{c}`") for c in order], *names)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length: int = 10) -> DataFrame:
    """``docs`` with every removal span cut out of ``text_col``; clean rows are unchanged, no row is dropped.

    ``n_chars``, if there is such a column, is counted again for the rows that change.
    """
    found = find_contamination(docs, benchmark, text_col, length=length)
    dirty = F.size("_cm_bytes") > 0
    raw = F.col(f"`{text_col}`").cast("binary")
    # text between spans: from the end of the one before to the start of the next, in bytes
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("_cm_bytes", lambda s: s["end"]))
    starts = F.concat(F.transform("_cm_bytes", lambda s: s["start"]), F.array(F.octet_length(raw).cast("long")))
    parts = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")),
                        lambda z: F.substr(raw, (z["a"] + 1).cast("int"), (z["b"] - z["a"]).cast("int")).cast("string"))
    done = found.withColumn("_cm_text", F.when(dirty, F.array_join(parts, "")))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.when(dirty, F.col("_cm_text")).otherwise(F.col(f"`{c}`")).alias(c))
        elif c == "n_chars":
            kind = dict(docs.dtypes)[c]
            out.append(F.when(dirty, F.char_length("_cm_text").cast(kind)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return done.select(*out)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = find_contamination(src, benchmark, keep_text=False)
    hit = F.aggregate("_cm_words", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", F.col("_cm_n_words").alias("n_words"), hit.alias("n_hit"),
                        F.size("_cm_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("_cm_items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.size("_cm_words") > 0).alias("contaminated"))


def query(spark, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_SQL_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bw),
dg AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT rid, i, n, item_id FROM dg JOIN win USING (n, g)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""
