"""Line de-duplication by winnowing over line hashes.

A line is what stands between newlines; it is compared without white space at
its ends, and lines that are then empty are neither compared nor removed.
Windows are measured in words, because lines differ a lot in length: the window
at line i is the shortest run of lines from i with at least ``window_words``
words.

1. **Winnow.**  Every complete window selects its line of the smallest hash (the
   last of equals) as a fingerprint.  Around each selected line stand at most two
   grams of window_words words: the shortest run that starts there and the
   shortest one that ends there.  The gram's 128-bit digest is its key.
2. **Join positions.**  Every gram meets the *first* place that holds it (the
   smallest id, null ids first; then text hash; then line): one aggregate and
   one equi-join, a star and never pairs, so a line on a third of all documents
   costs one row each.
3. **Extend** both ways, line by line, while the lines before and after are
   equal; each gram carries the hashes of its neighbours up to twice the window,
   beyond which another selected line of its own stands.
4. **Delete** the later run.  The first place of any line is never deleted, since
   a deleted line always has an equal one at an earlier place.

Guarantee: a repeated line of at least window_words words, and a repeated run of
lines of at least twice that many words, shares a fingerprint with its first
place, so the gram (and what extends it) is deleted at every later place.
Shorter repeats (headings, single words) stay unless they extend a longer run.
Exception: "first place" is the earliest place of the gram, and a run is extended
against that place only.  Lines of fewer than window_words words beside a longer
line stay when the longer line's first place has other neighbours, even though a
later place repeats the whole run.

Defined cases: null texts stay null; empty texts stay empty; a text that loses
every line becomes empty but its row stays; rows equal in id and text are one
document and all get the same result; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release
from .common import cut, read, text_bytes

#: Words of a winnowing window; bytes of text that are winnowed at a time (a longer document stands alone).
WINDOW_WORDS, SLICE_BYTES = 8, 2 << 20


def _reach(total: np.ndarray, words: int) -> np.ndarray:
    """For each line, the exclusive end of the shortest run from it with enough words (len + 1: none)."""
    end = np.searchsorted(total, total[:-1] + words, side="left")
    return end  # an index beyond the last prefix sum means that the words run out


def grams(text: bytes, words: int) -> list[tuple]:
    """(key, first line, last line, hashes before, lines before, hashes after, lines after) of the selected grams.

    Neighbours are listed from the nearest outwards, up to twice the window.
    """
    raw = [line.strip() for line in text.split(b"\n")]
    at = [i for i, line in enumerate(raw) if line]
    lines = [raw[i] for i in at]
    n = len(lines)
    if not n:
        return []
    total = np.concatenate(([0], np.cumsum([len(x.split()) for x in lines])))
    hashes = [xxhash.xxh64_intdigest(x) - (1 << 63) for x in lines]
    end = _reach(total, words)          # window at i: lines i .. end[i] - 1
    chosen: set[int] = set()
    queue: list[int] = []               # candidates of the sliding minimum, hashes rising
    head, taken = 0, 0
    for i in range(n):
        stop = int(end[i])
        if stop > n:
            break
        while taken < stop:
            while len(queue) > head and hashes[queue[-1]] >= hashes[taken]:
                queue.pop()
            queue.append(taken)
            taken += 1
        while queue[head] < i:
            head += 1
        chosen.add(queue[head])
    first = np.searchsorted(total, total[1:] - words, side="right") - 1   # shortest run that ends at line i
    out, seen = [], set()
    for a in chosen:
        runs = []
        if end[a] <= n:
            runs.append((a, int(end[a]) - 1))
        if total[a + 1] >= words:
            runs.append((int(first[a]), a))
        for lo, hi in runs:
            if (lo, hi) in seen:
                continue
            seen.add((lo, hi))
            key = hashlib.md5(b"\n".join(lines[lo:hi + 1])).digest()
            left, right = lo, hi + 1
            while left > 0 and total[lo] - total[left] < 2 * words:
                left -= 1
            while right < n and total[right] - total[hi + 1] < 2 * words:
                right += 1
            out.append((key, at[lo], at[hi], hashes[left:lo][::-1], at[left:lo][::-1], hashes[hi + 1:right],
                        at[hi + 1:right]))
    return out


def _slices(batch: pa.RecordBatch):
    """Parts of a batch of at most SLICE_BYTES of text each, or of one row."""
    start, held = 0, 0
    for k, t in enumerate(batch.column(2)):
        size = len(t.as_py()) if t.is_valid else 0
        if held and held + size > SLICE_BYTES:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if start < len(batch):
        yield batch.slice(start)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window_words: int = WINDOW_WORDS) -> DataFrame:
    """(id, th, cuts): per document with later repeats, its runs of lines [lo, hi] to delete (0-based, inclusive)."""

    def run(batches):
        hashes, places = pa.list_(pa.int64()), pa.list_(pa.int32())
        kinds = [pa.binary(), pa.int32(), pa.int32(), hashes, places, hashes, places]
        names = ["id", "th", "key", "lo", "hi", "before", "before_at", "after", "after_at"]
        for b in batches:
            for part in _slices(b):
                found = [grams(t.as_py(), window_words) if t.is_valid else [] for t in part.column(2)]
                owner = pa.array(np.repeat(np.arange(len(part)), [len(x) for x in found]))
                rows = [row for some in found for row in some]
                columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows) if rows else [()] * 7, kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(owner), part.column(1).take(owner), *columns], names)

    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"),
                      text_bytes(text_col).alias("t"))
    kind = dict(src.dtypes)["id"]
    found = cut(src.mapInArrow(run, f"id {kind}, th long, key binary, lo int, hi int, before array<long>, "
                                     "before_at array<int>, after array<long>, after_at array<int>"), "winnow")
    place = F.struct(F.col("id").isNotNull().alias("some"), "id", "th", "lo", "hi", "before", "after")
    # written, so that the join below deals both sides out anew and can split a hot key
    firsts = cut(found.groupBy("key").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n"))
                 .where("n > 1").select(F.col("key").alias("first_key"), "f"), "winnow-first")
    later = found.join(firsts, F.col("key") == F.col("first_key")).where(
        ~(F.col("id").eqNullSafe(F.col("f.id")) & (F.col("th") == F.col("f.th")) & (F.col("lo") == F.col("f.lo"))))

    def alike(a: str, b: str):
        same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        stop = F.array_position(same, False)
        return F.when(stop == 0, F.size(same)).otherwise(stop - 1).cast("int")

    run_of = F.struct(
        F.coalesce(F.try_element_at("before_at", F.nullif("left", F.lit(0))), F.col("lo")).alias("lo"),
        F.coalesce(F.try_element_at("after_at", F.nullif("right", F.lit(0))), F.col("hi")).alias("hi"))
    runs = (later.withColumn("left", alike("before", "f.before")).withColumn("right", alike("after", "f.after"))
            .select("id", "th", run_of.alias("cut")))
    cuts = cut(runs.groupBy("id", "th").agg(F.collect_set("cut").alias("cuts")), "cuts")
    release(found)
    release(firsts)
    return cuts


def _joined(docs: DataFrame, id_col: str, text_col: str, window_words: int) -> DataFrame:
    """``docs`` with _cm_done = (text without the lines of its cuts, lines, lines deleted); texts stay in the JVM."""
    found = repeated_runs(docs, id_col, text_col, window_words).select(
        F.col("id").alias("_cm_id"), F.col("th").alias("_cm_th"), F.col("cuts").alias("_cm_cuts"))
    text = F.col(f"`{text_col}`")
    hashed = docs.withColumn("_cm_hash", F.xxhash64(text))
    same = hashed[id_col].eqNullSafe(found["_cm_id"]) & (hashed["_cm_hash"] == found["_cm_th"])
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda line, i: (F.btrim(line, F.lit(" \t\r\x0b\x0c")) == "") | ~F.exists(
        "_cm_cuts", lambda c: (c["lo"] <= i) & (i <= c["hi"])))
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1, F.lit(0)).cast("long")
    cut_text = F.when(F.col("_cm_cuts").isNotNull(), kept)
    done = F.struct(F.when(F.col("_cm_kept").isNotNull(), F.array_join("_cm_kept", "\n")).otherwise(text).alias("text"),
                    F.col("_cm_lines").alias("n_lines"),
                    F.when(F.col("_cm_kept").isNotNull(), F.col("_cm_lines") - F.size("_cm_kept")).otherwise(0)
                    .cast("long").alias("n_removed"))
    return (hashed.join(found, same, "left").withColumn("_cm_kept", cut_text).withColumn("_cm_lines", n_lines)
            .withColumn("_cm_done", done))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               window_words: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from ``text_col``; no row is dropped.

    ``n_chars``, if there is such a column, is counted again for the rows that change.
    """
    done = _joined(docs, id_col, text_col, window_words)
    changed = F.col("_cm_done.n_removed") > 0
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col("_cm_done.text").alias(c))
        elif c == "n_chars":
            out.append(F.when(changed, F.length("_cm_done.text").cast(dict(docs.dtypes)[c])).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return done.select(*out)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           window_words: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256, changed) per row."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    done = _joined(src, "doc_id", "text", window_words).select("doc_id", "_cm_done")
    return done.select("doc_id", "_cm_done.n_lines", "_cm_done.n_removed",
                       F.sha2(F.coalesce(F.col("_cm_done.text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
                       (F.col("_cm_done.n_removed") > 0).alias("changed"))


def query(spark, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"))
