"""Hard-negative mining with Fagin's threshold algorithm.

Every block of candidates holds one list per dimension, sorted by the component.
An anchor walks all lists at once, from the end that its component's sign favours
(**anchor-signed sorted access**); every candidate that any list shows is scored by
its whole integer inner product (**random access**).  After a step the
**threshold**, the inner product of the anchor with the last component seen in each
list, bounds every candidate not yet shown.  The walk ends once the threshold lies
strictly below the k-th best score that still counts, so ties are all seen.

Two walks over the same blocks:

1. *Positives*: the k best other rows of the anchor's label.
2. *Negatives*: every positive of score p opens the window
   ``low * p <= 100 * score <= high * p`` over the rows of other labels.  One walk
   serves all windows of an anchor; a window is done when the threshold falls
   strictly below its k-th score, or below its floor, and the walk ends when all are.

Scale: rows are dealt into blocks of about ``BLOCK`` by a hash of the id, anchors
into groups of about ``GROUP``; a task holds one block and one group, both bounded
whatever the table's size or the commonness of a label or vector.  Nothing is
broadcast and nothing passes through the driver but two row counts.  A block
returns at most k rows an anchor (or window), and a window function per anchor
picks the final ones.  With many dimensions and vectors that spread evenly the
threshold falls late and most or all of a block is scored: results are exact either
way, and README.md says how much it was.

Defined cases: rows with a null id, null label, null vector or a null or
non-finite component take no part; rows that share an id are one row (the smallest
label, then the smallest vector); a vector shorter than another counts as padded
with zeros; components are held within +-2^26 after scaling, so that scores fit a
long; ties go to the smaller id; an anchor without another row of its label, or a
window without a row, gives no rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read

#: Rows of a block, anchors of a group, depth of the first step (a step doubles the depth).
BLOCK, GROUP, STEP = 4096, 4096, 32
#: Largest absolute component after scaling.
LIMIT = 1 << 26


def usable(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
           scale: int = 256) -> DataFrame:
    """(id, label, v): the rows that take part, one per id, with integer components floor(scale * x)."""
    fine = (F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()
            & F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    held = F.transform("x", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT))))
                       .cast("int"))
    some = (rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                        F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
            .where(fine).select("id", F.struct("label", held.alias("v")).alias("row")))
    return some.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.v")


class Lists:
    """The sorted lists of a block and the threshold walk over them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.rising = np.argsort(vectors, axis=0, kind="stable").astype(np.int32).T.copy()
        self.values = np.take_along_axis(vectors, self.rising.T, axis=0).T.copy()

    def walk(self, anchor: np.ndarray, done) -> tuple[np.ndarray, np.ndarray]:
        """(rows shown, their scores) once ``done(rows, scores, threshold)`` or the lists are read to their ends."""
        n, down = len(self.ids), anchor > 0
        seen = np.zeros(n, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)
        at, step = 0, STEP
        while at < n:
            stop = min(at + step, n)
            front, back = self.rising[~down, at:stop], self.rising[down, n - stop:n - at]
            shown = np.zeros(n, bool)
            shown[front.ravel()] = True
            shown[back.ravel()] = True
            fresh = np.flatnonzero(shown & ~seen)
            seen[fresh] = True
            rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, self.vectors[fresh] @ anchor])
            last = np.where(down, self.values[:, n - stop], self.values[:, stop - 1])
            if seen.all() or done(rows, scores, (last * anchor).sum()):
                break
            at, step = stop, stop
        return rows, scores

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Indices into ``rows`` of the k highest scores, ties by smaller id."""
        if len(rows) > 4 * k:
            few = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        else:
            few = np.arange(len(rows))
        return few[np.lexsort((self.ids[rows[few]], -scores[few]))][:k]


def _kth(scores: np.ndarray, k: int):
    return np.partition(scores, len(scores) - k)[len(scores) - k]


def positives_of(block: Lists, own: int, label: int, anchor: np.ndarray, k: int):
    """(rows, scores, rows shown): the block's k best other rows of the anchor's label."""
    mates = (block.labels == label) & (block.ids != own)

    def done(rows, scores, threshold):
        mine = scores[mates[rows]]
        return len(mine) >= k and threshold < _kth(mine, k)

    rows, scores = block.walk(anchor, done)
    mine = mates[rows]
    some, values = rows[mine], scores[mine]
    pick = block.best(some, values, k)
    return some[pick], values[pick], len(rows)


def negatives_of(block: Lists, label: int, anchor: np.ndarray, windows: list[int], k: int, low: int, high: int):
    """([(window, rows, scores)], rows shown): per window, the block's k best rows of other labels inside it."""
    others = block.labels != label

    def inside(p, values):
        return (100 * values >= low * p) & (100 * values <= high * p)

    def done(rows, scores, threshold):
        values = scores[others[rows]]
        for p in windows:
            if 100 * threshold < low * p:
                continue
            mine = values[inside(p, values)]
            if len(mine) < k or threshold >= _kth(mine, k):
                return False
        return True

    rows, scores = block.walk(anchor, done)
    mine = others[rows]
    some, values = rows[mine], scores[mine]
    out = []
    for p in windows:
        which = np.flatnonzero(inside(p, values))
        pick = which[block.best(some[which], values[which], k)]
        out.append((p, some[pick], values[pick]))
    return out, len(rows)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def _block(rows: pd.DataFrame, anchors: pd.DataFrame):
    """(Lists, anchor vectors): doubles, whose products are exact integers, or longs where those could be inexact."""
    width = max(int(rows["v"].map(len).max()), int(anchors["v"].map(len).max()), 1)
    vectors, points = _matrix(rows["v"], width), _matrix(anchors["v"], width)
    if int(np.abs(vectors).max()) * int(np.abs(points).max()) * width * 100 < 1 << 53:
        vectors, points = vectors.astype(float), points.astype(float)
    return Lists(rows["id"].to_numpy(), rows["label"].to_numpy(), vectors), points


def _by_block(rows: DataFrame, anchors: DataFrame, n_blocks: int, n_groups: int, run, schema: str) -> DataFrame:
    """``run(block rows, anchors)`` for every block and every group of anchors (aliases: both sides may be one table)."""
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("b"),
                        F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("g"),
                        *[F.col(c).alias(c) for c in ("id", "label", "v")])
    asked = anchors.select(F.explode(F.expr(f"sequence(0L, {n_blocks - 1}L)")).alias("b"),
                           F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_groups)).cast("int").alias("g"),
                           *[F.col(c).alias(c) for c in anchors.columns])
    return dealt.groupBy("b", "g").cogroup(asked.groupBy("b", "g")).applyInPandas(run, schema)


def mine(rows: DataFrame, anchors: DataFrame, k: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``usable`` rows.

    ``anchors`` are rows of the same form whose positives are sought among ``rows``.
    """
    n_blocks = max(1, -(-rows.count() // BLOCK))
    n_groups = max(1, -(-anchors.count() // GROUP))

    def positives(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(asked):
            block, points = _block(held, asked)
            for own, label, point in zip(asked["id"], asked["label"], points):
                some, values, _ = positives_of(block, own, label, point, k)
                out += [(own, label, block.ids[r], int(s)) for r, s in zip(some, values)]
        return pd.DataFrame(out, columns=["anchor", "label", "positive", "score"])

    found = _by_block(rows, anchors, n_blocks, n_groups, positives, "anchor long, label long, positive long, score long")
    first = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "positive"))
    kept = cut(found.withColumn("rank", first).where(F.col("rank") <= k).drop("rank"), "positives")
    windows = kept.groupBy("anchor").agg(F.sort_array(F.collect_set("score")).alias("windows"))
    asked = anchors.join(windows, F.col("id") == F.col("anchor")).drop("anchor")

    def negatives(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(asked):
            block, points = _block(held, asked)
            for own, label, point, some in zip(asked["id"], asked["label"], points, asked["windows"]):
                for p, which, values in negatives_of(block, label, point, [int(x) for x in some], k, low, high)[0]:
                    out += [(own, p, block.ids[r], int(s)) for r, s in zip(which, values)]
        return pd.DataFrame(out, columns=["owner", "window", "negative", "value"])

    near = _by_block(rows, asked, n_blocks, n_groups, negatives, "owner long, window long, negative long, value long")
    rank = F.row_number().over(Window.partitionBy("owner", "window").orderBy(F.desc("value"), "negative"))
    best = near.withColumn("rank", rank).where(F.col("rank") <= k)
    return (kept.join(best, (F.col("anchor") == F.col("owner")) & (F.col("score") == F.col("window")))
            .select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int"),
                    F.col("negative").alias("negative_id"), F.col("score").alias("positive_score"),
                    F.col("value").alias("negative_score")))


def query(spark, sf_dir: str) -> DataFrame:
    """Anchors: ids divisible by 100; ids divisible by 7 move to the next label of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = cut(usable(read(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")), "vectors")
    return mine(rows, rows.where("id % 100 = 0"))


ORACLE = """
WITH base AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM base a JOIN base b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
