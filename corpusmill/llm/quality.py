"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

1. Statistics of a text (shares of blanks, marks, capitals, digits, repeated
   words and lines, lengths) come from one pass over its bytes in a Pandas UDF:
   a byte histogram replaces a dozen passes of string functions.
2. Small trees are boosted on a bounded sample of labelled rows; every path
   from a root to an inner node or leaf is a conjunctive rule over statistics.
3. A lasso logistic regression (accelerated proximal gradient) over the rules'
   indicators leaves few of them with a weight.
4. The rules that stay become one Spark column expression over the statistics;
   scoring is a narrow projection, and the statistics of a row are computed once
   and bound to a lambda variable that all rules read.

The sample is bounded by the documented parameter ``sample_rows``: those labelled
training rows whose id hashes lowest.  Only their statistics (18 doubles a row)
reach the driver.  Scores cover every row of the documents.

Labels come only from rows whose crc32(doc_id as text) mod 5 is not 0; labels,
lang, source and doc_id are no inputs of a score.

Defined cases: a null text scores as an empty one; an id with several labels
takes the larger; null labels teach nothing; labels without a document are
skipped; without any usable label (or with one class only) every score is the
share of the good class, 0.5 if there is none; repeated rows are all scored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, read

#: Labelled rows that a fit takes at most; trees; depth of a tree; weight of the lasso; score from which a text is good.
SAMPLE_ROWS, TREES, DEPTH, LASSO, THRESHOLD = 6000, 60, 3, 0.001, 0.3

STATISTICS = ("log_bytes", "blank_share", "line_share", "upper_share", "digit_share", "hash_share", "exclaim_share",
              "pipe_share", "stop_share", "comma_share", "bracket_share", "mark_share", "word_length", "distinct_words",
              "distinct_lines", "log_words", "longest_line", "first_upper")

# The bytes that each share counts.
_SHARES = {"blank_share": b" \t\r\n", "line_share": b"\n", "upper_share": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
           "digit_share": b"0123456789", "hash_share": b"#$%&*", "exclaim_share": b"!", "pipe_share": b"|",
           "stop_share": b".", "comma_share": b",", "bracket_share": b"(){}[]<>=/\\", "mark_share": b"?:;'\"-_+~^@"}
_CLASS = np.zeros((256, len(_SHARES)))
for _no, _bytes in enumerate(_SHARES.values()):
    _CLASS[list(_bytes), _no] = 1


def text_statistics(text: bytes | None) -> tuple[float, ...]:
    """The statistics of a text's UTF-8 bytes (null: empty), in the order of STATISTICS."""
    t = text or b""
    shares = np.bincount(np.frombuffer(t, np.uint8), minlength=256) @ _CLASS / max(len(t), 1)
    words, lines = t.split(), t.split(b"\n")
    count = max(len(words), 1)
    return (math.log1p(len(t)), *shares.tolist(), len(t) / count, len(set(words)) / count, len(set(lines)) / len(lines),
            math.log1p(len(words)), math.log1p(max(map(len, lines))), float(t[:1].isupper()))


def statistics(text: Column) -> Column:
    """struct<double...> of a text, in the order of STATISTICS (one pass over its bytes, in batches)."""

    @F.pandas_udf(", ".join(f"{c} double" for c in STATISTICS))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_statistics(t) for t in texts], columns=STATISTICS, dtype="float64")

    return run(text.cast("binary"))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(text, y) of at most ``rows`` labelled training rows: those whose ids hash lowest."""
    known = (labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & ~held_out(id_col))
             .groupBy(F.col(f"`{id_col}`").alias("_cm_id")).agg(F.max(F.col(f"`{label_col}`")).cast("int").alias("y"))
             .orderBy(F.xxhash64("_cm_id"), "_cm_id").limit(rows))
    texts = docs.select(F.col(f"`{id_col}`").alias("_cm_doc"), F.col(f"`{text_col}`").alias("text"))
    # bounded: at most ``rows`` ids and labels are broadcast
    return texts.join(F.broadcast(known), F.col("_cm_doc") == F.col("_cm_id")).select("_cm_doc", "text", "y")


def _tree(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], target: np.ndarray, rows: np.ndarray, depth: int,
          path: tuple, rules: set, step: np.ndarray, rate: float) -> None:
    """Grow one regression tree; add each node's path to ``rules`` and the leaves' steps to ``step``."""
    best = (1e-9, None, None)
    if depth and len(rows) >= 20:
        part = target[rows]
        total, size = part.sum(), len(rows)
        base = total * total / size
        for f, cuts in enumerate(edges):
            if not len(cuts):
                continue
            b = bins[rows, f]
            n = np.cumsum(np.bincount(b, minlength=len(cuts) + 1))[:-1]
            s = np.cumsum(np.bincount(b, weights=part, minlength=len(cuts) + 1))[:-1]
            good = (n >= 8) & (size - n >= 8)
            if good.any():
                gain = np.where(good, s * s / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(size - n, 1) - base, 0)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], f, at)
    _, f, at = best
    if f is None:
        step[rows] += rate * target[rows].mean()
        return
    left = bins[rows, f] <= at
    for side, some in ((True, rows[left]), (False, rows[~left])):
        # a later condition on the same statistic and side is the narrower one
        here = tuple(sorted({**{(g, d): c for g, d, c in path}, (f, side): float(edges[f][at])}.items()))
        here = tuple((g, d, c) for (g, d), c in here)
        rules.add(here)
        _tree(x, bins, edges, target, some, depth - 1, here, rules, step, rate)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO,
        seed: int = 11) -> tuple[float, list[tuple[float, tuple]]]:
    """(intercept, [(weight, rule)]); a rule is a tuple of (statistic number, is "<=", threshold)."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 20 or share in (0.0, 1.0):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return math.log(share / (1 - share)), []
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    rng, rules = np.random.default_rng(seed), set()
    state = np.full(len(y), math.log(share / (1 - share)))
    for _ in range(trees):
        rows = np.sort(rng.choice(len(y), max(20, len(y) // 2), replace=False))
        step = np.zeros(len(y))
        _tree(x, bins, edges, y - _sigmoid(state), rows, int(rng.integers(1, depth + 1)), (), rules, step, 0.8)
        state += step
    rules = sorted(rules)
    hit = np.stack([np.all([(x[:, f] <= c) if low else (x[:, f] > c) for f, low, c in r], axis=0) for r in rules],
                   axis=1).astype(float)
    mean = hit.mean(axis=0)
    z = hit - mean
    # accelerated proximal gradient for mean log loss + lasso * |w|
    bound = 0.25 * (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    w, b, v, vb, t = np.zeros(len(rules)), math.log(share / (1 - share)), np.zeros(len(rules)), None, 1.0
    vb = b
    for _ in range(400):
        g = (_sigmoid(z @ v + vb) - y) / len(y)
        new = v - z.T @ g / bound
        new = np.sign(new) * np.maximum(np.abs(new) - lasso / bound, 0)
        nb = vb - g.sum() / bound
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    kept = [(float(a), r) for a, r in zip(w, rules) if a]
    return float(b - (w * mean).sum()), kept


def compile_rules(model: tuple[float, list[tuple[float, tuple]]], stats: Column) -> Column:
    """The model's probability as one column expression over a statistics struct."""
    intercept, rules = model

    def score(s: Column) -> Column:
        terms = [F.lit(intercept)]
        for weight, rule in rules:
            both = None
            for f, low, at in rule:
                one = s[STATISTICS[f]] <= at if low else s[STATISTICS[f]] > at
                both = one if both is None else both & one
            terms.append(F.when(both, weight).otherwise(0.0))
        while len(terms) > 1:  # a balanced sum keeps the expression shallow
            terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))

    return F.element_at(F.transform(F.array(stats), score), 1)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS,
          id_col: str = "doc_id", text_col: str = "text") -> tuple[float, list[tuple[float, tuple]]]:
    """Fit the rule ensemble on a bounded sample of labelled rows."""
    rows = (sample(docs, labels, label_col, sample_rows, id_col, text_col)
            .select("_cm_doc", "y", statistics(F.col("text")).alias("s")).select("_cm_doc", "y", "s.*")
            .limit(2 * sample_rows).toPandas().sort_values(["_cm_doc", *STATISTICS]))
    return fit(rows[list(STATISTICS)].to_numpy(float), rows["y"].to_numpy(float))


def score(docs: DataFrame, model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the probability that a text is good; narrow."""
    return docs.withColumn(score_col, compile_rules(model, statistics(F.col(f"`{text_col}`"))))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, columns unchanged."""
    model = train(docs, labels)
    scored = score(docs, model, score_col="_cm_score")
    return scored.where(F.col("_cm_score") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs, labels)
    out = score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score")
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
