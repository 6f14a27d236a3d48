"""Toxicity: a counterfactual-regularised classifier.

Features of a text are its distinct words and their beginnings of four, five and
six letters (so inflected forms of one stem share a feature).  Spark counts each
feature by label over a bounded sample of labelled rows; the ``FEATURES`` most
telling ones are kept.  A logistic regression over their presence minimises

    mean log loss + l2 * |w|^2 + counterfactual * mean (f(x) - f(x'))^2

where x' is a labelled text with its identity terms swapped for another term of
the same group (``IDENTITY_GROUPS``, a parameter) and f is the score before the
logistic function.  A group that insults happen to be aimed at in the sample so
gets no weight of its own, and a neutral mention raises no alarm.

Scoring is one narrow pass over all rows: words of a text, looked up among the
kept features.  Labels come only from rows whose crc32(doc_id as text) mod 5 is
not 0; labels, lang, source and doc_id are no inputs of a score.

The sample is bounded by ``SAMPLE_ROWS``; the driver holds the counts of kept
features and a presence matrix of at most SAMPLE_ROWS x FEATURES entries.

Defined cases: a null text scores as an empty one (the intercept); an id with
several labels takes the larger; null labels teach nothing; without usable
labels of both classes every score is the share of label 1 (0.5 if there is
none); repeated rows are all scored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, read
from .quality import _sigmoid, sample

#: Labelled rows of a fit at most; features kept; weights of the penalties; score from which a text is toxic.
SAMPLE_ROWS, FEATURES, L2, COUNTERFACTUAL, THRESHOLD = 12000, 600, 1e-4, 1.0, 0.5

#: Identity terms, by group; each term is swapped for every other one of its group.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)

_WORD = re.compile(r"[^\W_]+")
BEGINNINGS = (4, 5, 6)


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(words: set[str]) -> set[str]:
    """Whole words ("=word") and beginnings ("4:begi", ...)."""
    out = {"=" + w for w in words}
    for n in BEGINNINGS:
        out.update(f"{n}:{w[:n]}" for w in words if len(w) >= n)
    return out


def swapped(words: set[str], groups=IDENTITY_GROUPS) -> list[set[str]]:
    """The counterfactual word sets: each identity term replaced by each other term of its group."""
    out = []
    for group in groups:
        for term in group:
            if term in words:
                out.extend((words - {term}) | {other} for other in group if other != term)
    return out


def fit(x: np.ndarray, y: np.ndarray, pairs: np.ndarray, l2: float = L2, counterfactual: float = COUNTERFACTUAL,
        rounds: int = 400) -> tuple[float, np.ndarray]:
    """(intercept, weights); ``pairs`` holds f-features of x minus those of x', a row for each counterfactual."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y) or not x.shape[1]:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return math.log(share / (1 - share)), np.zeros(x.shape[1])
    gram = pairs.T @ pairs / max(1, len(pairs))

    def largest(a):  # power iteration: a bound of the curvature
        v = np.ones(a.shape[0]) / math.sqrt(a.shape[0])
        for _ in range(30):
            v = a @ v
            v /= np.linalg.norm(v) + 1e-12
        return float(v @ a @ v)

    bound = 0.25 * (largest(x.T @ x / len(y)) + 1) * 1.1 + l2 * 2 + 2 * counterfactual * largest(gram) * 1.1
    w, b, v, vb, t = np.zeros(x.shape[1]), math.log(share / (1 - share)), np.zeros(x.shape[1]), None, 1.0
    vb = b
    for _ in range(rounds):  # accelerated gradient
        g = (_sigmoid(x @ v + vb) - y) / len(y)
        new = v - (x.T @ g + 2 * l2 * v + 2 * counterfactual * (gram @ v)) / bound
        nb = vb - g.sum() / bound
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return float(b), w


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS,
          kept: int = FEATURES, groups=IDENTITY_GROUPS, id_col: str = "doc_id",
          text_col: str = "text") -> tuple[float, dict[str, float]]:
    """(intercept, weight by feature), fitted on a bounded sample of labelled rows."""

    def run(batches):
        for b in batches:
            for part in range(0, len(b), 500):
                some = b.iloc[part:part + 500]
                words = [words_of(t) for t in some["text"]]
                swaps = [swapped(w, groups) for w in words]
                yield pd.DataFrame({
                    "y": some["y"].to_numpy(), "feats": [sorted(features(w)) for w in words],
                    "gone": [[sorted(features(w) - features(c)) for c in s] for w, s in zip(words, swaps)],
                    "come": [[sorted(features(c) - features(w)) for c in s] for w, s in zip(words, swaps)]})

    rows = cut(sample(docs, labels, label_col, sample_rows, id_col, text_col).select("text", "y").mapInPandas(
        run, "y int, feats array<string>, gone array<array<string>>, come array<array<string>>"), "toxic")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    n, p = size["n"], size["p"]
    if not n or p in (0, n):
        share = min(max(p / n if n else 0.5, 1e-3), 1 - 1e-3)
        return math.log(share / (1 - share)), {}
    # how far the feature's share of label 1 is from the whole, in standard errors
    seen = (rows.select("y", F.explode("feats").alias("f")).groupBy("f")
            .agg(F.count(F.lit(1)).alias("k"), F.sum("y").alias("ky")).where("k >= 5"))
    rate = p / n
    z = F.abs(F.col("ky") - F.col("k") * rate) / F.sqrt(F.col("k") * (rate * (1 - rate)))
    top = seen.select("f", z.alias("z")).where("z >= 4").orderBy(F.desc("z"), "f").limit(kept)
    names = [r["f"] for r in top.collect()]     # bounded: at most ``kept`` rows
    if not names:
        return math.log(rate / (1 - rate)), {}
    at = {f: i for i, f in enumerate(names)}
    wanted = F.array(*[F.lit(f) for f in names])
    few = rows.select("y", F.array_intersect("feats", wanted).alias("feats"),
                      F.transform("gone", lambda a: F.array_intersect(a, wanted)).alias("gone"),
                      F.transform("come", lambda a: F.array_intersect(a, wanted)).alias("come"))
    # bounded by sample_rows x kept; sorted here, so that a fit does not depend on the order of partitions
    table = sorted(few.collect(), key=lambda r: (r["y"], r["feats"], r["gone"], r["come"]))
    x, pairs = np.zeros((len(table), len(names))), []
    for i, r in enumerate(table):
        x[i, [at[f] for f in r["feats"]]] = 1
        for gone, come in zip(r["gone"], r["come"]):
            d = np.zeros(len(names))
            d[[at[f] for f in gone]] = 1
            d[[at[f] for f in come]] -= 1
            if d.any():
                pairs.append(d)
    b, w = fit(x, np.array([r["y"] for r in table], float), np.array(pairs).reshape(len(pairs), len(names)))
    return b, dict(zip(names, w.tolist()))


def score(docs: DataFrame, model: tuple[float, dict[str, float]], text_col: str = "text",
          score_col: str = "score") -> DataFrame:
    """Add the probability that a text is toxic; one narrow pass."""
    intercept, weights = model
    whole = {f[1:]: w for f, w in weights.items() if f[0] == "="}
    starts = [(n, {f[2:]: w for f, w in weights.items() if f.startswith(f"{n}:")}) for n in BEGINNINGS]

    def one(text: str | None) -> float:
        words = words_of(text)
        total = intercept + sum(map(whole.__getitem__, sorted(words & whole.keys())))
        for n, known in starts:
            if known:
                total += sum(map(known.__getitem__, sorted({w[:n] for w in words} & known.keys())))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype="float64")

    return docs.withColumn(score_col, probability(F.col(f"`{text_col}`")))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs, labels)
    out = score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score")
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
