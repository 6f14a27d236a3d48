import random
import zlib

import numpy as np
import pytest

from corpusmill.llm import quality as Q
from corpusmill.llm import toxicity as T
from corpusmill.llm.common import held_out

from .util import collect, docs, words

LABELS = "doc_id long, quality int, toxic int, text string"


def accuracy(df, truth):
    got = {r["doc_id"]: r for r in df.collect()}
    rows = [(got[i]["predicted"], y) for i, y in truth.items() if got[i]["held_out"]]
    return sum(p == y for p, y in rows) / len(rows)


def corpus(kind):
    rnd = random.Random(7)
    rows, truth = [], {}
    for i in range(600):
        w = words(rnd, rnd.randrange(5, 150))
        y = int(rnd.random() < .3)
        if kind == "toxic" and y:
            for _ in range(3):
                w.insert(rnd.randrange(len(w) + 1), rnd.choice(["idiot", "scumbag", "veque" + rnd.choice("abcdef")]))
        if kind == "quality" and not y:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x + "###" for x in w]
        rows.append((i, " ".join(w)))
        truth[i] = y
    return rows, truth


def test_held_out_is_crc32_of_the_decimal_id(spark):
    got = dict(collect(docs(spark, [(i, "") for i in range(200)]).select("doc_id", held_out().alias("h")), "doc_id", "h"))
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_query_on_held_out_rows(spark, tmp_path, kind):
    rows, truth = corpus(kind)
    odd = [(None, "null id"), (900, None), (901, ""), (902, "x " * 20000), rows[3], rows[3]]
    docs(spark, rows + odd).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, y, y, "clash") for i, y in truth.items()] + [(None, 1, 1, ""), (5000, 1, 1, ""), (3, None, None, "")]
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    out = (T if kind == "toxic" else Q).query(spark, str(tmp_path))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    assert accuracy(out.where("doc_id < 600"), truth) > .95
    # held-out labels never matter
    flipped = [(i, 1 - y, 1 - y, "") if zlib.crc32(str(i).encode()) % 5 == 0 else (i, y, y, "") for i, y in truth.items()]
    spark.createDataFrame(flipped, LABELS).write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    again = (T if kind == "toxic" else Q).query(spark, str(tmp_path))
    assert sorted(collect(again, "doc_id", "score"), key=str) == sorted(collect(out, "doc_id", "score"), key=str)


def test_no_labels_and_one_class(spark):
    df = docs(spark, [(i, "a b c") for i in range(60)])
    none, ones = spark.createDataFrame([], LABELS), spark.createDataFrame([(i, 1, 1, "") for i in range(60)], LABELS)
    for labels, want in ((none, .5), (ones, .999)):
        for got in (Q.score(df, Q.train(df, labels)), T.score(df, T.train(df, labels))):
            assert {round(r["score"], 3) for r in got.collect()} == {want}
    empty = docs(spark, [])
    assert Q.keep_good(empty, none).count() == 0 and T.score(empty, T.train(empty, none)).count() == 0


def test_rules_as_columns_equal_the_model(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(Q.STATISTICS)))
    y = ((x[:, 3] > .6) & (x[:, 5] < .7) | (x[:, 1] < .1)).astype(float)
    model = Q.fit(x, y)
    assert 0 < len(model[1]) < 200
    z = model[0] + sum(w * np.all([(x[:, f] <= c) if low else (x[:, f] > c) for f, low, c in r], axis=0) for w, r in model[1])
    frame = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], ["i", *Q.STATISTICS])
    from pyspark.sql import functions as F
    got = dict(collect(frame.select("i", Q.compile_rules(model, F.struct(*Q.STATISTICS)).alias("p")), "i", "p"))
    assert np.allclose([got[i] for i in range(len(x))], 1 / (1 + np.exp(-z)))
    assert (((1 / (1 + np.exp(-z))) > .5) == y).mean() > .95


def test_keep_good_keeps_clean_rows_whole(spark):
    rows, truth = corpus("quality")
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, y, 0, "") for i, y in truth.items()], LABELS)
    kept = Q.keep_good(df, labels)
    assert kept.columns == df.columns
    ids = {i for i, in collect(kept, "doc_id")}
    assert ids == {i for i, y in truth.items() if y}


def test_counterfactual_penalty_frees_neutral_mentions(spark):
    """A group that insults often aim at gets no weight of its own."""
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(800):
        w = words(rnd, 30)
        toxic = int(rnd.random() < .4)
        if toxic:
            w[rnd.randrange(30)] = "idiot" if rnd.random() < .6 else "fool"
        if rnd.random() < (.8 if toxic else .05):
            w[rnd.randrange(30)] = "muslim"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic, ""))
    df, known = docs(spark, rows), spark.createDataFrame(labels, LABELS)
    test = docs(spark, [(1, "the muslim family met for dinner"), (2, "what an idiot"), (3, "the family met for dinner")])
    score = dict(collect(T.score(test, T.train(df, known), score_col="p"), "doc_id", "p"))
    free = dict(collect(T.score(test, T.train(df, known, groups=()), score_col="p"), "doc_id", "p"))
    assert free[1] - free[3] > .1                       # without the penalty a neutral mention raises the score
    assert abs(score[1] - score[3]) < (free[1] - free[3]) / 3 and score[1] < .5 < score[2]
