"""Vector and prediction metrics on literal inputs (FIXTURES A)."""

import math

from corpusmill.operators import metrics as M
from corpusmill.operators import vecmetrics as VM


def _vecs(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")


def test_alignment(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 1.0], [0.0, 1.0])], "u array<float>, v array<float>")
    assert abs(VM.alignment(df, "u", "v").first()[0]) < 1e-6
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "u array<float>, v array<float>")
    assert abs(VM.alignment(df, "u", "v").first()[0] - 2.0) < 1e-6


def test_uniformity(spark):
    assert abs(VM.uniformity(_vecs(spark, [[1.0, 0.0], [1.0, 0.0]]), "vec_id", "embedding").first()[0]) < 1e-6
    got = VM.uniformity(_vecs(spark, [[1.0, 0.0], [0.0, 1.0]]), "vec_id", "embedding").first()[0]
    assert abs(got + 4.0) < 1e-6


def test_uniformity_blocks_equal_single_block(spark):
    rows = [[math.cos(i), math.sin(i), (i % 5) / 5.0] for i in range(60)]
    one = VM.uniformity(_vecs(spark, rows), "vec_id", "embedding", block_rows=1000).first()[0]
    many = VM.uniformity(_vecs(spark, rows), "vec_id", "embedding", block_rows=7).first()[0]
    assert abs(one - many) < 1e-9


def test_cosine_topk_blocks(spark):
    rows = [[math.cos(i / 3), math.sin(i / 3)] for i in range(40)]
    e = _vecs(spark, rows)
    a = [tuple(r) for r in VM.cosine_topk(e, e, 3, "vec_id", "vec_id", "embedding", True, 1000).collect()]
    b = [tuple(r) for r in VM.cosine_topk(e, e, 3, "vec_id", "vec_id", "embedding", True, 6).collect()]
    assert sorted(a) == sorted(b) and len(a) == 120


def test_classification_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (1, 1)], "p int, y int")
    r = M.classification_metrics(df, "p", "y").first()
    assert r.accuracy == 0.6 and abs(r.f1 - 2 / 3) < 1e-6


def test_spearman_average_ranks(spark):
    import pandas as pd
    p = [1.0, 2.0, 3.0, 3.0, 7.0, 2.0, 5.0]
    y = [2.0, 2.0, 5.0, 1.0, 9.0, 4.0, 4.0]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(p, y))], "i long, p double, y double")
    r = M.regression_metrics(df, "p", "y", ["i"]).first()
    expected = pd.Series(p).rank(method="average").corr(pd.Series(y).rank(method="average"))
    assert abs(r.spearmanr - expected) < 1e-6
    assert abs(r.pearson - pd.Series(p).corr(pd.Series(y))) < 1e-6


def test_exact_median(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", 1.0), ("b", 4.0)], "g string, v double")
    assert {r.g: r.median for r in M.exact_median(df, ["g"], "v").collect()} == {"a": 2.0, "b": 2.5}


def test_token_accuracy(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [9, 1, 2, 3])], "p array<int>, y array<int>")
    assert M.token_accuracy(df, "p", "y", shift=True).first()[0] == 1.0
    df = spark.createDataFrame([([1, 2, 3], [1, -100, 4])], "p array<int>, y array<int>")
    assert M.token_accuracy(df, "p", "y", ignore_masked=True).first()[0] == 0.5


def test_task_metrics_dispatch(spark):
    df = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (2, 0, 0), (3, 0, 1), (4, 1, 1)], "i long, p int, y int")
    assert M.task_metrics(df, "cola", "p", "y", ["i"]).columns == ["matthews_correlation"]
    assert M.task_metrics(df, "mrpc", "p", "y", ["i"]).columns == ["f1", "accuracy", "combined_score"]
    assert M.task_metrics(df, "JNLI", "p", "y", ["i"]).columns == ["accuracy"]
    assert M.sentence_columns("qnli", []) == ("question", "sentence")
    assert M.sentence_columns(None, ["a", "label", "b", "c"]) == ("a", "b")


def test_queries_without_relevant_documents_take_no_part(spark):
    from corpusmill.operators import vecmetrics as VM
    ranked = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 10)], "query_id int, rank int, doc_id int")
    relevant = spark.createDataFrame([(1, 10), (3, 99)], "query_id int, doc_id int")
    assert VM.ir_metrics(ranked, relevant.where("query_id = 1")).first().accuracy_at_1 == 1.0
    assert VM.ir_metrics(ranked, relevant).first().accuracy_at_1 == 0.5       # query 3 has one, but found nothing


def test_pooling_of_empty_sequences_and_first_token(spark):
    from corpusmill.operators import vecmetrics as VM
    rows = [("a", 0, [9.0, 9.0], False), ("a", 1, [1.0, 3.0], True), ("a", 2, [3.0, 5.0], False)]
    t = spark.createDataFrame(rows, "g string, p int, v array<double>, bos boolean")
    assert VM.pool(t, "g", "p", "v", "bos", bos_col="bos").first().pooled == [1.0, 3.0]
    assert VM.pool(t, "g", "p", "v", "mean", last_n=0).first().pooled == [0.0, 0.0]
    every = spark.createDataFrame([("a",), ("b",)], "g string")
    got = {r.g: r.pooled for r in VM.pool(t, "g", "p", "v", "mean", last_n=2, sequences=every, dim=2).collect()}
    assert got == {"a": [2.0, 4.0], "b": [0.0, 0.0]}


def test_vector_search_with_string_ids_and_small_blocks(spark):
    from corpusmill.operators import vecmetrics as VM
    df = spark.createDataFrame([(f"v{i}", [float(i % 5), 1.0]) for i in range(30)], "k string, embedding array<double>")
    one = VM.cosine_topk(df, df, 4, "k", "k", "embedding", True).orderBy("query_id", "rank").collect()
    many = VM.cosine_topk(df, df, 4, "k", "k", "embedding", True, block_rows=7).orderBy("query_id", "rank").collect()
    assert one == many and len(one) == 120


def test_median_of_one_hot_value(spark):
    from corpusmill.operators import metrics as M
    df = spark.createDataFrame([("g", 0.0)] * 500 + [("g", float(i)) for i in range(400)] + [("h", 2.0), ("h", 4.0)],
                               "g string, x double")
    assert {r.g: r.median for r in M.exact_median(df, ["g"], "x").collect()} == {"g": 0.0, "h": 3.0}


def test_block_pairs_are_multiplied_in_strips():
    """A block pair's products never exist all at once (3000 x 3000 doubles are 72 MB)."""
    import tracemalloc

    import numpy as np

    a, ids = np.random.default_rng(1).normal(size=(3000, 4)), np.arange(3000)
    for work in (lambda: VM._pair_best(a, a, ids, ids, 2, 6, True), lambda: VM._pair_sum(a, a, 2.0, True)):
        tracemalloc.start()
        got = work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40e6
    d2 = ((a[:300, None] - a[None, :300]) ** 2).sum(2)[np.triu_indices(300, k=1)]
    total, count = VM._pair_sum(a[:300], a[:300], 2.0, True)
    assert got[1] == 3000 * 2999 // 2 and count == 300 * 299 // 2 and abs(total - np.exp(-2 * d2).sum()) < 1e-6
    q, d, s = VM._pair_best(a[:300], a[:300], ids[:300], ids[:300], 2, 6, True)
    assert (s.reshape(300, 2)[:, 0] >= s.reshape(300, 2)[:, 1]).all() and (q != d).all()


def test_cosine_topk_copies_no_vectors(spark, monkeypatch):
    """Every vector was shuffled once a block; now queries stay with their lists, and rows that repeat or tie are ranked alike."""
    rows = [(i // 2, [math.cos(i % 9), math.sin(i % 9)]) for i in range(50)] + [(99, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(VM, "PIECE_BYTES", 1)
    found = VM.cosine_topk(df, df, 6, "vec_id", "vec_id", "embedding", True, block_rows=7)
    assert "FlatMapGroups" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "bi#" not in plan
    want = []
    for q in sorted({i for i, _ in rows}):
        pairs = [(-round(sum(x * y for x, y in zip(u, v)) / max(math.hypot(*u) * math.hypot(*v), 1e-12), 6), d)
                 for i, u in rows if i == q for d, v in rows if d != q]
        want += [(q, r + 1, d, -s) for r, (s, d) in enumerate(sorted(pairs)[:6])]
    got = sorted(map(tuple, found.collect()))
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(x[3] - y[3]) < 2e-6 for x, y in zip(got, want))
