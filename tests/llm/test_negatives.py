import random
from math import floor, isfinite

import numpy as np

from corpusmill.llm import negatives as N

from .util import collect

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, id string, b int, anchor int"
OUT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 0.5, 1, "x", 2, 3) for i, v, lab in rows], SCHEMA)


def brute(rows, anchor, k=5, low=80, high=100):
    once = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not isfinite(x) for x in v):
            continue
        row = (lab, [floor(256 * float(np.float32(x))) for x in v])
        once[i] = min(row, once.get(i, row))
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    out = set()
    for a, (lab, v) in once.items():
        if not anchor(a):
            continue
        scored = [(-dot(v, w), i, other) for i, (other, w) in once.items() if i != a]
        for s, p, _ in sorted(x for x in scored if x[2] == lab)[:k]:
            fit = sorted((t, n) for t, n, other in scored if other != lab and low * -s <= 100 * -t <= high * -s)
            out.update((a, p, r, n, -s, -t) for r, (t, n) in enumerate(fit[:k], 1))
    return out


def mined(spark, rows, modulus):
    some = N.usable(table(spark, rows))
    return set(collect(N.mine(some, some.where(f"id % {modulus} = 0")), *OUT))


def test_equals_all_pairs_over_several_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 60)
    monkeypatch.setattr(N, "GROUP", 20)
    monkeypatch.setattr(N, "STEP", 2)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + .5 * rng.standard_normal(8)], int(rng.integers(0, 4))) for i in range(400)]
    got, want = mined(spark, rows, 10), brute(rows, lambda i: i % 10 == 0)
    assert got == want and len(want) > 100


def test_ties_and_a_vector_that_a_third_of_the_rows_share(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 50)
    monkeypatch.setattr(N, "STEP", 1)
    rnd = random.Random(3)
    rows = [(i, [1.0, .5] if i % 3 == 0 else [rnd.choice([-.5, 0., .5, 1.]), rnd.choice([0., .5, 1.])], i % 2) for i in range(200)]
    assert mined(spark, rows, 7) == brute(rows, lambda i: i % 7 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [0.9, -1.0], 2), (2, [0.9, -1.0], 2), (3, None, 1), (4, [nan, 1.0], 1),
            (5, [inf, 0.0], 2), (6, [None, 1.0], 2), (7, [1.0, 0.0], None), (None, [1.0, 0.0], 2), (8, [0.95], 2),
            (9, [], 1), (10, [-1.0, 0.0], 1), (10, [1.0, 1.0], 0), (20, [-0.1, 0.3, 7.0], 3), (30, [1.0, 2.0], 3)]
    got = mined(spark, rows, 10)
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert (0, 1, 1, 10, 256 * 256, 256 * 256) in got
    assert mined(spark, [], 10) == set()


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0 ** 17, 1.0], 0), (1, [2.0 ** 17, 3.0], 0), (2, [2.0 ** 17, 2.0], 1), (3, [2.0 ** 17, 1.0], 1)]
    assert mined(spark, rows, 10) == brute(rows, lambda i: i % 10 == 0) != set()


def test_the_walk_stops_early_where_scores_are_uneven():
    rng = np.random.default_rng(5)
    vectors = np.floor(256 * rng.exponential(1, (4000, 4)) ** 2)
    block = N.Lists(np.arange(4000), rng.integers(0, 3, 4000), vectors)
    shown = [N.positives_of(block, i, int(block.labels[i]), vectors[i], 5)[2] for i in range(50)]
    assert np.mean(shown) < 1000


def test_query_moves_labels_of_every_seventh_row(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.standard_normal(4)], i % 10) for i in range(300)]
    table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    moved = [(i, v, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows]
    assert set(collect(N.query(spark, str(tmp_path)), *OUT)) == brute(moved, lambda i: i % 100 == 0)
