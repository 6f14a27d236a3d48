import numpy as np
import zlib

from corpusmill.llm import neighbours as N
from corpusmill.llm import sharding as S

from .util import collect, docs

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, v int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.0, 1, 2) for i, v in rows], SCHEMA)


def brute(rows, query, k):
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = set()
    for q, x in fine:
        if query(q):
            best = {}
            for i, y in fine:
                if i != q and len(y) == len(x):
                    d = float(np.sqrt(((y - x) ** 2).sum()))
                    best[i] = min(d, best.get(i, np.inf))
            out.update((q, r, i) for r, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:k], 1))
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 32)) * 3
    rows = [(i, [float(x) for x in centres[i % 20] + rng.standard_normal(32)]) for i in range(3000)]
    df = vectors(spark, rows)
    got = N.search(df, df.where("vec_id % 100 = 0"), 10).collect()
    want = brute(rows, lambda q: q % 100 == 0, 10)
    ids = {(q, i) for q, _, i in want}
    assert len(got) == len(want)
    assert len({(r["query_id"], r["vec_id"]) for r in got} & ids) / len(ids) >= .9
    at = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    assert all(abs(r["score"] - np.linalg.norm(at[r["query_id"]] - at[r["vec_id"]])) < 1e-12 for r in got)


def test_odd_rows_ties_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, -1.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [nan, 1.0]),
            (6, [0.0, 0.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, []), (10, [1.0, 2.0, 3.0]),
            (100, [1.0, 2.0, 4.0]), (200, [2.0] * 5)]
    df = vectors(spark, rows)
    got = set(collect(N.search(df, df.where("vec_id % 100 = 0"), 10), "query_id", "rank", "vec_id"))
    assert got == brute(rows, lambda q: q % 100 == 0, 10)
    assert got == {(0, 1, 3), (0, 2, 1), (0, 3, 2), (100, 1, 10)}


def test_blocks_and_query_chunks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) + 0.5]) for i in range(400)]
    df = vectors(spark, rows)
    monkeypatch.setattr(N, "QUERIES", 7)
    got = set(collect(N.search(df, df.where("vec_id % 20 = 0"), 5), "query_id", "rank", "vec_id"))
    want = brute(rows, lambda q: q % 20 == 0, 5)
    assert len(got & want) / len(want) >= .9 and len(got) == len(want)
    none = vectors(spark, [])
    assert N.search(none, none).count() == 0 and N.search(df, none).count() == 0


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(0).integers(-2**63, 2**63 - 1, 2000)
    for n in (1, 2, 16, 17, 1000):
        assert S.jump_hash(keys, n).tolist() == [jump(int(k) & (1 << 64) - 1, n) for k in keys]


def test_sharded(spark):
    rows = [(i, "text " * (i % 7)) for i in range(2000)] + [(None, "x"), (None, None), (5, "é"), (5, "é"), (6, "")]
    got = S.sharded(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = {}
    for r in got:
        assert r["law"] == "key" and 0 <= r["shard"] < 16
        assert r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    of = {}
    for r in got:
        assert of.setdefault(r["doc_id"], r["shard"]) == r["shard"]   # the key alone decides
    assert S.sharded(docs(spark, [])).count() == 0


def test_write_shards(spark, tmp_path):
    S.write_shards(docs(spark, [(i, "t") for i in range(300)]), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
