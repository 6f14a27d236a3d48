import random
from itertools import combinations

import numpy as np
import xxhash

from corpusmill.llm import simhash as S

from .util import collect, docs, words


def brute_fingerprint(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    """Smallest id reachable over links of at most two bits; prints: [(id, fingerprint)]."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
            parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(prints):
        groups.setdefault(find(i), []).append(d)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(prints))]


def test_fingerprint_matches_definition():
    rnd = random.Random(3)
    texts = [None, "", " \t\n", "One", "one two", "A b\x0bC d", "é É ß ẞ x y z"] + [
        " ".join(words(rnd, rnd.randrange(1, 700))) for _ in range(40)]
    for t in texts:
        assert S.fingerprint(None if t is None else t.encode()) & (1 << 64) - 1 == brute_fingerprint(t)


def test_chunked_bit_counts():
    h = np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64)
    want = [int(((h >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]
    assert S.bit_counts(h).tolist() == want


def test_every_close_pair_meets_at_the_home_anchor():
    rng = np.random.default_rng(0)
    x = rng.integers(-2**63, 2**63 - 1, 300)
    row, anchor, _ = S.anchors(x, 0)
    assert row.tolist() == list(range(300))  # a perfect code: exactly one home
    for bits in (1, 2):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, bits, replace=False):
                y[i] ^= np.int64(-2**63) if b == 63 else np.int64(1) << np.int64(b)
        r, a, _ = S.anchors(y, 2)
        assert set(zip(row.tolist(), anchor.tolist())) <= set(zip(r.tolist(), a.tolist()))


def test_links_are_complete_and_unique(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-2**63, 2**63 - 1, 30)
    fps = {int(v) for v in base}
    for v in base:
        for _ in range(12):
            w = int(v) & (1 << 64) - 1
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                w ^= 1 << int(b)
            fps.add(w - (1 << 64) if w >> 63 else w)
    found = collect(S.links(spark.createDataFrame([(f,) for f in fps], "fp long")), "u", "v")
    want = {(a, b) for a, b in combinations(sorted(fps), 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert len(found) == len(set(found)) and set(found) == want


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (160, 159), (160, 159)]
    got = dict(collect(S.components(spark.createDataFrame(edges, "u long, v long")), "node", "root"))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 161)}}


def test_components_match_brute_force_with_odd_rows(spark):
    rnd = random.Random(9)
    rows = [(None, ""), (5, None), (4, "  "), (9, "x"), (None, "only null here " * 9)]
    for g in range(25):
        base = words(rnd, 400)
        rows.append((100 * g + 50, " ".join(base)))
        for c in range(3):
            copy = list(base)
            for _ in range(c):
                copy[rnd.randrange(len(copy))] = "zz"
            rows.append((100 * g + c + 10, " ".join(copy)))
    rows += [(1010, rows[30][1]), rows[20], rows[20]]
    out = S.near_duplicates(docs(spark, rows))
    got = sorted((d if d is not None else -1, f & (1 << 64) - 1, c if c is not None else -1)
                 for d, f, c in collect(out, "id", "fp", "component_id"))
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    want = sorted((d if d is not None else -1, f, c if c is not None else -1)
                  for (d, f), c in zip(prints, brute_components(prints)))
    assert got == want


def test_keep_one_keeps_columns_and_one_row_of_each_group(spark):
    rnd = random.Random(2)
    a, b = " ".join(words(rnd, 300)), " ".join(words(rnd, 300))
    df = docs(spark, [(3, a), (1, a), (1, a), (2, b), (None, a), (7, None), (8, "")])
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(collect(kept, "doc_id")) == [(1,), (2,), (7,)]


def test_empty_table(spark):
    df = docs(spark, [])
    assert S.near_duplicates(df).count() == 0 and S.keep_one(df).count() == 0


def test_large_ids_beside_a_null_stay_exact(spark):
    big = 2**62 + 1
    got = collect(S.near_duplicates(docs(spark, [(big, "a b c"), (None, "d e f"), (big + 2, "a b c")])), "id", "component_id")
    assert sorted(got, key=str) == sorted([(big, big), (big + 2, big), (None, None)], key=str)


def test_replicas_are_never_broadcast(spark):
    """Spark sizes 61 anchors a fingerprint like the fingerprints, and so broadcast a gigabyte of them."""
    prints = spark.createDataFrame([(i * 0x9E3779B97F4A7C15 % (1 << 62),) for i in range(50)], "fp long")
    plan = S.links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
