import random

from corpusmill.llm import linededup as L

from .util import collect, docs

W = L.WINDOW_WORDS


def brute(rows, window=W):
    """The texts that the definition leaves: grams of selected lines, first place, extension, deletion."""
    def parse(t):
        raw = t.split("\n")
        at = [i for i, x in enumerate(raw) if x.encode().strip()]
        return raw, at, [raw[i].encode().strip() for i in at]

    def near(lines, lo, hi):
        def some(seq):
            out, n = [], 0
            for x in seq:
                if n >= 2 * window:
                    break
                out.append(x)
                n += len(x.split())
            return out
        return some(lines[:lo][::-1]), some(lines[hi + 1:])

    import xxhash
    places = {}
    for key in sorted({(i is not None, i if i is not None else 0, xx(t), t) for i, t in rows if t is not None}):
        _, at, lines = parse(key[3])
        n = len(lines)
        size = [len(x.split()) for x in lines]

        def reach(i):
            for j in range(i, n):
                if sum(size[i:j + 1]) >= window:
                    return j
            return None

        def back(j):
            for i in range(j, -1, -1):
                if sum(size[i:j + 1]) >= window:
                    return i
            return None

        chosen = set()
        for i in range(n):
            if reach(i) is not None:
                span = range(i, reach(i) + 1)
                chosen.add(min(span, key=lambda j: (xxhash.xxh64_intdigest(lines[j]), -j)))
        runs = {(a, reach(a)) for a in chosen if reach(a) is not None} | {(back(a), a) for a in chosen if back(a) is not None}
        for lo, hi in sorted(runs):
            places.setdefault(tuple(lines[lo:hi + 1]), []).append((key, lo, hi, near(lines, lo, hi)))
    gone = {}
    for found in places.values():
        found.sort(key=lambda x: (x[0][:3], x[1]))
        _, _, _, (before, after) = found[0]
        for key, lo, hi, (b, a) in found[1:]:
            left = next((i for i, (x, y) in enumerate(zip(b, before)) if x != y), min(len(b), len(before)))
            right = next((i for i, (x, y) in enumerate(zip(a, after)) if x != y), min(len(a), len(after)))
            gone.setdefault(key, set()).update(range(lo - left, hi + right + 1))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None))
            continue
        raw, at, _ = parse(t)
        drop = {at[j] for j in gone.get((i is not None, i if i is not None else 0, xx(t), t), ())}
        out.append((i, "\n".join(x for j, x in enumerate(raw) if j not in drop)))
    return out


def xx(t):
    import xxhash
    h = xxhash.xxh64_intdigest(t.encode(), 42)   # as Spark's xxhash64 of one string
    return h - (1 << 64) if h >> 63 else h


def cases(seed):
    rnd = random.Random(seed)
    pool = [" ".join(f"t{rnd.randrange(60)}" for _ in range(rnd.choice([1, 2, 3, 5, 9, 20, 60]))) for _ in range(30)]
    rows = [(None, pool[4] + "\n" + pool[5]), (1, None), (2, ""), (3, "\n\n \n"), (4, pool[4] + "\n\n" + pool[5])]
    for i in range(10, 60):
        lines = []
        while len(lines) < rnd.randrange(1, 12):
            a = rnd.randrange(len(pool))
            lines += pool[a:a + rnd.randrange(1, 5)] if rnd.random() < .6 else [f"own {i} " * rnd.randrange(1, 9)]
            if rnd.random() < .2:
                lines.append(rnd.choice(["", "  ", "\t"]))
        rows.append((i, "\n".join(lines)))
    rows += [rows[12], rows[12], (500, rows[12][1]), (12, "  " + pool[7] + "\r\n" + pool[7] + "\n" + pool[7])]
    return rows


def test_line_dedup_matches_definition(spark):
    for seed in (1, 2):
        rows = cases(seed)
        df = docs(spark, rows)
        out = L.line_dedup(df)
        assert out.columns == df.columns
        assert sorted(collect(out, "doc_id", "text"), key=str) == sorted(brute(rows), key=str)


def test_guarantee_and_first_place(spark):
    rnd = random.Random(6)
    run = [f"run line {k} " + " ".join(f"r{k}{j}" for j in range(rnd.randrange(2, 6))) for k in range(6)]
    passage = " ".join(f"p{j}" for j in range(70))
    rows = []
    for i in range(30):
        own = [f"doc {i} line {k} " + " ".join(f"d{i}x{k}y{j}" for j in range(6)) for k in range(8)]
        at = rnd.randrange(9)
        rows.append((i, "\n".join(own[:at] + (run if i % 3 == 0 else [passage] if i % 3 == 1 else []) + own[at:])))
    got = dict(collect(L.line_dedup(docs(spark, rows)), "doc_id", "text"))
    for i, t in rows:
        lines, left = t.split("\n"), got[i].split("\n")
        if i in (0, 1) or i % 3 == 2:
            assert left == lines          # first places and clean documents stay as they are
        else:
            assert left == [x for x in lines if x not in run and x != passage]
    seen = {x.strip() for _, t in cases(4) if t for x in t.split("\n")}
    kept = {x.strip() for t, in collect(L.line_dedup(docs(spark, cases(4))), "text") if t for x in t.split("\n")}
    assert kept >= seen - {""}   # no line vanishes from the corpus


def test_report_and_empty_table(spark):
    r = L.report(docs(spark, [(1, "a b c d e f g h i\nx"), (2, "a b c d e f g h i\ny"), (3, None)]))
    assert sorted(collect(r, "doc_id", "n_lines", "n_removed", "changed")) == [
        (1, 2, 0, False), (2, 2, 1, True), (3, 0, 0, False)]
    assert L.line_dedup(docs(spark, [])).count() == 0


def test_large_ids_beside_a_null_stay_exact(spark):
    line, big = "a line of more than eight words in all here", 2**62 + 1
    got = dict(collect(L.line_dedup(docs(spark, [(big, line), (None, "x\n" + line), (big + 2, line)])), "doc_id", "text"))
    assert got == {None: "x\n" + line, big: "", big + 2: ""}
