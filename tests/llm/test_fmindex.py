import hashlib
import random

import numpy as np

from corpusmill.llm import fmindex as FM

from .util import collect, docs, words


def brute(texts, items, length=10):
    """[(word count, hit mask, item ids)] by trying every window at every word."""
    windows = {}
    for item, text in items:
        w = FM.words_of(None if text is None else text.encode())
        n = min(length, len(w))
        if n:
            for a in range(len(w) - n + 1):
                windows.setdefault(tuple(w[a:a + n]), set()).add(item)
    out = []
    for t in texts:
        w = FM.words_of(None if t is None else t.encode())
        mask, got = [False] * len(w), set()
        for win, ids in windows.items():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a:a + len(win)]) == win:
                    mask[a:a + len(win)] = [True] * len(win)
                    got |= ids
        out.append((len(w), mask, got))
    return out


def test_suffix_order_and_index():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 60, 700):
        for top in (1, 2, 5):
            text = np.append(rng.integers(0, top + 1, n), 0)
            # sentinels rank by position, below every word
            key = [[(0, j) if v == 0 else (1, int(v)) for j, v in enumerate(text.tolist())][i:] for i in range(len(text))]
            assert FM.suffix_order(text).tolist() == sorted(range(len(text)), key=key.__getitem__)
            if text.any():
                index = FM.FMIndex(text)
                for i in range(len(text) - 3):
                    if text[i:i + 3].all():
                        low, high = index.ranges(text[i:i + 3][None, :])
                        spots = sorted(index.locate(np.arange(low[0], high[0])).tolist())
                        assert spots == [j for j in range(len(text) - 2) if (text[j:j + 3] == text[i:i + 3]).all()]


def test_shards_of_any_size_agree_with_brute_force(monkeypatch):
    rnd = random.Random(5)
    for _ in range(60):
        texts = [" ".join(rnd.choice("abcx") for _ in range(rnd.randrange(60))) for _ in range(rnd.randrange(1, 9))]
        items = [(str(i), " ".join(rnd.choice("abc") for _ in range(rnd.randrange(9)))) for i in range(4)]
        length = rnd.choice([2, 3, 5])
        monkeypatch.setattr(FM, "SHARD_WORDS", rnd.choice([6, 40, 1000]))
        windows = FM.Windows([(i, FM.words_of(t.encode())) for i, t in items], length)
        got = FM.scan_texts([t.encode() for t in texts], windows)
        for (n, mask, ids), (bn, bmask, bids) in zip(got, brute(texts, items, length)):
            assert (n, ids) == (bn, bids) and (mask.tolist() if mask is not None else [False] * n) == bmask


def cases():
    rnd = random.Random(8)
    items = [(i, " ".join(words(rnd, rnd.randrange(3, 40)))) for i in range(12)]
    items += [(20, "Short  one"), (21, None), (22, "!!"), (3, items[4][1]), (None, "no id here at all " * 3)]
    rows = [(None, "x y"), (1, None), (2, ""), (3, "?!"), (4, "a SHORT, one! b"), (5, items[0][1]), (5, items[0][1])]
    for i in range(10, 40):
        body = words(rnd, rnd.randrange(200))
        if i % 2:
            passage = items[i % 12][1].split()
            at = rnd.randrange(len(body) + 1)
            body[at:at] = [w.upper() if rnd.random() < .3 else w for w in passage[: rnd.randrange(1, len(passage) + 1)]]
        rows.append((i, " - ".join(body)))
    rows.append((99, ("lead " + items[2][1] + " tail ") * 3 + "no id here at all no id here at all"))
    return rows, items


def test_report_matches_brute_force(spark, monkeypatch):
    rows, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for (d, _), (n, mask, ids) in zip(rows, brute([t for _, t in rows], items)):
        names = sorted(str(x) for x in ids if x is not None)
        want.append((d, n, sum(mask), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), any(mask)))
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(collect(FM.report(docs(spark, rows), bench), *cols), key=str) == sorted(want, key=str)
    monkeypatch.setattr(FM, "BLOCK_BYTES", 300)   # several blocks of test phrases
    assert sorted(collect(FM.report(docs(spark, rows), bench), *cols), key=str) == sorted(want, key=str)


def test_removal_cuts_exactly_the_hit_words(spark):
    rows, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, rows)
    out = FM.remove_contamination(df, bench)
    assert out.columns == df.columns and out.count() == len(rows)
    got = {(d, c): t for d, t, c in collect(out.where("doc_id != 5"), "doc_id", "text", "n_chars")}
    for (d, t), (n, mask, _) in zip(rows, brute([t for _, t in rows], items)):
        if d in (5, None):
            continue
        text = next(x for (i, _), x in got.items() if i == d)
        if not any(mask):
            assert text == t
        else:
            left = [w for w, m in zip(FM.words_of(t.encode()), mask) if not m]
            assert FM.words_of(text.encode()) == left and (d, len(text)) in got


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    df = docs(spark, [(1, "a b"), (2, None)])
    assert sorted(collect(FM.report(df, none), "doc_id", "n_words", "contaminated")) == [(1, 2, False), (2, 0, False)]
    assert FM.report(docs(spark, []), none).count() == 0
    assert sorted(collect(FM.remove_contamination(df, none), "doc_id", "text"), key=str) == [(1, "a b"), (2, None)]
