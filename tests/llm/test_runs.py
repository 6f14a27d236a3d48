import hashlib
import random
import zlib

from corpusmill.llm import runs as R

from .util import collect, docs, words


def brute(w, least=6, times=4):
    """Every run by its definition, period by period."""
    out = []
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q):
                part = w[i:i + size]
                if not any(all(part[x] == part[x + p] for x in range(size - p)) for p in range(1, q)):
                    out.append((i, size, q))
            i = j + 1
    return sorted(out)


def expected(doc_id, text):
    w = [] if text is None else text.encode().split()
    n = len(w)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *top, None if top[0] is None else 1000 * top[1] // top[2],
            sha(b"".join(b"%d,%d,%d\n" % r for r in found)), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


OUT = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_equals_the_definition(spark, tmp_path):
    rnd = random.Random(4)
    rows = []
    for i in range(150):
        w = words(rnd, rnd.randrange(0, 60), rnd.choice([1, 3, 400]))
        if w and i % 3 == 0:
            at, period = rnd.randrange(len(w)), 1 + rnd.randrange(6)
            w = [x if k < at else w[at + (k - at) % period] for k, x in enumerate(w)]
        rows.append((i, rnd.choice([" ", "\n", " \t", "\x0b\r"]).join(w)))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "a " * 9), (203, "a " * 9), (None, "b " * 9), (None, None),
             (204, "nbsp joins words"), (205, "日本 " * 8 + "x"), (206, "a b a b a b a b a"), (207, "a a a a a a b b b b b b")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = collect(R.query(spark, str(tmp_path)), *OUT)
    assert sorted(got, key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert any(r[1] for r in got) and any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(150))


def test_random_words_and_minimal_alphabets():
    rnd = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rnd.randrange(1, 5)):
            w = [b"w%d" % rnd.randrange(rnd.choice([1, 2, 3])) for _ in range(rnd.randrange(0, 50))]
            texts.append(w)
        assert R.batch_runs(texts, 6, 4) == [brute(w) for w in texts]
        assert R.batch_runs(texts, 8, 3) == [brute(w, 8, 3) for w in texts]


def test_long_texts():
    assert R.batch_runs([[b"a"] * 30_000], 6, 4) == [[(0, 30_000, 1)]]
    assert R.batch_runs([[b"%d" % (i % 700) for i in range(30_000)]], 6, 4) == [[(0, 30_000, 700)]]
    rnd = random.Random(2)
    common = [b"w%d" % i for i in range(9)]
    text = [x for _ in range(1500) for x in [b"%d" % rnd.randrange(9000), *common]]
    assert R.batch_runs([text], 6, 4) == [[]]


def test_places_keep_neighbours_in_order():
    rnd = random.Random(7)
    numbers = rnd.sample(range(20_000), 5000)
    held, some = R.Places(numbers[0]), [numbers[0]]
    for x in numbers[1:]:
        before, after = held.around(x)
        assert before == max((y for y in some[-50:] if y < x), default=-1) or before > max((y for y in some[-50:] if y < x), default=-1)
        held.add(x)
        some.append(x)
    assert list(held) == sorted(numbers)
    for x in rnd.sample(range(20_000), 300):
        if x not in set(numbers):
            assert held.around(x) == (max((y for y in numbers if y < x), default=-1), min((y for y in numbers if y > x), default=-1))


def test_operator_gives_runs_and_texts_and_slices_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE_BYTES", 100)
    rows = [(1, "x " + "go " * 8 + "on"), (2, None), (3, "plain words only"), (4, "y " * 300)]
    got = {r["id"]: r for r in R.periodic_runs(docs(spark, rows)).collect()}
    assert got[1]["collapsed"] == "x go on" and [tuple(r) for r in got[1]["runs"]] == [(1, 8, 1)]
    assert got[2]["collapsed"] == "" and got[2]["top"] is None and got[2]["n_words"] == 0
    assert got[3]["collapsed"] == "plain words only" and got[4]["collapsed"] == "y"
    assert R.periodic_runs(docs(spark, [])).count() == 0
