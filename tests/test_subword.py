"""Subword vocabularies: both trainers and both encoders against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest

from corpusmill.operators import bpe_trainer as B
from corpusmill.operators import encode as E
from corpusmill.operators import subword as S
from corpusmill.operators import unigram_trainer as U


def texts(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


def test_units_end_to_end_are_the_marked_line(spark):
    rows = ["low  lower 12a", "", None, " x\ty\n", "日本 2024年", "a1", "   "]
    for digits in (True, False):
        got = [r[0] for r in texts(spark, rows).select(S.units("text", digits)).collect()]
        for t, u in zip(rows, got):
            line = "" if t is None else t.replace("\n", " ").replace("\t", " ")
            assert S.joined(u) == line
        assert got[0] == (["▁low", "▁▁lower", "▁", "1", "2", "a"] if digits else ["▁low", "▁▁lower", "▁12a"])
        assert got[1] == got[2] == []


# --- BPE --------------------------------------------------------------------

def plain_bpe(counts, wanted):
    """One merge after the other: most frequent, then shortest, then smallest; a joint that exists is never merged."""
    held, symbols, out = {t: list(t) for t in counts}, set("".join(counts)), []
    while len(out) < wanted:
        pairs = {}
        for t, s in held.items():
            for a, b in zip(s, s[1:]):
                if a + b not in symbols:
                    pairs[a, b] = pairs.get((a, b), 0) + counts[t]
        if not pairs:
            break
        (a, b), n = min(pairs.items(), key=lambda x: (-x[1], len(x[0][0] + x[0][1]), x[0][0] + x[0][1], x[0][0]))
        out.append((a, b, n))
        symbols.add(a + b)
        for t, s in held.items():
            done, i = [], 0
            while i < len(s):
                both = i + 1 < len(s) and (s[i], s[i + 1]) == (a, b)
                done.append(a + b if both else s[i])
                i += 2 if both else 1
            held[t] = done
    return out


def random_counts(rnd, letters, n):
    words = ("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 12))) for _ in range(n))
    return {w: rnd.choice([1, 1, 1, 2, 3, 50]) for w in words}


def test_rounds_of_merges_equal_one_by_one():
    """The same loop as ``learn`` over one block, without Spark: many small cases, most of them full of ties."""
    rnd = random.Random(5)
    for _ in range(150):
        counts = random_counts(rnd, rnd.choice(["ab", "abc", "abcdefgh"]), rnd.randrange(1, 50))
        letters = sorted(set("".join(counts)))
        names, ids, merges = list(letters), {c: i for i, c in enumerate(letters)}, []
        symbols = B.encoded(list(counts), letters)
        weights = np.repeat(list(counts.values()), [len(t) + 1 for t in counts])
        keys, values = B.pair_totals(symbols, weights)
        watch = dict(zip(keys.tolist(), values.tolist()))
        while True:
            ranked = sorted((B.order_of(n, names[k >> 32], names[k & 0xFFFFFFFF]), names[k >> 32], names[k & 0xFFFFFFFF])
                            for k, n in watch.items() if names[k >> 32] + names[k & 0xFFFFFFFF] not in ids)
            if not ranked:
                break
            partner, joint = np.full(len(names) + 1, -5, np.int32), np.zeros(len(names) + 1, np.int32)
            for order, left, right in B.ready(ranked):
                merges.append((order, left, right))
                partner[ids[left]], joint[ids[left]], ids[left + right] = ids[right], len(names), len(names)
                names.append(left + right)
            symbols, weights, keys, changes = B.merged(symbols, weights, partner, joint)
            for k, n in zip(keys.tolist(), changes.tolist()):
                watch[k] = watch.get(k, 0) + n
            watch = {k: n for k, n in watch.items() if n}
            again = dict(zip(*[x.tolist() for x in B.pair_totals(symbols, weights)]))
            assert watch == again       # changes alone keep the counts right
        assert [(a, b, -o[0]) for o, a, b in sorted(merges)] == plain_bpe(counts, 10 ** 6)


@pytest.mark.parametrize("watched,keep,wanted", [(3, 2, 25), (1000, 16, 40)])
def test_bpe_trainer_in_spark(spark, monkeypatch, watched, keep, wanted):
    monkeypatch.setattr(B, "WATCHED", watched)
    monkeypatch.setattr(B, "KEEP", keep)
    counts = random_counts(random.Random(watched), "abcd", 40)
    df = spark.createDataFrame(list(counts.items()), "token string, n long").repartition(3)
    assert B.learn(df, list("abcd"), wanted) == plain_bpe(counts, wanted)


def test_bpe_vocabulary_and_encoding(spark):
    rnd = random.Random(3)
    rows = [" ".join("".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 7))) for _ in range(30)) + " 12é" for _ in range(4)]
    docs = texts(spark, rows + ["", None, "abc ßunseen 9", "b" * 500])
    learnt = docs.where("doc_id < 4")
    vocab, merges = B.bpe_vocab(learnt, "text", 320, special_tokens=["<s>", "<mask>"])
    table = [tuple(r) for r in vocab.orderBy("id").collect()]
    assert [r[0] for r in table[:4]] == ["<unk>", "<s>", "<mask>", "<0x00>"] and len(table) == 320
    counts = {r["token"]: r["n"] for r in S.unit_counts(learnt, "text").collect()}
    want = plain_bpe(counts, merges.count())
    ranked = [tuple(r)[1:] for r in merges.orderBy("rank").collect()]
    assert ranked == want and all(len(a) + len(b) == 1 or not any(c.isdigit() for c in a + b) for a, b, _ in want)
    encoded = E.encode_bpe(docs, "text", ["doc_id"], vocab, merges)
    names = {r[1]: r[0] for r in table}
    lines = {r["doc_id"]: r for r in E.decode(encoded, vocab).collect()}
    for i, t in enumerate(rows + ["", None, "abc ßunseen 9", "b" * 500]):
        assert lines[i]["line"] == (t or "")
    for r in lines.values():
        if r["doc_id"] in (0, 4, 5, 7):     # every merge in its turn over the whole unit
            units = docs.where(f"doc_id = {r['doc_id']}").select(S.units("text")).first()[0]
            pieces = []
            for u in units:
                s = list(u)
                for a, b, _ in want:
                    k = 0
                    while k + 1 < len(s):
                        if (s[k], s[k + 1]) == (a, b):
                            s[k:k + 2] = [a + b]
                        k += 1
                pieces += s
            assert [names[x] for x in r["ids"]] == pieces
    with pytest.raises(ValueError):
        B.bpe_vocab(learnt, "text", 20)


# --- unigram ----------------------------------------------------------------

def cuts(text, longest=16):
    """All ways to write a text as pieces."""
    for marks in itertools.product([0, 1], repeat=len(text) - 1):
        at = [0] + [i + 1 for i, m in enumerate(marks) if m] + [len(text)]
        yield [text[a:b] for a, b in zip(at, at[1:])]


def test_nodes_of_sorted_suffixes_are_those_of_the_suffix_tree():
    rnd = random.Random(1)
    for _ in range(80):
        held = random_counts(rnd, "ab", rnd.randrange(1, 40))
        held = {k[:8]: n for k, n in held.items()}
        order = sorted(held)
        got = {}
        for members, totals, depth in U.bucket_nodes(np.array(order, "U8"), np.array([held[x] for x in order]), 1, 8):
            got.update({order[i][:depth]: n for i, n in zip(members.tolist(), totals.tolist())})
        want = {}
        for p in {s[:d] for s in order for d in range(1, len(s) + 1)}:
            nexts = {}
            for k, n in held.items():
                if k.startswith(p):
                    nexts[k[len(p):len(p) + 1]] = nexts.get(k[len(p):len(p) + 1], 0) + n
            if len(p) == 8 or len(nexts) > 1 or "" in nexts:
                want[p] = sum(nexts.values())
        assert got == want


@pytest.mark.parametrize("long", [64, 2])
def test_expectations_and_best_paths_equal_all_segmentations(monkeypatch, long):
    monkeypatch.setattr(U, "LONG", long)
    rnd = random.Random(4)
    pieces = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bb"]
    chance = np.array([rnd.random() for _ in pieces])
    chance /= chance.sum()
    longest = 3
    book = U.Codebook(U.hashes(pieces, 1_000_003), np.arange(len(pieces)), 1_000_003, longest)
    both = np.append(chance, [1e-9, 0.0])
    words = ["".join(rnd.choice("abcx") for _ in range(6)) for _ in range(20)]
    counts = np.array([rnd.randrange(1, 9) for _ in words])
    cells = book.cells(words, 6)
    used, likelihood = U.expectations(6, counts, cells, both, longest)
    got = np.bincount(cells.ravel(), used.ravel(), len(both))
    value, steps = U.best_paths(6, cells, np.log(np.maximum(both, 1e-300)), longest)
    p = dict(zip(pieces, chance)) | {"x": 1e-9}
    want, logs = np.zeros(len(both)), 0.0
    number = {q: i for i, q in enumerate(pieces)} | {"x": len(pieces)}
    for k, (w, n) in enumerate(zip(words, counts)):
        ways = [(math.prod(p[q] for q in c), c) for c in cuts(w) if all(q in p for q in c)]
        total = sum(x for x, _ in ways)
        logs += n * math.log(total)
        for x, c in ways:
            for q in c:
                want[number[q]] += n * x / total
        assert abs(value[k] - math.log(max(ways)[0])) < 1e-9
    assert np.allclose(got, want) and abs(logs - likelihood) < 1e-6


def corpus(spark, n=300, seed=8):
    rnd = random.Random(seed)
    stems, ends = ["walk", "talk", "jump", "play", "work"], ["", "s", "ed", "ing", "er"]
    return texts(spark, [" ".join(rnd.choice(stems) + rnd.choice(ends) for _ in range(20)) for _ in range(n)])


def test_likelihood_rises_every_round(spark):
    counts = S.unit_counts(corpus(spark), "text")
    letters = S.alphabet(counts)
    trainer = U.Trainer(counts, U.seed_table(counts, letters, 500, 16), len(letters), 16)
    for _ in range(6):
        trainer.em_round()
    assert all(b > a for a, b in zip(trainer.history, trainer.history[1:]))
    before = trainer.alive()
    trainer.prune(40)
    assert trainer.alive() == 40 < before and (trainer.chance[:len(letters)] > 0).all()
    for _ in range(4):
        trainer.em_round()
    assert all(b > a for a, b in zip(trainer.history[6:], trainer.history[7:]))
    trainer.close()


def test_unigram_vocabulary_and_encoding(spark):
    docs = corpus(spark)
    vocab = U.unigram_vocab(docs, "text", 300, special_tokens=["</s>"])
    table = [tuple(r) for r in vocab.orderBy("id").collect()]
    pieces = [r[0] for r in table if r[2] == "normal"]
    assert len(table) == 300 and len(set(pieces)) == len(pieces) and [r[1] for r in table] == list(range(300))
    assert set("walktjumpyorsednig▁") <= set(pieces)            # every character is kept
    assert {"▁walk", "▁talk", "▁jump", "▁play", "▁work"} <= set(pieces)
    scores = {r[0]: r[3] for r in table if r[2] == "normal"}
    assert [scores[p] for p in pieces] == sorted(scores.values(), reverse=True)
    more = texts(spark, ["walking  works", "", None, "ßx 7\nquizzed", "played" * 40])
    out = {r["doc_id"]: r for r in E.decode(E.encode_unigram(more, "text", ["doc_id"], vocab), vocab).collect()}
    assert [out[i]["line"] for i in range(5)] == ["walking  works", "", "", "ßx 7 quizzed", "played" * 40]
    names = {r[1]: r[0] for r in table}
    encoder = E.UnigramEncoder(table)
    for unit in ("▁walking", "▁talkers", "▁▁played", "▁jumpe", "▁okays"):
        got = [names[i] for i in encoder.encode(unit)]
        best = max(sum(scores[p] for p in c) for c in cuts(unit) if all(p in scores for p in c))
        assert "".join(got) == unit and abs(sum(scores[p] for p in got) - best) < 1e-9
    no_bytes = [r for r in table if r[2] != "byte"]
    assert E.UnigramEncoder(no_bytes).encode("ß") == [0]


def test_unigram_options(spark):
    df = texts(spark, ["abcdefgh abcdefgh 12 34 12", "aaaa"])
    with pytest.raises(ValueError):
        U.unigram_vocab(df, "text", 5, byte_fallback=False)
    few = [r.piece for r in U.unigram_vocab(df, "text", 6, byte_fallback=False, character_coverage=0.5).collect()]
    assert "a" in few and len(few) <= 6
    apart = [r.piece for r in U.unigram_vocab(df, "text", 400).collect()]
    assert "12" not in apart and "1" in apart and "<0x41>" in apart
    together = [r.piece for r in U.unigram_vocab(df, "text", 400, split_digits=False).collect()]
    assert "▁12" in together
    assert [r.piece for r in U.unigram_vocab(texts(spark, ["", None]), "text", 10, byte_fallback=False).collect()] == ["<unk>"]
    signs = [chr(0x4e00 + i) for i in range(400)]
    many = {r.piece for r in U.unigram_vocab(texts(spark, [c + signs[i - 1] for i, c in enumerate(signs)]), "text").collect()}
    assert set(signs) <= many
