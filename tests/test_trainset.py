"""Packing, line examples and masking properties."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import trainset as TS
from corpusmill.operators.vocab import encode_texts


def test_packing_drops_remainder(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5, 6]), (2, [7, 8, 9])], "doc_id long, ids array<int>")
    out = TS.pack_blocks(df, 4, "doc_id", "ids").orderBy("block").collect()
    assert [list(r.input_ids) for r in out] == [[1, 2, 3, 4], [5, 6, 7, 8]]
    assert all(list(r.labels) == list(r.input_ids) for r in out)


def test_packing_per_batch(spark):
    df = spark.createDataFrame([(i, [i] * 3) for i in range(4)], "doc_id long, ids array<int>")
    out = TS.pack_blocks(df, 4, "doc_id", "ids", batch_rows=2).collect()
    assert sorted((r.batch, list(r.input_ids)) for r in out) == [(0, [0, 0, 0, 1]), (1, [2, 2, 2, 3])]


def test_packing_keeps_empty_rows_and_all_columns(spark):
    rows = [(0, [], []), (1, [1, 2], [1, 0]), (2, [3, 4], [0, 1]), (3, [5, 6], [1, 1]), (4, None, None), (5, [7] * 9, [0] * 9)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, special_tokens_mask array<int>")
    out = TS.pack_blocks(df, 4, "doc_id", "ids", 2, ("special_tokens_mask",)).orderBy("batch", "block").collect()
    # batches are rows 0-1, 2-3, 4-5: the empty rows count
    assert [(r.batch, r.block, list(r.input_ids), list(r.special_tokens_mask)) for r in out] == [
        (1, 0, [3, 4, 5, 6], [0, 1, 1, 1]), (2, 0, [7] * 4, [0] * 4), (2, 1, [7] * 4, [0] * 4)]


def test_packing_matches_concatenation(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.randrange(100) for _ in range(rnd.choice([0, 1, 3, 40]))]) for i in range(50)]
    out = TS.pack_blocks(spark.createDataFrame(rows, "doc_id long, ids array<int>"), 7, "doc_id", "ids", 12).collect()
    want = {}
    for b in range(0, 50, 12):
        flat = [x for _, ids in rows[b:b + 12] for x in ids]
        want.update({(b // 12, k): flat[7 * k:7 * k + 7] for k in range(len(flat) // 7)})
    assert {(r.batch, r.block): list(r.input_ids) for r in out} == want


def test_encoding_keeps_rows_without_words(spark):
    vocab = spark.createDataFrame([("a", 5), ("b", 6)], "token string, id long")
    df = spark.createDataFrame([(0, "!!!"), (1, "a b"), (2, None), (3, ""), (4, "b zz a")], "doc_id long, text string")
    out = {r.doc_id: list(r.ids) for r in encode_texts(df, "text", ["doc_id"], vocab, 1, 2).collect()}
    assert out == {0: [], 1: [5, 6], 2: [], 3: [], 4: [6, 1, 5]}


def test_encoding_by_a_bounded_vocabulary_is_narrow_and_merges_equal_keys(spark):
    vocab = spark.createDataFrame([("a", 5), ("b", 6), ("c", None), (None, 9)], "token string, id long")
    rows = [(0, "x", "a b"), (0, "y", "b"), (0, "y", "a zz c"), (None, "x", "b"), (None, "x", "a"), (None, None, None), (1, "x", "!")]
    df = spark.createDataFrame(rows, "doc_id long, part string, text string")
    got, want = ({(r.doc_id, r.part): list(r.ids) for r in encode_texts(df, "text", ["doc_id", "part"], vocab, 1, n).collect()}
                 for n in (4, None))
    assert got == want and got[0, "y"] == [5, 6, 1, 1] and got[None, "x"] == [5, 6] and got[None, None] == []
    once = encode_texts(df.where("part = 'x' AND doc_id = 0"), "text", ["doc_id"], vocab, 1, 4)
    assert once.schema["ids"].dataType.simpleString() == "array<bigint>"
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [-0.5, 0.0, 0.15, 0.5, 0.8, 1 / 3, 1.0, 2.0])
def test_draws_compare_by_their_digits(spark, limit):
    edge = [f"{max(0, min(int(limit * 2 ** 32) + i, 2 ** 32 - 1)):08x}" for i in (-1, 0, 1)]
    df = spark.createDataFrame([(a + b + "0" * 16,) for a in edge for b in edge] + [(None,)], "d string")
    for no in (0, 1):
        got = df.select(TS._below(F.col("d"), limit, no).alias("x"), (TS._draw(F.col("d"), no) < limit).alias("y")).collect()
        assert all(bool(r.x) == bool(r.y) for r in got)


def test_long_pairs_lose_their_longer_side(spark):
    a, b = list(range(10, 30)), list(range(50, 54))
    df = spark.createDataFrame([(0, a, b), (1, b, a), (2, a, a), (3, b, b)], "k int, a array<int>, b array<int>")
    out = {r.k: [x for x in r.input_ids if x] for r in TS.pair_encode(df, "a", "b", 14, 1, 2, 0, ["k"]).collect()}
    assert out[0] == [1, *a[:7], 2, *b, 2] and out[1] == [1, *b, 2, *a[:7], 2]
    assert out[2] == [1, *a[:5], 2, *a[:6], 2] and out[3] == [1, *b, 2, *b, 2]


def test_line_examples(spark):
    df = spark.createDataFrame([(0, [7, 8]), (1, list(range(10, 20)))], "k long, ids array<int>")
    out = {r.k: r for r in TS.line_examples(df, 6, 2, 3, 0).collect()}
    assert list(out[0].input_ids) == [2, 7, 8, 3, 0, 0]
    assert list(out[0].attention_mask) == [1, 1, 1, 1, 0, 0]
    assert list(out[0].special_tokens_mask) == [1, 0, 0, 1, 1, 1]
    assert list(out[1].input_ids) == [2, 10, 11, 12, 13, 3]      # the end token always stays


def test_masking_labels_agree(spark):
    ids = list(range(5, 205))
    df = spark.createDataFrame([("r0", ids, [0] * 200)], "row string, input_ids array<int>, special_tokens_mask array<int>")
    out = TS.mask_tokens(df, "row", 4, 1000, 0.15, 42, "all_mask").first()
    chosen = [i for i, y in enumerate(out.labels) if y != -100]
    assert 10 < len(chosen) < 60
    assert all(out.labels[i] == ids[i] and out.input_ids[i] == 4 for i in chosen)
    assert all(out.input_ids[i] == ids[i] for i in range(200) if i not in chosen)
    special = spark.createDataFrame([("r0", ids, [1] * 200)], "row string, input_ids array<int>, special_tokens_mask array<int>")
    assert set(TS.mask_tokens(special, "row", 4, 1000, 0.5, 42, "default").first().labels) == {-100}


def test_packed_special_tokens_are_never_masked(spark):
    df = spark.createDataFrame([("r", list(range(5, 105)), [i % 3 == 0 and 1 or 0 for i in range(100)])],
                               "row string, input_ids array<int>, special_tokens_mask array<int>")
    out = TS.mask_tokens(df, "row", 4, 1000, 0.9, 1, "default").first()
    assert all(out.labels[i] == -100 and out.input_ids[i] == i + 5 for i in range(0, 100, 3))
    assert sum(x != -100 for x in out.labels) > 40


def test_effective_block_size():
    assert TS.effective_block_size(None, 4096) == 1024
    assert TS.effective_block_size(512, 256) == 256


def test_build_texts_and_mask_choice(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y"], 3), (2, None, [], None)], "k int, s string, l array<string>, n int")
    out = {r.k: r.text for r in TS.build_texts(df, ["s", "l", "n"]).collect()}
    assert out == {1: "a x y 3"}
    assert [r.text for r in TS.build_texts(df, ["n", "s"]).collect()] == ["3 a"]      # as named, not as stored
    assert TS.text_column(df, "s") == "s" and TS.text_column(df, "text") == "k"
    empty = spark.createDataFrame([(1, "  ")], "k int, s string")
    with pytest.raises(ValueError):
        TS.build_texts(empty, ["s"])
    vocab = spark.createDataFrame([("</s>", 3), ("_", 9)], "token string, id long")
    assert TS.mask_token_id(vocab, "eos") == 3 and TS.mask_token_id(vocab, "blank") == 9
    assert TS.mask_token_id(vocab, "mask") is None
    assert TS.cap_count(None, 5) == 5 and TS.cap_count(3, 5) == 3


def test_roles_and_evaluation_pairs(spark):
    df = spark.createDataFrame([(i, f"q{i}", f"p{i}", f"n{i}") for i in range(20)], "k int, q string, p string, n string")
    out = TS.role_pairs(df, {"anchor": "q", "positive": "p", "negative": "n"}, 5, ["k"])
    assert out.columns == ["k", "anchor", "positive", "negative"] and out.count() == 5
    assert TS.role_pairs(df, {"anchor": "q", "positive": "p"}).columns == ["anchor", "positive"]
    with pytest.raises(ValueError):
        TS.role_pairs(df, {"anchor": "q"})
    queries = spark.createDataFrame([(1, [("a",)]), (2, [("b",), ("c",), ("d",)]), (3, [("e",), ("f",)]), (4, None)],
                                    "query_id int, positive_passages array<struct<text: string>>")
    corpus = spark.createDataFrame([(i, f"t{i}") for i in range(9)], "doc_id int, text string")
    rows = TS.evaluation_pairs(queries, corpus, 2).collect()
    assert {(r.pair_id, r.text1, r.text2) for r in rows if r.kind == "positive"} == {(2, "b", "c"), (3, "e", "f")}
    random_rows = [r for r in rows if r.kind == "random"]
    assert len(random_rows) == 2 and len({t for r in random_rows for t in (r.text1, r.text2)}) == 4
    assert len(TS.evaluation_pairs(queries, corpus, 1).collect()) == 2
