"""Retrieval, hard negatives and vocabulary tools."""

import re


from corpusmill.operators import pruned as P
from corpusmill.operators import retrieval as R
from corpusmill.operators import vocab as V
from corpusmill.plans.mining import MiningConfig, mine_job


def _corpus(spark):
    docs = [(0, "apple banana apple"), (1, "banana cherry"), (2, "cherry date elder"), (3, "apple date")]
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_hard_negatives_skip_positive(spark):
    idx = R.build_index(_corpus(spark))
    q = spark.createDataFrame([(0, "apple banana")], "query_id long, text string")
    scores = R.bm25_scores(idx, R.query_terms(q, "text", "query_id"))
    ranked = [r.doc_id for r in R.top_k(scores, 10).orderBy("rank").collect()]
    pos = spark.createDataFrame([(0, ranked[0])], "query_id long, doc_id long")
    negs = R.hard_negatives(scores, pos, 2).orderBy("rank").collect()
    assert [r.doc_id for r in negs] == ranked[1:3]
    assert list(R.collect_negatives(R.hard_negatives(scores, pos, 2)).first().negatives) == ranked[1:3]


def test_index_stats(spark):
    idx = R.build_index(_corpus(spark))
    assert idx.n_docs == 4 and abs(idx.avgdl - 10 / 4) < 1e-12
    df = {r.token: r.df for r in idx.terms.collect()}
    assert df["apple"] == 2 and df["elder"] == 1


def test_verbatim_qrels(spark):
    corpus = spark.createDataFrame([(0, "xx the quick brown fox yy"), (1, "quick brown"), (2, "a quick brown fox!")],
                                   "doc_id long, text string")
    idx = R.build_index(corpus)
    q = spark.createDataFrame([(9, "quick brown fox")], "query_id long, text string")
    assert sorted(r.doc_id for r in R.verbatim_qrels(q, corpus, idx).collect()) == [0, 2]


def test_verbatim_qrels_of_short_queries(spark):
    texts = ["the quick brown fox", "red fox den", "unbrown foxes", "brownfox", "fox", "!! ok ??", None, ""]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = ["brown fox", "fox", "ox", "!!", "d fo", "", None, "no such", "e quick brow"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = {(r.query_id, r.doc_id) for r in R.verbatim_qrels(q, corpus, R.build_index(corpus)).collect()}
    assert got == {(i, j) for i, a in enumerate(asked) for j, t in enumerate(texts)
                   if a is not None and t is not None and a in t}


def test_negatives_are_filled_up_from_the_whole_corpus(spark):
    corpus = _corpus(spark)
    q = spark.createDataFrame([(0, "elder"), (1, "nothing"), (2, "apple")], "query_id long, text string")
    scores = R.bm25_scores(R.build_index(corpus), R.query_terms(q, "text", "query_id"))
    pos = spark.createDataFrame([(0, 0), (1, 1)], "query_id long, doc_id long")
    got = {}
    for r in R.hard_negatives(scores, pos, 3, queries=q, corpus=corpus).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {0: [2, 1, 3], 1: [0, 2, 3], 2: [0, 3, 1]}


def test_scores_need_no_exchange_by_query_and_document(spark):
    idx = R.build_index(_corpus(spark), norms=True)
    q = R.query_terms(spark.createDataFrame([(0, "apple banana")], "query_id long, text string"), "text", "query_id")
    for s in (R.bm25_scores(idx, q), R.tfidf_scores(idx, q)):
        plan = R.top_k(s, 2)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(query_id" in plan and "WindowGroupLimit" in plan
        assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", plan)


def test_mining_job_caps_saves_and_loads(spark, tmp_path):
    rows = [(i, f"word{i} common", f"word{i} text number {i % 4}") for i in range(12)] + [(12, "x", "word0 text number 0")]
    df = spark.createDataFrame(rows, "doc_id long, query string, doc_text string")
    cfg = MiningConfig(num_samples=8, num_negatives=2)
    out = mine_job({"a": df, "b": df.where("doc_id > 7")}, cfg, str(tmp_path))
    mined = {r.query_id: r.negatives for r in R.collect_negatives(out["a"]).collect()}
    assert set(mined) == set(range(8)) and all(i not in n and len(n) == 2 for i, n in mined.items())
    saved = {r.query_id: r.negatives for r in spark.read.json(str(tmp_path / "hard_negatives_a")).collect()}
    assert saved == mined
    again = MiningConfig(num_samples=8, num_negatives=2, index_path=str(tmp_path / "a_lucene_model"))
    assert {r.query_id: r.negatives for r in R.collect_negatives(mine_job({"a": df}, again)["a"]).collect()} == mined


def test_add_tokens(spark):
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("token3", 2)], "token string, id long")
    new = spark.createDataFrame([("token1", "normal", 0), ("token2", "normal", 1), ("token3", "normal", 2),
                                 ("<special1>", "special", 0)], "token string, kind string, pos int")
    out = {r.token: (r.id, r.kind) for r in V.extend_vocab(vocab, new).collect()}
    assert out["token1"] == (3, "normal") and out["token2"] == (4, "normal") and out["<special1>"] == (5, "special")
    assert out["token3"] == (2, "base")


def test_merge_vocabs(spark):
    base = spark.createDataFrame([("a", -1.0, 0), ("b", -2.0, 1)], "piece string, score double, id long")
    add = spark.createDataFrame([("b", -9.0, 0), ("c", -3.0, 1)], "piece string, score double, id long")
    out = [(r.piece, r.score, r.id) for r in V.merge_vocabs(base, add).orderBy("id").collect()]
    assert out == [("a", -1.0, 0), ("b", -2.0, 1), ("c", -3.0, 2)]


def test_special_token_kinds(spark):
    t = spark.createDataFrame([("<pad>",), ("<unk>",), ("<mask>",)], "token string")
    assert {r.token: r.kind for r in V.special_token_kinds(t).collect()} == {"<pad>": "control", "<mask>": "user_defined"}


def test_char_vocab_coverage(spark):
    df = spark.createDataFrame([("aaaab",)], "text string")
    assert [r.token for r in V.char_vocab(df, "text", 0.8).collect()] == ["a"]
    assert sorted(r.token for r in V.char_vocab(df, "text", 1.0).collect()) == ["a", "b"]


def test_index_save_load(spark, tmp_path):
    idx = R.build_index(_corpus(spark))
    R.save_index(idx, str(tmp_path / "idx"))
    back = R.load_index(spark, str(tmp_path / "idx"))
    assert back.n_docs == idx.n_docs and back.avgdl == idx.avgdl
    assert sorted(back.terms.collect()) == sorted(idx.terms.collect())


def test_index_and_scoring_tasks_grow_with_the_input(spark, monkeypatch, tmp_path):
    """Twice the documents make more tasks, not larger ones."""
    monkeypatch.setattr(R, "TASK_BYTES", 200, raising=False)
    monkeypatch.setattr(R, "TASK_PAIRS", 20, raising=False)
    spark.createDataFrame([(i, f"word{i} common w{i % 7}") for i in range(300)], "doc_id long, text string") \
        .coalesce(1).write.parquet(str(tmp_path / "docs"))
    idx = R.build_index(spark.read.parquet(str(tmp_path / "docs")))
    assert len(idx.docs.inputFiles()) > 8
    scores = R.bm25_scores(idx, spark.createDataFrame([(0, "common", 1), (1, "w3", 1)], "query_id long, token string, qtf long"))
    assert scores.count() == 300 + 43 and scores.rdd.getNumPartitions() > 8


def test_best_by_blocks_equals_scoring_everything(spark, monkeypatch):
    """no row per (query, document) pair, and the same best rows over several blocks."""
    monkeypatch.setattr(R, "BLOCK_ROWS", 12, raising=False)
    docs = spark.createDataFrame([(i, f"a w{i % 5} w{i % 7} x{i % 3} " + "b " * (i % 4)) for i in range(60)], "doc_id long, text string")
    idx = R.build_index(docs)
    terms = R.query_terms(docs.where("doc_id < 40"), "text", "doc_id")
    best = R.best_by_blocks(P.bm25_impacts(idx), P.bm25_query_weights(idx, terms), 3)
    assert best.count() <= 40 * 3 * 5
    want = R.top_k(R.bm25_scores(idx, terms), 3).select("query_id", "rank", "doc_id", "score")
    got = R.top_k(best, 3).select("query_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_index_with_norms_keeps_its_number_of_partitions(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(R, "TASK_BYTES", 100)
    spark.createDataFrame([(i, f"w{i} w{i % 7} a") for i in range(400)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    index = R.build_index(docs, "text", "doc_id", norms=True)
    assert len(index.docs.inputFiles()) > 20 and index.docs.where("dn IS NULL").count() == 0


def test_qrels_join_in_as_many_partitions_as_the_postings_need(spark, monkeypatch):
    """the token join of short queries went by the session's shuffle partitions, whatever the input."""
    corpus = _corpus(spark)
    idx = R.build_index(corpus)
    monkeypatch.setattr(R, "TASK_BYTES", max(1, R.input_bytes(idx.docs) // 50))
    n = R._tasks(spark, R.input_bytes(idx.docs), R.TASK_BYTES)
    q = spark.createDataFrame([(0, "apple")], "query_id long, text string")
    plan = R.verbatim_qrels(q, corpus, idx)._jdf.queryExecution().executedPlan().toString()
    assert n >= 50 and len(re.findall(rf"hashpartitioning\(token#\d+, {n}\)", plan)) == 2


def test_lexicon_of_pos_filter_is_broadcast_by_its_rows(spark, tmp_path):
    """the tokens are not shuffled while the lexicon has few enough rows."""
    from corpusmill.plans.q_retrieval import pos_filter

    spark.createDataFrame([(0, "a bb ccc dddd"), (1, "eee fff"), (2, None)], "doc_id long, text string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = pos_filter(spark, str(tmp_path))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert [tuple(r) for r in out.collect()] == [(0, 3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_index_tasks_grow_with_the_text_not_with_its_files(spark, monkeypatch, tmp_path):
    """Repeated texts, whose files are far smaller than they are."""
    monkeypatch.setattr(R, "TASK_BYTES", 100_000)
    text = " ".join(f"word{i}" for i in range(1000))
    spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    idx = R.build_index(spark.read.parquet(str(tmp_path / "docs")))
    assert len(idx.docs.inputFiles()) > 8
    assert idx.n_docs == 300 and {(r.df, r.cf) for r in idx.terms.collect()} == {(300, 300)}


def test_norms_deal_a_frequent_token_over_several_tasks(spark, monkeypatch):
    """F16: no task gets all postings of a token; the norms are those of the plain join."""
    corpus = spark.createDataFrame([(i, f"common word{i % 5} w{i} w{i}" if i else "other") for i in range(60)], "doc_id long, text string")
    plain = {r.doc_id: r.dn for r in R.build_index(corpus, norms=True).docs.collect()}
    monkeypatch.setattr(R, "TOKEN_ROWS", 7, raising=False)
    read = []
    keep = R.materialize

    def seen(df, tag="t"):
        read.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, tag)

    monkeypatch.setattr(R, "materialize", seen)
    dealt = {r.doc_id: r.dn for r in R.build_index(corpus, norms=True).docs.collect()}
    assert any(re.search(r"RepartitionByExpression \[token#\d+, _part#\d+L\]", p) for p in read)
    assert dealt.keys() == plain.keys() and all(abs(dealt[i] - plain[i]) < 1e-9 for i in plain)


def test_negatives_need_no_exchange_by_query_and_document(spark):
    """the positives come to the scores of their document."""
    idx = R.build_index(_corpus(spark))
    q = R.query_terms(spark.createDataFrame([(0, "apple banana"), (1, "cherry")], "query_id long, text string"), "text", "query_id")
    pos = spark.createDataFrame([(0, 0), (1, 0), (1, 2), (None, 1), (0, None)], "query_id long, doc_id long")
    found = R.hard_negatives(R.bm25_scores(idx, q), pos, 3)
    assert not re.search(r"hashpartitioning\((query_id#\d+L?, doc_id|doc_id#\d+L?, query_id)",
                         found._jdf.queryExecution().executedPlan().toString())
    assert {(r.query_id, r.doc_id) for r in found.collect()} == {(0, 1), (0, 3), (1, 1)}
