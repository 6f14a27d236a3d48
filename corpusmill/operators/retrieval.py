"""Lexical retrieval: tokens, index, BM25 / TF-IDF scoring, top-k, hard negatives.

The index holds **one row per document** (``docs(doc_id, dl, dn, items)`` with
``items`` the document's distinct tokens and their counts, ``dn`` its TF-IDF norm
when fitted with norms) and the term table ``terms(token, df, cf)``.

Scoring partitions the document rows by id once (the postings' size, whatever
the number of queries), explodes them, and joins the query terms by broadcast
while a row count allows it.  Every (query, document) sum then finishes inside
the task that holds the document: the plan has no exchange on (query, document).
The top-k's ``WindowGroupLimit`` cuts each task's list to k a query before the
only other shuffle, which carries queries x k x tasks rows at most.  A query set
that is too large to broadcast is joined on the token instead; then the sums do
need an exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import explode_items, words
from ..session import materialize
from .position import input_bytes, with_position

BROADCAST_ROWS = 5_000_000
#: Bytes of text of one indexing task, and (query, document) sums of one scoring task: more input makes more tasks.
TASK_BYTES, TASK_PAIRS = 4 << 20, 500_000
#: Postings of one token that may meet in one task; those of a more frequent token are dealt over several.
TOKEN_ROWS = 100_000


def _tasks(spark, amount: int, each: int) -> int:
    """Enough tasks of ``each`` for the whole amount, at least one a core."""
    return max(spark.sparkContext.defaultParallelism, -(-amount // each))


def _rows_and_bytes(df: DataFrame, text_col: str) -> tuple[int, int]:
    """Rows, and bytes of their texts as they are in memory: files of repeated texts are much smaller."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col)).alias("b")).first()
    return row["n"], row["b"] or 0


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Size check for an explicit broadcast.  Call it only on cheap inputs (the
    query set, a stopword file): joins of derived tables are left to AQE, which
    broadcasts at runtime from measured sizes and keeps a shuffled join beyond."""
    return df.count() <= limit


def _bc(df: DataFrame, ok: bool) -> DataFrame:
    return F.broadcast(df) if ok else df


def tokenize(df: DataFrame, text_col: str, id_col: str, id_alias: str = "doc_id",
             stopwords: DataFrame | None = None, lexicon: DataFrame | None = None,
             pos_filter: list[str] | None = None, pos_match: str = "equals",
             broadcast_lists: bool = False) -> DataFrame:
    """(id, tok_pos, token) rows: lower-cased word tokens in text order.

    FLT-16: ``stopwords(word)`` removes tokens (anti join); ``lexicon(token,
    pos)`` with ``pos_filter`` keeps tokens whose part of speech equals (or,
    ``pos_match='prefix'``, starts with) one of the listed tags.
    """
    toks = explode_items(df.select(F.col(id_col).alias(id_alias), text_col), [id_alias], words(F.col(text_col)),
                         "token", "tok_pos")
    if stopwords is not None:
        sw = stopwords.select(F.col(stopwords.columns[0]).alias("token")).distinct()
        toks = toks.join(_bc(sw, broadcast_lists), "token", "left_anti")
    if pos_filter is not None:
        if lexicon is None:
            raise ValueError("pos_filter needs a lexicon(token, pos) table")
        if pos_match == "equals":
            ok = F.col("pos").isin(list(pos_filter))
        else:
            ok = F.lit(False)
            for p in pos_filter:
                ok = ok | F.col("pos").startswith(p)
        keep = lexicon.where(ok).select("token").distinct()
        toks = toks.join(_bc(keep, broadcast_lists), "token", "left_semi")
    return toks.select(id_alias, "tok_pos", "token")


@dataclass
class LexicalIndex:
    docs: DataFrame       # doc_id, dl, dn, items array<struct<token, tf>>
    terms: DataFrame      # token, df, cf
    n_docs: int
    avgdl: float

    @property
    def postings(self) -> DataFrame:
        """(doc_id, token, tf, dl, dn), one row per document and token."""
        return _exploded(self.docs)


def _exploded(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "dl", "dn", F.explode("items").alias("_i")).select(
        "doc_id", F.col("_i.token").alias("token"), F.col("_i.tf").alias("tf"), "dl", "dn")


def build_index(corpus: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                stopwords: DataFrame | None = None, norms: bool = False) -> LexicalIndex:
    """AGG-20: term frequencies, document frequencies, lengths, N and avgdl.

    Documents are hash-partitioned by id before tokenising, so the counts per
    (document, token) and the document rows need no second exchange: each text
    crosses the network once instead of every token row.  Both tables are
    written once under the checkpoint folder.  The number of partitions grows with the
    bytes of text, so a task's counts do not.  ``norms`` adds the TF-IDF norm of
    every document, which needs the finished term table and so a second pass.
    A document without tokens has no row in ``docs`` but counts in ``n_docs``.
    """
    n_docs, size = _rows_and_bytes(corpus, text_col)
    n = _tasks(corpus.sparkSession, size, TASK_BYTES)
    toks = tokenize(corpus.repartition(n, F.col(id_col)), text_col, id_col, "doc_id", stopwords)
    tf = toks.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))
    docs = tf.groupBy("doc_id").agg(F.sum("tf").alias("dl"), F.lit(None).cast("double").alias("dn"),
                                    F.collect_list(F.struct("token", "tf")).alias("items"))
    docs = materialize(docs, "postings")
    terms = materialize(_exploded(docs).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")),
                        "terms")
    total = terms.agg(F.sum("cf").alias("s")).first()["s"] or 0
    if norms:
        # the postings of a frequent token are dealt over as many parts as they need, its idf is copied to each
        parts = terms.where(F.col("df") > TOKEN_ROWS).select("token", F.ceil(F.col("df") / TOKEN_ROWS).alias("_n"))
        postings = _exploded(docs).join(F.broadcast(parts), "token", "left").withColumn(
            "_part", F.coalesce(F.pmod(F.xxhash64("doc_id"), "_n"), F.lit(0).cast("long")))
        idf = _tfidf_idf(terms, n_docs).join(F.broadcast(parts), "token", "left").select(
            "token", "idf", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_n", F.lit(1)) - 1)).alias("_part"))
        weights = postings.repartition(n, "token", "_part").join(idf, ["token", "_part"])
        dn = weights.groupBy("doc_id").agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) * (F.col("tf") * F.col("idf"))))
                                           .alias("dn"))
        docs = materialize(docs.drop("dn").repartition(n, "doc_id").join(dn.repartition(n, "doc_id"), "doc_id", "left").select("doc_id", "dl", "dn", "items"), "postings")
    return LexicalIndex(docs, terms, int(n_docs), float(total) / n_docs if n_docs else 0.0)


def _tfidf_idf(terms: DataFrame, n_docs: int) -> DataFrame:
    return terms.select("token", F.log2(F.lit(float(n_docs)) / F.col("df")).alias("idf")).where(F.col("idf") > 0)


def query_terms(queries: DataFrame, text_col: str = "text", id_col: str = "query_id",
                stopwords: DataFrame | None = None) -> DataFrame:
    """(query_id, token, qtf): repeated query words count repeatedly."""
    toks = tokenize(queries, text_col, id_col, "query_id", stopwords)
    return toks.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qtf"))


def bm25_term_weights(index: LexicalIndex, variant: str = "lucene", k1: float = 1.5, b: float = 0.75,
                      epsilon: float = 0.25) -> DataFrame:
    """(token, idf) for the chosen variant.

    lucene: ln(1 + (N - df + .5) / (df + .5)).
    okapi:  ln((N - df + .5) / (df + .5)); negative values replaced by
            epsilon x mean idf over all terms (one small aggregate).
    """
    n = F.lit(float(index.n_docs))
    if variant == "lucene":
        return index.terms.select("token", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    if variant == "okapi":
        raw = index.terms.select("token", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
        mean_idf = raw.agg(F.avg("idf").alias("m")).first()["m"] or 0.0
        return raw.select("token", F.when(F.col("idf") < 0, F.lit(epsilon * mean_idf)).otherwise(F.col("idf"))
                          .alias("idf"))
    raise ValueError("variant must be 'lucene' or 'okapi'")


def _hits(index: LexicalIndex, terms_of_queries: DataFrame, small: bool, n_queries: int) -> DataFrame:
    """Postings joined with the query terms; partitioned by document while the terms are broadcast."""
    if not small:
        return index.postings.join(terms_of_queries, "token")
    n = _tasks(index.docs.sparkSession, index.n_docs * n_queries, TASK_PAIRS)
    postings = _exploded(index.docs.repartition(n, F.col("doc_id")))
    return postings.join(F.broadcast(terms_of_queries), "token")


def _queries(qterms: DataFrame) -> int:
    return qterms.select("query_id").distinct().count()


def bm25_scores(index: LexicalIndex, qterms: DataFrame, variant: str = "lucene", k1: float = 1.5,
                b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query_id, doc_id, score) for every document sharing a term with the query."""
    idf = bm25_term_weights(index, variant, k1, b, epsilon)
    small = small_enough(qterms)
    # the query side is checked once; its join with idf can only shrink it
    q = _bc(qterms, small).join(idf, "token")
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(index.avgdl))
    sat = F.col("tf") / (F.col("tf") + norm)
    if variant == "okapi":
        sat = sat * F.lit(k1 + 1)
    return _hits(index, q, small, _queries(qterms) if small else 0).groupBy("query_id", "doc_id").agg(
        F.sum(F.col("qtf") * F.col("idf") * sat).alias("score"))


def tfidf_scores(index: LexicalIndex, qterms: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): cosine of L2-normalised tf x log2(N/df) vectors.

    The documents' norms come from the index (``build_index(norms=True)``).
    """
    small = small_enough(qterms)
    qw = _bc(qterms, small).join(_tfidf_idf(index.terms, index.n_docs), "token").select(
        "query_id", "token", "idf", (F.col("qtf") * F.col("idf")).alias("w"))
    qn = qw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qn"))
    q = qw.join(qn, "query_id").select("query_id", "token", "idf", (F.col("w") / F.col("qn")).alias("qw"))
    dw = F.col("tf") * F.col("idf") / F.col("dn")
    return _hits(index, q, small, _queries(qterms) if small else 0).groupBy("query_id", "doc_id").agg(F.sum(dw * F.col("qw")).alias("score"))


def top_k(scores: DataFrame, k: int, digits: int = 6, group: str = "query_id", item: str = "doc_id") -> DataFrame:
    """TOP-3: best k per query by score (rounded to ``digits``), ties to the smaller id."""
    s = scores.withColumn("score", F.round("score", digits))
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), F.col(item))
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Rows of a block of queries or of documents; a pair of blocks is one task's work.
BLOCK_ROWS = 8192


def best_by_blocks(impacts: DataFrame, weights: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score): the k best documents of every query in each block of documents, for large query sets.

    ``impacts(token, doc_id, impact)`` and ``weights(query_id, token, weight)``; the score is the sum of their
    products over the common tokens.  A query's k best of all are among these rows.  Queries and documents are
    hashed into blocks, a pair of blocks is a group, and a group adds up one query's scores at a time, so that
    neither memory nor what is written holds all (query, document) pairs.
    """
    sides = []
    for no, (df, key, value) in enumerate(((weights, "query_id", "weight"), (impacts, "doc_id", "impact"))):
        rows = df.select(F.col(key).alias("id"), "token", F.col(value).cast("double").alias("value")).where("id IS NOT NULL")
        rows = materialize(rows.groupBy("id").agg(F.collect_list(F.struct("token", "value")).alias("items")), "blocks")
        blocks = max(1, -(-rows.count() // BLOCK_ROWS))
        sides.append((rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks))), blocks, no))
    (q, nq, _), (c, nc, _) = sides
    parts = [F.col("items.token").alias("tokens"), F.col("items.value").alias("values")]
    routed = (q.select("id", F.lit(0).alias("side"), F.col("own").alias("bi"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("bj"), *parts)
              .union(c.select("id", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("bi"), F.col("own").alias("bj"), *parts)))

    def pair(t: pa.Table) -> pa.Table:
        tokens, values = t["tokens"].combine_chunks(), t["values"].combine_chunks()
        codes = tokens.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        values, side, ids = values.flatten().to_numpy(), t["side"].to_numpy(), t["id"].to_numpy()
        ends = np.cumsum(pc.list_value_length(tokens).to_numpy())
        row = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))
        # the documents' items by token
        mine = np.flatnonzero(side[row] == 1)
        mine = mine[np.argsort(codes[mine], kind="stable")]
        starts = np.searchsorted(codes[mine], np.arange(codes.max(initial=-1) + 2))
        local = np.cumsum(side) - 1
        doc, impact, doc_ids = local[row[mine]], values[mine], ids[side == 1]
        out: list = [[], [], []]
        for r in np.flatnonzero(side == 0):
            score, met = np.zeros(len(doc_ids)), np.zeros(len(doc_ids), dtype=bool)
            for at in range(ends[r - 1] if r else 0, ends[r]):
                span = slice(starts[codes[at]], starts[codes[at] + 1])
                score[doc[span]] += values[at] * impact[span]
                met[doc[span]] = True
            some = np.flatnonzero(met)
            s = np.round(score[some], digits)
            if len(some) > k:
                some = some[s >= np.partition(s, len(s) - k)[len(s) - k]]
                some = some[np.lexsort((doc_ids[some], -np.round(score[some], digits)))[:k]]
            for column, x in zip(out, (np.full(len(some), ids[r]), doc_ids[some], score[some])):
                column.append(x)
        empty = np.zeros(0, dtype="int64")
        return pa.table([np.concatenate([empty, *out[0]]), np.concatenate([empty, *out[1]]),
                         np.concatenate([np.zeros(0), *out[2]])], names=["query_id", "doc_id", "score"])

    n = max(impacts.sparkSession.sparkContext.defaultParallelism, nq * nc)
    return routed.repartition(n, "bi", "bj").groupBy("bi", "bj").applyInArrow(pair, "query_id long, doc_id long, score double")


def hard_negatives(scores: DataFrame, positives: DataFrame, num_negatives: int = 5, digits: int = 6,
                   queries: DataFrame | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """RET-7: per query, the best-scoring documents that are not a positive.

    ``positives(query_id, doc_id)``; result ``(query_id, rank, doc_id, score)``.
    Only documents that share a term with a query are scored.  With ``queries``
    (query_id) and ``corpus`` (doc_id) the whole corpus is ranked: documents of
    score zero, by id, fill up what a query lacks (ties go to the smaller id).
    A document's positive queries are joined as one row by ``doc_id`` alone: scores that lie by
    document stay where they are, and all (query, document) pairs need no exchange.
    """
    pos = materialize(positives.select("query_id", "doc_id").distinct(), "positives")
    of_doc = pos.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list("query_id").alias("_queries"))
    open_pairs = scores.join(of_doc, (F.col("doc_id") == F.col("_doc")) & F.array_contains("_queries", F.col("query_id")),
                             "left_anti")
    ranked = top_k(open_pairs, num_negatives, digits).select("query_id", "rank", "doc_id", "score")
    if queries is None or corpus is None:
        return ranked
    ranked = materialize(ranked, "negatives")
    # a query with fewer than n negatives has all its scored documents among them; besides these and
    # its positives, n documents of the corpus suffice to fill it up
    have = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"))
    known = pos.groupBy("query_id").agg(F.count(F.lit(1)).alias("known"))
    lacking = (queries.select("query_id").distinct().join(have, "query_id", "left").join(known, "query_id", "left")
               .where(F.coalesce("have", F.lit(0)) < num_negatives)
               .select("query_id", (F.coalesce("known", F.lit(0)) + 2 * num_negatives).cast("long").alias("wide")))
    widest = lacking.agg(F.max("wide").alias("w")).first()["w"]
    if widest is None:
        return ranked
    pool = with_position(corpus.select("doc_id").distinct(), ["doc_id"], pos_col="_p").where(F.col("_p") < widest)
    slots = lacking.select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1)).alias("_p"))
    taken = ranked.select("query_id", "doc_id").union(pos)
    zero = slots.join(pool, "_p").select("query_id", "doc_id").join(taken, ["query_id", "doc_id"], "left_anti")
    both = ranked.select("query_id", "doc_id", "score").union(zero.withColumn("score", F.lit(0.0)))
    return top_k(both, num_negatives, digits).select("query_id", "rank", "doc_id", "score")


def collect_negatives(ranked: DataFrame) -> DataFrame:
    """(query_id, negatives array in rank order) — bounded by num_negatives per query."""
    return ranked.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
        .alias("negatives"))


def _pieces(token: str, lengths: list[int], kind: str) -> F.Column:
    """array<string>: the token's beginnings, ends, or all pieces of the given lengths."""
    size = F.length(token)

    def cut(n: int) -> F.Column:
        if kind == "begin":
            return F.array(F.substring(token, 1, n))
        if kind == "end":
            return F.array(F.substr(F.col(token), size - n + 1, F.lit(n)))
        return F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substr(F.col(token), i, F.lit(n)))

    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*[F.when(size >= n, cut(n)).otherwise(none) for n in lengths])))


def verbatim_qrels(queries: DataFrame, corpus: DataFrame, index: LexicalIndex,
                   q_text: str = "text", q_id: str = "query_id", d_text: str = "text", d_id: str = "doc_id") -> DataFrame:
    """(query_id, doc_id) where the document contains the query text verbatim.

    Candidates come from equi-joins on one token of the query; ``instr`` then
    verifies.  From three tokens on it is the rarest *interior* token, which is
    delimited inside the query and so a whole token wherever the query occurs.
    The tokens of shorter queries may be parts of a document's tokens: the first
    of two ends one, the second begins one (the longer of both is used), a
    single one lies anywhere in one.  The term table's distinct tokens are cut
    into such pieces of just the lengths that short queries have.  Queries
    without any token (marks only, or empty) are compared with every document.
    """
    qt = queries.select(F.col(q_id).alias("query_id"), F.col(q_text).alias("q_text")).where(F.col("q_text").isNotNull())
    small = small_enough(qt)   # a few rows at most are derived from each query
    qa = qt.select("query_id", "q_text", words(F.col("q_text")).alias("_a")).withColumn("n", F.size("_a"))
    toks = explode_items(qa.where("n >= 3"), ["query_id", "n"], F.col("_a"), "token", "p")
    interior = toks.where((F.col("p") > 0) & (F.col("p") < F.col("n") - 1))
    rare = (interior.join(index.terms, "token")
            .groupBy("query_id").agg(F.min_by("token", F.struct("df", "token")).alias("token")))
    first, last = F.element_at("_a", 1), F.element_at("_a", -1)
    kind = (F.when(F.col("n") == 1, "any").when(F.length(first) >= F.length(last), "end").otherwise("begin"))
    short = qa.where("n BETWEEN 1 AND 2").select(
        "query_id", kind.alias("kind"), F.when(kind == "begin", last).otherwise(first).alias("piece"))
    for row in short.groupBy("kind").agg(F.collect_set(F.length("piece")).alias("lengths")).collect():
        pieces = index.terms.select("token", F.explode(_pieces("token", sorted(row["lengths"]), row["kind"])).alias("piece"))
        mine = short.where(F.col("kind") == row["kind"]).select("query_id", "piece")
        rare = rare.union(pieces.join(_bc(mine, small), "piece").select("query_id", "token"))
    docs = corpus.select(F.col(d_id).alias("doc_id"), F.col(d_text).alias("d_text"))
    # as many partitions as the tables need: what a task sorts does not grow with them
    spark, size = corpus.sparkSession, _rows_and_bytes(docs, "d_text")[1]
    postings = index.postings.select("doc_id", "token")
    if small and not short.take(1):
        hits = postings.join(F.broadcast(rare), "token")
    else:
        n = _tasks(spark, max(size, input_bytes(index.docs)), TASK_BYTES)
        hits = postings.repartition(n, "token").join(rare.repartition(n, "token"), "token")
    cand = hits.select("query_id", "doc_id").distinct()
    n = _tasks(spark, size, TASK_BYTES)
    pairs = cand.repartition(n, "doc_id").join(docs.repartition(n, "doc_id"), "doc_id").join(_bc(qt, small), "query_id")
    found = pairs.where(F.instr(F.col("d_text"), F.col("q_text")) > 0).select("query_id", "doc_id")
    bare = qa.where("n = 0").select("query_id", "q_text")
    if bare.take(1):
        found = found.union(docs.join(_bc(bare, small), F.col("d_text").contains(F.col("q_text"))).select("query_id", "doc_id"))
    return found


def vocab_first_seen(tokens: DataFrame, doc_order: str = "doc_id") -> DataFrame:
    """RET-2: token -> id in order of first occurrence (document order, then position)."""
    first = tokens.groupBy("token").agg(F.min(F.struct(F.col(doc_order).alias("d"), F.col("tok_pos").alias("p")))
                                        .alias("f"))
    first = first.select("token", F.col("f.d").alias("_d"), F.col("f.p").alias("_p"))
    return with_position(first, ["_d", "_p"], pos_col="id").select("token", "id")


def df_stopwords(index: LexicalIndex, max_df_ratio: float = 0.5) -> DataFrame:
    """A stopword table by rule: tokens found in more than ``max_df_ratio`` of the documents."""
    return index.terms.where(F.col("df") > F.lit(max_df_ratio * index.n_docs)).select(F.col("token").alias("word"))


def save_index(index: LexicalIndex, path: str) -> None:
    """SNK-8 / RET-9: persist a fitted index (document rows with their norms, terms, scalars) as Parquet."""
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    spark = index.docs.sparkSession
    spark.createDataFrame([(index.n_docs, index.avgdl)], "n_docs long, avgdl double") \
        .write.mode("overwrite").parquet(f"{path}/stats")


def load_index(spark, path: str) -> LexicalIndex:
    """Read an index written by ``save_index``."""
    st = spark.read.parquet(f"{path}/stats").first()
    return LexicalIndex(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/terms"),
                        int(st["n_docs"]), float(st["avgdl"]))
