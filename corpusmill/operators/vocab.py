"""Vocabulary work (VOC-*): corpus lines, special tokens, char / word vocabularies,
merge, extension and encoding by whole words (subword vocabularies are learnt in
``bpe_trainer`` and ``unigram_trainer`` and applied in ``encode``).

Vocabularies are tables ``(token, id[, score])``.  Counting is a partial
aggregate; ranking a vocabulary uses ``with_position`` (no single-partition
window), except the character table whose size is bounded by the Unicode code
space.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chars, explode_items, newline_to_space, words
from ..session import ship_package
from .position import with_position

# Control tokens of the vocabulary trainer, and the unknown token.
CONTROL_TOKENS = ("<pad>", "<s>", "</s>")
UNK_TOKEN = "<unk>"

VOCAB_BROADCAST_ROWS = 2_000_000


def corpus_lines(df: DataFrame, text_column: str | None = None, id_col: str | None = None) -> DataFrame:
    """VOC-1: one training line per sample, newlines turned into spaces.

    The text column falls back to ``text``, then to an empty string.
    """
    if text_column and text_column in df.columns:
        c = F.col(text_column)
    elif "text" in df.columns:
        c = F.col("text")
    else:
        c = F.lit("")
    cols = [F.col(id_col)] if id_col else []
    return df.select(*cols, newline_to_space(F.coalesce(c, F.lit(""))).alias("line"))


def special_token_kinds(tokens: DataFrame, col: str = "token") -> DataFrame:
    """VOC-2: 'control' for <pad> <s> </s>, 'user_defined' for the rest, <unk> dropped."""
    return (tokens.where(F.col(col) != UNK_TOKEN)
            .select(F.col(col).alias("token"),
                    F.when(F.col(col).isin(list(CONTROL_TOKENS)), "control").otherwise("user_defined").alias("kind")))


def char_vocab(df: DataFrame, text_col: str, character_coverage: float = 1.0) -> DataFrame:
    """VOC-3 char model: most frequent characters covering ``character_coverage`` of all occurrences.

    Result ``(token, n, id)``; ids by descending frequency, ties by character.
    """
    counts = explode_items(df, [], chars(F.col(text_col)), "token").groupBy("token").agg(
        F.count(F.lit(1)).alias("n"))
    # the alphabet is bounded by the Unicode code space: one ordered window is fine
    w = Window.orderBy(F.col("n").desc(), F.col("token"))
    ranked = counts.select("token", "n", (F.row_number().over(w) - 1).alias("id"),
                           F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
                           F.sum("n").over(Window.partitionBy()).alias("total"))
    keep = F.coalesce(F.col("before"), F.lit(0)) < F.lit(character_coverage) * F.col("total")
    return ranked.where(keep).select("token", "n", F.col("id").cast("bigint").alias("id"))


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    return explode_items(df, [], words(F.col(text_col)), "token").groupBy("token").agg(
        F.count(F.lit(1)).alias("n"))


def word_vocab(df: DataFrame, text_col: str, vocab_size: int) -> DataFrame:
    """VOC-3 word model: the ``vocab_size`` most frequent words, ids by (count desc, word).

    Up to 100 000 words the top-k is a TakeOrdered and its ranking one window
    over that bounded result; beyond, positions are computed distributed.
    """
    counts = word_counts(df, text_col)
    if vocab_size <= 100_000:
        top = counts.orderBy(F.col("n").desc(), F.col("token")).limit(vocab_size)
        w = Window.orderBy(F.col("n").desc(), F.col("token"))
        return top.select("token", "n", (F.row_number().over(w) - 1).cast("bigint").alias("id"))
    ranked = with_position(counts.withColumn("_neg", -F.col("n")), ["_neg", "token"], pos_col="id")
    return ranked.where(F.col("id") < vocab_size).drop("_neg")


def merge_vocabs(base: DataFrame, additional: DataFrame) -> DataFrame:
    """VOC-5 / SET-4: base pieces in base order, then unseen additional pieces in their order.

    Inputs ``(piece, score, id)``; output ``(piece, score, id)`` with dense ids.
    """
    b = base.select("piece", "score", F.lit(0).alias("_src"), F.col("id").alias("_o"))
    extra = additional.join(base.select("piece"), "piece", "left_anti") \
                      .select("piece", "score", F.lit(1).alias("_src"), F.col("id").alias("_o"))
    both = b.unionByName(extra)
    return with_position(both, ["_src", "_o"], pos_col="id").select("piece", "score", "id")


def extend_vocab(vocab: DataFrame, new_tokens: DataFrame) -> DataFrame:
    """VOC-4: append tokens not already present, in list order, with the next ids.

    ``vocab(token, id)``; ``new_tokens(token, kind, pos)`` with kind 'normal' or
    'special' (normal tokens first, then special, each in ``pos`` order).
    Result ``(token, id, kind)``; existing tokens keep kind 'base'.
    """
    max_id = vocab.agg(F.max("id").alias("m")).first()["m"]
    start = -1 if max_id is None else int(max_id)
    fresh = (new_tokens.withColumn("_k", F.when(F.col("kind") == "normal", 0).otherwise(1))
             .groupBy("token").agg(F.min(F.struct("_k", "pos", "kind")).alias("f"))
             .select("token", F.col("f._k").alias("_k"), F.col("f.pos").alias("_p"), F.col("f.kind").alias("kind")))
    fresh = fresh.join(vocab.select("token"), "token", "left_anti")
    fresh = with_position(fresh, ["_k", "_p", "token"], pos_col="_r")
    added = fresh.select("token", (F.col("_r") + F.lit(start + 1)).alias("id"), "kind")
    return vocab.select("token", F.col("id").cast("bigint").alias("id"), F.lit("base").alias("kind")).unionByName(added)


def encode(tokens: DataFrame, vocab: DataFrame, unk_id: int, doc_col="doc_id",
           vocab_rows: int | None = None) -> DataFrame:
    """VOC-6: (key..., tok_pos, token) -> (key..., ids array in position order); unknown -> unk_id.

    ``vocab_rows`` is a known bound on the vocabulary size (e.g. ``vocab_size``);
    below ``VOCAB_BROADCAST_ROWS`` the vocabulary is broadcast, otherwise AQE
    chooses from measured sizes.
    """
    keys = [doc_col] if isinstance(doc_col, str) else list(doc_col)
    v = vocab.select("token", F.col("id").alias("_id"))
    if vocab_rows is not None and vocab_rows <= VOCAB_BROADCAST_ROWS:
        v = F.broadcast(v)
    ided = tokens.join(v, "token", "left").select(*keys, "tok_pos", F.coalesce("_id", F.lit(unk_id)).alias("id"))
    return ided.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("tok_pos", "id"))), lambda x: x["id"]).alias("ids"))


def encode_texts(df: DataFrame, text_col: str, key_cols: list[str], vocab: DataFrame, unk_id: int,
                 vocab_rows: int | None = None) -> DataFrame:
    """VOC-6 from raw texts.  Result ``(key..., ids)``, one row per key; rows without
    tokens (null texts too) have an empty array.

    A vocabulary of at most ``VOCAB_BROADCAST_ROWS`` is looked up where the text is
    read, a batch of token arrays at a time: no row per token and no exchange.  Rows
    that share a key (found by their keys alone) are merged by token position.  A larger
    vocabulary is joined, with rows hash-partitioned by their key first.
    """
    if vocab_rows is None or vocab_rows > VOCAB_BROADCAST_ROWS:
        base = df.repartition(*[F.col(k) for k in key_cols]).select(*key_cols, words(F.col(text_col)).alias("_cm_arr"))
        toks = base.select(*key_cols, F.posexplode_outer("_cm_arr").alias("tok_pos", "token"))
        ided = toks.join(vocab.select("token", F.col("id").alias("_id")), "token", "left")
        known = F.when(F.col("token").isNotNull(), F.struct("tok_pos", F.coalesce("_id", F.lit(unk_id)).alias("id")))
        return ided.groupBy(*key_cols).agg(
            F.transform(F.array_sort(F.collect_list(known)), lambda x: x["id"]).alias("ids"))
    rows = _looked_up(df, text_col, key_cols, vocab, unk_id)
    shared = df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("_cm_n")).where("_cm_n > 1").drop("_cm_n")
    if shared.isEmpty():
        return rows
    same = reduce(and_, [rows[k].eqNullSafe(shared[k]) for k in key_cols])
    each = rows.join(shared, same, "left_semi").select(*key_cols, F.posexplode_outer("ids").alias("tok_pos", "id"))
    known = F.when(F.col("tok_pos").isNotNull(), F.struct("tok_pos", "id"))
    merged = each.groupBy(*key_cols).agg(F.transform(F.array_sort(F.collect_list(known)), lambda x: x["id"]).alias("ids"))
    return rows.join(shared, same, "left_anti").unionByName(merged)


def _looked_up(df: DataFrame, text_col: str, key_cols: list[str], vocab: DataFrame, unk_id: int) -> DataFrame:
    """(key..., ids) per row, by a broadcast vocabulary."""
    kind = dict(vocab.dtypes)["id"]
    rows = vocab.where(F.col("token").isNotNull()).select("token", F.coalesce("id", F.lit(unk_id)).cast("long").alias("id")).toArrow()
    ship_package(df.sparkSession)
    # a token that the vocabulary lacks has the last number
    numbers = np.append(rows.column("id").to_numpy(), unk_id)
    shared = df.sparkSession.sparkContext.broadcast((rows.column("token").to_pylist(), numbers))
    src = df.select(*key_cols, words(F.col(text_col)).alias("_cm_arr"))
    fields = ", ".join(f"`{k}` {t}" for k, t in src.dtypes[:-1])

    def work(batches):
        tokens, numbers = shared.value
        known = pa.array(tokens, pa.string())
        for b in batches:
            arrays = b.column(b.num_columns - 1)
            found = pc.index_in(arrays.flatten().cast(pa.string()), value_set=known)
            ids = numbers[found.fill_null(len(tokens)).to_numpy(zero_copy_only=False)]
            ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], [*key_cols, "ids"])

    return src.mapInArrow(work, f"{fields}, ids array<long>").withColumn("ids", F.col("ids").cast(f"array<{kind}>"))
