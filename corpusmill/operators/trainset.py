"""Training-set construction (TRN-*, SPL-6): packing, line examples, masking, pairs.

All per-token work is array expressions on one row, or an explode whose
regrouping key is bounded (a packed block holds ``block_size`` tokens, a map
batch ``batch_rows`` documents).  Randomness is a hash of (seed, row, position),
so a rerun after executor loss produces the same masks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, release
from .position import input_bytes, shuffle_key, with_position

#: Written bytes of encoded rows that a packing task is meant to hold.
PACK_BYTES = 32 << 20


def _draw(digest: F.Column, no: int = 0) -> F.Column:
    """Deterministic U[0,1): the ``no``-th eight hex digits of a digest / 2^32."""
    return F.conv(F.substring(digest, 8 * no + 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def _below(digest: F.Column, limit: float, no: int = 0) -> F.Column:
    """``_draw(digest, no) < limit``, by the order of the hex digits."""
    least = math.ceil(limit * 2 ** 32)
    if least <= 0 or least >= 2 ** 32:
        return digest.isNotNull() & F.lit(least > 0)
    return (F.substring(digest, 8 * no + 1, 8) if no else digest) < F.lit(f"{least:08x}")


def effective_block_size(requested: int | None, model_max: int, default_cap: int = 1024) -> int:
    """TRN-1: min(requested, model max); without a request min(model max, 1024)."""
    if requested is None:
        return min(model_max, default_cap)
    return min(requested, model_max)


def pack_blocks(encoded: DataFrame, block_size: int, order_col: str = "doc_id", ids_col: str = "ids",
                batch_rows: int = 1000, other_cols: tuple[str, ...] = ()) -> DataFrame:
    """TRN-2/3: concatenate token arrays per map batch, cut blocks of ``block_size``, drop the rest.

    Batch = floor(position / batch_rows) in ``order_col`` order, as in a batched
    map; rows without tokens count as rows.  ``other_cols`` are arrays as long as
    the ids (a special-token mask, say) that are packed along with them.  Result
    ``(batch, block, input_ids, labels, *other_cols)``.

    A row is cut into the pieces that fall into each block it overlaps; a block
    then gathers its pieces (at most ``block_size`` of them), so no row per token
    is ever made.
    """
    cols = [ids_col, *other_cols]
    # written first: the range partitioning samples its input, which would be computed twice
    encoded = materialize(encoded.select(order_col, *cols), "encoded")
    pos = with_position(encoded, [order_col], pos_col="_pos")
    spark = encoded.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(encoded) // PACK_BYTES)
    release(encoded)
    pos = pos.withColumn("batch", F.floor(F.col("_pos") / batch_rows)).repartition(n, "batch").withColumn(
        "_len", F.greatest(F.size(ids_col), F.lit(0)).cast("bigint"))
    # running offset inside a batch: a window over at most batch_rows rows
    w = Window.partitionBy("batch").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    pos = pos.withColumn("_off", F.coalesce(F.sum("_len").over(w), F.lit(0))).where("_len > 0")
    first, last = F.floor(F.col("_off") / block_size), F.floor((F.col("_off") + F.col("_len") - 1) / block_size)
    parts = pos.select("batch", "_off", "_len", *cols, F.explode(F.sequence(first, last)).alias("block"))
    at = F.greatest(F.col("block") * block_size - F.col("_off"), F.lit(0))
    stop = F.least((F.col("block") + 1) * block_size - F.col("_off"), F.col("_len"))
    parts = parts.select("batch", "block", F.struct("_off", *[
        F.slice(F.col(c), (at + 1).cast("int"), (stop - at).cast("int")).alias(f"_{i}") for i, c in enumerate(cols)])
        .alias("_part"))
    blocks = parts.groupBy("batch", "block").agg(F.array_sort(F.collect_list("_part")).alias("_all"))
    whole = blocks.select("batch", "block", *[
        F.flatten(F.col(f"_all._{i}")).alias(c) for i, c in enumerate(["input_ids", *other_cols])]).where(F.size("input_ids") == block_size)
    return whole.select("batch", "block", "input_ids", F.col("input_ids").alias("labels"), *other_cols)


def line_examples(encoded: DataFrame, max_len: int, bos_id: int, eos_id: int, pad_id: int,
                  pad_to_max: bool = True, ids_col: str = "ids") -> DataFrame:
    """TRN-4: [bos] + ids + [eos], the ids cut so that both ends fit max_len, optionally padded; masks.

    Adds ``input_ids``, ``attention_mask`` and ``special_tokens_mask``.
    """
    if max_len < 2:
        raise ValueError("max_len must leave room for the two special tokens")
    full = F.concat(F.array(F.lit(bos_id)), F.slice(F.col(ids_col), 1, max_len - 2), F.array(F.lit(eos_id)))
    out = encoded.withColumn("_ids", full).withColumn("_n", F.size("_ids"))
    pad = F.array_repeat(F.lit(pad_id), F.greatest(F.lit(max_len) - F.col("_n"), F.lit(0)))
    ids = F.concat("_ids", pad) if pad_to_max else F.col("_ids")
    ones = F.array_repeat(F.lit(1), F.col("_n"))
    zeros = F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - F.col("_n"), F.lit(0)))
    att = F.concat(ones, zeros) if pad_to_max else ones
    out = out.withColumn("input_ids", ids).withColumn("attention_mask", att)
    special = [bos_id, eos_id, pad_id]
    out = out.withColumn("special_tokens_mask",
                         F.transform("input_ids", lambda x: x.isin(special).cast("int")))
    return out.drop("_ids", "_n")


def mask_tokens(df: DataFrame, row_col: str, mask_id: int, vocab_size: int, probability: float = 0.15,
                seed: int = 42, mode: str = "default", ids_col: str = "input_ids",
                special_col: str | None = "special_tokens_mask") -> DataFrame:
    """TRN-6/7: choose non-special positions with probability p; labels keep their
    original ids there and are -100 elsewhere.

    mode 'all_mask': every chosen token becomes ``mask_id``.  mode 'default':
    80 % mask, 10 % a random id in [0, vocab_size), 10 % unchanged.  All numbers
    of a position come from one digest of (seed, row, position).
    """
    if mode not in ("default", "all_mask"):
        raise ValueError("mode must be 'default' or 'all_mask'")
    sp = F.col(special_col) if special_col else F.array_repeat(F.lit(0), F.size(ids_col))

    def digest(i):
        return F.md5(F.concat("_cm_row", i.cast("string")))

    def replaced(e, i):
        if mode == "all_mask":
            return F.when(e["on"], F.lit(mask_id)).otherwise(e["id"])
        # few positions are chosen: their digests are made again rather than kept
        return (F.when(~e["on"], e["id"]).when(_below(digest(i), 0.8, 1), F.lit(mask_id))
                .when(_below(digest(i), 0.9, 1), F.floor(_draw(digest(i), 2) * vocab_size).cast("int")).otherwise(e["id"]))

    picked = F.transform(sp, lambda s, i: (s == 0) & _below(digest(i), probability))
    done = df.withColumn("_cm_row", F.concat(F.lit(f"{seed}:"), F.col(row_col).cast("string"), F.lit(":")))
    done = done.withColumn("_cm_picked", F.arrays_zip(F.col(ids_col).alias("id"), picked.alias("on")))
    labels = F.transform("_cm_picked", lambda e: F.when(e["on"], e["id"]).otherwise(F.lit(-100)))
    return done.withColumn("labels", labels).withColumn(ids_col, F.transform("_cm_picked", replaced)).drop(
        "_cm_row", "_cm_picked")


def pair_encode(pairs: DataFrame, ids1: str, ids2: str, max_len: int, cls_id: int, sep_id: int, pad_id: int,
                order_by: list, batch_size: int = 32, multiple_of: int = 8) -> DataFrame:
    """TRN-5: [cls] a [sep] b [sep]; padded per batch to the batch's longest row rounded up to ``multiple_of``.

    A pair that is too long loses ids from its longer side until both are equally
    long, then from both; the three special tokens always stay.
    """
    room = max_len - 3
    if room < 0:
        raise ValueError("max_len must leave room for the three special tokens")
    la, lb = F.size(ids1), F.size(ids2)
    short = F.least(la, lb, F.lit(room // 2))
    fits = la + lb <= room
    keep1 = F.when(fits, la).when(la <= lb, short).otherwise(room - short)
    keep2 = F.when(fits, lb).when(la <= lb, room - short).otherwise(short)
    ids = F.concat(F.array(F.lit(cls_id)), F.slice(F.col(ids1), F.lit(1), keep1), F.array(F.lit(sep_id)),
                   F.slice(F.col(ids2), F.lit(1), keep2), F.array(F.lit(sep_id)))
    pos = with_position(pairs.withColumn("_ids", ids), list(order_by), pos_col="_pos")
    pos = pos.withColumn("batch", F.floor(F.col("_pos") / batch_size)).withColumn("_n", F.size("_ids"))
    # batch max: a window over at most batch_size rows
    blen = F.ceil(F.max("_n").over(Window.partitionBy("batch")) / multiple_of) * multiple_of
    pos = pos.withColumn("_L", F.least(blen, F.lit(((max_len + multiple_of - 1) // multiple_of) * multiple_of)))
    pad = F.array_repeat(F.lit(pad_id), (F.col("_L") - F.col("_n")).cast("int"))
    out = pos.withColumn("input_ids", F.concat("_ids", pad)) \
             .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.col("_n")),
                                                    F.array_repeat(F.lit(0), (F.col("_L") - F.col("_n")).cast("int"))))
    return out.drop("_ids", "_n", "_L", "_pos")


def next_turn_pairs(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                    role_col: str = "role", text_col: str = "text", first_role: str = "user",
                    second_role: str = "assistant") -> DataFrame:
    """Consecutive (first_role, second_role) turns of a conversation as (anchor, positive).

    An equi-join on (conversation, turn + 1): a long conversation spreads over
    the hash of its turn numbers instead of one window task.
    """
    a = turns.where(F.col(role_col) == first_role).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(text_col).alias("anchor"))
    b = turns.where(F.col(role_col) == second_role).select(
        F.col(conv_col).alias("conv_id"), (F.col(turn_col) - 1).alias("turn"), F.col(text_col).alias("positive"))
    return a.join(b, ["conv_id", "turn"])


def batches_by_label(df: DataFrame, label_col: str, id_cols: list[str], batch_size: int, seed: int = 42) -> DataFrame:
    """SPL-6: shuffle within each label and cut into batches holding one label each."""
    keyed = df.withColumn("_k", shuffle_key(seed, *id_cols))
    pos = with_position(keyed, ["_k", *id_cols], partition_by=[label_col], pos_col="_rn")
    return pos.withColumn("batch", F.floor(F.col("_rn") / batch_size)).drop("_k", "_rn")


def joined_text(df: DataFrame, text_fields: list[str]) -> F.Column:
    """PRJ-8: the fields, in the order they are named, joined by a space (nulls skipped, arrays flattened)."""
    from ..functions.text import py_strip

    arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    return py_strip(F.concat_ws(" ", *[F.col(f).cast("array<string>" if f in arrays else "string") for f in text_fields]))


def build_texts(df: DataFrame, text_fields: list[str], out_col: str = "text") -> DataFrame:
    """PRJ-8 / FLT-13: ``joined_text``, keeping non-empty results; raise when none is left."""
    out = df.withColumn(out_col, joined_text(df, text_fields)).where(F.col(out_col) != "")
    if out.isEmpty():
        raise ValueError("no non-empty text could be built from " + ", ".join(text_fields))
    return out


def text_column(df: DataFrame, name: str = "text") -> str:
    """PRJ-9: the configured column if the table has it, else the table's first column."""
    return name if name in df.columns else df.columns[0]


def role_pairs(df: DataFrame, roles: dict[str, str], max_samples: int | None = None, id_cols: list[str] | None = None,
               seed: int = 42) -> DataFrame:
    """PRJ-3 / TRN-9: role columns of a contrastive set; ``roles`` maps anchor, positive[, negative][, label] to columns.

    Roles that are not mapped are left out.  With ``max_samples`` a seeded
    shuffle by ``id_cols`` is cut to that many rows.
    """
    if not {"anchor", "positive"} <= set(roles) or not set(roles) <= {"anchor", "positive", "negative", "label"}:
        raise ValueError("roles are anchor, positive and, if wanted, negative and label")
    from .sampling import shuffle_take

    rows = df if max_samples is None else shuffle_take(df, max_samples, list(id_cols or df.columns), seed)
    keep = [F.col(c) for c in (id_cols or []) if c not in roles]
    return rows.select(*keep, *[F.col(roles[r]).alias(r) for r in ("anchor", "positive", "negative", "label") if r in roles])


def evaluation_pairs(queries: DataFrame, corpus: DataFrame, num_examples: int, passages_col: str = "positive_passages",
                     query_id: str = "query_id", text_col: str = "text", corpus_id: str = "doc_id",
                     seed: int = 42) -> DataFrame:
    """TRN-10 / PRJ-11 / FLT-12: (kind, pair_id, text1, text2) for alignment and uniformity.

    ``positive``: the first two passages (``array<struct<text>>``) of the first
    ``num_examples`` queries, by id, that have two; ``random``: rows i and i + n of
    the corpus under a seeded shuffle, n being the number of positive pairs.
    """
    from .sampling import cap_prefix

    two = queries.where(F.size(passages_col) >= 2).select(
        F.lit("positive").alias("kind"), F.col(query_id).alias("pair_id"),
        F.col(passages_col)[0]["text"].alias("text1"), F.col(passages_col)[1]["text"].alias("text2"))
    positive = cap_prefix(two, num_examples, ["pair_id"])
    n = positive.count()
    texts = corpus.select(F.col(corpus_id).alias("_id"), F.col(text_col).alias("_t"))
    order = with_position(texts.withColumn("_k", shuffle_key(seed, "_id")), ["_k", "_id"], pos_col="_p")
    left = order.where(F.col("_p") < n).select(F.col("_p").alias("pair_id"), F.col("_t").alias("text1"))
    right = order.where((F.col("_p") >= n) & (F.col("_p") < 2 * n)).select((F.col("_p") - n).alias("pair_id"),
                                                                          F.col("_t").alias("text2"))
    return positive.unionByName(left.join(right, "pair_id").select(F.lit("random").alias("kind"), "pair_id", "text1", "text2"))


def mask_token_id(vocab: DataFrame, choice: str, eos_token: str = "</s>", mask_token: str = "<mask>",
                  blank_token: str = "_") -> int | None:
    """TRN-8: the id used for masking — the blank piece, the end-of-sequence token,
    or a mask token (None when the vocabulary lacks it: extend it first with
    ``vocab.extend_vocab``).  One small lookup in the vocabulary table."""
    token = {"blank": blank_token, "eos": eos_token, "mask": mask_token}[choice]
    row = vocab.where(F.col("token") == token).select("id").first()
    return None if row is None else int(row["id"])


def cap_count(max_samples: int | None, n_rows: int) -> int:
    """AGG-22: rows used after a cap, min(max_samples, len)."""
    return n_rows if max_samples is None else min(max_samples, n_rows)
