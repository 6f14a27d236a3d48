"""Chat formatting: cumulative-snapshot collapse, then rendering.

Chat logs often hold the same conversation again and again, each time a few
turns longer.  Only maximal conversations are rendered:

1. Turns are numbered inside their conversation by (turn, role, text), null
   first, by range partitioning and counts, so a conversation that holds a third
   of all rows is numbered by many tasks.
2. Every turn is hashed with its number; the **rolling prefix hash** after turn i
   is the running sum of these hashes (three lanes of 40 bits).  Sums run inside
   chunks of ``CHUNK`` turns, and over the chunks' totals, so no window holds an
   unbounded group.
3. A conversation whose full hash and length are a proper prefix hash of another
   one is removed by an **anti-join**; of conversations that are equal turn by
   turn, the smallest id stays.  Prefixes are made distinct first (a greeting
   that opens a third of all conversations is one row).
4. What stays is rendered turn by turn.  A conversation of more than ``CHUNK``
   turns comes in several parts, one row each, so no row or group is unbounded.

DataFrame functions only; no Python runs on the executors.

Defined cases: rows that repeat within a conversation (same turn, role and text)
count once; a null role or text is empty; rows with a null id are one
conversation; marker strings inside texts are broken up by a blank; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.position import with_position
from .common import cut, read

#: Turns of a chunk, and of a part of the rendered conversation.
CHUNK = 1024
_LANES = ("_cm_p1", "_cm_p2", "_cm_p3")
_MASK = (1 << 40) - 1


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Add to numbered turns (conv, pos, n, role, text) the rolling hash lanes of the prefix that ends at the turn."""
    lanes = [F.xxhash64(F.lit(i), "pos", "role", "text").bitwiseAND(F.lit(_MASK)).alias(f"_cm_h{i}") for i in (1, 2, 3)]
    chunked = turns.withColumn("_cm_chunk", F.floor(F.col("pos") / CHUNK)).select("*", *lanes)
    inside = Window.partitionBy("conv", "_cm_chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.select("conv", "pos", "n", "role", "text", "_cm_chunk",
                           *[F.sum(f"_cm_h{i}").over(inside).alias(f"_cm_s{i}") for i in (1, 2, 3)])
    totals = chunked.groupBy("conv", "_cm_chunk").agg(
        *[F.sum(f"_cm_h{i}").bitwiseAND(F.lit(_MASK)).alias(f"_cm_t{i}") for i in (1, 2, 3)])
    earlier = Window.partitionBy("_cm_c").orderBy("_cm_k").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("conv").alias("_cm_c"), F.col("_cm_chunk").alias("_cm_k"), "_cm_t1", "_cm_t2",
                            "_cm_t3").select(
        "_cm_c", "_cm_k", *[F.coalesce(F.sum(f"_cm_t{i}").over(earlier), F.lit(0)).alias(f"_cm_o{i}") for i in (1, 2, 3)])
    # conversations of one chunk need no offset, so only later chunks are joined
    first = local.where("_cm_chunk = 0").select("conv", "pos", "n", "role", "text", *[
        F.col(f"_cm_s{i}").bitwiseAND(F.lit(_MASK)).alias(c) for i, c in enumerate(_LANES, 1)])
    rest = local.where("_cm_chunk > 0").join(
        offsets.where("_cm_k > 0"), F.col("conv").eqNullSafe(F.col("_cm_c")) & (F.col("_cm_chunk") == F.col("_cm_k")))
    return first.union(rest.select("conv", "pos", "n", "role", "text", *[
        (F.col(f"_cm_s{i}") + F.col(f"_cm_o{i}")).bitwiseAND(F.lit(_MASK)).alias(c) for i, c in enumerate(_LANES, 1)]))


def maximal(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """(conv, pos, n, role, text) of the turns of every maximal conversation."""
    plain = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                         F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).distinct()
    numbered = with_position(plain, ["turn", "role", "text"], ["conv"], pos_col="pos", size_col="n")
    hashed = cut(prefix_hashes(numbered.select("conv", "pos", "n", "role", "text")), "chat")
    size = (F.col("pos") + 1).alias("len")
    proper = hashed.where("pos < n - 1").select(size, *_LANES).distinct()
    full = (hashed.where("pos = n - 1").groupBy(size, *_LANES)
            .agg(F.min(F.struct(F.col("conv").isNull().alias("none"), "conv")).alias("best")))
    stay = full.join(proper, ["len", *_LANES], "left_anti").select(F.col("best.conv").alias("_cm_stay"))
    return hashed.join(stay, F.col("conv").eqNullSafe(F.col("_cm_stay")), "left_semi").select(
        "conv", "pos", "n", "role", "text")


def chatml(role: Column, text: Column) -> Column:
    """One turn between its markers; markers inside the text are broken up."""
    def safe(c: Column) -> Column:
        return F.replace(F.replace(c, F.lit("<|im_start|>"), F.lit("<| im_start|>")), F.lit("<|im_end|>"),
                         F.lit("<| im_end|>"))
    return F.concat(F.lit("<|im_start|>"), safe(role), F.lit("\n"), safe(text), F.lit("<|im_end|>\n"))


def render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", template=chatml) -> DataFrame:
    """(conv_id, part, n_turns, text): the maximal conversations, rendered."""
    kept = maximal(turns, conv_col, turn_col, role_col, text_col)
    lines = kept.select("conv", "n", F.floor(F.col("pos") / CHUNK).alias("part"),
                        F.struct("pos", template(F.col("role"), F.col("text")).alias("line")).alias("one"))
    parts = lines.groupBy("conv", "part").agg(F.first("n").alias("n"), F.collect_list("one").alias("all"))
    text = F.array_join(F.transform(F.array_sort("all"), lambda x: x["line"]), "")
    return parts.select(F.col("conv").alias("conv_id"), "part", F.col("n").cast("long").alias("n_turns"),
                        text.alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return render(read(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, count(*) AS n,
             list({'r': role, 'x': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT list_slice(turns, 1, k) AS head FROM (SELECT turns, unnest(range(1, n)) AS k FROM c)),
f AS (SELECT min(conv_id) AS conv_id, turns FROM c GROUP BY turns),
m AS (SELECT conv_id, turns FROM f WHERE turns NOT IN (SELECT head FROM p)),
u AS (SELECT conv_id, len(turns) AS n, unnest(turns) AS one, generate_subscripts(turns, 1) - 1 AS pos FROM m)
SELECT conv_id, pos // 1024 AS part, any_value(n) AS n_turns,
       string_agg('<|im_start|>' || replace(replace(one.r, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>')
                  || chr(10) || replace(replace(one.x, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>')
                  || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM u GROUP BY conv_id, pos // 1024
"""
