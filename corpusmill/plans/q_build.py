"""Registered queries: vocabularies, encoding, packing, masking, pair and example building.

Shared vocabulary: the 30000 most frequent words of ``documents`` with ids from 5;
ids 0..4 are <pad>, <unk>, <s>/[CLS], </s>/[SEP], <mask>.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import bpe_trainer as BT
from ..operators import encode as EN
from ..operators import retrieval as R
from ..operators import trainset as TS
from ..operators import unigram_trainer as UT
from ..operators import vocab as V
from ..operators.position import with_position
from ..sources.tables import table
from . import sqltext as S

QUERIES: dict = {}
ORACLE: dict = {}

PAD, UNK, BOS, EOS, MASK, FIRST = 0, 1, 2, 3, 4, 5
VOCAB_WORDS = 30_000
VOCAB_SIZE = FIRST + VOCAB_WORDS


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _vocab(spark, d):
    v = V.word_vocab(table(spark, d, "documents"), "text", VOCAB_WORDS)
    return v.select("token", (F.col("id") + FIRST).alias("id"))


def _encoded_docs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return V.encode_texts(docs, "text", ["doc_id"], _vocab(spark, d), UNK, vocab_rows=VOCAB_WORDS)


W = S.words
_VOC_SQL = f"""
wc AS (SELECT token, count(*) AS n FROM (SELECT unnest({W('text')}) AS token FROM documents) GROUP BY 1),
voc AS (SELECT token, id FROM (SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 + {FIRST} AS id FROM wc)
        WHERE id < {VOCAB_SIZE}),
tok AS (SELECT doc_id, unnest({W('text')}) AS token, unnest(range(len({W('text')}))) AS p FROM documents),
ent AS (SELECT doc_id, list(coalesce(voc.id, {UNK}) ORDER BY p) AS ids FROM tok LEFT JOIN voc USING (token) GROUP BY doc_id),
enc AS (SELECT doc_id, coalesce(ids, []) AS ids FROM documents LEFT JOIN ent USING (doc_id))"""


@register("char_vocab",
          "WITH c AS (SELECT ch AS token, count(*) AS n FROM (SELECT unnest(list_filter(string_split(text, ''), "
          "lambda c: c <> '')) AS ch FROM documents) GROUP BY 1),\n"
          "r AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) - 1 AS id, "
          "coalesce(sum(n) OVER (ORDER BY n DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, "
          "sum(n) OVER () AS total FROM c)\nSELECT token, n, id FROM r WHERE before < 0.9995 * total")
def char_vocab_q(spark, d):
    """VOC-3 char model with character_coverage .9995."""
    return V.char_vocab(table(spark, d, "documents"), "text", 0.9995)


@register("word_vocab",
          f"WITH wc AS (SELECT token, count(*) AS n FROM (SELECT unnest({W('text')}) AS token FROM documents) GROUP BY 1)"
          " SELECT token, n, id FROM (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) - 1 AS id FROM wc)"
          f" WHERE id < {VOCAB_WORDS}")
def word_vocab_q(spark, d):
    """VOC-3 word model: vocab_size 1000."""
    return V.word_vocab(table(spark, d, "documents"), "text", VOCAB_WORDS)


def _lang_vocab_sql(lang: str, name: str) -> str:
    return (f"{name}c AS (SELECT token, count(*) AS n FROM (SELECT unnest({W('text')}) AS token FROM documents "
            f"WHERE lang = '{lang}') GROUP BY 1),\n"
            f"{name} AS (SELECT token AS piece, round(ln(n / (SELECT sum(n) FROM {name}c)), 6) AS score, id FROM "
            f"(SELECT token, n, row_number() OVER (ORDER BY n DESC, token) - 1 AS id FROM {name}c) WHERE id < 500)")


@register("vocab_merge",
          "WITH " + _lang_vocab_sql("en", "base") + ",\n" + _lang_vocab_sql("de", "addv") + ",\n"
          "u AS (SELECT piece, score, 0 AS src, id AS o FROM base UNION ALL "
          "SELECT piece, score, 1, id FROM addv WHERE piece NOT IN (SELECT piece FROM base))\n"
          "SELECT piece, score, row_number() OVER (ORDER BY src, o) - 1 AS id FROM u")
def vocab_merge_q(spark, d):
    """VOC-5: English word pieces, then unseen German pieces with their scores."""
    doc = table(spark, d, "documents")

    def lang_vocab(lang):
        sub = doc.where(F.col("lang") == lang)
        v = V.word_vocab(sub, "text", 500)
        total = V.word_counts(sub, "text").agg(F.sum("n").alias("t")).first()["t"]
        return v.select(F.col("token").alias("piece"), F.round(F.log(F.col("n") / F.lit(float(total))), 6)
                        .alias("score"), "id")
    return V.merge_vocabs(lang_vocab("en"), lang_vocab("de"))


@register("vocab_extend",
          f"WITH wc AS (SELECT token, count(*) AS n FROM (SELECT unnest({W('text')}) AS token FROM documents) GROUP BY 1),\n"
          "base AS (SELECT token, id FROM (SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS id FROM wc) "
          "WHERE id < 200),\n"
          f"bt AS (SELECT item_id, unnest({W('text')}) AS token, unnest(range(len({W('text')}))) AS p FROM benchmark),\n"
          "nt AS (SELECT token, 'normal' AS kind, 0 AS k, item_id AS a, p AS b FROM bt UNION ALL "
          "SELECT '<special1>', 'special', 1, 0, 0 UNION ALL SELECT '<special2>', 'special', 1, 0, 1),\n"
          "ft AS (SELECT token, arg_min(kind, (k, a, b)) AS kind, min((k, a, b)) AS o FROM nt GROUP BY token),\n"
          "fr AS (SELECT token, kind, o FROM ft WHERE token NOT IN (SELECT token FROM base))\n"
          "SELECT token, id, 'base' AS kind FROM base UNION ALL "
          "SELECT token, (SELECT max(id) FROM base) + row_number() OVER (ORDER BY o, token), kind FROM fr")
def vocab_extend_q(spark, d):
    """VOC-4: a 200-word vocabulary extended with benchmark words and two special tokens."""
    base = V.word_vocab(table(spark, d, "documents"), "text", 200).select("token", "id")
    bt = R.tokenize(table(spark, d, "benchmark"), "text", "item_id", "item_id")
    normal = bt.select("token", F.lit("normal").alias("kind"), F.struct("item_id", "tok_pos").alias("pos"))
    special = bt.sparkSession.createDataFrame(
        [("<special1>", "special", (0, 0)), ("<special2>", "special", (0, 1))],
        "token string, kind string, pos struct<item_id: bigint, tok_pos: int>")
    return V.extend_vocab(base, normal.unionByName(special))


@register("encode_ids", f"WITH {_VOC_SQL} SELECT doc_id, ids FROM enc")
def encode_ids(spark, d):
    """VOC-6: every document as vocabulary ids (unknown -> 1)."""
    return _encoded_docs(spark, d)


@register("corpus_lines", "SELECT doc_id, translate(text, chr(10), ' ') AS line FROM documents")
def corpus_lines_q(spark, d):
    """VOC-1: training lines for the vocabulary trainer."""
    return V.corpus_lines(table(spark, d, "documents"), "text", "doc_id")


_PACK_SQL = f"""{_VOC_SQL},
p AS (SELECT doc_id, [{BOS}] || ids || [{EOS}] AS ids,
      [1] || list_transform(ids, lambda x: 0) || [1] AS sp, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM enc),
b AS (SELECT ids, sp, pos // 1000 AS batch, CAST(coalesce(sum(len(ids)) OVER (PARTITION BY pos // 1000 ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM p),
t AS (SELECT batch, off, unnest(range(len(ids))) AS i, unnest(ids) AS tok, unnest(sp) AS s FROM b),
blk AS (SELECT batch, CAST((off + i) // 128 AS BIGINT) AS block, count(*) AS n, list(tok ORDER BY off + i) AS input_ids,
        list(s ORDER BY off + i) AS sp FROM t GROUP BY 1, 2),
packed AS (SELECT batch, block, input_ids, input_ids AS labels, sp AS special_tokens_mask FROM blk WHERE n = 128)"""


def _packed(spark, d):
    ids = F.concat(F.array(F.lit(BOS)), F.col("ids").cast("array<int>"), F.array(F.lit(EOS)))
    one = F.array(F.lit(1).cast("tinyint"))
    mask = F.concat(one, F.array_repeat(F.lit(0).cast("tinyint"), F.size("ids")), one)
    # narrow arrays while they are shuffled
    enc = _encoded_docs(spark, d).select("doc_id", ids.alias("ids"), mask.alias("special_tokens_mask"))
    packed = TS.pack_blocks(enc, 128, "doc_id", "ids", 1000, ("special_tokens_mask",))
    return packed.select("batch", "block", *[F.col(c).cast("array<bigint>").alias(c) for c in ("input_ids", "labels")],
                         F.col("special_tokens_mask").cast("array<int>").alias("special_tokens_mask"))


@register("pack_blocks", f"WITH {_PACK_SQL} SELECT * FROM packed")
def pack_blocks_q(spark, d):
    """TRN-2/3: blocks of 128 ids and their special-token mask per 1000-document map batch, remainder dropped."""
    return _packed(spark, d)


def _u_sql(no: int, row: str, i: str) -> str:
    return (f"(('0x' || substr(md5('42:' || {row} || ':' || CAST({i} AS VARCHAR)), {8 * no + 1}, 8))::BIGINT "
            "/ 4294967296.0)")


_ROW = "(CAST(batch AS VARCHAR) || '-' || CAST(block AS VARCHAR))"
_ON = f"(special_tokens_mask[i + 1] = 0 AND {_u_sql(0, _ROW, 'i')} < 0.15)"
_LABELS = f"list_transform(range(len(input_ids)), lambda i: CASE WHEN {_ON} THEN input_ids[i + 1] ELSE -100 END) AS labels"


@register("mask_full",
          f"WITH {_PACK_SQL} SELECT batch, block, "
          f"list_transform(range(len(input_ids)), lambda i: CASE WHEN {_ON} THEN {MASK} ELSE input_ids[i + 1] END) "
          f"AS input_ids, {_LABELS} FROM packed")
def mask_full(spark, d):
    """TRN-6: every chosen token (p .15, no special token) becomes <mask>; labels -100 elsewhere."""
    p = _packed(spark, d).drop("labels").withColumn("row", F.concat_ws("-", "batch", "block"))
    return TS.mask_tokens(p, "row", MASK, VOCAB_SIZE, 0.15, 42, "all_mask").select("batch", "block", "input_ids", "labels")


@register("mask_default",
          f"WITH {_PACK_SQL} SELECT batch, block, "
          f"list_transform(range(len(input_ids)), lambda i: CASE WHEN NOT {_ON} "
          f"THEN input_ids[i + 1] WHEN {_u_sql(1, _ROW, 'i')} < 0.8 THEN {MASK} "
          f"WHEN {_u_sql(1, _ROW, 'i')} < 0.9 THEN CAST(floor({_u_sql(2, _ROW, 'i')} * {VOCAB_SIZE}) AS BIGINT) "
          f"ELSE input_ids[i + 1] END) AS input_ids, {_LABELS} FROM packed")
def mask_default(spark, d):
    """TRN-7: 80 % <mask>, 10 % random id, 10 % unchanged among chosen tokens."""
    p = _packed(spark, d).drop("labels").withColumn("row", F.concat_ws("-", "batch", "block"))
    return TS.mask_tokens(p, "row", MASK, VOCAB_SIZE, 0.15, 42, "default").select("batch", "block", "input_ids", "labels")


_LINES_SQL = f"""{_VOC_SQL},
lines AS (SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line
          FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
nb AS (SELECT * FROM lines WHERE {S.strip('line')} <> ''),
lt AS (SELECT doc_id, line_no, unnest({W('line')}) AS token, unnest(range(len({W('line')}))) AS p FROM nb),
le AS (SELECT doc_id, line_no, list(coalesce(voc.id, {UNK}) ORDER BY p) AS ids FROM lt LEFT JOIN voc USING (token)
       GROUP BY 1, 2),
x AS (SELECT nb.doc_id, nb.line_no, coalesce(le.ids, []) AS ids FROM nb LEFT JOIN le USING (doc_id, line_no)),
y AS (SELECT doc_id, line_no, ([{BOS}] || ids[1:62] || [{EOS}]) AS s FROM x)"""


@register("line_examples",
          f"WITH {_LINES_SQL} SELECT doc_id, line_no, s || list_transform(range(64 - len(s)), lambda k: {PAD}) AS input_ids, "
          "list_transform(range(len(s)), lambda k: 1) || list_transform(range(64 - len(s)), lambda k: 0) AS attention_mask, "
          f"list_transform(s || list_transform(range(64 - len(s)), lambda k: {PAD}), "
          f"lambda x: CAST(x IN ({BOS}, {EOS}, {PAD}) AS INTEGER)) AS special_tokens_mask FROM y")
def line_examples_q(spark, d):
    """TRN-4: non-blank lines -> [s] ids [/s], truncated/padded to 64, with masks."""
    doc = table(spark, d, "documents")
    lines = doc.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")) \
               .withColumn("line_no", F.col("line_no").cast("bigint")).where(tx.py_strip("line") != "")
    enc = V.encode_texts(lines, "line", ["doc_id", "line_no"], _vocab(spark, d), UNK, vocab_rows=VOCAB_WORDS)
    return TS.line_examples(enc, 64, BOS, EOS, PAD).select(
        "doc_id", "line_no", "input_ids", "attention_mask", "special_tokens_mask")


def _turn_pairs_sql() -> str:
    return """
a AS (SELECT conv_id, turn, text AS anchor FROM conversations WHERE role = 'user'),
b AS (SELECT conv_id, turn - 1 AS turn, text AS positive FROM conversations WHERE role = 'assistant'),
pr AS (SELECT * FROM a JOIN b USING (conv_id, turn))"""


@register("contrastive_pairs",
          "WITH " + _turn_pairs_sql() + " SELECT conv_id, turn, anchor, positive, 0 AS label FROM pr")
def contrastive_pairs(spark, d):
    """TRN-9 / PRJ-3 / PRJ-5: (anchor, positive) role columns from user/assistant turns + subset label."""
    pairs = TS.next_turn_pairs(table(spark, d, "conversations"))
    return pairs.select("conv_id", "turn", "anchor", "positive", F.lit(0).alias("label"))


_ROLE_SQL = ("WITH " + _turn_pairs_sql() + ",\nn AS (SELECT pr.*, lead(anchor) OVER (ORDER BY conv_id, turn) AS other FROM pr),\n"
          "k AS (SELECT *, md5('7:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)) AS k FROM n "
          "WHERE other IS NOT NULL)\n"
          "SELECT conv_id, turn, anchor, positive, other AS negative, CAST(conv_id % 3 AS BIGINT) AS label "
          "FROM k ORDER BY k, conv_id, turn")


def _role_pairs(spark, d, cap: int | None):
    pairs = with_position(TS.next_turn_pairs(table(spark, d, "conversations")), ["conv_id", "turn"], pos_col="p")
    other = pairs.select((F.col("p") - 1).alias("p"), F.col("anchor").alias("other"))
    rows = pairs.join(other, "p").withColumn("kind", F.col("conv_id") % 3)
    return TS.role_pairs(rows, {"anchor": "anchor", "positive": "positive", "negative": "other", "label": "kind"},
                         cap, ["conv_id", "turn"], 7)


@register("role_pairs_all", _ROLE_SQL)
def role_pairs_all(spark, d):
    """TRN-9 / PRJ-3: anchor, positive, negative and label columns of every pair."""
    return _role_pairs(spark, d, None)


@register("role_pairs", _ROLE_SQL + " LIMIT 60")
def role_pairs_q(spark, d):
    """TRN-9 / PRJ-3: anchor, positive, negative and label columns mapped by name, seeded cap of 60."""
    return _role_pairs(spark, d, 60)


def _enc_sql(col: str, name: str) -> str:
    return (f"{name}t AS (SELECT conv_id, turn, unnest({W(col)}) AS token, unnest(range(len({W(col)}))) AS p FROM pr),\n"
            f"{name} AS (SELECT conv_id, turn, list(coalesce(voc.id, {UNK}) ORDER BY p) AS ids FROM {name}t "
            f"LEFT JOIN voc USING (token) GROUP BY 1, 2)")


@register("pair_encode",
          f"WITH {_VOC_SQL},{_turn_pairs_sql()},\n{_enc_sql('anchor', 'ae')},\n{_enc_sql('positive', 'pe')},\n"
          "x AS (SELECT pr.conv_id, pr.turn, coalesce(ae.ids, []) AS a, coalesce(pe.ids, []) AS b FROM pr "
          "LEFT JOIN ae USING (conv_id, turn) LEFT JOIN pe USING (conv_id, turn)),\n"
          "k AS (SELECT *, CASE WHEN len(a) + len(b) <= 125 THEN len(a) WHEN len(a) <= len(b) THEN least(len(a), 62) "
          "ELSE 125 - least(len(b), 62) END AS ka, CASE WHEN len(a) + len(b) <= 125 THEN len(b) "
          "WHEN len(a) <= len(b) THEN 125 - least(len(a), 62) ELSE least(len(b), 62) END AS kb FROM x),\n"
          f"y AS (SELECT conv_id, turn, ([{BOS}] || a[1:ka] || [{EOS}] || b[1:kb] || [{EOS}]) AS s, "
          "(row_number() OVER (ORDER BY conv_id, turn) - 1) // 32 AS batch FROM k),\n"
          "z AS (SELECT *, least(CAST(ceil(max(len(s)) OVER (PARTITION BY batch) / 8) * 8 AS BIGINT), 128) AS L FROM y)\n"
          f"SELECT conv_id, turn, batch, s || list_transform(range(L - len(s)), lambda k: {PAD}) AS input_ids, "
          "list_transform(range(len(s)), lambda k: 1) || list_transform(range(L - len(s)), lambda k: 0) "
          "AS attention_mask FROM z")
def pair_encode_q(spark, d):
    """TRN-5: (user, assistant) pairs as [CLS] a [SEP] b [SEP], padded per batch of 32 to a multiple of 8."""
    pairs = TS.next_turn_pairs(table(spark, d, "conversations"))
    voc = _vocab(spark, d)

    def enc(col):
        return V.encode_texts(pairs, col, ["conv_id", "turn"], voc, UNK, vocab_rows=VOCAB_WORDS) \
                .withColumnRenamed("ids", col + "_ids")
    empty = F.array().cast("array<bigint>")
    x = pairs.select("conv_id", "turn").join(enc("anchor"), ["conv_id", "turn"], "left") \
             .join(enc("positive"), ["conv_id", "turn"], "left") \
             .select("conv_id", "turn", F.coalesce("anchor_ids", empty).alias("a"),
                     F.coalesce("positive_ids", empty).alias("b"))
    out = TS.pair_encode(x, "a", "b", 128, BOS, EOS, PAD, ["conv_id", "turn"], 32, 8)
    return out.select("conv_id", "turn", "batch", "input_ids", "attention_mask")


_EVAL_SQL = f"""
q AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
f AS (SELECT query_id, min(doc_id) AS d1 FROM q GROUP BY 1),
s AS (SELECT q.query_id, min(q.doc_id) AS d2 FROM q JOIN f USING (query_id) WHERE q.doc_id > f.d1 GROUP BY 1),
pp AS (SELECT 'positive' AS kind, f.query_id AS pair_id, x.text AS text1, y.text AS text2
       FROM f JOIN s USING (query_id) JOIN documents x ON x.doc_id = f.d1 JOIN documents y ON y.doc_id = s.d2
       ORDER BY f.query_id LIMIT 100),
n AS (SELECT count(*) AS n FROM pp),
sh AS (SELECT doc_id, text, row_number() OVER (ORDER BY {S.shuffle_key(42, 'doc_id')}, doc_id) - 1 AS pos FROM documents),
rp AS (SELECT 'random' AS kind, a.pos AS pair_id, a.text AS text1, b.text AS text2 FROM sh a JOIN sh b
       ON b.pos = a.pos + (SELECT n FROM n) WHERE a.pos < (SELECT n FROM n))"""


@register("eval_pairs", f"WITH {_EVAL_SQL} SELECT * FROM pp UNION ALL SELECT * FROM rp")
def eval_pairs(spark, d):
    """TRN-10 / PRJ-11 / FLT-12 / JN-5: first two positive passages per query (queries with >= 2, at most 100),
    and as many random pairs (shuffled corpus row i with row n + i)."""
    docs = table(spark, d, "documents")
    idx = R.build_index(docs, "text", "doc_id")
    q = R.verbatim_qrels(table(spark, d, "benchmark"), docs, idx, q_id="item_id")
    two = q.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).where("r <= 2")
    passages = two.join(docs.select("doc_id", "text"), "doc_id").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("r", "text"))).alias("p"))
    queries = passages.select("query_id", F.transform("p", lambda x: F.struct(x["text"].alias("text"))).alias("positive_passages"))
    return TS.evaluation_pairs(queries, docs, 100)


@register("batch_by_label",
          f"SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY {S.shuffle_key(42, 'vec_id')}, vec_id)"
          " - 1) // 16 AS batch FROM embeddings")
def batch_by_label(spark, d):
    """SPL-6: batches of 16 that hold a single label each, seeded order inside a label."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return TS.batches_by_label(e, "label", ["vec_id"], 16, 42).select("vec_id", "label", "batch")


#: Merges that the registered queries learn.  README.md has the figures behind the number; the operator has no limit.
BPE_MERGES = 2_000


@register("bpe_merges")
def bpe_merges_q(spark, d):
    """VOC-3 bpe: the merges learnt from every unit of every document.

    Iterative, so no SQL oracle; tests compare with a plain trainer.
    """
    return BT.bpe_merges(table(spark, d, "documents"), "text", BPE_MERGES)


@register("unigram_vocab")
def unigram_vocab_q(spark, d):
    """VOC-3 unigram: 30000 pieces (the reference's size, pruning and coverage) from every unit of every document.

    Iterative, so no SQL oracle; tests hold its sums against all segmentations.
    """
    return UT.unigram_vocab(table(spark, d, "documents"), "text", 30_000)


_LINES_SQL = "SELECT doc_id, translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ') AS line FROM documents"


@register("encode_unigram", _LINES_SQL)
def encode_unigram_q(spark, d):
    """VOC-6: every document as ids of the unigram vocabulary learnt from all, and back: pieces end to end give the line."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    vocab = UT.unigram_vocab(docs, "text", 30_000)
    return EN.decode(EN.encode_unigram(docs, "text", ["doc_id"], vocab), vocab).select("doc_id", "line")


@register("encode_bpe", _LINES_SQL)
def encode_bpe_q(spark, d):
    """VOC-6: every document as ids of a BPE vocabulary learnt from all, and back."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    vocab, merges = BT.bpe_vocab(docs, "text", ENCODED_BPE)
    return EN.decode(EN.encode_bpe(docs, "text", ["doc_id"], vocab, merges), vocab).select("doc_id", "line")


#: Pieces of the BPE vocabulary of ``encode_bpe``, which learns it anew.
ENCODED_BPE = 1_000
