"""Registered queries: driver tables written by every sink and read back by every source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import subword
from ..operators import vocab as V
from ..operators import unigram_trainer as UT
from ..session import checkpoint_dir
from ..sources import jsonarray as JA
from ..sources import lazy as LZ
from ..sources import readers as RD
from ..sources import writers as WR
from ..sources.tables import table
from . import sqltext as S

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/io-{name}-{uuid.uuid4().hex}"


@register("io_json_array", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, text, lang, source, n_chars FROM documents")
def io_json_array(spark, d):
    """SRC-1 / SNK-1: all documents as one array in one file, written in order and read by many tasks."""
    path = f"{_folder(spark, 'array')}.json"
    docs = table(spark, d, "documents")
    JA.write_array(docs, path, ["doc_id"])
    return RD.read_json_array(spark, path, docs.schema, "pos").select("pos", "doc_id", "text", "lang", "source", "n_chars")


@register("io_jsonl", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def io_jsonl(spark, d):
    """SRC-2 / SRC-4 / SNK-1: JSON Lines, text with newlines, quotes and non-ASCII letters."""
    path = _folder(spark, "jsonl")
    docs = table(spark, d, "documents")
    WR.write_jsonl(docs, path)
    return RD.read_jsonl(spark, path, docs.schema).select("doc_id", "text", "lang", "source", "n_chars")


@register("io_csv", "SELECT doc_id, text, lang, n_chars FROM documents")
def io_csv(spark, d):
    """SRC-3 / SNK-3: CSV with a header; quotes, commas, blanks at the ends and newlines survive."""
    path = _folder(spark, "csv")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    WR.write_csv(docs, path)
    return RD.read_csv(spark, path, docs.schema)


@register("io_text", "SELECT translate(text, chr(10), ' ') || chr(10) AS text, count(*) AS n FROM documents GROUP BY 1")
def io_text(spark, d):
    """SRC-5 / SNK-4: one text a line, read with its line break."""
    path = _folder(spark, "text")
    WR.write_text_corpus(table(spark, d, "documents"), "text", path)
    return RD.read_text(spark, path, keep_linebreaks=True).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@register("io_splits", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM documents")
def io_splits(spark, d):
    """SRC-6 / SNK-6: one folder a split, every split read back and tagged."""
    path = _folder(spark, "splits")
    docs = table(spark, d, "documents").withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train"))
    WR.write_parquet(docs, path, ["split"])
    return RD.read_splits(spark, path).select("doc_id", F.col("split").cast("string").alias("split"))


@register("io_choose_split", "SELECT doc_id FROM documents WHERE doc_id % 10 <> 0")
def io_choose_split(spark, d):
    """SRC-7: the train split if there is one."""
    path = _folder(spark, "choose")
    docs = table(spark, d, "documents").withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train"))
    WR.write_jsonl(docs, path, ["split"])
    return RD.choose_split(RD.read_splits(spark, path, "json")).select("doc_id")


@register("io_subsets", "SELECT doc_id, source AS subset FROM documents WHERE source IN ('src1', 'src4')")
def io_subsets(spark, d):
    """SRC-8: two named subsets of a partitioned folder."""
    path = _folder(spark, "subsets")
    WR.write_parquet(table(spark, d, "documents").withColumn("subset", F.col("source")), path, ["subset"])
    return RD.select_subsets(spark.read.parquet(path), ["src1", "src4"]).select("doc_id", "subset")


@register("io_predictions", "SELECT CAST(vec_id AS VARCHAR) AS index, printf('%3.3f', CAST(embedding[1] AS DOUBLE)) AS prediction "
          "FROM embeddings")
def io_predictions(spark, d):
    """SNK-5: regression predictions as tab-separated lines."""
    path = _folder(spark, "pred")
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("p"))
    WR.write_predictions(rows, "vec_id", "p", path, regression=True)
    return RD.read_csv(spark, path, "index string, prediction string", sep="\t")


@register("io_metrics", "SELECT count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents")
def io_metrics(spark, d):
    """SNK-7: a metrics row as JSON."""
    path = _folder(spark, "metrics")
    m = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))
    WR.write_metrics(m, path)
    return RD.read_jsonl(spark, path, m.schema)


@register("io_token_list", f"WITH t AS (SELECT DISTINCT unnest({S.words('text')}) AS token FROM documents) "
          "SELECT row_number() OVER (ORDER BY token) - 1 AS pos, token FROM t")
def io_token_list(spark, d):
    """SRC-11: all distinct words as one JSON array of strings, in order."""
    path = f"{_folder(spark, 'tokens')}.json"
    tokens = V.word_counts(table(spark, d, "documents"), "text").select("token")
    JA.write_array(tokens, path, ["token"], strings=True)
    return RD.read_token_list(spark, path)


@register("io_word_list", "SELECT DISTINCT source AS word FROM documents")
def io_word_list(spark, d):
    """SRC-12: words one a line, blank lines and blanks around them dropped."""
    path = _folder(spark, "words")
    words = table(spark, d, "documents").select(F.explode(F.array(F.concat(F.lit("  "), "source", F.lit(" ")), F.lit(" ")))
                                                .alias("value")).distinct()
    words.write.text(path)
    return RD.read_word_list(spark, path)


_MARKED = ("CASE WHEN length(text) > 0 THEN '▁' || translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), "
           "'▁▁▁▁▁▁') ELSE '' END")


@register("seed_pieces", f"""
WITH u AS (SELECT token, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all({_MARKED}, '\\p{{Nd}}|▁*[^▁\\p{{Nd}}]+|▁+')) AS token FROM documents) GROUP BY 1),
p AS (SELECT n, token, unnest(range(1, len(token))) AS i FROM u),
q AS (SELECT n, substr(token, i, l) AS piece, substr(token, i + l, 1) AS follows FROM p, range(2, 17) t(l) WHERE i + l - 1 <= len(token)),
f AS (SELECT piece, follows, sum(n) AS n FROM q GROUP BY 1, 2),
g AS (SELECT piece, CAST(sum(n) AS BIGINT) AS n, coalesce(max(n) FILTER (WHERE follows <> ''), 0) AS heaviest FROM f GROUP BY 1)
SELECT piece, n FROM g WHERE n >= 2 AND (len(piece) = 2 OR len(piece) = 16 OR n > heaviest)""")
def seed_pieces_q(spark, d):
    """VOC-3 (unigram): every candidate piece of up to 16 characters that occurs twice or more, with its count."""
    return UT.seed_pieces(subword.unit_counts(table(spark, d, "documents"), "text"))


@register("lazy_read", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500 ORDER BY doc_id LIMIT 40")
def lazy_read(spark, d):
    """SRC-10: the first 40 long English documents of a dataset of 24 files, read in steps until they are found."""
    path = _folder(spark, "files")
    table(spark, d, "documents").repartitionByRange(24, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    keep = (F.col("lang") == "en") & (F.col("n_chars") > 500)
    return LZ.first_rows(spark, path, 40, keep).rows.select("doc_id", "lang", "n_chars")
