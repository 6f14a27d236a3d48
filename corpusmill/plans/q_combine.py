"""Registered queries: subset combination and the flagship cleanse -> split -> counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import combine as C
from ..operators.splits import split_dataset
from ..sources.tables import table
from . import sqltext as S
from .cleanse import cleanse
from .q_text import _CLEANSE_FULL_SQL

QUERIES: dict = {}
ORACLE: dict = {}

SOURCES = ["src1", "src3", "src5", "src7", "src9"]


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("subset_concat",
          "SELECT doc_id, lang AS subset, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label, "
          "CASE WHEN lang = (SELECT max(lang) FROM documents) THEN source END AS source "
          "FROM documents WHERE lang IS NOT NULL")
def subset_concat(spark, d):
    """SET-1 / PRJ-5 / PRJ-6: per-language subsets (one with an extra column) concatenated and labelled."""
    doc = table(spark, d, "documents")
    names = C.subset_names(doc, "lang")
    frames = {lang: doc.where(F.col("lang") == lang).select("doc_id", *["source"] * (lang == names[-1])) for lang in names}
    out = C.concat_subsets(frames)
    return out.select("doc_id", "subset", C.subset_label("subset", names).alias("label"), "source")


@register("subset_interleave",
          "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rn FROM documents),\n"
          "m AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM documents GROUP BY lang))\n"
          "SELECT r.doc_id, r.lang AS subset, rn * k + i - 1 AS pos FROM r JOIN (SELECT lang, dense_rank() OVER (ORDER BY lang) "
          "AS i, count(*) OVER () AS k FROM (SELECT DISTINCT lang FROM documents)) USING (lang) WHERE rn < (SELECT m FROM m)")
def subset_interleave(spark, d):
    """SET-2: round-robin interleave of the language subsets, first exhausted stops."""
    doc = table(spark, d, "documents").select("doc_id", F.col("lang").alias("subset"))
    return C.interleave(doc, "subset", None, ["doc_id"]).select("doc_id", "subset", "pos")


@register("subset_assembly",
          f"WITH s AS (SELECT doc_id, source AS subset, row_number() OVER (PARTITION BY source ORDER BY "
          f"{S.shuffle_key(42, 'doc_id')}, doc_id) - 1 AS rn FROM documents "
          f"WHERE source IN ('src1', 'src3', 'src5', 'src7', 'src9')),\n"
          "c AS (SELECT * FROM s WHERE rn < 30),\n"
          "n AS (SELECT subset, count(*) AS n FROM c GROUP BY 1)\n"
          "SELECT doc_id, subset, CAST(list_position(['src1', 'src3', 'src5', 'src7', 'src9'], subset) - 1 AS INTEGER) "
          "AS label, CASE WHEN rn < round_even(n * 10 / 100.0, 0) THEN 'validation' ELSE 'train' END AS split "
          "FROM c JOIN n USING (subset)")
def subset_assembly(spark, d):
    """SET-3 / SRC-8 / TOP-4 / SRC-9: five source subsets, 30 seeded rows each, 10 % validation."""
    doc = table(spark, d, "documents").select("doc_id", F.col("source").alias("subset"))
    out = C.assemble_subsets(doc, "subset", SOURCES, ["doc_id"], max_per_subset=30, seed=42, validation_percent=10)
    return out.select("doc_id", "subset", "label", "split")


def _flagship_sql() -> str:
    body = _CLEANSE_FULL_SQL.strip()
    assert body.startswith("WITH ")
    ctes, final = body[len("WITH "):].rsplit("\nSELECT * FROM d3 WHERE text IS NOT NULL", 1)
    key = S.shuffle_key(42, "doc_id")
    return f"""WITH {ctes},
cl AS (SELECT doc_id, lang FROM d3 WHERE text IS NOT NULL),
nt AS (SELECT count(*) AS t FROM cl),
sz AS (SELECT t - CAST(floor(t * 0.2) AS BIGINT) - CAST(floor(t * 0.1) AS BIGINT) AS n_train,
              CAST(floor(t * 0.1) AS BIGINT) AS n_val, t FROM nt),
g AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {key}, doc_id) - 1 AS rn,
             count(*) OVER (PARTITION BY lang) AS size FROM cl),
sp AS (SELECT lang, CASE WHEN rn < floor(size * (sz.n_train / sz.t)) THEN 'train'
                   WHEN rn < floor(size * (sz.n_train / sz.t)) + floor(size * (sz.n_val / sz.t)) THEN 'validation'
                   ELSE 'test' END AS split FROM g, sz)
SELECT split, lang, count(*) AS n FROM sp GROUP BY 1, 2"""


def flagship_df(spark, d):
    cleaned = cleanse(table(spark, d, "documents"), "doc_id", text_fields=["text"],
                      do_deduplicate=True, do_rm_duplicated_by_minhash=True)
    split = split_dataset(cleaned.select("doc_id", "lang"), 0.2, 0.1, split_mode="random", random_seed=42,
                          stratify_key="lang", id_cols=["doc_id"])
    return split.groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"))


register("flagship", _flagship_sql())(flagship_df)
