"""Registered queries: text functions, rules, cleansing, dedup, near-dup, splits, caps.

Each query reads the driver tables in full and has a DuckDB twin in ``ORACLE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.dedup import dedup_column, dedup_records
from ..operators.minhash import (dedup_counts, earliest_candidates, exact_near_duplicate_flags, lsh_buckets, minhash_signatures,
                                 near_duplicate_flags, optimal_bands)
from ..operators.sampling import cap_prefix, lazy_cap, percent_slice, shuffle_take
from ..operators.splits import split_dataset
from ..operators.trainset import build_texts, text_column
from ..sources.tables import table
from . import sqltext as S
from ..session import materialize, release
from .cleanse import RowAccount, cleanse, cleanse_columns, keep_any_field, normalize_fields

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --- normalisation ----------------------------------------------------------

@register("normalize_text", f"SELECT doc_id, {S.collapse('text')} AS text FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    # NFKC is the identity on the driver tables, so the oracle checks the collapse
    return normalize_fields(table(spark, d, "documents").select("doc_id", "text"), ["text"])


@register("strip_text", f"SELECT conv_id, turn, {S.strip('text')} AS text FROM conversations")
def strip_text(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", tx.py_strip("text").alias("text"))


@register("build_text",
          "SELECT conv_id, turn, " + S.strip("concat_ws(' ', text, CAST(turn AS VARCHAR), role)") + " AS built "
          "FROM conversations WHERE " + S.strip("concat_ws(' ', text, CAST(turn AS VARCHAR), role)") + " <> ''")
def build_text(spark, d):
    """PRJ-8 / FLT-13: fields joined by a space in the order named (nulls skipped, numbers as text), stripped."""
    return build_texts(table(spark, d, "conversations"), ["text", "turn", "role"], "built").select("conv_id", "turn", "built")


@register("text_column", "SELECT item_id, text AS line FROM benchmark UNION ALL SELECT conv_id, text FROM conversations "
          "UNION ALL SELECT r_regionkey, CAST(r_regionkey AS VARCHAR) FROM region")
def text_column_q(spark, d):
    """PRJ-9: the column called text where there is one, else the first column."""
    out = []
    for name, key in (("benchmark", "item_id"), ("conversations", "conv_id"), ("region", "r_regionkey")):
        t = table(spark, d, name)
        out.append(t.select(F.col(key).cast("bigint").alias("item_id"), F.col(text_column(t)).cast("string").alias("line")))
    return out[0].union(out[1]).union(out[2])


# --- predicates (flags for every row, so true and false cases are compared) --

@register("filter_email",
          f"SELECT 'doc' AS src, doc_id AS id, {S.has_email('text')} AS hit FROM documents "
          f"UNION ALL SELECT 'page', page_id, {S.has_email('html')} FROM pages")
def filter_email(spark, d):
    docs = table(spark, d, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"),
                                               tx.is_include_email("text").alias("hit"))
    pages = table(spark, d, "pages").select(F.lit("page"), "page_id", tx.is_include_email("html"))
    return docs.unionAll(pages)


@register("filter_url",
          f"SELECT 'doc' AS src, doc_id AS id, {S.has_url('text')} AS hit FROM documents "
          f"UNION ALL SELECT 'url', page_id, {S.has_url('url')} FROM pages "
          f"UNION ALL SELECT 'html', page_id, {S.has_url('html')} FROM pages")
def filter_url(spark, d):
    docs = table(spark, d, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"),
                                               tx.is_include_url("text").alias("hit"))
    p = table(spark, d, "pages")
    return docs.unionAll(p.select(F.lit("url"), "page_id", tx.is_include_url("url"))) \
               .unionAll(p.select(F.lit("html"), "page_id", tx.is_include_url("html")))


def _schedule_text_spark(e: DataFrame) -> F.Column:
    return F.concat_ws(" ", F.date_format("ts", "HH:mm"),
                       F.when(F.col("value") > 10, F.date_format("ts", "HH:mm:ss")),
                       F.when(F.col("value") > 20, F.concat(F.lit("until "), F.date_format("ts", "mm:ss"))))


_SCHEDULE_SQL = ("concat_ws(' ', strftime(ts, '%H:%M'), CASE WHEN value > 10 THEN strftime(ts, '%H:%M:%S') END, "
                 "CASE WHEN value > 20 THEN 'until ' || strftime(ts, '%M:%S') END)")


@register("filter_time",
          f"SELECT event_id, {S.time_count(_SCHEDULE_SQL)} AS n_times, "
          f"{S.time_count(_SCHEDULE_SQL)} >= 3 AS hit FROM events")
def filter_time(spark, d):
    """FLT-6 on an event schedule line built from each event's timestamp."""
    e = table(spark, d, "events")
    t = _schedule_text_spark(e)
    return e.select("event_id", tx.time_count(t).cast("bigint").alias("n_times"),
                    tx.include_time_schedule(t, 3).alias("hit"))


@register("filter_numeric",
          f"SELECT o_orderkey, {S.only_numeric('CAST(o_orderkey AS VARCHAR)')} AS key_numeric, "
          f"{S.only_numeric('o_orderpriority')} AS prio_numeric, "
          f"{S.only_numeric(chr(39) + '1.' + chr(39) + ' || CAST(o_custkey AS VARCHAR) || ' + chr(39) + '.5' + chr(39))}"
          f" AS dotted_numeric FROM orders")
def filter_numeric(spark, d):
    o = table(spark, d, "orders")
    dotted = F.concat(F.lit("1."), F.col("o_custkey").cast("string"), F.lit(".5"))
    return o.select("o_orderkey", tx.is_only_numeric(F.col("o_orderkey").cast("string")).alias("key_numeric"),
                    tx.is_only_numeric("o_orderpriority").alias("prio_numeric"),
                    tx.is_only_numeric(dotted).alias("dotted_numeric"))


@register("filter_length",
          "SELECT doc_id, (length(text) < 100 OR length(text) > 5000) AS out_of_range FROM documents")
def filter_length(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", tx.is_out_of_length_range("text", 100, 5000).alias("out_of_range"))


@register("filter_blank",
          "SELECT doc_id, line_no, " + S.strip("line") + " = '' AS blank FROM ("
          "SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM "
          "(SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))")
def filter_blank(spark, d):
    """FLT-1 / FLT-11 over every line of every document."""
    doc = table(spark, d, "documents")
    lines = doc.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), tx.is_blank("line").alias("blank"))


@register("regex_search",
          "SELECT doc_id, regexp_matches(text, '(?:[0-9]+|(?:ß|ñ))') AS hit, "
          "regexp_matches(text, '[A-Z][a-z]+ [a-z]+') AS hit2 FROM documents")
def regex_search(spark, d):
    """FLT-17: search with patterns assembled by the builders."""
    p = tx.concat_patterns([r"[0-9]+", tx.concat_patterns(["ß", "ñ"])])
    return table(spark, d, "documents").select(
        "doc_id", tx.is_match_pattern("text", p).alias("hit"),
        tx.is_match_pattern("text", "[A-Z][a-z]+ [a-z]+").alias("hit2"))


# --- rules and cleansing ----------------------------------------------------

@register("cleanse_rules", f"SELECT doc_id, {S.cleanse('text')} AS text FROM documents")
def cleanse_rules(spark, d):
    """FLT-7/8: every document text becomes its stripped form or null."""
    return cleanse_columns(table(spark, d, "documents").select("doc_id", "text"), ["text"])


@register("cleanse_two_fields",
          f"SELECT page_id, url, html FROM (SELECT page_id, {S.cleanse('url')} AS url, {S.cleanse('html')} AS html "
          f"FROM pages) WHERE coalesce(url, html) IS NOT NULL")
def cleanse_two_fields(spark, d):
    """FLT-8/9 on two fields: kept when either field survives."""
    p = table(spark, d, "pages")
    return keep_any_field(cleanse_columns(p, ["url", "html"]), ["url", "html"])


def _sig_sql(src: str, order: str, text: str, num_perm: int = 128) -> str:
    """CTEs ``s(set_key, set_first)`` and ``sig(set_key, sig)``."""
    return f"""
s AS (SELECT {S.char_set(text)} AS set_key, min({order}) AS set_first FROM {src} WHERE {text} IS NOT NULL GROUP BY 1),
sc AS (SELECT set_key, unnest(list_filter(string_split(set_key, ''), lambda c: c <> '')) AS ch FROM s),
alpha AS (SELECT DISTINCT ch FROM sc),
ah AS (SELECT ch, i, ('0x' || substr(md5(CAST(i AS VARCHAR) || ':' || ch), 1, 15))::BIGINT AS h
       FROM alpha, range(0, {num_perm}) r(i)),
sg AS (SELECT sc.set_key, ah.i, min(ah.h) AS h FROM sc JOIN ah USING (ch) GROUP BY 1, 2),
sig AS (SELECT set_key, list(h ORDER BY i) AS sig FROM sg GROUP BY 1)"""


def _near_dup_sql(src: str, order: str, text: str, threshold: float = 0.95, num_perm: int = 128,
                  verify: bool = False) -> str:
    """DuckDB twin of near_duplicate_flags: ``best(set_key, earliest)`` CTEs."""
    b, r = optimal_bands(threshold, num_perm)
    sql = _sig_sql(src, order, text, num_perm) + f""",
sb AS (SELECT s.set_key, s.set_first, k AS band_no,
              md5(array_to_string(list_transform(sig.sig[k * {r} + 1 : k * {r} + {r}], lambda x: CAST(x AS VARCHAR)), '|')) AS band_hash
       FROM s JOIN sig USING (set_key), range(0, {b}) t(k)),"""
    if not verify:
        sql += """
bucket AS (SELECT band_no, band_hash, min(set_first) AS bucket_first FROM sb GROUP BY 1, 2),
best AS (SELECT sb.set_key, min(bucket_first) AS earliest FROM sb JOIN bucket USING (band_no, band_hash) GROUP BY 1)"""
    else:
        sql += f"""
cand AS (SELECT a.set_key, b.set_first AS other_first,
                len(list_intersect(string_split(a.set_key, ''), string_split(b.set_key, '')))::DOUBLE
                / len(list_distinct(list_concat(string_split(a.set_key, ''), string_split(b.set_key, '')))) AS jac
         FROM sb a JOIN sb b USING (band_no, band_hash) WHERE b.set_first < a.set_first),
ver AS (SELECT set_key, min(other_first) AS v_first FROM cand WHERE jac >= {threshold} GROUP BY 1),
best AS (SELECT s.set_key, least(s.set_first, coalesce(ver.v_first, s.set_first)) AS earliest
         FROM s LEFT JOIN ver USING (set_key))"""
    return sql


_CLEANSE_FULL_SQL = f"""
WITH d0 AS (SELECT doc_id, text, lang, source, n_chars FROM documents),
d1 AS (SELECT arg_min(doc_id, doc_id) AS doc_id, text, arg_min(lang, doc_id) AS lang,
              arg_min(source, doc_id) AS source, arg_min(n_chars, doc_id) AS n_chars FROM d0 GROUP BY text),
{_near_dup_sql('d1', 'doc_id', 'text')},
d2 AS (SELECT d1.* FROM d1 LEFT JOIN best ON {S.char_set('d1.text')} = best.set_key
       WHERE d1.text IS NOT NULL AND NOT coalesce(best.earliest < d1.doc_id, false)),
d3 AS (SELECT doc_id, {S.cleanse('text')} AS text, lang, source, n_chars FROM d2)
SELECT * FROM d3 WHERE text IS NOT NULL"""


@register("cleanse_full", _CLEANSE_FULL_SQL)
def cleanse_full(spark, d):
    """DD-9: record dedup -> exact + MinHash near-dup on text -> rules."""
    return cleanse(table(spark, d, "documents"), "doc_id", text_fields=["text"],
                   do_deduplicate=True, do_rm_duplicated_by_minhash=True)


@register("cleanse_account", _CLEANSE_FULL_SQL.replace("SELECT * FROM d3 WHERE text IS NOT NULL", """
SELECT 0 AS stage_no, 'read' AS stage, count(*) AS n_rows FROM d0 UNION ALL
SELECT 1, 'records', count(*) FROM d1 UNION ALL
SELECT 2, 'duplicates of text', count(*) FROM d2 UNION ALL
SELECT 3, 'rules', count(text) FROM d3 UNION ALL
SELECT 4, 'saved', count(text) FROM d3"""))
def cleanse_account(spark, d):
    """AGG-22: the rows that leave each stage of the job, observed while it runs and writes its result."""
    account = RowAccount()
    saved = cleanse(table(spark, d, "documents"), "doc_id", text_fields=["text"], do_deduplicate=True,
                    do_rm_duplicated_by_minhash=True, account=account)
    release(materialize(saved, "cleansed"))
    return spark.createDataFrame(account.rows(), "stage_no int, stage string, n_rows long")


@register("cleanse_all_fields",
          "SELECT arg_min(event_id, event_id) AS event_id, ts, user_id, event_type, value, props "
          "FROM events GROUP BY ts, user_id, event_type, value, props")
def cleanse_all_fields(spark, d):
    """DD-9 without text fields: record dedup on all columns but the order id."""
    return cleanse(table(spark, d, "events"), "event_id", text_fields=None)


# --- dedup ------------------------------------------------------------------

@register("dedup_records",
          "SELECT arg_min(doc_id, doc_id) AS doc_id, text, lang, arg_min(source, doc_id) AS source "
          "FROM documents GROUP BY text, lang")
def dedup_records_q(spark, d):
    """DD-1 on key (text, lang), first doc wins."""
    doc = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return dedup_records(doc, ["text", "lang"], ["doc_id"])


@register("dedup_column",
          "SELECT doc_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY text) THEN text END AS text "
          "FROM documents")
def dedup_column_q(spark, d):
    """DD-2: later repeats of a text become null."""
    return dedup_column(table(spark, d, "documents").select("doc_id", "text"), "text", ["doc_id"])


@register("dedup_counts",
          "WITH " + _near_dup_sql("documents", "doc_id", "text") +
          ",\nex AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE text IS NOT NULL GROUP BY text)\n"
          "SELECT *, removed_exact + removed_minhash AS removed FROM "
          "(SELECT count(*) FILTER (WHERE text IS NULL) AS before_nulls, "
          "count(*) - count(DISTINCT text) - count(*) FILTER (WHERE text IS NULL) AS removed_exact, "
          f"(SELECT count(*) FROM ex JOIN best ON {S.char_set('ex.text')} = best.set_key WHERE best.earliest < ex.doc_id) "
          "AS removed_minhash FROM documents)")
def dedup_counts_q(spark, d):
    """DD-8 / AGG-8: texts removed by the exact pass, by MinHash after it, and in total."""
    return dedup_counts(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")


# --- MinHash / LSH ----------------------------------------------------------

@register("minhash_signature", "WITH " + _sig_sql("documents", "doc_id", "text") +
          f"\nSELECT doc_id, sig.sig AS sig FROM documents JOIN sig ON {S.char_set('text')} = sig.set_key")
def minhash_signature(spark, d):
    """DD-3: 128 permutation minima over the character set of each document."""
    return minhash_signatures(table(spark, d, "documents"), "text", "doc_id")


@register("lsh_candidates", "WITH " + _near_dup_sql("documents", "doc_id", "text") +
          f"\nSELECT doc_id, earliest AS candidate_first FROM documents JOIN best ON {S.char_set('text')} = best.set_key"
          " WHERE earliest < doc_id")
def lsh_candidates(spark, d):
    """DD-4/5: for each document, the earliest document sharing an LSH bucket (when earlier)."""
    doc = table(spark, d, "documents").select("doc_id", "text")
    out = earliest_candidates(doc, "text", "doc_id", out_col="candidate_first")
    return out.where(F.col("candidate_first") < F.col("doc_id")).select("doc_id", "candidate_first")


@register("lsh_buckets", "WITH " + _near_dup_sql("documents", "doc_id", "text") +
          f"\nSELECT doc_id, band_no, band_hash FROM documents JOIN sb ON {S.char_set('text')} = sb.set_key")
def lsh_buckets_q(spark, d):
    """DD-4: the LSH index, one row per document and band."""
    out = lsh_buckets(table(spark, d, "documents"), "text", "doc_id")
    return out.select("doc_id", F.col("band_no").cast("bigint").alias("band_no"), "band_hash")


@register("near_dup_drop", "WITH " + _near_dup_sql("documents", "doc_id", "text") +
          f"\nSELECT doc_id, coalesce(best.earliest < doc_id, false) AS is_near_dup FROM documents "
          f"LEFT JOIN best ON {S.char_set('text')} = best.set_key")
def near_dup_drop(spark, d):
    """DD-6/7: flag every document whose text has an earlier near duplicate."""
    return near_duplicate_flags(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id") \
        .select("doc_id", "is_near_dup")


@register("near_dup_verified", "WITH " + _near_dup_sql("documents", "doc_id", "text", verify=True) +
          f"\nSELECT doc_id, coalesce(best.earliest < doc_id, false) AS is_near_dup FROM documents "
          f"LEFT JOIN best ON {S.char_set('text')} = best.set_key")
def near_dup_verified(spark, d):
    """DD-7 with exact Jaccard verification against every earlier set of the buckets."""
    return near_duplicate_flags(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id",
                                verify=True).select("doc_id", "is_near_dup")


def _word_sets_sql(k: int, num_perm: int, threshold: float) -> str:
    b, r = optimal_bands(threshold, num_perm)
    return f"""w AS (SELECT doc_id, {S.words('text')} AS w FROM documents WHERE text IS NOT NULL),
it AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) > {k} THEN list_transform(range(1, len(w) - {k} + 2),
       lambda i: array_to_string(w[i:i + {k - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
       ELSE [] END)) AS items FROM w),
tx AS (SELECT doc_id, items, md5(array_to_string(items, chr(31))) AS set_key FROM it),
s AS (SELECT set_key, min(doc_id) AS set_first, any_value(items) AS items FROM tx GROUP BY 1),
sc AS (SELECT set_key, unnest(items) AS ch FROM s),
ah AS (SELECT ch, i, ('0x' || substr(md5(CAST(i AS VARCHAR) || ':' || ch), 1, 15))::BIGINT AS h
       FROM (SELECT DISTINCT ch FROM sc), range(0, {num_perm}) r(i)),
sig AS (SELECT set_key, list(h ORDER BY i) AS sig FROM (SELECT set_key, i, min(h) AS h FROM sc JOIN ah USING (ch)
        GROUP BY 1, 2) GROUP BY 1),
sb AS (SELECT s.*, k AS band_no, md5(array_to_string(list_transform(sig[k * {r} + 1 : k * {r} + {r}],
       lambda x: CAST(x AS VARCHAR)), '|')) AS band_hash FROM s JOIN sig USING (set_key), range(0, {b}) t(k)),
pr AS (SELECT DISTINCT a.set_key, a.set_first, b.set_first AS other_first, a.items AS x, b.items AS y
       FROM sb a JOIN sb b USING (band_no, band_hash) WHERE b.set_first < a.set_first),
lose AS (SELECT DISTINCT set_key FROM pr WHERE len(list_intersect(x, y))::DOUBLE
         / (len(x) + len(y) - len(list_intersect(x, y))) >= {threshold})"""


@register("near_dup_words", f"WITH {_word_sets_sql(3, 32, 0.7)}\n"
          "SELECT tx.doc_id, tx.doc_id > s.set_first OR tx.set_key IN (SELECT set_key FROM lose) AS is_near_dup "
          "FROM tx JOIN s USING (set_key)")
def near_dup_words(spark, d):
    """DD-6/7 over runs of three words, 32 permutations, Jaccard of at least .7 verified."""
    return near_duplicate_flags(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id", threshold=0.7,
                                num_perm=32, verify=True, shingle=("word", 3)).select("doc_id", "is_near_dup")


def _all_pairs_sql(k: int, threshold: float) -> str:
    """Jaccard of all pairs of sets that share a shingle; no bands, no prefixes."""
    return f"""w AS (SELECT doc_id, {S.words('text')} AS w FROM documents WHERE text IS NOT NULL),
tx AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) > {k} THEN list_transform(range(1, len(w) - {k} + 2),
       lambda i: array_to_string(w[i:i + {k - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
       ELSE [] END)) AS items FROM w),
s AS (SELECT min(doc_id) AS set_first, items FROM tx GROUP BY items),
m AS (SELECT set_first, len(items) AS n, unnest(items) AS item FROM s),
pr AS (SELECT a.set_first, b.set_first AS other, any_value(a.n) AS x, any_value(b.n) AS y, count(*) AS c
       FROM m a JOIN m b USING (item) WHERE b.set_first < a.set_first GROUP BY 1, 2),
lose AS (SELECT DISTINCT set_first FROM pr WHERE c::DOUBLE / (x + y - c) >= {threshold})"""


@register("near_dup_words_exact", f"WITH {_all_pairs_sql(5, 0.8)}\n"
          "SELECT d.doc_id, d.text IS NOT NULL AND (s.set_first IS NULL OR s.set_first IN (SELECT set_first FROM lose)) "
          "AS is_near_dup FROM documents d LEFT JOIN s ON d.doc_id = s.set_first")
def near_dup_words_exact(spark, d):
    """DD-6/7 over runs of five words, Jaccard of at least .8: every pair, by a prefix filter without bands."""
    return exact_near_duplicate_flags(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id") \
        .select("doc_id", "is_near_dup")


# --- splits -----------------------------------------------------------------

def _seq_sql(src: str, idc: str, order: str, n_train: str, n_val: str) -> str:
    return (f"SELECT {idc}, CASE WHEN rn < {n_train} THEN 'train' WHEN rn < {n_train} + {n_val} THEN 'validation' "
            f"ELSE 'test' END AS split FROM (SELECT {idc}, row_number() OVER (ORDER BY {order}) - 1 AS rn FROM {src})")


@register("split_sequential",
          "WITH n AS (SELECT count(*) AS t FROM documents) " +
          _seq_sql("documents", "doc_id", "doc_id",
                   "((SELECT t FROM n) - CAST(floor((SELECT t FROM n) * 0.2) AS BIGINT) - CAST(floor((SELECT t FROM n) * 0.1) AS BIGINT))",
                   "CAST(floor((SELECT t FROM n) * 0.1) AS BIGINT)"))
def split_sequential(spark, d):
    doc = table(spark, d, "documents").select("doc_id")
    return split_dataset(doc, 0.2, 0.1, split_mode="sequential", id_cols=["doc_id"])


@register("split_random",
          "WITH n AS (SELECT count(*) AS t FROM customer) " +
          _seq_sql("customer", "c_custkey", f"{S.shuffle_key(42, 'c_custkey')}, c_custkey",
                   "((SELECT t FROM n) - 300)", "0"))
def split_random(spark, d):
    """SPL-3 with an absolute test count and no validation."""
    c = table(spark, d, "customer").select("c_custkey")
    return split_dataset(c, 300, None, split_mode="random", random_seed=42, id_cols=["c_custkey"])


def _strat_sql(src: str, idc: str, key: str, order: str, test: float, val: float) -> str:
    return f"""
WITH n AS (SELECT count(*) AS t FROM {src}),
sz AS (SELECT (SELECT t FROM n) - CAST(floor((SELECT t FROM n) * {test}) AS BIGINT) - CAST(floor((SELECT t FROM n) * {val}) AS BIGINT) AS n_train,
              CAST(floor((SELECT t FROM n) * {val}) AS BIGINT) AS n_val, (SELECT t FROM n) AS t),
g AS (SELECT {idc}, {key}, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS rn,
             count(*) OVER (PARTITION BY {key}) AS size FROM {src})
SELECT {idc}, CASE WHEN rn < floor(size * (sz.n_train / sz.t)) THEN 'train'
                   WHEN rn < floor(size * (sz.n_train / sz.t)) + floor(size * (sz.n_val / sz.t)) THEN 'validation'
                   ELSE 'test' END AS split
FROM g, sz"""


@register("split_stratified",
          _strat_sql("documents", "doc_id", "lang", f"{S.shuffle_key(42, 'doc_id')}, doc_id", 0.2, 0.1))
def split_stratified(spark, d):
    """SPL-4: random split within each language."""
    doc = table(spark, d, "documents").select("doc_id", "lang")
    return split_dataset(doc, 0.2, 0.1, split_mode="random", random_seed=42, stratify_key="lang",
                         id_cols=["doc_id"]).select("doc_id", "split")


@register("split_stratified_seq",
          _strat_sql("orders", "o_orderkey", "o_orderpriority", "o_orderkey", 0.25, 0.15))
def split_stratified_seq(spark, d):
    """SPL-4 sequential mode on orders by priority."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return split_dataset(o, 0.25, 0.15, split_mode="sequential", stratify_key="o_orderpriority",
                         id_cols=["o_orderkey"]).select("o_orderkey", "split")


@register("percent_slice",
          "WITH n AS (SELECT count(*) AS t FROM labels) SELECT doc_id, CASE WHEN rn < "
          "CAST(round_even((SELECT t FROM n) * 5 / 100.0, 0) AS BIGINT) THEN 'validation' ELSE 'train' END AS split "
          "FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM labels)")
def percent_slice_q(spark, d):
    """SRC-9: first 5 % -> validation, rest -> train."""
    return percent_slice(table(spark, d, "labels").select("doc_id"), 5, ["doc_id"])


# --- caps and shuffles ------------------------------------------------------

@register("cap_prefix", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 500")
def cap_prefix_q(spark, d):
    """TOP-1/2: the first 500 records (the cap is the feature)."""
    return cap_prefix(table(spark, d, "customer").select("c_custkey", "c_name"), 500, ["c_custkey"])


@register("shuffle_take",
          f"SELECT c_custkey, c_mktsegment FROM customer ORDER BY {S.shuffle_key(7, 'c_custkey')}, c_custkey LIMIT 100")
def shuffle_take_q(spark, d):
    """TOP-4: seeded shuffle then take 100."""
    return shuffle_take(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), 100, ["c_custkey"], seed=7)


@register("lazy_cap_kept",
          f"SELECT doc_id, text FROM documents WHERE {S.strip('text')} <> '' AND NOT {S.has_url('text')} "
          f"ORDER BY doc_id LIMIT 300")
def lazy_cap_kept(spark, d):
    """TOP-7 streaming flavour: the first 300 texts that pass the filter."""
    doc = table(spark, d, "documents").select("doc_id", "text")
    return lazy_cap(doc, 300, ["doc_id"], (tx.py_strip("text") != "") & ~tx.is_include_url("text"), "kept")


@register("lazy_cap_raw",
          f"SELECT doc_id, text FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 300) "
          f"WHERE {S.strip('text')} <> '' AND NOT {S.has_url('text')}")
def lazy_cap_raw(spark, d):
    """TOP-7 in-memory flavour: the first 300 rows, then the filter."""
    doc = table(spark, d, "documents").select("doc_id", "text")
    return lazy_cap(doc, 300, ["doc_id"], (tx.py_strip("text") != "") & ~tx.is_include_url("text"), "raw")
