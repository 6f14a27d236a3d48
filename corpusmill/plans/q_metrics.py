"""Registered queries: embedding metrics, prediction metrics and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import argmax
from ..operators import metrics as M
from ..operators import vecmetrics as VM
from ..operators.position import with_position
from ..sources.tables import table
from . import q_build as QB

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_NORM_SQL = """
e0 AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
e1 AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda y: y * y))) AS nrm FROM e0),
n AS (SELECT vec_id, label, list_transform(e, lambda x: x / greatest(nrm, 1e-12)) AS v,
             row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM e1)"""

_PAIRS_SQL = _NORM_SQL + """,
pr AS (SELECT a.label, a.vec_id AS id1, a.v AS z1, b.v AS z2 FROM n a JOIN n b ON a.label = b.label AND b.rn = a.rn + 1)"""


def _pairs(spark, d):
    return VM.neighbour_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


@register("alignment",
          f"WITH {_PAIRS_SQL} SELECT round(avg(pow(list_distance(z1, z2), 2)), 6) AS alignment FROM pr")
def alignment_q(spark, d):
    """AGG-3 over consecutive same-label pairs of the whole embeddings table."""
    return VM.alignment(_pairs(spark, d), "z1", "z2").select(F.round("alignment", 6).alias("alignment"))


@register("uniformity",
          f"WITH {_NORM_SQL} SELECT round(ln(avg(exp(-2 * (list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v)"
          " - 2 * list_inner_product(a.v, b.v))))), 6) AS uniformity FROM n a JOIN n b ON a.vec_id <> b.vec_id")
def uniformity_q(spark, d):
    """AGG-4 over all off-diagonal pairs (blocked numpy products)."""
    e = table(spark, d, "embeddings")
    return VM.uniformity(e, "vec_id", "embedding", 2.0).select(F.round("uniformity", 6).alias("uniformity"))


_COS_SQL = _NORM_SQL + """,
sc AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_inner_product(a.v, b.v), 6) AS score,
              CAST(a.label = b.label AS INTEGER) AS hit FROM n a JOIN n b ON a.vec_id <> b.vec_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""


@register("cosine_topk", f"WITH {_COS_SQL} SELECT query_id, rank, doc_id, score FROM rk WHERE rank <= 10")
def cosine_topk_q(spark, d):
    """JN-12: exhaustive cosine top 10 of every embedding against all others."""
    e = table(spark, d, "embeddings")
    return VM.cosine_topk(e, e, 10, "vec_id", "vec_id", "embedding", exclude_self=True)


def _ir_sql() -> str:
    ks = (1, 3, 5, 10)
    agg = []
    for k in ks:
        agg.append(f"max(CASE WHEN rank <= {k} THEN hit ELSE 0 END) AS acc_{k}")
        agg.append(f"sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END) AS hits_{k}")
    agg.append("max(CASE WHEN rank <= 10 AND hit = 1 THEN 1.0 / rank ELSE 0 END) AS rr")
    agg.append("sum(CASE WHEN rank <= 10 THEN hit / log2(rank + 1) ELSE 0 END) AS dcg")
    agg.append("sum(CASE WHEN hit = 1 THEN hits_so_far / rank ELSE 0 END) AS ap_sum")
    out = []
    for k in ks:
        out.append(f"round(avg(CAST(acc_{k} AS DOUBLE)), 6) AS accuracy_at_{k}")
        out.append(f"round(avg(hits_{k} / {k}.0), 6) AS precision_at_{k}")
        out.append(f"round(avg(CASE WHEN n_rel > 0 THEN hits_{k} / n_rel ELSE 0 END), 6) AS recall_at_{k}")
    out.append("round(avg(rr), 6) AS mrr_at_10")
    out.append("round(avg(CASE WHEN n_rel > 0 THEN dcg / list_sum(list_transform(range(1, least(n_rel, 10) + 1), "
               "lambda i: 1 / log2(i + 1))) ELSE 0 END), 6) AS ndcg_at_10")
    out.append("round(avg(CASE WHEN n_rel > 0 THEN ap_sum / least(n_rel, 100) ELSE 0 END), 6) AS map_at_100")
    return (f"WITH {_COS_SQL},\n"
            "cum AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING "
            "AND CURRENT ROW) AS hits_so_far FROM rk WHERE rank <= 100),\n"
            "nrel AS (SELECT a.vec_id AS query_id, count(*) AS n_rel FROM embeddings a JOIN embeddings b "
            "ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1),\n"
            f"pq AS (SELECT query_id, {', '.join(agg)} FROM cum GROUP BY 1),\n"
            "m AS (SELECT pq.*, coalesce(n_rel, 0) AS n_rel FROM pq LEFT JOIN nrel USING (query_id))\n"
            f"SELECT {', '.join(out)} FROM m")


@register("ir_metrics", _ir_sql())
def ir_metrics_q(spark, d):
    """AGG-19: IR metrics of cosine retrieval, relevant = same label (self excluded)."""
    e = table(spark, d, "embeddings")
    ranked = VM.cosine_topk(e, e, 100, "vec_id", "vec_id", "embedding", exclude_self=True)
    return VM.ir_metrics_same_label(ranked, e, "vec_id", "label")


@register("ir_metrics_pairs",
          f"WITH {_NORM_SQL},\npr AS (SELECT a.vec_id AS q, b.vec_id AS d FROM n a JOIN n b ON b.label = a.label AND b.rn = a.rn + 1),\n"
          "s AS (SELECT a.vec_id AS q, b.vec_id AS d, round(list_inner_product(a.v, b.v), 6) AS s FROM n a JOIN n b "
          "ON a.vec_id <> b.vec_id),\n"
          "k AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS r FROM s),\n"
          "x AS (SELECT pr.q, CASE WHEN r <= 100 THEN r END AS r FROM pr JOIN k USING (q, d))\n"
          "SELECT " + ", ".join(
              f"round(avg(CASE WHEN r <= {k} THEN 1.0 ELSE 0 END), 6) AS accuracy_at_{k}, "
              f"round(avg(CASE WHEN r <= {k} THEN 1.0 / {k} ELSE 0 END), 6) AS precision_at_{k}, "
              f"round(avg(CASE WHEN r <= {k} THEN 1.0 ELSE 0 END), 6) AS recall_at_{k}" for k in (1, 3, 5, 10)) +
          ", round(avg(CASE WHEN r <= 10 THEN 1.0 / r ELSE 0 END), 6) AS mrr_at_10, "
          "round(avg(CASE WHEN r <= 10 THEN 1.0 / log2(r + 1) ELSE 0 END), 6) AS ndcg_at_10, "
          "round(avg(CASE WHEN r <= 100 THEN 1.0 / r ELSE 0 END), 6) AS map_at_100 FROM x")
def ir_metrics_pairs(spark, d):
    """JN-9 / AGG-19: explicit relevance pairs (the next vector of the same label); others take no part."""
    e = table(spark, d, "embeddings")
    ranked = VM.cosine_topk(e, e, 100, "vec_id", "vec_id", "embedding", exclude_self=True)
    pairs = VM.neighbour_pairs(e, "vec_id", "embedding", "label")
    return VM.ir_metrics(ranked, pairs.select(F.col("id1").alias("query_id"), F.col("id2").alias("doc_id")))


@register("concat_sets", "SELECT vec_id, label, embedding[1] AS x FROM embeddings")
def concat_sets_q(spark, d):
    """VEC-6: one embedding table from two, whose columns stand in different orders."""
    e = table(spark, d, "embeddings")
    both = VM.concat_sets(e.where("label < 3"), e.where("label >= 3").select("label", "embedding", "vec_id"))
    return both.select("vec_id", "label", F.col("embedding")[0].alias("x"))


@register("triplet_accuracy",
          f"WITH {_NORM_SQL},\nmx AS (SELECT max(label) + 1 AS m FROM embeddings)\n"
          "SELECT round(avg(CAST(list_inner_product(a.v, p.v) > list_inner_product(a.v, ng.v) AS DOUBLE)), 6) "
          "AS triplet_accuracy FROM n a JOIN n p ON p.label = a.label AND p.rn = a.rn + 1 "
          "JOIN n ng ON ng.label = (a.label + 1) % (SELECT m FROM mx) AND ng.rn = a.rn")
def triplet_accuracy_q(spark, d):
    """AGG-18: anchor, next vector of its label, same-rank vector of the next label."""
    e = table(spark, d, "embeddings")
    m = e.agg(F.max("label")).first()[0] + 1
    pos = with_position(e.select("vec_id", "label", "embedding"), ["vec_id"], partition_by=["label"], pos_col="rn")
    a = pos.select("label", "rn", F.col("embedding").alias("a"))
    p = pos.select("label", (F.col("rn") - 1).alias("rn"), F.col("embedding").alias("p"))
    ng = pos.select(F.col("label").alias("nl"), F.col("rn").alias("nrn"), F.col("embedding").alias("n"))
    trip = a.join(p, ["label", "rn"]).join(
        ng, (F.col("nl") == (F.col("label") + 1) % m) & (F.col("nrn") == F.col("rn")))
    return VM.triplet_accuracy(trip, "a", "p", "n").select(F.round("triplet_accuracy", 6).alias("triplet_accuracy"))


@register("ranking_loss",
          f"WITH {_PAIRS_SQL},\n"
          "b AS (SELECT *, (row_number() OVER (ORDER BY label, id1) - 1) // 32 AS batch FROM pr),\n"
          "s AS (SELECT x.id1 AS i, x.label AS li, 100 * list_inner_product(x.z1, y.z2) AS s, x.id1 = y.id1 AS diag "
          "FROM b x JOIN b y ON x.batch = y.batch),\n"
          "m AS (SELECT i, li, max(s) AS m FROM s GROUP BY 1, 2),\n"
          "l AS (SELECT s.i, m.m + ln(sum(exp(s.s - m.m))) - max(CASE WHEN diag THEN s.s END) AS loss "
          "FROM s JOIN m USING (i, li) GROUP BY s.i, m.m)\n"
          "SELECT round(avg(loss), 6) AS ranking_loss FROM l")
def ranking_loss_q(spark, d):
    """AGG-23: in-batch-negatives loss (scale 100) over same-label neighbour pairs, batches of 32."""
    pr = _pairs(spark, d)
    return VM.ranking_loss(pr, ["label", "id1"], "z1", "z2", 32, 100.0).select(
        F.round("ranking_loss", 6).alias("ranking_loss"))


def _pool_sql(mode: str, last_n: int | None = None) -> str:
    flt = f"WHERE rn > mx - {last_n}" if last_n else ""
    if mode == "mean":
        w = "1.0 / cnt"
    else:
        w = "(rn - mn + 1) / (cnt * (cnt + 1) / 2.0)"
    return f"""WITH p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
       row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM embeddings),
q AS (SELECT *, max(rn) OVER (PARTITION BY label) AS mx FROM p),
r AS (SELECT * FROM q {flt}),
t AS (SELECT *, min(rn) OVER (PARTITION BY label) AS mn, count(*) OVER (PARTITION BY label) AS cnt FROM r),
u AS (SELECT label, {w} AS w, unnest(range(len(e))) AS dim, unnest(e) AS x FROM t),
g AS (SELECT label, dim, sum(w * x) AS s FROM u GROUP BY 1, 2)
SELECT label, list(round(s, 6) ORDER BY dim) AS pooled FROM g GROUP BY 1"""


def _label_tokens(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return with_position(e, ["vec_id"], partition_by=["label"], pos_col="rn")


@register("pool_mean", _pool_sql("mean"))
def pool_mean(spark, d):
    """VEC-4 mean pooling: each label's vectors (in id order) as one token sequence."""
    return VM.pool(_label_tokens(spark, d), "label", "rn", "embedding", "mean")


@register("pool_weighted_last", _pool_sql("weighted", 20))
def pool_weighted_last(spark, d):
    """VEC-4/5: position-weighted mean over the last 20 tokens (instruction mask)."""
    return VM.pool(_label_tokens(spark, d), "label", "rn", "embedding", "weighted", last_n=20)


@register("pool_last",
          "SELECT label, list_transform(CAST(arg_max(embedding, vec_id) AS DOUBLE[]), lambda x: round(x, 6)) AS pooled "
          "FROM embeddings GROUP BY label")
def pool_last(spark, d):
    """VEC-4 last-token pooling."""
    return VM.pool(_label_tokens(spark, d), "label", "rn", "embedding", "last")


@register("argmax", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS argmax FROM embeddings")
def argmax_q(spark, d):
    """PRJ-12: index of the largest component of every embedding."""
    return table(spark, d, "embeddings").select("vec_id", argmax("embedding").alias("argmax"))


# --- prediction metrics -----------------------------------------------------

def _cls_sql(src: str, pred: str, label: str) -> str:
    return f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE {pred} = {label}) AS correct,
  CAST(count(*) FILTER (WHERE {pred} = 1 AND {label} = 1) AS DOUBLE) AS tp,
  CAST(count(*) FILTER (WHERE {pred} = 1 AND {label} <> 1) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE {pred} <> 1 AND {label} = 1) AS DOUBLE) AS fn,
  CAST(count(*) FILTER (WHERE {pred} <> 1 AND {label} <> 1) AS DOUBLE) AS tn FROM {src}),
d AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc,
             sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS den FROM c)
SELECT round(correct / n, 6) AS accuracy, round(pr, 6) AS precision, round(rc, 6) AS recall,
       round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 6) AS f1,
       round(CASE WHEN den > 0 THEN (tp * tn - fp * fn) / den ELSE 0 END, 6) AS matthews_correlation FROM d"""


@register("accuracy_f1_mcc", _cls_sql("labels", "toxic", "quality"))
def accuracy_f1_mcc(spark, d):
    """AGG-10/13: 'toxic' scored as a prediction of 'quality'."""
    return M.classification_metrics(table(spark, d, "labels"), "toxic", "quality")


@register("pearson_spearman_mse",
          "WITH r AS (SELECT l_discount AS p, l_tax AS y, "
          "rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS rp, "
          "rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2.0 AS ry FROM lineitem)\n"
          "SELECT round(corr(p, y), 6) AS pearson, round(corr(rp, ry), 6) AS spearmanr, "
          "round(avg((p - y) * (p - y)), 6) AS mse FROM r")
def pearson_spearman_mse(spark, d):
    """AGG-11/12 over every lineitem row (discount as prediction of tax)."""
    li = table(spark, d, "lineitem")
    return M.regression_metrics(li, "l_discount", "l_tax", ["l_orderkey", "l_linenumber"])


_PACKED_SQL = "WITH " + QB._PACK_SQL.lstrip()


@register("token_accuracy_clm",
          _PACKED_SQL + " SELECT round(sum(len(list_filter(range(1, len(input_ids)), "
          "lambda i: input_ids[i] = input_ids[i + 1]))) / sum(len(input_ids) - 1), 6) AS accuracy FROM packed")
def token_accuracy_clm(spark, d):
    """AGG-5: next-token accuracy of the copy-previous-token predictor on packed blocks."""
    p = QB._packed(spark, d)
    return M.token_accuracy(p, "input_ids", "labels", shift=True)


def _masked_sql(extra: str) -> str:
    return ("WITH " + QB.ORACLE["mask_default"][5:].replace(" SELECT batch, block,", ", md AS (SELECT batch, block,", 1)
            + ") " + extra)


@register("token_accuracy_mlm",
          _masked_sql("SELECT round(sum(len(list_filter(range(1, len(labels) + 1), lambda i: labels[i] <> -100 AND "
                      "input_ids[i] = labels[i]))) / sum(len(list_filter(labels, lambda y: y <> -100))), 6) AS accuracy "
                      "FROM md"))
def token_accuracy_mlm(spark, d):
    """AGG-6: masked-token accuracy of the identity predictor (labels -100 ignored)."""
    m = QB.mask_default(spark, d)
    return M.token_accuracy(m, "input_ids", "labels", ignore_masked=True)


@register("token_accuracy_mntp",
          _masked_sql("SELECT round(sum(len(list_filter(range(1, len(labels)), lambda i: labels[i + 1] <> -100 AND "
                      "input_ids[i] = labels[i + 1]))) / sum(len(list_filter(labels[2:], lambda y: y <> -100))), 6) "
                      "AS accuracy FROM md"))
def token_accuracy_mntp(spark, d):
    """AGG-7: shifted + masked accuracy."""
    m = QB.mask_default(spark, d)
    return M.token_accuracy(m, "input_ids", "labels", shift=True, ignore_masked=True)


@register("perplexity", "SELECT round(exp(avg(ln(1 + value))), 6) AS perplexity FROM events")
def perplexity_q(spark, d):
    """AGG-9: exp(mean loss), loss = ln(1 + value) per event."""
    e = table(spark, d, "events")
    return M.perplexity(e.select(F.log1p("value").alias("loss")), "loss")


@register("class_distribution",
          "SELECT quality, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, "
          "printf('%.2f%%', count(*) / sum(count(*)) OVER () * 100) AS percent FROM labels GROUP BY quality")
def class_distribution_q(spark, d):
    """AGG-1 / STR-9: label counts and shares."""
    return M.class_distribution(table(spark, d, "labels"), "quality")


@register("distinct_labels",
          "SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS label_id, count(*) OVER () AS n_labels "
          "FROM (SELECT DISTINCT lang FROM documents)")
def distinct_labels(spark, d):
    """AGG-2 / SET-5: sorted distinct labels, their ids and how many there are."""
    langs = table(spark, d, "documents").select("lang").distinct()
    ids, n = with_position(langs, ["lang"], pos_col="label_id", return_total=True)
    return ids.select("lang", "label_id", F.lit(n).cast("bigint").alias("n_labels"))


@register("label_encode",
          "SELECT doc_id, source, r.id AS source_id FROM documents JOIN "
          "(SELECT source, row_number() OVER (ORDER BY source) - 1 AS id FROM (SELECT DISTINCT source FROM documents)) r "
          "USING (source)")
def label_encode(spark, d):
    """PRJ-7: source name -> id by sorted distinct order."""
    doc = table(spark, d, "documents").select("doc_id", "source")
    return M.label_ids(doc, "source", "source_id", passthrough="-1").select("doc_id", "source", "source_id")


@register("median_pivot",
          "SELECT l_returnflag, round(median(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), 6) AS \"F\", "
          "round(median(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 6) AS \"O\" FROM lineitem GROUP BY 1")
def median_pivot(spark, d):
    """AGG-16: median extended price, return flag x line status."""
    return M.median_pivot(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice")


@register("median_pivot_valid",
          "SELECT event_type, round(median(value) FILTER (WHERE user_id % 2 = 0), 6) AS \"0\", "
          "round(median(value) FILTER (WHERE user_id % 2 = 1), 6) AS \"1\" FROM events WHERE event_id % 7 <> 0 GROUP BY 1")
def median_pivot_valid(spark, d):
    """AGG-16 / FLT-14: medians over the records without an error (every seventh one has one)."""
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 2).alias("half"), "value",
                                         F.when(F.col("event_id") % 7 == 0, "failed").alias("error"))
    return M.median_pivot(e, "event_type", "half", "value", error_col="error")


@register("rate_columns",
          "SELECT event_id, CASE WHEN event_type <> 'error' AND value > 0 THEN round(value / length(props) * 1000.0, 6) "
          "ELSE 'NaN'::DOUBLE END AS avg_time_per_text_ms, CASE WHEN event_type <> 'error' AND value > 0 "
          "THEN round(length(props) / value, 6) ELSE 'NaN'::DOUBLE END AS throughput_texts_per_sec FROM events")
def rate_columns(spark, d):
    """PRJ-13: per event, props length as item count and value as elapsed seconds."""
    e = table(spark, d, "events").select(
        "event_id", F.length("props").alias("n"), F.col("value").alias("elapsed"),
        F.when(F.col("event_type") == "error", F.lit("error")).alias("error"))
    r = M.rate_columns(e, "n", "elapsed", "error")
    return r.select("event_id", F.round("avg_time_per_text_ms", 6).alias("avg_time_per_text_ms"),
                    F.round("throughput_texts_per_sec", 6).alias("throughput_texts_per_sec"))


@register("max_samples",
          "SELECT user_id, max(value) FILTER (WHERE event_type = 'view') AS max_view FROM events GROUP BY 1")
def max_samples(spark, d):
    """AGG-17: max of the samples, null when a user has none."""
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("value"))).alias("max_view"))


@register("glue_matched",
          "WITH j AS (SELECT l.toxic, l.quality, CASE WHEN d.lang = 'en' THEN 'matched' ELSE 'mismatched' END AS s "
          "FROM labels l JOIN documents d USING (doc_id)),\n"
          "a AS (SELECT round(avg(CAST(toxic = quality AS DOUBLE)) FILTER (WHERE s = 'matched'), 6) AS accuracy, "
          "round(avg(CAST(toxic = quality AS DOUBLE)) FILTER (WHERE s = 'mismatched'), 6) AS accuracy_mm FROM j)\n"
          "SELECT accuracy, accuracy_mm, round((accuracy + accuracy_mm) / 2, 6) AS combined_score FROM a")
def glue_matched(spark, d):
    """AGG-14/15: accuracy per evaluation split (English = matched), suffix _mm, combined score."""
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id") \
        .withColumn("s", F.when(F.col("lang") == "en", "matched").otherwise("mismatched"))
    acc = F.avg((F.col("toxic") == F.col("quality")).cast("double"))
    per = j.groupBy().pivot("s", ["matched", "mismatched"]).agg(F.round(acc, 6))
    per = per.select(F.col("matched").alias("accuracy"), F.col("mismatched").alias("accuracy_mm"))
    return M.combined_score(per, ["accuracy", "accuracy_mm"])


@register("prediction_lines",
          "SELECT l_orderkey * 10 + l_linenumber AS \"index\", printf('%3.3f', l_extendedprice / 7) AS prediction "
          "FROM lineitem")
def prediction_lines(spark, d):
    """SNK-5 projection: regression predictions formatted %3.3f."""
    from ..sources.writers import prediction_lines as pl
    li = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), (F.col("l_extendedprice") / 7).alias("p"))
    return pl(li, "idx", "p", regression=True)


@register("task_metrics_mrpc",
          "SELECT f1, accuracy, round((f1 + accuracy) / 2, 6) AS combined_score FROM ("
          + _cls_sql("labels", "toxic", "quality") + ")")
def task_metrics_mrpc(spark, d):
    """AGG-13/14: the metric set of an F1 task (F1, accuracy, combined score)."""
    return M.task_metrics(table(spark, d, "labels"), "mrpc", "toxic", "quality", ["doc_id"])
