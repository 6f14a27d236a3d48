"""Prediction metrics and result-table queries (AGG-1/2/5..17/22, PRJ-7/12/13).

Every metric is one aggregate over the prediction table (partial + final), so
it scales with the number of executors.  Exact medians and average ranks use
``with_position`` instead of an aggregate that buffers a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .position import with_position

IGNORE = -100


def classification_metrics(df: DataFrame, pred: str, label: str, positive=1, digits: int = 6) -> DataFrame:
    """AGG-10/13: accuracy, precision, recall, F1 (binary, positive class) and Matthews correlation."""
    p, y = F.col(pred), F.col(label)
    c = df.agg(F.count(F.lit(1)).alias("n"),
               F.count_if(p == y).alias("correct"),
               F.count_if((p == positive) & (y == positive)).alias("tp"),
               F.count_if((p == positive) & (y != positive)).alias("fp"),
               F.count_if((p != positive) & (y == positive)).alias("fn"),
               F.count_if((p != positive) & (y != positive)).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(0.0)
    return c.select(F.round(F.col("correct") / F.col("n"), digits).alias("accuracy"),
                    F.round(prec, digits).alias("precision"), F.round(rec, digits).alias("recall"),
                    F.round(f1, digits).alias("f1"), F.round(mcc, digits).alias("matthews_correlation"))


def average_ranks(df: DataFrame, value: str, id_cols: list[str], out: str) -> DataFrame:
    """1-based ranks with ties averaged: rank = (#smaller) + (ties + 1) / 2."""
    pos = with_position(df, [value, *id_cols], pos_col="_pos")
    per_value = pos.groupBy(value).agg(F.min("_pos").alias("_lo"), F.count(F.lit(1)).alias("_c"))
    r = per_value.select(value, (F.col("_lo") + (F.col("_c") + 1) / 2.0).alias(out))
    return df.join(r, value)


def regression_metrics(df: DataFrame, pred: str, label: str, id_cols: list[str], digits: int = 6) -> DataFrame:
    """AGG-11/12: Pearson, Spearman (Pearson of average ranks) and MSE."""
    ranked = average_ranks(average_ranks(df.select(*id_cols, pred, label), pred, id_cols, "_rp"),
                           label, id_cols, "_rl")
    return ranked.agg(F.round(F.corr(pred, label), digits).alias("pearson"),
                      F.round(F.corr("_rp", "_rl"), digits).alias("spearmanr"),
                      F.round(F.avg((F.col(pred) - F.col(label)) ** 2), digits).alias("mse"))


def combined_score(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """AGG-14: mean of the metric columns when there is more than one."""
    if len(cols) < 2:
        return df
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    return df.withColumn("combined_score", F.round(total / len(cols), digits))


def token_accuracy(df: DataFrame, preds: str, labels: str, shift: bool = False, ignore_masked: bool = False,
                   digits: int = 6) -> DataFrame:
    """AGG-5/6/7: flattened token accuracy.

    ``shift``: predictions[:-1] against labels[1:] (causal LM).
    ``ignore_masked``: positions whose label is -100 are left out.
    """
    p, y = F.col(preds), F.col(labels)
    if shift:
        p = F.slice(p, 1, F.size(p) - 1)
        y = F.slice(y, 2, F.size(y) - 1)
    z = F.arrays_zip(p.alias("p"), y.alias("y"))
    if ignore_masked:
        z = F.filter(z, lambda e: e["y"] != IGNORE)
    hits = F.aggregate("_z", F.lit(0).cast("bigint"), lambda s, e: s + (e["p"] == e["y"]).cast("bigint"))
    per_row = df.select(z.alias("_z")).select(hits.alias("_h"), F.size("_z").cast("bigint").alias("_n"))
    return per_row.agg(F.round(F.sum("_h") / F.sum("_n"), digits).alias("accuracy"))


def perplexity(df: DataFrame, loss: str, digits: int = 6) -> DataFrame:
    """AGG-9: exp(mean loss); overflow gives +inf."""
    return df.agg(F.round(F.exp(F.avg(loss)), digits).alias("perplexity"))


def class_distribution(df: DataFrame, label: str, digits: int = 6) -> DataFrame:
    """AGG-1 / STR-9: count, share and a percent string per label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # the grouped table has one row per class: a global window over it is tiny
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.select(label, "n", F.round(share, digits).alias("share"),
                         F.format_string("%.2f%%", share * 100).alias("percent"))


def label_ids(df: DataFrame, label: str, out: str = "label_id", passthrough=-1) -> DataFrame:
    """PRJ-7 / AGG-2: label -> index in the sorted distinct labels; ``passthrough`` stays as is."""
    distinct = df.where(F.col(label) != F.lit(passthrough)).select(label).distinct()
    ids, n = with_position(distinct, [label], pos_col=out, return_total=True)
    j = df.join(F.broadcast(ids) if n <= 1_000_000 else ids, label, "left")
    return j.withColumn(out, F.when(F.col(label) == F.lit(passthrough), F.lit(passthrough)).otherwise(F.col(out)))


def exact_median(df: DataFrame, group_cols: list[str], value: str, out: str = "median") -> DataFrame:
    """Exact median per group (mean of the two middle values for an even count).

    Positions inside each group come from a range-partitioned sort with a row
    number as the last key, so neither a group nor a single value that holds a
    third of the rows lands in one task; only the two middle rows per group are
    aggregated.
    """
    v = df.select(*group_cols, value, F.monotonically_increasing_id().alias("_tie")).where(F.col(value).isNotNull())
    j = with_position(v, [value, "_tie"], partition_by=group_cols, pos_col="_p", size_col="_n")
    mid = j.where((F.col("_p") == F.floor((F.col("_n") - 1) / 2)) | (F.col("_p") == F.ceil((F.col("_n") - 1) / 2)))
    return mid.groupBy(*group_cols).agg(F.avg(value).alias(out))


def median_pivot(df: DataFrame, row: str, col: str, value: str, digits: int = 6,
                 error_col: str | None = None) -> DataFrame:
    """AGG-16 / FLT-14: rows x columns table of medians over the records without an error."""
    med = exact_median(df if error_col is None else df.where(F.col(error_col).isNull()), [row, col], value)
    return med.groupBy(row).pivot(col).agg(F.round(F.first("median"), digits))


def rate_columns(df: DataFrame, n_col: str, elapsed_col: str, error_col: str) -> DataFrame:
    """PRJ-13: avg ms per item and items per second; NaN on error or non-positive time."""
    ok = F.col(error_col).isNull() & (F.col(elapsed_col) > 0)
    nan = F.lit(float("nan"))
    return df.withColumn("avg_time_per_text_ms",
                         F.when(ok, F.col(elapsed_col) / F.col(n_col) * 1000.0).otherwise(nan)) \
             .withColumn("throughput_texts_per_sec", F.when(ok, F.col(n_col) / F.col(elapsed_col)).otherwise(nan))


# Sentence columns per evaluation task (None = no second sentence).
TASK_SENTENCE_COLUMNS = {
    "cola": ("sentence", None),
    "mnli": ("premise", "hypothesis"),
    "mrpc": ("sentence1", "sentence2"),
    "qnli": ("question", "sentence"),
    "qqp": ("question1", "question2"),
    "rte": ("sentence1", "sentence2"),
    "sst2": ("sentence", None),
    "stsb": ("sentence1", "sentence2"),
    "wnli": ("sentence1", "sentence2"),
    "JSTS": ("sentence1", "sentence2"),
    "JNLI": ("sentence1", "sentence2"),
    "JCoLA": ("sentence", None),
}
REGRESSION_TASKS = ("stsb", "JSTS")


def sentence_columns(task: str | None, columns: list[str], label_col: str = "label") -> tuple[str, str | None]:
    """PRJ-10: the task's sentence columns; else sentence1/2; else the first two non-label columns."""
    if task in TASK_SENTENCE_COLUMNS:
        return TASK_SENTENCE_COLUMNS[task]
    if "sentence1" in columns and "sentence2" in columns:
        return "sentence1", "sentence2"
    rest = [c for c in columns if c != label_col]
    if len(rest) >= 2:
        return rest[0], rest[1]
    return rest[0], None


def task_metrics(df: DataFrame, task: str | None, pred: str, label: str, id_cols: list[str],
                 regression: bool | None = None) -> DataFrame:
    """AGG-10..14: the metric set a task is scored with, plus ``combined_score`` when several.

    cola -> Matthews correlation; mrpc / qqp -> F1 and accuracy; stsb-like ->
    Pearson and Spearman; regression without a task -> MSE; otherwise accuracy.
    """
    is_reg = (task in REGRESSION_TASKS) if regression is None else regression
    if task in REGRESSION_TASKS:
        out = regression_metrics(df, pred, label, id_cols).select("pearson", "spearmanr")
        return combined_score(out, ["pearson", "spearmanr"])
    if is_reg:
        return regression_metrics(df, pred, label, id_cols).select("mse")
    cls = classification_metrics(df, pred, label)
    if task == "cola":
        return cls.select("matthews_correlation")
    if task in ("mrpc", "qqp"):
        return combined_score(cls.select("f1", "accuracy"), ["f1", "accuracy"])
    return cls.select("accuracy")
