"""Dataset writers (SNK-*).  All are distributed writes of sharded files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import newline_to_space


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """SNK-1 / SNK-2 / SNK-6 / SNK-9: JSON Lines, one folder per split when partitioned.

    Non-ASCII text is written as UTF-8 (not escaped).
    """
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """SNK-3: CSV with header, no index column; quotes are doubled and blanks at the ends kept, as ``read_csv`` expects."""
    (df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_text_corpus(df: DataFrame, col: str, path: str, mode: str = "overwrite") -> None:
    """SNK-4: one sample per line, newlines inside a sample become spaces."""
    df.select(newline_to_space(F.col(col)).alias("value")).write.mode(mode).text(path)


def prediction_lines(df: DataFrame, index_col: str, pred_col: str, regression: bool) -> DataFrame:
    """SNK-5 projection: ``index, prediction``; regression values as ``%3.3f``."""
    p = F.format_string("%3.3f", F.col(pred_col)) if regression else F.col(pred_col).cast("string")
    return df.select(F.col(index_col).alias("index"), p.alias("prediction"))


def write_predictions(df: DataFrame, index_col: str, pred_col: str, path: str, regression: bool = False) -> None:
    """SNK-5: TSV ``index<TAB>prediction`` with a header."""
    write_csv(prediction_lines(df, index_col, pred_col, regression), path, sep="\t")


def write_metrics(df: DataFrame, path: str) -> None:
    """SNK-7: a (small) metrics frame as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """SNK-8: index tables (postings, df, doc_len) and any intermediate result."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
