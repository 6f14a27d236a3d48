"""Dataset readers (SRC-*).

Every reader returns a DataFrame; the split / subset of a record is a column
(``split``, ``subset``) so partition pruning replaces the reference's
per-split loops.  The reader format is explicit; there is no silent fallback.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.position import with_position
from .jsonarray import array_items


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                    pos_col: str | None = None) -> DataFrame:
    """SRC-1: JSON files that each hold one array of objects of any size (heterogeneous objects merge).

    A file is read by many tasks (``jsonarray``).  Without a schema one more pass
    infers it.  ``pos_col`` numbers the records in file order.
    """
    records = array_items(spark, path)
    if schema is None:
        schema = spark.read.json(records.rdd.map(lambda r: r["item"])).schema
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if pos_col:
        records = with_position(records, ["file", "block", "number"], pos_col=pos_col)
    parsed = records.withColumn("_record", F.from_json("item", fields))
    return parsed.select(*([pos_col] if pos_col else []), *[F.col("_record")[n].alias(n) for n in fields.fieldNames()])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """SRC-2 / SRC-4: JSON Lines (splittable)."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",") -> DataFrame:
    """SRC-3: CSV with a header row; an explicit schema avoids the inference pass."""
    r = (spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"')
         .option("maxCharsPerColumn", -1))
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def read_text(spark: SparkSession, path: str, keep_linebreaks: bool = False, col: str = "text") -> DataFrame:
    """SRC-5: one row per line; ``keep_linebreaks`` re-appends the newline."""
    df = spark.read.text(path)
    v = F.concat(F.col("value"), F.lit("\n")) if keep_linebreaks else F.col("value")
    return df.select(v.alias(col))


def read_splits(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """SRC-6: a dataset stored as ``root/split=<name>/...`` — every split, tagged."""
    return spark.read.format(fmt).load(root)


def choose_split(df: DataFrame, split_col: str = "split", preferred: str = "train") -> DataFrame:
    """SRC-7: ``train`` if present, else the first split name (sorted).

    One small aggregate over the split column (partition values only when the
    column is a directory partition).
    """
    names = [r[0] for r in df.select(split_col).distinct().orderBy(split_col).collect()]
    if not names:
        return df
    chosen = preferred if preferred in names else names[0]
    return df.where(F.col(split_col) == chosen)


def select_subsets(df: DataFrame, subsets: list[str] | str | None, subset_col: str = "subset") -> DataFrame:
    """SRC-8: all subsets (None), a list, or one name — a partition filter."""
    if subsets is None:
        return df
    names = [subsets] if isinstance(subsets, str) else list(subsets)
    return df.where(F.col(subset_col).isin(names))


def read_token_list(spark: SparkSession, path: str, col: str = "token") -> DataFrame:
    """SRC-11: JSON arrays of strings -> (pos, token) rows; ``pos`` counts on from file to file."""
    items = with_position(array_items(spark, path), ["file", "block", "number"], pos_col="pos")
    value = F.from_json(F.concat(F.lit("["), "item", F.lit("]")), T.ArrayType(T.StringType()))
    return items.select("pos", F.element_at(value, 1).alias(col))


def read_word_list(spark: SparkSession, path: str, col: str = "word") -> DataFrame:
    """SRC-12: newline-separated words, blank lines dropped, surrounding spaces stripped."""
    df = spark.read.text(path)
    return df.select(F.trim(F.col("value")).alias(col)).where(F.col(col) != "")
