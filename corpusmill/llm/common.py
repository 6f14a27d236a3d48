"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, ship_package

#: The remainder of crc32(doc_id) that marks a held-out row, and its modulus.
HELD_OUT_MOD = 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark alone (the path may be one only Hadoop readers open)."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def need(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns: whatever else the table has cannot clash with derived names."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def text_bytes(col: str = "text"):
    """UTF-8 bytes of a text column; null stays null."""
    return F.col(f"`{col}`").cast("binary")


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id's decimal text is divisible by five (a null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % HELD_OUT_MOD == 0


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write once under the shared checkpoint folder and read back (cuts lineage, survives lost executors)."""
    return materialize(df, tag)
