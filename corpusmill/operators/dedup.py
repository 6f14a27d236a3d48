"""Exact de-duplication (first occurrence wins).

Both operators are one hash aggregate (partial + final, so a value held by a
third of all rows still collapses map-side) and, for the column form, one
equi-join back whose skewed side AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _order_struct(order_by: list) -> F.Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    return F.struct(*cols) if len(cols) > 1 else cols[0]


def dedup_records(df: DataFrame, key_cols: list[str] | None = None, order_by: list | None = None) -> DataFrame:
    """Keep the first record (by ``order_by``) of every distinct key.

    ``key_cols`` None or empty means all columns.  A null key value is a value
    of its own (null groups with null).
    """
    keys = list(key_cols) if key_cols else list(df.columns)
    if not order_by:
        raise ValueError("order_by is required: first-wins needs an order")
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    firsts = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]), _order_struct(order_by)).alias("_cm_first"))
    return firsts.select(*[F.col(k) for k in keys], *[F.col("_cm_first")[c].alias(c) for c in rest]) \
                 .select(*df.columns)


def dedup_column(df: DataFrame, col: str, order_by: list) -> DataFrame:
    """Null out later repeats of a value in ``col``; nulls stay null; no row is removed."""
    o = _order_struct(order_by)
    firsts = (df.where(F.col(col).isNotNull())
                .groupBy(F.col(col).alias("_cm_v")).agg(F.min(o).alias("_cm_first")))
    joined = df.join(firsts, df[col] == firsts["_cm_v"], "left")
    kept = F.when(o == F.col("_cm_first"), F.col(col))
    return joined.select(*[kept.alias(c) if c == col else F.col(c) for c in df.columns])
