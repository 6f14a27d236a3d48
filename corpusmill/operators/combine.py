"""Subset combination (SET-1..3, SRC-8/9, PRJ-5/6).

A multi-subset dataset is one DataFrame with a ``subset`` column (a directory
partition on disk), so subset selection is partition pruning and every
per-subset step is a grouped operator instead of a driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .position import shuffle_key, with_position


#: Up to this many rows a subset's cap is a top-k inside the tasks; the result is the same either way.
SMALL_CAP = 1000
#: A subset column names folders; with more distinct values than this it is taken for an id by mistake.
MAX_SUBSETS = 10_000


def subset_names(df: DataFrame, subset_col: str = "subset") -> list[str]:
    """The subset names in order; raises beyond ``MAX_SUBSETS`` instead of collecting an id column."""
    names = [r[0] for r in df.select(subset_col).where(F.col(subset_col).isNotNull()).distinct().limit(MAX_SUBSETS + 1).collect()]
    if len(names) > MAX_SUBSETS:
        raise ValueError(f"{subset_col} has more than {MAX_SUBSETS} values")
    return sorted(names)


def subset_label(subset_col: str, names: list[str]) -> F.Column:
    """PRJ-5/6: index of the subset name in ``names`` (ClassLabel encoding), -1 if absent."""
    return (F.array_position(F.array(*[F.lit(n) for n in names]), F.col(subset_col)) - 1).cast("int")


def concat_subsets(frames: dict[str, DataFrame], subset_col: str = "subset") -> DataFrame:
    """SET-1: union by column name (missing columns become null), tagged by subset."""
    out = None
    for name, df in frames.items():
        tagged = df.withColumn(subset_col, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def interleave(df: DataFrame, subset_col: str, names: list[str] | None, order_by: list[str],
               pos_col: str = "pos") -> DataFrame:
    """SET-2: round-robin over subsets in ``names`` order (None: all, by name), stopping at the first exhausted.

    Keeps rank < min(subset sizes) in every subset; ``pos_col`` is the
    interleaved order (rank x k + subset index).  The sizes come from the pass
    that ranks the rows.
    """
    names = subset_names(df, subset_col) if names is None else names
    k = len(names)
    ranked = with_position(df.where(F.col(subset_col).isin(names)), order_by, partition_by=[subset_col], pos_col="_rn",
                           size_col="_size")
    counts = dict(ranked.where("_rn = 0").select(subset_col, "_size").collect())  # one row per subset
    m = min((counts.get(n, 0) for n in names), default=0)
    idx = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(subset_col)) - 1
    return ranked.drop("_size").where(F.col("_rn") < m).withColumn(pos_col, F.col("_rn") * k + idx).drop("_rn")


def assemble_subsets(df: DataFrame, subset_col: str, names: list[str] | None, id_cols: list[str],
                     max_per_subset: int | None = None, seed: int = 42, validation_percent: float | None = None,
                     label_col: str = "label", split_col: str = "split") -> DataFrame:
    """SET-3: select subsets -> seeded cap per subset -> label -> percent validation slice.

    The validation slice is the first ``validation_percent`` % of each subset in
    its shuffled order; the rest is train.
    """
    if names is None:
        names = subset_names(df, subset_col)
    sel = df.where(F.col(subset_col).isin(names)).withColumn("_k", shuffle_key(seed, *id_cols))
    order = ["_k", *id_cols]
    if max_per_subset is not None and max_per_subset <= SMALL_CAP:
        # a partial top-k in every task (window group limit) leaves few rows to rank: nothing is written
        w = Window.partitionBy(subset_col).orderBy(*order)
        ranked = sel.withColumn("_rn", F.row_number().over(w) - 1).where(F.col("_rn") < max_per_subset)
    else:
        ranked = with_position(sel, order, partition_by=[subset_col], pos_col="_rn")
        if max_per_subset is not None:
            ranked = ranked.where(F.col("_rn") < max_per_subset)
    out = ranked.withColumn(label_col, subset_label(subset_col, names))
    if validation_percent is not None:
        sizes = out.groupBy(subset_col).agg(F.count(F.lit(1)).alias("_n"))
        # half-to-even rounding of n * p / 100, as the percent slice does
        cut = F.bround(F.col("_n") * F.lit(validation_percent) / 100.0, 0)
        out = out.join(sizes, subset_col) \
                 .withColumn(split_col, F.when(F.col("_rn") < cut, "validation").otherwise("train")).drop("_n")
    return out.drop("_k", "_rn")
