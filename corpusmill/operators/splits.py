"""Train / validation / test splits (SPL-2..5) as a ``split`` column.

Sizes are resolved on the driver from the row count that ``with_position``
returns with the positions (global or per stratum), so a stratum holding a third of the
rows is still ranked by many tasks.  The random order is the seeded md5 key of
the id columns; the permutation is not Python's, the contract (seeded,
uniform, exact sizes) is.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .position import shuffle_key, with_position
from .sampling import rows_of


class Sizes(NamedTuple):
    """Rows of each part; training gets what the two held-out parts leave."""

    train: int
    validation: int
    test: int

    @classmethod
    def of(cls, rows: int, test: int | float, validation: int | float | None = None) -> Sizes:
        held = [rows_of(part, rows) for part in (0 if validation is None else validation, test)]
        left = rows - sum(held)
        if left < 0:
            raise ValueError(f"the held-out parts ask for {sum(held)} rows and there are {rows}")
        return cls(left, *held)


def _order(df: DataFrame, id_cols: list[str], mode: str, seed: int):
    if mode == "random":
        return df.withColumn("_cm_key", shuffle_key(seed, *id_cols)), ["_cm_key", *id_cols]
    if mode == "sequential":
        return df, list(id_cols)
    raise ValueError(f"unknown order of rows for a split: {mode!r}")


def split_dataset(df: DataFrame, test_size, val_size=None, split_mode: str = "random",
                  random_seed: int = 42, stratify_key: str | None = None,
                  id_cols: list[str] | None = None, split_col: str = "split",
                  n_total: int | None = None) -> DataFrame:
    """Return ``df`` plus ``split_col`` in {'train', 'validation', 'test'}.

    Sequential: train, then validation, then test in ``id_cols`` order.
    Random: the same on a seeded shuffle.  Stratified: inside each stratum,
    ``int(size * n_x / total)`` rows to train and validation, the rest to test.
    """
    if not id_cols:
        raise ValueError("id_cols gives the record order")
    ordered, order = _order(df, id_cols, split_mode, random_seed)
    groups = [stratify_key] if stratify_key else None
    # one checkpointed pass gives positions, the total and the stratum sizes
    pos, total = with_position(ordered, order, partition_by=groups, pos_col="_cm_pos",
                               size_col="_cm_size" if stratify_key else None, return_total=True)
    if n_total is not None:
        total = n_total
    n_train, n_val, _ = Sizes.of(total, test_size, val_size)
    if not stratify_key:
        label = (F.when(F.col("_cm_pos") < n_train, "train")
                  .when(F.col("_cm_pos") < n_train + n_val, "validation")
                  .otherwise("test"))
        return pos.select(*df.columns, label.alias(split_col))
    g_train = F.floor(F.col("_cm_size") * F.lit(n_train / total))
    g_val = F.floor(F.col("_cm_size") * F.lit(n_val / total)) if n_val else F.lit(0)
    label = (F.when(F.col("_cm_pos") < g_train, "train")
              .when(F.col("_cm_pos") < g_train + g_val, "validation")
              .otherwise("test"))
    return pos.select(*df.columns, label.alias(split_col))
