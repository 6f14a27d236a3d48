"""Dense positions without a single-partition window.

The reference keeps records in Python lists, so "first", "prefix" and "the
i-th row" are part of its semantics.  ``with_position`` gives every row its
0-based rank under an explicit ordering (optionally within groups):

1. range-partition on (groups, order) and sort inside partitions — one shuffle
   whose bounds split a hot group across many tasks;
2. in the same stage, tag each row with its range-partition id and its index
   inside the sorted partition, and write the result once to the shared
   checkpoint folder (range bounds come from sampling and would differ on a
   recompute; the written table fixes them and the upstream plan runs once);
3. count rows per (range partition, group) — a table of at most
   partitions + groups rows — prefix-sum it with a small window and write
   that small table too;
4. position = group offset of the partition + in-partition index.

No step holds more than one partition of data in a task, and nothing but
scalars (row counts) reaches the driver.  The same pass yields the total row
count and, per group, the group size, so callers never ``count()`` their input
a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# broadcast the offset table only while it is this small (rows)
OFFSET_BROADCAST_ROWS = 2_000_000


def shuffle_key(seed: int, *id_cols) -> F.Column:
    """Deterministic pseudo-random order key: md5('seed:id').

    Sorting by it (ties by id) is a seeded uniform shuffle that DuckDB
    reproduces bit for bit.
    """
    parts = [F.lit(f"{seed}:")]
    for i, c in enumerate(id_cols):
        if i:
            parts.append(F.lit(":"))
        parts.append(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))
    return F.md5(F.concat(*parts))


#: Bytes of input that one range partition is meant to hold.
PARTITION_BYTES = 256 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that the plan reads (sources of unknown size count as nothing)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def with_position(df: DataFrame, order_by: list, partition_by: list | None = None,
                  pos_col: str = "pos", size_col: str | None = None, num_partitions: int | None = None,
                  return_total: bool = False):
    """Add ``pos_col`` = 0-based rank of the row by ``order_by`` within ``partition_by``.

    ``order_by`` should make the order total (append an id column to break
    ties).  ``size_col`` adds the size of the row's group.  With
    ``return_total`` the result is ``(frame, total_rows)``.
    """
    spark = df.sparkSession
    groups = list(partition_by or [])
    # as many range partitions as the session shuffles into, more where the input needs them
    n = num_partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(df) // PARTITION_BYTES)
    keys = [_col(g) for g in groups] + [_col(o) for o in order_by]
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    mid = F.monotonically_increasing_id()
    tagged = materialize(ranged.withColumn("_cm_pid", F.spark_partition_id())
                         .withColumn("_cm_li", mid - F.shiftleft(F.shiftright(mid, 33), 33)), "pos")
    gnames = [f"_cm_g{i}" for i in range(len(groups))]
    stats = (tagged.select("_cm_pid", "_cm_li", *[_col(g).alias(a) for g, a in zip(groups, gnames)])
             .groupBy("_cm_pid", *gnames)
             .agg(F.count(F.lit(1)).alias("_cm_n"), F.min("_cm_li").alias("_cm_first")))
    w = Window.partitionBy(*gnames).orderBy("_cm_pid")
    offsets = materialize(
        stats.withColumn("_cm_off", F.sum("_cm_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cm_n"))
             .withColumn("_cm_gsize", F.sum("_cm_n").over(Window.partitionBy(*gnames)))
             .withColumnRenamed("_cm_pid", "_cm_opid"), "offsets")
    summary = offsets.agg(F.count(F.lit(1)).alias("rows"), F.sum("_cm_n").alias("total")).first()
    if summary["rows"] <= OFFSET_BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    cond = tagged["_cm_pid"] == offsets["_cm_opid"]
    for g, a in zip(groups, gnames):
        cond = cond & (tagged[g] if isinstance(g, str) else g).eqNullSafe(offsets[a])
    out = tagged.join(offsets, cond, "inner")
    out = out.withColumn(pos_col, F.col("_cm_off") + (F.col("_cm_li") - F.col("_cm_first")))
    if size_col:
        out = out.withColumn(size_col, F.col("_cm_gsize"))
    out = out.drop("_cm_li", "_cm_first", "_cm_off", "_cm_pid", "_cm_opid", "_cm_n", "_cm_gsize", *gnames)
    return (out, int(summary["total"] or 0)) if return_total else out
