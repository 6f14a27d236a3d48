"""SRC-10: the first rows of a dataset without reading all of it.

A dataset is a list of files.  They are read in name order in growing steps (one, two,
four ... files) until enough rows have passed the filter; the rows of the last step are
cut in file order.  What the reference's lazy reader gets from iterating row by row comes
here from never planning a scan of the files behind the step that was enough.  Row order
is the order of files and of rows in them, which Parquet keeps (``_metadata.row_index``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import cap_prefix
from ..session import materialize


@dataclass
class LazyRead:
    """``rows`` in order by ``pos``, and what it took: files in all, files and rows read."""
    rows: DataFrame
    files: int
    files_read: int
    rows_read: int


def first_rows(spark: SparkSession, path: str, n: int, keep: F.Column | None = None, count: str = "kept",
               first_step: int = 1) -> LazyRead:
    """The first ``n`` rows of a Parquet dataset that pass ``keep``; with ``count='raw'`` those among its first ``n`` rows.

    Every step writes its rows once; how many were read and kept is observed in that
    very pass.  A step's rows that are too many are cut by (file, row).
    """
    if count not in ("kept", "raw"):
        raise ValueError("count must be 'kept' or 'raw'")
    whole = spark.read.parquet(path)
    files = sorted(whole.inputFiles())
    keep = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    steps, at, found, read = [], 0, 0, 0
    size = first_step
    while at < len(files) and found < n:
        some = files[at:at + size]
        seen, kept = Observation(), Observation()
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        rows = spark.read.schema(whole.schema).parquet(*some).withColumn("_place", place)
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n"))
        if count == "kept":
            rows = rows.where(keep)
        written = materialize(rows.observe(kept, F.count(F.lit(1)).alias("n")), "lazy")
        enough = found + kept.get["n"] > n
        if enough:
            written = cap_prefix(written, n - found, ["_place.file", "_place.row"])
        steps.append(written if count == "kept" else written.where(keep))
        found += kept.get["n"]
        read += seen.get["n"]
        at += size
        size *= 2
    if not steps:
        return LazyRead(whole.limit(0), len(files), 0, 0)
    out = steps[0]
    for step in steps[1:]:
        out = out.union(step)
    return LazyRead(out, len(files), min(at, len(files)), read)
