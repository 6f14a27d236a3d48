"""Structured Streaming forms of the lazy readers (STM-1, STM-5, UDF-2; the steps with state are in ``stateful``).

The reference's "streaming" is lazy iteration over a dataset.  Here a
directory of files is a file-source stream (``maxFilesPerTrigger`` bounds each
micro-batch), stateless operators are the same Catalyst expressions as in batch,
and first-seen exact dedup keeps a state-store key per distinct text hash
(bounded by a watermark when the records carry an event time).  Every query
has a checkpoint location, so a restarted or failed query resumes exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import cleanse_text


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = 1, glob: str | None = None) -> DataFrame:
    """STM-1: a file directory as an unbounded source, a few files per micro-batch.

    ``glob`` keeps only matching file names of the directory.
    """
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def cleanse_stream(stream: DataFrame, text_col: str, event_time_col: str | None = None,
                   watermark: str = "1 hour", **rule_options) -> DataFrame:
    """STM-5: rule cleansing, then first-seen exact dedup on sha2(text).

    With an event-time column the dedup state is bounded by the watermark
    (``dropDuplicatesWithinWatermark``); without one it is kept per distinct text.
    """
    cleaned = stream.withColumn(text_col, cleanse_text(F.col(text_col), **rule_options)) \
                    .where(F.col(text_col).isNotNull()) \
                    .withColumn("text_key", F.sha2(F.col(text_col), 256))
    if event_time_col:
        return cleaned.withWatermark(event_time_col, watermark).dropDuplicatesWithinWatermark(["text_key"])
    return cleaned.dropDuplicates(["text_key"])


def union_streams(*streams: DataFrame) -> DataFrame:
    """Sources in one stream, in arrival order (``stateful.interleave_streams`` takes turns)."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def write_stream(df: DataFrame, sink_path: str, checkpoint_location: str, fmt: str = "parquet",
                 available_now: bool = True) -> StreamingQuery:
    """Append to files with a checkpoint; ``available_now`` drains what exists and stops."""
    w = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(sink_path)


def per_batch_stream(stream: DataFrame, step: Callable[[DataFrame], DataFrame], sink_path: str,
                     checkpoint_location: str) -> StreamingQuery:
    """UDF-2: any DataFrame step as a hook on every micro-batch, its rows under ``sink_path/epoch=<n>``.

    The folder of an epoch is overwritten, so a batch that runs again after a
    failure leaves its rows once.
    """
    def per_batch(batch: DataFrame, epoch: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/epoch={epoch}")

    return (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
            .trigger(availableNow=True).start())
