"""Stream steps whose result does not depend on where micro-batches are cut.

A step keeps what it has not yet given out (a shuffle buffer, an open batch, the
rows of a source that runs ahead) and a few counts.  Both are a *state table* under
the checkpoint folder, one folder per epoch: epoch k reads the state of epoch k - 1,
writes its rows to ``sink/epoch=k`` and its own state to ``state/epoch=k``, each by
overwriting.  An epoch that runs again after a failure, or on another driver, finds
the same input and the same earlier state and leaves the same rows once.

``drain`` runs a stream over everything that is there and then lets the step give
out what it still holds (``sink/epoch=-1``), as a lazy reader does when its source
is exhausted.  Should the stream be resumed later, that tail is withdrawn first and
its rows come out of the state again.

Rows are numbered in arrival order: micro-batch by micro-batch, inside one by
``order_by``.  The state of a shuffle holds ``buffer`` rows, that of a packer fewer
than ``batch_rows``; an interleaver holds what its fastest source is ahead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.position import with_position
from ..operators.trainset import pack_blocks

#: The epoch under which a sink holds what was left at the end of its source.
TAIL = -1

Step = Callable[[DataFrame, "DataFrame | None", dict], "tuple[DataFrame | None, DataFrame | None, dict]"]
Finish = Callable[["DataFrame | None", dict], "DataFrame | None"]


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _delete(spark: SparkSession, path: str) -> None:
    fs, target = _path(spark, path)
    fs.delete(target, True)


def _exists(spark: SparkSession, path: str) -> bool:
    fs, target = _path(spark, path)
    return fs.exists(target)


class StateTable:
    """Rows and counts of a step, one version per epoch; the two newest are kept."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def load(self, epoch: int) -> tuple[DataFrame | None, dict]:
        """What ``epoch`` left behind (nothing before the first)."""
        at = f"{self.path}/epoch={epoch}"
        if not _exists(self.spark, f"{at}/counts/_SUCCESS"):
            return None, {}
        counts = self.spark.read.schema("name string, value long").parquet(f"{at}/counts")
        rows = self.spark.read.parquet(f"{at}/rows") if _exists(self.spark, f"{at}/rows/_SUCCESS") else None
        return rows, dict(counts.collect())

    def save(self, epoch: int, rows: DataFrame | None, counts: dict) -> None:
        at = f"{self.path}/epoch={epoch}"
        if rows is None:
            _delete(self.spark, f"{at}/rows")
        else:
            rows.write.mode("overwrite").parquet(f"{at}/rows")
        # the counts are written last: they say that the epoch's state is whole
        (self.spark.createDataFrame(sorted(counts.items()), "name string, value long").coalesce(1)
         .write.mode("overwrite").parquet(f"{at}/counts"))
        _delete(self.spark, f"{self.path}/epoch={epoch - 2}")

    def newest(self) -> int | None:
        fs, target = _path(self.spark, self.path)
        if not fs.exists(target):
            return None
        names = [f.getPath().getName() for f in fs.listStatus(target)]
        whole = [int(n[6:]) for n in names if n.startswith("epoch=") and _exists(self.spark, f"{self.path}/{n}/counts/_SUCCESS")]
        return max(whole, default=None)


def stateful_stream(stream: DataFrame, step: Step, sink_path: str, checkpoint_location: str) -> StreamingQuery:
    """Start ``step`` on every micro-batch with the state that the one before left."""
    spark = stream.sparkSession
    state = StateTable(spark, f"{checkpoint_location.rstrip('/')}/state")
    sink = sink_path.rstrip("/")

    def per_batch(batch: DataFrame, epoch: int) -> None:
        _delete(spark, f"{sink}/epoch={TAIL}")
        rows, counts = state.load(epoch - 1)
        out, kept, counts = step(batch, rows, counts)
        if out is not None:
            out.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
        state.save(epoch, kept, counts)

    return (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
            .trigger(availableNow=True).start())


def drain(stream: DataFrame, step: Step, finish: Finish, sink_path: str, checkpoint_location: str) -> None:
    """Run the stream over all that is there, then write what the step still holds."""
    stateful_stream(stream, step, sink_path, checkpoint_location).awaitTermination()
    state = StateTable(stream.sparkSession, f"{checkpoint_location.rstrip('/')}/state")
    last = state.newest()
    tail = None if last is None else finish(*state.load(last))
    if tail is not None:
        tail.write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/epoch={TAIL}")


def read_sink(spark: SparkSession, sink_path: str, schema: StructType | str) -> DataFrame:
    """The rows of a sink without its epoch column (an empty frame if nothing was written)."""
    empty = spark.createDataFrame([], schema)
    if not _exists(spark, sink_path):
        return empty
    return spark.read.schema(empty.schema).parquet(sink_path).select(*empty.columns)


def _numbered(batch: DataFrame, order_by: list[str], seen: int, name: str) -> tuple[DataFrame, int]:
    """The batch with its rows' arrival numbers, and how many rows have arrived by now."""
    rows, total = with_position(batch, order_by, pos_col=name, return_total=True)
    return rows.withColumn(name, (F.col(name) + F.lit(seen)).cast("long")), seen + total


def slot(seed: int, number: F.Column, buffer: int) -> F.Column:
    """The buffer slot that arrival ``number`` goes to: itself while the buffer fills, then a seeded hash."""
    mixed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), number.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.when(number < buffer, number).otherwise(mixed % buffer).cast("long")


def shuffle_take_stream(stream: DataFrame, n: int | None, order_by: list[str], sink_path: str, checkpoint_location: str,
                        seed: int = 42, buffer: int = 1000) -> None:
    """STM-3 / TOP-5: a buffered shuffle of the whole stream, and its first ``n`` rows in all.

    A buffer of ``buffer`` slots fills with the first rows.  Every later row goes to
    the slot that a hash of its number names and drives out the row that stood
    there, which is the next one given out; at the end of the source the rows still
    held follow in the order of a seeded hash.  As a window: a row is given out when
    the next row of its slot arrives, so a batch is one window per slot over the held
    and the new rows, never a loop.  Once ``n`` rows are out, later batches are not
    read.  The sink gets the rows with their place ``take_no`` (from 0).
    """
    limit = (1 << 62) if n is None else n

    def step(batch, held, counts):
        if counts.get("out", 0) >= limit:
            return None, held, counts
        rows, seen = _numbered(batch, order_by, counts.get("seen", 0), "_no")
        both = rows if held is None else held.unionByName(rows)
        both = both.withColumn("_slot", slot(seed, F.col("_no"), buffer))
        turn = Window.partitionBy("_slot").orderBy("_no")
        both = both.withColumn("_next", F.lead("_no").over(turn)).drop("_slot")
        out = (both.where(F.col("_next").isNotNull()).withColumn("take_no", F.col("_next") - buffer)
               .where(F.col("take_no") < limit).drop("_no", "_next"))
        done = min(max(seen - buffer, 0), limit)
        return out, both.where(F.col("_next").isNull()).drop("_next"), {"seen": seen, "out": done}

    def finish(held, counts):
        left = limit - counts.get("out", 0)
        if held is None or left <= 0:
            return None
        # at most ``buffer`` rows: one ordered window over them
        mixed = F.md5(F.concat(F.lit(f"{seed}:end:"), F.col("_no").cast("string")))
        ranked = held.withColumn("_rank", F.row_number().over(Window.orderBy(mixed, "_no")) - 1)
        return (ranked.where(F.col("_rank") < left)
                .withColumn("take_no", (F.col("_rank") + counts.get("out", 0)).cast("long")).drop("_no", "_rank"))

    drain(stream, step, finish, sink_path, checkpoint_location)


def pack_stream(stream: DataFrame, ids_col: str, order_col: str, block_size: int, sink_path: str, checkpoint_location: str,
                batch_rows: int = 1000) -> None:
    """STM-2: packing in batches of ``batch_rows`` rows that go on across micro-batches.

    The open batch (fewer than ``batch_rows`` rows) is carried; complete batches are
    packed as ``pack_blocks`` does.  Rows are numbered in arrival order, so the sink
    equals the batch operator's result whatever ``maxFilesPerTrigger`` is, provided
    that files arrive in the order of ``order_col``.
    """
    def packed(rows: DataFrame, first_batch: int) -> DataFrame:
        out = pack_blocks(rows.select("_no", ids_col), block_size, "_no", ids_col, batch_rows)
        return out.withColumn("batch", F.col("batch") + F.lit(first_batch).cast("long"))

    def step(batch, held, counts):
        rows, seen = _numbered(batch.select(order_col, ids_col), [order_col], counts.get("seen", 0), "_no")
        both = rows if held is None else held.unionByName(rows)
        first, closed = counts.get("closed", 0), seen // batch_rows
        out = packed(both.where(F.col("_no") < closed * batch_rows), first) if closed > first else None
        return out, both.where(F.col("_no") >= closed * batch_rows), {"seen": seen, "closed": closed}

    def finish(held, counts):
        return None if held is None or held.isEmpty() else packed(held, counts["closed"])

    drain(stream, step, finish, sink_path, checkpoint_location)


def interleave_streams(streams: list[DataFrame], order_by: list[str], sink_path: str, checkpoint_location: str) -> None:
    """STM-4: round-robin over the sources in list order, ended by the first that is exhausted.

    Row j of source i is row ``j * len(streams) + i`` of the result, in column
    ``pos``.  Complete rounds are given out as soon as every source has reached them;
    a source that runs ahead waits in the state.  What is left when the shortest
    source has ended belongs to no complete round and is never given out.
    """
    k = len(streams)
    union = None
    for i, s in enumerate(streams):
        tagged = s.withColumn("_source", F.lit(i))
        union = tagged if union is None else union.unionByName(tagged, allowMissingColumns=True)

    def step(batch, held, counts):
        ranked = with_position(batch, order_by, partition_by=["_source"], pos_col="_no", size_col="_n")
        sizes = dict(ranked.where("_no = 0").select("_source", "_n").collect())     # one row a source
        seen = {i: counts.get(f"seen{i}", 0) for i in range(k)}
        offset = F.element_at(F.array(*[F.lit(seen[i]).cast("long") for i in range(k)]), F.col("_source") + 1)
        rows = ranked.withColumn("_no", (F.col("_no") + offset).cast("long")).drop("_n")
        both = rows if held is None else held.unionByName(rows)
        seen = {i: seen[i] + int(sizes.get(i, 0)) for i in range(k)}
        rounds = min(seen.values())
        out = (both.where(F.col("_no") < rounds).withColumn("pos", F.col("_no") * k + F.col("_source"))
               .drop("_no", "_source"))
        return out, both.where(F.col("_no") >= rounds), {f"seen{i}": seen[i] for i in range(k)}

    drain(union, step, lambda held, counts: None, sink_path, checkpoint_location)
