"""Structured Streaming: file source -> cleanse + dedup -> sink; steps with state over many micro-batches."""

import datetime as dt
import hashlib
import os
import shutil

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from corpusmill.operators.trainset import pack_blocks
from corpusmill.streaming import stateful as SF
from corpusmill.streaming import streams as ST


def test_cleanse_stream_dedups(spark, tmp_path):
    src = tmp_path / "src"
    rows = [(1, "  hello  ", dt.datetime(2024, 1, 1, 0, 0)), (2, "hello", dt.datetime(2024, 1, 1, 0, 1)),
            (3, "mail a@b.io", dt.datetime(2024, 1, 1, 0, 2)), (4, "world", dt.datetime(2024, 1, 1, 0, 3))]
    df = spark.createDataFrame(rows, "id long, text string, ts timestamp")
    df.coalesce(1).write.parquet(str(src / "a"))
    df.coalesce(1).write.parquet(str(src / "b"))       # a second file repeating every text
    stream = ST.read_stream(spark, str(src / "*"), df.schema, max_files_per_trigger=1)
    out = ST.cleanse_stream(stream, "text", event_time_col="ts", watermark="1 hour").select("text")
    q = ST.write_stream(out, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    got = sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == ["hello", "world"]


def files(spark, path, rows, schema, parts):
    """``rows`` in ``parts`` files whose ages follow the rows; returns a starter of their stream."""
    size = -(-len(rows) // parts)
    path.mkdir(exist_ok=True)
    old = len(list(path.glob("*.parquet")))
    for k in range(0, len(rows), size):
        df = spark.createDataFrame(rows[k:k + size], schema).coalesce(1)
        df.write.parquet(str(path / "one"))
        name = path / f"f{old + k // size:03}.parquet"
        next((path / "one").glob("part-*.parquet")).rename(name)
        shutil.rmtree(path / "one")
        os.utime(name, (1_600_000_000 + old + k // size,) * 2)
    return lambda: ST.read_stream(spark, str(path), df.schema, max_files_per_trigger=1, glob="f*.parquet")


def buffered(n_rows, n, seed, size):
    """A shuffle buffer as a loop: the numbers in the order in which they come out."""
    md5 = lambda x: hashlib.md5(f"{seed}:{x}".encode()).hexdigest()
    held, out = {}, []
    for no in range(n_rows):
        at = no if no < size else int(md5(no)[:8], 16) % size
        if at in held:
            out.append(held[at])
        held[at] = no
    out += sorted(held.values(), key=lambda no: (md5(f"end:{no}"), no))
    return out[:n]


SHUFFLED = "take_no long, doc_id long, text string"


def test_shuffle_and_take_over_many_micro_batches(spark, tmp_path):
    rows = [(i, f"t{i}") for i in range(200)]
    for n, size in ((50, 30), (190, 1000)):
        base = tmp_path / f"{n}-{size}"
        start = files(spark, tmp_path / f"src{n}{size}", rows, "doc_id long, text string", 4)
        SF.shuffle_take_stream(start(), n, ["doc_id"], f"{base}/out", f"{base}/ck", 7, size)
        got = sorted(tuple(r) for r in SF.read_sink(spark, f"{base}/out", SHUFFLED).collect())
        want = buffered(200, n if n else 200, 7, size)
        assert [r[1] for r in got] == want and [r[0] for r in got] == list(range(len(want)))
        assert all(r[2] == f"t{r[1]}" for r in got)


def test_a_shuffle_goes_on_after_a_restart_and_more_files(spark, tmp_path):
    rows = [(i, f"t{i}") for i in range(160)]
    src, out, ck = tmp_path / "src", f"{tmp_path}/out", f"{tmp_path}/ck"
    for part in (rows[:90], rows[90:]):
        SF.shuffle_take_stream(files(spark, src, part, "doc_id long, text string", 2)(), 120, ["doc_id"], out, ck, 3, 20)
        seen = part[-1][0] + 1
        got = sorted(tuple(r) for r in SF.read_sink(spark, out, SHUFFLED).collect())
        assert [r[1] for r in got] == buffered(seen, 120, 3, 20)


def test_an_epoch_that_fails_and_runs_again_leaves_its_rows_once(spark, tmp_path):
    start = files(spark, tmp_path / "src", [(i, "x") for i in range(40)], "doc_id long, text string", 4)
    out, ck, runs = f"{tmp_path}/out", f"{tmp_path}/ck", []

    def step(batch, held, counts):
        runs.append(counts.get("seen", 0))
        n = batch.count()
        if len(runs) == 3:
            batch.write.parquet(f"{out}/epoch=2")       # half done, then lost
            raise RuntimeError("executor lost")
        return batch.withColumn("seen", F.lit(counts.get("seen", 0))), batch, {"seen": counts.get("seen", 0) + n}

    for _ in range(2):
        try:
            SF.drain(start(), step, lambda held, counts: None, out, ck)
        except StreamingQueryException:
            pass
    got = spark.read.parquet(out)
    assert runs == [0, 10, 20, 20, 30]
    assert sorted((r.doc_id, r.seen) for r in got.collect()) == [(i, i // 10 * 10) for i in range(40)]


def test_packing_does_not_depend_on_file_borders(spark, tmp_path):
    rows = [(i, list(range(i, i + i % 4))) for i in range(50)]
    schema = "doc_id long, ids array<long>"
    want = sorted((r.batch, r.block, list(r.input_ids))
                  for r in pack_blocks(spark.createDataFrame(rows, schema), 4, "doc_id", "ids", 8).collect())
    for parts in (1, 5):
        start = files(spark, tmp_path / f"src{parts}", rows, schema, parts)
        SF.pack_stream(start(), "ids", "doc_id", 4, f"{tmp_path}/o{parts}", f"{tmp_path}/c{parts}", 8)
        got = SF.read_sink(spark, f"{tmp_path}/o{parts}", "batch long, block long, input_ids array<long>")
        assert sorted((r.batch, r.block, list(r.input_ids)) for r in got.collect()) == want


def test_interleaved_streams_take_turns(spark, tmp_path):
    sizes = {"a": (23, 2), "b": (9, 3), "c": (15, 1)}
    starts = {k: files(spark, tmp_path / k, [(i, k) for i in range(n)], "doc_id long, text string", p) for k, (n, p) in sizes.items()}
    SF.interleave_streams([s() for s in starts.values()], ["doc_id"], f"{tmp_path}/o", f"{tmp_path}/c")
    got = sorted(tuple(r) for r in SF.read_sink(spark, f"{tmp_path}/o", "pos long, doc_id long, text string").collect())
    assert got == [(3 * j + i, j, k) for j in range(9) for i, k in enumerate("abc")]


def test_union_of_streams_and_a_hook(spark, tmp_path):
    for name in ("a", "b"):
        spark.createDataFrame([(1, name)], "doc_id long, text string").write.parquet(str(tmp_path / name))
    schema = spark.read.parquet(str(tmp_path / "a")).schema
    both = ST.union_streams(*[ST.read_stream(spark, str(tmp_path / n), schema) for n in ("a", "b")])
    ST.per_batch_stream(both, lambda b: b.selectExpr("upper(text) AS text"), str(tmp_path / "o"),
                        str(tmp_path / "c")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["A", "B"]
