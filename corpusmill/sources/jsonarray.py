"""JSON files that hold one array, read and written by many tasks.

A text source that ends its lines at commas splits a file of any size at byte ranges and
hands out the *fragments* between commas.  Whether a comma separates two items of the
outer array depends on everything before it: on whether a string is open, and on how
many brackets are.  Both are a running state, so

1. a first pass sums up every byte range under both assumptions (a string is open at its
   start, or none): is one open at its end, and how many brackets more are;
2. the driver chains these few numbers per range into the state at each start;
3. a second pass cuts every range into whole items; what stands before its first and
   after its last separator are parts of items that reach over the border of ranges,
   put together by one small aggregate.

An escape never reaches over a comma, since JSON knows no escaped comma.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, ship_package

_SIGNS = re.compile(r'\\.|["{}\[\]]', re.S)


def scan(fragment: str, inside: bool, depth: int) -> tuple[bool, int]:
    """(a string is open, open brackets) behind a fragment."""
    for m in _SIGNS.finditer(fragment):
        sign = m.group()
        if sign == '"':
            inside = not inside
        elif not inside:
            if sign in "{[":
                depth += 1
            elif sign in "}]":
                depth -= 1
    return inside, depth


def _runs(batches):
    """(file, block, its fragments in order), one after the other."""
    key, held = None, []
    for b in batches:
        for value, file, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if key is not None and key != (file, block):
                yield *key, held
                held = []
            key = file, block
            held.append(value)
    if key is not None:
        yield *key, held


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", ",").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def array_items(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, number, item): the items of every file's array as JSON texts; the first three give their order."""
    ship_package(spark)
    fragments = _fragments(spark, path)

    def sum_up(batches):
        for file, block, held in _runs(batches):
            closed, opened = (False, 0), (True, 0)
            for fragment in held:
                closed, opened = scan(fragment, *closed), scan(fragment, *opened)
            yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "closed": [closed[0]], "closed_by": [closed[1]],
                                              "opened": [opened[0]], "opened_by": [opened[1]]})

    states: dict[tuple[str, int], tuple[bool, int, bool]] = {}
    ranges = fragments.mapInArrow(sum_up, "file string, block long, closed boolean, closed_by long, opened boolean, "
                                          "opened_by long").orderBy("file", "block").collect()     # a row a byte range
    file, inside, depth = None, False, 0
    for k, r in enumerate(ranges):
        if r["file"] != file:
            file, inside, depth = r["file"], False, 0
        last = k + 1 == len(ranges) or ranges[k + 1]["file"] != file
        states[file, r["block"]] = inside, depth, last
        inside, depth = (r["opened"], depth + r["opened_by"]) if inside else (r["closed"], depth + r["closed_by"])

    def cut(batches):
        for file, block, held in _runs(batches):
            inside, depth, last = states[file, block]
            texts, parts = [], []
            for k, fragment in enumerate(held):
                inside, depth = scan(fragment, inside, depth)
                parts.append(fragment)
                # the last fragment of a range has its comma too, unless the file ends there
                if not inside and depth == 1 and not (last and k + 1 == len(held)):
                    texts.append(",".join(parts))
                    parts = []
            ends = bool(texts)
            texts.append(",".join(parts) + ("" if last or not parts else ","))
            n = len(texts)
            yield pa.RecordBatch.from_pydict(
                {"file": [file] * n, "block": pa.array([block] * n, pa.int64()), "number": pa.array(range(n), pa.int64()),
                 "first": [k == 0 for k in range(n)], "rest": [k == n - 1 for k in range(n)], "ends": [ends] * n, "text": texts})

    rows = materialize(fragments.mapInArrow(cut, "file string, block long, number long, first boolean, rest boolean, "
                                                 "ends boolean, text string"), "array")
    # the rest of a range belongs to the item that goes on in the next ones: count the separators before it
    whole = rows.where(~F.col("first") & ~F.col("rest")).select("file", "block", F.col("number"), "text")
    starts: dict[tuple[str, int], tuple[int, int]] = {}
    file, open_at = None, (0, 0)
    closing = {(r["file"], r["block"]): r["ends"] for r in rows.where("first").select("file", "block", "ends").collect()}
    for f, block in sorted(closing):
        if f != file:
            file, open_at = f, (block, -1)
        starts[f, block] = open_at
        if closing[f, block]:
            open_at = (block, 1 << 40)
    owner = spark.createDataFrame([(f, b, *at) for (f, b), at in starts.items()],
                                  "file string, block long, to_block long, to_number long")
    edges = rows.where("first OR rest").join(F.broadcast(owner), ["file", "block"])
    # a range without a separator is one part, first and rest at once
    to_block = F.when(F.col("first"), F.col("to_block")).otherwise(F.col("block"))
    to_number = F.when(F.col("first"), F.col("to_number")).otherwise(F.lit(1 << 40))
    joined = (edges.select("file", to_block.alias("b"), to_number.alias("n"), F.struct("block", "number", "text").alias("part"))
              .groupBy("file", "b", "n").agg(F.array_sort(F.collect_list("part")).alias("parts"))
              .select("file", F.col("b").alias("block"), F.col("n").alias("number"),
                      F.array_join("parts.text", "").alias("text")))
    blanks = r"[ \t\r\n]*"
    text = F.regexp_replace(F.col("text"), f"^{blanks}|{blanks}$", "")
    opening = F.col("number") == -1
    text = F.when(opening, F.regexp_replace(text, rf"^\uFEFF?{blanks}\[{blanks}", "")).otherwise(text)
    closed = joined.groupBy("file").agg(F.max(F.struct("block", "number")).alias("end"))
    tail = joined.join(closed, "file").withColumn("closing", F.struct("block", "number") == F.col("end")).drop("end")
    items = whole.withColumn("closing", F.lit(False)).unionByName(tail).withColumn("text", text)
    item = F.when(F.col("closing"), F.regexp_replace("text", rf"{blanks}\]$", "")).otherwise(F.col("text"))
    return items.select("file", "block", "number", item.alias("item")).where("item <> ''")


def write_array(df: DataFrame, path: str, order_by: list[str], parts: int | None = None, strings: bool = False) -> None:
    """SNK-1: one file that holds the rows as one JSON array, in order: objects, or with ``strings`` the only column's texts.

    Range-partitioned tasks write their items, each followed by a comma; the commit
    puts the parts end to end between brackets, as a stream of bytes.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = path.rstrip("/") + ".parts"
    columns = [F.col(f"`{c}`") for c in df.columns]
    if strings:     # an array of one text, without its brackets
        item = F.expr("substring(_j, 2, length(_j) - 2)")
        source = F.to_json(F.array(columns[0]))
    else:
        item, source = F.col("_j"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    items = (df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by).select(source.alias("_j"))
             .select(item.alias("value")))
    items.write.mode("overwrite").option("lineSep", ",\n").text(base)
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    listed = [f for f in fs.listStatus(hadoop(base)) if f.getPath().getName().startswith("part-") and f.getLen() > 0]
    listed.sort(key=lambda f: f.getPath().getName())
    out = fs.create(hadoop(path), True)
    try:
        out.write(bytearray(b"[\n"))
        for k, f in enumerate(listed):
            length = f.getLen() - (2 if k + 1 == len(listed) else 0)     # without the comma after the last item
            source = fs.open(f.getPath())
            try:
                jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, length)
            finally:
                source.close()
        out.write(bytearray(b"\n]\n"))
    finally:
        out.close()
    fs.delete(hadoop(base), True)
