"""JSON arrays in byte ranges, lazy reads that stop early, and the row account of a cleansing run."""

import json
import random

from pyspark.sql import functions as F

from corpusmill.plans.cleanse import RowAccount, cleanse
from corpusmill.sources import jsonarray as J
from corpusmill.sources import lazy as L
from corpusmill.sources import readers as RD


def odd_items(rnd, n):
    texts = ["plain", 'quo"te, "and", more', "back\\slash\\", "a,,b],[", "{not, an] object", "ünï, 日本", "", "\\\\,", "line\nbreak,\t"]
    return [{"id": i, "t": rnd.choice(texts) * rnd.randrange(3), "l": [{"k": [rnd.random(), "x,]"]}] * rnd.randrange(3), "n": None}
            for i in range(n)]


def test_array_files_are_cut_at_item_borders_wherever_ranges_end(spark, tmp_path):
    items = odd_items(random.Random(1), 120)
    (tmp_path / "a.json").write_text(json.dumps(items, ensure_ascii=False, indent=4), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(items[:7]), encoding="utf-8")
    (tmp_path / "c.json").write_text(" [ ] ", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in (200, 1777, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = J.array_items(spark, str(tmp_path / "*.json")).orderBy("file", "block", "number").collect()
            assert [json.loads(r["item"]) for r in got] == items + items[:7]
            if size == 200:
                assert J._fragments(spark, str(tmp_path / "a.json")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    rows = RD.read_json_array(spark, str(tmp_path / "a.json"), pos_col="pos").orderBy("pos").collect()
    assert [(r["pos"], r["id"], r["t"]) for r in rows] == [(i, x["id"], x["t"]) for i, x in enumerate(items)]


def test_written_arrays_are_one_json_file_in_order(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else f't"{i},') for i in range(50)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(7)
    J.write_array(df, str(tmp_path / "out.json"), ["id"], 4)
    assert json.loads((tmp_path / "out.json").read_text()) == [{"id": i, "text": t} for i, t in rows]
    J.write_array(df.limit(0), str(tmp_path / "none.json"), ["id"], 3)
    assert json.loads((tmp_path / "none.json").read_text()) == []
    words = ["b,", "a]", 'c"', ""]
    tokens = spark.createDataFrame([(w,) for w in words], "w string")
    J.write_array(tokens, str(tmp_path / "words.json"), ["w"], strings=True)
    assert json.loads((tmp_path / "words.json").read_text()) == sorted(words)
    assert [tuple(r) for r in RD.read_token_list(spark, str(tmp_path / "words.json")).orderBy("pos").collect()] == list(
        enumerate(sorted(words)))


def test_a_lazy_read_stops_early(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(3200).repartitionByRange(32, "id").sortWithinPartitions("id").write.parquet(path)
    some = L.first_rows(spark, path, 25, F.col("id") % 2 == 0)
    assert [r[0] for r in some.rows.orderBy("id").collect()] == list(range(0, 50, 2))
    assert some.files == 32 and some.files_read == 1 and some.rows_read < 200
    more = L.first_rows(spark, path, 300, F.col("id") % 2 == 0)
    assert [r[0] for r in more.rows.orderBy("id").collect()] == list(range(0, 600, 2))
    assert more.files_read == 7 and more.rows_read < 1000
    raw = L.first_rows(spark, path, 130, F.col("id") % 2 == 0, count="raw")
    assert [r[0] for r in raw.rows.orderBy("id").collect()] == list(range(0, 130, 2)) and raw.files_read == 3
    whole = L.first_rows(spark, path, 10 ** 6)
    assert whole.rows.count() == 3200 == whole.rows_read and whole.files_read == 32
    assert L.first_rows(spark, path, 0).rows.count() == 0


def test_row_account(spark):
    rows = [(1, "one text"), (2, "one text"), (3, "mail a@b.io"), (4, "  "), (5, None), (6, "another")]
    account = RowAccount()
    out = cleanse(spark.createDataFrame(rows, "id long, text string"), "id", ["text"], account=account)
    assert sorted(r["id"] for r in out.collect()) == [1, 6]
    assert account.rows() == [(0, "read", 6), (1, "records", 5), (2, "duplicates of text", 4), (3, "rules", 2), (4, "saved", 2)]
