"""Readers/writers and the driver contract."""

import json
import os
import tempfile

import duckdb

import __spark_entry__ as E
from corpusmill.sources import readers, writers
from corpusmill.sources.tables import TABLES


def test_json_roundtrip(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "in.json")
    with open(p, "w") as f:
        json.dump([{"key": "value"}, {"nested": {"key": "value"}}, {}], f)
    df = readers.read_json_array(spark, p)
    assert df.count() == 3 and set(df.columns) == {"key", "nested"}
    writers.write_jsonl(df, os.path.join(d, "out"))
    assert readers.read_jsonl(spark, os.path.join(d, "out")).count() == 3


def test_token_list_and_word_list(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "t.json")
    with open(p, "w") as f:
        json.dump(["item1", "item2"], f)
    assert [r.token for r in readers.read_token_list(spark, p).orderBy("pos").collect()] == ["item1", "item2"]
    w = os.path.join(d, "w.txt")
    with open(w, "w") as f:
        f.write("a\n\n b \n")
    assert [r.word for r in readers.read_word_list(spark, w).collect()] == ["a", "b"]


def test_entry_runs(spark):
    out = E.entry(spark)
    assert set(out.columns) == {"split", "lang", "n"} and out.count() > 0


def test_registered_queries_have_oracles():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80


def test_some_oracles_at_smallest_scale(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in ["cleanse_full", "split_stratified", "bm25_topk", "pack_blocks", "uniformity", "flagship"]:
        df = E.queries()[name](spark, sf)
        got = sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
        res = con.execute(E.oracle_sql()[name])
        cols = [x[0] for x in res.description]
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        exp = sorted(tuple(row[i] for i in order) for row in res.fetchall())
        assert len(got) == len(exp), name
        assert [tuple(list(v) if isinstance(v, (list, tuple)) else v for v in r) for r in got] == \
               [tuple(list(v) if isinstance(v, (list, tuple)) else v for v in r) for r in exp], name
