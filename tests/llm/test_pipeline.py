"""The pipeline's stages, one after the other, on documents with planted cases."""
import random

import pytest

import __spark_entry__ as E
import corpus_pipeline as P

from .util import words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    rnd = random.Random(11)
    rows, labels = [], []
    passage = " ".join(words(rnd, 40))
    base = [" ".join(words(rnd, 500)) for _ in range(4)]
    shared = "a shared line of rather more than eight words that repeats in many documents"
    for i in range(400):
        text = "\n".join(" ".join(words(rnd, rnd.randrange(15, 40))) + "." for _ in range(rnd.randrange(1, 5)))
        good = 1
        if i % 4 == 0:
            text, good = " ".join(w.upper() + "!!" for w in text.split()), 0
        elif i % 40 == 1:
            text += "\n" + shared
        elif i % 40 == 2:
            text += "\n" + " ".join(words(rnd, 9)) + " " + passage.upper() + " " + " ".join(words(rnd, 9))
        elif i % 40 == 3:
            near = base[i % 4].split()
            near[rnd.randrange(len(near))] = "zz"
            text = " ".join(near)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, good, 0))
    rows += [(900, None, "en", None, None), (901, "", None, "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(root / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root), dict((r[0], r[1]) for r in rows), passage, shared


def test_stages(spark, folder):
    root, texts, passage, shared = folder
    assert [f.__name__ for _, f in P.STAGES] == ["quality_stage", "line_dedup_stage", "near_dedup_stage",
                                                "decontamination_stage", "bpe_stage"]
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        out = P.cut(stage(spark, docs, root), name)
        if name != P.STAGES[-1][0]:
            assert out.columns == COLUMNS
            assert all(r.text is None or r.n_chars == len(r.text) for r in out.collect())
        kept[name] = {r["doc_id"]: r for r in out.collect()}
        docs = out
    good = {i for i in texts if i < 400 and i % 4}
    assert {i for i in kept["quality_classifier"] if i < 400} == good
    lines = kept["line_dedup"]
    assert set(lines) == set(kept["quality_classifier"])
    assert [i for i in sorted(lines) if shared in (lines[i].text or "")] == [1]       # only the first place stays
    near = {i for i in good if i % 40 == 3}
    assert near & set(kept["simhash_near_dedup"]) == {3} and good - near <= set(kept["simhash_near_dedup"])
    clean = kept["decontamination"]
    assert set(clean) == set(kept["simhash_near_dedup"])
    for i, r in clean.items():
        before = kept["simhash_near_dedup"][i].text
        if i in good and i % 40 == 2:
            assert passage.lower() not in r.text.lower() and len(before) - len(r.text) == len(passage)
        else:
            assert r.text == before
    last = kept["byte_bpe"]
    assert set(last) == set(clean) and all(len(r.ids) == r.n_tokens for r in last.values())


def test_run_is_the_registered_query(spark, folder):
    out = E.queries()["pipeline"](spark, folder[0])
    assert out.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 200


def test_stages_on_empty_documents(spark, folder):
    empty = spark.read.parquet(f"{folder[0]}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        assert stage(spark, empty, folder[0]).count() == 0


def test_all_ten_operators_are_registered():
    names = E.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
