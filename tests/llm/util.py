"""Shared small inputs of the operator tests."""
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string, id string"


def docs(spark, rows):
    """Rows (doc_id, text) with extra columns whose names clash with derived ones."""
    full = [(i, t, "en", "s", None if t is None else len(t), 0.5, "x", "y") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rnd: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return ["w" + "abcdefghij"[rnd.randrange(10)] + str(rnd.randrange(vocabulary)) for _ in range(n)]


def collect(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]
