"""VOC-3 (bpe): merges learnt in rounds, with pair counts that are updated and never counted anew.

The distinct units of the corpus (a Spark aggregate) become blocks of symbol numbers.
The most frequent pairs, all above some count, stand in a *watch list* on the driver.
A round merges many pairs at once, and the tasks report how the counts of the pairs
around them change: only units that hold a merged pair are touched.  The changes are
summed in Spark and applied to the watch list; when it runs low, all pairs are counted
once more and it is filled again, with lower counts.

**Which pairs may be merged together.**  The order of merging is that of the trainer
that the reference calls: the more frequent pair first, of equals the shorter joint,
then the smaller one; a pair whose joint is a symbol already is never merged.  A pair
that arises from a merge is at most as frequent as one that it grew from, and longer,
so it always comes later in this order.  Hence a pair that comes before all pairs
sharing a symbol with it keeps its count until its turn, and merging it early changes
nothing that comes before its turn.  It only has to wait for earlier pairs whose joint
is part of its own, which could lead to the same joint on another way (``ready``).
Sorted by that order, the merges of all rounds are those of merging one by one; tests
hold this against a plain trainer.

A round costs one pass over the blocks, which stay cached and are written every
``KEEP`` rounds, so that lineage stays short and a lost executor costs at most that
many rounds.  The driver holds the watch list and the merges, both bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release, ship_package
from . import subword

#: Pairs of a full watch list; rounds between writing the blocks.
WATCHED, KEEP = 20_000, 16

#: Marks between units: also a character that is not in the alphabet.
GAP = -1


def encoded(tokens: list[str], letters: list[str]) -> np.ndarray:
    """The units as symbol numbers, a gap after each; characters out of the alphabet are gaps too."""
    codes = np.frombuffer("".join([t + "\0" for t in tokens]).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.array([ord(c) for c in letters], np.uint32)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where((known[at] == codes) & (codes != 0), at, GAP).astype(np.int32)


def pair_totals(symbols: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair keys, counts) of all neighbours; ``weights`` is the count of every position's unit."""
    real = (symbols[:-1] >= 0) & (symbols[1:] >= 0)
    return totals((symbols[:-1][real].astype(np.int64) << 32) | symbols[1:][real], weights[:-1][real])


def totals(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, without those that come to nothing."""
    if not len(keys):
        return keys.astype(np.int64), values.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sums = np.add.reduceat(values, start)
    return keys[start][sums != 0], sums[sums != 0]


def merged(symbols: np.ndarray, weights: np.ndarray, partner: np.ndarray, joint: np.ndarray):
    """(symbols, weights, pair keys, changes) after merging every symbol with its partner where that follows.

    The last entry of ``partner`` stands for the gap.  A pair of equal symbols is merged from the left.
    """
    p = np.flatnonzero(partner[symbols[:-1]] == symbols[1:])
    if not len(p):
        return symbols, weights, np.zeros(0, np.int64), np.zeros(0, np.int64)
    chained = np.append(False, p[1:] == p[:-1] + 1)
    if chained.any():
        spot = np.arange(len(p))
        p = p[(spot - np.maximum.accumulate(np.where(chained, 0, spot))) % 2 == 0]
    unit = np.cumsum(np.append(0, symbols[:-1] == GAP))
    touched = np.zeros(unit[-1] + 1, bool)
    touched[unit[p]] = True
    some = touched[unit]
    keys, n = pair_totals(symbols[some], weights[some])     # every part ends in a gap
    fresh = symbols.copy()
    fresh[p] = joint[symbols[p]]
    stays = np.ones(len(symbols), bool)
    stays[p + 1] = False
    fresh, weights, some = fresh[stays], weights[stays], some[stays]
    more, m = pair_totals(fresh[some], weights[some])
    return fresh, weights, *totals(np.concatenate([keys, more]), np.concatenate([-n, m]))


def order_of(count: int, left: str, right: str) -> tuple:
    """The place of a pair in the order of merging."""
    return -count, len(left) + len(right), left + right, left


def ready(ranked: list[tuple]) -> list[tuple]:
    """Of pairs (order, left, right) in order those that can be merged now (see the module's docstring)."""
    out, seen, joints = [], set(), set()
    for order, left, right in ranked:
        whole = order[2]
        if left not in seen and right not in seen and not any(
                whole[i:j] in joints for i in range(len(whole) - 1) for j in range(i + 2, len(whole) + 1)):
            out.append((order, left, right))
        seen.update((left, right))
        joints.add(whole)
    return out


_BLOCK = "symbols binary, weights binary"
_CHANGES = "keys binary, changes binary"


def _blocks(counts: DataFrame, letters: list[str]) -> DataFrame:
    def work(batches):
        for b in batches:
            tokens = b.column(0).to_pylist()
            if not tokens:
                continue
            numbers = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            symbols = encoded(tokens, letters)
            weights = np.repeat(numbers, [len(t) + 1 for t in tokens])
            # gaps inside a unit split it, which no merge ever notices
            yield pa.RecordBatch.from_arrays([pa.array([symbols.tobytes()], pa.binary()),
                                              pa.array([weights.tobytes()], pa.binary())], ["symbols", "weights"])

    return materialize(counts.select("token", "n").mapInArrow(work, _BLOCK), "blocks")


def _arrays(batches):
    for b in batches:
        for symbols, weights in zip(b.column(0), b.column(1)):
            yield np.frombuffer(symbols.as_py(), np.int32), np.frombuffer(weights.as_py(), np.int64)


def _apply(blocks: DataFrame, partner: np.ndarray, joint: np.ndarray) -> DataFrame:
    """The blocks after a round, with the changes of the pair counts."""
    def work(batches):
        for symbols, weights in _arrays(batches):
            done = merged(symbols, weights, partner, joint)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in done],
                                             ["symbols", "weights", "keys", "changes"])

    return blocks.select("symbols", "weights").mapInArrow(work, f"{_BLOCK}, {_CHANGES}")


def _summed(parts: DataFrame) -> DataFrame:
    """(key, n): the sums of ``keys`` and ``changes`` over all blocks."""
    def work(batches):
        for b in batches:
            keys = [np.frombuffer(x.as_py(), np.int64) for x in b.column(0)]
            values = [np.frombuffer(x.as_py(), np.int64) for x in b.column(1)]
            if keys:
                sums = totals(np.concatenate(keys), np.concatenate(values))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums], ["key", "n"])

    return parts.select("keys", "changes").mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _counted(blocks: DataFrame) -> DataFrame:
    """(key, n) of all pairs."""
    def work(batches):
        for symbols, weights in _arrays(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in pair_totals(symbols, weights)],
                                             ["keys", "changes"])

    return _summed(blocks.select("symbols", "weights").mapInArrow(work, _CHANGES))


def learn(counts: DataFrame, letters: list[str], num_merges: int) -> list[tuple[str, str, int]]:
    """The first ``num_merges`` merges (left, right, count) over the units ``(token, n)``."""
    if not letters or num_merges <= 0:
        return []
    names, ids = list(letters), {c: i for i, c in enumerate(letters)}
    merges: list[tuple] = []
    base = blocks = _blocks(counts, letters)
    cached: list[DataFrame] = []
    watch: dict[int, int] = {}
    floor: int | None = None       # every pair that is more frequent is watched

    def joint_of(key: int) -> str:
        return names[key >> 32] + names[key & 0xFFFFFFFF]

    while True:
        last = sorted(m[0] for m in merges)[num_merges - 1] if len(merges) >= num_merges else None
        ranked = []
        for key, n in watch.items():
            left, right = names[key >> 32], names[key & 0xFFFFFFFF]
            order = order_of(n, left, right)
            if left + right not in ids and (last is None or order < last):
                ranked.append((order, left, right))
        if not ranked:
            if floor == 0 or (last is not None and floor < -last[0]):
                break
            watched = WATCHED
            while True:     # fill the watch list; a count is watched with all its pairs or not at all
                fresh = [r for r in _counted(blocks).orderBy(F.col("n").desc()).limit(watched + 1).collect()]
                floor = fresh[-1]["n"] if len(fresh) > watched else 0
                watch = {r["key"]: r["n"] for r in fresh if r["n"] > floor}
                if floor == 0 or any(joint_of(k) not in ids for k in watch):
                    break
                watched *= 4
            continue
        ranked.sort()
        partner, joint, made = np.full(len(names) + 1, -5, np.int32), np.zeros(len(names) + 1, np.int32), {}
        for order, left, right in ready(ranked):
            merges.append((order, left, right))
            made[left + right] = len(names) + len(made)
            partner[ids[left]], joint[ids[left]] = ids[right], made[left + right]
        first_new = len(names)
        names += made
        ids.update(made)
        blocks = _apply(blocks, partner, joint).persist()
        cached.append(blocks)
        # pairs that fall, and new ones that are frequent enough to be watched
        changes = _summed(blocks).where((F.col("n") < 0) | (F.col("n") > floor))
        for r in changes.collect():
            key = r["key"]
            if key in watch or max(key >> 32, key & 0xFFFFFFFF) >= first_new:
                n = watch.get(key, 0) + r["n"]
                if n > floor:
                    watch[key] = n
                else:
                    watch.pop(key, None)
        if len(cached) >= KEEP:
            fresh_base = materialize(blocks.select("symbols", "weights"), "blocks")
            for frame in cached:
                frame.unpersist()
            release(base)
            base, blocks, cached = fresh_base, fresh_base, []
    for frame in cached:
        frame.unpersist()
    release(base)
    merges.sort()
    return [(left, right, -order[0]) for order, left, right in merges[:num_merges]]


def train(counts: DataFrame, letters: list[str], num_merges: int) -> DataFrame:
    """(rank, left, right, freq): the merges as a table."""
    ship_package(counts.sparkSession)
    rows = [(i, *m) for i, m in enumerate(learn(counts, letters, num_merges))]
    return counts.sparkSession.createDataFrame(rows, "rank int, left string, right string, freq long")


def bpe_merges(df: DataFrame, text_col: str, num_merges: int, split_digits: bool = True,
               character_coverage: float = 1.0) -> DataFrame:
    """VOC-3 (bpe): the merges (rank, left, right, freq) over the units of all texts, learnt at once."""
    counts = materialize(subword.unit_counts(df, text_col, split_digits), "units")
    letters = subword.alphabet(counts, character_coverage)
    out = train(counts, letters, num_merges)
    release(counts)
    return out


def bpe_vocab(df: DataFrame, text_col: str, vocab_size: int = 30_000, special_tokens: list[str] | None = None,
              byte_fallback: bool = True, split_digits: bool = True, character_coverage: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(vocabulary (piece, id, kind, score), merges): first pieces, characters, then merged pieces up to ``vocab_size``.

    The score of a merged piece is minus its rank, that of a character is below all of them.
    """
    counts = materialize(subword.unit_counts(df, text_col, split_digits), "units")
    letters = subword.alphabet(counts, character_coverage)
    first = subword.first_pieces(special_tokens, byte_fallback)
    room = vocab_size - len(first) - len(letters)
    if room < 0:
        raise ValueError(f"{len(first) + len(letters)} symbols and characters do not fit a vocabulary of {vocab_size}; "
                         "lower character_coverage")
    merges = train(counts, letters, room)
    release(counts)
    # bounded by vocab_size
    learnt = dict.fromkeys(r["left"] + r["right"] for r in merges.orderBy("rank").collect())
    rows = [(p, kind, 0.0) for p, kind in first] + [(p, "normal", float(-i)) for i, p in enumerate(learnt)]
    rows += [(c, "normal", float(-len(learnt) - i)) for i, c in enumerate(letters) if c not in learnt]
    table = [(p, i, kind, score) for i, (p, kind, score) in enumerate(rows)]
    return df.sparkSession.createDataFrame(table, "piece string, id int, kind string, score double"), merges
