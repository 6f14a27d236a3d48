"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is split by the tokenizer's pattern; every piece is encoded separately.
For a piece of n bytes a segment tree over positions 0..n-1 holds, at each leaf,
the rank of the pair that starts there (or "none"), and at each inner node the
position of the **leftmost minimum** below it.  One merge reads the root, joins
the pair, and makes at most three point updates on live neighbours (the merged
position, the one before it, and the one that disappeared), each O(log n).  So
a piece costs O(n log n) however long it is: a megabyte without a space is fine.
The trees of short pieces stand side by side in one array and are updated
together (``Codec.merge_many``); a long piece has one of its own (``merge_piece``).

The chunks between single blanks repeat, so their ids are remembered per worker
process in two generations of a bounded size (``MEMO``): when the young one is
full it replaces the old one.  The memo only
saves time; ids never depend on it.

The vocabulary is read once on the driver from a path parameter and broadcast;
its size is bounded by the rank file (checked against ``MAX_VOCAB``).

Defined cases: a null or empty text has no ids and decodes to zero bytes;
decoded bytes always equal the text's UTF-8 bytes; special-token strings are
ordinary text; repeated rows, null ids and extra columns pass through; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from .common import read

#: Most entries a rank file may have: what is broadcast stays below about 100 MB.
MAX_VOCAB = 2_000_000
#: Remembered chunks per generation, and the longest one (in characters) that is remembered.
MEMO, MEMO_CHARS = 90_000, 48
#: Characters encoded together, and the longest piece (in bytes) whose tree stands in an array beside others.
BATCH_CHARS, LANES = 4_000_000, 64

_NONE = 1 << 62
_POS = 32  # a tree key is rank << 32 | position, so the smallest key is the leftmost minimum

# a blank between two visible characters always starts a match of the pattern, so texts split there safely
_ODD_BLANK, _SAFE_BLANK = re.compile(r" \s|\s "), re.compile(r"(?<!\s) (?!\s)")


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: base64 token, blank, rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    if len(ranks) > MAX_VOCAB:
        raise ValueError(f"{path}: more than {MAX_VOCAB} entries")
    return ranks


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: always merge the leftmost pair of the lowest rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 1).bit_length()
    get = ranks.get
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i:i + 2])
        if rank is not None:
            tree[size + i] = rank << _POS | i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    # end[i]: where the live token at i stops; before[i]: where the live token that stops at i starts
    end, before = list(range(1, n + 1)), list(range(-1, n))
    while tree[1] != _NONE:
        i = tree[1] & 0xFFFFFFFF
        j = end[i]          # the right half, which disappears
        stop = end[i] = end[j]
        before[stop] = i
        changed = [(j, None), (i, get(piece[i:end[stop]]) if stop < n else None)]
        if i:
            p = before[i]
            changed.append((p, get(piece[p:stop])))
        for pos, rank in changed:
            node = size + pos
            key = _NONE if rank is None else rank << _POS | pos
            while node and tree[node] != key:
                tree[node] = key
                node >>= 1
                if node:
                    a, b = tree[2 * node], tree[2 * node + 1]
                    key = a if a < b else b
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = end[i]
    return ids


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.width = max(self.tokens) + 1
        pairs = sorted((ranks[t[:i]] * self.width + ranks[t[i:]], r) for t, r in ranks.items()
                       for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.pair_keys = np.array([k for k, _ in pairs] + [1 << 62], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] + [0], np.int64)
        self.sizes = np.zeros(self.width, np.int64)
        for r, t in self.tokens.items():
            self.sizes[r] = len(t)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.tokens[r] for r in sorted(self.tokens)), np.uint8)
        self.young, self.old = {}, {}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the joined token, _NONE where the vocabulary has none."""
        key = left * self.width + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (int32 bytes) of each piece; one segment tree a piece, many trees side by side in one array."""
        out: list = [None] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for at, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None or len(piece) > LANES:
                out[at] = np.array([whole] if whole is not None else merge_piece(piece, self.ranks), np.int32).tobytes()
            elif piece:
                by_size.setdefault(1 << (len(piece) - 1).bit_length(), []).append(at)
            else:
                out[at] = b""
        for size, every in by_size.items():
            for lo in range(0, len(every), 2000):
                some = every[lo:lo + 2000]
                for at, ids in zip(some, self._trees([pieces[x] for x in some], size)):
                    out[at] = ids
        return out

    def _trees(self, pieces: list[bytes], size: int) -> list[bytes]:
        count, wide = len(pieces), size + 2  # columns: 0 is "before the first", then the positions, then "after the last"
        length = np.fromiter(map(len, pieces), np.int64, count)
        raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), np.uint8).reshape(count, size)
        token = np.zeros((count, wide), np.int64)
        token[:, 1:-1] = self.byte_ids[raw]
        column = np.arange(wide)
        after = np.broadcast_to(np.minimum(column + 1, wide - 1), (count, wide)).copy()
        after[np.arange(count), length] = wide - 1
        before = np.broadcast_to(np.maximum(column - 1, 0), (count, wide)).copy()
        tree = np.full((count, 2 * size), _NONE, np.int64)
        rank = self.pair_rank(token[:, 1:-2], token[:, 2:-1])
        real = (column[1:-2] < length[:, None]) & (rank != _NONE)
        tree[:, size:2 * size - 1] = np.where(real, rank << _POS | column[1:-2], _NONE)
        half = size
        while half > 1:  # inner nodes, level by level
            half >>= 1
            tree[:, half:2 * half] = np.minimum(tree[:, 2 * half:4 * half:2], tree[:, 2 * half + 1:4 * half:2])
        flat, token_, after_, before_ = tree.ravel(), token.ravel(), after.ravel(), before.ravel()
        live = np.arange(count)
        while True:
            root = flat[live * (2 * size) + 1]
            more = root != _NONE
            live, root = live[more], root[more]
            if not len(live):
                break
            row, node = live * wide, live * (2 * size) + size - 1
            i = root & 0xFFFFFFFF
            j = after_[row + i]      # the right half, which disappears
            k = after_[row + j]
            token_[row + i] = root >> _POS
            after_[row + i] = k
            before_[row + k] = i
            p = before_[row + i]
            right = np.where(k < wide - 1, self.pair_rank(token_[row + i], token_[row + k]), _NONE)
            left = np.where(p > 0, self.pair_rank(token_[row + p], token_[row + i]), _NONE)
            flat[node + j] = _NONE
            flat[node + i] = np.where(right != _NONE, right << _POS | i, _NONE)
            has = p > 0
            flat[(node + p)[has]] = np.where(left != _NONE, left << _POS | p, _NONE)[has]
            base, up = live * (2 * size), [size - 1 + j, size - 1 + i, size - 1 + np.maximum(p, 1)]
            half = size
            while half > 1:  # point updates: only the nodes above the three positions
                half >>= 1
                up = [x >> 1 for x in up]
                for x in up:
                    child = base + 2 * x
                    flat[base + x] = np.minimum(flat[child], flat[child + 1])
        seen = np.zeros((count, wide), bool)
        seen_ = seen.ravel()
        live, at = np.arange(count), np.ones(count, np.int64)
        while len(live):  # walk the live tokens
            seen_[live * wide + at] = True
            at = after_[live * wide + at]
            on = at < wide - 1
            live, at = live[on], at[on]
        ids = token[seen].astype(np.int32).tobytes()
        stop = np.cumsum(seen.sum(axis=1)) * 4
        return [ids[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        firsts, chunks = [], []
        for text in texts:
            first, *rest = _SAFE_BLANK.split(text) if _ODD_BLANK.search(text) else text.split(" ")
            firsts.append(self.find(first))
            chunks.append(rest)
        young = self.young
        if len(young) > MEMO:
            self.old, young = young, {}
            self.young = young
        fresh = set()
        for rest in chunks:
            fresh.update(rest)
        fresh.difference_update(young.keys())
        old, split = self.old, {}
        for chunk in fresh:
            got = old.get(chunk)
            if got is None:
                split[chunk] = self.find(" " + chunk)
            else:
                young[chunk] = got
        pieces = list({p for some in (*split.values(), *firsts) for p in some})
        ids = dict(zip(pieces, self.merge_many([p.encode("utf-8") for p in pieces])))
        long = [c for c in split if len(c) > MEMO_CHARS]
        young.update((c, b"".join([ids[p] for p in some])) for c, some in split.items())
        out = [np.frombuffer(b"".join([ids[p] for p in first]) + b"".join([young[c] for c in rest]), np.int32)
               for first, rest in zip(firsts, chunks)]
        for c in long:
            del young[c]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for, gathered from one blob of all tokens."""
        parts = []
        for lo in range(0, len(ids), 1 << 18):
            some = ids[lo:lo + (1 << 18)]
            size = self.sizes[some]
            stop = np.cumsum(size)
            parts.append(self.blob[np.arange(stop[-1]) + np.repeat(self.starts[some] - (stop - size), size)].tobytes())
        return b"".join(parts)


_WORKER: dict = {}


def _codec(broadcast, pattern: str) -> Codec:
    """One codec per worker process, kept between tasks."""
    ranks = broadcast.value
    if _WORKER.get("for") is not ranks or _WORKER["pattern"] != pattern:
        _WORKER.update({"for": ranks, "pattern": pattern, "codec": Codec(ranks, pattern)})
    return _WORKER["codec"]


def _arrays(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def encode_decode(docs: DataFrame, vocab_path: str, pattern: str, text_col: str = "text",
                  ids_col: str = "_cm_ids", bytes_col: str = "_cm_decoded") -> DataFrame:
    """Add the token ids (array<int>) of ``text_col`` and the bytes that those ids decode to.

    One narrow pass: no shuffle; every other column passes through untouched.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocab_path))

    def run(batches):
        codec = _codec(ranks, pattern)
        for b in batches:
            texts = b.column(b.schema.get_field_index("_cm_text"))
            at = 0
            while at < len(texts):  # bounded sub-batches
                some, size, start = [], 0, at
                while at < len(texts) and (at == start or size < BATCH_CHARS):
                    some.append(texts[at].as_py() or "")
                    size += len(some[-1])
                    at += 1
                ids = codec.encode(some)
                decoded = [codec.decode(x) for x in ids]
                part = b.slice(start, at - start).drop_columns(["_cm_text"])
                yield pa.RecordBatch.from_arrays([*part.columns, _arrays(ids), pa.array(decoded, pa.binary())],
                                                 names=[*part.schema.names, ids_col, bytes_col])

    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    src = docs.select(*rest, F.col(f"`{text_col}`").cast("string").alias("_cm_text"))
    schema = src.drop("_cm_text").schema.add(ids_col, ArrayType(IntegerType())).add(bytes_col, BinaryType())
    return src.mapInArrow(run, schema)


def digests(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
            with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row, and the ids themselves on demand."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    done = encode_decode(src, vocab_path, pattern)
    ids = [F.col("_cm_ids").alias("ids")] if with_ids else []
    return done.select("doc_id", *ids, F.size("_cm_ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("_cm_ids", " ").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("_cm_decoded"), 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                   public_tokenizers.PATTERN)
