"""Encoding a corpus with a public byte-level BPE vocabulary.

Each pre-token is merged with a segment tree over its adjacent pairs: a leaf holds
(rank of the pair, position), an inner node the minimum of its children, so the root is the
leftmost pair of lowest rank.  A merge changes three leaves, each updated up the tree in
O(log n); a pre-token of n bytes costs O(n log n) however long it is.  Distinct pre-tokens
are far fewer than pre-tokens, so each worker keeps the ids of those it has merged; the
memory is bounded by emptying it when full, which changes no result.

The corpus is read once, in Arrow batches, with no shuffle.  The vocabulary file (under 1 MB,
checked) is read on the driver and sent with the task closure as bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.session import spread

TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 8 << 20
MEMO_ENTRIES = 1 << 19
MEMO_PIECE_CHARS = 64

#: Fixed value: the pre-token pattern published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = 1 << 62


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Lines of 'base64 rank' to a dict."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token, by repeated leftmost lowest-rank merges read off a segment tree."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 2).bit_length()  # leaves for the n - 1 pairs
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends
    before = list(range(-1, n))  # before[i]: start of the part before i

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    def pair(i: int) -> int:
        j = end[i]
        if j >= n:
            return _NONE
        r = ranks.get(piece[i : end[j]])
        return _NONE if r is None else r << 32 | i

    while (best := tree[1]) != _NONE:
        i = best & 0xFFFFFFFF
        j = end[i]
        end[i] = end[j]
        if end[i] < n:
            before[end[i]] = i
        if j < n - 1:
            put(j, _NONE)
        if i < n - 1:
            put(i, pair(i))
        if i:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder(dict):
    """piece -> ids, merged on first sight; calling it encodes a text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        super().__init__()
        self.ranks, self.findall = ranks, regex.compile(pattern).findall

    def __missing__(self, piece: str) -> list[int]:
        ids = merge_piece(piece.encode("utf-8", "replace"), self.ranks)
        if len(piece) <= MEMO_PIECE_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids

    def __call__(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.findall(text))))


_encoders: dict[bytes, Encoder] = {}


def encoder_for(raw: bytes, pattern: str = PATTERN) -> Encoder:
    """The worker's encoder of this vocabulary, built once per process."""
    key = blake2b(raw + pattern.encode(), digest_size=16).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(parse_ranks(raw), pattern)
    return _encoders[key]


def vocabulary(path: str = f"{TOKENIZER_DIR}/{BYTE_BPE_50K}") -> bytes:
    raw = Path(path).read_bytes()
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: {len(raw)} bytes is too large to send with each task")
    return raw


def _per_text(df: DataFrame, raw: bytes, keep: list[str], text_col: str, kind: str, make: Callable) -> DataFrame:
    """Arrow pass: the ``keep`` columns and ``make(encoder, texts)`` as one more column, ``out``."""
    sent = df.sparkSession.sparkContext.broadcast(raw)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_for(sent.value)
        for b in it:
            texts = b.column(b.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], make(enc, texts)], [*keep, "out"])

    picked = spread(df.select(*keep, F.col(text_col).alias("_text")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{fields}, out {kind}")


def _ids(enc: Encoder, texts: list) -> pa.Array:
    lists = [enc(t) if t else [] for t in texts]
    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _counts(enc: Encoder, texts: list) -> pa.Array:
    return pa.array([sum(len(enc[p]) for p in enc.findall(t)) if t else 0 for t in texts], pa.int64())


def encode_corpus(df: DataFrame, keep: list[str], text_col: str = "text", raw: bytes | None = None) -> DataFrame:
    """``keep`` columns and ``ids``: the token ids of each text, no special tokens.

    Null and empty texts have an empty list.  Strings that serve as special tokens elsewhere
    are ordinary text.  One row out per row in, repeated rows included.
    """
    return _per_text(df, raw or vocabulary(), keep, text_col, "array<int>", _ids).withColumnRenamed("out", "ids")


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", raw: bytes | None = None) -> DataFrame:
    """``keep`` columns and ``n_tokens``; 0 for null and empty texts."""
    return _per_text(df, raw or vocabulary(), keep, text_col, "bigint", _counts).withColumnRenamed("out", "n_tokens")


def decode_ids(df: DataFrame, ids_col: str, out_col: str, raw: bytes | None = None) -> DataFrame:
    """``df`` with ``out_col`` in place of ``ids_col``: the text the ids stand for; an empty list gives ''.

    Bytes that are no UTF-8, which ids of cut texts may give, become U+FFFD; a null list stays null.
    """
    raw = raw or vocabulary()
    picked = df.select(*(c for c in df.columns if c != ids_col), ids_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {r: b for b, r in parse_ranks(raw).items()}
        for b in it:
            texts = [x if x is None else b"".join([parts[i] for i in x]).decode("utf-8", "replace") for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], out_col])

    return picked.mapInArrow(run, f"{fields}, `{out_col}` string")
