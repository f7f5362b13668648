"""Encoding of texts with a byte-level BPE vocabulary.

A text is cut by the vocabulary's pattern into pieces, each piece is encoded by itself. Pieces recur,
so every worker keeps the ids of those it met (bounded; the ids don't depend on it). A piece that is
new is merged with a rank queue: each rank has a bucket of positions in a linked list of parts, a
hierarchical bitmap over the ranks gives the lowest rank with an entry by find-first-set, and entries
whose pair is no longer there are skipped. Merging n bytes takes O(n) queue steps, however long the
piece is. A merge makes pairs of later ranks only, as their parts include the token just made.

Row-local: one Python pass in Arrow batches, vocabulary read once per worker from a path.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

TOKENIZERS = os.environ.get("LEXMILL_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: what the byte-level vocabularies split text at before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker keeps at most, and the longest piece it keeps.
KEPT, KEPT_CHARS = 200_000, 64


class RankQueue:
    """Positions by rank; the lowest rank first."""

    def __init__(self, ranks: int):
        n0 = (ranks >> 6) + 1
        n1 = (n0 >> 6) + 1
        self.buckets: dict[int, list[int]] = {}
        self.low, self.mid, self.top = [0] * n0, [0] * n1, 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
            self.top |= 1 << (rank >> 12)
        else:
            bucket.append(position)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions from left to right."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = (a << 6) | ((word & -word).bit_length() - 1)
        word = self.low[b]
        rank = (b << 6) | ((word & -word).bit_length() - 1)
        self.low[b] &= ~(1 << (rank & 63))
        if not self.low[b]:
            self.mid[a] &= ~(1 << (b & 63))
            if not self.mid[a]:
                self.top &= ~(1 << a)
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class Encoder:
    """Text to ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.kept: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        ranks, queue = self.ranks, self.queue
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n

        def offer(i: int) -> None:
            j = after[i]
            rank = ranks.get(parts[i] + parts[j]) if j < n else None
            pair[i] = -1 if rank is None else rank
            if rank is not None:
                queue.push(rank, i)

        for i in range(n):
            offer(i)
        while (lowest := queue.pop()) is not None:
            rank, positions = lowest
            for i in positions:
                if parts[i] is None or pair[i] != rank:
                    continue
                j = after[i]
                parts[i] += parts[j]
                parts[j], pair[j] = None, -1
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                offer(i)
                if before[i] >= 0:
                    offer(before[i])
        return tuple(ranks[p] for p in parts if p is not None)

    def encode(self, text: str) -> list[int]:
        """Ids of a text; none for an empty one."""
        out: list[int] = []
        kept = self.kept
        for piece in self.find(text):
            ids = kept.get(piece)
            if ids is None:
                ids = self.merge(piece.encode())
                if len(piece) <= KEPT_CHARS:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Encoder:
    """The encoder of `<folder>/<vocabulary>.tiktoken`."""
    with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Encoder(ranks, PATTERN)


def _run(make: Callable[[], Encoder], schema: StructType, counts: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = make().encode, to_arrow_schema(schema)
        for batch in batches:
            *keys, texts = batch.columns
            for at in range(0, len(texts), 1000):
                flat: list[int] = []
                ends = [0]
                for text in texts.slice(at, 1000).to_pylist():
                    if text:
                        flat += encode(text)
                    ends.append(len(flat))
                if counts:
                    last = pa.array(np.diff(ends), pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([k.slice(at, 1000).cast(f.type) for k, f in zip(keys, out)] + [last.cast(out[-1].type)], schema=out)

    return run


def encode_texts(texts: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>): the ids of each text, without special tokens; strings of special tokens in
    a text are ordinary text. Null and empty texts both have the empty list. Rows are kept one to one."""
    schema = StructType([texts.schema[key]]).add("ids", ArrayType(IntegerType()))
    return texts.select(key, text).mapInArrow(_run(lambda: encoder(vocabulary, folder), schema, False), schema)


def count_tokens(texts: DataFrame, *keys: str, text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(keys, n_tokens bigint): the number of ids of each text, 0 for null and empty ones."""
    schema = StructType([texts.schema[k] for k in keys]).add("n_tokens", LongType())
    return texts.select(*keys, text).mapInArrow(_run(lambda: encoder(vocabulary, folder), schema, True), schema)
