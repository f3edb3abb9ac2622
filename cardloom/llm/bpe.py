"""Byte-level BPE of whole texts.

Pre-tokens are merged with a rank queue: one bucket of linked-list positions per merge rank, and a bitmap of three levels over the
ranks, in which the first set bit picks the next rank. An entry is stale when its pair has changed since; it is skipped. Work is
linear in the pre-token's length for each merge, so a pre-token of many thousands of bytes costs no more per byte than a short one.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of the public 50k vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens remembered by a worker; the memory is emptied when it is full.
REMEMBERED = 400_000
_NEVER = 1 << 62


class RankQueue:
    """Positions by rank, smallest rank first."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]] | None:
        """The smallest rank and all positions in its bucket, which is emptied."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        rank = a << 6 | (word & -word).bit_length() - 1
        self.low[a] &= word - 1
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        return rank, self.buckets.pop(rank)


class Encoder:
    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.split = regex.compile(PATTERN).findall
        self.memory: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        part: list[bytes] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [_NEVER] * n  # the rank of the pair that begins at a position, now
        queue = RankQueue(self.size)
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                pair[i] = rank
                queue.push(rank, i)
        while (top := queue.pop()) is not None:
            rank, places = top
            places.sort()
            for k, i in enumerate(places):
                if pair[i] != rank:
                    continue  # stale
                j = after[i]
                part[i] += part[j]
                pair[j] = _NEVER
                after[i] = m = after[j]
                again = False
                if m < n:
                    before[m] = i
                    new = ranks.get(part[i] + part[m])
                    pair[i] = _NEVER if new is None else new
                    if new is not None:
                        queue.push(new, i)
                        again = new < rank
                else:
                    pair[i] = _NEVER
                if (h := before[i]) >= 0:
                    new = ranks.get(part[h] + part[i])
                    pair[h] = _NEVER if new is None else new
                    if new is not None:
                        queue.push(new, h)
                        again = again or new < rank
                if again:  # a smaller rank came up: the rest of this bucket waits
                    for rest in places[k + 1 :]:
                        queue.push(rank, rest)
                    break
        out, i = [], 0
        while i < n:
            out.append(ranks[part[i]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty list for null or empty text."""
        if not text:
            return []
        memory = self.memory
        pieces = self.split(text)
        try:
            return list(itertools.chain.from_iterable([memory[p] for p in pieces]))
        except KeyError:
            pass
        if len(memory) > REMEMBERED:
            memory.clear()
        for p in set(pieces).difference(memory):
            memory[p] = self.merge(p.encode("utf-8", "replace"))
        return list(itertools.chain.from_iterable([memory[p] for p in pieces]))


_encoders: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """This process's encoder for a vocabulary file, read once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row: no shuffle, one pass, whole texts. Null and empty texts have an empty list; repeated rows stay."""
    rows = documents.select(F.col(key).alias("key_"), F.col(text).cast("string").alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(vocabulary).encode
        for batch in batches:
            ids = [one(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)['key_']}, ids array<int>")


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row: 0 for null and empty texts."""
    rows = documents.select(F.col(key).alias("key_"), F.col(text).cast("string").alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(vocabulary)
        for batch in batches:
            sizes = np.fromiter((len(one.encode(t)) for t in batch.column(1).to_pylist()), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], names=[key, "n_tokens"])

    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)['key_']}, n_tokens bigint")
