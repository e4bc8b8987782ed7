"""Encoding texts with a public byte-level BPE vocabulary.

Texts are cut into pre-tokens by the vocabulary's pattern. The pairs of a pre-token wait in one bucket
per merge rank; a bitmap of three levels marks the ranks that have waiting pairs, and find-first-set on
its words gives the lowest one. A bucket holds positions in a linked list of the pre-token's parts;
entries that a merge has made stale are skipped when they come up. The work is proportional to the
number of pairs, so very long pre-tokens take no longer per byte than short ones. Pre-tokens that come
again are remembered.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern that cuts texts before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
_KEPT = 200_000
_LONGEST_KEPT = 48
_WORD = 64


class RankQueue:
    """Positions by merge rank, lowest rank and then lowest position first."""

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        sizes = [ranks]
        while sizes[-1] > 1:
            sizes.append((sizes[-1] + _WORD - 1) // _WORD)
        self.levels = [[0] * n for n in sizes[1:]]

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            at = rank
            for level in self.levels:
                at, bit = divmod(at, _WORD)
                full = level[at]
                level[at] = full | 1 << bit
                if full:  # the levels above know of it
                    break
        else:
            heapq.heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        if not self.levels[-1][0]:
            return None
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = at * _WORD + (word & -word).bit_length() - 1
        bucket = self.buckets[at]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[at]
            up = at
            for level in self.levels:
                up, bit = divmod(up, _WORD)
                level[up] &= ~(1 << bit)
                if level[up]:
                    break
        return at, position


class Encoder:
    """Ids of texts by a rank file in tiktoken's format."""

    def __init__(self, folder: str = FOLDER, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> None:
        with open(f"{folder}/{vocabulary}.tiktoken", "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.find = regex.compile(pattern).findall
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.known: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, ranks, queue = len(piece), self.ranks, self.queue
        ends = list(range(1, n + 1))  # a part is piece[i:ends[i]]; 0 marks a part that is gone
        before = list(range(-1, n - 1))
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                queue.push(rank, i)
        while (least := queue.pop()) is not None:
            rank, i = least
            middle = ends[i]
            if not middle or middle >= n:
                continue
            end = ends[middle]
            if ranks.get(piece[i:end]) != rank:
                continue  # stale: one of the parts has changed
            ends[i], ends[middle] = end, 0
            if end < n:
                before[end] = i
                after = ranks.get(piece[i : ends[end]])
                if after is not None:
                    queue.push(after, i)
            if before[i] >= 0:
                left = ranks.get(piece[before[i] : end])
                if left is not None:
                    queue.push(left, before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]] if ends[i] - i > 1 else self.single[piece[i]])
            i = ends[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without special tokens; none for an empty or a null text."""
        out: list[int] = []
        known = self.known
        for word in self.find(text or ""):
            ids = known.get(word)
            if ids is None:
                ids = self.merge(word.encode("utf-8", "replace"))
                if len(word) <= _LONGEST_KEPT:
                    if len(known) >= _KEPT:
                        known.clear()
                    known[word] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Encoder:
    """The process's encoder of a vocabulary."""
    return Encoder(folder, vocabulary)


def encode(documents: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row of documents (doc_id, text).

    Empty and null texts have the empty array; repeated rows stay repeated; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(folder, vocabulary).encode
        for batch in batches:
            ids = [np.array(ids_of(text.as_py()), np.int32) for text in batch.column(1)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, ids array<int>")


def count_tokens(documents: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents (doc_id, text, ...) with n_tokens in place of text."""
    names = [c for c in documents.columns if c != "text"]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name != "text") + ", n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(folder, vocabulary).encode
        for batch in batches:
            counts = pa.array([len(ids_of(text.as_py())) for text in batch.column("text")], pa.int64())
            yield batch.select(names).append_column("n_tokens", counts)

    return documents.mapInArrow(run, shape)
