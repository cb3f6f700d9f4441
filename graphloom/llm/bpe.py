"""Byte-level BPE encoding of text by a public vocabulary.

A piece of text is merged with a segment tree over its byte positions. Each node
holds the least (rank, position) of its span, so the root is the leftmost pair of
least rank; a merge changes three leaves, each in logarithmic time. A piece of n
bytes takes O(n log n), also where a text is one single piece.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of up to so many bytes are remembered, at most MEMORY of them per task.
REMEMBERED = 64
MEMORY = 400_000
NEVER = 1 << 62


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The folder is ``$TOKENIZERS_DIR`` or the installed one."""
    return os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    known = ranks.get(piece)
    if known is not None:
        return [known]
    n = len(piece)
    size = 1 << max(n - 2, 0).bit_length()
    start, stop = list(range(n)), list(range(1, n + 1))  # the live token at a position spans start..stop
    before = list(range(-1, n - 1))
    tree = [NEVER] * (2 * size)

    def pair(i: int) -> int:
        j = stop[i]
        if j >= n:
            return NEVER
        rank = ranks.get(piece[i : stop[j]])
        return NEVER if rank is None else rank << 32 | i

    for i in range(n - 1):
        tree[size + i] = pair(i)
    for x in range(size - 1, 0, -1):
        a, b = tree[2 * x], tree[2 * x + 1]
        tree[x] = a if a < b else b

    def put(i: int, value: int) -> None:
        x = size + i
        tree[x] = value
        x >>= 1
        while x:
            a, b = tree[2 * x], tree[2 * x + 1]
            least = a if a < b else b
            if tree[x] == least:
                return
            tree[x] = least
            x >>= 1

    while (top := tree[1]) != NEVER:
        i = top & 0xFFFFFFFF
        j = stop[i]
        stop[i] = stop[j]
        if j < size:
            put(j, NEVER)
        if stop[i] < n:
            before[stop[i]] = i
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : stop[i]]])
        i = stop[i]
    return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.split, self.memory = ranks, regex.compile(pattern).findall, {}

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        memory = self.memory
        for piece in self.split(text):
            ids = memory.get(piece)
            if ids is None:
                ids = merge(piece.encode("utf-8", "surrogatepass"), self.ranks)
                if len(piece) <= REMEMBERED:
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[piece] = ids
            out += ids
        return out


def _encode(ranks: Broadcast, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(ranks.value, pattern)
        for batch in batches:
            # Long texts go on in several output batches of bounded size.
            keys, texts = batch.column(0), batch.column(1)
            begin = 0
            flat, ends = [], [0]
            for k in range(len(texts)):
                flat += encode(texts[k].as_py())
                ends.append(len(flat))
                if len(flat) > 2_000_000 or k + 1 == len(texts):
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys.slice(begin, k + 1 - begin), ids], names=["key", "ids"])
                    begin, flat, ends = k + 1, [], [0]

    return run


def encode_texts(df: DataFrame, id: str, text: str, path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``id`` and ``ids``, the text's token ids, without special tokens.

    Null and empty texts have an empty list, the names of special tokens are
    ordinary text. Rows keep their number and order; repeated rows stay repeated.
    The vocabulary, read from ``path`` on the driver, is sent to each executor once.
    """
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path or vocabulary_path()))
    kind = df.schema[id].dataType.simpleString()
    out = df.select(id, text).mapInArrow(_encode(ranks, pattern), f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", id)
