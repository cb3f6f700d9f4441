"""Passages of evaluation items inside training documents."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 12
#: The invisible characters that are left out.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
#: Items are sent to the executors in blocks of at most so many words, at under 50 bytes a word.
BLOCK_WORDS = 2_000_000
#: So many words of documents are looked up at a time, or those of one document if they are more.
SCAN_WORDS = 500_000
#: A worker remembers the hashes of so many words at most.
MEMO = 200_000

_run = regex.compile(r"[\p{L}\p{N}]+")
_ascii_run = re.compile(r"[0-9a-z]+")
_gone = re.compile(f"[{INVISIBLE}]")


def normal(text: str) -> str:
    """NFKC without invisible characters, in lower case."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return _gone.sub("", text).lower()


def words(text: str | None) -> list[str]:
    if not text:
        return []
    return (_ascii_run if text.isascii() else _run).findall(normal(text))


class _Memo(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hash = _Memo()
#: An odd number; a window of words h0, h1, … has the hash h0 + h1 * BASE + h2 * BASE**2 … modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1024, 0 if have is None else 2 * len(have))
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_hash.__getitem__, tokens), np.uint64, len(tokens))


def window_hashes(h: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
    """For each size the hashes of all windows of so many of the words."""
    n = len(h)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _power(BASE, n), out=sums[1:])
    back = _power(pow(BASE, -1, 1 << 64), n)
    for k in sizes:
        yield (sums[k:] - sums[: n + 1 - k]) * back[: n + 1 - k] if k <= n else np.zeros(0, np.uint64)


class Passages:
    """The word windows of evaluation items: ``size`` consecutive words, or all of a shorter item.

    A sorted table of 64-bit window hashes with their places in the items' words, which are kept as
    one UTF-8 text: about 30 bytes a word. A hit counts if the words themselves are equal.
    """

    def __init__(self, items: list[tuple[int, list[str]]], size: int) -> None:
        items = [(i, w) for i, w in items if w]
        lengths = np.array([len(w) for _, w in items], np.int64)
        tokens = [t for _, w in items for t in w]
        ends = np.cumsum(lengths)
        self.items = np.array([i for i, _ in items], np.int64)
        self.ends = ends  # of each item, in words
        encoded = [t.encode() for t in tokens]
        self.text = b" ".join(encoded)
        self.offsets = np.zeros(len(tokens) + 1, np.int64)
        np.cumsum([len(e) + 1 for e in encoded], out=self.offsets[1:])
        takes = np.minimum(lengths, size)
        self.sizes = sorted(set(takes.tolist()))
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        h = hashes(tokens)
        for k, found in zip(self.sizes, window_hashes(h, self.sizes)):
            one = takes == k
            first, last = (ends - lengths)[one], ends[one] - k
            at = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)]).astype(np.uint32)
            keys = found[at]
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            bits = max(10, int(len(keys) * 8).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[keys >> np.uint64(64 - bits)] = True
            self.tables.append((keys, at, np.packbits(seen)))

    def _slice(self, at: int, k: int) -> bytes:
        return self.text[self.offsets[at] : self.offsets[at + k] - 1]

    def lookup(self, tokens: list[str], docs: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """First word, end word and item of each matching window; ``docs`` are the words' documents,
        in ascending order, and no window crosses two."""
        if not tokens:
            return
        for (keys, at, seen), k, found in zip(self.tables, self.sizes, window_hashes(hashes(tokens), self.sizes)):
            if not len(found):
                continue
            bits = (len(seen) * 8).bit_length() - 1
            slot = found >> np.uint64(64 - bits)
            may = np.flatnonzero((seen[slot >> np.uint64(3)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1)
            may = may[docs[may] == docs[may + k - 1]]
            low = np.searchsorted(keys, found[may], "left")
            high = np.searchsorted(keys, found[may], "right")
            for a, i, j in zip(may[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
                own = " ".join(tokens[a : a + k]).encode()
                for place in at[i:j].tolist():
                    if self._slice(place, k) == own:
                        yield a, a + k, int(self.items[np.searchsorted(self.ends, place, "right")])

    def spans(self, text: str | None) -> list[tuple[int, int, set[int]]]:
        """First word, end word and items of each matching window."""
        tokens = words(text)
        found: dict[tuple[int, int], set[int]] = {}
        for a, b, item in self.lookup(tokens, np.zeros(len(tokens), np.int32)):
            found.setdefault((a, b), set()).add(item)
        return [(a, b, found[a, b]) for a, b in sorted(found)]

    def scan(self, texts: Iterator[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """Number of the text, first word, end word and item of each matching window of many texts."""
        tokens: list[str] = []
        starts: list[tuple[int, int]] = []

        def flush() -> Iterator[tuple[int, int, int, int]]:
            begins = np.array([b for _, b in starts], np.int64)
            docs = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(begins, len(tokens))))
            for a, b, item in self.lookup(tokens, docs):
                d = int(docs[a])
                yield starts[d][0], a - int(begins[d]), b - int(begins[d]), item

        for k, text in enumerate(texts):
            w = words(text)
            if not w:
                continue
            if tokens and len(tokens) + len(w) > SCAN_WORDS:
                yield from flush()
                tokens, starts = [], []
            starts.append((k, len(tokens)))
            tokens += w
        if tokens:
            yield from flush()


def item_blocks(items: DataFrame, id: str, text: str, limit: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The evaluation items in blocks of at most ``limit`` words each, at least one item."""
    block, size = [], 0
    for r in items.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(id, text).distinct().toLocalIterator():
        tokens = words(r[1])
        if block and size + len(tokens) > limit:
            yield block
            block, size = [], 0
        block.append((r[0], tokens))
        size += len(tokens)
    if block:
        yield block


def _scan(passages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = passages.value
        for batch in batches:
            texts = batch.column(1)
            hits = sorted({(k, item) for k, _, _, item in p.scan(t.as_py() for t in texts)})
            docs, items = [k for k, _ in hits], [i for _, i in hits]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, pa.int64())), pa.array(items, pa.int64())], names=["doc", "item"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id``, ``item_id``: each document with each item of which it has ``size``
    consecutive words, or all words in a row where the item has fewer.

    Words are runs of letters and digits of the normalised text (``normal``). Null
    and empty texts and items without a word match nothing; repeated rows give one
    row. The windows of a block of items, bounded by ``block_words``, are sent to the
    executors; larger item sets take several passes over the documents, which are
    never shuffled.
    """
    sc = docs.sparkSession.sparkContext
    kind = docs.schema[doc_id].dataType.simpleString()
    d = docs.where(F.col(doc_text).isNotNull()).select(doc_id, doc_text)
    found = None
    for block in item_blocks(items, item_id, item_text, block_words):
        part = d.mapInArrow(_scan(sc.broadcast(Passages(block, size))), f"doc {kind}, item bigint")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = d.select(F.col(doc_id).alias("doc"), F.lit(None).cast("bigint").alias("item")).where(F.lit(False))
    return found.distinct().select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the word spans; positions are found in the text as stored.

    Word runs of the stored text are normalised one by one, so a run that turns into
    several words (as a ligature sign with a space would) is removed as a whole.
    """
    drop = [False] * (max((b for _, b in spans), default=0))
    for a, b in spans:
        drop[a:b] = [True] * (b - a)
    out, word, at = [], 0, 0
    skipping = False
    for m in regex.finditer(r"[^\s]+", text):
        n = len(words(m[0]))
        gone = n > 0 and any(drop[word : word + n])
        if not gone and not (skipping and n == 0):
            out.append(text[at if not skipping else m.start() : m.end()])
            skipping = False
        elif gone:
            if not skipping:
                out.append(text[at : m.start()])
            skipping = True
        at = m.end()
        word += n
    if not skipping:
        out.append(text[at:])
    return "".join(out)


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same words as spans that neither meet nor overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = pa.list_(pa.int32())


def _mark(passages):
    """Adds the spans that a block of items has in each text to those of other blocks, as first and end words in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = passages.value
        for batch in batches:
            spans = [list(zip(s[::2], s[1::2])) for s in batch.column(2).to_pylist()]
            for k, a, b, _ in p.scan(t.as_py() for t in batch.column(1)):
                spans[k].append((a, b))
            flat = [[x for pair in joined_spans(s) for x in pair] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat, SPANS)], names=["doc", "text", "spans"])

    return run


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [cut_spans(t, list(zip(s[::2], s[1::2]))) if s else t for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc", "text"])


def remove_leaks(docs: DataFrame, items: DataFrame, mode: str = "span", doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id``, ``text``: the documents without leaked passages.

    'span' takes the matching word spans out of the texts, 'document' leaves out
    the documents that have any. The spans of all blocks of items are found in the text as
    stored before any is taken out, so results don't depend on ``block_words``. Null texts stay null.
    """
    sc = docs.sparkSession.sparkContext
    kind = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text"), F.array().cast("array<int>").alias("spans"))
    for block in item_blocks(items, item_id, item_text, block_words):
        d = d.mapInArrow(_mark(sc.broadcast(Passages(block, size))), f"doc {kind}, text string, spans array<int>")
    out = d.where(F.size("spans") == 0) if mode == "document" else d.mapInArrow(_clean, f"doc {kind}, text string")
    return out.select(F.col("doc").alias(doc_id), F.col("text").alias(doc_text))
