"""Encoding a corpus with a public tokenizer (problem 8).

A text is encoded as a balanced tree: leaves are encoded directly, two neighbours are joined by re-encoding a window around
their seam. The window grows on each side until it starts and ends at an anchor: a blank or line feed after a character that is
no white space. The tokenizer's splitting pattern lets no piece reach across such a place, whatever surrounds it, so tokens
outside the window are final and the joined list equals the encoding of the whole text. Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER_DIR = "/opt/tokenizers"
#: Characters of a leaf, and of the first window tried on each side of a seam.
LEAF, WINDOW = 512, 64

# Fixed value: the public tokenizer's splitting pattern, as its README gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Byte-level BPE from a rank file; strings of special tokens are ordinary text."""

    def __init__(self, rank_file: str):
        import tiktoken

        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("hireloom", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.n_bytes = np.zeros(max(self.ranks.values()) + 1, dtype=np.int32)
        for token, i in self.ranks.items():
            self.n_bytes[i] = len(token)
        self.joins = 0

    def leaf(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def encode(self, text: str | None, leaf: int = LEAF, window: int = WINDOW) -> list[int]:
        if not text:
            return []
        if len(text) <= leaf:
            return self.leaf(text)
        middle = len(text) // 2
        return self.join(text, middle, self.encode(text[:middle], leaf, window), self.encode(text[middle:], leaf, window), window)

    def join(self, text: str, seam: int, left: list[int], right: list[int], window: int) -> list[int]:
        self.joins += 1
        start, end = _anchor_before(text, seam, window), _anchor_after(text, seam, window)
        kept = self._tokens_within(reversed(left), len(text[start:seam].encode()))
        gone = self._tokens_within(iter(right), len(text[seam:end].encode()))
        return left[: len(left) - kept] + self.leaf(text[start:end]) + right[gone:]

    def _tokens_within(self, ids: Iterator[int], n: int) -> int:
        """How many tokens make up the next n bytes; an anchor is always a token's edge."""
        count = 0
        while n > 0:
            n -= int(self.n_bytes[next(ids)])
            count += 1
        if n:
            raise AssertionError("an anchor fell inside a token")
        return count

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode(list(ids))


def _is_anchor(text: str, i: int) -> bool:
    return text[i] in " \n" and not text[i - 1].isspace()


def _anchor_before(text: str, seam: int, window: int) -> int:
    low, i = max(0, seam - window), seam - 1
    while True:
        for i in range(min(i, seam - 1), max(low, 1) - 1, -1):
            if _is_anchor(text, i):
                return i
        if low == 0:
            return 0
        i, window = low - 1, window * 2
        low = max(0, seam - window)


def _anchor_after(text: str, seam: int, window: int) -> int:
    i, high = seam + 1, min(len(text), seam + window)
    while True:
        for i in range(i, high):
            if _is_anchor(text, i):
                return i
        if high == len(text):
            return high
        i, window = high, window * 2
        high = min(len(text), seam + window)


@cache
def encoder(rank_file: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(rank_file)


def rank_file(tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> str:
    return f"{folder}/{tokenizer}.tiktoken"


def encode_corpus(docs: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids): the token ids of each row's text, without special tokens; an empty list for empty and null texts.

    One narrow pass, nothing is shuffled. Repeated rows and keys stay; other columns are pruned at the scan.
    """
    path = rank_file(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            lists = [enc.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            values = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["key", "ids"])

    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return picked.mapInArrow(run, f"key {dict(docs.dtypes)[key]}, ids array<int>").withColumnRenamed("key", key)


def tree_shape(docs: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, n_tokens, n_joins): how many tokens each text has, and how many joins of neighbours its tree took; 0 and 0 for empty and null texts."""
    path = rank_file(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            sizes, joins = [], []
            for t in batch.column(1).to_pylist():
                before = enc.joins
                sizes.append(len(enc.encode(t)))
                joins.append(enc.joins - before)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(joins, pa.int32())], names=["key", "n_tokens", "n_joins"])

    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return picked.mapInArrow(run, f"key {dict(docs.dtypes)[key]}, n_tokens bigint, n_joins int").withColumnRenamed("key", key)


def count_tokens(docs: DataFrame, text: str, into: str = "n_tokens", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """Replaces ``text`` by ``into``, its number of tokens (0 for empty and null texts); the other columns pass through."""
    path = rank_file(tokenizer, folder)
    others = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            sizes = pa.array([len(enc.encode(t)) for t in batch.column(len(others)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], sizes], names=[*others, into])

    schema = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in others)
    return docs.select(*others, text).mapInArrow(run, f"{schema}, `{into}` bigint")
