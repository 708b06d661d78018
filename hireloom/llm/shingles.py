"""Vectorised word and word-run hashing over Arrow batches, and bounded count sketches and bitmaps shared by the llm operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bits of a word-run's hash; the bits above hold a text's number within its chunk.
TOKEN_BITS = 48
#: Bytes of text that are hashed at once.
CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(n, _BASE, dtype=np.uint64)
    inverse = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    base[0] = inverse[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(array: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(start, slice) with at most ``limit`` bytes of text or one text, and fewer than 2 ** 15 texts."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, n = 0, len(array)
    while start < n:
        before = sizes[start - 1] if start else 0
        stop = int(np.searchsorted(sizes, before + limit, side="right"))
        stop = min(max(stop, start + 1), start + 32767, n)
        yield start, array.slice(start, stop - start)
        start = stop


def lowered(array: pa.Array) -> pa.Array:
    """Lower case as str.lower() gives it, as far as the letters a to z come out of it; nulls become empty."""
    return pc.utf8_lower(pc.replace_substring(pc.fill_null(array.cast(pa.large_string()), ""), "İ", "i̇"))


def words(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its text) of each word, a longest run of a-z and 0-9 in lower case."""
    low = lowered(array)
    edges = np.frombuffer(low.buffers()[1], dtype=np.int64)[low.offset : low.offset + len(low) + 1]
    data = low.buffers()[2]
    text = np.frombuffer(data, dtype=np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    n = len(text)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = _WORD[text]
    cut = np.zeros(n + 1, dtype=bool)
    cut[edges] = True
    starts = np.flatnonzero(inside[:n] & (cut[:n] | ~np.concatenate(([False], inside[: n - 1]))))
    ends = np.flatnonzero(inside[:n] & (cut[1:] | ~inside[1:])) + 1
    up, down = _powers(max(CHUNK_BYTES * 2, 1 << int(n).bit_length()))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    return hashes, np.searchsorted(edges, starts, side="right") - 1


def runs(array: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, edges, word counts): the sorted distinct k-word runs of text i are tokens[edges[i]:edges[i + 1]]."""
    hashes, of = words(array)
    counts = np.bincount(of, minlength=len(array)).astype(np.int64)
    m = max(len(hashes) - k + 1, 0)
    joined = np.zeros(m, dtype=np.uint64)
    for i in range(k):
        joined = mix(joined * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + m])
    whole = of[:m] == of[k - 1 : k - 1 + m] if m else np.zeros(0, bool)
    keyed = (of[:m].astype(np.uint64) << np.uint64(TOKEN_BITS)) | (joined >> np.uint64(64 - TOKEN_BITS))
    keyed = np.sort(keyed[whole])
    if len(keyed):
        keyed = keyed[np.concatenate(([True], keyed[1:] != keyed[:-1]))]
    edges = np.searchsorted(keyed, np.arange(len(array) + 1, dtype=np.uint64) << np.uint64(TOKEN_BITS))
    return keyed & np.uint64((1 << TOKEN_BITS) - 1), edges, counts


class Sketch:
    """Counts of hashed items in 2 ** bits slots: its size is a parameter, whatever the corpus; it never undercounts."""

    BLOCK = 1 << 16

    def __init__(self, bits: int):
        self.bits, self.counts = bits, np.zeros(1 << bits, dtype=np.uint32)

    def add(self, items: np.ndarray) -> None:
        np.add.at(self.counts, (items & np.uint64((1 << self.bits) - 1)).astype(np.int64), np.uint32(1))

    def blocks(self) -> tuple[list[int], list[bytes]]:
        parts = self.counts.reshape(-1, min(self.BLOCK, len(self.counts)))
        used = [i for i in range(len(parts)) if parts[i].any()]
        return used, [zlib.compress(parts[i].tobytes(), 1) for i in used]

    @staticmethod
    def merge(packed: list[bytes]) -> bytes:
        total = None
        for p in packed:
            x = np.frombuffer(zlib.decompress(p), dtype=np.uint32).astype(np.uint64)
            total = x if total is None else total + x
        return zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)

    @staticmethod
    def unpack(bits: int, blocks: list[tuple[int, bytes]]) -> np.ndarray:
        counts = np.zeros(1 << bits, dtype=np.uint32)
        size = min(Sketch.BLOCK, len(counts))
        for i, p in blocks:
            counts[i * size : (i + 1) * size] = np.frombuffer(zlib.decompress(p), dtype=np.uint32)
        return counts


def pack_tokens(tokens: np.ndarray) -> bytes:
    """Six bytes a token."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : TOKEN_BITS // 8]).tobytes()


def unpack_tokens(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, dtype=np.uint8).reshape(-1, TOKEN_BITS // 8)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, : TOKEN_BITS // 8] = raw
    return wide.view("<u8").ravel()
