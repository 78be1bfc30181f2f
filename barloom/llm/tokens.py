"""Words of whole Arrow batches as numpy arrays: every step handles millions of bytes at once.

Texts are cut on their UTF-8 bytes. Both word classes used here are unions of single ASCII bytes and
of all bytes from 0x80 on, so cutting bytes gives the same words as cutting code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the polynomial hashes and of the final mixing.
BASE, BASE2, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
CHUNK_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Runs of anything but ASCII blanks (space, tab to carriage return).
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Runs of ASCII letters, digits and all non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def powers(n: int, base: int) -> np.ndarray:
    """base ** 0, ..., base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(n, dtype=U)
    done = 1
    while done < n:
        step = U(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out


def enough_powers(n: int, base: int) -> np.ndarray:
    return powers(max(CHUNK_BYTES * 2, 1 << (n - 1).bit_length() if n > 1 else 1), base)[:n]


@dataclass
class Words:
    """The words of some texts, in order. word i is bytes[start[i]:end[i]] and belongs to text[i]."""

    bytes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray  # of each text, the number of its first word; one entry more than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, base: int = BASE) -> np.ndarray:
        """64-bit hash of each word."""
        n = len(self.bytes)
        total = np.zeros(n + 1, dtype=U)
        np.cumsum((self.bytes.astype(U) + U(1)) * enough_powers(n, base), out=total[1:])
        back = enough_powers(n + 1, pow(base, -1, 1 << 64))
        return mix64((total[self.end] - total[self.start]) * back[self.start])

    def grams(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each k consecutive words of one text, and the number of the gram's first word."""
        h = self.hashes() if hashes is None else hashes
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
        acc = h[:n].copy()
        for j in range(1, k):
            acc *= U(STEP)
            acc += h[j : j + n]
        at = np.flatnonzero(self.text[:n] == self.text[k - 1 : k - 1 + n])
        return mix64(acc[at]), at

    def strings(self, first: int, n: int) -> str:
        """n words from number ``first`` on, with one space between."""
        return b" ".join(self.bytes[s:e].tobytes() for s, e in zip(self.start[first : first + n].tolist(), self.end[first : first + n].tolist(), strict=True)).decode("utf-8", "replace")


def cut_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True) -> Words:
    """data: bytes of all texts; offsets: where each begins, and the end."""
    inside = kind[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    before[offsets] = False
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    after[offsets] = False
    start = np.flatnonzero(inside & ~before[:-1])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(start, offsets)
    return Words(LOWER[data] if lower else data, start, end, text, first)


def window_least(values: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each w consecutive values, and the leftmost place that holds it: nothing but these values decides."""
    place, size = np.arange(len(values), dtype=np.int32 if len(values) < 1 << 31 else np.int64), 1
    if len(values) < w:
        return values[:0], place[:0]

    def least(step: int, n: int) -> None:
        nonlocal values, place
        right = values[step : step + n] < values[:n]
        values, place = np.where(right, values[step : step + n], values[:n]), np.where(right, place[step : step + n], place[:n])

    while size * 2 <= w:
        least(size, len(values) - size)
        size *= 2
    if size < w:
        least(w - size, len(values) - (w - size))
    return values, place


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the offsets of its texts."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the batches with about ``most`` bytes of text at a time (one text at least), the bytes and the offsets. Null texts are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text)).fill_null("")
        data, offsets = text_bytes(column)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
