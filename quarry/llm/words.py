"""Vectorized word splitting and hashing of Arrow string columns inside tasks.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D in the UTF-8 text. A word's hash is a
polynomial over a random byte table modulo 2**64 followed by a bijective mixer; a second, independent table and
base give 128 bits where equality must be beyond doubt.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are hashed at a time; the temporaries are about 60 times as large.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche (the finalizer of SplitMix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _byte_table(seed: int) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))
    t[_SPACE] = 0
    return t


_TABLES = (_byte_table(11), _byte_table(977))
_BASES = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))
_WINDOW_BASES = (U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3))


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, U)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


_POWERS = [powers(b, 1 << 12) for b in _BASES]


def _power_table(k: int, n: int) -> np.ndarray:
    if len(_POWERS[k]) < n:
        if n > 1 << 20:
            return powers(_BASES[k], n)  # a huge word: not kept
        _POWERS[k] = powers(_BASES[k], 2 * n)
    return _POWERS[k]


@dataclass
class Words:
    """Words of some documents, in order: byte ranges in ``data``, hashes, and each document's range of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: list[np.ndarray]
    offsets: np.ndarray


def split(texts: pa.Array, n_hashes: int = 1) -> Words:
    """Split and hash the texts (nulls have no words)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0]:offs[-1]] if raw is not None else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    parts, lo, n = [], 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK_BYTES, "right")) - 1)
        hi = min(max(hi, lo + 1), n)
        parts.append(_split_chunk(data[offs[lo]:offs[hi]], offs[lo:hi + 1], n_hashes))
        lo = hi
    if not parts:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, [np.zeros(0, U) for _ in range(n_hashes)], np.zeros(1, np.int64))
    counts = np.concatenate([p[3] for p in parts])
    return Words(data, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]),
                 [np.concatenate([p[2][k] for p in parts]) for k in range(n_hashes)],
                 np.concatenate([[0], np.cumsum(counts)]))


def _split_chunk(b: np.ndarray, offs: np.ndarray, n_hashes: int):
    base, rel = offs[0], offs - offs[0]
    n = len(b)
    ok = ~_SPACE[b]
    first = ok.copy()
    first[1:] &= ~ok[:-1]
    inner = rel[:-1][rel[:-1] < n]
    first[inner] = ok[inner]
    start = np.flatnonzero(first)
    last = ok.copy()
    last[:-1] &= ~ok[1:]
    ends = rel[1:] - 1
    ends = ends[ends >= 0]
    last[ends] = ok[ends]
    end = np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(start, rel))
    hashes = []
    if len(start):
        lengths = (end - start).astype(U)
        nxt = np.append(start[1:], n)
        pos = np.arange(start[0], n, dtype=np.int64)
        pos -= np.repeat(start, nxt - start)
        body = b[start[0]:]
        longest = int(pos.max()) + 1
        for k in range(n_hashes):
            v = _TABLES[k][body]
            v *= _power_table(k, longest)[pos]
            hashes.append(mix(np.add.reduceat(v, start - start[0]) + lengths * U(0x9E3779B97F4A7C15)))
    else:
        hashes = [np.zeros(0, U) for _ in range(n_hashes)]
    return start + base, end + base, hashes, counts


def windows(h: np.ndarray, width: int, k: int = 0) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive entries of ``h`` (those across documents included)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    q = powers(_WINDOW_BASES[k], width)
    if width <= 8:
        w = h[:n] * q[0]
        for j in range(1, width):
            w += h[j:j + n] * q[j]
    else:  # doubling: the runs of 1, 2, 4, ... entries, put together by the binary digits of the width
        run, size, at, w = h, 1, 0, None
        while True:
            if width & size:
                part = run[at:at + n] * q[at]
                w = part if w is None else w + part
                at += size
            if 2 * size > width:
                break
            run = run[:len(run) - size] + run[size:] * q[size]
            size *= 2
    return mix(w)


def window_starts(offsets: np.ndarray, width: int) -> np.ndarray:
    """Which positions begin a window inside one document; as long as the result of ``windows``."""
    n = int(offsets[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n + width, bool)
    for j in range(1, width):  # the last width-1 words of each document begin none
        at = offsets[1:] - j
        at = at[at >= offsets[:-1]]
        ok[at] = False
    return ok[:n]
