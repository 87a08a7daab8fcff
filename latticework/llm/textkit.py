"""Vectorised kernels on Arrow string buffers: chunks, word spans and hashes.

All of it works on whole texts: a chunk holds whole documents. A document that is longer
than a chunk comes alone and is cut into words slice by slice, so that what it takes besides
its bytes is a few numbers a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` well mixed 64-bit constants."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * _GOLD)


BASE = np.uint64(0x5851F42D4C957F2D)


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, offsets from 0); a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def blocks_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as a number; ``data`` is followed by eight zero bytes."""
    return np.ndarray((len(data) - 8,), "<u8", np.ascontiguousarray(data), strides=(1,))


_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def piece_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lanes: tuple[int, ...] = (0,)) -> np.ndarray:
    """Independent 64-bit hashes (lanes x pieces) of the pieces of ``data``; ``lanes`` are the numbers of the hashes wanted.

    Each eight bytes are mixed with all before them by a function that is not linear in them, so texts
    of special shape don't collide more often than others.
    """
    seeds = stream(max(lanes) + 1, 1)[list(lanes), None]
    out = mix(seeds ^ (sizes.astype(np.uint64) * _GOLD)[None])
    if not len(starts):
        return out
    view = blocks_of(np.concatenate((data, np.zeros(8, np.uint8))))
    live = np.flatnonzero(sizes > 0)
    at = 0
    while len(live):
        left = sizes[live] - at
        block = view[starts[live] + at] & _LOW_BYTES[np.minimum(left, 8)]
        if len(live) == out.shape[1]:
            out = mix((out ^ block) * _GOLD + seeds)
        else:
            out[:, live] = mix((out[:, live] ^ block) * _GOLD + seeds)
        at += 8
        live = live[left > 8]
    return out


def equal_pieces(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether each piece that starts at ``a`` has the bytes of that at ``b``."""
    view = blocks_of(np.concatenate((data, np.zeros(8, np.uint8))))
    live, at = np.flatnonzero((sizes > 0) & (a != b)), 0
    while len(live):
        left = sizes[live] - at
        keep = _LOW_BYTES[np.minimum(left, 8)]
        if (((view[a[live] + at] ^ view[b[live] + at]) & keep) != 0).any():
            return False
        at += 8
        live = live[left > 8]
    return True


def slices(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Parts of about ``limit`` bytes that begin at a white byte (a longer word stays whole)."""
    at = 0
    while at < len(data):
        end = at + limit
        while end < len(data):
            white = np.flatnonzero(WHITE[data[end : end + limit]])
            if len(white):
                end += int(white[0])
                break
            end += limit
        end = min(end, len(data))
        yield at, end
        at = end


def words(data: np.ndarray, offsets: np.ndarray, lanes: tuple[int, ...] = (0,)) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (lanes x words) of the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; number of words before each document (and in all)."""
    hashes, count, total = [np.zeros((len(lanes), 0), np.uint64)], np.zeros(len(offsets), np.int64), 0
    for lo, hi in slices(data, 2 * CHUNK):
        part = data[lo:hi]
        solid = ~WHITE[part]
        edge = np.concatenate(([True], ~solid[:-1]))
        inner = offsets[(offsets > lo) & (offsets < hi)] - lo
        edge[inner] = True
        first = solid & edge
        starts = np.flatnonzero(first)
        stop = ~solid
        stop[inner] = True
        ends = np.concatenate((np.flatnonzero(stop), [len(part)]))
        sizes = ends[np.searchsorted(ends, starts, "right")] - starts
        hashes.append(piece_hashes(LOWER[part], starts, sizes, lanes))
        here = (offsets > lo) & (offsets <= hi)
        count[here] = total + np.searchsorted(starts, offsets[here] - lo)
        total += len(starts)
    return np.concatenate(hashes, 1), count


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int, lane: int = 0) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each document, by one of two independent hashes.

    Fewer words than ``width``: the whole sequence as one; no word: empty.
    """
    (hashes,), bounds = words(data, offsets, (lane,))
    return _sets_of(hashes, bounds, width, lane)


def both_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """``shingle_sets`` by either hash."""
    (one, two), bounds = words(data, offsets, (0, 1))
    return _sets_of(one, bounds, width, 0), _sets_of(two, bounds, width, 1)


def _sets_of(hashes: np.ndarray, bounds: np.ndarray, width: int, lane: int) -> list[np.ndarray]:
    factor = stream(width, 2 + 20 * lane) | np.uint64(1)
    total = max(0, len(hashes) - width + 1)
    rolled = np.zeros(total, np.uint64)
    for k in range(width):
        rolled += hashes[k : k + total] * factor[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            n = b - a
            out.append(mix((hashes[a:b] * factor[:n]).sum(keepdims=True) + (np.full(1, n, np.uint64) * _GOLD)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
