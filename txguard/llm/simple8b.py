"""Simple-8b word-aligned coding of ids.

A 64-bit word has a 4-bit selector above a payload of up to 60 bits, which holds as
many ids of equal width as the selector says, the first one lowest. Selector 0 is
the escape: its payload is a place in the block's list of ids that need more than
60 bits. Selector 1 stands for 240 zeros. A block starts with four numbers (ids,
words, escapes, and STRIDE), then come the words, the escaped ids, and for every
STRIDE-th word the number of ids before it, so that decoding can start there.
"""

from __future__ import annotations

import numpy as np

WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
STRIDE = 1024
ZEROS = 240
_HEADER = np.dtype("<u4")


def _counts() -> np.ndarray:
    """Ids per word, by selector."""
    return np.array([1, ZEROS, *(60 // w for w in WIDTHS)])


def _levels(ids: np.ndarray) -> np.ndarray:
    """For each id the place in WIDTHS of the least width that holds it; their number if none does."""
    if ids.dtype.itemsize == 2:
        bounds = np.searchsorted([1 << w for w in WIDTHS], np.arange(1 << 16), "right").astype(np.uint8)
        return bounds[ids]
    return np.searchsorted(np.array([1 << w for w in WIDTHS], np.uint64), ids.astype(np.uint64), "right").astype(np.uint8)


def _selectors(levels: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """At each place, the selector of the word that would start there and take the most ids."""
    n = len(levels)
    found = np.where(levels < len(WIDTHS), len(WIDTHS) + 1, 0).astype(np.uint8)
    largest, size = levels, 1
    for level in range(len(WIDTHS) - 2, -1, -1):
        count = 60 // WIDTHS[level]
        if count > n:
            break
        while size < count:
            step = min(size, count - size)
            largest, size = np.maximum(largest[: len(largest) - step], largest[step:]), size + step
        fits = largest <= level
        if not fits.any():
            break
        found[: len(fits)][fits] = level + 2
    if n - np.count_nonzero(ids) >= ZEROS:
        filled = np.concatenate([[0], np.cumsum(ids != 0)])
        found[: n - ZEROS + 1][filled[ZEROS:] == filled[:-ZEROS]] = 1
    return found


def encode(ids: np.ndarray) -> bytes:
    """One block with all ``ids`` (unsigned integers)."""
    counts = _counts()
    levels = _levels(ids)
    selectors = _selectors(levels, ids)
    steps = counts[selectors].tolist()
    places, at, n = [], 0, len(ids)
    while at < n:
        places.append(at)
        at += steps[at]
    start = np.array(places, np.int64)
    chosen = selectors[start] if n else selectors
    words = chosen.astype(np.uint64) << np.uint64(60)
    escaped = chosen == 0
    words[escaped] |= np.arange(escaped.sum(), dtype=np.uint64)
    for level, width in enumerate(WIDTHS):
        here = np.flatnonzero(chosen == level + 2)
        for k in range(60 // width if len(here) else 0):
            words[here] |= ids[start[here] + k].astype(np.uint64) << np.uint64(k * width)
    header = np.array([n, len(words), escaped.sum(), STRIDE], _HEADER)
    raw = ids[start[escaped]].astype("<u8") if n else ids.astype("<u8")
    return header.tobytes() + words.astype("<u8").tobytes() + raw.tobytes() + start[::STRIDE].astype("<u8").tobytes()


def decode(block: bytes, first: int = 0) -> np.ndarray:
    """The ids of a block as 64-bit numbers, from its word ``first * STRIDE`` on."""
    n, size, escapes, stride = np.frombuffer(block, _HEADER, 4).tolist()
    words = np.frombuffer(block, "<u8", size, 16)
    raw = np.frombuffer(block, "<u8", escapes, 16 + 8 * size)
    begin = int(np.frombuffer(block, "<u8", -1, 16 + 8 * (size + escapes))[first]) if first else 0
    words, n = words[first * stride :], n - begin
    chosen = (words >> np.uint64(60)).astype(np.int64)
    taken = _counts()[chosen]
    start = np.cumsum(taken) - taken
    out = np.zeros(n + ZEROS, np.uint64)
    payload = words & np.uint64((1 << 60) - 1)
    for level, width in enumerate(WIDTHS):
        here = np.flatnonzero(chosen == level + 2)
        for k in range(60 // width if len(here) else 0):
            out[start[here] + k] = payload[here] >> np.uint64(k * width) & np.uint64((1 << width) - 1)
    here = np.flatnonzero(chosen == 0)
    out[start[here]] = raw[payload[here].astype(np.int64)]
    return out[:n]
