"""Words and rolling hashes over the bytes of a chunk, as numpy arrays."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all 64."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def kgram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k symbols in a row, at the place of the first; len(symbols) - k + 1 of them."""
    have, size = symbols, 1
    for bit in bin(k)[3:]:
        have = have[: len(have) - size] * np.uint64(pow(int(BASE), size, 2**64)) + have[size:]
        size *= 2
        if bit == "1":
            have = have[: len(have) - 1] * BASE + symbols[size : size + len(have) - 1]
            size += 1
    return mix(have)


def slide(a: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over a[i : i + width] for each i that has as many."""
    size = 1
    while 2 * size <= width:
        a = op(a[:-size], a[size:])
        size *= 2
    return op(a[: len(a) - width + size], a[width - size :]) if size < width else a


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word `[^\\x20\\x09-\\x0D]+`, and where each document's words begin.

    A document's end ends a word.
    """
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes, with A-Z as a-z if lower."""
    out = np.empty(len(starts), np.uint64)
    table = BYTE[LOWER] if lower else BYTE
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + 4 * BLOCK, "right")))
        lo, hi = int(starts[at]), int(ends[stop - 1])
        power = np.full(hi - lo, BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.add.accumulate(table[data[lo:hi]] * power, out=total[1:])
        undo = np.full(hi - lo, BASE_INVERSE, np.uint64)
        undo[0] = 1
        np.multiply.accumulate(undo, out=undo)
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        out[at:stop] = mix((total[e] - total[s]) * undo[s] + (e - s).astype(np.uint64))
        at = stop
    return out


def minimizers(symbols: np.ndarray, bounds: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors: places whose k symbols have the least hash of any w in a row; and these hashes.

    Every k + w - 1 symbols in a row of one document hold an anchor among their first w places, chosen by
    these symbols alone, so equal windows have equal anchors. All places with the least hash count.
    ``bounds``: where each document begins, and the end of the last.
    """
    n, span = len(symbols), k + w - 1
    places, hashes = [], []
    for at in range(0, max(0, n - k + 1), BLOCK):
        lo, hi = max(0, at - w + 1), min(n, at + BLOCK + span - 1)
        part = symbols[lo:hi]
        if len(part) < span:
            continue
        h = kgram_hashes(BYTE[part] if part.dtype == np.uint8 else part, k)
        least = slide(h, w, np.minimum)
        for cut in bounds[np.searchsorted(bounds, lo, "right") : np.searchsorted(bounds, hi, "left")].tolist():
            least[max(0, cut - lo - span + 1) : cut - lo] = 0
        most = slide(np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w, np.maximum)
        found = np.flatnonzero((h == most) & (most > 0))
        found = found[(found + lo >= at) & (found + lo < at + BLOCK)]
        places.append(found + lo)
        hashes.append(h[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def window_runs(symbols: np.ndarray, bounds: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows of k + w - 1 symbols, as (first window, windows), and the hash of the anchor of each run.

    A window's anchor is the first of those of its first w places whose k symbols have the least hash (by 44 bits), so
    equal windows have equal anchors, and each window of a document is in one run.
    """
    n, span, low = len(symbols), k + w - 1, np.uint64((1 << 20) - 1)
    runs, hashes = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.uint64)]
    for at in range(0, max(0, n - span + 1), BLOCK):
        part = symbols[at : min(n, at + BLOCK + span - 1)]
        h = kgram_hashes(part, k)
        least = slide((h & ~low) | np.arange(len(h), dtype=np.uint64), w, np.minimum) & low
        whole = np.ones(len(least) + 1, bool)
        whole[-1] = False
        for cut in bounds[np.searchsorted(bounds, at, "right") : np.searchsorted(bounds, at + len(part), "left")].tolist():
            whole[max(0, cut - at - span + 1) : cut - at] = False
        new = whole[:-1].copy()
        new[1:] &= ~whole[:-2] | (least[1:] != least[:-1])
        first = np.flatnonzero(new)
        ends = np.flatnonzero(whole[:-1] & ~(whole[1:] & ~np.append(new[1:], True))) + 1
        runs.append(np.stack([first + at, ends - first], axis=1))
        hashes.append(h[least[first].astype(np.int64)])
    return np.concatenate(runs), np.concatenate(hashes)
