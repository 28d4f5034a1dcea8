"""Matching blocks of many pairs of texts at once, as ``difflib.SequenceMatcher`` finds them."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: From this length on the library leaves frequent letters out; such texts are left to it.
LONG = 200
#: Stretches compared at once.
STRETCHES = 2048


def padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts by row, shorter ones filled up, and the lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), max(1, int(size.max(initial=0)))), np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return out, size


def _longest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each column the longest common stretch of ``x`` and ``y``: its start in both and its length; the first in x, then in y, counts."""
    behind = (255 - np.arange(len(y), dtype=np.uint16))[:, None]  # a length times 256, and the more the earlier in y
    runs, more = np.zeros((len(y) + 1, x.shape[1]), np.uint16), np.zeros(y.shape, np.uint16)
    best, end = np.zeros(x.shape[1], np.uint16), np.zeros(x.shape[1], np.int64)
    for i in range(len(x)):
        np.add(runs[:-1], 256, out=more)
        np.multiply(more, y == x[i], out=runs[1:])
        np.add(runs[1:], behind, out=more)
        top = more.max(0)
        longer = (top >> 8) > (best >> 8)
        best[longer], end[longer] = top[longer], i
    size = (best >> 8).astype(np.int64)
    return end - size + 1, 255 - (best & 255).astype(np.int64) - size + 1, size


def matched(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Letters in the matching blocks of each pair of rows; where ``need`` can't be reached, some number below it."""
    total = np.zeros(len(a), np.int64)
    pair, zero = np.arange(len(a)), np.zeros(len(a), np.int64)
    work = np.stack((pair, zero, na, zero, nb))
    while work.shape[1]:
        pair, a0, a1, b0, b1 = work
        most = np.bincount(pair, np.minimum(a1 - a0, b1 - b0), len(a))
        work = work[:, (total + most >= need)[pair] & (a1 > a0) & (b1 > b0)]
        work = work[:, np.argsort((work[2] - work[1]) * (work[4] - work[3]), kind="stable")]
        rest = []
        for at in range(0, work.shape[1], STRETCHES):
            pair, a0, a1, b0, b1 = part = work[:, at : at + STRETCHES]
            i, j = (np.arange((hi - lo).max())[:, None] for lo, hi in ((a0, a1), (b0, b1)))
            x = np.where(i < a1 - a0, a[pair, np.minimum(a0 + i, a.shape[1] - 1)], -1)
            y = np.where(j < b1 - b0, b[pair, np.minimum(b0 + j, b.shape[1] - 1)], -2)
            i, j, size = _longest(x, y)
            i, j = a0 + i, b0 + j
            total += np.bincount(pair, size, len(a)).astype(np.int64)
            some = size > 0
            rest += [np.stack((pair, a0, i, b0, j))[:, some], np.stack((pair, i + size, a1, j + size, b1))[:, some]]
        work = np.concatenate(rest, 1) if rest else work[:, :0]
    return total


def best_ratios(texts: list[str], r: np.ndarray, c: np.ndarray, least: float, at_once: int = 1 << 15) -> np.ndarray:
    """The ratio of each pair of texts in the better order of the two; below ``least`` it may be too small."""
    codes, size = padded([t if len(t) < LONG else "" for t in texts])
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros(len(r))
    for at in range(0, len(r), at_once):
        x, y = r[at : at + at_once], c[at : at + at_once]
        both = length[x] + length[y]
        need = np.ceil(least * both / 2 - 1e-9)
        m = np.maximum(matched(codes[x], size[x], codes[y], size[y], need), matched(codes[y], size[y], codes[x], size[x], need))
        out[at : at + at_once] = 2.0 * m / np.maximum(both, 1)
    for k in np.flatnonzero((length[r] >= LONG) | (length[c] >= LONG)):
        x, y = texts[r[k]], texts[c[k]]
        out[k] = max(SequenceMatcher(None, x, y).ratio(), SequenceMatcher(None, y, x).ratio())
    return out
