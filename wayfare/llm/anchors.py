"""Content-chosen anchors: each window of a text is kept by one short gram of its own, the same wherever it stands."""

from __future__ import annotations

import numpy as np

from wayfare.llm.common import BYTE_BASE, BYTE_BASE_INVERSE, _power_table, mix

_PLACE = np.uint64(24)


class Rolling:
    """Hashes of any stretches of some bytes, from running sums."""

    def __init__(self, raw: np.ndarray):
        part = raw.astype(np.uint64) + np.uint64(1)
        part *= _power_table("up", BYTE_BASE, len(part))
        self.total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=self.total[1:])
        self.down = _power_table("down", BYTE_BASE_INVERSE, len(part) + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.total) - k
        return mix((self.total[k:] - self.total[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


#: Windows looked at together; longer texts are taken in stretches, whose borders only cut runs in two.
STRETCH = 1 << 19


def anchored(raw: np.ndarray, at: np.ndarray, window: int, k: int) -> dict[str, np.ndarray]:
    """Runs of windows with a common anchor, over the documents that `at` delimits.

    Each window's anchor is its gram of least hash, the first of equal ones. A run has: doc (index), lo and hi (its
    first and last window's start, within the document), anchor and segment (hashes of the gram and of all the run's
    bytes).
    """
    found = [_stretch(raw[low : low + STRETCH + window - 1], at, low, window, k) for low in range(0, max(1, len(raw) - window + 1), STRETCH)]
    return {c: np.concatenate([x[c] for x in found]) for c in found[0]}


def _stretch(raw: np.ndarray, at: np.ndarray, low: int, window: int, k: int) -> dict[str, np.ndarray]:
    n = len(raw) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return {"doc": none, "lo": none, "hi": none, "anchor": none, "segment": none}
    rolling = Rolling(raw)
    packed = (rolling.grams(k) >> _PLACE << _PLACE) | np.arange(len(raw) - k + 1, dtype=np.uint64)
    chosen = (sliding_min(packed, window - k + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    doc = np.searchsorted(at, np.arange(low, low + n), "right") - 1
    valid = np.arange(low, low + n) + window <= at[doc + 1]
    new = valid.copy()
    new[1:] &= (chosen[1:] != chosen[:-1]) | ~valid[:-1]
    end = valid.copy()
    end[:-1] &= (chosen[1:] != chosen[:-1]) | ~valid[1:]
    lo, hi = np.flatnonzero(new), np.flatnonzero(end)
    p, doc = chosen[lo], doc[lo]
    first = at[doc] - low
    keys = {"anchor": rolling.hash(p, p + k).view(np.int64), "segment": rolling.hash(lo, hi + window).view(np.int64)}
    return {"doc": doc, "lo": lo - first, "hi": hi - first, **keys}
