"""Adjacent equal blocks of a text.

A block of `least` characters or more that stands twice in a row shows as a window of `least` characters which comes again at
the block's length. So windows are hashed and sorted, and only distances at which one comes again are looked at: for each, one
pass counts how far the text agrees with itself. A text without such a distance, most texts, is left after the sort.
Characters are counted as UTF-16 does.
"""

from __future__ import annotations

import numpy as np


def _windows(units: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows, by doubling: those of 16 from two of 8, and so on; unlike windows that share one do no harm."""
    base, have, width = np.uint64(0x9E3779B97F4A7C15), units.astype(np.uint64) + np.uint64(1), 1
    while 2 * width <= size:
        have = (have[:-width] ^ (have[:-width] >> np.uint64(29))) * base + have[width:]
        width *= 2
    more = size - width
    return (have[: len(have) - more] ^ (have[: len(have) - more] >> np.uint64(29))) * base + have[more:] if more else have


def distances(units: np.ndarray, least: int, most: int) -> np.ndarray:
    """Distances from least to most at which some window of `least` units comes again."""
    h = _windows(units, least)
    order = np.argsort(h, kind="stable")
    same, found = np.sort(h, kind="stable"), np.zeros(most + 1, bool)
    step = 1
    while step < len(order):
        alike = same[step:] == same[:-step]
        if not alike.any():
            break
        gap = (order[step:] - order[:-step])[alike]
        found[gap[(gap >= least) & (gap <= most)]] = True
        if (gap > most).all():
            break
        step += 1
    return np.flatnonzero(found)


def collapse(text: str, least: int = 20, most: int = 300) -> str:
    """One of adjacent equal blocks is left, from the start on; of blocks that begin at one place the longest counts."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    n = len(units)
    if n < 2 * least:
        return text
    longest, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in distances(units, least, most).tolist():
        differs = np.flatnonzero(np.append(units[:-d] != units[d:], True))
        agree = differs[np.searchsorted(differs, np.arange(n - d))] - np.arange(n - d)  # units that equal those d later, from each place on
        at = np.flatnonzero(agree >= d)
        longest[at] = d  # distances grow
        end[at] = at + d + agree[at] // d * d
    starts = np.flatnonzero(longest)
    if not len(starts):
        return text
    kept, done = [], 0
    k = 0
    while k < len(starts):
        i = int(starts[k])
        kept.append(units[done : i + int(longest[i])])
        done = int(end[i])
        k = int(np.searchsorted(starts, done))
    return np.concatenate([*kept, units[done:]]).tobytes().decode("utf-16-le", "surrogatepass")
