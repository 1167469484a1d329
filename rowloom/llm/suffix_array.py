"""Suffix arrays by two-stage sorting.

Suffixes smaller than their successor are sorted directly. All others are induced: scanning the buckets from the left, each
suffix found places the one that begins a byte before it at the head of that one's bucket, if that one is larger than its
successor. Adjacent common prefixes then show equal strings of a given length.
"""

from __future__ import annotations

import numpy as np

#: Ends each of the joined strings; no UTF-8 text has this byte.
STOP = 0xFF


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the end counts as smallest."""
    n = len(text)
    small = np.zeros(n, dtype=bool)
    differs = np.flatnonzero(text[:-1] != text[1:])
    if len(differs):
        at = np.searchsorted(differs, np.arange(n - 1))
        inside = at < len(differs)
        d = differs[np.minimum(at, len(differs) - 1)]
        small[:-1] = inside & (text[d] < text[d + 1])
    return small


STEP = 5
KEY_BITS = 41  # of STEP symbols of 257 kinds


def sort_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Order suffixes by their first ``depth`` bytes, STEP bytes at a time, going on with ties only."""
    symbols = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(depth + 2 * STEP, dtype=np.uint64)])
    keys = np.zeros(len(symbols) - STEP, dtype=np.uint64)  # of the STEP bytes from each place on
    for j in range(STEP):
        keys *= np.uint64(257)
        keys += symbols[j : j + len(keys)]
    order = at.copy()
    todo, group = np.arange(len(at)), np.zeros(len(at), dtype=np.uint64)  # places in the order, and which of them tie
    for step in range(0, depth, STEP):
        if not len(todo):
            break
        k = keys[order[todo] + step]
        by = np.argsort(group << np.uint64(KEY_BITS) | k) if len(todo) < 1 << 64 - KEY_BITS else np.lexsort((k, group))
        order[todo], k = order[todo][by], k[by]  # ties are neighbours, so that groups stay where they are
        new = np.append(True, (group[1:] != group[:-1]) | (k[1:] != k[:-1]))
        tied = ~(new & np.append(new[1:], True))
        todo = todo[tied]
        group = (np.cumsum(new) - 1).astype(np.uint64)[tied]
        if len(group):
            group = np.cumsum(np.append(False, group[1:] != group[:-1])).astype(np.uint64)
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (uint8) in the order of their first ``depth`` bytes: an induced suffix is at least as well in order as
    the one after it."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    small = smaller_than_next(text)
    direct = sort_directly(text, np.flatnonzero(small), depth)
    sizes = np.bincount(text, minlength=256)
    ends = np.cumsum(sizes)
    out = np.full(n, -1, dtype=np.int64)
    held = np.bincount(text[direct], minlength=256)
    tails = ends - held  # in a bucket the directly sorted suffixes come last
    firsts = np.cumsum(held) - held
    of = text[direct]
    out[tails[of] + np.arange(len(direct)) - firsts[of]] = direct
    starts = ends - sizes
    heads = starts.copy()  # where each bucket's next induced suffix goes
    out[heads[text[-1]]] = n - 1  # before nothing: the least of its bucket
    heads[text[-1]] += 1

    def induce(found: np.ndarray) -> None:
        """Place those that begin a byte before ``found`` and are larger than these."""
        j = found[found > 0] - 1
        j = j[~small[j]]
        order = np.argsort(text[j], kind="stable")
        j, more = j[order], np.bincount(text[j], minlength=256)
        c = text[j]
        out[heads[c] + np.arange(len(j)) - (np.cumsum(more) - more)[c]] = j
        heads[:] += more

    for c in np.flatnonzero(sizes).tolist():
        done = starts[c]
        while done < heads[c]:  # a run of one byte fills its own bucket on
            part, done = out[done : heads[c]], heads[c]
            induce(part)
        induce(out[tails[c] : ends[c]])
    return out


def equal_runs(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """For suffixes ``at`` in suffix order: the number of their class, where classes agree in the first ``length`` bytes."""
    if not len(at):
        return np.zeros(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    same = np.zeros(len(at), dtype=bool)
    for i in range(1, len(at), 100_000):
        j = min(len(at), i + 100_000)
        same[i:j] = (view[at[i:j]] == view[at[i - 1 : j - 1]]).all(axis=1)
    return np.cumsum(~same) - 1
