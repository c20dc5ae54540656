"""Suffix sorting by words of eight bytes, for many short texts at once.

An MSD radix sort: the suffixes of all groups are sorted by their first word, those that are alike so far by their next one, and so on. A suffix that has no
like leaves at once, and suffixes that all share a word are not sorted by it, so only what repeats is read to its end. Words are compared as they are, no hashes.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def opens(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def equal_classes(text: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """A class number for each start: equal exactly for starts of one group whose depth bytes are equal."""
    words = np.ndarray(len(text) + 1, ">u8", np.concatenate([text, np.zeros(WORD, np.uint8)]), 0, (1,))
    out = np.arange(len(starts)) + len(starts)
    rest = np.argsort(group, kind="stable")
    new = opens(group[rest])
    for at in range(0, depth, WORD):
        alone = new & np.append(new[1:], True)
        rest, new = rest[~alone], new[~alone]
        if not len(rest):
            return out
        word = words[starts[rest] + at].astype(np.uint64) >> np.uint64(8 * max(0, at + WORD - depth))
        run = np.cumsum(new) - 1
        first = word[np.flatnonzero(new)]
        mixed = np.zeros(len(first), bool)
        mixed[run[word != first[run]]] = True
        part = np.flatnonzero(mixed[run])
        by = part[np.lexsort((word[part], run[part]))]
        rest[part], word[part] = rest[by], word[by]
        new |= opens(word)
    out[rest] = np.cumsum(new)
    return out
