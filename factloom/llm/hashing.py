"""Work on many texts at once: their words, hashes of many strings, and the memory that such arrays take."""

from __future__ import annotations

import ctypes
from contextlib import suppress
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


@cache
def reuse_freed_memory(most: int = 64 << 20) -> None:
    """Has the C library keep so many freed bytes at hand. By default it gives the memory of each batch's arrays back and fetches it anew, which
    costs as much as a third of the work. Where there is no such call, nothing changes."""
    with suppress(OSError, AttributeError):
        library = ctypes.CDLL(None)
        for option in (-1, -3):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
            library.mallopt(option, most)


def ascii_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (between ASCII white space, A-Z lower-cased) of all texts, null as empty, and the place of each text's first word and the end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, at = lists.values, lists.offsets.to_numpy()
    real = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real), upto[at]


def string_hashes(strings: pa.Array, step: int = 1 << 17) -> np.ndarray:
    """A 64-bit polynomial hash of each of an array of non-empty strings, so many at a time."""
    out = np.empty(len(strings), np.uint64)
    if not len(strings):
        return out
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(strings.buffers()[2], np.uint8)
    powers = np.cumprod(np.full(int(np.diff(offsets).max()), GOLDEN))
    for at in range(0, len(out), step):
        mine = offsets[at : at + step + 1]
        starts, size = mine[:-1] - mine[0], np.diff(mine)
        x = BYTE_CODE[data[mine[0] : mine[-1]]]
        x *= powers[np.arange(len(x)) - np.repeat(starts, size)]
        out[at : at + step] = mix(np.add.reduceat(x, starts) + size.astype(np.uint64))
    return out
