"""Hashes of all words of many texts at once, in numpy.

A to Z are lower-cased; words are runs without ASCII white space, so they are what `bytes.lower().split()` gives.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash

_M1, _M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one at a time.
LONG = 64
#: Characters of the texts that are hashed together: about 50 bytes of arrays each; a longer text is a part of its own.
PART_CHARS = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def hash_runs(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run data[start:end] of one byte or more; eight bytes at least must follow the last run in data.

    Runs of eight bytes or fewer never share a hash with one of their length.
    """
    size = ends - starts
    blocks = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        h = mix((blocks[starts] & _MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * M3)
        more = np.flatnonzero((size > 8) & (size <= LONG))
        k = 8
        while len(more):
            h[more] = mix(h[more] * M3 + (blocks[starts[more] + k] & _MASKS[np.minimum(size[more] - k, 8)]))
            k += 8
            more = more[size[more] > k]
    for at in np.flatnonzero(size > LONG).tolist():
        h[at] = xxhash.xxh3_64_intdigest(data[starts[at] : ends[at]])
    return h


def batch_words(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word of all texts in order, first word of each text and the end, first word of each line of all texts and the end).

    Null texts count as empty. A line belongs to one text.
    """
    raw = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    data = b"\n".join([*raw, b"\0" * 8])
    flat = np.frombuffer(data, np.uint8)
    n = len(flat) - 8
    begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)]).astype(np.int64)
    # Where white space and words take turns; the text before the first and after the last byte counts as white space.
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SPACE[flat[:n]]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    h = hash_runs(data, starts, ends)
    lines = np.searchsorted(starts, np.concatenate([[0], np.flatnonzero(flat[:n] == 10) + 1]))
    return h, np.searchsorted(starts, begins), lines


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on."""
    with np.errstate(over="ignore"):
        m = max(0, len(h) - n + 1)
        out = h[:m].copy()
        for k in range(1, n):
            out *= M3
            out += h[k : m + k]
        return mix(out + np.uint64(n))


def in_parts(batches: Iterable[pd.DataFrame], column: str = "text") -> Iterator[pd.DataFrame]:
    """The batches in consecutive parts of some PART_CHARS characters, whole rows each."""
    for batch in batches:
        at = np.cumsum([len(t) if t else 0 for t in batch[column]], dtype=np.int64) // PART_CHARS
        cuts = (np.flatnonzero(np.diff(at)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            yield batch.iloc[a:b]


def shingle_sets(texts: Iterable[str | None], n: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; of all its words if it has fewer, none if it has no words."""
    h, docs, _ = batch_words(texts)
    g = grams(h, n)
    for a, b in zip(docs[:-1].tolist(), docs[1:].tolist(), strict=True):
        yield np.unique(g[a : b - n + 1] if b - a >= n else grams(h[a:b], b - a))
