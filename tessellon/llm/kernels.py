"""Vectorised text kernels over Arrow string arrays: words, word hashes, shingle hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, found on the UTF-8 bytes (both sets are ASCII, so bytes
and code points agree). Memory stays near one chunk of bytes plus 8 bytes a word, whatever a text's length.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


#: What operators remember in a worker, by operator; each entry forgets it.
MEMORIES: dict = {}


#: About what a dictionary of strings to bytes holds for an entry besides the characters and bytes.
ENTRY = 190


class Remembered:
    """A plain dictionary (data; sets differ from it fast) of at most so many bytes; what comes after that isn't kept."""

    def __init__(self, most: int):
        self.data: dict[str, bytes] = {}
        self.room = most

    def keep(self, new: dict[str, bytes]) -> bool:
        """Whether all of it is kept, or none."""
        if self.room < ENTRY * len(new):
            return False
        size = sum(ENTRY + 2 * len(k) + len(v) for k, v in new.items())
        if size > self.room:
            return False
        self.room -= size
        self.data.update(new)
        return True


def forget(owner: str) -> None:
    """Drop what all other operators remember; a function of this module, so that it is the worker's own memory."""
    for name, drop in MEMORIES.items():
        if name != owner:
            drop()


def give_back() -> None:
    """Give freed memory back to the system, which a process that lives for long otherwise keeps."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def trimmed(run, owner: str = ""):
    """A function of batches that first forgets what other operators remember in this worker and, once it is through the batches,
    gives freed memory back to the system: workers wait for long."""

    def wrapped(batches):
        forget(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 256), _ROOT, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets of n + 1) of a string array; nulls are empty."""
    texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = texts.buffers()
    at = np.frombuffer(raw[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array, spans: bool = False):
    """(hash of each word, index of each text's first word, n + 1 long); with spans also each word's byte start and end."""
    data, at = buffers(texts)
    hashes, begins, ends = [], [], []
    s, n = 0, len(data)
    while s < n:
        e = min(n, s + CHUNK)
        while e < n:  # to the next end of a word or text
            window = data[e : e + CHUNK]
            stop = np.flatnonzero(_SPACE[window])
            k = np.searchsorted(at, e)
            to = min(stop[0] if len(stop) else CHUNK, (at[k] if k < len(at) else n) - e)
            e = min(n, e + int(to))
            if to < CHUNK:
                break
        b = _LOWER[data[s:e]]
        solid = ~_SPACE[b]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        edges = at[np.searchsorted(at, s, "left") : np.searchsorted(at, e, "left")] - s
        first[edges[solid[edges]]] = True
        idx = np.flatnonzero(solid)
        if len(idx):
            f = np.flatnonzero(first[idx])
            lengths = np.diff(np.append(f, len(idx)))
            start = idx[f]
            pos = idx - np.repeat(start, lengths)
            value = (b[idx].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[pos]
            hashes.append(mix(np.add.reduceat(value, f) + lengths.astype(np.uint64)))
            begins.append(start + s)
            ends.append(start + s + lengths)
        s = e
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    begin = cat(begins, np.int64)
    out = cat(hashes, np.uint64), np.searchsorted(begin, at)
    return (*out, begin, cat(ends, np.int64)) if spans else out


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every k-word shingle; a text of fewer words, but one at least, has its whole sequence as one."""
    counts = np.diff(first)
    n = len(hashes)
    doc = np.repeat(np.arange(len(counts)), counts)
    value = np.full(n, 0x51, np.uint64)
    left = np.repeat(first[1:], counts) - np.arange(n)  # words to the end of the text
    for i in range(k):
        take = np.minimum(np.arange(n) + i, max(n - 1, 0))
        step = mix(value * np.uint64(0xD6E8FEB86659FD93) + hashes[take] + np.uint64(i))
        value = np.where(left > i, step, value)
    whole = (left >= k) | (np.arange(n) == np.repeat(first[:-1], counts))
    return value[whole], doc[whole]


def distinct(value: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes, bounds of each text, n + 1 long)."""
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[keep], doc[keep]
    return value, np.searchsorted(doc, np.arange(n_docs + 1))
