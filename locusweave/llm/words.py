"""Vectorised word and word-window hashing over byte buffers.

A word has two 64-bit hashes.  Words of up to seven bytes are one integer (bytes and length), which two bijective mixers
turn into the hashes, so such words never collide; longer ones take the two halves of their XXH3-128.  Windows are
hashed by doubling: a run of 2k words mixes the hashes of its two runs of k, so no window hash is a linear sum that
texts could be made to cancel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SHORT = 7  # bytes of a word that is its own integer
_MASK = np.array([(1 << 8 * n) - 1 for n in range(_SHORT + 1)], np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit words (splitmix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(docs: list[bytes], space: np.ndarray = _SPACE):
    """(joined docs, start and stop of every word in it, two hashes of every word, number of words of each doc)."""
    joined = b" ".join([*docs, b"       "])
    buf = np.frombuffer(joined, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space[buf])).view(np.int8)))
    start, stop = edge[0::2], edge[1::2]
    size = stop - start
    first = np.ndarray(len(buf) - 7, "<u8", joined, strides=(1,))[np.minimum(start, len(buf) - 8)]  # the eight bytes from each start on
    short = np.minimum(size, _SHORT)
    value = (first & _MASK[short]) | (short.astype(np.uint64) << np.uint64(56))
    h, g = mix(value), mix(value, 1)
    long = np.flatnonzero(size > _SHORT)
    if len(long):
        digest = xxhash.xxh3_128_digest
        both = np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(start[long].tolist(), stop[long].tolist())]), np.uint64)
        h[long], g[long] = both[0::2], both[1::2]
    ends = np.cumsum([len(d) + 1 for d in docs], dtype=np.int64)
    return joined, start, stop, h, g, np.diff(np.searchsorted(start, ends, "left"), prepend=0)


def word_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two 64-bit hashes of every word of all docs in order, number of words of each doc)."""
    return word_spans(docs)[3:]


def _joined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix(a ^ mix(b, salt + 2) * np.uint64(0xD6E8FEB86659FD93), salt)


def window_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive entries of h (runs over document ends too), by doubling."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    runs, size = h, 1
    for bit in bin(k)[3:]:
        runs, size = _joined(runs[:-size], runs[size:], salt), 2 * size
        if bit == "1":
            runs, size = _joined(runs[:-1], h[size:], salt), size + 1
    return runs


def inside(count: np.ndarray, k: int) -> np.ndarray:
    """Mask over window starts: the k words from there lie in one document."""
    total = int(count.sum())
    if total < k:
        return np.zeros(0, bool)
    ok = np.ones(total - k + 1, bool)
    for end in np.cumsum(count)[:-1]:
        ok[max(0, end - k + 1) : end] = False
    return ok


def minimizers(h: np.ndarray, span: int) -> np.ndarray:
    """For each run of span consecutive entries of h the index of its least (first of equals)."""
    n = len(h) - span + 1
    best, at = h[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span):
        c = h[j : j + n]
        less = c < best
        np.copyto(best, c, where=less)
        at[less] = j
    return at + np.arange(n)


def chunks(docs: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first doc, docs) in runs of about size bytes, to stay in cache."""
    begin, held = 0, 0
    for i, d in enumerate(docs):
        if held and held + len(d) > size:
            yield begin, docs[begin:i]
            begin, held = i, 0
        held += len(d) + 1
    if begin < len(docs):
        yield begin, docs[begin:]
