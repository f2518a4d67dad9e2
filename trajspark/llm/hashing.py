"""Word and shingle hashes of many texts at a time, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

PIECE_BYTES = 1 << 19       # bytes worked on at a time; one text is never cut
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place where it can)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * PRIME)


def powers(n: int, _kept: list = []) -> np.ndarray:  # noqa: B006
    if not _kept or len(_kept[0]) < n:
        p = np.full(max(n, 1 << 12), PRIME, np.uint64)
        p[0] = 1
        _kept[:] = [np.multiply.accumulate(p)]
    return _kept[0]


def pieces(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    """The texts as bytes, in lists of bounded size."""
    out, size = [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if out and size + len(raw) > PIECE_BYTES:
            yield out
            out, size = [], 0
        out.append(raw)
        size += len(raw) + 1
    if out:
        yield out


def words(raw: list[bytes], prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words per text); words are what stands between white space bytes.

    ``prefix``: only this many leading bytes of each word count.
    """
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    bounds = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = ends - starts
    if prefix:
        lengths = np.minimum(lengths, prefix)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    value = BYTE[data[np.repeat(starts, lengths) + place]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64) * BYTE[7]), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``width`` words, shingles per text); a shorter text is one shingle, one without words none."""
    n = len(hashes)
    runs = np.zeros(n, np.uint64)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)          # words to the end of the text
    for k in range(width):
        inside = left > k
        at = np.flatnonzero(inside)
        runs[at] += (hashes[at + k] ^ BYTE[20 + k]) * (PRIME + np.uint64(2 * k)) ** np.uint64(k + 1)
    whole = np.maximum(counts - width + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    place = np.arange(n) - np.repeat(first, counts)
    return mix(runs[place < np.repeat(whole, counts)]), whole


def parts(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(counts)[:-1]) if len(counts) else []
