"""Words and their hashes for many texts at once, in numpy.

A word is a run of ASCII letters, digits and bytes of multi-byte characters; A-Z and the capitals of Latin-1 count as small.
Hashes come from prefix sums of a polynomial over the bytes, modulo 2^64, so a word's value depends on its bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDY = np.zeros(256, bool)
WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
PRIME = 0x100000001B3
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Scan:
    """Word bounds of joined texts: starts, ends (in bytes of the joined text), and bounds: the first word of each text, and the end."""

    def __init__(self, texts: list[bytes]):
        raw = LOWERED[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        capital = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97))
        raw[capital + 1] |= 0x20
        edge = np.flatnonzero(np.diff(np.concatenate(([False], WORDY[raw], [False])).view(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.bounds = np.searchsorted(self.starts, np.concatenate(([0], np.cumsum(sizes))))
        power = _powers(PRIME, len(raw))
        self.sums = np.concatenate((np.zeros(1, U), np.cumsum((raw.astype(U) + U(1)) * power)))
        self.back = _powers(pow(PRIME, -1, 1 << 64), len(raw))[self.starts]

    def hashes(self, first_bytes: int = 1 << 40, salt: int = 0) -> np.ndarray:
        """A hash of each word's first bytes."""
        upto = np.minimum(self.ends, self.starts + first_bytes)
        return mix((self.sums[upto] - self.sums[self.starts]) * self.back + U(salt))


def pieces(text: bytes, chunk: int, overlap: int = 0) -> Iterator[bytes]:
    """A text cut at spaces into about ``chunk`` bytes, each piece from ``overlap`` words before its cut on."""
    start = 0
    while len(text) - start > chunk:
        cut = text.find(b" ", start + chunk)
        if cut < 0:
            break
        yield text[start:cut]
        span, before = 4096, start
        start = cut
        while overlap:  # back to where the last words before the cut begin
            low = max(before, cut - span)
            wordy = WORDY[np.frombuffer(text, np.uint8, cut - low, low)]
            begins = np.flatnonzero(wordy[1:] & ~wordy[:-1]) + 1
            if len(begins) >= overlap:
                start = low + int(begins[-overlap])
                break
            if low == before:
                break
            span *= 8
    yield text[start:]


def grouped(texts: list[bytes], chunk: int = 2 << 20, overlap: int = 0) -> Iterator[tuple[list[int], list[bytes]]]:
    """(owners, pieces) of about ``chunk`` bytes each: several texts together, or a part of a long one."""
    owners, group, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text, chunk, overlap):
            owners.append(i)
            group.append(piece)
            size += len(piece) + 1
            if size >= chunk:
                yield owners, group
                owners, group, size = [], [], 0
    if group:
        yield owners, group


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The word hashes of each text, in order."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for owners, group in grouped(texts):
        scan = Scan(group)
        found = scan.hashes()
        for k, owner in enumerate(owners):
            parts[owner].append(found[scan.bounds[k] : scan.bounds[k + 1]])
    return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, U) for p in parts]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of ``size`` words; of all words together if there are fewer, and none if there is no word."""
    if not len(words):
        return np.zeros(0, U)
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, U)
    for i in range(size):
        out = out * U(0x9E3779B97F4A7C15) + words[i : len(words) - size + 1 + i]
    return mix(out)


def occurrences(values: np.ndarray) -> np.ndarray:
    """For each value, how many equal ones stand before it."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(values) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(values)), 0)) if len(values) else np.zeros(0, int)
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - first
    return out
