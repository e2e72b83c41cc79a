"""SuperMinHash signatures of word shingles, a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: An odd multiplier; its powers and their inverses modulo 2^64 give hashes of byte ranges from one running sum.
BASE = 0x9E3779B97F4A7C15


def portions(texts: pa.Array, rows: int = 1000, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of at most `rows` texts and about `size` bytes, so that long texts don't swell what is held; one text is never cut."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or held + n > size):
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of BASE and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            step = np.full(size, BASE, U)
            back = np.full(size, pow(BASE, -1, 1 << 64), U)
            step[0] = back[0] = 1
            with np.errstate(over="ignore"):
                self.up, self.down = np.multiply.accumulate(step), np.multiply.accumulate(back)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of `words` words, the text each is from, and the words of each text.

    data: bytes of the texts, whose words are parted by single blanks without blanks at the ends; offsets: their bounds.
    """
    low, high = int(offsets[0]), int(offsets[-1])
    data, offsets = data[low:high], offsets - low
    n, texts = len(data), len(offsets) - 1
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    if not len(filled):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(texts, np.int64)
    up, down = POWERS.upto(n + 1)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum((data.astype(U) + U(1)) * up[:n], out=sums[1:])
    gaps = np.flatnonzero(data == 32)
    starts = np.concatenate([offsets[filled], gaps + 1])
    ends = np.concatenate([offsets[filled + 1], gaps])
    starts.sort()
    ends.sort()
    token = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))
    of = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(of, minlength=texts)
    if len(token) < words:
        return np.zeros(0, U), np.zeros(0, np.int64), counts
    size = len(token) - words + 1
    value = np.zeros(size, U)
    for k in range(words):
        value = value * U(BASE) + token[k : k + size]
    same = of[:size] == of[words - 1 :]
    return mixed(value[same]), of[:size][same], counts


def signatures(elements: np.ndarray, of: np.ndarray, texts: int, lanes: int) -> np.ndarray:
    """SuperMinHash: (texts, lanes) of uint64, round number in the upper bits and a random fraction below.

    In round j every element of a text draws the j-th lane of its own random permutation (a Fisher-Yates step), so that its
    ranks over the lanes are correlated and none repeats; a text stops when each of its lanes holds a value of an earlier
    round, as no later one can be smaller. Texts without elements keep the largest value everywhere.
    """
    top = np.iinfo(U).max
    table = np.full(texts * lanes, top, U)
    perm = np.tile(np.arange(lanes, dtype=np.uint8 if lanes <= 256 else np.uint16), (len(elements), 1))
    row = np.arange(len(elements))
    for j in range(lanes):
        draw = mixed(elements + U((j * 2 + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1))
        k = j + ((draw >> U(44)) % U(lanes - j)).astype(np.int64)
        lane = perm[row, k]
        perm[row, k] = perm[:, j]
        value = (U(j) << U(48)) | (draw & U((1 << 48) - 1))
        np.minimum.at(table, of * lanes + lane, value)
        open_ = (table.reshape(texts, lanes) >= U((j + 1) << 48)).any(axis=1)
        keep = open_[of]
        if not keep.any():
            break
        if not keep.all():
            elements, of, perm = elements[keep], of[keep], perm[keep]
            row = np.arange(len(elements))
    return table.reshape(texts, lanes)


def band_keys(table: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) of int64: a hash of each band's lanes and its number."""
    out = np.empty((len(table), bands), U)
    for b in range(bands):
        key = np.full(len(table), b + 1, U)
        for r in range(rows):
            key = mixed(key * U(BASE) + table[:, b * rows + r])
        out[:, b] = key
    return out.view(np.int64)


def sketch(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each of the first 64 lanes, as two int64."""
    bits = mixed(table[:, :64])
    place = U(1) << np.arange(64, dtype=U)
    return tuple((((bits >> U(s)) & U(1)) * place).sum(axis=1, dtype=U).view(np.int64) for s in (7, 29))
