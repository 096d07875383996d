"""Words of many texts as 64-bit hashes, by numpy over the bytes of an Arrow column."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
#: Text bytes handled at once.
CHUNK_BYTES = 1 << 20


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, BASE, np.uint64)
    up[0] = 1
    down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(n, CHUNK_BYTES + (CHUNK_BYTES >> 1)).bit_length())


def mixed(h: np.ndarray) -> np.ndarray:
    """Each bit of a hash spread over all bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Words:
    """raw: all bytes; offsets: where texts begin and end; starts, ends: places of the words; n: words of each text; first: index of a text's first word."""

    def __init__(self, texts: pa.Array, lower: bool = False, letters: np.ndarray | None = None):
        """`letters` says for each byte whether words hold it; without it words end at white space."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        if lower:  # A-Z alone
            self.raw = self.raw + ((self.raw >= 65) & (self.raw <= 90)) * np.uint8(32)
        at = self.offsets = offsets - offsets[0]
        letter = ~((self.raw == 32) | ((self.raw >= 9) & (self.raw <= 13))) if letters is None else letters[self.raw]
        edge = np.zeros(len(self.raw) + 1, bool)
        edge[at] = True
        begins, stops = letter.copy(), letter.copy()
        if len(letter):
            begins[1:] &= ~letter[:-1] | edge[1:-1]
            stops[:-1] &= ~letter[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        upto = np.searchsorted(self.starts, at)
        self.first, self.n = upto[:-1], np.diff(upto)

    def hashes(self) -> np.ndarray:
        up, down = powers(len(self.raw) + 1)
        sums = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * up[: len(self.raw)], out=sums[1:])
        return mixed((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` consecutive words; those that go over a text's end are for the caller to leave out."""
    n = max(0, len(hashes) - width + 1)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mixed(out * np.uint64(BASE) + hashes[k : k + n])
    return out


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """As `windows` at a cost that does not grow with the width, by prefix sums."""
    n = max(0, len(hashes) - width + 1)
    up, down = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mixed((sums[width : width + n] - sums[:n]) * down[:n])


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indexes first[i] .. first[i] + n[i] - 1 of all i, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
