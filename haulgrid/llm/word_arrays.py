"""Words of Arrow text columns as numpy arrays: where they lie and their 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, unless one text alone is longer.
CHUNK = 1 << 20
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits, one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(kind: str, base: int, n: int) -> np.ndarray:
    known = _powers.get(kind)
    if known is None or len(known) < n:
        steps = np.full(max(n, CHUNK), base, np.uint64)
        steps[0] = 1
        _powers[kind] = known = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows with about ``CHUNK`` bytes; NULL is empty."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).fill_null("").cast(pa.large_string())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        own = offsets[row : end + 1]
        yield row, data[own[0] : own[-1]], own - own[0]
        row = end


class Words:
    """The words of a chunk: byte ranges, number of words before each text, and what is a separator."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.data, self.offsets = data, offsets
        self.separates = _SEPARATES[data]
        edge = np.ones(n + 1, bool)
        edge[1:n] = self.separates[:-1]
        edge[offsets] = True
        inside = ~self.separates
        self.starts = np.flatnonzero(inside & edge[:n])
        edge[:n] = self.separates
        edge[offsets] = True
        self.ends = np.flatnonzero(inside & edge[1:]) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word's bytes, with A-Z in lower case if wanted."""
        n = len(self.data)
        data = _LOWER[self.data] if lower else self.data
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("step", _STEP, n), out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * _power("back", _BACK, n)[self.starts])


_PLACES = [np.uint64(c) for c in (
    0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3,
    0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9E6C63D0676A9A99, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
)]


def window_hashes(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash of each run of ``words`` words; none if there are fewer."""
    n = len(hashes) - words + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(words):
        total += hashes[j : j + n] * _PLACES[j % len(_PLACES)] + np.uint64(j // len(_PLACES))
    return mix(total)
