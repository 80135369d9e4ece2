"""Rabin-Karp fingerprints of any stretch of a sequence, from prefix polynomials modulo 2^64.

Every element is first replaced by a random odd-looking 64-bit value, so
stretches of a few hundred elements collide no more often than random numbers
would.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from opslake.llm.shingles import mix

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
#: Stands for each byte.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


class Powers:
    """Powers of the base and of its inverse; they grow with the longest sequence asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", _INVERSE)):
                all_ = np.full(max(n, 1 << 16), base, np.uint64)
                all_[0] = 1
                setattr(self, name, np.multiply.accumulate(all_))


_POWERS = Powers()


def prefixes(values: np.ndarray) -> np.ndarray:
    """Sums of ``values[i] * BASE**i`` up to every place."""
    _POWERS.reach(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _POWERS.up[: len(values)], out=sums[1:])
    return sums


def stretch(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The polynomial of the elements from ``start`` up to ``stop``, wherever they stand."""
    return (sums[stop] - sums[start]) * _POWERS.down[start]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of a column in one row, and where each string ends; null is the empty string."""
    plain = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    held = plain.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and held.size else np.empty(0, np.uint8)
    return data, offsets[1:] - offsets[0]
