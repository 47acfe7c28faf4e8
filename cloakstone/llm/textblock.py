"""Vectorised words of a block of texts: positions, 64-bit hashes and n-gram hashes straight from the Arrow buffers.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Its hash mixes its bytes in lanes of eight, each with its place, and its
length: words of up to eight bytes and one length never share a hash, longer ones only by chance (2**-64 a pair). No Python object is
made per word."""

from __future__ import annotations

import numpy as np

U = np.uint64
_PLACE, _SIZE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)  # the first k bytes of a lane
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Lower-case letters, digits and all bytes of other characters.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return _LOWER[data]


class Words:
    """Words of a block: starts, ends (byte positions), hashes, doc (row of each word), first (of each row: index of its first word; one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, hashed: bool = True, solid: np.ndarray = ~_SPACE):
        """solid: of each byte value, whether it belongs to words."""
        self.data = data = lowered(data) if lower else data
        self.offsets = offsets
        solid = solid[data]
        begins, ends = solid.copy(), solid.copy()
        if len(data):
            begins[1:] &= ~solid[:-1]
            ends[:-1] &= ~solid[1:]
            # a row's edge parts words too
            edge = offsets[(offsets > 0) & (offsets < len(data))]
            begins[edge] = solid[edge]
            ends[edge - 1] = solid[edge - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self.hashes = self._hash() if hashed else None

    def __len__(self) -> int:
        return len(self.starts)

    def _hash(self) -> np.ndarray:
        size = self.ends - self.starts
        room = np.zeros(len(self.data) // 8 * 8 + 24, np.uint8)
        room[: len(self.data)] = self.data
        aligned = room.view(U)

        def lanes(at: np.ndarray, n: np.ndarray) -> np.ndarray:
            """The n (at most 8) bytes from each place."""
            k, bits = at >> 3, ((at & 7) << 3).astype(U)
            x = aligned[k] >> bits
            x |= (aligned[k + 1] << U(1)) << (U(63) - bits)
            return x & _KEEP[n]

        out = lanes(self.starts, np.minimum(size, 8))
        long = np.flatnonzero(size > 8)
        if len(long):
            n = -(-size[long] // 8)
            first = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(first, n)
            at = np.repeat(self.starts[long], n) + 8 * place
            x = lanes(at, np.minimum(np.repeat(self.ends[long], n) - at, 8))
            out[long] = np.add.reduceat(mix(x + _PLACE * (place + 1).astype(U)), first)
        return mix(out ^ (size.astype(U) * _SIZE))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the first word) of every n words in a row of one document."""
        m = len(self) - n + 1
        if m <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        h = self.hashes
        g = h[:m].copy()
        for k in range(1, n):
            g = mix(g * U(0x9FB21C651E98DF25) + h[k : k + m])
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return g[at], at


def gram_of(hashes: np.ndarray) -> np.ndarray:
    """One hash for a whole sequence of word hashes, as grams() makes it."""
    g = hashes[:1].copy()
    for x in hashes[1:]:
        g = mix(g * U(0x9FB21C651E98DF25) + x)
    return g
