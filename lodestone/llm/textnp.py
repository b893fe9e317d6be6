"""Vectorised hashing of UTF-8 text for Python workers.

Hashes are polynomials over random byte values, taken from prefix sums, so the
hash of any stretch of a text costs two look-ups. A polynomial modulo 2^64 alone
has known collisions (a Thue-Morse string of 1,024 letters and its complement,
whatever the base); ``Sums`` therefore joins it with one modulo the prime
2^31 - 1, which has none of that kind.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
MUL = U(0x9E3779B97F4A7C15 | 1)
#: Bytes that are hashed at a time; a longer single word is taken whole.
SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def table(seed: int) -> np.ndarray:
    """A random value for each byte."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=U) * MUL + U(seed))


BYTES = table(1)
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
PUNCT = np.zeros(256, bool)
PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U)
    out[0] = 1
    k, step = 1, base
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * U(step)
        step = step * step & (2**64 - 1)
        k += m
    return out


class Powers:
    """Powers of a base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up[:n], self.down[:n]


POWERS = Powers(int(MUL))


def prefix(values: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Prefix sums of values times powers; one longer than ``values``."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers.get(len(values) + 1)[0][:-1], out=out[1:])
    return out


def stretch(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Hashes of [start, stop); equal stretches have equal hashes wherever they stand."""
    return (sums[stop] - sums[start]) * powers.get(len(sums))[1][start]


#: A prime modulus beside 2^64, and a base for it.
P31 = U((1 << 31) - 1)
BASE31 = 1_103_515_245


class PrimePowers:
    """Powers of BASE31 and of its inverse modulo P31, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (self._row(b, n) for b in (BASE31, pow(BASE31, -1, int(P31))))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _row(base: int, n: int) -> np.ndarray:
        out = np.empty(n, U)
        out[0] = 1
        k, step = 1, base % int(P31)
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m] * U(step) % P31
            step = step * step % int(P31)
            k += m
        return out


PRIME_POWERS = PrimePowers()


class Sums:
    """Prefix sums of a sequence of random 64-bit values under both polynomials."""

    def __init__(self, values: np.ndarray):
        self.wide = prefix(values)
        n = len(values) + 1
        up, self.down = PRIME_POWERS.get(n)
        x = (values >> U(33)) * up[:-1]
        self.prime = np.zeros(n, U)
        np.cumsum((x & P31) + (x >> U(31)), out=self.prime[1:])  # terms under 2^32: no overflow below 2^32 of them

    def pair(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key and check of [start, stop), both 64 bits wide and both made of the two hashes and the length: 95 bits in all."""
        wide = stretch(self.wide, start, stop)
        prime = (self.prime[stop] - self.prime[start]) % P31 * self.down[start] % P31
        size = (stop - start).astype(U)
        return mix(wide ^ mix(prime ^ size << U(32))), mix(prime << U(33) ^ mix(wide + size) ^ U(0x5851F42D4C957F2D))

    def key(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """One 64-bit hash of [start, stop)."""
        wide = stretch(self.wide, start, stop)
        prime = (self.prime[stop] - self.prime[start]) % P31 * self.down[start] % P31
        return mix(wide ^ mix(prime ^ (stop - start).astype(U) << U(32)))


def words(data: np.ndarray, bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of ``data`` (uint8), A-Z taken as lower case.

    ``bare``: ASCII punctuation around a word doesn't count, unless it has nothing else.
    """
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        while end < len(data) and not SPACE[data[end - 1]]:  # to the end of the word
            ahead = np.flatnonzero(SPACE[data[end : end + SEGMENT]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(len(data), end + SEGMENT)
        b = data[at:end]
        gap = np.ones(len(b) + 2, bool)
        gap[1:-1] = SPACE[b]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        s, e = edge[0::2], edge[1::2]
        starts.append(s + at)
        if bare and len(s):
            s, e = s.copy(), e.copy()
            for _ in range(8):
                cut = PUNCT[b[e - 1]] & (e - s > 1)
                cut2 = PUNCT[b[s]] & (e - s > 1)
                if not (cut.any() or cut2.any()):
                    break
                e -= cut
                s += cut2 & (e - s > 1)
        hashes.append(Sums(LOWER[b]).key(s, e))
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(starts), np.concatenate(hashes)


def combine(*hashes: np.ndarray) -> np.ndarray:
    """Hash of a sequence of hashes; the order counts."""
    out = np.full(hashes[0].shape, len(hashes), U)
    for h in hashes:
        out = mix(out * U(0xD6E8FEB86659FD93) + h)
    return out


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, each followed by a line break, and the offsets of their starts (one more at the end)."""
    buf = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or b"") + 1 for t in texts], out=bounds[1:])
    return buf, bounds


def groups(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Cut a list into runs whose sizes add up to ``most``, or hold one item."""
    out, first, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > most:
            out.append((first, i))
            first, held = i, 0
        held += n
    if first < len(sizes):
        out.append((first, len(sizes)))
    return out
