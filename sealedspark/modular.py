"""Products modulo a prime on numpy arrays: a number is a column of limbs, multiples of powers of 2**24 held as doubles."""

from __future__ import annotations

import numpy as np

W = 24


class Field:
    """Numbers modulo p as arrays (limbs, n). All sums stay below 2**53 units of their limb, so that they are exact."""

    def __init__(self, p: int):
        self.p, self.size = p, -(-(p.bit_length() + 8) // W)
        size, half = self.size, (1 << W - 1) + 8  # the largest limb of what `times` returns, in units
        column = size * half * half
        high = (1 << W - 1) + (column >> W) + 1
        most = size * high + ((high << W * (size - 1)) + (column << W * max(0, size - 2)) * 2) // p  # of the quotient by p
        self.fits = p > 1 << 32 and column + (size * high + most) * half < 1 << 53
        if not self.fits:
            return
        self.weight = 2.0 ** (W * np.arange(2 * size))[:, None]
        self.magic = self.weight * (1.5 * 2.0 ** (52 + W))  # adding and taking it away rounds to the next limb's unit
        fold, share = np.zeros((size + 1, 2 * size)), [(1 << W * k) / p for k in range(size)]
        fold[np.arange(size), np.arange(size)] = 1.0
        for j in range(size, 2 * size):
            rest = (1 << W * j) % p
            rest -= p if 2 * rest > p else 0
            fold[:size, j] = self._signed(rest)
            share.append(rest / p)
        fold[size] = share
        fold[:size] *= self.weight[:size]
        self.fold, self.modulus = fold / self.weight.T, self._signed(p)[:, None] * self.weight[:size]
        self.room: dict = {}

    def _signed(self, x: int) -> np.ndarray:
        """Limbs of at most half a unit of the next, from the lowest up; the highest takes what is left."""
        out = []
        for _ in range(self.size - 1):
            low = (x + (1 << W - 1)) % (1 << W) - (1 << W - 1)
            out.append(float(low))
            x = (x - low) >> W
        return np.array([*out, float(x)])

    def of(self, numbers: list[int]) -> np.ndarray:
        """Numbers from 0 to p as limbs."""
        digits = np.frombuffer(b"".join(x.to_bytes(3 * self.size, "little") for x in numbers), np.uint8).reshape(len(numbers), self.size, 3)
        a = np.ascontiguousarray((digits @ np.array([1.0, 256.0, 65536.0])).T) * self.weight[: self.size]
        for _ in range(2):
            self._carry(a, 0, self.size - 1, np.empty_like(a))
        return a

    def _carry(self, a: np.ndarray, lo: int, hi: int, tmp: np.ndarray) -> None:
        """Limbs from lo to hi (exclusive) keep at most half a unit of the next, which takes the rest."""
        part, c = a[lo:hi], tmp[: hi - lo]
        np.add(part, self.magic[lo:hi], out=c)
        np.subtract(c, self.magic[lo:hi], out=c)
        np.subtract(part, c, out=part)
        np.add(a[lo + 1 : hi + 1], c, out=a[lo + 1 : hi + 1])

    def times(self, a: np.ndarray, b: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The products of two arrays of numbers, about between -p/2 and p/2; `out` may be one of them."""
        size, n = self.size, a.shape[1]
        if n not in self.room:
            if len(self.room) > 8:
                self.room.clear()
            self.room[n] = np.empty((2 * size, n)), np.empty((size, n)), np.empty((size + 1, n))
        t, tmp, s = self.room[n]
        np.multiply(b, a[0], out=t[:size])
        t[size:] = 0.0
        for k in range(1, size):
            np.multiply(b, a[k], out=tmp)
            np.add(t[k : k + size], tmp, out=t[k : k + size])
        self._carry(t, size - 1, 2 * size - 1, tmp)
        np.matmul(self.fold, t, out=s)
        np.rint(s[size], out=s[size])
        np.multiply(self.modulus, s[size], out=tmp)
        np.subtract(s[:size], tmp, out=out)
        self._carry(out, 0, size - 1, tmp)
        self._carry(out, 0, size - 1, tmp)
        return out

    def words(self, a: np.ndarray) -> np.ndarray:
        """Words of 48 bits (n, words), the last one signed: the same for the same integer, whatever its limbs."""
        whole = (a / self.weight[: self.size]).astype(np.int64)
        if self.size % 2:
            whole = np.concatenate([whole, np.zeros((1, a.shape[1]), np.int64)])
        out = np.ascontiguousarray((whole[::2] + (whole[1::2] << W)).T)
        for k in range(out.shape[1] - 1):
            out[:, k + 1] += out[:, k] >> 2 * W
            out[:, k] &= (1 << 2 * W) - 1
        return out

    def numbers(self, a: np.ndarray) -> list[int]:
        """From 0 to p."""
        return [sum(w << 2 * W * k for k, w in enumerate(row)) % self.p for row in self.words(a).tolist()]

    def big_endian(self, a: np.ndarray, size: int) -> np.ndarray:
        """Numbers from 0 to p as bytes (n, size)."""
        words = self.words(a)
        below = words[:, -1] < 0
        words[below] += [self.p >> 2 * W * k & (1 << 2 * W) - 1 for k in range(words.shape[1])]
        for k in range(words.shape[1] - 1):
            words[:, k + 1] += words[:, k] >> 2 * W
            words[:, k] &= (1 << 2 * W) - 1
        raw = words[:, ::-1].astype(">i8").view(np.uint8).reshape(len(words), -1, 8)[:, :, 2:]
        return np.ascontiguousarray(raw.reshape(len(words), -1)[:, -size:])

    def powers(self, base: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
        """first * base**v for v from 0 to n - 1: (n, limbs, ...) for bases (limbs, ...)."""
        out = np.empty((n, *base.shape))
        out[0] = first
        flat = base.reshape(self.size, -1)
        for v in range(1, n):
            self.times(out[v - 1].reshape(self.size, -1), flat, out[v].reshape(self.size, -1))
        return out
