"""Inner-product functional encryption over a safe-prime group.

Keys are made on the driver; the master secret never enters a DataFrame. Ciphertexts are arrays of big-endian
binaries. Encryption and decryption are Arrow-batched, since no SQL function does modular powers.
"""

from __future__ import annotations

import json
import os
import secrets
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from math import isqrt, prod

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sealedspark.modular import Field

# Numbers that are multiplied at once: enough to outweigh the calls, few enough for a cache.
LANE = 8192
# Powers of ciphertexts that are held at once take about so many bytes.
POWERS = 1 << 25
# Fewer pairs than these are not worth a table.
FEW = 128
# Components of requests are combined up to this size; so many requests are combined at once.
LARGE = 1 << 20
TILE = 1024


def is_prime(n: int) -> bool:
    """Miller-Rabin with forty random bases."""
    if n < 4 or n % 2 == 0:
        return n in (2, 3)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for _ in range(40):
        x = pow(secrets.randbelow(n - 3) + 2, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def safe_prime(bits: int) -> int:
    while True:
        q = secrets.randbits(bits - 1) | 1 | 1 << (bits - 2)
        if all(q % d and (2 * q + 1) % d for d in (3, 5, 7, 11, 13, 17, 19, 23)) and is_prime(q) and is_prime(2 * q + 1):
            return 2 * q + 1


@dataclass(frozen=True)
class Public:
    """What the party that scores may know."""

    p: int
    g: int
    mpk: tuple
    quant_bits: int

    @property
    def bound(self) -> int:
        """The largest absolute inner product of two quantised vectors with components within [-1, 1]."""
        return len(self.mpk) * 10 ** (2 * self.quant_bits)


@dataclass(frozen=True)
class Scheme:
    public: Public
    msk: tuple = field(repr=False)

    @staticmethod
    def setup(dim: int, bits: int = 128, quant_bits: int = 2) -> Scheme:
        if not 0 <= quant_bits <= 3:
            raise ValueError("quant_bits is 0 to 3")
        p = safe_prime(bits)
        g = 1
        while g == 1:
            g = pow(secrets.randbelow(p - 3) + 2, 2, p)
        msk = tuple(secrets.randbelow((p - 1) // 2) for _ in range(dim))
        return Scheme(Public(p, g, tuple(pow(g, s, p) for s in msk), quant_bits), msk)

    def key(self, q: list[int]) -> int:
        """The functional key of one quantised query."""
        if len(q) != len(self.msk):
            raise ValueError("the query has another length than the key")
        return sum(s * x for s, x in zip(self.msk, q, strict=True)) % ((self.public.p - 1) // 2)


def save(scheme: Scheme, path: str) -> None:
    """Write a scheme with its master secret to a file of the driver that only its owner may read; replaces it at once."""
    kept = {"p": scheme.public.p, "g": scheme.public.g, "quant_bits": scheme.public.quant_bits, "msk": list(scheme.msk)}
    part = f"{path}.part"
    with open(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
        json.dump(kept, f)
    os.replace(part, path)


def load(path: str) -> Scheme:
    """A scheme written by `save`; the public keys are computed anew."""
    with open(path) as f:
        kept = json.load(f)
    p, g, msk = kept["p"], kept["g"], tuple(kept["msk"])
    return Scheme(Public(p, g, tuple(pow(g, s, p) for s in msk), kept["quant_bits"]), msk)


def load_or_setup(path: str, dim: int, bits: int = 128, quant_bits: int = 2) -> Scheme:
    """The scheme of a file, or a new one that is written to it; another dimension or precision is an error."""
    if not os.path.exists(path):
        save(Scheme.setup(dim, bits, quant_bits), path)
    scheme = load(path)
    if (len(scheme.msk), scheme.public.quant_bits) != (dim, quant_bits):
        raise ValueError("the saved scheme is for other vectors")
    return scheme


def _bytes(x: int, p: int) -> bytes:
    return x.to_bytes((p.bit_length() + 7) // 8, "big")


class FixedBase:
    """Powers of one base from a table of its powers by digits of the exponent: a product for each digit, no squaring."""

    def __init__(self, base: int, p: int, digit: int = 8):
        self.p, self.digit, self.rows = p, digit, []
        for _ in range(-(-p.bit_length() // digit)):
            row = [1]
            for _ in range((1 << digit) - 1):
                row.append(row[-1] * base % p)
            self.rows.append(row)
            base = row[-1] * base % p

    def power(self, e: int) -> int:
        """base**e for 0 <= e < 2**bits of p."""
        x, mask, p = 1, (1 << self.digit) - 1, self.p
        for row in self.rows:
            if e & mask:
                x = x * row[e & mask] % p
            e >>= self.digit
        return x


def _digit(public: Public) -> int:
    return 8 if len(public.mpk) <= 128 else 4  # 12 MB for 64 keys of 128 bits


@lru_cache(maxsize=4)
def _tables(public: Public) -> tuple[list[FixedBase], dict[int, int]]:
    """Fixed-base tables of g and the public keys, and g**x for every component of a quantised unit vector."""
    most = 10**public.quant_bits
    return [FixedBase(b, public.p, _digit(public)) for b in (public.g, *public.mpk)], {x: pow(public.g, x, public.p) for x in range(-most, most + 1)}


@lru_cache(maxsize=4)
def _limbs(public: Public) -> tuple[np.ndarray, np.ndarray] | None:
    """Like `_tables`, on arrays: powers (digits, limbs, values, bases) and g**x (limbs, x); None where they would be large or do not fit."""
    f, p, bases, most = _field(public.p), public.p, [public.g, *public.mpk], 10**public.quant_bits
    values = 1 << _digit(public)
    digits = -(-p.bit_length() // _digit(public))
    if not f.fits or digits * values * len(bases) > 1 << 19:
        return None
    base = [pow(b, values**d, p) for d in range(digits) for b in bases]
    powers = f.powers(f.of(base), f.of([1] * len(base)), values).reshape(values, f.size, digits, len(bases))
    return np.ascontiguousarray(powers.transpose(2, 1, 0, 3)), f.of([pow(public.g, x, p) for x in range(-most, most + 1)])


def _one(public: Public, r: int, v: list[int]) -> list[bytes]:
    p, (bases, small) = public.p, _tables(public)
    ct = [bases[0].power(r)]
    for base, x in zip(bases[1:], v, strict=True):
        ct.append(base.power(r) * (small[x] if x in small else pow(public.g, x, p)) % p)
    return [_bytes(c, p) for c in ct]


def _many(public: Public, rs: list[int], v: np.ndarray) -> list[list[bytes]]:
    """`_one` of vectors (n, components) within the table of g**x, multiplied all at once."""
    f, (powers, small), (n, dim) = _field(public.p), _limbs(public), v.shape
    size = (public.p.bit_length() + 7) // 8
    digits = np.frombuffer(b"".join(r.to_bytes(size, "little") for r in rs), np.uint8).reshape(n, size)
    if powers.shape[2] == 16:
        digits = np.stack([digits & 15, digits >> 4], 2).reshape(n, 2 * size)
    x = np.zeros((f.size, n, dim + 1))
    x[0, :, 0] = 1.0
    np.take(small, v + small.shape[1] // 2, axis=1, out=x[:, :, 1:])
    x = x.reshape(f.size, -1)
    for table, at in zip(powers, digits.T[: len(powers)], strict=True):
        f.times(x, table.take(at, axis=1).reshape(f.size, -1), x)
    raw = f.big_endian(x, size).tobytes()
    return [[raw[i : i + size] for i in range(lo, lo + size * (dim + 1), size)] for lo in range(0, len(raw), size * (dim + 1))]


def encrypt(public: Public, quantized: Column) -> Column:
    """Ciphertexts of quantised vectors. Random: write them before use."""

    @F.pandas_udf("array<binary>")
    def run(vecs: pd.Series) -> pd.Series:
        dim, most, out = len(public.mpk), 10**public.quant_bits, []
        step = max(1, LANE // (dim + 1))
        for lo in range(0, len(vecs), step):
            part = [list(map(int, v)) for v in vecs[lo : lo + step]]
            if any(len(v) != dim for v in part):
                raise ValueError("a vector has another length than the key")
            rs = [secrets.randbelow((public.p - 1) // 2) for _ in part]
            if _limbs(public) and len(part) * dim >= FEW and all(abs(x) <= most for v in part for x in v):
                out += _many(public, rs, np.array(part, np.int64))
            else:
                out += [_one(public, r, v) for r, v in zip(rs, part, strict=True)]
        return pd.Series(out)

    return run.asNondeterministic()(quantized)


def derive(scheme: Scheme, q: Column) -> Column:
    """Functional keys of quantised queries, made where the key holder's executors run: the secret is in a closure."""
    size = (scheme.public.p.bit_length() + 7) // 8

    @F.pandas_udf("binary")
    def run(queries: pd.Series) -> pd.Series:
        return pd.Series([scheme.key(list(map(int, v))).to_bytes(size, "big") for v in queries])

    return run(q)


@lru_cache(maxsize=4)
def _steps(g: int, p: int, span: int) -> tuple[int, dict, int, int]:
    m = 16 * (isqrt(span) + 1)  # a larger table than the root: it is built once a worker, and used for many pairs
    table, x = {}, pow(g, -(m // 2), p)
    for i in range(m):
        table.setdefault(x, i - m // 2)
        x = x * g % p
    return m, table, pow(g, -m, p), pow(g, m, p)


def discrete_log(x: int, g: int, p: int, bound: int) -> int:
    """e in [-bound, bound] with g**e = x modulo p: baby steps around zero, then giant steps to both sides.

    Products of unit vectors lie near zero, so that nearly all are in the table at once.
    """
    m, table, down, up = _steps(g, p, 2 * bound)
    low = high = x
    for j in range(bound // m + 2):
        for y, at in ((low, j * m), (high, -j * m)):
            if (i := table.get(y)) is not None and abs(i + at) <= bound:
                return i + at
        low, high = low * down % p, high * up % p
    raise ValueError("the inner product is out of range")


def _planes(q: list[int]) -> list[list]:
    """For the positive and the negative components: the places whose size has a bit, from the highest bit down."""
    out = []
    for sign in (1, -1):
        size = [max(0, sign * x) for x in q]
        planes = []
        for bit in range(max(size, default=0).bit_length() - 1, -1, -1):
            planes.append([i + 1 for i, x in enumerate(size) if x >> bit & 1])
        out.append(planes)
    return out


def _product(ct: list[int], planes: list, p: int) -> int:
    """The product of powers with one squaring a bit for all of them together."""
    x = 1
    for places in planes:
        x = x * x % p
        if places:
            x = x * prod([ct[i] for i in places]) % p
    return x


class Query:
    """A request ready for scoring: where its components' bits are, and the exponent that takes its key out."""

    def __init__(self, public: Public, sk: bytes, q: list[int]):
        self.n, self.own = len(q), (public.p - 1) // 2 - int.from_bytes(sk, "big")
        self.plus, self.minus = _planes([int(x) for x in q])

    def quotient(self, ct: list[int], p: int) -> tuple[int, int]:
        """Numerator and denominator of g to the inner product."""
        if len(ct) != self.n + 1:
            raise ValueError("ciphertext and query differ in length")
        return _product(ct, self.plus, p) * pow(ct[0], self.own, p) % p, _product(ct, self.minus, p)


def inner_products(public: Public, pairs: list[tuple[list[int], Query]]) -> list[int]:
    """The exact integer inner product of each pair of ciphertext and query.

    Powers of one pair share their squarings; the denominators of all pairs share one inverse.
    """
    p, above, run = public.p, [], []
    acc = 1
    for ct, query in pairs:
        a, b = query.quotient(ct, p)
        above.append((a, b))
        run.append(acc)
        acc = acc * b % p
    inverse, out = pow(acc, -1, p), []
    for (a, b), before in zip(reversed(above), reversed(run), strict=True):
        out.append(discrete_log(a * inverse * before % p, public.g, p, public.bound))
        inverse = inverse * b % p
    return out[::-1]


@lru_cache(maxsize=4)
def _field(p: int) -> Field:
    return Field(p)


@lru_cache(maxsize=4)
def _logs(public: Public) -> tuple[np.ndarray, np.ndarray]:
    """The words of g**e and of g**e - p for the e of the baby steps, sorted by the first word, and e."""
    p, bound = public.p, public.bound
    table = [(x - less, e) for x, e in _steps(public.g, p, 2 * bound)[1].items() if abs(e) <= bound for less in (0, p)]
    n = (_field(p).size + 1) // 2
    mask = (1 << 48) - 1
    words = np.array([[x >> 48 * k & mask if k < n - 1 else x >> 48 * k for k in range(n)] for x, _ in table], np.int64)
    order = np.argsort(words[:, 0])
    return words[order], np.array([e for _, e in table], np.int64)[order]


def _independent(q: np.ndarray) -> list[int]:
    """The places of as many independent rows as there are, each time the one that is farthest from the span of the others."""
    left, at, size = q.copy(), [], (q * q).sum(1).max(initial=0)
    while len(at) < q.shape[1]:
        far = (left * left).sum(1)
        i = int(far.argmax())
        if far[i] <= 1e-9 * size:
            break
        at.append(i)
        unit = left[i] / np.sqrt(far[i])
        left -= np.outer(left @ unit, unit)
    return at


class Requests:
    """Requests that are scored together against many ciphertexts, each of which is raised to all powers they need once.

    Every exponent is cut into digits, and a score is a product of one power for each digit, of many pairs at once.
    Components are raised by `up`, so that none is negative; the power of a ciphertext that this is too much is taken
    out of its table again. A few pairs, and what fits no table, are multiplied a pair at a time.

    Inner products are linear in the request: where there are many more requests than components, only independent ones
    are decrypted, and the scores of the others follow from these scores (`basis`).
    """

    def __init__(self, public: Public, keys: list[bytes], vectors: np.ndarray):
        self.public, self.n, self.keys, self.vectors, self.queries = public, len(keys), keys, vectors, []
        lo, hi = int(vectors.min(initial=0)), int(vectors.max(initial=0))
        self.tables = _field(public.p).fits and max(-lo, hi) < 1 << 31
        if not self.tables:
            return
        self.up, e = -lo, (vectors.T - lo).astype(np.int64)
        own = np.array([(public.p - 1) // 2 - int.from_bytes(k, "big") for k in keys], object)
        bits = [public.p.bit_length(), *[(hi - lo).bit_length()] * len(e)]
        self.digit = min(range(1, 9), key=lambda w: sum(-(-b // w) for b in bits) * (self.n + (1 << w)))
        self.counts = [-(-b // self.digit) for b in bits]
        part = lambda x, j: x >> self.digit * j & (1 << self.digit) - 1
        rows = [part(own, j) for j in range(self.counts[0])] + [part(x, j) for j in range(self.counts[-1] if len(e) else 0) for x in e]
        self.digits = np.array([x.astype(np.uint8) for x in rows])
        self.values = int(self.digits.max(initial=0)) + 1
        self.most = max(1, POWERS // (8 * _field(public.p).size * len(rows) * self.values))

    def _powers(self, cts: list[list[int]]) -> np.ndarray:
        """(digits of exponents, limbs, values, ciphertexts)"""
        p, f, own, first, dim = self.public.p, _field(self.public.p), [], [], len(self.counts) - 1
        for ct in cts:
            if len(ct) != len(self.counts):
                raise ValueError("ciphertext and query differ in length")
            x = ct[0] % p
            for j in range(self.counts[0]):
                own.append(x := pow(x, 1 << self.digit, p) if j else x)
            much = 1
            for x in ct[1:]:
                much = much * x % p
            first.append(pow(much, -self.up, p))
        base = np.empty((f.size, len(self.digits), len(cts)))
        base[:, : self.counts[0]] = f.of(own).reshape(f.size, len(cts), -1).transpose(0, 2, 1)
        x = f.of([ct[i] % p for i in range(1, dim + 1) for ct in cts])
        for lo in range(self.counts[0], len(self.digits), dim):
            base[:, lo : lo + dim] = x.reshape(f.size, dim, -1)
            for _ in range(self.digit if lo + dim < len(self.digits) else 0):
                f.times(x, x, x)
        one = np.zeros_like(base)
        one[0] = 1.0
        one[:, 0] = f.of(first)
        return np.ascontiguousarray(f.powers(base, one, self.values).transpose(2, 1, 0, 3))

    @cached_property
    def basis(self) -> tuple[Requests, np.ndarray] | None:
        """Requests that the others are linear combinations of, and the combination that each request is.

        None where it saves little, where rounding could matter, or where a key is not that of its request.
        """
        q = self.vectors.astype(float)
        if not self.tables or self.n < 2 * q.shape[1] or self.n > LARGE or np.abs(q).max(initial=0) > LARGE or not self._genuine():
            return None
        at = _independent(q)
        if not 0 < 2 * len(at) <= self.n:
            return None
        inverse = np.linalg.pinv(q[at])
        parts = q @ inverse
        parts += (q - parts @ q[at]) @ inverse
        # what a combination misses, times the components of a document, and what sums of scores lose in their last bits
        missed = np.abs(q - parts @ q[at]).sum(1).max() * LARGE + np.abs(parts).sum(1).max() * self.public.bound * len(at) * 2.0**-52
        return (Requests(self.public, [self.keys[i] for i in at], self.vectors[at]), parts) if missed < 2.0**-7 else None

    def _genuine(self) -> bool:
        """Whether every key is that of its request, by the public keys: three random combinations of all of them."""
        p, order = self.public.p, (self.public.p - 1) // 2
        by = np.random.default_rng(secrets.randbits(128)).integers(0, 1 << 22, (3, self.n))
        keys = [int.from_bytes(k, "big") for k in self.keys]
        for row, exponents in zip(by.tolist(), (by @ self.vectors.astype(np.int64)).tolist(), strict=True):
            want = 1
            for h, e in zip(self.public.mpk, exponents, strict=True):
                want = want * pow(h, e % order, p) % p
            if pow(self.public.g, sum(b * k for b, k in zip(row, keys, strict=True)) % order, p) != want:
                return False
        return True

    def scores(self, cts: list[list[int]]) -> np.ndarray:
        """The exact integer inner products (requests, ciphertexts), for any number of ciphertexts."""
        if self.n * len(cts) < FEW or not self.basis or self.basis[0].n * len(cts) < FEW:
            return self._powered(cts)
        few, parts = self.basis
        known, out, odd = few._powered(cts).astype(float), np.empty((self.n, len(cts)), np.int64), np.zeros(len(cts), bool)
        for i in range(0, self.n, TILE):
            x = parts[i : i + TILE] @ known
            whole = np.rint(x)
            x -= whole
            odd |= (np.abs(x).max(0) > 2.0**-6) | (np.abs(whole).max(0) > self.public.bound)
            out[i : i + TILE] = whole
        if odd.any():  # no ciphertext of whole numbers: its pairs are decrypted, as far as they can be
            out[:, odd] = self._powered([ct for ct, o in zip(cts, odd, strict=True) if o])
        return out

    def _powered(self, cts: list[list[int]]) -> np.ndarray:
        """`scores` by modular powers for each pair."""
        out = np.empty((self.n, len(cts)), np.int64)
        if not self.tables or self.n * len(cts) < FEW:
            if not self.queries:
                self.queries = [Query(self.public, k, v) for k, v in zip(self.keys, self.vectors.tolist(), strict=True)]
            for j, ct in enumerate(cts):
                out[:, j] = inner_products(self.public, [(ct, q) for q in self.queries])
            return out
        for lo in range(0, len(cts), self.most):
            part = cts[lo : lo + self.most]
            out[:, lo : lo + len(part)] = self._scores(self._powers(part), len(part))
        return out

    def _scores(self, powers: np.ndarray, width: int) -> np.ndarray:
        f, out, step = _field(self.public.p), np.empty((self.n, width), np.int64), max(1, LANE // width)
        for i in range(0, self.n, step):
            digits = self.digits[:, i : i + step]
            x = powers[0].take(digits[0], axis=1).reshape(f.size, -1)
            y = np.empty((f.size, digits.shape[1], width))
            for row, values in zip(powers[1:], digits[1:], strict=True):
                np.take(row, values, axis=1, out=y, mode="clip")
                f.times(x, y.reshape(f.size, -1), x)
            out[i : i + step] = self._log(x).reshape(-1, width)
        return out

    def _log(self, x: np.ndarray) -> np.ndarray:
        f, g, p = _field(self.public.p), self.public.g, self.public.p
        known, e = _logs(self.public)
        words = f.words(x)
        at = np.minimum(np.searchsorted(known[:, 0], words[:, 0]), len(e) - 1)
        out, far = e[at], np.flatnonzero((known[at] != words).any(1))
        if len(far):
            out[far] = [discrete_log(v, g, p, self.public.bound) for v in f.numbers(x[:, far])]
        return out


def numbers(ct: list[bytes]) -> list[int]:
    return [int.from_bytes(c, "big") for c in ct]


def inner_product(public: Public, ct: Column, sk: Column, q: Column) -> Column:
    """The exact integer inner product of a ciphertext column and a query column."""

    @F.pandas_udf("long")
    def run(cts: pd.Series, keys: pd.Series, queries: pd.Series) -> pd.Series:
        pairs = [(numbers(c), Query(public, k, v)) for c, k, v in zip(cts, keys, queries, strict=True)]
        return pd.Series(inner_products(public, pairs), dtype="int64")

    return run(ct, sk, q)
