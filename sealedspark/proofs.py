"""Schnorr proofs of attributes, made and checked over tables.

A secret is a hash of the public token, so a proof shows a valid transcript only. Proofs are checked in batches: one
equation with random weights stands for all of a batch, and a batch that fails is halved until the bad ones are left.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets
from functools import lru_cache
from math import prod

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealedspark.ipfe import FixedBase, safe_prime

BATCH, ALONE = 256, 4  # proofs of one equation; so few are checked each by itself
WEIGHT_BITS, SUBSETS = 64, 40  # a wrong batch passes with a chance of about 2**-40 at most


@lru_cache(maxsize=2)
def group(bits: int = 128) -> tuple[int, int]:
    """p and g of a safe-prime group, made once in a process. In a small group proofs for other contexts may pass."""
    return safe_prime(bits), 4


@lru_cache(maxsize=4)
def _base(g: int, p: int) -> FixedBase:
    return FixedBase(g, p)


def _secret(attr: str, q: int) -> int:
    return int.from_bytes(hashlib.sha256(attr.strip().lower().encode()).digest(), "big") % q


@lru_cache(maxsize=100_000)
def _public(attr: str, p: int, g: int) -> int:
    return _base(g, p).power(_secret(attr, (p - 1) // 2))


def _challenge(q: int, *parts) -> int:
    return int.from_bytes(hashlib.sha256("\x1f".join(map(str, parts)).encode()).digest(), "big") % q


def prove(attr: str, context: str, p: int, g: int) -> tuple[str, str, str]:
    """t, c, s as decimal texts. The nonce is a keyed hash of secret and context, so that a task that runs again,
    after an executor is lost, gives the same proof and no nonce is ever used for two contexts."""
    q = (p - 1) // 2
    x = _secret(attr, q)
    seed = hmac.new(x.to_bytes((q.bit_length() + 7) // 8, "big"), f"{p}\x1f{g}\x1f{context}".encode(), hashlib.sha512).digest()
    r = int.from_bytes(seed, "big") % (q - 1) + 1
    t = _base(g, p).power(r)
    c = _challenge(q, g, _public(attr, p, g), t, context)
    return str(t), str(c), str((r + c * x) % q)


def proof(p: int, g: int, attr: Column, context: Column) -> Column:
    """A struct of t, c and s; null where attribute or context is null."""

    @F.pandas_udf("t string, c string, s string")
    def run(attrs: pd.Series, contexts: pd.Series) -> pd.DataFrame:
        rows = [prove(a, k, p, g) if a is not None and k is not None else (None,) * 3 for a, k in zip(attrs, contexts, strict=True)]
        return pd.DataFrame(rows, columns=["t", "c", "s"])

    return run(attr, context)


def _jacobi(a: int, n: int) -> int:
    """The Jacobi symbol: 1 for the squares modulo a prime, which are the group's members."""
    sign = 1
    a %= n
    while a:
        twos = (a & -a).bit_length() - 1
        a >>= twos
        if twos & 1 and n & 7 in (3, 5):
            sign = -sign
        if a & 3 == 3 and n & 3 == 3:
            sign = -sign
        a, n = n % a, a
    return sign if n == 1 else 0


def _members(ts: list[int], p: int) -> bool:
    """Whether all are members of the group, by the products of random subsets: one that is not changes half of these."""
    for _ in range(SUBSETS):
        bits = secrets.randbits(len(ts))
        if _jacobi(prod(t for i, t in enumerate(ts) if bits >> i & 1) % p, p) != 1:
            return False
    return True


def _right(item: tuple, p: int, g: int) -> bool:
    t, c, s, y = item
    return _base(g, p).power(s) == t * pow(y, c, p) % p


def _all_right(items: list[tuple], p: int, g: int) -> bool:
    """g**s = t * y**c for all (t, c, s, y) at once, each to the power of a random weight; squarings are shared, and the
    powers of one public key are one."""
    q = (p - 1) // 2
    weights = [secrets.randbits(WEIGHT_BITS) for _ in items]
    left = _base(g, p).power(sum(w * i[2] for w, i in zip(weights, items, strict=True)) % q)
    of_key: dict[int, int] = {}
    for w, (_, c, _, y) in zip(weights, items, strict=True):
        of_key[y] = (of_key.get(y, 0) + w * c) % q
    right = 1
    for bit in range(WEIGHT_BITS - 1, -1, -1):
        right = right * right % p
        right = right * prod(i[0] for w, i in zip(weights, items, strict=True) if w >> bit & 1) % p
    for y, e in of_key.items():
        right = right * pow(y, e, p) % p
    return left == right and _members([i[0] for i in items], p)


def check(items: list[tuple], p: int, g: int) -> list[bool]:
    """Whether each (t, c, s, y) is right. Batches that hold a wrong one are halved; small ones are checked one by one."""
    out, open_ = [True] * len(items), [(i, min(i + BATCH, len(items))) for i in range(0, len(items), BATCH)]
    while open_:
        a, b = open_.pop()
        if b - a <= ALONE:
            for i in range(a, b):
                out[i] = _right(items[i], p, g)
        elif not _all_right(items[a:b], p, g):
            open_ += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return out


def _number(text: str | None, below: int) -> int | None:
    """A decimal text as a number in [0, below); null for anything else."""
    if text is None or not (text.isascii() and text.isdigit()) or len(text) > len(str(below)):
        return None
    n = int(text)
    return n if n < below else None


def verify(p: int, g: int, attr: Column, context: Column, t: Column, c: Column, s: Column) -> Column:
    """Whether t, c, s prove an attribute in a context; false where any of them is null or no number of its range."""
    q = (p - 1) // 2

    @F.pandas_udf("boolean")
    def run(attrs: pd.Series, contexts: pd.Series, ts: pd.Series, cs: pd.Series, ss: pd.Series) -> pd.Series:
        out, items, places = [False] * len(attrs), [], []
        for i, (a, k, t_, c_, s_) in enumerate(zip(attrs, contexts, ts, cs, ss, strict=True)):
            n = _number(t_, p), _number(c_, q), _number(s_, q)
            if a is None or k is None or None in n or not n[0]:
                continue
            y = _public(a, p, g)
            if n[1] == _challenge(q, g, y, n[0], k):
                items.append((*n, y))
                places.append(i)
        for i, ok in zip(places, check(items, p, g), strict=True):
            out[i] = ok
        return pd.Series(out, dtype=bool)

    return run(attr, context, t, c, s)


def all_proved(required: DataFrame, checked: DataFrame) -> DataFrame:
    """caller_id, proved for `required` (caller_id, attrs) and `checked` (caller_id, attr, ok); nothing required is proved."""
    each = required.select("caller_id", F.explode_outer("attrs").alias("attr"))
    j = each.join(checked.groupBy("caller_id", "attr").agg(F.max("ok").alias("ok")), ["caller_id", "attr"], "left")
    ok = F.col("attr").isNull() | F.coalesce("ok", F.lit(False))
    return j.groupBy("caller_id").agg(F.bool_and(ok).alias("proved"))
