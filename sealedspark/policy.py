"""Attribute policies: a small language compiled on the driver to Boolean columns.

    or   := and ('OR' and)*        and := atom ('AND' atom)*
    atom := '(' or ')' | INT '-of(' or (',' or)* ')' | key:value | "key:value"

AND and OR are upper-case words; `k-of` needs k >= 1. Whatever does not parse is an error, never a grant.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PolicyError(ValueError):
    pass


class Node:
    def __or__(self, other: Node) -> Node:
        return Any_((self, other))

    def __and__(self, other: Node) -> Node:
        return All_((self, other))


@dataclass(frozen=True)
class Leaf(Node):
    token: str

    def column(self, attrs: Column) -> Column:
        return F.array_contains(attrs, F.lit(self.token))

    def min_attrs(self) -> int:
        return 1


@dataclass(frozen=True)
class All_(Node):
    parts: tuple

    def column(self, attrs: Column) -> Column:
        return reduce(lambda a, b: a & b, [p.column(attrs) for p in self.parts])

    def min_attrs(self) -> int:
        return sum(p.min_attrs() for p in self.parts)


@dataclass(frozen=True)
class Any_(Node):
    parts: tuple

    def column(self, attrs: Column) -> Column:
        return reduce(lambda a, b: a | b, [p.column(attrs) for p in self.parts])

    def min_attrs(self) -> int:
        return min(p.min_attrs() for p in self.parts)


@dataclass(frozen=True)
class AtLeast(Node):
    k: int
    parts: tuple

    def column(self, attrs: Column) -> Column:
        return reduce(lambda a, b: a + b, [p.column(attrs).cast("int") for p in self.parts]) >= self.k

    def min_attrs(self) -> int:
        return self.k


def k_of_n(k: int, *parts: Node) -> Node:
    if k < 1:
        raise PolicyError("a threshold is at least 1")
    return AtLeast(k, parts)


def token(text: str) -> str:
    """`Key : value` as the token key:value, both sides trimmed and in lower case."""
    key, colon, value = text.partition(":")
    if not colon or not key.strip() or not value.strip():
        raise PolicyError(f"not an attribute: {text!r}")
    return f"{key.strip().lower()}:{value.strip().lower()}"


_LEX = re.compile(r'\s*(?:(?P<of>\d+-[oO][fF]\s*\()|(?P<p>[(),])|"(?P<q>[^"]*)"|(?P<w>[^\s(),"]+))')


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise PolicyError(f"unreadable policy at {at}: {text!r}")
        kind = m.lastgroup
        word = m.group(kind)
        if kind == "w" and word in ("AND", "OR"):
            kind = word
        elif kind == "w" and word.lower() in ("and", "or", "k-of"):
            raise PolicyError(f"{word!r} is not an operator")
        out.append((kind, word))
        at = m.end()
    return out


def parse(text: str) -> Node:
    """The tree of a policy text."""
    if not text or not text.strip():
        raise PolicyError("empty policy")
    items, at = _lex(text), 0

    def peek() -> str:
        return items[at][0] + (items[at][1] if items[at][0] == "p" else "") if at < len(items) else "end"

    def take() -> str:
        nonlocal at
        at += 1
        return items[at - 1][1]

    def many(sub, word, make):
        parts = [sub()]
        while peek() == word:
            take()
            parts.append(sub())
        return parts[0] if len(parts) == 1 else make(tuple(parts))

    def close() -> None:
        if peek() != "p)":
            raise PolicyError(f"a bracket is open: {text!r}")
        take()

    def atom() -> Node:
        kind = peek()
        if kind == "p(":
            take()
            node = any_()
            close()
            return node
        if kind == "of":
            k = int(take().split("-")[0])
            parts = [any_()]
            while peek() == "p,":
                take()
                parts.append(any_())
            close()
            return k_of_n(k, *parts)
        if kind == "q":
            return Leaf(token(take()))
        if kind == "w":
            words = [take()]
            while peek() == "w":
                words.append(take())
            return Leaf(token(" ".join(words)))
        raise PolicyError(f"an attribute is missing: {text!r}")

    def all_() -> Node:
        return many(atom, "AND", All_)

    def any_() -> Node:
        return many(all_, "OR", Any_)

    try:
        node = any_()
    except RecursionError:
        raise PolicyError("nested too deeply") from None
    if at != len(items):
        raise PolicyError(f"text after the policy: {text!r}")
    return node


_BLANK = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _BLANK, "")


def normalize_attrs(tokens: Column) -> Column:
    """A caller's tokens, each trimmed and in lower case, without repeats."""
    return F.array_distinct(F.transform(tokens, lambda t: F.lower(strip(t))))


def parse_attribute(text: Column) -> Column:
    """key:value of a text; null where it has no colon."""
    parts = F.split(text, ":", 2)
    joined = F.concat_ws(":", F.lower(strip(parts[0])), F.lower(strip(F.get(parts, F.lit(1)))))
    return F.when(F.contains(text, F.lit(":")), joined)


def from_roles(roles: Column) -> Column:
    return normalize_attrs(F.transform(roles, lambda r: F.concat(F.lit("role:"), r)))


def parse_caller(text: Column) -> Column:
    """Tokens of `role:Doctor, dept: Cardio`; a word without a colon stays, in lower case."""
    items = F.transform(F.split(text, ","), lambda t: F.coalesce(parse_attribute(t), F.lower(strip(t))))
    return F.array_distinct(F.filter(items, lambda t: t != ""))


def caller(text: str) -> list[str]:
    """The tokens of one caller, on the driver; a caller without any is an error."""
    items = [t.strip() for t in (text or "").split(",")]
    out = list(dict.fromkeys(token(t) if ":" in t else t.lower() for t in items if t))
    if not out:
        raise PolicyError("a caller has an attribute at least")
    return out


def has_prefix(attrs: Column, prefix: str) -> Column:
    return F.exists(attrs, lambda t: F.startswith(t, F.lit(prefix)))


def get_value(attrs: Column, key: str) -> Column:
    """The value of a key, the smallest one if it has several; null without one."""
    own = F.filter(attrs, lambda t: F.startswith(t, F.lit(key + ":")))
    return F.array_min(F.transform(own, lambda t: F.substring(t, len(key) + 2, 1 << 20)))


def roles(attrs: Column) -> Column:
    own = F.filter(attrs, lambda t: F.startswith(t, F.lit("role:")))
    return F.array_sort(F.transform(own, lambda t: F.substring(t, 6, 1 << 20)))


def allows(policy: str | None, attrs: Column) -> Column:
    """Whether `attrs` meet a policy; no policy and no attributes deny."""
    return F.coalesce(parse(policy).column(attrs), F.lit(False)) if policy else F.lit(False)


def satisfied(callers: DataFrame, policies: list[str]) -> DataFrame:
    """Which caller meets which policy: columns caller_id, policy, for `callers` (caller_id, attrs).

    Each distinct policy is evaluated once for each caller. A policy that does not parse grants nothing.
    """
    cases = []
    for p in sorted(set(policies)):
        try:
            cases.append(F.when(allows(p, F.col("attrs")), F.lit(p)))
        except PolicyError:
            continue
    none = callers.select("caller_id", F.lit(None).cast("string").alias("policy")).limit(0)
    if not cases:
        return none
    return callers.select("caller_id", F.explode(F.filter(F.array(*cases), lambda p: p.isNotNull())).alias("policy"))
