"""Policies held in a table: trees as rows, evaluated by joins instead of one compiled Column for each policy.

A policy text is parsed where it lies (one Arrow function over the distinct texts) into its leaves, each with the way
up from it: the nodes above it and how many of their children each needs. To tell who meets which policy, texts that
differ in their tokens only are parsed once (their shape), and policies of one shape are judged many at once in numpy.

Which pairs of callers and policies are looked at at all comes from an inverted index. Each policy names witnesses:
tokens of which every caller that meets it holds at least one. A leaf is its own witness, an OR needs those of all
its parts, an AND those of its rarest part, k of n those of the n-k+1 rarest. So a token that half of all callers
hold makes no pairs where the policy asks for a rare one too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealedspark.layout import broadcast_if_few, pin, shuffled, spread
from sealedspark.policy import All_, Any_, AtLeast, Leaf, Node, PolicyError, normalize_attrs, parse

UP = "array<struct<node:int,kind:string,k:int>>"
_PATH = pa.list_(pa.struct([("node", pa.int32()), ("kind", pa.string()), ("k", pa.int32())]))
_LEAVES = pa.list_(pa.struct([("token", pa.string()), ("path", _PATH)]))
# At most so many granted (class, policy) rows of text are broadcast; more are joined by shuffle.
FEW = 100_000
# Callers of one class in a row, about; tokens whose holders are counted; holders and policies at one address, about.
CLASS, COMMON, TOGETHER, MANY = 1_000_000, 100_000, 10_000, 1_000_000
# One in so many policies is looked at for how often tokens are witnesses; this bears on the layout only.
SAMPLED = 100
# A token in a text that any parser would take for one, and what stands for it while texts of one shape are told apart.
# No leaf has a quotation mark in it, so it separates.
TOKEN, MARK, QUOTE = r"[A-Za-z0-9_.@/+-]+:[A-Za-z0-9_.@/+:-]+", "\x01", '"'


def _kind(node: Node) -> tuple[str, int]:
    """How a node counts its parts: all of them, one, or k."""
    if isinstance(node, AtLeast):
        return "of", node.k
    return ("and", len(node.parts)) if isinstance(node, All_) else ("or", 1)


def _leaves(node: Node) -> list[dict]:
    """The leaves of a tree, each with its ancestors from the nearest to the root."""
    out, ids = [], iter(range(1 << 30))

    def walk(n: Node, above: list[dict]) -> None:
        if isinstance(n, Leaf):
            out.append({"token": n.token, "path": above})
            return
        kind, k = _kind(n)
        here = [{"node": next(ids), "kind": kind, "k": k}, *above]
        for part in n.parts:
            walk(part, here)

    walk(node, [])
    return out


def _witness(node: Node, held: dict[str, int]) -> tuple[int, list[str]]:
    """How many callers hold the witnesses of a tree, and these tokens."""
    if isinstance(node, Leaf):
        return held.get(node.token, 0), [node.token]
    parts = sorted(_witness(p, held) for p in node.parts)
    k = len(parts) if isinstance(node, All_) else 1 if isinstance(node, Any_) else node.k
    if k > len(parts):
        return 0, []  # more than there are: nobody
    need = parts[: len(parts) - k + 1]
    return sum(n for n, _ in need), [t for _, tokens in need for t in tokens]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, leaves, reasons = batch.column("policy").to_pylist(), [], []
        for t in texts:
            try:
                leaves.append(_leaves(parse(t)))
                reasons.append(None)
            except PolicyError as e:  # unreadable: denies, with its reason
                leaves.append(None)
                reasons.append(str(e))
        yield pa.RecordBatch.from_arrays([batch.column("policy"), pa.array(leaves, _LEAVES), pa.array(reasons, pa.string())], names=["policy", "leaves", "reason"])


def trees(policies: DataFrame) -> DataFrame:
    """policy, leaves (token and path), reason for the distinct texts of `policies` (policy; other columns are ignored).

    A text that does not parse has a reason and no leaves. Null is no policy and has no row: it denies.
    """
    texts = policies.select("policy").where("policy IS NOT NULL").distinct()
    return texts.mapInArrow(_read, f"policy string, leaves array<struct<token:string,path:{UP}>>, reason string")


def quarantine(policies: DataFrame) -> DataFrame:
    """policy, reason of the texts that do not parse."""
    return trees(policies).where("reason IS NOT NULL").select("policy", "reason")


def _climb(rows: DataFrame, by: list[str], value: Column, most: int) -> DataFrame:
    """Rows (by, path, id, value) of leaves, folded level by level, the deepest first, into one row a tree.

    All levels group within the same `by`, so that one shuffle serves them all. Parts that stand higher than the
    level pass as they are.
    """
    rows = rows.repartition(*by)
    for level in range(most, 0, -1):
        now = F.size("path") == level
        up = F.get("path", 0)
        own = F.when(now, up["node"]).alias("own"), F.when(~now, F.col("id")).alias("id"), now.alias("now")
        g = rows.select(*by, "path", "value", *own).groupBy(*by, "now", "own", "id")
        g = g.agg(F.count("*").alias("n"), F.sum("value").alias("sum"), F.min("value").alias("least"), F.first("path").alias("path"))
        rows = g.select(
            *by, F.when(F.col("now"), F.slice("path", 2, F.size("path"))).otherwise(F.col("path")).alias("path"),
            F.when(F.col("now"), F.concat(F.lit("n"), F.col("own"))).otherwise(F.col("id")).alias("id"),
            F.when(F.col("now"), value).otherwise(F.col("least")).alias("value"))
    return rows


def _exploded(t: DataFrame) -> DataFrame:
    each = t.select("policy", F.posexplode("leaves").alias("i", "leaf"))
    return each.select("policy", F.concat(F.lit("l"), "i").alias("id"), "leaf.token", "leaf.path", F.lit(1).cast("long").alias("value"))


def _depth(t: DataFrame) -> int:
    return t.agg(F.max(F.array_max(F.transform("leaves", lambda x: F.size(x["path"]))))).first()[0] or 0


def min_attrs(policies: DataFrame) -> DataFrame:
    """policy, min_attrs of every text that parses: a leaf counts 1, AND the sum, OR the least, k of n counts k."""
    t = pin(trees(policies).where("leaves IS NOT NULL"))
    up = F.get("path", 0)
    value = F.when(up["kind"] == "of", up["k"].cast("long")).when(up["kind"] == "and", F.col("sum")).otherwise(F.col("least"))
    return _climb(_exploded(t).drop("token"), ["policy"], value, _depth(t)).select("policy", F.col("value").alias("min_attrs"))


def _postfix(node: Node) -> list[str]:
    """The nodes of a tree, parts before wholes: "." is a leaf, k/n asks for k of the n parts before it."""
    if isinstance(node, Leaf):
        return ["."]
    return [x for p in node.parts for x in _postfix(p)] + [f"{_kind(node)[1]}/{len(node.parts)}"]


def _tokens(node: Node) -> list[str]:
    return [node.token] if isinstance(node, Leaf) else [t for p in node.parts for t in _tokens(p)]


@lru_cache(maxsize=10_000)
def _shape(skeleton: str) -> tuple[str, str] | None:
    """The tree of a text whose tokens are MARK, in postfix, and a pattern that takes the tokens out of such texts.

    None where the text has to be parsed by itself: it cannot be read, or a token is but a part of a leaf.
    """
    pieces = skeleton.split(MARK)
    if len(pieces) > 100:
        return None
    try:
        node = parse(pieces[0] + "".join(f"{MARK}:{i}{x}" for i, x in enumerate(pieces[1:])))
    except PolicyError:
        return None
    if _tokens(node) != [f"{MARK}:{i}" for i in range(len(pieces) - 1)]:
        return None
    plain = [re.sub(r"[^A-Za-z0-9_\x80-\U0010ffff]", lambda m: f"\\x{{{ord(m[0]):x}}}", x) for x in pieces]
    return " ".join(_postfix(node)), "^" + plain[0] + "".join(f"(?P<t{i}>{TOKEN}){x}" for i, x in enumerate(plain[1:])) + "$"


def _rarest(shape: str, held: np.ndarray) -> np.ndarray:
    """`_witness` for many trees of one shape: which leaves are witnesses, of a row of leaves' holders each."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    leaf = 0
    for x in shape.split(" "):
        if x == ".":
            mask = np.zeros(held.shape, bool)
            mask[:, leaf] = True
            done.append((held[:, leaf], mask))
            leaf += 1
            continue
        k, m = map(int, x.split("/"))
        parts = done[-m:]
        del done[-m:]
        n, masks = np.stack([p[0] for p in parts], 1), [p[1] for p in parts]
        take = np.zeros(n.shape, bool)
        if k <= m:  # else nobody
            np.put_along_axis(take, np.argsort(n, 1, kind="stable")[:, : m - k + 1], True, 1)
        done.append(((n * take).sum(1), np.any([x & take[:, [i]] for i, x in enumerate(masks)], axis=0)))
    return done[0][1]


def _head(shape: str, witnesses: list[int]) -> str:
    return f"{shape}|{' '.join(map(str, witnesses))}"


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _parsed(often, texts: pa.Array):
    """Of distinct texts that parse: which, their head (shape and witnesses), leaves and witnesses (lists)."""
    common, counts = often.value
    skeletons = pc.dictionary_encode(pc.replace_substring_regex(texts, TOKEN, MARK))
    kinds, code = skeletons.dictionary.to_pylist(), skeletons.indices.to_numpy()
    code = np.where(pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False), -1, code)
    order = np.argsort(code, kind="stable")
    at = np.searchsorted(code[order], np.arange(len(kinds) + 1))
    alone = [order[: at[0]]]
    for i, (lo, hi) in enumerate(pairwise(at.tolist())):
        own, known = order[lo:hi], _shape(kinds[i]) if hi - lo >= 8 and MARK in kinds[i] else None
        if known is None:
            alone.append(own)
            continue
        cells = pc.extract_regex(texts.take(pa.array(own)), known[1])
        columns = [pc.ascii_lower(cells.field(j)) for j in range(cells.type.num_fields)]
        where = [pc.index_in(c, common).fill_null(-1).to_numpy() for c in columns]
        held = np.stack([counts[w] for w in where], 1)  # the last count stands for all other tokens
        rare = _rarest(known[0], held)
        row, leaf = np.nonzero(rare)
        n, m = held.shape
        _, one, which = np.unique(np.packbits(rare, 1), axis=0, return_index=True, return_inverse=True)
        heads = pa.array([_head(known[0], np.flatnonzero(rare[j]).tolist()) for j in one], pa.string()).take(pa.array(which.ravel()))
        leaves = pa.concat_arrays(columns).take(pa.array((np.arange(m) * n + np.arange(n)[:, None]).ravel()))
        yield own, heads, _lists(np.full(n, m), leaves), _lists(np.bincount(row, minlength=n), pa.array(leaf.astype(np.int32)))
    held, rows = None, []
    for i in np.sort(np.concatenate(alone)).tolist():
        try:
            node = parse(texts[i].as_py())
        except PolicyError:
            continue
        held = dict(zip(common.to_pylist(), counts[:-1].tolist(), strict=True)) if held is None else held
        leaves = _tokens(node)
        found = sorted({leaves.index(t) for t in _witness(node, held)[1]})
        rows.append((i, _head(" ".join(_postfix(node)), found), leaves, found))
    if rows:
        which, heads, leaves, found = zip(*rows, strict=True)
        yield np.array(which), pa.array(heads), pa.array(leaves, pa.list_(pa.string())), pa.array(found, pa.list_(pa.int32()))


def _split(split, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Over how many parts of its holders, and of its policies, a token is dealt."""
    names, holders, policies = split.value
    i = pc.index_in(tokens, names).fill_null(-1).to_numpy()
    return holders[i], policies[i]  # the last entry stands for all other tokens


def _addressed(row: np.ndarray, tokens: pa.Array, one: np.ndarray, of: np.ndarray, many: np.ndarray, first: bool, n: int) -> pa.ListArray:
    """For each row the addresses of its tokens: its own part of one side beside all parts of the other."""
    rep = np.repeat(np.arange(len(row)), many)
    each = np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
    own, dealt = (one % of)[rep], pa.array((of * many > 1)[rep])
    names = tokens.take(pa.array(rep))
    if pc.any(dealt).as_py():
        parts = [pa.array(x).cast(pa.string()) for x in ([own, each] if first else [each, own])]
        names = pc.if_else(dealt, pc.binary_join_element_wise(names, *parts, QUOTE), names)
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    cells = pa.StructArray.from_arrays([pa.array(nth[rep].astype(np.int32)), names], names=["nth", "at"])
    return _lists(np.bincount(row[rep], minlength=n), cells)


_AT = "array<struct<nth:int,at:string>>"


def _policies_at(often, split):
    """keys, body (head and leaves), at for the policies of a batch, equal ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("policy")))
            if not batch.num_rows:
                continue
            found = pc.dictionary_encode(batch.column("policy"))
            code = found.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            sizes = np.bincount(code, minlength=len(found.dictionary))
            keys = _lists(sizes, batch.column("key").take(pa.array(order)))
            for which, heads, leaves, witness in _parsed(often, found.dictionary):
                n = len(which)
                row = np.repeat(np.arange(n), witness.value_lengths().to_numpy())
                tokens = leaves.flatten().take(pa.array(leaves.offsets.to_numpy()[row] + witness.flatten().to_numpy()))
                holders, policies = _split(split, tokens)
                at = _addressed(row, tokens, which[row], policies, holders, False, n)
                body = pc.binary_join_element_wise(heads, pc.binary_join(leaves, QUOTE), QUOTE)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(which)), body, at], names=["keys", "body", "at"])

    return run


def _callers_at(split):
    """callers, body (attributes), at for classes of callers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            attrs = batch.column("attrs")
            n, row, tokens = len(attrs), np.repeat(np.arange(len(attrs)), attrs.value_lengths().to_numpy()), attrs.flatten()
            odd = pc.match_substring(tokens, QUOTE)
            if pc.any(odd).as_py():  # no leaf of a policy has a quotation mark
                row, tokens = row[~odd.to_numpy(zero_copy_only=False)], tokens.filter(pc.invert(odd))
                attrs = _lists(np.bincount(row, minlength=n), tokens)
            holders, policies = _split(split, tokens)
            at = _addressed(row, tokens, batch.column("number").to_numpy()[row], holders, policies, True, n)
            yield pa.RecordBatch.from_arrays([batch.column("callers"), pc.binary_join(attrs, QUOTE), at], names=["callers", "body", "at"])

    return run


def _true(shape: str, n: int, hit) -> np.ndarray:
    """Which of n pairs meet a tree; hit(leaf, some) says of some pairs whether the caller holds the leaf's token."""
    stack: list[list] = []  # where the parts of a node begin in its postfix, so that whole nodes are left out
    items, leaf = shape.split(" "), 0
    for x in items:
        if x == ".":
            stack.append([0, leaf])
            leaf += 1
        else:
            k, m = map(int, x.split("/"))
            parts = stack[-m:]
            del stack[-m:]
            stack.append([k, parts])

    def value(node: list, some: np.ndarray) -> np.ndarray:
        k, parts = node
        if not k:
            return hit(parts, some)
        count, left = np.zeros(len(some), np.int32), np.arange(len(some))
        for i, part in enumerate(parts):
            count[left] += value(part, some[left])
            now = count[left]
            left = left[(now < k) & (now + len(parts) - i - 1 >= k)]
            if not len(left):
                break
        return count >= k

    return value(stack[0], np.arange(n))


def _holding(attrs: pa.ListArray, codes: np.ndarray):
    """A function of callers and codes, pair by pair: whether the caller's attributes have the code."""
    sizes, start = attrs.value_lengths().to_numpy(), attrs.offsets.to_numpy() - attrs.offsets[0].as_py()
    most = int(sizes.max(initial=0))
    if most <= 64:
        slots = np.full((most, len(sizes)), -1, np.int32)
        row = np.repeat(np.arange(len(sizes)), sizes)
        slots[np.arange(len(row)) - start[row], row] = codes

        def few(caller: np.ndarray, code: np.ndarray) -> np.ndarray:
            out = np.zeros(len(caller), bool)
            for s in slots:
                out |= s[caller] == code
            return out

        return few
    width = int(codes.max()) + 2
    pairs = np.sort(np.repeat(np.arange(len(sizes)), sizes) * width + codes)

    def many(caller: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = caller * width + np.minimum(code, width - 1)
        return pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] == key

    return many


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, caller_id of the pairs that meet; rows lie by address, callers before policies.

    A pair is told at the first witness of its policy that the caller holds, so that it comes once.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        at = t.column("at")
        head = np.append(True, pc.not_equal(at.slice(1), at.slice(0, len(at) - 1)).to_numpy(zero_copy_only=False))
        group = np.cumsum(head) - 1
        asks = t.column("nth").is_valid().to_numpy(zero_copy_only=False)
        callers, policies = np.flatnonzero(~asks), np.flatnonzero(asks)
        last = callers[group[callers] == group[-1]]
        yield from _met(t, group, callers, policies)
        held = t.take(pa.array(last)) if len(last) else None


def _met(t: pa.RecordBatch, group: np.ndarray, callers: np.ndarray, policies: np.ndarray, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    size = np.bincount(group[callers], minlength=group[-1] + 1)
    policies = policies[size[group[policies]] > 0]
    if not len(policies):
        return
    needed = np.zeros(len(size), bool)
    needed[group[policies]] = True
    callers = callers[needed[group[callers]]]
    first = np.searchsorted(group[callers], group[policies])
    last = first + size[group[policies]]
    who, what = (pc.split_pattern(t.column("body").take(pa.array(i)), QUOTE) for i in (callers, policies))
    names, cells = who.flatten(), what.flatten()
    codes = pc.dictionary_encode(pa.concat_arrays([names, cells])).indices.to_numpy()
    holds, asked = _holding(who, codes[: len(names)]), codes[len(names) :]
    begin, nth = what.offsets.to_numpy()[:-1] - what.offsets[0].as_py() + 1, t.column("nth").to_numpy(zero_copy_only=False)[policies]
    nth = nth.astype(np.int64)
    heads = pc.dictionary_encode(cells.take(pa.array(begin - 1)))
    code = heads.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    lists = [(x.flatten(), x.offsets.to_numpy() - x.offsets[0].as_py()) for x in (t.column("keys").take(pa.array(policies)), t.column("callers").take(pa.array(callers)))]
    for i, (lo, hi) in enumerate(pairwise(np.searchsorted(code[order], np.arange(len(heads.dictionary) + 1)).tolist())):
        shape, witnesses = heads.dictionary[i].as_py().split("|")
        own = order[lo:hi]
        for part in np.split(own, np.flatnonzero(np.diff(np.cumsum((last - first)[own]) // most)) + 1):
            n = (last - first)[part]
            p = np.repeat(part, n)
            c = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + first[p]
            good = np.flatnonzero(_true(shape, len(p), lambda leaf, some, p=p, c=c: holds(c[some], asked[begin[p[some]] + leaf])))
            p, c = p[good], c[good]
            for j, leaf in enumerate(map(int, witnesses.split(" "))):  # told already at an earlier witness
                keep = nth[p] <= j
                keep[~keep] = ~holds(c[~keep], asked[begin[p[~keep]] + leaf])
                p, c = p[keep], c[keep]
            yield from _expanded(p, c, *lists)


def _expanded(p: np.ndarray, c: np.ndarray, keys: tuple, ids: tuple, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Each key of policy p beside each caller of class c."""
    (keys, k0), (ids, c0) = keys, ids
    wide = c0[c + 1] - c0[c]
    ends = np.cumsum((k0[p + 1] - k0[p]) * wide)
    total = int(ends[-1]) if len(ends) else 0
    for lo in range(0, total, most):
        at = np.arange(lo, min(total, lo + most))
        pair = np.searchsorted(ends, at, "right")
        inner = at - np.append(0, ends)[pair]
        key, who = k0[p[pair]] + inner // wide[pair], c0[c[pair]] + inner % wide[pair]
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(key)), ids.take(pa.array(who))], names=["key", "caller_id"])


def _frequent(counts: DataFrame, most: int) -> tuple[pa.Array, np.ndarray]:
    """The tokens of the largest counts (token, n), at most `most` of them: those of one count all or not at all."""
    least, n = None, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.desc("n")).limit(most).collect():
        n += r.m
        if n > most:
            break
        least = r.n
    got = counts.where(F.lit(False) if least is None else F.col("n") >= least).select("token", "n").toArrow()
    return pa.array(got.column("token").to_pylist(), pa.string()), got.column("n").to_numpy().astype(np.int64)


def _grants(policies: DataFrame, callers: DataFrame) -> DataFrame:
    """key, caller_id: which rows of `policies` (key, policy) each of `callers` (caller_id, attrs) meets.

    Policies and callers come together at the address of a witness and are judged there many at once. Tokens that
    very many callers hold, or very many policies have as a witness, are dealt over several addresses; how many
    only bears on the layout, so policies' tokens are counted on a sample.
    """
    spark = policies.sparkSession
    attrs = F.sort_array(normalize_attrs(F.filter("attrs", lambda a: a.isNotNull())))
    c = pin(spread(callers).select("caller_id", attrs.alias("attrs"))).where("size(attrs) > 0")
    once = c.groupBy("caller_id").count().where("count > 1").isEmpty()
    c = c if once else c.distinct()
    chunks = c.count() // CLASS + 1
    classes = c.groupBy("attrs", F.pmod(F.xxhash64("caller_id"), F.lit(chunks)).alias("chunk")).agg(F.collect_list("caller_id").alias("callers"))
    classes = pin(classes.select("callers", "attrs", F.monotonically_increasing_id().alias("number")))
    held = pin(classes.select(F.explode("attrs").alias("token")).groupBy("token").agg(F.count("*").alias("n")))
    common, counts = _frequent(held, COMMON)
    often = spark.sparkContext.broadcast((common, np.append(counts, 0)))
    none = spark.sparkContext.broadcast((pa.array([], pa.string()), np.ones(1, np.int64), np.ones(1, np.int64)))
    key, who = (dict(x.dtypes)[n] for x, n in ((policies, "key"), (callers, "caller_id")))
    made = f"keys array<{key}>, body string, at {_AT}"
    parts = {t: [-(-n // TOGETHER), 1] for t, n in zip(common.to_pylist(), counts.tolist(), strict=True) if n > TOGETHER}
    seen = policies.sample(1 / SAMPLED, 7).mapInArrow(_policies_at(often, none), made).select(F.explode("at").alias("a"))
    seen = seen.groupBy(F.col("a.at").alias("token")).agg((F.count("*") * SAMPLED).alias("n"))
    for r in seen.where(F.col("n") > MANY).collect():  # as many as all policies have witnesses, over MANY
        parts.setdefault(r.token, [1, 1])[1] = -(-r.n // MANY)
    sizes = np.array([*parts.values(), [1, 1]], np.int64)
    split = spark.sparkContext.broadcast((pa.array(parts, pa.string()), sizes[:, 0], sizes[:, 1]))
    left = policies.select("key", "policy").mapInArrow(_policies_at(often, split), made)
    left = left.select("keys", F.lit(None).cast(f"array<{who}>").alias("callers"), "body", F.inline("at"))
    right = classes.mapInArrow(_callers_at(split), f"callers array<{who}>, body string, at {_AT}")
    right = right.select(F.lit(None).cast(f"array<{key}>").alias("keys"), "callers", "body", F.inline("at")).withColumn("nth", F.lit(None).cast("int"))
    rows = left.union(right).withColumn("g", F.xxhash64("at")).repartition("g").sortWithinPartitions("g", "at", F.asc_nulls_first("nth"))  # by a number first
    out = rows.drop("g").mapInArrow(_judged, f"key {key}, caller_id {who}")
    return out if once else out.distinct()


def satisfied(callers: DataFrame, policies: DataFrame) -> DataFrame:
    """Which caller meets which policy: caller_id, policy, for `callers` (caller_id, attrs) and `policies` (policy).

    As `policy.satisfied`, for any number of policies and callers: attributes are normalised, callers of equal
    attributes are one class and evaluated together, a null or unreadable policy and a caller without attributes grant
    nothing. Repeated policies count once; of a caller_id with several rows each row counts on its own.
    """
    texts = policies.select("policy").where("policy IS NOT NULL").distinct()
    texts = pin(texts.withColumn("key", F.monotonically_increasing_id()))
    return _grants(texts, callers).join(shuffled(texts), "key").select("caller_id", "policy")


def granted(docs: DataFrame, callers: DataFrame) -> DataFrame:
    """doc_id, caller_id: which of `docs` (doc_id, policy) each of `callers` (caller_id, attrs) may read.

    As `gate` for documents with no other columns and nearly as many policies as documents: texts are not joined.
    """
    return _grants(docs.select(F.col("doc_id").alias("key"), "policy"), callers).withColumnRenamed("key", "doc_id")


def gate(docs: DataFrame, callers: DataFrame) -> DataFrame:
    """`docs` (policy, ...) beside each caller_id that may read them; every document may have a policy of its own."""
    return docs.join(broadcast_if_few(pin(satisfied(callers, docs)), FEW), "policy")
