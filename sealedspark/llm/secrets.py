"""Secret scans in Spark SQL functions alone, with linking of the parts of multipart credentials.

Base kinds (assign, access, hex) are always reported. Two weak kinds are candidates only: `secret`, a run of
20 or more key characters with a digit and letters of both cases, and `endpoint`, an http(s) address. They are
joined to their complements over intervals of `scope` code points around their start: a weak secret is
reported beside an access identifier, an endpoint beside an access identifier and a secret (assigned, hex or
weak). The interval join is a range frame over the spans of one text, so no pair is ever written out, and a
frame holds at most the spans that start within the scope.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealedspark.llm.common import cut, maybe_broadcast

# At most so many row numbers are broadcast (8 bytes each); more are joined by shuffle.
MAX_ROWS = 1_000_000

# Kinds in their order, with pattern and the group whose length counts (fixed values). Runs that end before
# the least length are the same with {n,} as with + and a length test; an assignment's are not, hence `least`.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("secret", r"[A-Za-z0-9+/_-]{20,}", 0, 20),
    ("endpoint", r"https?://[A-Za-z0-9.-]+(:[0-9]+)?[A-Za-z0-9/_.?=&%+-]*", 0, 8),
]
NAMES = [k[0] for k in KINDS]


def _found(text: Column, kind: int) -> Column:
    """Every match in order: its ordinal, the code points before it since the last match, its length, if it holds."""
    name, pattern, group, least = KINDS[kind]
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    tested = whole if group == 0 else F.regexp_extract_all(text, p, F.lit(group))

    def one(gap: Column, i: Column) -> Column:
        m, t = F.get(whole, i), F.get(tested, i)
        good = F.length(t) >= least
        if name == "secret":
            good = good & m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(gap).alias("gap"), F.length(m).alias("len"), good.alias("good")
        )

    gaps = F.split(text, pattern, -1)
    return F.when(F.size(whole) > 0, F.slice(F.transform(gaps, one), 1, F.size(whole)))


def find_spans(docs: DataFrame, scope: int = 256) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, row, spans.

    spans is an array of (start, kind, end): code points, end exclusive, kind an index into NAMES, in order of
    start and kind. A null or empty text has none. Repeated rows and null doc_ids give a row each.
    """
    found = [F.coalesce(_found(F.col("text"), k), F.expr("array()")) for k in range(len(KINDS))]
    empty = "array<struct<kind:int,i:int,gap:int,len:int,good:boolean>>"
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.concat(*(c.cast(empty) for c in found)).alias("m"),
    )
    rows = cut(rows)  # the row numbers are read twice
    each = rows.where("size(m) > 0").select("row", F.explode("m").alias("m")).select("row", "m.*")
    each = each.repartition("row")
    run = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(run)
    each = each.select("row", "kind", "good", end.alias("end"), (end - F.col("len")).alias("start")).where("good")
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    base_end = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(before)
    each = each.withColumn("covered", F.coalesce(base_end > F.col("start"), F.lit(False)))
    each = each.where("kind < 3 OR kind = 4 OR NOT covered")
    near = Window.partitionBy("row").orderBy("start").rangeBetween(-scope, scope)
    is_ = lambda *k: F.max(F.col("kind").isin(*k)).over(near)
    each = each.select("row", "kind", "start", "end", is_(1).alias("id_near"), is_(0, 2, 3).alias("secret_near"))
    each = each.where("kind < 3 OR (id_near AND (kind = 3 OR secret_near))")
    spans = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    out = rows.select("doc_id", "row").join(spans, "row", "left")
    none = F.expr("cast(array() AS array<struct<start:bigint,kind:int,end:bigint>>)")
    return out.select("doc_id", "row", F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    """The spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, NAMES))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def digests(found: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans and the list of all spans of what `find_spans` returns."""
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{NAMES[k]}") for k in range(3)),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, scope: int = 256, mark: str = "[secret]") -> DataFrame:
    """`docs` with every reported span of its texts replaced by `mark`; columns and their order stay.

    Overlapping spans become one mark. A text without spans, a null one included, stays as it is.
    """
    columns = docs.columns
    whole = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__doc")
    keyed = cut(docs.select(whole, "text", F.monotonically_increasing_id().alias("__row")))
    text = keyed.select(F.col("__row").alias("doc_id"), "text")
    hit = cut(find_spans(text, scope).where("size(spans) > 0").select(F.col("doc_id").alias("__row"), "spans"))
    # pieces between the marks, in order: explode the spans, merge overlaps by a running end
    s = hit.select("__row", F.explode("spans").alias("s")).select("__row", "s.start", "s.end").repartition("__row")
    by = Window.partitionBy("__row").orderBy("start", "end")
    past = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("past", F.coalesce(past, F.lit(0).cast("bigint"))).where("end > past OR past = 0")
    s = s.withColumn("mark", F.col("start") >= F.col("past")).select(
        "__row", F.struct("start", F.col("end"), F.greatest("past", "start").alias("from_"), "past", "mark").alias("p")
    )
    plan = s.groupBy("__row").agg(F.array_sort(F.collect_list("p")).alias("plan"))
    # up to a checked number of row numbers is broadcast, so that only texts with secrets are shuffled
    rows = maybe_broadcast(hit.select("__row"), MAX_ROWS)
    clean = keyed.join(rows, "__row", "left_anti").select("__doc.*")
    joined = keyed.join(rows, "__row", "left_semi").join(plan, "__row")
    pieces = F.transform(
        "plan",
        lambda p: F.when(
            p["mark"], F.concat(F.substring(F.col("text"), (p["past"] + 1).cast("int"), (p["start"] - p["past"]).cast("int")), F.lit(mark))
        ).otherwise(F.lit("")),
    )
    tail = F.substring(F.col("text"), (F.array_max(F.transform("plan", lambda p: p["end"])) + 1).cast("int"), F.lit(2**31 - 1))
    new = F.concat(F.concat_ws("", pieces), tail)
    masked = joined.select("__doc", new.alias("__new")).select(*(F.col("__new").alias(c) if c == "text" else F.col(f"__doc.`{c}`") for c in columns))
    return clean.union(masked)


def oracle() -> str:
    """DuckDB SQL for the digests of table documents."""
    parts = []
    for k, (name, pattern, group, least) in enumerate(KINDS):
        q = pattern.replace("'", "''")
        extra = " AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')" if name == "secret" else ""
        parts.append(f"""SELECT r, {k} AS kind, e - length(m) AS s, e FROM (SELECT r, m, g,
  sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM (SELECT r, unnest(a[1:len(m)]) AS gap,
  unnest(m) AS m, unnest(g) AS g, unnest(range(len(m))) AS i FROM (SELECT r, string_split_regex(text, '{q}') AS a,
  regexp_extract_all(text, '{q}') AS m, regexp_extract_all(text, '{q}', {group}) AS g FROM d))) WHERE length(g) >= {least}{extra}""")
    names = "['assign', 'access', 'hex', 'secret', 'endpoint'][kind + 1]"
    joined = f"string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    near = "abs(o.s - a.s) <= 256 AND o.r = a.r"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
a0 AS ({" UNION ALL ".join(parts)}),
a AS (SELECT * FROM a0 WHERE kind <> 3 OR NOT EXISTS (FROM a0 o WHERE o.r = a0.r AND o.kind < 3 AND o.s <= a0.s AND o.e > a0.s)),
b AS (SELECT * FROM a WHERE kind < 3 OR (EXISTS (FROM a o WHERE {near} AND o.kind = 1)
  AND (kind = 3 OR EXISTS (FROM a o WHERE {near} AND o.kind IN (0, 2, 3)))))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
  count(*) FILTER (kind = 2) AS n_hex, sha256(coalesce({joined} FILTER (kind < 3), '')) AS base_sha256,
  coalesce({joined}, '') AS spans FROM d LEFT JOIN b USING (r) GROUP BY d.r, d.doc_id"""
