"""Keyed tags over stored documents, the manifest of expected ids, and reports of what was tampered with.

HMAC-SHA256 is built from Catalyst functions. The key's two pads come as columns of a broadcast row, so that no plan shows
them and no Python worker runs; `mac_sql` writes them into the plan and is for tests, `mac_udf` is a Python function for
single columns. Tags are compared by Catalyst, which does not take constant time: a batch job answers nobody.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import secrets

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEALED = ("doc_id", "ct", "tag", "meta", "version")
NOTES = {
    "doc_missing": "registered but absent",
    "store_unreadable": "no readable content",
    "missing_mac": "no tag or no version",
    "mac_mismatch": "the tag is not that of the content",
    "version_rollback": "an older version than the registered one",
}


def _part(text: Column) -> Column:
    """A text with its length, so that parts cannot run into each other; null differs from empty."""
    return F.when(text.isNull(), "N").otherwise(F.concat(F.lit("S"), F.length(text).cast("string"), F.lit(":"), text))


def content_text(ct: Column, kind: T.DataType) -> Column:
    """Content as a text that names its kind: bytes as hex, lists as comma-joined items, the rest as it is."""
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("B"), F.hex(ct))
    if isinstance(kind, T.ArrayType):
        items = F.transform(ct, lambda x: F.coalesce(F.hex(x) if isinstance(kind.elementType, T.BinaryType) else x.cast("string"), F.lit("N")))
        return F.when(ct.isNotNull(), F.concat(F.lit("L"), F.concat_ws(",", items)))
    return F.concat(F.lit("T"), ct.cast("string"))


def meta_text(meta: Column) -> Column:
    """A map as the parts of its keys and values in the order of the keys; null for null."""
    each = F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(_part(e["key"].cast("string")), _part(e["value"].cast("string"))))
    return F.when(meta.isNotNull(), F.concat_ws("", each))


def canonical(store: DataFrame) -> Column:
    """One unambiguous text of what is sealed of a row: doc_id, ct, tag, meta (a map; may be absent) and version."""
    kinds = {f.name: f.dataType for f in store.schema}
    texts = []
    for name in SEALED:
        if name not in kinds:
            texts.append(F.lit(None).cast("string"))
        elif name == "ct":
            texts.append(content_text(F.col(name), kinds[name]))
        else:
            texts.append(meta_text(F.col(name)) if isinstance(kinds[name], T.MapType) else F.col(name).cast("string"))
    return F.concat(*map(_part, texts))


def _check(key: bytes) -> bytes:
    if len(key) != 32:
        raise ValueError("an integrity key has 32 bytes")
    return key


def load_key(path: str, key: bytes | None = None) -> bytes:
    """The key of a driver's file, made if the file is absent; an explicit key is checked and not written."""
    if key is not None:
        return _check(key)
    if not os.path.exists(path):
        with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
            f.write(secrets.token_bytes(32))
    with open(path, "rb") as f:
        return _check(f.read())


def _pads(key: bytes) -> tuple[bytes, bytes]:
    padded = _check(key) + bytes(32)
    return tuple(bytes(b ^ x for b in padded) for x in (0x36, 0x5C))


def _hmac(inner: Column, outer: Column, message: Column) -> Column:
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def mac_sql(key: bytes, message: Column) -> Column:
    return _hmac(*map(F.lit, _pads(key)), message)


def mac_udf(key: bytes, message: Column) -> Column:
    _check(key)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hmac.new(key, t.encode(), hashlib.sha256).hexdigest())

    return run(message)


def _with_mac(store: DataFrame, key: bytes, name: str, mac=None) -> DataFrame:
    if mac:
        return store.withColumn(name, mac(key, canonical(store)))
    row = store.sparkSession.createDataFrame([tuple(map(bytearray, _pads(key)))], "__inner binary, __outer binary")
    both = store.crossJoin(F.broadcast(row))  # one row
    return both.withColumn(name, _hmac(F.col("__inner"), F.col("__outer"), canonical(store))).drop("__inner", "__outer")


def seal(store: DataFrame, key: bytes, mac=None) -> DataFrame:
    """`store` (doc_id, ct, tag, version, and meta if there is any) with its mac."""
    return _with_mac(store, key, "mac", mac)


def check(store: DataFrame, manifest: DataFrame, key: bytes, mac=None) -> DataFrame:
    """Every id of a store or its manifest (doc_id, version) with a reason, null if nothing is wrong.

    The reasons are those of NOTES, in their order. Ids that were never registered are not missed; rows that
    were put in without a right mac are reported as any other.
    """
    s = _with_mac(store, key, "want", mac).withColumn("here", F.lit(True))
    both = s.join(manifest.select("doc_id", F.col("version").alias("registered")), "doc_id", "full_outer")
    reason = (
        F.when(F.col("here").isNull(), "doc_missing").when(F.col("ct").isNull(), "store_unreadable")
        .when(F.col("mac").isNull() | F.col("version").isNull(), "missing_mac").when(F.col("mac") != F.col("want"), "mac_mismatch")
        .when(F.col("version") < F.col("registered"), "version_rollback")
    )
    return both.select("doc_id", reason.alias("reason"))


def verify(store: DataFrame, manifest: DataFrame, key: bytes, mac=None) -> DataFrame:
    """The incidents of a store against its manifest: doc_id, reason."""
    return check(store, manifest, key, mac).where("reason IS NOT NULL")


def verified(store: DataFrame, key: bytes, mac=None) -> DataFrame:
    """The rows of a store whose mac is right."""
    return _with_mac(store, key, "want", mac).where("ct IS NOT NULL AND version IS NOT NULL AND mac = want").drop("want")


def incidents(found: DataFrame) -> DataFrame:
    """Rows for the incident log: doc_id, reason, ts, note."""
    notes = F.create_map(*(F.lit(x) for pair in NOTES.items() for x in pair))
    return found.select("doc_id", "reason", F.current_timestamp().alias("ts"), F.element_at(notes, F.col("reason")).alias("note"))


def missing(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """Registered ids that a store lacks."""
    return manifest.select("doc_id").distinct().join(store.select("doc_id"), "doc_id", "left_anti")


def stale(store: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of a store whose id no manifest names."""
    return store.join(manifest.select("doc_id"), "doc_id", "left_anti")


def registered(manifest: DataFrame, put: DataFrame) -> DataFrame:
    """A manifest (doc_id, version) grown by the rows of `put`: the newest version of each id."""
    return manifest.select("doc_id", "version").union(put.select("doc_id", "version")).groupBy("doc_id").agg(F.max("version").alias("version"))


def _saves(spark: SparkSession, path: str, id_type: str) -> DataFrame | None:
    try:
        found = spark.read.json(path, schema=f"doc_id {id_type}, version bigint")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found if "save" in found.columns else found.withColumn("save", F.lit(0))


def save_manifest(manifest: DataFrame, path: str) -> None:
    """Save a manifest below save=N beside the earlier ones, of which none is touched: a save that dies loses nothing."""
    before = _saves(manifest.sparkSession, path, "string")
    number = (before.agg(F.max("save")).first()[0] or 0) if before is not None else 0
    manifest.select("doc_id", "version").write.mode("overwrite").json(f"{path}/save={number + 1}")  # what a dead save left


def load_manifest(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The last manifest saved at a path, or a plain JSON file; rows that lack an id or a version are an error."""
    found = _saves(spark, path, id_type)
    if found is None:
        raise FileNotFoundError(path)
    last = found.agg(F.max("save")).first()[0]
    rows = found.where(F.col("save") == F.lit(last)).drop("save")
    if not rows.where("doc_id IS NULL OR version IS NULL").isEmpty():
        raise ValueError(f"{path}: malformed manifest")
    return rows


def latest(store: DataFrame) -> DataFrame:
    """The newest version of each doc_id."""
    cols = [c for c in store.columns if c != "doc_id"]
    best = F.max_by(F.struct(*cols), F.col("version"))
    return store.groupBy("doc_id").agg(best.alias("x")).select("doc_id", "x.*")
