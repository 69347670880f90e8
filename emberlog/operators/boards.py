"""Leaderboard records and archives: validation, latest and best of an identity, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The counters of a record, and its optional readings.
COUNTERS = ("max_health", "personal_kills", "personal_deaths", "high_hit", "coin_looted")
RECORD = (
    "public_key string, submission_id string, alias string, captured_at string, max_health long, max_mana long, personal_kills long, personal_deaths long, "
    "high_hit long, coin_looted long, sequence long, capture_backend string, signature string"
)


def valid(records: DataFrame) -> DataFrame:
    """Records of the right shape, the first of each submission: hex keys, a UTC stamp, counters in range.

    Signatures are checked for their shape only.
    """
    ok = (F.col("public_key").rlike("^[0-9a-f]{64}$") & F.col("submission_id").rlike("^[0-9a-f]{32}$") & F.col("signature").rlike("^[0-9a-f]{128}$")
          & F.col("captured_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$") & F.try_to_timestamp("captured_at", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).isNotNull()
          & (F.length(F.trim("alias")).between(1, 32)) & (F.col("sequence") >= 1))
    for c in COUNTERS:
        ok = ok & F.col(c).between(0, 2**53)
    w = Window.partitionBy("submission_id").orderBy("captured_at", "sequence")
    return records.where(F.coalesce(ok, F.lit(False))).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest(records: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key with the largest ``order``: one aggregate, no sort of a key's history."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, *[F.col(f"_r.{c}") for c in rest])


def personal_bests(records: DataFrame, key: str, fields: list[str], at: str) -> DataFrame:
    """``(key, field, best, first_at)``: each field's largest value and when it was reached first."""
    long = records.unpivot([key, at], fields, "field", "value").where("value is not null")
    return long.groupBy(key, "field").agg(F.min(F.struct((-F.col("value")).alias("v"), F.col(at).alias("t"))).alias("_m")).select(key, "field", (-F.col("_m.v")).alias("best"), F.col("_m.t").alias("first_at"))


def reading_total(*columns: str):
    """The sum of readings only if none is missing."""
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c)
    return total


def accepted(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New records that may be appended: unknown submissions whose sequence and counters do not fall below the identity's latest."""
    fresh = new.join(existing.select("submission_id"), "submission_id", "left_anti")
    top = existing.groupBy("public_key").agg(F.max("sequence").alias("_seq"), *[F.max(c).alias(f"_{c}") for c in COUNTERS])
    j = fresh.join(top, "public_key", "left")
    ok = F.col("sequence") > F.coalesce("_seq", F.lit(0))
    for c in COUNTERS:
        ok = ok & (F.col(c) >= F.coalesce(f"_{c}", F.lit(0)))
    return j.where(ok).select(*new.columns)


def upsert(archive: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last write wins by key and version."""
    both = archive.unionByName(changes)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in rest])


def prune(archive: DataFrame, cutoff, updated: str, protected: DataFrame, key: str) -> DataFrame:
    """Rows updated at or after ``cutoff``, and the protected."""
    p = protected.select(F.col(key).alias("_p")).distinct()
    return archive.join(p, archive[key] == F.col("_p"), "left").where((F.col(updated) >= cutoff) | F.col("_p").isNotNull()).drop("_p")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def page(rows: DataFrame, order: list, size: int, number: int) -> DataFrame:
    return rows.orderBy(*order).offset(size * number).limit(size)
