"""Keyed writes on immutable tables: upserts by column policy, insert-if-absent, change ledgers, work queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.relational import anti


def collapse_batch(incoming: DataFrame, keys: list[str], order: str, overwrite: list[str], keep: list[str]) -> DataFrame:
    """One row for each key of a batch: the last arrival's overwrite columns, the last non-null of each keep column."""
    at = F.col(order)
    aggs = [F.max_by(F.col(c), at).alias(c) for c in overwrite]
    aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in keep]
    return incoming.groupBy(*keys).agg(*aggs)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], overwrite: list[str], keep: list[str]) -> DataFrame:
    """existing with incoming merged: overwrite columns from incoming where it has the key, keep columns only if not null.

    One full outer join on the key; incoming must hold a key once (see collapse_batch).
    """
    new = incoming.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in (*overwrite, *keep)], F.lit(True).alias("_new"))
    joined = existing.select(*keys, *overwrite, *keep).join(new, keys, "full")
    over = [F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in overwrite]
    kept = [F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) for c in keep]
    return joined.select(*keys, *over, *kept)


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing and the incoming rows whose key it lacks."""
    return existing.unionByName(anti(incoming, existing, keys))


def stage_raw(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("source", "external_id")) -> DataFrame:
    """Raw payloads with a refreshed batch: equal keys get the new payload and are unprocessed again; blank ids are skipped."""
    keys = list(keys)
    fresh = incoming.where(F.trim(F.coalesce(F.col(keys[-1]), F.lit(""))) != "").withColumn("processed", F.lit(False))
    return anti(existing, fresh, keys).unionByName(fresh)


def change_ledger(existing: DataFrame, incoming: DataFrame, keys: list[str], state: list[str]) -> DataFrame:
    """Each incoming key with status inserted, changed or unchanged, by a hash of its material state."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in state])), 256)
    old = existing.select(*keys, digest.alias("_old"))
    new = incoming.select(*keys, digest.alias("state_hash"))
    status = F.when(F.col("_old").isNull(), "inserted").when(F.col("_old") == F.col("state_hash"), "unchanged").otherwise("changed")
    return new.join(old, keys, "left").select(*keys, "state_hash", status.alias("status"))


def unprocessed(raw: DataFrame, done: DataFrame, key: str, most: int) -> DataFrame:
    """The next rows of a work queue: not yet done, in key order."""
    return anti(raw, done, [key]).orderBy(key).limit(most)


def cached(wanted: DataFrame, cache: DataFrame, keys: list[str], digest: str) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses): an entry counts only if the content hash is the same."""
    return wanted.join(cache, [*keys, digest]), wanted.join(cache.select(*keys, digest), [*keys, digest], "left_anti")


def differences(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column, before, after of every value that a recomputation changed."""
    both = before.select(key, *[F.col(c).cast("string").alias(f"_b_{c}") for c in columns]).join(after.select(key, *[F.col(c).cast("string").alias(f"_a_{c}") for c in columns]), key)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_b_{c}").alias("before"), F.col(f"_a_{c}").alias("after")) for c in columns])
    return both.select(key, F.inline(rows)).where("NOT before <=> after")


def quarantine(df: DataFrame, column: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose column casts to a type, the rest as they were): bad rows do not stop the good ones."""
    cast = F.col(column).try_cast(kind)
    bad = F.col(column).isNotNull() & cast.isNull()
    return df.where(~bad).withColumn(column, cast), df.where(bad)
