"""Strata, caps, folds and leakage."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.operators.relational import hash_order


def ranked(df: DataFrame, *order) -> DataFrame:
    """The rows with _rank from 1 in an order, for a pool that a limit has already bounded."""
    return df.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))


def strata(pool: DataFrame, total: int, key: str, score: str, confidence: str, seed: int = 42, shares: tuple[float, float] = (0.4, 0.3)) -> DataFrame:
    """key, stratum of a batch: the best by score, then the least confident of the rest, then random ones.

    Shares are rounded down and the remainder is random. Each stratum is a top-k over what the others left.
    """
    n1, n2 = int(total * shares[0]), int(total * shares[1])
    top = pool.orderBy(F.col(score).desc_nulls_last(), F.col(key)).limit(n1).select(key, F.lit("top").alias("stratum"))
    rest = pool.join(top.select(key), key, "left_anti")
    unsure = rest.orderBy(F.col(confidence).asc_nulls_last(), F.col(key)).limit(n2).select(key, F.lit("uncertain").alias("stratum"))
    rest = rest.join(unsure.select(key), key, "left_anti")
    drawn = rest.orderBy(hash_order(key, seed=seed), F.col(key)).limit(total - n1 - n2).select(key, F.lit("random").alias("stratum"))
    return top.unionByName(unsure).unionByName(drawn)


def capped(pool: DataFrame, group: str, order: list, most: int, history: DataFrame | None = None, most_ever: int = 5) -> DataFrame:
    """The first rows of each group in an order: at most `most`, and with history (group, n) at most `most_ever` in all.

    Caps are by group, so a rank inside the group picks the same rows as a scan in score order would.
    """
    d = pool.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    room = F.lit(most)
    if history is not None:
        d = d.join(history.select(group, F.col("n").alias("_n")), group, "left")
        room = F.least(room, F.lit(most_ever) - F.coalesce("_n", F.lit(0)))
    return d.where(F.col("_rank") <= room).drop("_rank", "_n")


def batch_with_caps(pool: DataFrame, total: int, key: str, group: str, score: str, history: DataFrame | None = None, seed: int = 42, share: float = 0.7, most: int = 3, most_ever: int = 5) -> DataFrame:
    """key, stratum: a share of the best and the rest random, with no group over its cap in the whole batch."""
    n1 = int(total * share + 0.5)
    best = [F.col(score).desc_nulls_last(), F.col(key)]
    first = capped(pool, group, best, most, history, most_ever).orderBy(*best).limit(n1).select(key, group)
    used = first.groupBy(group).agg(F.count("*").alias("_used"))
    rest = pool.join(first.select(key), key, "left_anti").withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(hash_order(key, seed=seed), F.col(key))))
    rest = rest.join(used, group, "left")
    room = F.lit(most) - F.coalesce("_used", F.lit(0))
    if history is not None:
        rest = rest.join(history.select(group, F.col("n").alias("_n")), group, "left")
        room = F.least(room, F.lit(most_ever) - F.coalesce("_n", F.lit(0)) - F.coalesce("_used", F.lit(0)))
    drawn = rest.where(F.col("_rank") <= room).orderBy(hash_order(key, seed=seed), F.col(key)).limit(total - n1).select(key)
    return first.select(key, F.lit("top").alias("stratum")).unionByName(drawn.select(key, F.lit("random").alias("stratum")))


def few_shot(labels: DataFrame, label: str, key: str, n: int, without: DataFrame | None = None) -> DataFrame:
    """The first n rows of each class by key, none of those excluded."""
    d = labels if without is None else labels.join(without.select(key), key, "left_anti")
    return d.withColumn("_rank", F.row_number().over(Window.partitionBy(label).orderBy(key))).where(F.col("_rank") <= n).drop("_rank")


def hash_folds(df: DataFrame, group: str, folds: int, seed: int = 42) -> DataFrame:
    """A fold for each row by the MD5 of its group, so a group is never split."""
    digest = F.conv(F.substring(hash_order(group, seed=seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", (digest % folds).cast("int"))


def greedy_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """A fold for each row: groups by size, the largest first, to the fold that holds least.

    The assignment is sequential by nature; it sees one row for each group, and the result is joined back.
    """
    spark: SparkSession = df.sparkSession
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group)
    queue, made = [(0, f) for f in range(folds)], []
    for r in sizes.toLocalIterator():  # groups, not rows
        held, f = heapq.heappop(queue)
        made.append((r[group], f))
        heapq.heappush(queue, (held + r["n"], f))
    table = spark.createDataFrame(made, f"_g {dict(df.dtypes)[group]}, fold int")
    return df.join(table, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def leakage(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """check, overlap: how many distinct non-blank values of each column are on both sides."""
    out = None
    for c in columns:
        of = lambda d: d.select(F.col(c).cast("string").alias("v")).where("v IS NOT NULL AND v != ''")
        one = of(train).intersect(of(test)).agg(F.count("*").alias("overlap")).select(F.lit(c).alias("check"), "overlap")
        out = one if out is None else out.unionByName(one)
    return out


def require_no_leakage(train: DataFrame, test: DataFrame, columns: list[str]) -> None:
    bad = [f"{r['check']}: {r['overlap']}" for r in leakage(train, test, columns).where("overlap > 0").collect()]
    if bad:
        raise ValueError("train and test overlap in " + ", ".join(bad))


def training_gate(labels: DataFrame, label: str, fold: str | None = None, least: int = 150, least_positive: int = 30, least_in_fold: int = 3) -> DataFrame:
    """One row: labels, positives, the least positives of a fold, and whether training may start."""
    counts = labels.agg(F.count("*").alias("labels"), F.coalesce(F.sum(F.col(label).cast("int")), F.lit(0)).alias("positives"))
    if fold is None:
        low = counts.withColumn("least_in_fold", F.col("positives"))
    else:
        low = counts.crossJoin(labels.groupBy(fold).agg(F.sum(F.col(label).cast("int")).alias("p")).agg(F.coalesce(F.min("p"), F.lit(0)).alias("least_in_fold")))  # two rows of one
    return low.withColumn("open", (F.col("labels") >= least) & (F.col("positives") >= least_positive) & (F.col("least_in_fold") >= least_in_fold))
