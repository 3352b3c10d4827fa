"""Relational building blocks: latest per key, anti and semi joins, or-joins, groups, top-k, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import written


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """The row of each key with the greatest order values: one aggregate with map-side combine, no sort, no window.

    Nulls in the order columns come last, so a dated row wins over an undated one.
    """
    columns = columns or [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), rank).alias("_row"))
    return picked.select(*keys, "_row.*")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order of any kind, by a window whose groups Spark limits before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def anti(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_anti")


def semi(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_semi")


def or_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """left joined to right where any of the column pairs is equal: a union of equi-joins and never a nested loop.

    A pair of rows that is equal in several ways appears once. right's columns must not clash with left's.
    """
    joins = []
    for i, (a, b) in enumerate(pairs):
        earlier = reduce(lambda x, y: x | y, [F.coalesce(left[p] == right[q], F.lit(False)) for p, q in pairs[:i]], F.lit(False))
        joins.append(left.join(right, left[a] == right[b]).where(~earlier))
    return reduce(DataFrame.unionAll, joins)


def canonical_groups(df: DataFrame, group: list[Column], score: Column, tie: Column, key: str) -> DataFrame:
    """key, canonical, group_size for all members of groups over one: the best by score, then the least tie value."""
    names = [f"_g{i}" for i in range(len(group))]
    d = df.select(F.col(key), score.alias("_s"), tie.alias("_t"), *[g.alias(n) for g, n in zip(group, names)])
    best = d.groupBy(*names).agg(F.count("*").alias("group_size"), F.min_by(F.col(key), F.struct(-F.coalesce(F.col("_s"), F.lit(0)), F.col("_t"), F.col(key))).alias("canonical")).where("group_size > 1")
    return d.join(best, names).select(key, "canonical", "group_size")


def explode_count(df: DataFrame, items: Column, most: int) -> DataFrame:
    """The most frequent elements of an array column: counted with map-side combine, then a top-k without a full sort."""
    return df.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(most)


def systematic_sample(df: DataFrame, order: str, step: int, start: int = 0) -> DataFrame:
    """Every step-th row in the order of a column, nulls last, then of the others that have an order.

    Row numbers come from counts by range of the sorted rows, not from a window over the whole table. The sorted
    rows are stored once, for counts and rows of two evaluations could stand by different ranges.
    """
    by = [F.col(order).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c, kind in df.dtypes if c != order and "map<" not in kind and "variant" not in kind]]
    spread = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    spread = written(spread, "sorted")
    low = spread.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = low.select(F.col("_part"), F.col("_first"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    numbered = spread.join(F.broadcast(before), "_part").withColumn("_no", F.col("_row") - F.col("_first") + F.col("_before"))
    return numbered.where((F.col("_no") - start) % step == 0).where(F.col("_no") >= start).drop("_part", "_row", "_first", "_before", "_no")


def hash_order(*columns: str, seed: int = 42) -> Column:
    """A repeatable random order that other engines can follow: the MD5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def sample_per_group(df: DataFrame, group: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group, at random but repeatably."""
    w = Window.partitionBy(*group).orderBy(hash_order(key, seed=seed), key)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
