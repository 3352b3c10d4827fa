"""Reports as DataFrames: funnels, recent activity, staleness, examples, and the endpoints' queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_class(quality: str = "quality", toxic: str = "toxic") -> Column:
    return F.when(F.col(toxic) == 1, "bad_fit").when(F.col(quality) == 1, "good_fit").otherwise("maybe")


def funnel(df: DataFrame, source: str, steps: dict[str, Column]) -> DataFrame:
    """source, fetched, one count for each step, and the last step's rate; the row TOTAL covers all sources."""
    counts = [F.sum(F.when(c, 1).otherwise(0)).alias(k) for k, c in steps.items()]
    d = df.rollup(source).agg(F.count("*").alias("fetched"), *counts)
    last = list(steps)[-1]
    return d.select(F.coalesce(F.col(source), F.lit("TOTAL")).alias("source"), "fetched", *steps, F.round(F.col(last) / F.col("fetched"), 6).alias("rate"))


def recent(df: DataFrame, source: str, at: str, days: int, counted: Column) -> DataFrame:
    """source, inserted, n of the last days of the table's own time: the newest row is now."""
    now = df.agg(F.max(at).alias("_now"))
    d = df.join(F.broadcast(now)).where(F.col(at) > F.col("_now") - F.make_interval(days=F.lit(days)))  # one row
    return d.groupBy(source).agg(F.sum(F.when(counted, 1).otherwise(0)).alias("inserted"), F.count("*").alias("n"))


def stale(df: DataFrame, source: str, at: str, hours: int) -> DataFrame:
    now = df.agg(F.max(at).alias("_now"))
    seen = df.groupBy(source).agg(F.max(at).alias("_seen"))
    return seen.join(F.broadcast(now)).select(source, (F.col("_seen") < F.col("_now") - F.make_interval(hours=F.lit(hours))).alias("stale"))


def examples(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """group, n, and its n least keys as text: the least are kept by a ranked top-n, never by collecting the group."""
    from pyspark.sql import Window

    top = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("_rank") <= n)
    listed = top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("examples"))
    return df.groupBy(group).agg(F.count("*").alias("n")).join(listed, group)


def feed(postings: DataFrame, matches: DataFrame, labels: DataFrame, most: int = 100) -> DataFrame:
    """Unlabelled postings that passed and may be shown, best first: the interactive feed as one plan."""
    d = postings.join(matches, "job_id").join(labels.select("job_id").distinct(), "job_id", "left_anti")
    return d.where("passed AND feed_reason IS NULL").orderBy(F.desc_nulls_last("score"), "job_id").limit(most)


def rejected(postings: DataFrame, matches: DataFrame, most: int = 200) -> DataFrame:
    return postings.join(matches.where("NOT passed"), "job_id").orderBy(F.desc_nulls_last("last_seen_at"), "job_id").limit(most)


def markdown(df: DataFrame, columns: list[str], most: int = 100) -> str:
    """A table of the first rows of a bounded frame."""
    rows = df.select(*columns).limit(most).collect()
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows)])
