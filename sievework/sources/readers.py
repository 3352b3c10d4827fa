"""Readers over captured payload files: envelopes are unwrapped, ids found, rows filtered before anything else."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import blank, contains_any

#: Places that a listing open to all may name.
OPEN_GEO = ("worldwide", "anywhere", "global", "remote")
HIMALAYAS_GEO = ("worldwide", "anywhere", "global", "asia", "apac", "south asia", "nepal")
POST_MARKS = ("[hiring]", "[task]", "hiring", "looking for a developer", "freelance", "paid project", "remote job")
POST_SKIP = ("[for hire]", "for hire", "looking for work", "hire me", "my portfolio")


def at(path: str) -> Column:
    return F.get_json_object("payload", path)


@dataclass(frozen=True)
class Source:
    """Where a payload's items are, what identifies one, and which are kept."""

    name: str
    items: str | None
    id: Callable[[], Column]
    keep: Callable[[], Column] | None = None


def _first(*paths: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(at(p)), F.lit("")) for p in paths])


def _strings(path: str) -> Column:
    return F.coalesce(F.from_json(at(path), "array<string>"), F.array().cast("array<string>"))


def _geo_parts() -> Column:
    return F.filter(F.transform(F.split(F.lower(blank(at("$.jobGeo"))), ","), lambda x: F.trim(x)), lambda x: x != "")


SOURCES = {
    s.name: s
    for s in (
        Source("arbeitnow", "$.data", lambda: _first("$.slug", "$.url")),
        Source("remotive", "$.jobs", lambda: _first("$.id", "$.url")),
        Source("himalayas", "$.jobs", lambda: _first("$.guid", "$.applicationLink"), lambda: (F.size(_strings("$.locationRestrictions")) == 0) | F.exists(_strings("$.locationRestrictions"), lambda x: F.lower(F.trim(x)).isin(*HIMALAYAS_GEO))),
        Source("jobicy", "$.jobs", lambda: _first("$.id", "$.jobSlug"), lambda: F.forall(_geo_parts(), lambda x: x.isin(*OPEN_GEO))),
        Source("remoteok", "$", lambda: _first("$.id", "$.slug"), lambda: at("$.position").isNotNull() | (at("$.id").isNotNull() & at("$.legal").isNull())),
        Source("workingnomads", "$", lambda: _first("$.url")),
        Source("hackernews", "$.children", lambda: _first("$.id"), lambda: (blank(at("$.deleted")) != "true") & (blank(at("$.dead")) != "true") & (blank(at("$.text")) != "")),
        Source("greenhouse", "$.jobs", lambda: _first("$.id")),
        Source("lever", "$", lambda: _first("$.id")),
        Source("ashby", "$.jobs", lambda: _first("$.id")),
        Source("github", "$.items", lambda: _first("$.id", "$.html_url")),
        Source("reddit", "$.data.children", lambda: _first("$.data.id", "$.id"), lambda: contains_any(F.lower(blank(at("$.data.title"))), POST_MARKS) & ~contains_any(F.lower(blank(at("$.data.title"))), POST_SKIP)),
        Source("python_org", "$", lambda: _first("$.external_id", "$.link")),
        Source("manual", "$.jobs", lambda: _first("$.external_id")),
    )
}


def read_json(spark: SparkSession, path: str, name: str, source: str | None = None) -> DataFrame:
    """source, external_id, payload of captured JSON documents (one a file, an array or an envelope).

    An envelope's items are exploded; a document that is a list, or one object, is taken as it is.
    """
    s = SOURCES[name]
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"))
    boxed = at(s.items) if s.items and s.items != "$" else F.col("payload")
    listed = F.from_json(F.coalesce(boxed, F.col("payload")), "array<variant>")
    items = whole.select(F.explode(F.when(F.ltrim(F.coalesce(boxed, F.col("payload"))).startswith("["), listed).otherwise(F.array(F.parse_json(F.coalesce(boxed, F.col("payload")))))).alias("item")).select(F.to_json("item").alias("payload"))
    if s.keep is not None:
        items = items.where(s.keep())
    return items.select(F.lit(source or name).alias("source"), s.id().alias("external_id"), "payload")


def read_rss(spark: SparkSession, path: str, source: str, tag: str = "item") -> DataFrame:
    """source, external_id, payload of the items of captured feeds."""
    d = spark.read.format("xml").option("rowTag", tag).option("inferSchema", "false").load(path)
    link = [F.col(c) for c in ("guid", "link") if c in d.columns]
    key = F.coalesce(*[F.coalesce(c.getField("_VALUE"), F.lit(None)) if str(d.schema[c._jc.toString()].dataType).startswith("Struct") else c for c in link]) if link else F.lit(None).cast("string")
    return d.select(F.lit(source).alias("source"), F.trim(key).alias("external_id"), F.to_json(F.struct(*d.columns)).alias("payload"))


def read_manual_csv(spark: SparkSession, path: str, source: str = "manual:import") -> DataFrame:
    """A CSV of postings by hand: is_remote from true, 1 or yes, tags from a comma list."""
    d = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if "is_remote" in d.columns:
        d = d.withColumn("is_remote", F.lower(F.trim("is_remote")).isin("true", "1", "yes"))
    if "tags" in d.columns:
        d = d.withColumn("tags", F.filter(F.transform(F.split("tags", ","), lambda x: F.trim(x)), lambda t: t != ""))
    return d.select(F.lit(source).alias("source"), F.lit(None).cast("string").alias("external_id"), F.to_json(F.struct(*d.columns)).alias("payload"))


def read_labels_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Label files: UTF-8 (a byte-order mark is read over) unless its text cannot be, then Latin-1."""
    if encoding is None:
        broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
        encoding = "ISO-8859-1" if broken else "UTF-8"
    d = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=encoding)
    return d.withColumnsRenamed({c: c.lstrip("\ufeff").strip() for c in d.columns})


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_with_digest(df: DataFrame, path: str) -> str:
    """Write one CSV of a bounded table and return the SHA-256 of its content in row order."""
    df.coalesce(1).write.csv(path, header=True, mode="overwrite")
    text = df.sparkSession.read.text(path)
    return text.agg(F.sha2(F.concat_ws("\n", F.collect_list("value")), 256)).first()[0]
