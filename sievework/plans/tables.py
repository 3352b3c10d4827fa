"""The driver's tables and the views on them that the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def title(text: str = "text") -> Column:
    """A document's first sentence as its title, cut to 255 characters."""
    return F.substring(F.split_part(F.col(text), F.lit("."), F.lit(1)), 1, 255)


TITLE = "substr(split_part(text, '.', 1), 1, 255)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def words(text: Column) -> Column:
    """ASCII-and-Latin-1 letter runs in lower case, alike in both engines."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zà-ÿ]+"), F.lit(0))


WORDS = "regexp_extract_all(lower(text), '[a-zà-ÿ]+')"


def sql_in(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def sql_hits(values, words_sql: str = WORDS) -> str:
    """How many words are in a list, with multiplicity."""
    return f"len(list_filter({words_sql}, lambda w: {sql_in('w', values)}))"
