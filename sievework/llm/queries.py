"""The queries opN_<name>: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import html, language_model, lines, neighbours, packing, pieces, quality, simhash, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc(c) -> Column:
    return F.crc32(F.col(c).cast("string")) if isinstance(c, str) else F.crc32(c.cast("string"))


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine and its workers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.dedup_lines(docs.withColumn("_was", F.size(F.split("text", "\n", -1))))
    return out.select("doc_id", F.col("_was").cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars_kept"), "text")


@_query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"))


@_query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    out = pieces.decode(pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "score", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


@_query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html.main_text(pages, html.train(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_quality")


@_query
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(table, table.where(F.col("vec_id") % 20 == 0))


@_query
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return language_model.scored(docs, _crc(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0)


#: The rules that the query applies.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@_query
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judged(_table(spark, sf_dir, "pages"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "log_odds", "words")


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), where=lambda c: _crc(c) % 5 != 0)
    out = toxicity.scores(docs, model)
    return out.select("doc_id", (_crc("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
