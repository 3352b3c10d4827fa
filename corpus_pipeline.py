"""The corpus pipeline: quality rules, toxicity, line dedup, near-duplicates, packing, in that order."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import lines, packing, quality, simhash, toxicity
from sievework.llm.queries import vocabulary
from sievework.session import fresh, made_since, mark, release, written

#: No row of the last stage can be told in SQL: EM, gradient descent and column generation stand before it.
ORACLE_SQL = None

#: Scratch tables of the stage before, and of no other query: deleted when the next stage begins, for by then its result is stored.
_BEFORE: list[str] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _BEFORE)
        began = mark()
        out = f(spark, docs, sf_dir)
        _BEFORE[:] = made_since(began)
        return out

    return stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality passes; the rest go, null and empty texts among them."""
    judged = quality.judged(docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text")), "_text")
    return judged.where("kept").select("_row.*")


@_stage
def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the rest go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs, "_toxic")
    return toxicity.scores(docs, model, to=score).where(F.col(score) < 0.5).drop(score)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one."""
    return lines.dedup_lines(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_duplicates),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next.

    Nulls, empty texts, repeated ids and rows, extra columns and an empty table pass through every stage; see the
    operators for what becomes of them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
