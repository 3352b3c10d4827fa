"""Learned text scorers on pyspark.ml, the scorer registry and the evaluation harness."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import has
from sievework.operators import metrics
from sievework.operators.rules import clamp

#: What a title scorer counts for and against a posting.
FOR = (r"\b(?:software|engineer|developer|programmer)\b", r"\b(?:full[- ]?stack|backend|front[- ]?end|web)\b", r"\b(?:python|django|fastapi|react|next\.?js|node)\b", r"\b(?:data\s+engineer|ai|ml|machine\s+learning)\b")
AGAINST = (r"\b(?:senior|sr\.?|lead|staff|principal|director|head\s+of|vp|manager)\b", r"\b(?:sales|recruiter|recruiting|marketing|account\s+executive)\b", r"\b(?:copywriter|nurse|paralegal|receptionist|fitness)\b", r"\b(?:intern|internship|unpaid)\b")


def title_rule(title: Column) -> Column:
    count = lambda patterns: reduce(lambda a, b: a + b, [has(title, p).cast("int") for p in patterns])
    return clamp(F.lit(0.5) + F.lit(0.25) * count(FOR) - F.lit(0.4) * count(AGAINST), 0.0, 1.0)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Add weight: total / (classes x rows of the class)."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    return df.join(F.broadcast(n), label).join(F.broadcast(total)).withColumn("weight", F.col("_t") / (F.col("_k") * F.col("_n"))).drop("_n", "_t", "_k")  # a row for each class


def _fit(df: DataFrame, stages: list, label: str) -> PipelineModel:
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=0.01, maxIter=50)
    return Pipeline(stages=[*stages, lr]).fit(balanced(df, label))


def char_ngram(df: DataFrame, text: str, label: str, low: int = 2, high: int = 5, features: int = 4096) -> PipelineModel:
    """Character n-grams inside padded words, TF-IDF, balanced logistic regression. Grams are made by native arrays."""
    grams = ", ".join(f"flatten(transform(_w, w -> transform(sequence(1, greatest(1, length(w) - {n - 1})), i -> substring(w, i, {n}))))" for n in range(low, high + 1))
    words = SQLTransformer(statement=f"SELECT *, transform(filter(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> ''), w -> concat(' ', w, ' ')) AS _w FROM __THIS__")
    made = SQLTransformer(statement=f"SELECT *, concat({grams}) AS _g FROM __THIS__")
    return _fit(df, [words, made, CountVectorizer(inputCol="_g", outputCol="_tf", minDF=2, vocabSize=features), IDF(inputCol="_tf", outputCol="features")], label)


def word_tfidf(df: DataFrame, text: str, label: str, features: int = 1000) -> PipelineModel:
    """Words and word pairs, TF-IDF, balanced logistic regression."""
    clean = SQLTransformer(statement=f"SELECT *, coalesce({text}, '') AS _t FROM __THIS__")
    one = RegexTokenizer(inputCol="_t", outputCol="_w1", pattern="[^\\p{L}\\p{N}]+")
    two = NGram(n=2, inputCol="_w1", outputCol="_w2")
    both = SQLTransformer(statement="SELECT *, concat(_w1, _w2) AS _g FROM __THIS__")
    return _fit(df, [clean, one, two, both, CountVectorizer(inputCol="_g", outputCol="_tf", minDF=2, vocabSize=features), IDF(inputCol="_tf", outputCol="features")], label)


def embedding_head(df: DataFrame, columns: list[str], label: str) -> PipelineModel:
    """A linear decision head over numeric columns."""
    return _fit(df, [VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")], label)


def probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("probability", vector_to_array("probability")[1]).select(*df.columns, "probability")


#: Scorers by name: a function of (training rows or None, rows) that adds a score column.
REGISTRY: dict[str, Callable[[DataFrame | None, DataFrame], DataFrame]] = {}


def scorer(name: str):
    def put(f):
        REGISTRY[name] = f
        return f

    return put


@scorer("title_keyword_rule")
def _rule(train, rows):
    return rows.withColumn("score", title_rule(F.col("title")))


@scorer("char_ngram_title")
def _grams(train, rows):
    return probability(char_ngram(train, "title", "y"), rows).withColumnRenamed("probability", "score")


@scorer("word_tfidf")
def _words(train, rows):
    return probability(word_tfidf(train, "title", "y"), rows).withColumnRenamed("probability", "score")


@scorer("stored_match")
def _stored(train, rows):
    return rows.withColumn("score", F.coalesce(F.col("match_score") / 100, F.lit(0.5)))


@scorer("stored_triage")
def _triaged(train, rows):
    return rows.withColumn("score", F.coalesce(F.col("triage_score"), F.lit(0.5)))


def blend(name: str, parts: dict[str, float]) -> None:
    """Register a weighted mean of other scorers; a missing part counts as even odds."""

    @scorer(name)
    def _blend(train, rows):
        d, total = rows, None
        for part, w in parts.items():
            d = REGISTRY[part](train, d).withColumnRenamed("score", f"_{part}")
            one = F.lit(w) * F.coalesce(F.col(f"_{part}"), F.lit(0.5))
            total = one if total is None else total + one
        return d.withColumn("score", total / sum(parts.values())).drop(*[f"_{p}" for p in parts])


blend("composite_rule_title", {"title_keyword_rule": 0.5, "char_ngram_title": 0.5})
blend("composite_match_title", {"stored_match": 0.6, "char_ngram_title": 0.4})


def evaluate(rows: DataFrame, names: list[str], k: int = 10, fold: str | None = None) -> list[dict]:
    """Metrics of each scorer, on all rows or pooled out of fold (a model never scores the fold it was fitted on)."""
    out = []
    for name in names:
        if fold is None:
            d = REGISTRY[name](rows, rows)
        else:
            folds = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]
            d = reduce(DataFrame.unionByName, [REGISTRY[name](rows.where(F.col(fold) != f), rows.where(F.col(fold) == f)) for f in folds])
        d = d.select("id", "y", "score")
        p = metrics.precision_at(d, k).first()
        out.append({"scorer": name, "p_at_k": p["p_at_k"], "r_at_k": p["r_at_k"], "roc_auc": metrics.roc_auc(d).first()[0], "average_precision": metrics.average_precision(d).first()[0]})
    return out


def promoted(current: dict, candidate: dict, low: float, least: float = 0.70, gain: float = 0.05) -> bool:
    """May a candidate replace the current ranker: its lower bound is high enough and it gains enough."""
    return low > least and candidate["roc_auc"] - current["roc_auc"] >= gain
