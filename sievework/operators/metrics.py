"""Ranking and agreement metrics over (y, score), each a few aggregates; ties are handled by groups of equal scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precision_at(df: DataFrame, k: int, y: str = "y", score: str = "score", key: str = "id") -> DataFrame:
    """p_at_k, r_at_k of the k best by score (ties by key): one top-k and two sums."""
    top = df.orderBy(F.desc(score), key).limit(k)
    hit = top.agg(F.coalesce(F.sum(y), F.lit(0)).alias("hits"), F.count("*").alias("n"))
    total = df.agg(F.sum(y).alias("positives"))
    both = hit.crossJoin(total)  # one row each
    return both.select((F.col("hits") / F.greatest("n", F.lit(1))).alias("p_at_k"), (F.col("hits") / F.nullif("positives", F.lit(0))).alias("r_at_k"))


def curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """One row for each distinct score, best first: p, n (positives and rows at it), tp, seen (so far).

    Rows are pre-aggregated by score, so the window runs over distinct scores, not over all rows.
    """
    g = df.groupBy(score).agg(F.sum(y).alias("p"), F.count("*").alias("n"))
    w = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return g.withColumn("tp", F.sum("p").over(w)).withColumn("seen", F.sum("n").over(w))


def average_precision(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Sum over thresholds of precision times the gain in recall; null without a positive."""
    c = curve(df, y, score)
    return c.agg((F.sum(F.col("p") * F.col("tp") / F.col("seen")) / F.nullif(F.sum("p"), F.lit(0))).alias("average_precision"))


def pr_auc_trapezoid(df: DataFrame, y: str = "y", score: str = "score", key: str = "id") -> DataFrame:
    """Area under one point for each row in score order (ties by key), from recall 0 and precision 1."""
    w = Window.orderBy(F.desc(score), F.col(key))
    total = df.agg(F.sum(y).alias("total"))
    d = df.withColumn("tp", F.sum(y).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("at", F.row_number().over(w))
    d = d.crossJoin(F.broadcast(total)).withColumn("r", F.col("tp") / F.col("total")).withColumn("p", F.col("tp") / F.col("at"))  # total is one row
    d = d.withColumn("r0", F.coalesce(F.lag("r").over(w), F.lit(0.0))).withColumn("p0", F.coalesce(F.lag("p").over(w), F.lit(1.0)))
    return d.agg(F.sum((F.col("r") - F.col("r0")) * (F.col("p") + F.col("p0")) / 2).alias("pr_auc"))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """The share of pairs in the right order, ties half: by counts at each distinct score. Null with one class."""
    g = df.groupBy(score).agg(F.sum(y).alias("p"), F.sum(1 - F.col(y)).alias("q"))
    below = F.sum("q").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    g = g.withColumn("won", F.col("p") * (F.coalesce(below, F.lit(0)) + F.col("q") / 2))
    return g.agg((F.sum("won") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("roc_auc"))


def kendall_tau_b(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with ties. Values are pre-aggregated, so pairs are of distinct (a, b) and not of rows."""
    g = df.groupBy(a, b).agg(F.count("*").alias("n"))
    l, r = g.select(F.col(a).alias("a1"), F.col(b).alias("b1"), F.col("n").alias("n1")), g.select(F.col(a).alias("a2"), F.col(b).alias("b2"), F.col("n").alias("n2"))
    pairs = l.join(r, F.col("a1") < F.col("a2"))  # over distinct values: bounded by the two scales
    s = pairs.agg(F.coalesce(F.sum(F.signum(F.col("b2") - F.col("b1")) * F.col("n1") * F.col("n2")), F.lit(0.0)).alias("s"))
    ties = lambda c: df.groupBy(c).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(f"t_{c}"))
    total = df.agg((F.count("*") * (F.count("*") - 1) / 2).alias("pairs"))
    one = s.crossJoin(ties(a)).crossJoin(ties(b)).crossJoin(total)  # one row each
    return one.select((F.col("s") / F.nullif(F.sqrt((F.col("pairs") - F.col(f"t_{a}")) * (F.col("pairs") - F.col(f"t_{b}"))), F.lit(0.0))).alias("tau_b"))


def confusion(df: DataFrame, y: str = "y", predicted: str = "predicted") -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, kappa in one aggregate."""
    one = lambda a, b: F.sum(((F.col(y) == a) & (F.col(predicted) == b)).cast("long"))
    d = df.agg(one(1, 1).alias("tp"), one(0, 1).alias("fp"), one(1, 0).alias("fn"), one(0, 0).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    chance = ((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("tn") + F.col("fn")) * (F.col("tn") + F.col("fp"))) / (n * n)
    agree = (F.col("tp") + F.col("tn")) / n
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    d = d.withColumns({"precision": p, "recall": r, "kappa": F.when(chance == 1, 0.0).otherwise((agree - chance) / F.nullif(1 - chance, F.lit(0.0)))})
    return d.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))))


def threshold(df: DataFrame, score: str = "score") -> Column:
    """0.5 if any score reaches it, else the 90th percentile: a literal column."""
    r = df.agg(F.max(score).alias("m"), F.percentile(score, 0.9).alias("p")).first()
    return F.lit(0.5 if r["m"] is not None and r["m"] >= 0.5 else r["p"])


def calibration_bins(df: DataFrame, y: str = "y", confidence: str = "confidence", bins: int = 10) -> DataFrame:
    """bin, n, accuracy, mean_confidence of bins [lo, hi); a confidence of 1 falls in no bin."""
    b = F.floor(F.col(confidence) * bins).cast("int")
    return df.withColumn("bin", b).where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("accuracy"), F.avg(confidence).alias("mean_confidence"))


def calibration_error(df: DataFrame, y: str = "y", confidence: str = "confidence", bins: int = 10) -> DataFrame:
    """Expected calibration error: the bins' gaps weighted by their rows."""
    return calibration_bins(df, y, confidence, bins).agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("n")).alias("ece"))


def draws(seed: int, trial: Column, index: Column, n: Column | int) -> Column:
    """The index that draw `index` of resample `trial` takes, from 0 to n - 1: an MD5, so any engine draws alike."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), trial.cast("string"), index.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n


def bootstrap(df: DataFrame, y: str = "y", group: str | None = None, trials: int = 200, seed: int = 42, key: str = "id") -> DataFrame:
    """low, mean, high of the mean of y over resamples of rows, or of whole groups.

    Rows are first summed by unit (row or group); units are numbered, every trial draws as many with repeats, and
    draws meet units in one equi-join. The resamples are trials x units rows of three numbers.
    """
    unit = group or key
    u = df.groupBy(unit).agg(F.sum(y).alias("s"), F.count("*").alias("n"))
    u = u.withColumn("no", F.row_number().over(Window.orderBy(unit)) - 1)
    size = u.count()
    spark = df.sparkSession
    d = spark.range(trials * size).select((F.col("id") / size).cast("long").alias("trial"), (F.col("id") % size).alias("i"))
    d = d.withColumn("no", draws(seed, F.col("trial"), F.col("i"), size))
    means = d.join(u, "no").groupBy("trial").agg((F.sum("s") / F.sum("n")).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.avg("m").alias("mean"), F.percentile("m", 0.975).alias("high"))
