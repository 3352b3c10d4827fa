"""URL filters: domain rules, unigram Viterbi host segmentation and multinomial naive Bayes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.session import written

#: Words that mark a host as unwanted; hosts that hold one are the weak examples that naive Bayes learns from.
SEEDS = frozenset("casino poker betting bets gamble gambling slots jackpot adult porn sex xxx nude escort spam malware phishing warez torrent crack keygen pills viagra cialis pharmacy ads adserver popup clickbait payday loans replica".split())
#: Words that concatenated host names are often made of, beside those that the corpus shows.
COMMON = frozenset("free cheap win farm track best online shop store news blog home world web site net info my the buy top live play game games money cash credit deal deals hot link links mail new now one pro real smart super tech video vip zone example www".split())
LONGEST = 24
#: A seed word's own evidence, in examples: what it weighs where no other seed in the host has taught it.
SEED_WEIGHT = 100.0
#: A table of at most so many rows of a few words (some tens of MB) may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
_RUNS = r"[a-z]+|#|[^\x00-\x7f]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def shape(text: Column) -> Column:
    """What naive Bayes sees of a host or path: A-Z lower-cased, every run of digits one #."""
    return F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[0-9]+", "#")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, "host/path") that fits the host or a parent, and the path's start."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        which, verdict = F.when(fits, rule).otherwise(which), F.when(fits, said).otherwise(verdict)
    return which, verdict


def viterbi(run: str, cost: dict[str, float], total: float) -> list[str]:
    """The most likely words of a run of letters; an unknown word of n letters costs as one seen 10^-n times.

    Known words have at most LONGEST letters; of unknown ones, of any length, the cheapest that ends at a letter
    either goes on from the one before or begins there, so time grows with the length of the run.
    """
    longest = min(LONGEST, max(map(len, cost), default=1))
    unseen, letter = math.log(total), math.log(10)
    best, back = [0.0], [0]
    odd, since = math.inf, 0  # the cheapest unknown word up to here, and its start
    for j in range(1, len(run) + 1):
        if best[j - 1] + unseen <= odd:
            odd, since = best[j - 1] + unseen, j - 1
        odd += letter
        least, at = odd, since
        for i in range(max(0, j - longest), j):
            c = cost.get(run[i:j])
            if c is not None and best[i] + c < least:
                least, at = best[i] + c, i
        best.append(least)
        back.append(at)
    out, j = [], len(run)
    while j:
        out.append(run[back[j] : j])
        j = back[j]
    return out[::-1]


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """word, c: the letter words between the tags of all whole pages.

    Seed and common words count as one in 5,000 at least, so that a name made of them is split where the corpus
    does not know them.
    """
    text = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), "<[^<>]*+>", " ")
    counted = pages.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"[a-z]{{1,{LONGEST}}}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    counted = written(counted, "words")
    floor = max(1, (counted.agg(F.sum("c")).first()[0] or 0) // 5000)
    fixed = pages.sparkSession.createDataFrame([(w, floor) for w in sorted(SEEDS | COMMON)], "word string, c long")
    return counted.unionByName(fixed).groupBy("word").agg(F.max("c").alias("c"))


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """run, words: every distinct run of letters split by Viterbi under the unigram model of all counts.

    A run's parts of up to 24 letters are looked up in the whole count table by a join, so the dictionary has no
    cut; what a run gathers is bounded by its own length.
    """
    counts = written(counts, "unigrams")
    total = float(counts.agg(F.sum("c")).first()[0] or 1)
    letters = runs.where("run rlike '^[a-z]+$'")
    starts = f"transform(sequence(1, length(run)), i -> transform(sequence(1, least({LONGEST}, length(run) - i + 1)), n -> substring(run, i, n)))"
    parts = letters.select("run", F.explode(F.array_distinct(F.expr(f"flatten({starts})"))).alias("word"))
    held = parts.join(counts, "word").groupBy("run").agg(F.collect_list(F.struct("word", "c")).alias("known"))

    @F.pandas_udf("array<string>")
    def split(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for run, known in parts:
            yield pd.Series([viterbi(r, {} if k is None else {x["word"]: -math.log(x["c"] / total) for x in k}, total) for r, k in zip(run, known)], dtype=object)

    done = letters.join(held, "run", "left").select("run", split("run", "known").alias("words"))
    return done.unionByName(runs.where("NOT run rlike '^[a-z]+$'").select("run", F.array("run").alias("words")))


def tokens(shapes: DataFrame, counts: DataFrame) -> DataFrame:
    """host, way, n, tokens: of every distinct host and path shape its words in order, h: of the host and p: of the path."""
    cut = lambda c, kind: F.transform(F.regexp_extract_all(c, F.lit(_RUNS), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("run")))
    each = shapes.select("host", "way", F.posexplode(F.concat(cut(shape(F.col("host")), "h"), cut(F.col("way"), "p"))).alias("pos", "r")).select("host", "way", "pos", "r.kind", "r.run")
    words = written(segmented(each.select("run").distinct(), counts), "segments")
    split = each.join(_small(words), "run").withColumn("words", F.transform("words", lambda w: F.concat(F.col("kind"), F.lit(":"), w)))
    listed = split.groupBy("host", "way").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])).alias("tokens"))
    return shapes.join(listed, ["host", "way"], "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def _seeds(kind: str = "h:") -> Column:
    return F.array(*[F.lit(kind + s) for s in sorted(SEEDS)])


def train(known: DataFrame) -> tuple[DataFrame, float]:
    """(token, weight) and the prior log odds of multinomial naive Bayes over tokens(); over 0 means block.

    Examples of block are the rows whose host holds a seed word; in the features of an example the seed words that
    label it stand only for the other seeds: with one seed alone it is left out, with several each is taught by the
    others. What a seed weighs beside that is a prior of SEED_WEIGHT examples, which other words can outvote. Counts
    of the commoner class are scaled to the mass of the rarer one, so that words that neither has seen say nothing,
    and smoothed by one.
    """
    d = known.withColumn("bad", F.arrays_overlap("tokens", _seeds())).withColumn("own", F.array_distinct(F.array_intersect("tokens", _seeds())))
    sums = d.agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("a")).first()
    prior = math.log(((sums["b"] or 0) + 1) / ((sums["a"] or 0) + 1))
    each = d.select("n", "bad", "own", F.explode("tokens").alias("token")).where(~(F.array_contains("own", F.col("token")) & (F.size("own") == 1)))
    counted = written(each.groupBy("token").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("a")), "tokens")
    mass = counted.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("a"), F.lit(0)).alias("a")).first()
    least = min(mass["a"], mass["b"])
    scale = {k: least / mass[k] if mass[k] else 0.0 for k in ("a", "b")}
    seeds = known.sparkSession.createDataFrame([("h:" + s, SEED_WEIGHT) for s in sorted(SEEDS)], "token string, seed double")
    weight = F.log(F.coalesce("b", F.lit(0)) * scale["b"] + F.coalesce("seed", F.lit(0.0)) + 1) - F.log(F.coalesce("a", F.lit(0)) * scale["a"] + 1)
    return counted.join(F.broadcast(seeds), "token", "full").select("token", weight.alias("weight")), prior


def scored(known: DataFrame, weights: DataFrame, prior: float) -> DataFrame:
    """host, way, log_odds, words (of the host): the prior plus the weights of all tokens; unseen ones say nothing."""
    each = known.select("host", "way", F.explode("tokens").alias("token")).join(_small(weights), "token")
    sums = each.groupBy("host", "way").agg(F.sum("weight").alias("more"))
    of_host = F.array_join(F.transform(F.filter("tokens", lambda t: t.startswith("h:")), lambda t: F.substring(t, 3, LONGEST * 100)), " ")
    return known.join(sums, ["host", "way"], "left").select("host", "way", (F.lit(prior) + F.coalesce("more", F.lit(0.0))).alias("log_odds"), of_host.alias("words"))


def judged(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", html: str = "html") -> DataFrame:
    """Add host, path, rule, verdict, log_odds and words (the segmented host) to every row of pages.

    A fitting rule decides; else the sign of the naive Bayes log odds (0 allows). Null urls and those without ://
    have an empty host and path and the prior's odds; repeated rows are judged alike and come back repeated; an
    empty table stays empty. Input columns named like a result are replaced by it, whatever their case.

    All that is learned and scored is of distinct (host, path with digits as #), so a host that holds a third of the
    pages is one row there; the pages meet it again through a broadcast of bounded size or a join that AQE splits.
    """
    boxed = pages.select(F.struct("*").alias("_row"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path")).withColumn("way", shape(F.col("path")))
    counts = word_counts(pages.select(F.col(html).alias("html")), "html")
    shapes = written(boxed.groupBy("host", "way").agg(F.count("*").alias("n")), "shapes")
    known = written(tokens(shapes, counts), "known")
    weights, prior = train(known)
    table = written(scored(known, written(weights, "weights"), prior), "judged")
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    d = boxed.join(_small(table), ["host", "way"], "left").withColumn("rule", rule)
    verdict = F.coalesce(said, F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    results = ("host", "path", "rule", "verdict", "log_odds", "words")
    kept = [F.col("_row").getField(c).alias(c) for c in pages.columns if c.lower() not in results]
    return d.withColumn("verdict", verdict).select(*kept, *results)
