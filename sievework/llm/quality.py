"""Quality rules by weak supervision: rules vote or abstain, EM estimates how far each can be trusted."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.session import written

WINDOW = 8
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = "the of and to in is that it for on was with as at be this are from or by a de la le les des et en un une que du dans est pour der die und das den von zu mit ist nicht sich auf ein eine el los las y se por con para una".split()
#: What holds of a rule before any data: how often it votes bad on bad documents and on good ones, as pseudo-counts.
PRIOR_BAD, PRIOR_GOOD = (2.0, 4.0), (0.5, 50.0)
ROUNDS = 200


def base_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts of every whole text (null: empty), in DataFrame functions only.

    Words are runs of anything but space and \\x09-\\x0D. n_words; word_chars: code points in words; n_symbols:
    characters of #*$%&|<>; n_lines: \\n-split lines with a word; n_dup_lines: those equal to an earlier one;
    n_repeat_words: words in 8-word windows found twice or more, first included; n_upper, n_letters, n_bangs,
    n_stop: upper-case letters, letters, exclamation marks and function words. The texts themselves are dropped.
    """
    w = WINDOW
    d = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).drop(text)
    d = d.withColumn("_w", F.expr(r"regexp_extract_all(_t, r'[^\x20\x09-\x0D]+', 0)"))
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("_h", F.expr(f"CASE WHEN n_words >= {w} THEN transform(_w, x -> xxhash64(x)) END"))
    d = d.withColumn("_h", F.expr(f"transform(sequence(1, size(_h) - {w - 1}), i -> xxhash64(slice(_h, i, {w})))"))
    kept = [c for c in docs.columns if c != text]
    d = d.select(
        *[F.col(f"`{c}`") for c in kept],
        "n_words",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.expr(r"filter(split(_t, '\n', -1), x -> x rlike r'[^\x20\x09-\x0D]')").alias("_l"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("_t", "[^!]+", "")).cast("long").alias("n_bangs"),
        F.expr(f"size(filter(_w, x -> lower(x) IN ({', '.join(repr(s) for s in STOP_WORDS)})))").cast("long").alias("n_stop"),
        F.expr("CASE WHEN size(_h) > size(array_distinct(_h)) THEN sort_array(transform(_h, (x, i) -> struct(x AS h, i AS p))) END").alias("_s"),
    )
    d = d.withColumn("n_lines", F.size("_l").cast("long")).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).drop("_l")
    twin = "(j > 0 AND _s[j - 1].h = e.h) OR (j < size(_s) - 1 AND _s[j + 1].h = e.h)"
    d = d.withColumn("_p", F.expr(f"CASE WHEN _s IS NOT NULL THEN sort_array(transform(filter(_s, (e, j) -> {twin}), e -> e.p)) END")).drop("_s")
    covered = f"CASE WHEN size(_p) > 1 THEN aggregate(sequence(1, size(_p) - 1), {w}, (a, j) -> a + least({w}, _p[j] - _p[j - 1])) ELSE 0 END"
    return d.withColumn("n_repeat_words", F.expr(covered).cast("long")).drop("_p")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def votes() -> dict[str, Column]:
    """The rules over base_stats columns: -1 bad, 1 good, 0 abstains."""
    n, per = F.col("n_words"), lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    upper = F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1))
    return {
        "length": _vote(n < 20, n >= 60),
        "word_length": _vote((per("word_chars") < 1.8) | (per("word_chars") > 20), per("word_chars").between(3, 12)),
        "symbols": _vote(per("n_symbols") > 0.3, per("n_symbols") < 0.03),
        "dup_lines": _vote(F.col("n_dup_lines") * 10 > F.col("n_lines") * 3, (F.col("n_dup_lines") == 0) & (F.col("n_lines") >= 3)),
        "repeats": _vote(F.col("n_repeat_words") * 10 > n * 3, F.col("n_repeat_words") * 20 < n),
        "upper": _vote((upper > 0.5) & (n >= 5), upper < 0.2),
        "bangs": _vote(per("n_bangs") > 0.3, per("n_bangs") < 0.05),
        "function_words": _vote((n >= 60) & (per("n_stop") < 0.01), per("n_stop") > 0.08),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """EM on vote patterns and their counts: the posterior probability of quality for each pattern.

    Two classes; each rule votes, given that it votes, bad with a rate of its own in either class, and abstains
    alike in both. Rates have Beta priors that say which class is which; it starts from "bad if any rule says so",
    but for rules that call most documents bad, which tell nothing apart.
    """
    if not patterns:
        return {}
    k, total = len(patterns[0][0]), sum(n for _, n in patterns)
    told = [2 * sum(n for p, n in patterns if p[j] < 0) < sum(n for p, n in patterns if p[j]) for j in range(k)]
    bad = {p: 0.9 if any(v < 0 and t for v, t in zip(p, told)) else 0.05 for p, _ in patterns}
    for _ in range(rounds):
        share = (sum(bad[p] * n for p, n in patterns) + 1) / (total + 10)
        rate = []
        for j in range(k):
            b1 = sum(bad[p] * n for p, n in patterns if p[j] < 0) + PRIOR_BAD[0]
            b0 = sum(bad[p] * n for p, n in patterns if p[j]) + sum(PRIOR_BAD)
            g1 = sum((1 - bad[p]) * n for p, n in patterns if p[j] < 0) + PRIOR_GOOD[0]
            g0 = sum((1 - bad[p]) * n for p, n in patterns if p[j]) + sum(PRIOR_GOOD)
            rate.append((b1 / b0, min(g1 / g0, b1 / b0)))
        new = {}
        for p, _ in patterns:
            z = math.log(share / (1 - share))
            for v, (b, g) in zip(p, rate):
                z += math.log(b / g) if v < 0 else math.log((1 - b) / (1 - g)) if v > 0 else 0
            new[p] = 1 / (1 + math.exp(-max(-700, min(700, z))))
        moved = max(abs(new[p] - bad[p]) for p in new)
        bad = new
        if moved < 1e-9:
            break
    return {p: 1 - x for p, x in bad.items()}


def judged(docs: DataFrame, text: str = "text", least: float = 0.8) -> DataFrame:
    """Add base counts, base_failed, p_quality and kept to every row of docs, without its text.

    base_failed: under 20 words, or over 30 % of the words in repeated windows. kept: not base_failed, and a
    posterior of at least `least`. The votes take one of 3^8 patterns at most, so what EM works on is bounded
    however large the corpus, while it counts every row. Null and empty texts have no words and fail; repeated rows
    are judged alike and come back repeated; an empty table stays empty; input columns named like a result are
    replaced by it, all others stay whatever their names.
    """
    rules = votes()
    names = [f"_v_{r}" for r in rules]
    others = [c for c in docs.columns if c != text]
    boxed = docs.select(F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    d = written(base_stats(boxed, "_text").withColumns({n: v for n, v in zip(names, rules.values())}), "quality")
    counted = d.groupBy(*names).agg(F.count("*").alias("_n")).collect()  # 3^8 rows at most
    p = fit(sorted((tuple(r[n] for n in names), r["_n"]) for r in counted))
    table = d.sparkSession.createDataFrame([(*k, x) for k, x in p.items()], ", ".join(f"{n} tinyint" for n in names) + ", p_quality double")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    d = d.join(F.broadcast(table), names, "left").withColumn("base_failed", failed)
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("p_quality") >= least)).drop(*names)
    results = [c for c in d.columns if c != "_row"]
    return d.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(others) if c.lower() not in results], *results)
