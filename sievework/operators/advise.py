"""Advice and selection: keyword scores, friendly places, 3-class decisions, search filters, caches, advisory codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import blank, contains_any, has, salary_top, unscramble, words_pattern
from sievework.operators.rules import first_match, Rule

#: Words that raise or lower a title, and phrases of places.
BOOST = "engineer|developer|software|full-stack|fullstack|backend|frontend|python|ai|ml|data|junior|entry|associate|graduate|intern".split("|")
PENALTY = "senior|lead|principal|director|manager|sales|support|marketing|designer|recruiter".split("|")
FRIENDLY = ("worldwide", "anywhere", "global", "apac", "asia", "nepal", "south asia", "remote", "all locations", "international")
RESTRICTED = ("usa only", "us only", "eu only", "uk only", "canada only", "us timezones", "latam only")
DISQUALIFYING = ("GERMAN", "UNPAID", "INACCESSIBLE")


def title_points(title: Column, boost=tuple(BOOST), penalty=tuple(PENALTY)) -> Column:
    """One point for each boosting word in a title, two less for each of the others; every word counts once."""
    total = F.lit(0.0)
    for words, points in ((boost, 1.0), (penalty, -2.0)):
        for w in words:
            total = total + F.when(has(title, words_pattern([w])), points).otherwise(0.0)
    return total


def friendly_place(location: Column) -> Column:
    """Unstated places are friendly, strict locks are not, open phrases are, and others unless they say only."""
    low = F.lower(F.trim(blank(location)))
    rules = [Rule("yes", low == ""), Rule("no", contains_any(low, RESTRICTED)), Rule("yes", contains_any(low, FRIENDLY)), Rule("no", contains_any(low, ("only", "timezones")))]
    return first_match(rules, "yes") == "yes"


def decision(score: Column, disqualified: Column) -> Column:
    return F.when(disqualified, "bad_fit").when(score >= 60, "good_fit").when(score >= 40, "maybe").otherwise("bad_fit")


def match_decision(score: Column, flags: Column) -> Column:
    return decision(score, F.arrays_overlap(flags, F.array(*[F.lit(f) for f in DISQUALIFYING])))


def answer_decision(score: Column, passed: Column, role: Column) -> Column:
    return decision(score, ~passed | (role == "other"))


def cleaned(text: Column) -> Column:
    """struct<text, tags, mojibake, whitespace>: the cleaned text and which steps changed it."""
    t = blank(text)
    stripped = F.regexp_replace(t, "<[^>]+>", " ")
    fixed = unscramble(stripped)
    neat = F.trim(F.regexp_replace(F.regexp_replace(fixed, "[ \\t]+", " "), "\n{3,}", "\n\n"))
    return F.struct(neat.alias("text"), (stripped != t).alias("tags"), (fixed != stripped).alias("mojibake"), (neat != fixed).alias("whitespace"))


def search(postings: DataFrame, tags: list[str] = (), keywords: list[str] = (), least_salary: int = 0, friendly: bool = False) -> DataFrame:
    """Postings with any of the tags in title, tags or text, any keyword in title or text, a salary and a friendly place.

    Columns: title, description_text, tags, location_raw, salary. What is not asked for does not filter.
    """
    said = F.lower(F.concat_ws(" ", "title", "description_text"))
    d = postings
    if friendly:
        d = d.where(friendly_place(F.col("location_raw")))
    if least_salary > 0:
        d = d.where(salary_top(F.col("salary")) >= least_salary)
    if tags:
        d = d.where(contains_any(F.concat_ws(" ", said, F.lower(F.array_join("tags", " "))), [t.lower() for t in tags]))
    if keywords:
        d = d.where(contains_any(said, [k.lower() for k in keywords]))
    return d


def live(cache: DataFrame, checked: str, now: Column, seconds: int) -> DataFrame:
    """The entries of a cache that are not older than their time to live at `now`."""
    return cache.where(F.unix_timestamp(now) - F.unix_timestamp(checked) <= seconds)


def advise(policy: Column, regions: Column, authorization: Column, level: Column, years: Column, degree: Column) -> Column:
    """struct<accessible, flags, codes, seniority, experience, degree> from what was extracted of a description."""
    policy, auth, level = F.lower(blank(policy)), F.lower(blank(authorization)), F.lower(blank(level))
    regions = F.transform(F.coalesce(regions, F.array().cast("array<string>")), lambda r: F.lower(r))
    us = F.exists(regions, lambda r: r.rlike(r"\b(us|usa|united states)\b"))
    eu = F.exists(regions, lambda r: r.rlike(r"\b(eu|europe|european union|uk)\b"))
    barrier = contains_any(auth, ("citizen", "security clearance", "no sponsorship"))
    senior = level.isin("senior", "lead", "principal", "staff", "manager", "head")
    flags = F.array_compact(F.array(F.when(policy == "onsite", "ONSITE_LOCATION"), F.when(policy == "hybrid", "HYBRID_LOCATION"), F.when(us, "US_LOCKED"), F.when(~us & eu, "EU_LOCKED"), F.when(barrier, "WORK_AUTH_BARRIER")))
    codes = F.array_compact(F.array(F.when(policy.isin("onsite", "hybrid"), "NOT_REMOTE"), F.when(us | eu, "REGION_LOCKED"), F.when(senior, "TOO_SENIOR"), F.when(years > 3, "DEGREE_OR_EXP")))
    seniority = F.when(senior, "too_senior").when(level.isin("junior", "entry", "intern"), "junior_friendly").when(level == "mid", "acceptable_mid").otherwise("unstated")
    experience = F.when(years > 3, "too_senior").when(years <= 2, "well_matched").when(years.isNotNull(), "moderate_stretch").otherwise("unknown")
    none = F.when(F.size(flags) == 0, F.array(F.lit("WORLDWIDE_OR_UNRESTRICTED"))).otherwise(flags)
    return F.struct((F.size(flags) == 0).alias("accessible"), none.alias("flags"), codes.alias("codes"), seniority.alias("seniority"), experience.alias("experience"), F.when(F.coalesce(degree, F.lit(False)), "degree_mandatory").otherwise("acceptable").alias("degree"))


def regressions(before: list[dict], after: list[dict], metric: str = "roc_auc", tolerance: float = 0.01) -> list[str]:
    """The scorers whose metric fell by more than the tolerance between two evaluations."""
    old = {r["scorer"]: r[metric] for r in before}
    return [r["scorer"] for r in after if r["scorer"] in old and old[r["scorer"]] is not None and r[metric] is not None and old[r["scorer"]] - r[metric] > tolerance]
