"""Rule cascades: ordered (name, predicate[, points]) lists compiled into one expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A reason, when it holds, its points, and an optional detail."""

    reason: str
    when: Column
    points: float = 0
    detail: Column | None = None


def first_match(rules: list[Rule], otherwise: str = "PASS") -> Column:
    """The reason of the first rule that holds. Later predicates are not evaluated for the row."""
    out = F.lit(otherwise)
    for r in reversed(rules):
        out = F.when(r.when, r.reason).otherwise(out)
    return out


def first_detail(rules: list[Rule]) -> Column:
    """struct<reason, detail> of the first rule that holds, null if none."""
    out = F.lit(None).cast("struct<reason:string,detail:string>")
    for r in reversed(rules):
        out = F.when(r.when, F.struct(F.lit(r.reason).alias("reason"), (r.detail if r.detail is not None else F.lit("")).alias("detail"))).otherwise(out)
    return out


def all_matches(rules: list[Rule]) -> Column:
    """The reasons of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(r.when, r.reason) for r in rules])) if rules else F.array().cast("array<string>")


def points(rules: list[Rule], start: float = 0) -> Column:
    """start plus the points of all rules that hold."""
    total = F.lit(start)
    for r in rules:
        if r.points:
            total = total + F.when(r.when, F.lit(r.points)).otherwise(F.lit(0))
    return total


def clamp(c: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
