"""Compensation, risk, outreach and freshness of an opportunity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.text import blank, contains_any, has, money

#: Signals of pay and of risk.
REWARD = r"\b(bounty|bounties|reward|rewards|bounty\s+program)\b"
PAID = r"\b(paid|payment|compensation|sponsor(?:ed|ship)?|fund(?:ed|ing)?|stipend|honorarium)\b"
UNPAID = r"\b(unpaid|not\s+paid|no\s+(?:payment|compensation|pay|budget|monetary\s+reward)|for\s+free|volunteer|pro\s*bono)\b"
NO_REWARD = r"\b(?:no|without)\s+(?:bounty|bounties|reward|rewards|monetary\s+reward)\b"
VAGUE = ("simple project", "quick win", "easy money", "no experience needed", "part-time assistance", "help needed asap", "urgent hire")
UPFRONT = ("upfront", "pay first", "advance payment", "security deposit", "verification fee", "training cost", "equipment fee", "background check fee")
HOURLY = r"[$\s](\d+(?:,\d{3})*(?:\.\d+)?)\s*/\s*hr"
NEGATIONS = ("no", "not", "never", "without", "none", "zero", "don't", "dont", "doesn't", "doesnt", "isn't", "isnt", "won't", "wont", "cannot", "can't", "cant")
CLAUSE_ENDS = (". ", "; ", "! ", "? ", "\n", ", ")
POLLING = {"python_org": 1800, "reddit": 600, "github": 300, "hackernews": 900, "remotive": 900, "jobicy": 900, "arbeitnow": 900, "weworkremotely": 900, "remoteok": 900, "workingnomads": 900, "himalayas": 900}
POLL_OTHERWISE = 900


def compensation(text: Column, kind: str = "freelance", verified: bool = False) -> Column:
    """struct<type, verification, min, max, currency>: what a text says of pay; unknown stays unknown."""
    amounts = money(text)
    negated, paid = has(text, UNPAID), has(text, PAID)
    reward = has(text, REWARD) & ~has(text, NO_REWARD) & ~negated
    priced = F.size(amounts) > 0
    mode = "bounty" if kind == "bounty" else "fixed_price"
    kind_of = F.when(priced | reward, F.when(reward, "bounty").otherwise(mode)).when(negated, "unpaid").when(paid, mode).otherwise("unknown")
    status = F.when(priced | reward, "verified" if verified else "unverified").when(negated, "none").when(paid, "unverified").otherwise("unknown")
    values = F.transform(amounts, lambda m: m["amount"])
    return F.struct(kind_of.alias("type"), status.alias("verification"), F.array_min(values).alias("min"), F.array_max(values).alias("max"), F.when(priced, amounts[0]["currency"]).alias("currency"))


def _clause(window: Column, last: bool) -> Column:
    out = window
    for end in CLAUSE_ENDS:
        out = F.substring_index(out, end, -1 if last else 1)
    return out


def _asks(parts: Column, phrase: str):
    """For the i-th occurrence of a phrase that a text was split at: does its clause leave it standing?"""

    def asks(i: Column) -> Column:
        before = F.array_join(F.slice(parts, 1, i), phrase)
        after = F.array_join(F.slice(parts, i + 1, F.size(parts)), phrase)
        near = _clause(F.when(F.length(before) > 60, F.substring(before, -60, 60)).otherwise(before), True)
        said = F.regexp_extract_all(near, F.lit("[a-z']+"), F.lit(0))
        tail = _clause(F.substring(after, 1, 40), False)
        return ~F.arrays_overlap(said, F.array(*[F.lit(w) for w in NEGATIONS])) & ~tail.rlike(r"\b(?:is|are|was|were)\s+(?:not|never)\b")

    return asks


def upfront(description: Column) -> Column:
    """The phrases that ask for money first, in order, unless negated in their clause."""
    text = F.lower(blank(description))
    found = []
    for phrase in UPFRONT:
        parts = F.split(text, phrase)  # the phrases hold no pattern characters
        places = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
        found.append(F.when(F.exists(places, _asks(parts, phrase)), phrase))
    return F.array_compact(F.array(*found))


def risk(description: Column, pay: Column) -> Column:
    """struct<vague, rate, upfront, unpaid, total, flags>: four components, their sum at most 1."""
    text = F.lower(blank(description))
    words = F.size(F.filter(F.split(blank(description), r"(?U)\s+"), lambda w: w != ""))
    short = (words > 0) & (words < 15)
    vague = F.greatest(F.when(short, F.round(F.lit(0.7) * (1 - words / 15), 2)).otherwise(0.0), F.when(contains_any(text, VAGUE), 0.7).otherwise(0.0))
    hourly = F.regexp_replace(F.regexp_extract(blank(description), "(?i)" + HOURLY, 1), ",", "").try_cast("double")
    rate = F.when(hourly > 150, F.least(F.lit(0.8), hourly / 300)).otherwise(0.0)
    asked = F.when(F.size(upfront(description)) > 0, 0.9).otherwise(0.0)
    free = F.when(F.lower(blank(pay)) == "unpaid", F.when(text.contains("portfolio"), 0.3).otherwise(0.7)).otherwise(0.0)
    flags = F.array_compact(F.array(F.when(vague > 0, "vague_description"), F.when(rate > 0.5, "unrealistic_rate"), F.when(asked > 0, "upfront_payment"), F.when(free > 0.5, "unpaid_test")))
    total = F.round(F.least(F.lit(1.0), vague + rate + asked + free), 2)
    return F.struct(vague.alias("vague"), F.round(rate, 2).alias("rate"), asked.alias("upfront"), free.alias("unpaid"), total.alias("total"), flags.alias("flags"))


def outreach(title: Column, skills: Column, score: Column) -> Column:
    """A draft message: a greeting, the matching skills, and more questions the riskier the listing is."""
    asks = F.array_compact(F.array(F.lit("What is the timeline?"), F.when(score >= 0.3, "How is payment handled?"), F.when(score >= 0.8, "Can you verify the company?")))
    about = F.when(F.size(skills) > 0, F.concat(F.lit("I have worked with "), F.array_join(F.slice(skills, 1, 3), ", "), F.lit(".")))
    return F.concat_ws("\n", F.concat(F.lit("Hello, I am interested in: "), blank(title), F.lit(".")), about, F.array_join(asks, "\n"))


def freshness_seconds(source: Column, kind: Column) -> Column:
    """How long a listing stays fresh: a day for jobs, else the polling interval of its source."""
    table = F.create_map(*[F.lit(x) for kv in POLLING.items() for x in kv])
    return F.when(F.coalesce(kind, F.lit("job")) == "job", 86_400).otherwise(F.coalesce(table[source], F.lit(POLL_OTHERWISE)))


def is_fresh(seen: Column, now: Column, source: Column, kind: Column) -> Column:
    """Never seen, or seen within its window before `now`, which is given and never the clock."""
    return seen.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(seen) <= freshness_seconds(source, kind))


def should_poll(seen: Column, now: Column, source: Column) -> Column:
    return seen.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(seen) >= freshness_seconds(source, F.lit("poll")))
