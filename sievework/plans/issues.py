"""The issue gate over issue-shaped rows made of the documents so that its stages are reached, with SQL for every rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.text import MONEY
from sievework.operators import gate
from sievework.plans.catalogue import query
from sievework.plans.listings import _pick, _sql_pick, fold, quoted, sql_any, sql_has, sql_words
from sievework.plans.tables import table

NOW = 1_751_241_600
TITLES = (
    "Fix crash in parser", "[Plan] roadmap of the year", "Bounty alert: new opportunities", "Add support for dark mode", "Variation 7 of the linked task", "Submission form: add my project", "Talk at the meetup", "Fix login bug now fix login bug now",
    "Track all regressions", "Kernel driver and firmware", "Bounty platform for all", "Free download of crack and keygen", "Update the django workflow",
)
BODIES = (
    "", "Please fix the file module. Steps to reproduce: run the unit test.", "Pays $500 via algora.io for the patch to this function.", "Fix it, paid in USDC.", "Send to 0x52908400098527886E0F7030069857D2E4169EE7 and implement it.", "No coding required, just paste it.",
    "This issue does not fund a bounty. Please add a test file.", "A bounty for this function, implement it.", "Follow-up from the review of PR #4: update the workflow .yml", "For our campus and its syllabus: create a page.", "Our team will resolve it in the sprint.",
    "A placeholder in data.json to change", "This needs alignment before we implement it, for a bounty.", "Reward of 20 USD, migrate the module.",
)
LABELS = ((), ("bug",), ("Bounty", "good first issue"), ("Epic",), ("help wanted", "e1"), ("a", "b", "c", "d", "e", "f"), ("digest",), ("S0: review needed", "difficulty: hard"), ("python", "docker"))
AUTHORS, ASSOCIATIONS, STATES = ("ann", "Bob", "github-actions[bot]", "org1", "algora-pbc", ""), ("OWNER", "MEMBER", "NONE", "CONTRIBUTOR", ""), ("open", "Open", "open", "closed", "open", "open", "open")
ASSIGNEES, REPOS = ((), (), (), ("Ann",), ("bob", "cy"), ()), ("org1/app", "bob/tools", "x/bounty-scout", "acme/site", "acme/bounty-bot", "ann/lib")
PARENTS = ("", "Security audit", "Release")
_PICKED = {"title": (TITLES, 1), "note": (BODIES, 2), "labels": (LABELS, 3), "author": (AUTHORS, 5), "association": (ASSOCIATIONS, 7), "state": (STATES, 4), "assignees": (ASSIGNEES, 9), "repo": (REPOS, 6), "parent_title": (PARENTS, 8)}


def issues(spark, sf_dir):
    """Issue-shaped rows: the columns that gate.issue_rules() reads; the body is a note and the whole text."""
    i, at = F.col("doc_id"), lambda s: F.timestamp_seconds(s)
    made = NOW - (i * 37) % 20_000 * 60
    d = table(spark, sf_dir, "documents").select("doc_id", "text", *[_pick(v, s).alias(c) for c, (v, s) in _PICKED.items()])
    pr = lambda who, after: F.array(F.struct(who.alias("author_login"), at(made + after).alias("created_at")))
    some = lambda *vs: F.element_at(F.array(*[F.lit(v) for v in vs]), (i % len(vs) + 1).cast("int"))
    return d.withColumns(
        {
            "body": F.concat_ws(" ", "note", "text"), "closed_at": F.when(i % 13 == 0, at(F.lit(NOW))), "created_at": at(made), "updated_at": F.when(i % 19 != 0, at(NOW - i % 30 * 86_400)),
            "linked_prs": F.when(i % 23 == 0, pr(F.lit("dee"), 600)).when(i % 29 == 0, pr(F.upper("author"), 432_000)), "comments": i % 9, "archived": i % 17 == 0, "owner": F.substring_index("repo", "/", 1),
            "size_kb": some(None, 4000, 20, 300, 60_000, 800), "contributor_count": some(5, None, 1, 40), "outside_merged": some(0, 3, None), "owner_share": some(None, 0.95, 0.2),
            "similar_titles": i % 5, "author_recent": i % 7, "template_group": i % 4,
        }
    ).drop("text", "note")


_SOME = lambda *vs: f"([{', '.join('NULL' if v is None else str(v) for v in vs)}])[CAST(doc_id % {len(vs)} + 1 AS INTEGER)]"
_ROWS = f"""(SELECT *, split_part(repo, '/', 1) AS owner, {NOW} - doc_id * 37 % 20000 * 60 AS created, CASE WHEN doc_id % 19 <> 0 THEN {NOW} - doc_id % 30 * 86400 END AS updated, {_SOME(None, 4000, 20, 300, 60000, 800)} AS size_kb, {_SOME(5, None, 1, 40)} AS people,
 {_SOME(0, 3, None)} AS outside0, {_SOME(None, 0.95, 0.2)} AS share, lower(title) AS lt, lower(body) AS lb, list_transform(labels, lambda x: lower(x)) AS ll, lower(author) AS who, list_transform(assignees, lambda x: lower(x)) AS taken FROM
 (SELECT doc_id, {", ".join(f"{_sql_pick(v, s)} AS {c}" for c, (v, s) in _PICKED.items())}, concat_ws(' ', {_sql_pick(BODIES, 2)}, text) AS body FROM documents))"""
_MONEY = f"list_transform(regexp_extract_all(body, {quoted(MONEY)}, 0, 'i'), lambda m: try_cast(replace(regexp_extract(m, '\\d[\\d,]*(?:\\.\\d{{1,2}})?', 0), ',', '') AS DOUBLE))"
_g = gate.GateConfig()
_among = lambda listed: f"list_has_any(ll, [{', '.join(map(quoted, listed))}])"
_FACTS = f"""(SELECT *, coalesce(outside0, 0) AS outside, {_among(_g.newcomer_labels)} AS newcomer, {sql_any('lb', gate.SUBSTANCE)} AS substance, ({NOW} - created) / 60.0 AS age, who <> '' AND (association = 'OWNER' OR who = owner) AS is_owner, who <> '' AND owner = who AS maintainer,
 (people IS NOT NULL OR outside0 IS NOT NULL OR share IS NOT NULL) AND (people < 3 OR coalesce(outside0, 0) = 0 OR share >= 0.9) AS solo, {sql_has('lt', '^(?:.plan.|plan:|todo|issue 1.5:)')} OR {_among(_g.internal_labels)} OR {sql_has('lower(parent_title)', 'review|audit|defects? found|tracking')} AS structural,
 ({sql_any('tx', _g.platforms)} OR len(list_filter(ll, lambda x: {sql_any('x', (*_g.bounty_labels, *_g.platforms))})) > 0 OR {sql_any('who', _g.platform_bots)}) AND len(list_filter({_MONEY}, lambda m: m BETWEEN 50 AND 1000000)) > 0 AS funded,
 contains(lx, 'needs alignment') OR contains(lx, 'needs triage') AS alignment, doc_id % 23 = 0 OR (doc_id % 29 = 0 AND who <> '') AS self_pr, {fold('tx')} AS ftx, {fold('lx')} AS flx, regexp_extract_all(lt, '\\w+') AS tw
 FROM (SELECT *, concat_ws(' ', lt, lb) AS tx, concat_ws(' ', lt, lb, array_to_string(ll, ' ')) AS lx FROM {_ROWS}))"""
_PAIRS = "list_transform(range(1, len(tw)), lambda i: tw[i] || ' ' || tw[i + 1])"
_COUNT = lambda text, terms: "(" + " + ".join(f"CAST(contains({text}, {quoted(t)}) AS INTEGER)" for t in terms) + ")"
_WORD_ONLY = "(NOT funded AND contains(tx, 'bounty'))"
#: (reason, when, points), in the order of the stages.
_RULES = [
    ("CLOSED", "lower(state) = 'closed' OR doc_id % 13 = 0", -50), ("CLOSED_OR_ARCHIVED_REPO", "doc_id % 17 = 0", -50), ("STALE", f"coalesce(floor(({NOW} - updated) / 86400) > 14, true)", -30), ("CRYPTO_WALLET_IN_BODY", sql_has("body", gate.WALLET, flags="c"), -50),
    ("CRYPTO_PAYMENT", f"{sql_has('ftx', gate.CRYPTO_AMOUNT)} OR ({sql_any('tx', gate.PAYMENT_WORDS)} AND {sql_has('ftx', sql_words(gate.CRYPTO_WORDS))})", -50),
    ("AGGREGATOR_DIGEST", f"{sql_any('who', _g.bot_authors)} OR {sql_any('lt', (*_g.digest_titles, *_g.aggregator_titles))} OR {sql_any('repo', _g.aggregator_repos)} OR {_among(_g.digest_labels)}", -40),
    ("BOT_OR_FARM_REPO", f"{sql_any('repo', _g.farm_repos)} OR coalesce(size_kb < 50, false)", -30), ("CLONE_FARM", "doc_id % 5 >= 3", -30), ("REPEATED_TITLE", f"len(tw) >= 4 AND len({_PAIRS}) <> len(list_distinct({_PAIRS}))", -15), ("NO_TASK", sql_has("lx", gate.TRACKING, flags="c"), -30),
    ("NOT_A_CODING_TASK", f"{sql_any('lt', gate.SUBMISSION)} OR {sql_any('substr(tx, 1, 400)', gate.SUBMISSION)} OR ({sql_has('lt', gate.EVENT)} AND NOT {sql_has('lt', gate.EVENT_WORK)}) OR {_COUNT('tx', gate.DOWNLOAD_SPAM)} >= 2", -40),
    ("NO_TASK", f"len(trim(body)) < 80 OR NOT {sql_any('lb', gate.TASK_VERBS)}", -25), ("TAKEN", "len(taken) > 0 OR lower(state) = 'closed'", -40), ("SELF_ASSIGNED", "who <> '' AND list_contains(taken, who)", -50), ("SELF_FIXED", "self_pr", -50),
    ("OWNER_BACKLOG", "is_owner AND NOT newcomer AND outside <= 0 AND coalesce(solo OR structural, false)", -50), ("INTERNAL_TEAM_TASK", f"{sql_any('tx', _g.team_phrases)} AND NOT newcomer", -40),
    ("TRIVIAL_TASK", f"{sql_any('lb', ('no coding required', 'under 1 minute', 'just paste'))} OR (contains(lb, 'placeholder') AND {sql_any('lb', ('.json', '.txt', '.yml'))})", -30),
    ("TEMPLATED_ISSUE", f"contains(lt, 'variation') OR {sql_has('lt', r'answer the [0-9]+ linked question')} OR doc_id % 4 >= 3 OR doc_id % 7 >= 5", -20), ("LABEL_STUFFING", "len(ll) >= 6", -20),
    ("FOLLOW_UP_INTERNAL", f"{sql_any('tx', _g.follow_ups)} AND (association IN ('OWNER', 'MEMBER', 'COLLABORATOR') OR maintainer)", -20), ("LOCAL_KNOWLEDGE_REQUIRED", sql_any("tx", _g.local_knowledge), -15), ("DOMAIN_PENALTY", sql_has("flx", sql_words(_g.hard_domains), flags="c"), -20),
    ("NEW_ISSUE_HOLD", "age < 60 AND NOT newcomer", 0), ("UNFUNDED_NOTICE", f"NOT funded AND {sql_any('lb', _g.unfunded)}", -40), ("WORD_ONLY_MATCH", f"{_WORD_ONLY} AND NOT (substance AND NOT alignment)", -25), ("PLATFORM_FEATURE", sql_any("tx", _g.platform_features), -10),
]
_INVITED, _STRONG, _WEAK = _among(("good first issue", "help wanted")), f"({_COUNT('lx', _g.strong_stack)} + CAST({sql_any('lx', ('workflow', '.github/workflows', '.yml', '.yaml'))} AS INTEGER))", _COUNT("lx", _g.weak_stack)
_MORE = [
    ("funded", 40), (f"{_WORD_ONLY} AND substance AND NOT alignment", -10), (_among(gate.EFFORT_LABELS), 10), (f"{_INVITED} AND substance", 10), (f"{_INVITED} AND NOT substance", -10), ("maintainer", 10), ("floor(age / 1440) <= 7", 8), ("doc_id % 9 <= 5", 5),
    (f"{_STRONG} > {_WEAK} AND {_STRONG} > 0", 12), (f"NOT ({_STRONG} > {_WEAK} AND {_STRONG} > 0) AND {_WEAK} > 0", 4), ("coalesce(size_kb > 50000, false)", -20), ("alignment", -15), ("contains(lx, 's0: review needed')", -5), ("contains(lx, 'difficulty: hard') OR contains(lx, 'difficulty:hard')", -15),
]
_SCORE = "50" + "".join(f" + CASE WHEN {when} THEN {p} ELSE 0 END" for when, p in [*[(w, p) for _, w, p in _RULES if p], *_MORE])
_REASONS = "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {when} THEN {quoted(r)} END" for r, when, _ in _RULES) + "], lambda x: x IS NOT NULL)))"
_HARD = f"len(list_filter(reasons, lambda x: x NOT IN ({', '.join(map(quoted, gate.SOFT))}))) > 0"
EVALUATED = f"(SELECT *, CASE WHEN {_HARD} THEN 'reject' WHEN score >= 70 THEN 'accept' ELSE 'uncertain' END AS verdict FROM (SELECT *, {_REASONS} AS reasons, CAST(greatest(0, least(100, {_SCORE})) AS INTEGER) AS score FROM {_FACTS}))"


def now() -> Column:
    return F.timestamp_seconds(F.lit(NOW))


def evaluated(spark, sf_dir):
    return gate.evaluate(issues(spark, sf_dir), now())


@query("gate_score_reasons", f"SELECT doc_id, array_to_string(reasons, ',') AS reasons, score, verdict, CASE WHEN funded THEN 'PAID' ELSE 'PROOF' END AS lane FROM {EVALUATED}")
def gate_score_reasons(spark, sf_dir):
    return evaluated(spark, sf_dir).select("doc_id", F.array_join(F.array_sort("reasons"), ",").alias("reasons"), "score", "verdict", "lane")


@query("gate_feed_guard", f"SELECT doc_id, verdict = 'accept' AND lower(state) = 'open' AND len(assignees) = 0 AND len(reasons) = 0 AND age >= 60 AND doc_id % 3 <> 0 AS shown FROM {EVALUATED}")
def gate_feed_guard(spark, sf_dir):
    c = F.col
    verified = F.when(c("doc_id") % 3 != 0, "VERIFIED").otherwise("UNVERIFIED")
    return evaluated(spark, sf_dir).select("doc_id", gate.feed_guard(c("verdict"), verified, c("state"), c("assignees"), c("reasons"), c("created_at"), now()).alias("shown"))


_STAGE = "CASE " + " ".join(f"WHEN r IN ({', '.join(map(quoted, reasons))}) THEN {quoted(stage)}" for stage, reasons in gate.STAGES.items()) + " END"


@query("gate_stage_counts", f"SELECT {_STAGE} AS stage, r AS reason, count(*) AS n FROM (SELECT unnest(reasons) AS r FROM {EVALUATED}) GROUP BY ALL")
def gate_stage_counts(spark, sf_dir):
    each = evaluated(spark, sf_dir).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    stage = F.create_map(*[F.lit(x) for s, reasons in gate.STAGES.items() for r in reasons for x in (r, s)])
    return each.select(stage[F.col("reason")].alias("stage"), "reason", "n")


_HEALTH = f"""(SELECT doc_id, coalesce(floor(({NOW} - pushed) / 86400) <= 30, false) AS c1, doc_id % 7 <> 0 AS c2, doc_id % 11 <> 0 AS c3, doc_id % 2 = 0 AS c4, doc_id % 5 > 0 AS c5, n_chars * 20 <= 50000 AS c6, NOT (doc_id % 300 >= 200 AND doc_id % 5 < 5) AS c7, doc_id % 6 AS outside, (doc_id % 10) / 9.0 AS share
 FROM (SELECT doc_id, n_chars, CASE WHEN doc_id % 19 <> 0 THEN {NOW} - doc_id % 60 * 86400 END AS pushed FROM documents))"""


@query(
    "repo_health",
    f"SELECT doc_id, p AS passed, p >= 5 AND c2 AND c3 AS healthy, p >= 5 AND c2 AND c3 AND outside >= 3 AND c4 AND NOT (share >= 0.9 AND outside = 0) AS watchlist FROM (SELECT *, CAST(c1 AS INTEGER) + CAST(c2 AS INTEGER) + CAST(c3 AS INTEGER) + CAST(c4 AS INTEGER) + CAST(c5 AS INTEGER) + CAST(c6 AS INTEGER) + CAST(c7 AS INTEGER) AS p FROM {_HEALTH})",
)
def repo_health(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 19 != 0, F.timestamp_seconds(NOW - i % 60 * 86_400)).alias("pushed_at"), (i % 7 == 0).alias("is_fork"), (i % 11 == 0).alias("is_archived"), (i % 2 == 0).alias("has_contributing"), (i % 5).alias("merged_prs_recent"),
        (F.col("n_chars") * 20).alias("repo_size_kb"), (i % 300).alias("open_prs"), (i % 6).alias("outside_merged_prs_recent"), (i % 10 / 9.0).alias("owner_issue_share"),
    )
    return gate.repo_health(d, now()).select("doc_id", "passed", "healthy", "watchlist")


_KINDS = ("cross-referenced", "commented", "labeled", "connected", "commented")
_SAID = ("", "I'll take this", "thanks", "Working on this")


@query(
    "gate_recheck",
    f"""WITH e AS (SELECT event_id % (SELECT count(*) FROM documents) + (SELECT min(doc_id) FROM documents) AS doc_id, {_sql_pick(_KINDS, 1).replace('doc_id', 'event_id')} AS event, {_sql_pick(_SAID, 3).replace('doc_id', 'event_id')} AS said, event_id % 5 < 2 AS trusted, {NOW} - event_id * 41 % 20000 * 60 AS at, CASE WHEN event_id % 7 = 0 THEN 'ann' END AS pr FROM events),
    f AS (SELECT i.doc_id, bool_or(event IN ('cross-referenced', 'connected')) AS linked, bool_or(event IN ('cross-referenced', 'connected') AND (abs(e.at - created) / 60.0 <= 30 OR coalesce(who <> '' AND pr = who, false))) AS fixed,
    bool_or(event = 'commented' AND trusted AND {sql_any('lower(said)', gate.CLAIMS)}) AS claimed FROM e JOIN {_ROWS} i ON e.doc_id = i.doc_id GROUP BY i.doc_id)
    SELECT doc_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS keep FROM (SELECT i.doc_id, CASE WHEN i.doc_id % 31 = 0 THEN ['UNVERIFIED'] ELSE list_sort(list_distinct(list_filter([CASE WHEN lower(state) = 'closed' OR i.doc_id % 13 = 0 THEN 'CLOSED' END, CASE WHEN i.doc_id % 17 = 0 THEN 'CLOSED_OR_ARCHIVED_REPO' END,
    CASE WHEN who <> '' AND list_contains(taken, who) THEN 'SELF_ASSIGNED' END, CASE WHEN len(taken) > 0 AND NOT (who <> '' AND list_contains(taken, who)) THEN 'TAKEN' END, CASE WHEN linked OR claimed THEN 'TAKEN' END, CASE WHEN fixed THEN 'SELF_FIXED' END], lambda x: x IS NOT NULL))) END AS reasons FROM {_ROWS} i LEFT JOIN f ON i.doc_id = f.doc_id)""",
)
def gate_recheck(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    i = F.col("event_id")
    pick = lambda v, s: F.element_at(F.array(*[F.lit(x) for x in v]), (F.floor(i / s) % len(v) + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id").join(F.broadcast(docs))  # one row
    e = e.select(
        F.lit("r").alias("repo"), (i % F.col("n") + F.col("least")).alias("number"), pick(_KINDS, 1).alias("event"), F.lit("x").alias("actor"), F.when(i % 5 < 2, "MEMBER").otherwise("NONE").alias("author_association"), pick(_SAID, 3).alias("body"),
        F.when(i % 7 == 0, "ann").alias("pr_author"), F.timestamp_seconds(NOW - (i * 41) % 20_000 * 60).alias("created_at"),
    )
    d = issues(spark, sf_dir).select(F.lit("r").alias("repo"), F.col("doc_id").alias("number"), "author", "created_at", "state", "closed_at", "assignees", "archived", F.when(F.col("doc_id") % 31 == 0, "timeout").otherwise("ok").alias("status"))
    return gate.recheck(d, e).select(F.col("number").alias("doc_id"), F.array_join(F.array_sort("reasons"), ",").alias("reasons"), "keep")
