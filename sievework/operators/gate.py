"""The issue gate: ordered stages of reasons and points, batch signals, repository health and the fresh re-check."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import blank, contains_any, has, issue_title, money, repo_of, words_pattern
from sievework.operators.rules import Rule, all_matches, clamp, points

#: The stages in the order of the contract, and the reasons that alone reject nothing.
STAGES = {
    "state_and_repo": ("CLOSED", "CLOSED_OR_ARCHIVED_REPO"),
    "aggregator_and_farm": (
        "AGGREGATOR_DIGEST",
        "BOT_OR_FARM_REPO",
        "CLONE_FARM",
        "REPEATED_TITLE",
        "NOT_A_CODING_TASK",
        "NO_TASK",
        "UNFUNDED_NOTICE",
        "WORD_ONLY_MATCH",
        "PLATFORM_FEATURE",
        "CRYPTO_WALLET_IN_BODY",
        "CRYPTO_PAYMENT",
        "STALE",
    ),
    "taken_and_self": ("TAKEN", "SELF_ASSIGNED", "SELF_FIXED"),
    "owner_and_quality": ("OWNER_BACKLOG", "INTERNAL_TEAM_TASK", "TRIVIAL_TASK", "TEMPLATED_ISSUE", "LABEL_STUFFING", "FOLLOW_UP_INTERNAL", "LOCAL_KNOWLEDGE_REQUIRED", "DOMAIN_PENALTY"),
    "new_issue_hold": ("NEW_ISSUE_HOLD",),
}
SOFT = ("PLATFORM_FEATURE", "LOW_TRUST_POSTER", "FOLLOW_UP_INTERNAL", "NEW_ISSUE_HOLD", "LOCAL_KNOWLEDGE_REQUIRED", "DOMAIN_PENALTY")


def stage_of(reason: str) -> str | None:
    return next((name for name, reasons in STAGES.items() if reason in reasons), None)


@dataclass(frozen=True)
class GateConfig:
    """Thresholds and phrases of the gate; any of them can be given anew."""

    platforms: tuple = ("algora.io", "issuehunt.io", "polar.sh", "bountysource.com", "gitcoin.co")
    platform_bots: tuple = ("algora", "issuehunt", "polar-bot", "bountysource", "gitcoin")
    bounty_labels: tuple = ("bounty", "bounties", "reward", "paid", "funded")
    least_amount: float = 50.0
    most_amount: float = 1_000_000.0
    stale_days: int = 14
    least_body: int = 80
    clone_repos: int = 3
    label_stuffing: int = 6
    large_kb: int = 50_000
    least_kb: int = 50
    accept: int = 70
    least_contributors: int = 3
    hold_minutes: int = 60
    self_fixed_minutes: int = 30
    owner_share: float = 0.90
    pushed_days: int = 30
    farm_repos: tuple = ("bounty-bot", "bountybot", "bounty-plaza", "bountyplaza", "bountyscout", "bounty-scout", "scout", "aggregator")
    bot_authors: tuple = ("github-actions[bot]", "dependabot[bot]", "renovate[bot]", "actions-user")
    digest_titles: tuple = ("bounty alert", "new opportunities", "scan results", "bounty digest", "opportunity scan", "intake", "release-watch", "bounty-alert")
    aggregator_titles: tuple = ("scope digest", "bounty scout —", "bounty scout -", "bounty alert", "intake (release-watch)")
    aggregator_repos: tuple = ("-watch", "-scout", "bounty-scout", "bounty-watch", "digest")
    digest_labels: tuple = ("intake", "release-watch", "bounty-alert", "intake-release-watch", "bounty-watch", "bounty-scout", "digest")
    newcomer_labels: tuple = ("help wanted", "good first issue", "up-for-grabs", "up for grabs")
    internal_labels: tuple = ("plan", "internal", "roadmap", "tracking", "epic", "meta")
    plan_prefixes: tuple = ("[plan]", "plan:", "todo", "issue 1.5:")
    team_phrases: tuple = ("teammates", "team mates", "split by category", "see docs/conventions.md before starting", "our team", "sprint", "internal team", "assigned to the team")
    follow_ups: tuple = ("follow-up from the review of", "follow up from the review of", "from the review of pr #", "from the review of #", "follow-up of the review")
    local_knowledge: tuple = ("campus", "college", "university", "curriculum", "institution's documents", "official documents", "syllabus", "school's", "district's")
    hard_domains: tuple = ("kernel", "kernel code", "operating system", "hypervisor", "firmware", "assembly", "asm", "smart contract", "solidity", "cryptography")
    platform_features: tuple = ("bounty platform", "bounty website", "bounty app", "escrow app", "reward platform")
    unfunded: tuple = ("does not fund a bounty", "no reward", "not funded", "unpaid", "publishing this issue does not fund", "this issue does not fund")
    strong_stack: tuple = ("python", "django", "fastapi", "react", "typescript", "next.js", "postgres")
    weak_stack: tuple = ("javascript", "node", "docker", "sql", "css")
    avoid: tuple = ()


#: Phrases and patterns of single checks.
WALLET = r"\b([13][a-km-zA-HJ-NP-Z1-9]{25,34}|bc1[a-z0-9]{39,59}|0x[a-fA-F0-9]{40}|L[a-km-zA-HJ-NP-Z1-9]{26,33}|tb1[a-z0-9]{39,59})\b"
CRYPTO_AMOUNT = r"(?:\b\d[\d,]*(?:\.\d+)?\s*(?:usdc|usdt|btc|eth|sol|xlm|ltc|dai|usd\s*coin|sats?)\b|\b(?:usdc|usdt|btc|eth|sol|xlm|ltc|dai|sats?)\s*\d)"
CRYPTO_WORDS = "btc|bitcoin|eth|ethereum|ltc|litecoin|sol|solana|xlm|stellar|usdc|usdt|dai|usd coin|stablecoin|lightning network|lightning|sats|satoshi|satoshis|on-chain|onchain|web3|defi|crypto|cryptocurrency|memecoin".split("|")
PAYMENT_WORDS = (
    "paid in|pay in|payment in|reward in|pays in|pay via|paid via|payout in|payouts in|compensation in|send crypto|crypto payment|crypto reward|crypto bounty|pay me in|pay to my wallet|wallet address"
).split("|")
TRACKING = r"\[(?:system )?roadmap\]|\b(?:tracking issue|meta issue|epic:)\b|^\s*track (?:all|every)\b"
SUBMISSION = "[server submission]|[submission]|submission form|add to awesome|awesome list|directory submission|listing request|add my project|add a tool".split("|")
EVENT = r"\b(talk|symposium|meetup|webinar|conference|podcast)\b"
EVENT_WORK = r"\b(fix|bug|implement|refactor|add support)\b"
DOWNLOAD_SPAM = "download |latest version|free download|crack|keygen|full version|activation key|torrent|serial number".split("|")
TASK_VERBS = "fix add remove update change implement create resolve refactor migrate support".split()
SUBSTANCE = "file|module|acceptance criteria|reproduce|repro|steps to reproduce|test|unit test|line |function|class |workflow|.yml|.yaml|.py|.js|.ts|expected|actual|steps:|suggested fix|patch".split("|")
EFFORT_LABELS = ("e1", "e2", "easy", "small", "good first issue", "help wanted")
CLAIMS = ("i'll take", "i will take", "i'm working on", "i am working on", "working on this", "assigned to me", "claimed")
MAINTAINERS = ("OWNER", "MEMBER", "COLLABORATOR")


def _count(text: Column, terms) -> Column:
    return sum([text.contains(t).cast("int") for t in terms], F.lit(0))


def batch_signals(issues: DataFrame, title: str = "title", author: str = "author", repo: str = "repo", norm: Column | None = None, who: Column | None = None) -> DataFrame:
    """Add similar_titles, author_recent and template_group: how often a title, author or opening recurs in the batch.

    Three aggregates with map-side combine joined back, so a title that a third of all issues share is one row
    of a small table and not one task's window. norm, who: title and author as they are compared, if not by
    issue_title() and in lower case with null as empty; a null is alike to nulls only.
    """
    norm = issue_title(F.col(title)) if norm is None else norm
    who = F.lower(blank(F.col(author))) if who is None else who
    first = F.array_join(F.slice(F.split(norm, " "), 1, 3), " ")
    d = issues.withColumns({"_norm": norm, "_open": first, "_who": who})
    titles = d.groupBy("_norm").agg(F.countDistinct(blank(F.col(repo))).alias("_repos"), F.count("*").alias("_titles"))
    authors = d.groupBy("_who").agg(F.count("*").alias("_authored"))
    opened = d.groupBy("_who", "_open").agg(F.count("*").alias("template_group"))
    for counted, keys in ((titles, ["_norm"]), (authors, ["_who"]), (opened, ["_who", "_open"])):
        counted = counted.withColumnsRenamed({k: f"{k}_of" for k in keys})
        d = d.join(counted, reduce(lambda a, b: a & b, [d[k].eqNullSafe(counted[f"{k}_of"]) for k in keys])).drop(*[f"{k}_of" for k in keys])
    d = d.withColumn("similar_titles", F.greatest("_repos", "_titles") - 1).withColumn("author_recent", F.col("_authored") - 1)
    return d.drop("_norm", "_open", "_who", "_repos", "_titles", "_authored")


def issue_rules(now: Column, config: GateConfig = GateConfig()) -> tuple[list[Rule], list[Rule], dict[str, Column]]:
    """(reasons with points, points alone, shared facts) over columns of an issue.

    Columns: title, body, state, closed_at, labels array<string>, author, association, assignees array<string>,
    linked_prs array<struct<author_login, created_at>>, comments, created_at, updated_at, repo, archived, size_kb,
    owner, contributor_count, outside_merged, owner_share, parent_title, similar_titles, author_recent, template_group.
    `now` is given, never the clock.
    """
    c, g = F.col, config
    title, body = blank(c("title")), blank(c("body"))
    labels = F.transform(F.coalesce(c("labels"), F.array().cast("array<string>")), F.lower)
    low_title, low_body = F.lower(title), F.lower(body)
    text = F.concat_ws(" ", low_title, low_body)
    labelled = F.concat_ws(" ", text, F.array_join(labels, " "))
    author, owner = F.lower(blank(c("author"))), F.lower(blank(c("owner")))
    among = lambda listed: F.arrays_overlap(labels, F.array(*[F.lit(x) for x in listed]))
    newcomer, substance = among(g.newcomer_labels), contains_any(low_body, SUBSTANCE)
    assignees = F.transform(F.coalesce(c("assignees"), F.array().cast("array<string>")), F.lower)
    minutes = lambda a, b: F.abs(F.unix_timestamp(a) - F.unix_timestamp(b)) / 60
    prs = F.coalesce(c("linked_prs"), F.array().cast("array<struct<author_login:string,created_at:timestamp>>"))
    self_pr = F.exists(prs, lambda p: F.coalesce((author != "") & (F.lower(p["author_login"]) == author), F.lit(False)) | F.coalesce(minutes(p["created_at"], c("created_at")) <= g.self_fixed_minutes, F.lit(False)))
    association = F.upper(blank(c("association")))
    is_owner = (author != "") & ((association == "OWNER") | ((owner != "") & (author == owner)))
    outside = F.coalesce(c("outside_merged"), F.lit(0))
    known = c("contributor_count").isNotNull() | c("outside_merged").isNotNull() | c("owner_share").isNotNull()
    solo = known & ((c("contributor_count") < g.least_contributors) | (outside == 0) | (c("owner_share") >= g.owner_share))
    structural = (
        low_title.rlike("^(?:" + "|".join(p.replace("[", r"\[").replace("]", r"\]").replace(".", r"\.") for p in g.plan_prefixes) + ")")
        | among(g.internal_labels)
        | F.lower(blank(c("parent_title"))).rlike("review|audit|defects? found|tracking")
    )
    words = F.regexp_extract_all(low_title, F.lit(r"(?U)\w+"), F.lit(0))
    pairs = F.when(F.size(words) >= 4, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1))))
    repo = F.lower(blank(c("repo")))
    amounts = F.filter(money(body), lambda m: m["amount"].between(g.least_amount, g.most_amount))
    signal = contains_any(text, g.platforms) | F.exists(labels, lambda x: contains_any(x, (*g.bounty_labels, *g.platforms))) | contains_any(author, g.platform_bots)
    funded = signal & (F.size(amounts) > 0)
    alignment = labelled.contains("needs alignment") | labelled.contains("needs triage")
    word_only = ~funded & text.contains("bounty")
    maintainer = (author != "") & ((owner == author) | (F.substring_index(repo, "/", 1) == author))
    age = minutes(now, c("created_at"))
    hold = F.coalesce(age < g.hold_minutes, F.lit(False)) & ~newcomer
    spam = _count(text, DOWNLOAD_SPAM) >= 2
    not_task = contains_any(low_title, SUBMISSION) | contains_any(F.substring(text, 1, 400), SUBMISSION) | (low_title.rlike(EVENT) & ~low_title.rlike(EVENT_WORK)) | spam
    stale = F.coalesce(F.floor((F.unix_timestamp(now) - F.unix_timestamp(c("updated_at"))) / 86400) > g.stale_days, F.lit(True))
    crypto = has(text, CRYPTO_AMOUNT) | (contains_any(text, PAYMENT_WORDS) & has(text, words_pattern(CRYPTO_WORDS)))
    rules = [
        Rule("CLOSED", (F.lower(blank(c("state"))) == "closed") | c("closed_at").isNotNull(), -50),
        Rule("CLOSED_OR_ARCHIVED_REPO", F.coalesce(c("archived"), F.lit(False)), -50),
        Rule("STALE", stale, -30),
        Rule("CRYPTO_WALLET_IN_BODY", body.rlike(WALLET), -50),
        Rule("CRYPTO_PAYMENT", crypto, -50),
        Rule("AGGREGATOR_DIGEST", contains_any(author, g.bot_authors) | contains_any(low_title, (*g.digest_titles, *g.aggregator_titles)) | contains_any(repo, g.aggregator_repos) | among(g.digest_labels), -40),
        Rule("BOT_OR_FARM_REPO", contains_any(repo, g.farm_repos) | F.coalesce(c("size_kb") < g.least_kb, F.lit(False)), -30),
        Rule("CLONE_FARM", F.coalesce(c("similar_titles") >= g.clone_repos, F.lit(False)), -30),
        Rule("REPEATED_TITLE", F.coalesce(F.size(pairs) != F.size(F.array_distinct(pairs)), F.lit(False)), -15),
        Rule("NO_TASK", labelled.rlike(TRACKING), -30),
        Rule("NOT_A_CODING_TASK", not_task, -40),
        Rule("NO_TASK", (F.length(F.trim(body)) < g.least_body) | ~contains_any(low_body, TASK_VERBS), -25),
        Rule("TAKEN", (F.size(assignees) > 0) | (F.lower(blank(c("state"))) == "closed"), -40),
        Rule("SELF_ASSIGNED", (author != "") & F.array_contains(assignees, author), -50),
        Rule("SELF_FIXED", self_pr, -50),
        Rule("OWNER_BACKLOG", is_owner & ~newcomer & (outside <= 0) & F.coalesce(solo | structural, F.lit(False)), -50),
        Rule("INTERNAL_TEAM_TASK", contains_any(text, g.team_phrases) & ~newcomer, -40),
        Rule("TRIVIAL_TASK", contains_any(low_body, ("no coding required", "under 1 minute", "just paste")) | (low_body.contains("placeholder") & contains_any(low_body, (".json", ".txt", ".yml"))), -30),
        Rule("TEMPLATED_ISSUE", low_title.contains("variation") | low_title.rlike(r"answer the \d+ linked question") | F.coalesce(c("template_group") >= 3, F.lit(False)) | F.coalesce(c("author_recent") >= 5, F.lit(False)), -20),
        Rule("LABEL_STUFFING", F.size(labels) >= g.label_stuffing, -20),
        Rule("FOLLOW_UP_INTERNAL", contains_any(text, g.follow_ups) & (association.isin(*MAINTAINERS) | maintainer), -20),
        Rule("LOCAL_KNOWLEDGE_REQUIRED", contains_any(text, g.local_knowledge), -15),
        Rule("DOMAIN_PENALTY", has(labelled, words_pattern(g.hard_domains), fold=False), -20),
        Rule("NEW_ISSUE_HOLD", hold),
        Rule("UNFUNDED_NOTICE", ~funded & contains_any(low_body, g.unfunded), -40),
        Rule("WORD_ONLY_MATCH", word_only & ~(substance & ~alignment), -25),
        Rule("PLATFORM_FEATURE", contains_any(text, g.platform_features), -10),
    ]
    invited = among(("good first issue", "help wanted"))
    strong = _count(labelled, g.strong_stack) + contains_any(labelled, ("workflow", ".github/workflows", ".yml", ".yaml")).cast("int")
    weak = _count(labelled, g.weak_stack)
    more = [
        Rule("funding", funded, 40),
        Rule("word_only", word_only & substance & ~alignment, -10),
        Rule("effort_label", among(EFFORT_LABELS), 10),
        Rule("invited_with_substance", invited & substance, 10),
        Rule("invited_without_substance", invited & ~substance, -10),
        Rule("maintainer_authored", maintainer, 10),
        Rule("fresh", F.coalesce(F.floor(age / 1440) <= 7, F.lit(False)), 8),
        Rule("few_comments", F.coalesce(c("comments"), F.lit(0)) <= 5, 5),
        Rule("stack_strong", (strong > weak) & (strong > 0), 12),
        Rule("stack_weak", ~((strong > weak) & (strong > 0)) & (weak > 0), 4),
        Rule("avoid_domain", contains_any(text, g.avoid) if g.avoid else F.lit(False), -20),
        Rule("large_codebase", F.coalesce(c("size_kb") > g.large_kb, F.lit(False)), -20),
        Rule("needs_alignment", alignment, -15),
        Rule("review_needed", labelled.contains("s0: review needed"), -5),
        Rule("difficulty_hard", labelled.contains("difficulty: hard") | labelled.contains("difficulty:hard"), -15),
    ]
    return rules, more, {"funded": funded, "hold": hold, "amount": F.get(amounts, 0)["amount"], "currency": F.get(amounts, 0)["currency"]}


def evaluate(issues: DataFrame, now: Column, config: GateConfig = GateConfig()) -> DataFrame:
    """Add reasons, score, verdict, lane, hold, funded: one projection over issues with their batch signals."""
    rules, more, facts = issue_rules(now, config)
    d = issues.withColumn("reasons", F.array_distinct(all_matches(rules))).withColumn("score", clamp(points([*rules, *more], 50)).cast("int"))
    d = d.withColumns({"hold": facts["hold"], "funded": facts["funded"]})
    soft = F.array(*[F.lit(r) for r in SOFT])
    hard = F.size(F.array_except("reasons", soft)) > 0
    verdict = F.when(hard, "reject").when(F.col("score") >= config.accept, "accept").otherwise("uncertain")
    return d.withColumn("verdict", verdict).withColumn("lane", F.when(F.col("funded"), "PAID").otherwise("PROOF"))


def feed_guard(verdict: Column, verified: Column, state: Column, assignees: Column, reasons: Column, created: Column, now: Column, least_minutes: int = 60) -> Column:
    """May an issue be shown: accepted, verified, open, free, without reasons and old enough."""
    old = (F.unix_timestamp(now) - F.unix_timestamp(created)) / 60 >= least_minutes
    return (verdict == "accept") & (verified == "VERIFIED") & (F.lower(state) == "open") & (F.size(F.coalesce(assignees, F.array().cast("array<string>"))) == 0) & (F.size(reasons) == 0) & old


def repo_health(repos: DataFrame, now: Column, config: GateConfig = GateConfig()) -> DataFrame:
    """Add passed (of seven checks), failed, healthy and watchlist to repository facts."""
    c = F.col
    checks = {
        "pushed_recently": F.coalesce(F.floor((F.unix_timestamp(now) - F.unix_timestamp(c("pushed_at"))) / 86400) <= config.pushed_days, F.lit(False)),
        "not_fork": ~F.coalesce(c("is_fork"), F.lit(False)),
        "not_archived": ~F.coalesce(c("is_archived"), F.lit(False)),
        "has_contributing": F.coalesce(c("has_contributing"), F.lit(False)),
        "has_recent_merges": F.coalesce(c("merged_prs_recent"), F.lit(0)) > 0,
        "reasonable_size": F.coalesce(c("repo_size_kb"), F.lit(0)) <= config.large_kb,
        "pr_backlog_ok": ~((F.coalesce(c("open_prs"), F.lit(0)) >= 200) & (F.coalesce(c("merged_prs_recent"), F.lit(0)) < 5)),
    }
    passed = sum([v.cast("int") for v in checks.values()], F.lit(0))
    failed = F.array_compact(F.array(*[F.when(~v, k) for k, v in checks.items()]))
    healthy = (passed >= 5) & checks["not_fork"] & checks["not_archived"]
    outside = F.coalesce(c("outside_merged_prs_recent"), F.lit(0))
    owner_only = F.coalesce(c("owner_issue_share") >= config.owner_share, F.lit(False)) & (outside == 0)
    watch = healthy & (outside >= config.least_contributors) & checks["has_contributing"] & ~owner_only
    return repos.withColumns({"passed": passed, "failed": failed, "healthy": healthy, "watchlist": watch})


def recheck(issues: DataFrame, events: DataFrame, minutes: int = 30) -> DataFrame:
    """Decide again by what has happened since: keep and reasons, by (repo, number).

    issues: repo, number, author, created_at, state, closed_at, assignees, archived, status (ok or why the call
    failed). events: repo, number, event, actor, author_association, body, pr_author, created_at. Events are folded
    by one aggregate of flags, joined back.
    """
    c = F.col
    facts = issues.select("repo", "number", F.lower(blank(c("author"))).alias("_author"), c("created_at").alias("_opened"))
    e = events.join(facts, ["repo", "number"])
    linked = c("event").isin("cross-referenced", "connected")
    near = F.coalesce(F.abs(F.unix_timestamp("created_at") - F.unix_timestamp("_opened")) / 60 <= minutes, F.lit(False))
    own = F.coalesce((c("_author") != "") & (F.lower(c("pr_author")) == c("_author")), F.lit(False))
    claim = (c("event") == "commented") & F.upper(blank(c("author_association"))).isin(*MAINTAINERS) & contains_any(F.lower(blank(c("body"))), CLAIMS)
    folded = e.groupBy("repo", "number").agg(F.max(linked).alias("_linked"), F.max(linked & (near | own)).alias("_fixed"), F.max(claim).alias("_claimed"))
    d = issues.join(folded, ["repo", "number"], "left")
    flag = lambda name: F.coalesce(c(name), F.lit(False))
    people = F.transform(F.coalesce(c("assignees"), F.array().cast("array<string>")), F.lower)
    author = F.lower(blank(c("author")))
    own_hand = (author != "") & F.array_contains(people, author)
    rules = [
        Rule("CLOSED", (F.lower(blank(c("state"))) == "closed") | c("closed_at").isNotNull()),
        Rule("CLOSED_OR_ARCHIVED_REPO", F.coalesce(c("archived"), F.lit(False))),
        Rule("SELF_ASSIGNED", own_hand),
        Rule("TAKEN", (F.size(people) > 0) & ~own_hand),
        Rule("TAKEN", flag("_linked")),
        Rule("SELF_FIXED", flag("_fixed")),
        Rule("TAKEN", flag("_claimed")),
    ]
    reasons = F.when(blank(c("status")) != "ok", F.array(F.lit("UNVERIFIED"))).otherwise(F.array_distinct(all_matches(rules)))
    return d.select("repo", "number", reasons.alias("reasons")).withColumn("keep", F.size("reasons") == 0)
