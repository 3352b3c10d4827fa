"""Operators on literal rows: input, expected label."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import enrich, filters, gate, merge, metrics, models, relational, risk, sampling, score, sections


def one(spark, column, **values):
    kinds = {bool: "boolean", str: "string", int: "long", float: "double", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "title, body, expected",
    [
        ("Entwickler (m/w/d)", "", "german"),
        ("Développeur (f/h)", "", "french"),
        ("Job", "wir suchen dich, bewerbung mit deutschkenntnisse und berufserfahrung", "german"),
        ("", "the cat and the dog of the house is for you", "english"),
        ("", "le chat et la maison de la ville pour les gens dans une rue", "french"),
        ("", "el perro y la casa por los campos con una mesa", "spanish"),
        ("", "", "english"),
        ("x", None, "english"),
    ],
)
def test_language(spark, title, body, expected):
    assert one(spark, enrich.language(F.col("t"), F.col("d")), t=title, d=body) == expected


@pytest.mark.parametrize(
    "title, body, expected",
    [
        ("Software Intern", "", "intern"),
        ("Junior Python Developer", "10+ years required", "junior"),
        ("Senior Backend Engineer", "", "senior"),
        ("Engineer", "no prior experience", "junior"),
        ("Engineer", "must have 8+ years of python", "senior"),
        ("Engineer", "3-5 years of work", "mid"),
        ("Engineer", "", "unspecified"),
        ("Visual leader", "", "unspecified"),
    ],
)
def test_seniority(spark, title, body, expected):
    assert one(spark, enrich.seniority(F.col("t"), F.col("d")), t=title, d=body) == expected


@pytest.mark.parametrize("text, expected", [("This is an unpaid role", True), ("Unpaid internship here", True), ("paid volunteer time off", False), ("equity only", True), ("", False)])
def test_unpaid(spark, text, expected):
    assert one(spark, enrich.unpaid(F.lit("Engineer"), F.col("d")), d=text) is expected


@pytest.mark.parametrize(
    "title, remote, location, restriction, expected",
    [("Dev US", True, "", "", "BLOCKED"), ("Dev", True, "Worldwide", "", "ACCESSIBLE"), ("Dev", False, "Berlin", "", "BLOCKED"), ("Dev", True, "Berlin", "", "BLOCKED"), ("Dev", True, "", "worldwide", "ACCESSIBLE"), ("Dev", True, "APAC", "", "UNKNOWN"), ("Dev", True, None, None, "UNKNOWN")],
)
def test_access(spark, title, remote, location, restriction, expected):
    assert one(spark, enrich.access(F.col("t"), F.col("r"), F.col("l"), F.col("x")), t=title, r=remote, l=location, x=restriction) == expected


@pytest.mark.parametrize(
    "title, body, location, remote, expected",
    [
        ("Dev", "ITAR applies", "", True, "blocked:itar_requirement"),
        ("Dev", "active clearance needed", "", True, "blocked:security_clearance_required"),
        ("Dev", "U.S. citizens only", "", True, "blocked:us_citizen_only"),
        ("Dev", "eligible to work in the UK", "", True, "blocked:work_authorization_required"),
        ("Dev", "anywhere in Europe", "", True, "blocked:regional_restriction"),
        ("Dev (EMEA)", "", "", True, "blocked:title_region_code"),
        ("Dev (EMEA/APAC)", "", "", True, "unknown:no_location_restriction_stated"),
        ("Dev", "", "Worldwide", True, "accessible:explicit_worldwide_location"),
        ("Dev", "", "Oslo", False, "blocked:onsite_abroad"),
        ("Dev", "", "Paris", True, "blocked:location_excludes_home"),
        ("Dev", "", "", True, "unknown:no_location_restriction_stated"),
    ],
)
def test_reach(spark, title, body, location, remote, expected):
    r = enrich.reach(F.col("t"), F.col("d"), F.col("l"), F.lit(""), F.col("r"))
    assert one(spark, F.concat_ws(":", r["reason"], r["detail"]), t=title, d=body, l=location, r=remote) == expected


@pytest.mark.parametrize(
    "title, body, location, remote, language, expected",
    [
        ("Junior Python Developer", "python", "Worldwide", True, "english", "PASS"),
        ("Senior Backend Engineer", "", "Worldwide", True, "english", "TOO_SENIOR"),
        ("Dev", "Unpaid internship for all", "Worldwide", True, "english", "UNPAID"),
        ("Entwickler", "", "Worldwide", True, "german", "NON_ENGLISH"),
        ("Dev", "", "Oslo", False, "english", "NOT_REMOTE"),
        ("Dev", "", "USA", True, "english", "REGION_LOCKED"),
        ("Dev", "", "", True, "english", "NEEDS_REVIEW"),
        ("Dev", "5+ years of experience", "Worldwide", True, "english", "DEGREE_OR_EXP"),
        ("Copywriter", "", "Worldwide", True, "english", "NON_TECHNICAL"),
    ],
)
def test_hard_filter(spark, title, body, location, remote, language, expected):
    c = filters.hard_filter(F.col("t"), F.col("d"), F.col("l"), F.lit(""), F.col("r"), F.col("g"))
    assert one(spark, c, t=title, d=body, l=location, r=remote, g=language) == expected


@pytest.mark.parametrize("text, skill, expected", [("leverage it", "rag", False), ("digitize", "git", False), ("on github", "git", False), ("uses git daily", "git", True), ("visual", "sql", False), ("Next.js and React.js", "next.js", True), ("restful api", "rest-api", True)])
def test_skills(spark, text, skill, expected):
    assert one(spark, score.present(skill, F.lit(""), F.col("d"), F.array().cast("array<string>")), d=text) is expected


def test_match_score(spark):
    c = score.match_score(F.col("t"), F.col("d"), F.array(F.lit("python")), F.lit("junior"), F.lit("english"), F.lit(False), F.lit(True), F.lit("Worldwide"), F.lit(""))
    r = spark.createDataFrame([("Python developer", "django and react")], "t string, d string").select(c.alias("s")).first()["s"]
    assert r["matched"] == ["python", "django", "react"]
    assert r["skills"] == round(28 / 126 * 150, 1) and r["seniority"] == 30 and r["remote"] == 15
    assert r["final"] == r["skills"] + 45 and r["flags"] == []
    worst = score.match_score(F.lit("test"), F.lit(""), F.array().cast("array<string>"), F.lit("senior"), F.lit("german"), F.lit(True), F.lit(False), F.lit(""), F.lit(""))
    w = spark.range(1).select(worst.alias("s")).first()["s"]
    assert w["final"] == 0 and w["flags"] == ["NON_ENGLISH", "UNPAID", "INACCESSIBLE", "SENIOR", "PLACEHOLDER", "NO_TECH_SIGNAL"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("You must pay first to start the work on this long listing with many words in it okay", ["pay first"]),
        ("No upfront payment is asked of you at any time in this long listing with many words", []),
        ("Pay first is not required for this job that is described at length in many words here", []),
        ("We ask for a security deposit, no experience needed, and more words follow in this text", ["security deposit"]),
        ("", []),
    ],
)
def test_upfront(spark, text, expected):
    assert one(spark, risk.upfront(F.col("d")), d=text) == expected


def test_risk_and_money(spark):
    assert one(spark, risk.risk(F.col("d"), F.lit("unpaid"))["flags"], d="easy money") == ["vague_description", "unpaid_test"]
    assert [tuple(x) for x in one(spark, T.money(F.col("d")), d="$80k or 1,200.50 EUR, £5")] == [(80.0, "USD"), (1200.5, "EUR"), (5.0, "GBP")]
    pay = lambda s, **k: one(spark, risk.compensation(F.col("d"), **k)["type"], d=s)
    assert [pay("bounty of $50"), pay("paid work"), pay("unpaid"), pay("no bounty here"), pay("hello"), pay("", kind="bounty")] == ["bounty", "fixed_price", "unpaid", "unknown", "unknown", "unknown"]


@pytest.mark.parametrize("text, expected", [("2024-01-02T03:04:05Z", 1704164645), ("1704164645", 1704164645), ("1704164645000", 1704164645), ("Tue, 02 Jan 2024 03:04:05 +0000", 1704164645), ("Tue, 02 Jan 2024 03:04:05 GMT", 1704164645), ("never", None), ("", None)])
def test_instant(spark, text, expected):
    assert one(spark, F.unix_timestamp(T.instant(F.col("d"))), d=text) == expected


def test_text_functions(spark):
    assert one(spark, T.unscramble(F.col("d")), d="cafÃ© donâ€™t") == "café don’t"
    assert one(spark, T.unscramble(F.col("d")), d="déjà vu") == "déjà vu"
    assert one(spark, T.tracker_link(F.col("d")), d="see https://jobs.lever.co/x/1). or https://boards.greenhouse.io/y/2,") == "https://boards.greenhouse.io/y/2"
    assert one(spark, T.country_lock(F.col("d")), d="You Must Reside in Norway") == "Must Reside in"
    assert one(spark, T.listing_number(F.col("d")), d="https://a/b/engineer-12345/") == "12345"
    assert one(spark, T.repo_of(F.col("d")), d="https://x/repos/own/name/") == "own/name"
    assert one(spark, T.issue_title(F.col("d")), d="[BUG] Fix 0x1f crash 12!") == "fix crash"
    a, b = T.fingerprint(F.lit(" Dev  One "), F.lit("ACME"), F.lit(True)), T.fingerprint(F.lit("dev one"), F.lit("acme"), F.lit(True))
    assert one(spark, (a == b) & (a != T.fingerprint(F.lit("dev one"), F.lit("acme"), F.lit(True), F.lit("bounty"))), d="") is True


def test_opportunities_and_triage(spark):
    long = "Build a django and react page. " * 5
    label = lambda kind, d: one(spark, score.opportunity(kind, F.lit("Task"), F.col("d"), F.array().cast("array<string>"))["label"], d=d)
    assert [label("freelance", long), label("freelance", "short"), label("freelance", long + " enterprise"), label("bounty", long), label("open_source", long)] == ["good_fit", "insufficient_information", "too_complex", "doable", "unpaid_portfolio_value"]
    t = lambda a, b: spark.createDataFrame([(a, b)], "a double, b double").select(score.triage(F.col("a"), F.col("b"))).first()[0]
    assert [t(60.0, 70.0), t(20.0, 20.0), t(90.0, 30.0), t(50.0, 50.0), t(50.0, None), t(10.0, -1.0)] == ["STRONG_CAND", "OBVIOUS_BAD", "CONFLICT", "UNCERTAIN", "UNCERTAIN", "OBVIOUS_BAD"]
    answers = score.combine_answers({k: F.lit(4.0) for k in "abcd"}, {"bad": F.lit(0.9)}, F.lit(0.0), F.lit(0.6), penalties={"bad": 15})
    r = spark.range(1).select(answers.alias("a")).first()["a"]
    assert (r["score"], r["warnings"], r["needs_review"]) == (85.0, ["bad"], True)


NOW = dt.datetime(2024, 1, 10, 12)
ISSUE = dict(
    title="Fix the parser module", body="Please fix the parse function in module x; steps to reproduce are in the file below and the expected result too.", state="open", closed_at=None, labels=["help wanted"], author="ann", association="NONE", assignees=[],
    linked_prs=[], comments=1, created_at=dt.datetime(2024, 1, 9), updated_at=dt.datetime(2024, 1, 9), repo="org/lib", archived=False, size_kb=900, owner="org", contributor_count=9, outside_merged=4, owner_share=0.1, parent_title=None, similar_titles=0, author_recent=0, template_group=1,
)
ISSUE_SCHEMA = (
    "title string, body string, state string, closed_at timestamp, labels array<string>, author string, association string, assignees array<string>, linked_prs array<struct<author_login:string,created_at:timestamp>>, comments int, created_at timestamp, "
    "updated_at timestamp, repo string, archived boolean, size_kb int, owner string, contributor_count int, outside_merged int, owner_share double, parent_title string, similar_titles int, author_recent int, template_group int"
)


@pytest.mark.parametrize(
    "change, reasons, verdict",
    [
        ({}, [], "accept"),
        (dict(state="closed"), ["CLOSED", "TAKEN"], "reject"),
        (dict(assignees=["ann"]), ["TAKEN", "SELF_ASSIGNED"], "reject"),
        (dict(linked_prs=[("bob", dt.datetime(2024, 1, 9, 0, 20))]), ["SELF_FIXED"], "reject"),
        (dict(author="org", association="OWNER", labels=[], outside_merged=0, contributor_count=1), ["OWNER_BACKLOG"], "reject"),
        (dict(title="Fix the parser for our team", labels=[]), ["INTERNAL_TEAM_TASK"], "reject"),
        (dict(similar_titles=3), ["CLONE_FARM"], "reject"),
        (dict(updated_at=None), ["STALE"], "reject"),
        (dict(body=""), ["NO_TASK"], "reject"),
        (dict(labels=["a", "b", "c", "d", "e", "f"]), ["LABEL_STUFFING"], "reject"),
        (dict(created_at=dt.datetime(2024, 1, 10, 11, 30), labels=[]), ["NEW_ISSUE_HOLD"], "uncertain"),
        (dict(size_kb=None), [], "accept"),
        (dict(template_group=3), ["TEMPLATED_ISSUE"], "reject"),
    ],
)
def test_gate(spark, change, reasons, verdict):
    d = spark.createDataFrame([tuple((ISSUE | change).values())], ISSUE_SCHEMA)
    r = gate.evaluate(d, F.lit(NOW)).first()
    assert (r["reasons"], r["verdict"]) == (reasons, verdict), r["score"]


def test_gate_funding_and_order(spark):
    d = spark.createDataFrame([tuple((ISSUE | dict(body=ISSUE["body"] + " Funded with $200 on algora.io")).values())], ISSUE_SCHEMA)
    r = gate.evaluate(d, F.lit(NOW)).first()
    assert (r["lane"], r["funded"], r["verdict"]) == ("PAID", True, "accept")
    assert list(gate.STAGES) == ["state_and_repo", "aggregator_and_farm", "taken_and_self", "owner_and_quality", "new_issue_hold"]
    assert gate.stage_of("SELF_FIXED") == "taken_and_self" and gate.stage_of("NONE") is None


def test_repo_health_and_recheck(spark):
    repos = spark.createDataFrame([("a", NOW, False, False, True, 5, 100, 1, 4, 0.1), ("b", NOW, True, False, True, 5, 100, 1, 4, 0.1), ("c", None, False, False, False, 0, 99999, 300, 0, 1.0)], "repo string, pushed_at timestamp, is_fork boolean, is_archived boolean, has_contributing boolean, merged_prs_recent int, repo_size_kb int, open_prs int, outside_merged_prs_recent int, owner_issue_share double")
    assert [(r["passed"], r["healthy"], r["watchlist"]) for r in gate.repo_health(repos, F.lit(NOW)).orderBy("repo").collect()] == [(7, True, True), (6, False, False), (2, False, False)]
    issues = spark.createDataFrame([("r", i, "ann", NOW, "open", None, a, False, s) for i, a, s in [(1, [], "ok"), (2, ["ann"], "ok"), (3, ["bob"], "ok"), (4, [], "timeout"), (5, [], "ok"), (6, [], "ok")]], "repo string, number int, author string, created_at timestamp, state string, closed_at timestamp, assignees array<string>, archived boolean, status string")
    events = spark.createDataFrame([("r", 5, "cross-referenced", None, None, None, "ann", NOW + dt.timedelta(days=3)), ("r", 6, "commented", "org", "MEMBER", "I'll take this", None, NOW)], "repo string, number int, event string, actor string, author_association string, body string, pr_author string, created_at timestamp")
    got = {r["number"]: r["reasons"] for r in gate.recheck(issues, events).collect()}
    assert got == {1: [], 2: ["SELF_ASSIGNED"], 3: ["TAKEN"], 4: ["UNVERIFIED"], 5: ["TAKEN", "SELF_FIXED"], 6: ["TAKEN"]}


def test_merges(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, t string")
    new = spark.createDataFrame([("a", 9, None), ("c", 3, "z")], "k string, v int, t string")
    got = sorted(map(tuple, merge.upsert(old, new, ["k"], ["v"], ["t"]).collect()))
    assert got == [("a", 9, "x"), ("b", 2, "y"), ("c", 3, "z")]
    assert sorted(r["k"] for r in merge.insert_ignore(old, new, ["k"]).collect()) == ["a", "b", "c"]
    assert sorted((r["k"], r["status"]) for r in merge.change_ledger(old, new, ["k"], ["v"]).collect()) == [("a", "changed"), ("c", "inserted")]
    batch = spark.createDataFrame([("a", 1, 5, "p"), ("a", 2, 6, None)], "k string, o int, v int, t string")
    assert tuple(merge.collapse_batch(batch, ["k"], "o", ["v"], ["t"]).first()) == ("a", 6, "p")
    raw = spark.createDataFrame([("s", "1", "p", True), ("s", "2", "q", True)], "source string, external_id string, payload string, processed boolean")
    more = spark.createDataFrame([("s", "1", "new"), ("s", " ", "blank")], "source string, external_id string, payload string")
    assert sorted(map(tuple, merge.stage_raw(raw, more).collect())) == [("s", "1", "new", False), ("s", "2", "q", True)]
    good, bad = merge.quarantine(spark.createDataFrame([("1",), ("x",), (None,)], "v string"), "v", "int")
    assert (good.count(), bad.count()) == (2, 1)


def test_relational(spark):
    d = spark.createDataFrame([(1, 5, "a"), (1, None, "b"), (2, None, "c")], "k int, t int, v string")
    assert sorted(map(tuple, relational.latest_per_key(d, ["k"], ["t"], ["v"]).collect())) == [(1, "a"), (2, "c")]
    left = spark.createDataFrame([(1, 7), (2, 8), (None, 9)], "a int, b int")
    right = spark.createDataFrame([(1, 9), (7, 8)], "x int, y int")
    got = relational.or_join(left, right, [("a", "x"), ("b", "y")])
    assert sorted((r["b"], r["y"]) for r in got.collect()) == [(7, 9), (8, 8), (9, 9)]


def test_sampling(spark):
    pool = spark.range(50).select("id", (F.col("id") % 7).alias("g"), (F.col("id") * 13 % 50).alias("s"), (F.col("id") * 7 % 50).alias("c"))
    got = sampling.strata(pool, 21, "id", "s", "c")
    assert got.count() == 21 and got.select("id").distinct().count() == 21
    assert {r["stratum"]: r["count"] for r in got.groupBy("stratum").count().collect()} == {"top": 8, "uncertain": 6, "random": 7}
    history = spark.createDataFrame([(0, 5), (1, 4)], "g long, n long")
    b = sampling.batch_with_caps(pool, 20, "id", "g", "s", history).join(pool, "id")
    counts = {r["g"]: r["count"] for r in b.groupBy("g").count().collect()}
    assert counts.get(0, 0) == 0 and counts.get(1, 0) <= 1 and max(counts.values()) <= 3
    folds = sampling.greedy_folds(pool, "g", 3)
    assert folds.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        sampling.require_no_leakage(pool.where("id < 30"), pool.where("id >= 20"), ["id"])
    sampling.require_no_leakage(pool.where("id < 30"), pool.where("id >= 30"), ["id"])


def test_metrics(spark):
    d = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.8), (3, 1, 0.8), (4, 0, 0.1)], "id int, y int, score double")
    assert tuple(metrics.precision_at(d, 2).first()) == (0.5, 0.5)
    assert metrics.roc_auc(d).first()[0] == pytest.approx(3.5 / 4)
    assert metrics.average_precision(d).first()[0] == pytest.approx((1 + 2 / 3) / 2)
    none = spark.createDataFrame([(1, 0, 0.9)], "id int, y int, score double")
    assert metrics.roc_auc(none).first()[0] is None and metrics.average_precision(none).first()[0] is None
    bins = spark.createDataFrame([(1, 1.0), (1, 0.95), (0, 0.05)], "y int, confidence double")
    assert sorted((r["bin"], r["n"]) for r in metrics.calibration_bins(bins).collect()) == [(0, 1), (9, 1)]
    assert metrics.calibration_error(bins).first()[0] == pytest.approx(0.05)
    r = metrics.confusion(d.withColumn("predicted", (F.col("score") > 0.5).cast("int"))).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (2, 1, 0, 1) and r["kappa"] == pytest.approx(0.5)
    b = metrics.bootstrap(d, trials=50).first()
    assert 0 <= b["low"] <= b["mean"] <= b["high"] <= 1


def test_sections(spark):
    text = "We make tools.\nREQUIREMENTS\nPython and SQL.\nGit.\nNice to Have\nRust.\nBenefits:\nTea."
    s = one(spark, sections.sections(F.col("d")), d=text)
    assert s["company_blurb"] == "We make tools." and "Python and SQL." in s["requirements"] and "Rust." in s["nice_to_have"] and "Tea." in s["benefits"]
    assert one(spark, sections.sections(F.col("d")), d="You must have python.\n\nWe offer tea and more.") == {"requirements": "You must have python.", "benefits": "We offer tea and more."}
    assert one(spark, sections.sections(F.col("d")), d="") == {} and one(spark, sections.sections(F.col("d")), d=None) == {}
    fitted = spark.range(1).select(sections.fit_budget({"a": F.lit("x " * 10), "b": F.lit("y " * 40), "c": F.lit("z")}, 30).alias("f")).first()["f"]
    assert fitted["a"] == " ".join("x" * 10) and fitted["b"].endswith("[...]") and fitted["c"] == ""


def test_models(spark):
    rows = [(i, w + " role", float(w in ("engineer", "developer"))) for i, w in enumerate(["engineer", "developer", "writer", "nurse"] * 6)]
    d = spark.createDataFrame(rows, "id int, title string, y double").withColumn("fold", F.col("id") % 2)
    got = models.evaluate(d, ["title_keyword_rule", "char_ngram_title", "composite_rule_title"], k=6)
    assert all(g["p_at_k"] == 1 and g["roc_auc"] == 1 for g in got)
    assert models.promoted({"roc_auc": 0.8}, {"roc_auc": 0.9}, 0.75) and not models.promoted({"roc_auc": 0.88}, {"roc_auc": 0.9}, 0.75)


def test_advice_and_config(spark, tmp_path):
    from sievework.operators import advise
    from sievework.sources import config

    r = spark.range(1).select(advise.advise(F.lit("onsite"), F.array(F.lit("US only")), F.lit("citizen"), F.lit("Lead"), F.lit(5.0), F.lit(True)).alias("a")).first()["a"]
    assert (r["accessible"], r["flags"], r["codes"], r["seniority"], r["degree"]) == (False, ["ONSITE_LOCATION", "US_LOCKED", "WORK_AUTH_BARRIER"], ["NOT_REMOTE", "REGION_LOCKED", "TOO_SENIOR", "DEGREE_OR_EXP"], "too_senior", "degree_mandatory")
    r = spark.range(1).select(advise.advise(F.lit("remote"), F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit("junior"), F.lit(None).cast("double"), F.lit(None).cast("boolean")).alias("a")).first()["a"]
    assert (r["accessible"], r["codes"], r["experience"]) == (True, [], "unknown")
    (tmp_path / "g.json").write_text('{"accept": 80, "platforms": ["x.io"]}')
    g = config.gate_config(config.load(str(tmp_path / "g.json")))
    assert (g.accept, g.platforms, len(config.version(str(tmp_path / "g.json")))) == (80, ("x.io",), 12)
    with pytest.raises(ValueError):
        config.gate_config({"odd": 1})
    assert advise.regressions([{"scorer": "a", "roc_auc": 0.9}], [{"scorer": "a", "roc_auc": 0.8}]) == ["a"]


def test_streaming_upsert(spark, tmp_path):
    from sievework.streaming import flows

    spark.createDataFrame([("a", 1, 5, "p"), ("b", 2, 6, None)], "k string, o int, v int, t string").write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new, or one more file
        flows.upsert_stream(flows.read_files(spark, f"{tmp_path}/in"), f"{tmp_path}/table", ["k"], ["v"], ["t"], "o")
        spark.createDataFrame([("a", 3, 7, None)], "k string, o int, v int, t string").write.mode("append").parquet(f"{tmp_path}/in")
    got = spark.read.parquet(f"{tmp_path}/table/v=1")
    assert sorted(map(tuple, got.select("k", "v", "t").collect())) == [("a", 7, "p"), ("b", 6, None)]


def test_words_of_a_language_are_cut_as_asked(spark):
    from sievework.plans import listings

    said = {"t": "", "d": "Zuß. Zuß. Zuß. 5zu zu_ œzu"}  # ß is a letter by default; the queries' SQL parts words there
    assert one(spark, enrich.language(F.col("t"), F.col("d")), **said) == "english"
    assert one(spark, enrich.language(F.col("t"), F.col("d"), listings.WORD), **said) == "german"
    assert one(spark, enrich.language(F.col("t"), F.col("d"), listings.WORD), t="", d="5zu zu_ œzu zu9") == "english"
