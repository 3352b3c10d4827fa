"""One captured payload for each source, and the readers."""

import json

from pyspark.sql import functions as F

from sievework.functions.html import readable
from sievework.sources import postings, readers


def normalized(spark, source, payload):
    return postings.normalize(spark.createDataFrame([(source, json.dumps(payload))], "source string, payload string")).first()


def test_simple_sources(spark):
    r = normalized(spark, "arbeitnow", dict(slug="s1", title="Dev", company_name="Acme", location="Rome", remote=True, tags=["a", ""], job_types=["full"], description="<p>Hi&amp;you</p>", url="https://x/1", created_at=1704164645))
    assert (r["external_id"], r["remote_restriction"], r["job_type"], r["description_text"], r["tags"], r["is_remote"]) == ("s1", "unspecified", "full", "Hi&you", ["a"], True)
    r = normalized(spark, "remotive", dict(id=7, title="Dev", company_name="Acme", candidate_required_location=" ", publication_date="2024-01-02T03:04:05"))
    assert (r["external_id"], r["is_remote"], r["remote_restriction"], str(r["posted_at"])) == ("7", True, "unspecified", "2024-01-02 03:04:05")
    r = normalized(spark, "himalayas", dict(guid="g", title="Dev", companyName="A", locationRestrictions=["India", "Japan"], categories=["x"], seniority=["y"], excerpt="short"))
    assert (r["location_raw"], r["tags"], r["description_text"]) == ("India, Japan", ["x", "y"], "short")
    r = normalized(spark, "weworkremotely", dict(title="Acme: Lead: Dev", link="https://l", pubDate="Tue, 02 Jan 2024 03:04:05 +0000"))
    assert (r["company_name"], r["title"], r["external_id"], r["location_raw"]) == ("Acme", "Lead: Dev", "https://l", "Remote")
    r = normalized(spark, "remoteok", dict(id="5", position="Dev", company="A", location="remote", apply_url="https://a"))
    assert (r["location_raw"], r["remote_restriction"]) == ("Remote", "unspecified")
    r = normalized(spark, "jobicy", dict(id=3, jobTitle="Dev", companyName="A", jobGeo="USA", jobType=["full-time"], jobIndustry="IT"))
    assert (r["location_raw"], r["job_type"], r["tags"]) == ("USA", "full-time", ["IT"])
    r = normalized(spark, "workingnomads", dict(url="https://u", title="Dev", tags="a, b,,c", location=""))
    assert (r["tags"], r["remote_restriction"]) == (["a", "b", "c"], "unspecified")


def test_thread_headers(spark):
    r = normalized(spark, "hackernews", dict(id=9, text="Acme (YC) | Senior Engineer | REMOTE (Worldwide) | $100k-120k | https://acme.io<p>We build. <a href=\"https:&#x2F;&#x2F;acme.io&#x2F;jobs\">x</a>", time=1704164645))
    assert (r["company_name"], r["title"], r["is_remote"], r["remote_restriction"], r["exclude_reason"]) == ("Acme", "Senior Engineer", True, "Worldwide", None)
    r = normalized(spark, "hackernews", dict(id=10, text="Just a long comment without any header at all"))
    assert (r["title"], r["exclude_reason"], r["company_name"], r["location_raw"]) == (postings.ROLE_UNKNOWN, "unparseable_title", "Unknown Company", "Unspecified")
    r = normalized(spark, "hackernews", dict(id=11, text="Acme | Austin, TX | Full-time<p>onsite work"))
    assert (r["title"], r["location_raw"], r["is_remote"]) == (postings.ROLE_UNKNOWN, "Austin, TX", False)


def test_boards(spark):
    meta = lambda p: dict(platform=p, company_name="Acme")
    r = normalized(spark, "ats:acme", dict(_ats_meta=meta("greenhouse"), id=1, title="Dev", location=dict(name="Home based"), content="&lt;p&gt;Hi&lt;/p&gt;", absolute_url="https://boards.greenhouse.io/a/1"))
    assert (r["is_remote"], r["description_text"], r["company_name"]) == (True, "Hi", "Acme")
    r = normalized(spark, "ats:acme", dict(_ats_meta=meta("lever"), id="2", text="Dev", categories=dict(location="Rome"), workplaceType="hybrid", description="x"))
    assert (r["location_raw"], r["is_remote"]) == ("Rome (Hybrid)", False)
    r = normalized(spark, "ats:acme", dict(_ats_meta=meta("ashby"), id="3", title="Dev", location="Rome", address=dict(postalAddress=dict(addressRegion="Lazio", addressCountry="Italy")), isRemote=True, descriptionPlain="plain"))
    assert (r["location_raw"], r["is_remote"], r["description_text"]) == ("Rome, Lazio, Italy", True, "plain")


def test_other_sources(spark):
    r = normalized(spark, "manual:x", dict(title="Dev", company="A", tags="p, q"))
    assert r["external_id"].startswith("manual_") and (r["remote_restriction"], r["tags"], r["location_raw"]) == ("nepal", ["p", "q"], "Kathmandu, Nepal")
    r = normalized(spark, "github", dict(id=4, title="Fix", body="pays $100", labels=[dict(name="bug")], state="open", html_url="https://h", _gh_repo="o/r"))
    assert (r["opportunity_type"], float(r["budget_min"]), r["company_name"], r["tags"]) == ("bounty", 100.0, "o/r", ["bug"])
    r = normalized(spark, "reddit", dict(external_id="e", title="Task", posted_at="not a date", description_text="d"))
    assert (r["posted_at"], r["description_text"]) == (None, "d")
    assert normalized(spark, "python_org", dict(title=" ")) is None
    r = normalized(spark, "remotive", dict(id=1, title="D" * 400, description="You must be located in Norway. Apply: https://jobs.lever.co/a/b.", url="https://x"))
    assert len(r["title"]) == 255 and r["remote_restriction"].startswith("locked: must be located in") and r["apply_url"] == "https://jobs.lever.co/a/b"
    raw = spark.createDataFrame([("odd", "{}")], "source string, payload string")
    assert postings.normalize(raw).count() == 0 and postings.unknown_sources(raw).first()["n"] == 1


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"jobs": [dict(guid="1", locationRestrictions=[]), dict(guid="2", locationRestrictions=["Japan"]), dict(guid="3", locationRestrictions=["Asia"])]}))
    assert sorted(r["external_id"] for r in readers.read_json(spark, str(tmp_path / "a.json"), "himalayas").collect()) == ["1", "3"]
    (tmp_path / "b.json").write_text(json.dumps([dict(legal="notice"), dict(id="7", position="Dev")]))
    assert [r["external_id"] for r in readers.read_json(spark, str(tmp_path / "b.json"), "remoteok").collect()] == ["7"]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A: B</title><link>https://l</link></item></channel></rss>")
    rss = readers.read_rss(spark, str(tmp_path / "f.xml"), "weworkremotely")
    assert postings.normalize(rss).first()["title"] == "B"
    (tmp_path / "m.csv").write_text('title,company,is_remote,tags\nDev,A,Yes,"x, y"\n')
    r = postings.normalize(readers.read_manual_csv(spark, str(tmp_path / "m.csv"))).first()
    assert (r["is_remote"], r["tags"]) == (True, ["x", "y"])
    (tmp_path / "l.csv").write_bytes("﻿id,label\n1,café\n".encode("utf-8"))
    assert tuple(readers.read_labels_csv(spark, str(tmp_path / "l.csv")).first()) == ("1", "café")
    (tmp_path / "w.csv").write_bytes("id,label\n1,café\n".encode("cp1252"))
    assert tuple(readers.read_labels_csv(spark, str(tmp_path / "w.csv")).first()) == ("1", "café")
    assert len(readers.write_with_digest(spark.range(3).select(F.col("id")), str(tmp_path / "o"))) == 64


def test_readable():
    assert readable("&lt;p&gt;a  b&lt;/p&gt;<script>x</script>") == "a b"
    assert readable(None) == "" and readable("1 < 2") == "1 < 2"
