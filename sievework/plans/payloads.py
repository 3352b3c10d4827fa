"""Each transformer over payloads that are made of the documents and written as JSON, with SQL for the fields it gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.plans.catalogue import query
from sievework.plans.listings import _pick, _sql_pick
from sievework.plans.tables import table
from sievework.sources import postings, readers

TITLES = ("Python Developer", "  Data   Engineer ", "", "Acme: Lead: QA", "Nurse", "Übersetzer", "D" * 300, "Remote Writer")
PLACES = ("", " ", "Berlin", "remote", "USA, Canada", "Anywhere", "Home based", "Rome")
KINDS = ("", "full_time", "contract")
NAMES = ("Acme", "", "Beta GmbH", " Gamma ")
WORK = ("", "remote", "hybrid", "onsite")
BASE = 1_700_000_000


def rows(spark, sf_dir):
    """doc_id, source, t, place, kind, name, work, stamp: what payloads are made of."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("src"), *[_pick(v, s).alias(c) for c, (v, s) in {"t": (TITLES, 1), "place": (PLACES, 2), "kind": (KINDS, 3), "name": (NAMES, 5), "work": (WORK, 7)}.items()], (BASE + F.col("doc_id") * 61).alias("stamp"))


ROWS = f"(SELECT doc_id, source AS src, {_sql_pick(TITLES, 1)} AS t, {_sql_pick(PLACES, 2)} AS place, {_sql_pick(KINDS, 3)} AS kind, {_sql_pick(NAMES, 5)} AS name, {_sql_pick(WORK, 7)} AS work, {BASE} + doc_id * 61 AS stamp FROM documents)"
_OUT = ("external_id", "title", "company_name", "location_raw", "is_remote", "remote_restriction", "job_type", "tags", "apply_url", "posted", "status", "opportunity_type", "fingerprint_hash")


def or_(*cs: str) -> str:
    return "coalesce(" + ", ".join([*[f"nullif(trim({c}), '')" for c in cs[:-1]], cs[-1]]) + ")"


def cut(c: str) -> str:
    return f"trim(substr(trim({c}), 1, 255))"


def _sql(fields: dict[str, str]) -> str:
    f = {"job_type": "NULL::VARCHAR", "tags": "''", "posted": "NULL::BIGINT", "status": "NULL::VARCHAR", "opportunity_type": "'job'", "is_remote": "true"} | fields
    for c in ("title", "company_name", "location_raw", "remote_restriction"):
        f[c] = cut(f[c])
    squeeze = lambda c: f"regexp_replace(lower(trim({c})), '\\s+', ' ', 'g')"
    print_ = f"sha256(concat_ws('|', CASE WHEN opportunity_type <> 'job' THEN opportunity_type END, {squeeze('title')}, {squeeze('company_name')}, CASE WHEN is_remote THEN 'remote' ELSE 'onsite' END))"
    return f"SELECT *, {print_} AS fingerprint_hash FROM (SELECT {', '.join(f'{f[c]} AS {c}' for c in _OUT[:-1])} FROM {ROWS}) WHERE title <> ''"


def transformer(name: str, source: str, payload: dict, fields: dict[str, str]) -> None:
    """A query that writes payloads of a source (a name, or an expression for it) and normalizes them."""

    @query(f"normalize_{name}", _sql(fields))
    def run(spark, sf_dir):
        raw = rows(spark, sf_dir).select(F.expr(source if "(" in source else f"'{source}'").alias("source"), F.to_json(F.struct(*[F.expr(e).alias(k) for k, e in payload.items()])).alias("payload"))
        out = postings.normalize(raw).withColumn("tags", F.array_join("tags", ",")).withColumn("posted", F.unix_timestamp("posted_at"))
        return out.select(*_OUT)


_PLACE, _LIMIT = or_("place", "'Remote'"), or_("place", "'unspecified'")
_TEXT = "'<p>plain words</p>'"
_URL, _RFC = "concat('https://jobs.example/', doc_id)", "date_format(timestamp_seconds(stamp), 'EEE, dd MMM yyyy HH:mm:ss') || ' +0000'"
_ISO = "date_format(timestamp_seconds(stamp), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
_SQL_URL = "'https://jobs.example/' || doc_id"
_NAMED = or_("name", "'Unknown Company'")

transformer("arbeitnow", "arbeitnow", dict(slug="concat('s', doc_id)", title="t", company_name="name", location="place", remote="doc_id % 2 = 0", job_types="array(kind)", tags="array(src, '', ' x ')", description=_TEXT, url=_URL, created_at="stamp"), dict(external_id="'s' || doc_id", title=or_("t", "'Untitled Position'"), company_name=_NAMED, location_raw="place", is_remote="doc_id % 2 = 0", remote_restriction="'unspecified'", job_type="nullif(kind, '')", tags="src || ',x'", apply_url=_SQL_URL, posted="stamp"))
transformer("remotive", "remotive", dict(id="doc_id", title="t", company_name="name", candidate_required_location="place", job_type="kind", tags="array(src)", description=_TEXT, url=_URL, publication_date=_ISO), dict(external_id="CAST(doc_id AS VARCHAR)", title=or_("t", "'Untitled Position'"), company_name=_NAMED, location_raw="place", remote_restriction=_LIMIT, job_type="kind", tags="src", apply_url=_SQL_URL, posted="stamp"))
transformer("himalayas", "himalayas", dict(guid="concat('g', doc_id)", title="t", companyName="name", locationRestrictions="array(place, 'Japan')", categories="array(src)", seniority="array(kind)", employmentType="kind", excerpt="'short'", applicationLink=_URL, pubDate="stamp"), dict(external_id="'g' || doc_id", title=or_("t", "'Untitled Position'"), company_name=_NAMED, location_raw="CASE WHEN trim(place) = '' THEN 'Japan' ELSE place || ', Japan' END", remote_restriction="CASE WHEN trim(place) = '' THEN 'Japan' ELSE place || ', Japan' END", job_type="kind", tags="concat_ws(',', src, nullif(kind, ''))", apply_url=_SQL_URL, posted="stamp"))
_RAW = or_("t", "'Untitled Position'")
transformer("weworkremotely", "weworkremotely", dict(title="t", region="place", type="kind", category="src", description=_TEXT, link=_URL, guid="concat('w', doc_id)", pubDate=_RFC), dict(external_id="'w' || doc_id", title=f"CASE WHEN contains({_RAW}, ': ') THEN substr({_RAW}, strpos({_RAW}, ': ') + 2) ELSE {_RAW} END", company_name=f"CASE WHEN contains({_RAW}, ': ') THEN split_part({_RAW}, ': ', 1) ELSE 'Unknown Company' END", location_raw=_PLACE, remote_restriction=_LIMIT, job_type="kind", tags="src", apply_url=_SQL_URL, posted="stamp"))
_OK = "CASE WHEN lower(trim(place)) IN ('', 'remote') THEN {} ELSE place END"
transformer("remoteok", "remoteok", dict(id="doc_id", position="t", company="name", location="place", tags="array(src)", description=_TEXT, apply_url=_URL, date=_ISO), dict(external_id="CAST(doc_id AS VARCHAR)", title=or_("t", "'Untitled Position'"), company_name=_NAMED, location_raw=_OK.format("'Remote'"), remote_restriction=_OK.format("'unspecified'"), tags="src", apply_url=_SQL_URL, posted="stamp"))
transformer("jobicy", "jobicy", dict(id="doc_id", jobTitle="t", companyName="name", jobGeo="place", jobType="array(kind, 'x')", jobIndustry="array(src)", jobDescription=_TEXT, url=_URL, pubDate="date_format(timestamp_seconds(stamp), 'yyyy-MM-dd HH:mm:ss')"), dict(external_id="CAST(doc_id AS VARCHAR)", title=or_("t", "'Untitled Position'"), company_name=_NAMED, location_raw=_PLACE, remote_restriction=_LIMIT, job_type="coalesce(nullif(kind, ''), 'x')", tags="src", apply_url=_SQL_URL, posted="stamp"))
transformer("workingnomads", "workingnomads", dict(url=f"concat(' ', {_URL})", title="t", company_name="name", location="place", tags="concat(src, ', ,b')", description=_TEXT, pub_date=_ISO), dict(external_id=_SQL_URL, title=or_("t", "'Untitled Position'"), company_name=_NAMED, location_raw=_PLACE, remote_restriction=_LIMIT, tags="src || ',b'", apply_url=_SQL_URL, posted="stamp"))
_BOARD = lambda platform: f"named_struct('platform', '{platform}', 'company_name', name)"
_FAR = lambda c, marks: "(" + " OR ".join(f"contains(lower({c}), '{m}')" for m in marks) + ")"
_T = or_("t", "'Untitled Position'")
transformer("greenhouse", "ats:board", dict(_ats_meta=_BOARD("greenhouse"), id="doc_id", title="t", location="named_struct('name', place)", content=_TEXT, absolute_url=_URL), dict(external_id="CAST(doc_id AS VARCHAR)", title=_T, company_name=_NAMED, location_raw=_PLACE, is_remote=f"{_FAR('place', postings.REMOTE_MARKS)} OR contains(lower({_T}), 'remote')", remote_restriction=_LIMIT, job_type="'full-time'", apply_url=_SQL_URL))
_HERE = "CASE WHEN work IN ('hybrid', 'onsite') THEN upper(substr(work, 1, 1)) || substr(work, 2) END"
_REMOTE = lambda also: f"CASE WHEN work IN ('hybrid', 'onsite') THEN false WHEN work = 'remote' THEN true ELSE {also} OR {_FAR('place', postings.BOARD_MARKS)} OR contains(lower({_T}), 'remote') END"
_LEVER = f"CASE WHEN {_HERE} IS NULL THEN place WHEN place = '' THEN {_HERE} ELSE place || ' (' || {_HERE} || ')' END"
transformer("lever", "ats:board", dict(_ats_meta=_BOARD("lever"), id="concat('l', doc_id)", text="t", categories="named_struct('location', place)", workplaceType="work", description=_TEXT, hostedUrl=_URL), dict(external_id="'l' || doc_id", title=_T, company_name=_NAMED, location_raw=or_(_LEVER, "'Remote'"), is_remote=_REMOTE("false"), remote_restriction=or_(_LEVER, "'unspecified'"), job_type="'full-time'", apply_url=_SQL_URL))
_ASHBY = f"concat_ws(', ', nullif(trim(place), ''), CASE WHEN trim(place) <> 'Rome' THEN 'Rome' END, '(' || {_HERE} || ')')"
transformer("ashby", "ats:board", dict(_ats_meta=_BOARD("ashby"), id="concat('a', doc_id)", title="t", location="place", address="named_struct('postalAddress', named_struct('addressRegion', 'Rome'))", workplaceType="work", isRemote="doc_id % 2 = 0", descriptionHtml=_TEXT, jobUrl=_URL), dict(external_id="'a' || doc_id", title=_T, company_name=_NAMED, location_raw=_ASHBY, is_remote=_REMOTE("doc_id % 2 = 0"), remote_restriction=_ASHBY, job_type="'full-time'", apply_url=_SQL_URL))
transformer("manual", "manual:import", dict(external_id="concat('m', doc_id)", title="t", company="name", location="place", is_remote="if(doc_id % 2 = 0, 'Yes', 'no')", description="'plain words'", tags="concat(src, ', y')", job_type="kind", apply_url=_URL), dict(external_id="'m' || doc_id", title="t", company_name=or_("name", "'Unknown'"), location_raw=or_("place", "'Kathmandu, Nepal'"), is_remote="doc_id % 2 = 0", remote_restriction="CASE WHEN doc_id % 2 = 0 THEN 'unspecified' ELSE 'nepal' END", job_type=or_("kind", "'full_time'"), tags="src || ',y'", apply_url=_SQL_URL))
_PAID = "doc_id % 3 = 0 OR doc_id % 4 = 0"
transformer("github", "github", dict(id="doc_id", title="t", body="if(doc_id % 3 = 0, 'It pays $100 now.', 'Some words.')", labels="array(named_struct('name', src), named_struct('name', if(doc_id % 4 = 0, 'Bounty', 'bug')))", state="if(doc_id % 5 = 0, 'Closed', kind)", html_url=_URL, _gh_repo="'o/r'", created_at=_ISO), dict(external_id="CAST(doc_id AS VARCHAR)", title=or_("t", "'Untitled Issue'"), company_name="'o/r'", location_raw="'Remote'", remote_restriction="'worldwide'", tags="src || CASE WHEN doc_id % 4 = 0 THEN ',Bounty' ELSE ',bug' END", apply_url=_SQL_URL, posted="stamp", opportunity_type=f"CASE WHEN {_PAID} THEN 'bounty' ELSE 'open_source' END", status="CASE WHEN doc_id % 5 = 0 THEN 'closed' WHEN kind = '' THEN 'open' ELSE 'unknown' END"))
_PLAIN = dict(external_id="concat('p', doc_id)", title="t", company_name="'Acme'", location_raw="place", is_remote="doc_id % 2 = 0", remote_restriction="kind", job_type="kind", description_text="'plain words'", apply_url=_URL, tags="array(src, 'z')", opportunity_type="if(doc_id % 3 = 0, 'freelance', 'job')", status="'open'", posted_at="if(doc_id % 4 = 0, 'no date', date_format(timestamp_seconds(stamp), 'yyyy-MM-dd HH:mm:ss'))")
_PLAIN_SQL = dict(external_id="'p' || doc_id", title="t", company_name="'Acme'", location_raw="place", is_remote="doc_id % 2 = 0", remote_restriction="kind", job_type="kind", tags="src || ',z'", apply_url=_SQL_URL, opportunity_type="CASE WHEN doc_id % 3 = 0 THEN 'freelance' ELSE 'job' END", status="'open'", posted="CASE WHEN doc_id % 4 <> 0 THEN stamp END")
transformer("pre_normalized", "if(doc_id % 2 = 0, 'python_org', 'reddit')", _PLAIN, _PLAIN_SQL)

_HEADS = ("Acme (YC) | Senior Engineer | REMOTE (Worldwide) | $100k-120k | https://acme.io", "Beta | Austin, TX | Full-time", "Just a long comment without any header at all", "Gamma | QA Analyst | Berlin | onsite", "Delta | Remote | Data Scientist | hello")
_HN = {"company_name": ("Acme", "Beta", "Unknown Company", "Gamma", "Delta"), "title": ("Senior Engineer", "Hacker News Role", "Hacker News Role", "QA Analyst", "Data Scientist"), "location_raw": ("REMOTE (Worldwide)", "Austin, TX", "Unspecified", "Berlin", "Remote"), "remote_restriction": ("Worldwide", "unspecified", "unspecified", "unspecified", "unspecified")}


@query("normalize_hackernews", f"SELECT CAST(doc_id AS VARCHAR) AS external_id, {', '.join(f'{_sql_pick(v, 1)} AS {c}' for c, v in _HN.items())}, doc_id % 5 IN (0, 4) AS is_remote, doc_id % 5 IN (1, 2) AS excluded, {BASE} + doc_id * 61 AS posted FROM documents")
def normalize_hackernews(spark, sf_dir):
    made = rows(spark, sf_dir).select("doc_id", "stamp", F.concat(_pick(_HEADS, 1), F.lit("<p>We build things and pay well.")).alias("text"))
    raw = made.select(F.lit("hackernews").alias("source"), F.to_json(F.struct(F.col("doc_id").alias("id"), "text", F.col("stamp").alias("time"))).alias("payload"))
    return postings.normalize(raw).select("external_id", *_HN, "is_remote", F.col("exclude_reason").isNotNull().alias("excluded"), F.unix_timestamp("posted_at").alias("posted"))


@query("unknown_sources", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def unknown_sources(spark, sf_dir):
    return postings.unknown_sources(table(spark, sf_dir, "documents").select("source", F.lit("{}").alias("payload")))


def _kept(name: str, payload: dict, key: str, keep: str) -> None:
    """A query of the rows that a source's reader keeps, and their ids."""

    @query(f"read_{name}", f"SELECT {key} AS external_id FROM {ROWS} WHERE {keep}")
    def run(spark, sf_dir):
        s = readers.SOURCES[name]
        made = rows(spark, sf_dir).select(F.to_json(F.struct(*[F.expr(e).alias(k) for k, e in payload.items()])).alias("payload"))
        return made.where(s.keep()).select(s.id().alias("external_id"))


_kept("himalayas", dict(guid="concat('g', doc_id)", locationRestrictions="if(doc_id % 3 = 0, cast(array() as array<string>), array(place, if(doc_id % 5 = 0, ' Asia', 'Japan')))"), "'g' || doc_id", "doc_id % 3 = 0 OR doc_id % 5 = 0 OR place = 'Anywhere'")
_kept("jobicy", dict(id="doc_id", jobGeo="concat(place, if(doc_id % 3 = 0, ', Worldwide', ''))"), "CAST(doc_id AS VARCHAR)", "trim(place) = '' OR place IN ('remote', 'Anywhere')")
_kept("remoteok", dict(id="if(doc_id % 2 = 0, doc_id, null)", position="if(doc_id % 3 = 0, t, null)", legal="if(doc_id % 5 = 0, 'x', null)", slug="concat('s', doc_id)"), "CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 's' || doc_id END", "doc_id % 3 = 0 OR (doc_id % 2 = 0 AND doc_id % 5 <> 0)")
_kept("hackernews", dict(id="doc_id", text="if(doc_id % 7 = 0, '', t)", deleted="doc_id % 3 = 0", dead="doc_id % 5 = 0"), "CAST(doc_id AS VARCHAR)", "doc_id % 7 <> 0 AND t <> '' AND doc_id % 3 <> 0 AND doc_id % 5 <> 0")
_POSTS = ("[Hiring] a developer", "[For Hire] me", "Task done", "Paid project, remote", "hiring: looking for work too", "[TASK] fix")
_kept("reddit", dict(data="named_struct('id', concat('r', doc_id), 'title', element_at(array({}), cast(doc_id % 6 + 1 as int)))".format(", ".join(f"'{p}'" for p in _POSTS))), "'r' || doc_id", "doc_id % 6 IN (0, 3, 5)")
