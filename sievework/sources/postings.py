"""Payloads to normalized postings: one projection for each source, all of one schema, in one union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.html import clean_html
from sievework.functions.text import blank, contains_any, country_lock, cut, fingerprint, has, instant, rx, tracker_link
from sievework.operators.risk import compensation
from sievework.sources.readers import at

#: Marks of a remote place, and the patterns of a thread's header parts.
REMOTE_MARKS = ("remote", "anywhere", "virtual", "distributed", "worldwide", "global", "home based", "home-based", "homebased")
BOARD_MARKS = ("remote", "anywhere", "global", "worldwide", "home based", "home-based")
URL_OR_MAIL = r"^https?://|[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+|\.(?:com|org|net|io|ai|tech|co|app|dev|me)(?:/|$)"
PAY_PART = (
    r"[$€£¥]|\b(?:salary|equity|equity\s*\+?\s*salary|salary\s*\+?\s*equity|equity\s+only|doe|d\.o\.e\.|competitive\s+compensation|negotiable)\b"
    r"|\b\d+k\s*[-–/]\s*\d+k\b|\b\d+[-–]\d+k\b|\b\d+\s*k\s*(?:usd|eur|gbp|/year|/yr)\b"
)
WORK_PART = r"^(?:remote|onsite|hybrid|full[- ]?time|part[- ]?time|contract|contractor|freelance|internship|intern|visa|visa\s+sponsorship)$"
PLACE_PART = (
    r"\b(?:san francisco|sf|bay area|new york|nyc|london|berlin|toronto|austin|seattle|boston|zurich|amsterdam|paris|tokyo|chicago|los angeles|vancouver|montreal)\b"
    r"|,\s*(?:[A-Z]{2}\b|ontario|quebec|bc|alberta)|\b(?:usa|us|uk|united states|united kingdom|canada|germany|france|netherlands|switzerland|australia|spain|ireland|poland|austria)\b"
    r"|\b(?:cet|cest|est|edt|pst|pdt|cst|cdt|gmt|utc)(?:\s*[±+-]\s*\d+)?\b|\btime\s*zones?\b|\bhours\b|\b(?:remote|onsite|hybrid)\s*\([^)]+\)"
)
ROLE_PART = r"\b(?:engineer|developer|programmer|architect|scientist|lead|manager|director|head of|vp|designer|specialist|analyst|cto|founder|co-founder|evaluator|sourcer|fellow)\b"
NO_TITLE = (
    r"\b(?:GMT|UTC)[-+]?\d+",
    r"^\s*(?:remote|onsite|hybrid|unspecified|role-dependent|see below)\s*$",
    r"^\s*(?:remote\s*\(.*?\)|onsite\s+in\s+.*?|\d+\s+days\s+hybrid\s+in\s+.*?)\s*$",
    r",\s*[A-Z]{2}\b",
    r"\b(?:san francisco|new york|berlin|zurich|austin|toronto|seattle|london|tokyo|paris)\b",
    r"^\s*https?://",
    r"^\s*earth\s*$",
    r"^\s*hacker news role\s*$",
    r"^\s*multiple (?:roles|engineering)\b",
)
ROLE_UNKNOWN = "Hacker News Role"
SCHEMA = (
    "source string, external_id string, title string, company_name string, company_url string, location_raw string, is_remote boolean, remote_restriction string, "
    "job_type string, description_html string, description_text string, apply_url string, tags array<string>, posted_at timestamp, opportunity_type string, "
    "compensation_type string, budget_min decimal(12,2), budget_max decimal(12,2), budget_currency string, status string, exclude_reason string, fingerprint_hash string"
)


def _list(path: str) -> Column:
    """The strings of a JSON list, or of one string; blanks dropped."""
    raw = at(path)
    listed = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>")).when(blank(raw) != "", F.array(raw)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def _commas(path: str) -> Column:
    raw = at(path)
    parts = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>")).otherwise(F.split(blank(raw), ","))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def _or(*cs: Column | str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) if isinstance(c, Column) else F.lit(c) for c in cs])


def _true(path: str) -> Column:
    return F.lower(blank(at(path))).isin("true", "1", "yes")


def _place(text: Column, as_remote: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """(location, restriction): Remote and unspecified where the source says nothing."""
    named = F.nullif(F.trim(blank(text)), F.lit(""))
    if as_remote:
        named = F.when(~F.lower(named).isin(*as_remote), named)
    return F.coalesce(named, F.lit("Remote")), F.coalesce(named, F.lit("unspecified"))


def _arbeitnow() -> dict[str, Column]:
    return dict(external_id=_or(at("$.slug"), at("$.url"), ""), title=_or(at("$.title"), "Untitled Position"), company_name=_or(at("$.company_name"), "Unknown Company"), location_raw=at("$.location"), is_remote=_true("$.remote"), remote_restriction=F.lit("unspecified"), job_type=F.get(_list("$.job_types"), 0), description_html=at("$.description"), apply_url=blank(at("$.url")), tags=_list("$.tags"), posted_at=instant(at("$.created_at")))


def _remotive() -> dict[str, Column]:
    place = blank(at("$.candidate_required_location"))
    return dict(external_id=_or(at("$.id"), at("$.url"), ""), title=_or(at("$.title"), "Untitled Position"), company_name=_or(at("$.company_name"), "Unknown Company"), company_url=at("$.company_logo_url"), location_raw=place, is_remote=F.lit(True), remote_restriction=_or(place, "unspecified"), job_type=at("$.job_type"), description_html=at("$.description"), apply_url=blank(at("$.url")), tags=_list("$.tags"), posted_at=instant(at("$.publication_date")))


def _himalayas() -> dict[str, Column]:
    location, restriction = _place(F.array_join(_list("$.locationRestrictions"), ", "))
    return dict(external_id=_or(at("$.guid"), at("$.applicationLink"), ""), title=_or(at("$.title"), "Untitled Position"), company_name=_or(at("$.companyName"), "Unknown Company"), company_url=at("$.companyLogo"), location_raw=location, is_remote=F.lit(True), remote_restriction=restriction, job_type=at("$.employmentType"), description_html=at("$.description"), spare=at("$.excerpt"), apply_url=_or(at("$.applicationLink"), at("$.guid"), ""), tags=F.concat(_list("$.categories"), _list("$.seniority")), posted_at=instant(at("$.pubDate")))


def _weworkremotely() -> dict[str, Column]:
    raw = _or(at("$.title"), "Untitled Position")
    parts, split = F.split(raw, ": ", 2), raw.contains(": ")
    location, restriction = _place(at("$.region"))
    return dict(external_id=_or(at("$.guid._VALUE"), at("$.guid"), at("$.link"), ""), title=F.trim(F.when(split, F.get(parts, 1)).otherwise(raw)), company_name=F.trim(F.when(split, F.get(parts, 0)).otherwise("Unknown Company")), location_raw=location, is_remote=F.lit(True), remote_restriction=restriction, job_type=at("$.type"), description_html=at("$.description"), apply_url=_or(at("$.link"), at("$.guid"), ""), tags=_list("$.category"), posted_at=instant(at("$.pubDate")))


def _remoteok() -> dict[str, Column]:
    location, restriction = _place(at("$.location"), ("remote",))
    return dict(external_id=_or(at("$.id"), at("$.slug"), ""), title=_or(at("$.position"), "Untitled Position"), company_name=_or(at("$.company"), "Unknown Company"), company_url=_or(at("$.company_logo"), at("$.logo")), location_raw=location, is_remote=F.lit(True), remote_restriction=restriction, description_html=at("$.description"), apply_url=_or(at("$.apply_url"), at("$.url"), ""), tags=_list("$.tags"), posted_at=instant(_or(at("$.date"), at("$.epoch"))))


def _jobicy() -> dict[str, Column]:
    location, restriction = _place(at("$.jobGeo"))
    return dict(external_id=_or(at("$.id"), at("$.jobSlug"), ""), title=_or(at("$.jobTitle"), "Untitled Position"), company_name=_or(at("$.companyName"), "Unknown Company"), company_url=at("$.companyLogo"), location_raw=location, is_remote=F.lit(True), remote_restriction=restriction, job_type=F.get(_list("$.jobType"), 0), description_html=at("$.jobDescription"), spare=at("$.jobExcerpt"), apply_url=blank(at("$.url")), tags=_list("$.jobIndustry"), posted_at=instant(at("$.pubDate")))


def _workingnomads() -> dict[str, Column]:
    location, restriction = _place(at("$.location"))
    url = F.trim(blank(at("$.url")))
    return dict(external_id=url, title=_or(at("$.title"), "Untitled Position"), company_name=_or(at("$.company_name"), "Unknown Company"), location_raw=location, is_remote=F.lit(True), remote_restriction=restriction, description_html=at("$.description"), apply_url=url, tags=_commas("$.tags"), posted_at=instant(at("$.pub_date")))


def unparseable_title(title: Column) -> Column:
    """Does a thread title read as a place, a time zone, an address or a placeholder?"""
    t = F.trim(blank(title))
    low, role = F.lower(t), has(t, ROLE_PART)
    placed = low.startswith("remote (") | low.startswith("onsite in ") | low.contains("days hybrid in") | t.startswith("http")
    return (t == "") | low.isin("hacker news role", "earth", "remote", "see below", "equity + salary") | (has(t, *NO_TITLE) & (~role | placed)) | (~role & (t.contains(",") | t.contains("/") | (F.length(t) < 5)))


def _hackernews() -> dict[str, Column]:
    raw = blank(at("$.text"))
    first = F.when(raw.contains("<p>"), F.substring_index(raw, "<p>", 1)).otherwise(F.substring_index(raw, "\n", 1))
    header = F.trim(F.regexp_replace(F.regexp_replace(first, "<[^>]+>", " "), "&#x2F;", "/"))
    parts = F.filter(F.transform(F.split(F.translate(header, "—–•·", "||||"), r"\|"), lambda x: F.trim(x)), lambda p: p != "")
    head = F.get(parts, 0)
    clean = (F.size(parts) >= 2) & (F.length(head) <= 80) & ~contains_any(head, (". ", "? ", "! "))
    open_parts = F.filter(F.slice(parts, 2, 1000), lambda p: ~p.rlike(rx(URL_OR_MAIL)) & ~p.rlike(rx(PAY_PART)) & ~p.rlike(rx(WORK_PART)))
    roles = F.filter(open_parts, lambda p: p.rlike(rx(ROLE_PART)))
    places = F.filter(open_parts, lambda p: ~p.rlike(rx(ROLE_PART)) & p.rlike(rx(PLACE_PART)))
    others = F.filter(open_parts, lambda p: ~p.rlike(rx(ROLE_PART)) & ~p.rlike(rx(PLACE_PART)))
    named = F.trim(F.regexp_replace(F.regexp_replace(head, r"https?://[^\s)]+", ""), r"\(.*?\)", ""))
    dashed = F.trim(F.regexp_extract(header, r"^([A-Za-z0-9\s&.,'-]{2,50})\s+[-–—:]\s+", 1))
    dashed = F.when(~contains_any(F.lower(dashed), ("we are", "looking for", "hiring", "http")), dashed)
    title = F.when(clean, F.coalesce(F.try_element_at(roles, F.lit(1)), F.try_element_at(others, F.lit(1)), F.lit(ROLE_UNKNOWN))).otherwise(ROLE_UNKNOWN)
    text = F.lower(F.concat_ws(" ", header, raw))
    remote = text.contains("remote")
    limits = [F.trim(F.regexp_extract(header, p, 1)) for p in (r"(?i)remote\s*\(([^)]+)\)", r"(?i)\(([^)]*\bremote\b[^)]*)\)", r"(?i)remote\s*[-–—:]\s*([A-Za-z\s,]{2,40})")]
    limit = F.when(remote, F.coalesce(*[F.when((x != "") & (F.length(x) <= 100), x) for x in limits]))
    place = F.when(clean, F.try_element_at(places, F.lit(1)))
    otherwise = F.when(remote, F.coalesce(limit, F.lit("Remote"))).when(text.contains("onsite"), "Onsite").otherwise("Unspecified")
    decoded = F.replace(F.replace(raw, F.lit("&#x2F;"), F.lit("/")), F.lit("&amp;"), F.lit("&"))
    href = F.regexp_extract(decoded, "href=[\"'](https?://[^\"'\\s>]+)[\"']", 1)
    bare = F.regexp_extract(decoded, "(https?://[^\\s<>\"()]+)", 1)
    return dict(external_id=blank(at("$.id")), title=title, company_name=_or(F.when(clean, named).otherwise(dashed), "Unknown Company"), location_raw=F.coalesce(place, otherwise), is_remote=remote, remote_restriction=F.coalesce(limit, F.lit("unspecified")), description_html=raw, apply_url=_or(tracker_link(decoded), href, bare, F.concat(F.lit("item?id="), blank(at("$.id")))), tags=F.array(F.lit("HackerNews"), F.lit("Who is Hiring")), posted_at=instant(at("$.time")), exclude_reason=F.when(unparseable_title(title), "unparseable_title"))


def _greenhouse() -> dict[str, Column]:
    place, title = blank(F.coalesce(at("$.location.name"), at("$.location"))), _or(at("$.title"), "Untitled Position")
    return dict(external_id=blank(at("$.id")), title=title, company_name=_or(at("$._ats_meta.company_name"), at("$.company_name"), "Unknown Company"), location_raw=_or(place, "Remote"), is_remote=contains_any(F.lower(place), REMOTE_MARKS) | F.lower(title).contains("remote"), remote_restriction=_or(place, "unspecified"), job_type=F.lit("full-time"), description_html=at("$.content"), apply_url=_or(at("$.absolute_url"), at("$.url"), ""))


def _workplace(place: Column, title: Column, also: Column) -> tuple[Column, Column]:
    """(kind if hybrid or onsite, is it remote) by the workplace type, else by marks in place and title."""
    kind = F.lower(blank(at("$.workplaceType")))
    here = F.when(kind.isin("hybrid", "onsite"), F.initcap(kind))
    return here, F.when(here.isNotNull(), False).when(kind == "remote", True).otherwise(also | contains_any(F.lower(place), BOARD_MARKS) | F.lower(title).contains("remote"))


def _lever() -> dict[str, Column]:
    raw, title = blank(at("$.categories.location")), _or(at("$.text"), "Untitled Position")
    here, remote = _workplace(raw, title, F.lit(False))
    place = F.when(here.isNull(), raw).when(raw == "", here).otherwise(F.concat(raw, F.lit(" ("), here, F.lit(")")))
    return dict(external_id=blank(at("$.id")), title=title, company_name=_or(at("$._ats_meta.company_name"), "Unknown Company"), location_raw=_or(place, "Remote"), is_remote=remote, remote_restriction=_or(place, "unspecified"), job_type=F.lit("full-time"), description_html=F.concat_ws(" ", at("$.description"), at("$.additional")), spare=at("$.descriptionPlain"), apply_url=_or(at("$.hostedUrl"), at("$.applyUrl"), ""))


def _ashby() -> dict[str, Column]:
    raw, title = blank(at("$.location")), _or(at("$.title"), "Untitled Position")
    here, remote = _workplace(raw, title, _true("$.isRemote"))
    named = F.array_distinct(F.filter(F.array(F.trim(raw), F.trim(blank(at("$.address.postalAddress.addressRegion"))), F.trim(blank(at("$.address.postalAddress.addressCountry")))), lambda x: x != ""))
    place = F.array_join(F.concat(named, F.array_compact(F.array(F.when(here.isNotNull(), F.concat(F.lit("("), here, F.lit(")")))))), ", ")
    return dict(external_id=blank(at("$.id")), title=title, company_name=_or(at("$._ats_meta.company_name"), "Unknown Company"), location_raw=_or(place, "Remote"), is_remote=remote, remote_restriction=_or(place, "unspecified"), job_type=F.lit("full-time"), description_html=at("$.descriptionHtml"), spare=at("$.descriptionPlain"), apply_url=_or(at("$.jobUrl"), at("$.applyUrl"), ""))


def _manual() -> dict[str, Column]:
    title, company = F.trim(blank(at("$.title"))), _or(at("$.company_name"), at("$.company"), "Unknown")
    place = _or(at("$.location_raw"), at("$.location"), "Kathmandu, Nepal")
    made = F.concat(F.lit("manual_"), F.substring(F.sha2(F.concat_ws("_", title, company, place), 256), 1, 16))
    remote = _true("$.is_remote")
    return dict(external_id=_or(at("$.external_id"), made), title=title, company_name=company, company_url=_or(at("$.company_url")), location_raw=place, is_remote=remote, remote_restriction=_or(at("$.remote_restriction"), F.when(remote, "unspecified").otherwise("nepal")), job_type=_or(at("$.job_type"), "full_time"), description_html=F.lit(None).cast("string"), spare=_or(at("$.description_text"), at("$.description")), apply_url=_or(at("$.apply_url"), at("$.company_url"), ""), tags=_commas("$.tags"))


def _github() -> dict[str, Column]:
    body, state = blank(at("$.body")), F.lower(_or(at("$.state"), "open"))
    labels = F.coalesce(F.transform(F.from_json(at("$.labels"), "array<struct<name:string>>"), lambda x: F.trim(x["name"])), F.array().cast("array<string>"))
    labels = F.filter(labels, lambda x: blank(x) != "")
    pay = compensation(body, "bounty")
    paid = pay["type"].isin("bounty", "fixed_price") | F.arrays_overlap(F.transform(labels, F.lower), F.array(F.lit("bounty"), F.lit("reward"), F.lit("paid")))
    url = _or(at("$.html_url"), at("$.url"), "")
    return dict(external_id=_or(at("$.id"), url), title=_or(at("$.title"), "Untitled Issue"), company_name=_or(at("$._gh_repo"), "Unknown Repository"), location_raw=F.lit("Remote"), is_remote=F.lit(True), remote_restriction=F.lit("worldwide"), description_html=body, apply_url=url, tags=labels, posted_at=instant(at("$.created_at")), opportunity_type=F.when(paid, "bounty").otherwise("open_source"), compensation_type=pay["type"], budget_min=pay["min"], budget_max=pay["max"], budget_currency=pay["currency"], status=F.when(state.isin("open", "closed"), state).otherwise("unknown"))


def _normalized() -> dict[str, Column]:
    plain = {c: at(f"$.{c}") for c in ("external_id", "title", "company_name", "company_url", "location_raw", "remote_restriction", "job_type", "description_html", "apply_url", "opportunity_type", "compensation_type", "budget_min", "budget_max", "budget_currency", "status")}
    return plain | dict(spare=at("$.description_text"), is_remote=_true("$.is_remote"), tags=_list("$.tags"), posted_at=at("$.posted_at").try_cast("timestamp"))


TRANSFORMERS = {
    "arbeitnow": _arbeitnow,
    "remotive": _remotive,
    "himalayas": _himalayas,
    "weworkremotely": _weworkremotely,
    "remoteok": _remoteok,
    "jobicy": _jobicy,
    "workingnomads": _workingnomads,
    "hackernews": _hackernews,
    "greenhouse": _greenhouse,
    "lever": _lever,
    "ashby": _ashby,
    "manual": _manual,
    "github": _github,
    "python_org": _normalized,
    "reddit": _normalized,
}


def transformer_of(source: Column) -> Column:
    """Which transformer a source name asks for: ats:* by the platform in the payload, manual:* by its prefix."""
    s = F.lower(F.trim(source))
    return F.when(s.startswith("ats:"), F.lower(blank(at("$._ats_meta.platform")))).when(s.startswith("manual"), "manual").otherwise(s)


def normalize(raw: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Postings of raw rows (source, payload), in SCHEMA. Sources without a transformer are left out: see unknown_sources().

    One pass: the row's kind decides which transformer's fields are taken, and all that follows is done once. Direct
    tracking-system links replace other addresses, a country lock in the text replaces an unspecified restriction,
    long names are cut, untitled rows are dropped.
    """
    types = dict(x.split(" ", 1) for x in SCHEMA.split(", "))
    made = F.lit(None)
    for name in names or TRANSFORMERS:
        fields = TRANSFORMERS[name]()
        spare = fields.pop("spare", F.lit(None))
        cols = [fields.get(c, F.lit(None)).try_cast(t).alias(c) for c, t in types.items() if c != "source"]
        made = F.when(F.col("_kind") == name, F.struct(spare.cast("string").alias("_spare"), *cols)).otherwise(made)
    out = raw.withColumn("_kind", transformer_of(F.col("source"))).where(F.col("_kind").isin(*(names or TRANSFORMERS))).select("source", made.alias("_m")).select("source", "_m.*")
    text = clean_html(F.col("description_html"))
    out = out.withColumn("description_text", _or(text, F.col("_spare"), F.col("title"), ""))
    lock = country_lock(F.concat_ws(" ", "location_raw", "description_text"))
    link = tracker_link(F.col("description_html"), F.col("description_text"))
    direct = F.col("apply_url").rlike(r"^https?://(?:boards\.greenhouse\.io|job-boards\.greenhouse\.io|grnh\.se|jobs\.lever\.co|jobs\.ashbyhq\.com|apply\.workable\.com)/")
    out = out.withColumns(
        {
            "title": cut(F.col("title")),
            "company_name": cut(F.col("company_name")),
            "location_raw": cut(F.col("location_raw")),
            "remote_restriction": cut(F.when(lock.isNotNull() & blank(F.col("remote_restriction")).isin("", "unspecified"), F.concat(F.lit("locked: "), lock)).otherwise(F.col("remote_restriction"))),
            "apply_url": F.when((blank(F.col("apply_url")) != "") & ~direct, F.coalesce(link, F.col("apply_url"))).otherwise(F.col("apply_url")),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
            "opportunity_type": F.coalesce("opportunity_type", F.lit("job")),
        }
    ).where(blank(F.col("title")) != "")
    out = out.withColumn("fingerprint_hash", fingerprint(F.col("title"), F.col("company_name"), F.col("is_remote"), F.col("opportunity_type")))
    return out.select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items()])


def unknown_sources(raw: DataFrame) -> DataFrame:
    """source, n of rows that no transformer takes."""
    return raw.where(~transformer_of(F.col("source")).isin(*TRANSFORMERS)).groupBy("source").agg(F.count("*").alias("n"))
