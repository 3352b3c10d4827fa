"""Queries for the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions.html import clean_html
from sievework.plans.catalogue import query
from sievework.plans.tables import TITLE, events, table, title


@query("scan_project_payload", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'click' OR value > 50")
def scan_project_payload(spark, sf_dir):
    return events(spark, sf_dir).where("event_type = 'click' OR value > 50").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("html_clean_regex", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_clean_regex(spark, sf_dir):
    stripped = F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"\s+", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(stripped).alias("text"))


@query("html_clean_full")
def html_clean_full(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", clean_html(F.col("html")).alias("text"))


@query("title_split_colon", "SELECT doc_id, CASE WHEN contains(t, ' ') THEN split_part(t, ' ', 1) ELSE 'Unknown Company' END AS company, CASE WHEN contains(t, ' ') THEN substr(t, instr(t, ' ') + 1) ELSE t END AS title FROM (SELECT doc_id, " + TITLE + " AS t FROM documents)")
def title_split_colon(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", title().alias("t"))
    parts = F.split("t", " ", 2)
    two = F.size(parts) == 2
    return d.select("doc_id", F.when(two, parts[0]).otherwise("Unknown Company").alias("company"), F.when(two, parts[1]).otherwise(F.col("t")).alias("title"))


@query(
    "url_listing_id",
    r"SELECT page_id, seg, regexp_replace(seg, '^.*-([0-9]+)$', '\1') AS listing FROM (SELECT page_id, list_last(string_split(regexp_replace(url, '/+$', ''), '/')) AS seg FROM pages)",
)
def url_listing_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.last_segment(F.col("url")).alias("seg"), T.listing_key(F.col("url")).alias("listing"))


@query("slug_key", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slug_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


_NORM = "lower(" + TITLE + ")"
for _p in (r"^\s*(?:\[[^\]]*\]|\([^)]*\)|[a-z]+\s*:)\s*", r"\b0x[0-9a-f]+\b|\b[0-9a-f]{7,}\b"):
    _NORM = f"regexp_replace({_NORM}, '{_p}', ' ', 'g')"
_NORM = f"trim(regexp_replace(regexp_replace(regexp_replace({_NORM}, '[0-9]+', ' ', 'g'), '[^a-zà-ÿ]+', ' ', 'g'), ' +', ' ', 'g'))"


@query("issue_title_norm", f"SELECT doc_id, {_NORM} AS norm FROM documents")
def issue_title_norm(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.issue_title(title()).alias("norm"))


_PRICED = "p_name || ' for $' || CAST(p_size AS VARCHAR) || ' or ' || CAST(p_size * 10 AS VARCHAR) || ' EUR'"


@query(
    "money_extract",
    f"""SELECT p_partkey, CAST(len(m) AS INTEGER) AS n, CAST(replace(regexp_extract(m[1], '[0-9][0-9,]*'), ',', '') AS DOUBLE) AS first_amount,
    CASE WHEN m[1] LIKE '$%' THEN 'USD' ELSE upper(right(m[1], 3)) END AS first_currency
    FROM (SELECT p_partkey, regexp_extract_all({_PRICED}, '[$€£₹]\\s*\\d[\\d,]*(?:\\.\\d{{1,2}})?|\\d[\\d,]*(?:\\.\\d{{1,2}})?\\s*[kK]?\\s*(?:USD|EUR|GBP|INR)') AS m FROM part)""",
)
def money_extract(spark, sf_dir):
    priced = F.concat(F.col("p_name"), F.lit(" for $"), F.col("p_size").cast("string"), F.lit(" or "), (F.col("p_size") * 10).cast("string"), F.lit(" EUR"))
    d = table(spark, sf_dir, "part").select("p_partkey", T.money(priced).alias("m"))
    return d.select("p_partkey", F.size("m").alias("n"), F.col("m")[0]["amount"].alias("first_amount"), F.col("m")[0]["currency"].alias("first_currency"))


@query("salary_max", "SELECT p_partkey, CAST(coalesce(list_max(list_transform(regexp_extract_all(p_name || ' ' || CAST(p_size AS VARCHAR) || ',000', '[0-9][0-9,]*'), lambda x: CAST(replace(x, ',', '') AS BIGINT))), 0) AS BIGINT) AS top FROM part")
def salary_max(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.salary_top(F.concat_ws(" ", "p_name", F.concat(F.col("p_size").cast("string"), F.lit(",000")))).alias("top"))


@query(
    "fingerprint_dedup",
    f"""SELECT fp, CAST(min(doc_id) AS BIGINT) AS doc_id, count(*) AS n FROM (SELECT doc_id, sha256(concat_ws('|', regexp_replace(lower(trim({TITLE}, ' ')), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), lower(source), CASE WHEN doc_id % 3 <> 0 THEN 'remote' ELSE 'onsite' END)) AS fp FROM documents) GROUP BY fp""",
)
def fingerprint_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.fingerprint(title(), F.col("source"), F.col("doc_id") % 3 != 0).alias("fp")).groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(
    "email_extract",
    r"""SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda x: NOT contains(lower(x), 'noreply') AND NOT contains(lower(x), 'no-reply'))[1] AS email
    FROM documents WHERE contains(text, '@')""",
)
def email_extract(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))
    kept = F.filter(found, lambda x: ~T.contains_any(F.lower(x), ("noreply", "no-reply")))
    return table(spark, sf_dir, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", F.try_element_at(kept, F.lit(1)).alias("email"))


@query("snippet_200", r"SELECT doc_id, trim(regexp_replace(substr(text, 1, 200), '[ \t\n\r\f\v]+', ' ', 'g')) AS snippet FROM documents")
def snippet_200(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("company_norm", "SELECT DISTINCT source, CASE WHEN lower(trim(source)) IN ('unknown', 'n/a', 'none', 'na', 'null', '') THEN '' ELSE lower(trim(source)) END AS company FROM documents")
def company_norm(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", T.company(F.col("source")).alias("company"))


@query("job_type_class", "SELECT o_orderkey, CASE WHEN lower(o_orderpriority) LIKE '%low%' THEN 'part_time' WHEN lower(o_orderpriority) LIKE '%urgent%' THEN 'full_time' ELSE 'other' END AS kind FROM orders")
def job_type_class(spark, sf_dir):
    said = F.lower("o_orderpriority")
    worded = F.when(said.contains("low"), "Part-time").when(said.contains("urgent"), "Full time").otherwise(said)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.job_type(worded).alias("kind"))


@query("timestamp_parse", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS from_iso, CAST(floor(epoch(ts)) AS BIGINT) AS from_epoch FROM events")
def timestamp_parse(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    iso, epoch = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.unix_timestamp("ts").cast("string")
    return e.select("event_id", F.unix_timestamp(T.instant(iso)).alias("from_iso"), F.unix_timestamp(T.instant(epoch)).alias("from_epoch"))


@query("json_mean", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS mean FROM events")
def json_mean(spark, sf_dir):
    values = F.map_values(F.from_json("props", "map<string,double>"))
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
    return events(spark, sf_dir).select("event_id", mean.alias("mean"))
