"""Queries for joins, aggregates, merges, top-k, set operations and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievework.functions.text import fingerprint
from sievework.operators import merge, relational, reports
from sievework.plans.catalogue import query
from sievework.plans.tables import TITLE, WORDS, events, table, title, words


@query(
    "upsert_merge_policy",
    """WITH old AS (SELECT user_id, max_by(event_type, event_id) AS kind, max_by(value, event_id) AS value FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
    new AS (SELECT user_id, max_by(event_type, event_id) AS kind, max_by(value, event_id) FILTER (value > 50) AS value FROM events WHERE event_id % 2 = 1 GROUP BY user_id)
    SELECT coalesce(n.user_id, o.user_id) AS user_id, CASE WHEN n.user_id IS NOT NULL THEN n.kind ELSE o.kind END AS kind, coalesce(n.value, o.value) AS value FROM old o FULL JOIN new n ON o.user_id = n.user_id""",
)
def upsert_merge_policy(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", F.col("event_type").alias("kind"), "value")
    old = merge.collapse_batch(e.where("event_id % 2 = 0"), ["user_id"], "event_id", ["kind", "value"], [])
    new = merge.collapse_batch(e.where("event_id % 2 = 1").withColumn("value", F.when(F.col("value") > 50, F.col("value"))), ["user_id"], "event_id", ["kind"], ["value"])
    return merge.upsert(old, new, ["user_id"], ["kind"], ["value"])


@query(
    "insert_ignore",
    "SELECT user_id, event_type, count(*) AS n FROM (SELECT user_id, event_type FROM events WHERE event_id % 3 = 0 UNION ALL SELECT user_id, event_type FROM events e WHERE event_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id % 3 = 0 AND o.user_id = e.user_id AND o.event_type = e.event_type)) GROUP BY ALL",
)
def insert_ignore(spark, sf_dir):
    e = events(spark, sf_dir)
    both = merge.insert_ignore(e.where("event_id % 3 = 0").select("user_id", "event_type"), e.where("event_id % 3 <> 0").select("user_id", "event_type"), ["user_id", "event_type"])
    return both.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(
    "change_ledger",
    """WITH old AS (SELECT user_id, max_by(event_type, event_id) AS kind FROM events WHERE event_id % 2 = 0 GROUP BY user_id), new AS (SELECT user_id, max_by(event_type, event_id) AS kind FROM events GROUP BY user_id)
    SELECT n.user_id, CASE WHEN o.user_id IS NULL THEN 'inserted' WHEN o.kind = n.kind THEN 'unchanged' ELSE 'changed' END AS status FROM new n LEFT JOIN old o ON o.user_id = n.user_id""",
)
def change_ledger(spark, sf_dir):
    e = events(spark, sf_dir)
    latest = lambda d: d.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("kind"))
    return merge.change_ledger(latest(e.where("event_id % 2 = 0")), latest(e), ["user_id"], ["kind"]).select("user_id", "status")


@query("raw_staging", "SELECT source, external_id, payload, processed FROM (SELECT source, CAST(doc_id % 100 AS VARCHAR) AS external_id, max(doc_id) AS payload, doc_id % 2 = 0 AND false AS processed FROM documents GROUP BY source, doc_id % 100, processed)")
def raw_staging(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 100).cast("string").alias("external_id"), F.col("doc_id").alias("payload"))
    one = lambda x: x.groupBy("source", "external_id").agg(F.max("payload").alias("payload"))
    half = F.col("payload") % 2 == 0
    return merge.stage_raw(one(d.where(half)).withColumn("processed", F.lit(True)).limit(0), one(d))


@query("work_queue_unprocessed", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY doc_id LIMIT 100")
def work_queue_unprocessed(spark, sf_dir):
    return merge.unprocessed(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id", 100)


_LATEST = "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events) WHERE r = 1"


@query("latest_per_key_lateral", _LATEST)
def latest_per_key_lateral(spark, sf_dir):
    events(spark, sf_dir).createOrReplaceTempView("sievework_events")
    # not by ORDER BY and LIMIT: Spark numbers the rows of a lateral limit after the shuffle by key, which undoes their order
    return spark.sql(
        """SELECT u.user_id, l.r.* FROM (SELECT DISTINCT user_id FROM sievework_events) u
        JOIN LATERAL (SELECT max_by(struct(event_id, event_type, value), struct(ts IS NOT NULL, ts, event_id)) AS r FROM sievework_events e WHERE e.user_id <=> u.user_id) l"""
    )


@query("latest_per_key_distinct_on", _LATEST)
def latest_per_key_distinct_on(spark, sf_dir):
    return relational.latest_per_key(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "value"])


@query("anti_unlabeled", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unlabeled(spark, sf_dir):
    return relational.anti(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("semi_labeled", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_labeled(spark, sf_dir):
    return relational.semi(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").where("quality = 1"), ["doc_id"])


@query("or_join_union", "SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON o_custkey = s_suppkey OR o_orderkey = s_suppkey * 32")
def or_join_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 32).alias("far"))
    return relational.or_join(o, s, [("o_custkey", "s_suppkey"), ("o_orderkey", "far")]).select("o_orderkey", "s_suppkey")


@query("content_hash_join", "SELECT a.doc_id, CAST(min(b.doc_id) AS BIGINT) AS first_id, count(*) AS copies FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) GROUP BY a.doc_id HAVING count(*) > 1")
def content_hash_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    groups = d.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return d.join(groups, "h").select("doc_id", "first_id", "copies")


@query(
    "pair_cosine_max_mean",
    """WITH c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)
    SELECT vec_id, round(max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c)), 4) AS best, round(avg(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c)), 4) AS mean FROM embeddings CROSS JOIN c GROUP BY vec_id""",
)
def pair_cosine_max_mean(spark, sf_dir):
    # every row against a profile of one vector for each label, held in one row beside it
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    means = e.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c")).agg(F.collect_list("c").alias("cs"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    cosines = F.transform("cs", lambda c: dot(F.col("x"), c) / F.sqrt(dot(F.col("x"), F.col("x")) * dot(c, c)))
    d = e.join(F.broadcast(centres)).select("vec_id", cosines.alias("s"))
    return d.select("vec_id", F.round(F.array_max("s"), 4).alias("best"), F.round(F.aggregate("s", F.lit(0.0), lambda a, v: a + v) / F.size("s"), 4).alias("mean"))


@query("near_time_pairs", "SELECT a.event_id, count(*) AS near FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND b.ts BETWEEN a.ts - INTERVAL 30 MINUTE AND a.ts + INTERVAL 30 MINUTE GROUP BY a.event_id")
def near_time_pairs(spark, sf_dir):
    # a range frame over each user's sorted events: one shuffle and no pairs
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-1_800_000_000, 1_800_000_000)
    d = events(spark, sf_dir).select("event_id", "user_id", t.alias("t"))
    return d.withColumn("near", F.count("*").over(w) - 1).where("near > 0").select("event_id", "near")


@query(
    "funnel_report",
    """SELECT coalesce(event_type, 'TOTAL') AS source, count(*) AS fetched, CAST(sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS BIGINT) AS inserted, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS passed,
    round(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) / count(*), 6) AS rate FROM events GROUP BY ROLLUP (event_type)""",
)
def funnel_report(spark, sf_dir):
    return reports.funnel(events(spark, sf_dir), "event_type", {"inserted": F.col("value") > 20, "passed": F.col("value") > 50})


_LABELLED = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@query("count_distinct_case", f"SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT CASE WHEN l.quality = 1 THEN source END) AS good_sources FROM {_LABELLED} GROUP BY lang")
def count_distinct_case(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.countDistinct(F.when(F.col("quality") == 1, F.col("source"))).alias("good_sources"))


@query("count_distinct_filter", f"SELECT source, count(DISTINCT d.doc_id) FILTER (WHERE l.quality = 1) AS good, count(DISTINCT d.doc_id) FILTER (WHERE l.doc_id IS NULL) AS unlabeled FROM {_LABELLED} GROUP BY source")
def count_distinct_filter(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("sievework_documents")
    table(spark, sf_dir, "labels").createOrReplaceTempView("sievework_labels")
    return spark.sql("SELECT source, count(DISTINCT d.doc_id) FILTER (WHERE l.quality = 1) AS good, count(DISTINCT d.doc_id) FILTER (WHERE l.doc_id IS NULL) AS unlabeled FROM sievework_documents d LEFT JOIN sievework_labels l ON d.doc_id = l.doc_id GROUP BY source")


@query("group_ordinal", "SELECT CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 4000 THEN 'middle' ELSE 'long' END AS size, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def group_ordinal(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("sievework_documents")
    return spark.sql("SELECT CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 4000 THEN 'middle' ELSE 'long' END AS size, lang, count(*) AS n FROM sievework_documents GROUP BY 1, 2")


@query("explode_tag_count", f"SELECT item, count(*) AS n FROM (SELECT unnest({WORDS}) AS item FROM documents) GROUP BY item ORDER BY n DESC, item LIMIT 200")
def explode_tag_count(spark, sf_dir):
    return relational.explode_count(table(spark, sf_dir, "documents"), words(F.col("text")), 200)


@query("confusion_pivot", "SELECT lang, CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS good FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def confusion_pivot(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("lang").pivot("quality", [0, 1]).count().fillna(0).select("lang", F.col("0").alias("bad"), F.col("1").alias("good"))


@query(
    "canonical_groups",
    f"""SELECT doc_id, first_value(doc_id) OVER (PARTITION BY k ORDER BY n_chars DESC, doc_id) AS canonical, count(*) OVER (PARTITION BY k) AS group_size FROM (SELECT doc_id, n_chars, {TITLE} || '|' || lang AS k FROM documents) QUALIFY count(*) OVER (PARTITION BY k) > 1""",
)
def canonical_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("title", title())
    return relational.canonical_groups(d, [F.col("title"), F.col("lang")], F.col("n_chars"), F.col("doc_id"), "doc_id")


@query("company_weights", "SELECT doc_id, least(1.0, 10.0 / count(*) OVER (PARTITION BY source)) AS weight FROM documents")
def company_weights(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    n = d.groupBy("source").agg(F.count("*").alias("n"))
    return d.join(n, "source").select("doc_id", F.least(F.lit(1.0), F.lit(10.0) / F.col("n")).alias("weight"))


_CLASS = "CASE WHEN toxic = 1 THEN 'bad_fit' WHEN quality = 1 THEN 'good_fit' ELSE 'maybe' END"


@query("class_weights", f"SELECT label, CAST(t AS DOUBLE) / (3 * n) AS weight FROM (SELECT {_CLASS} AS label, count(*) AS n, sum(count(*)) OVER () AS t FROM labels GROUP BY 1)")
def class_weights(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select(reports.label_class().alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    total = d.agg(F.sum("n").alias("t"))
    return d.join(F.broadcast(total)).select("label", (F.col("t") / (F.lit(3) * F.col("n"))).alias("weight"))  # one row


@query("topk_null_order", "SELECT event_id, user_id, CASE WHEN value > 20 THEN value END AS v FROM events ORDER BY v DESC NULLS LAST, user_id, event_id LIMIT 200")
def topk_null_order(spark, sf_dir):
    d = events(spark, sf_dir).select("event_id", "user_id", F.when(F.col("value") > 20, F.col("value")).alias("v"))
    return d.orderBy(F.desc_nulls_last("v"), "user_id", "event_id").limit(200)


@query("systematic_sample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) WHERE r % 7 = 0")
def systematic_sample(spark, sf_dir):
    return relational.systematic_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 7)


@query("hash_sample_per_state", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR))), doc_id) AS r FROM documents) WHERE r <= 10")
def hash_sample_per_state(spark, sf_dir):
    return relational.sample_per_group(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 10)


@query("union_sources", "SELECT source FROM documents UNION SELECT event_type FROM events UNION SELECT 'manual'")
def union_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source").union(events(spark, sf_dir).select("event_type"))
    return d.union(spark.createDataFrame([("manual",)], "source string")).distinct()


@query("except_new", "SELECT source FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT source FROM documents WHERE n_chars > 12000")
def except_new(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.where("doc_id % 2 = 0").select("source").distinct().join(d.where("n_chars > 12000").select("source").distinct(), "source", "left_anti")


@query("last24h_inserted", "SELECT event_type, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS inserted, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY event_type")
def last24h_inserted(spark, sf_dir):
    return reports.recent(events(spark, sf_dir), "event_type", "ts", 1, F.col("value") > 50)


@query("stale_sources", "SELECT user_id, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 36 HOUR AS stale FROM events GROUP BY user_id")
def stale_sources(spark, sf_dir):
    return reports.stale(events(spark, sf_dir), "user_id", "ts", 36)


@query("label_report", f"SELECT {_CLASS} AS label, count(*) AS n, count(DISTINCT source) AS sources, round(avg(n_chars), 4) AS mean_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1")
def label_report(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return d.groupBy(reports.label_class().alias("label")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query(
    "disqualification_examples",
    "SELECT lang, count(*) AS n, array_to_string(list_slice(list_sort(list(doc_id)), 1, 3), ',') AS examples FROM documents WHERE n_chars < 400 GROUP BY lang",
)
def disqualification_examples(spark, sf_dir):
    return reports.examples(table(spark, sf_dir, "documents").where("n_chars < 400"), "lang", "doc_id", 3)


@query("customer_spend_topk", "SELECT c_custkey, n_name, CAST(sum(floor(l_extendedprice * (1 - l_discount) * 10000 + 0.5)) AS BIGINT) AS spend FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2 ORDER BY spend DESC, c_custkey LIMIT 50")
def customer_spend_topk(spark, sf_dir):
    # in ten-thousandths, so that sums are exact in any order
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000 + 0.5).alias("v")).groupBy("l_orderkey").agg(F.sum("v").alias("v"))
    d = line.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), line["l_orderkey"] == F.col("o_orderkey"))
    spend = d.groupBy("o_custkey").agg(F.sum("v").alias("spend"))
    who = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return spend.join(who, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "n_name", "spend").orderBy(F.desc("spend"), "c_custkey").limit(50)


@query("batch_differences", "SELECT doc_id, 'n_chars' AS column, CAST(n_chars AS VARCHAR) AS before, CAST(strlen(text) AS VARCHAR) AS after FROM documents WHERE n_chars <> strlen(text)")
def batch_differences(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return merge.differences(d.select("doc_id", "n_chars"), d.select("doc_id", F.octet_length("text").alias("n_chars")), "doc_id", ["n_chars"])


@query("quarantine_split", "SELECT CAST(count(*) FILTER (WHERE TRY_CAST(p_name AS BIGINT) IS NOT NULL OR p_name IS NULL) AS BIGINT) AS good, CAST(count(*) FILTER (WHERE p_name IS NOT NULL AND TRY_CAST(p_name AS BIGINT) IS NULL) AS BIGINT) AS bad FROM part")
def quarantine_split(spark, sf_dir):
    good, bad = merge.quarantine(table(spark, sf_dir, "part").select("p_name"), "p_name", "bigint")
    both = good.select(F.lit(1).alias("g"), F.lit(0).alias("b")).unionAll(bad.select(F.lit(0), F.lit(1)))
    return both.agg(F.sum("g").alias("good"), F.sum("b").alias("bad"))


@query("cross_post_fingerprint", f"SELECT count(*) AS rows, count(DISTINCT fp) AS prints FROM (SELECT sha256(concat_ws('|', regexp_replace(lower(trim({TITLE}, ' ')), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), lang, 'onsite')) AS fp FROM documents)")
def cross_post_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(fingerprint(title(), F.col("lang"), F.lit(False)).alias("fp")).agg(F.count("*").alias("rows"), F.countDistinct("fp").alias("prints"))
