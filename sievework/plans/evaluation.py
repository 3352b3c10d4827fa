"""Queries for samples, folds, leakage, metrics, bootstrap intervals and learned scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import metrics, models, sampling
from sievework.operators.reports import label_class
from sievework.plans.catalogue import query
from sievework.plans.relations import _CLASS
from sievework.plans.tables import TITLE, table, title

_MD5 = "md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR)))"


@query(
    "strata_40_30_30",
    f"""WITH pool AS (SELECT doc_id, n_chars, (doc_id * 7919) % 1000 AS conf FROM documents), t AS (SELECT doc_id FROM pool ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 40),
    u AS (SELECT doc_id FROM pool WHERE doc_id NOT IN (SELECT doc_id FROM t) ORDER BY conf NULLS LAST, doc_id LIMIT 30),
    r AS (SELECT doc_id FROM pool WHERE doc_id NOT IN (SELECT doc_id FROM t) AND doc_id NOT IN (SELECT doc_id FROM u) ORDER BY {_MD5}, doc_id LIMIT 30)
    SELECT doc_id, 'top' AS stratum FROM t UNION ALL SELECT doc_id, 'uncertain' FROM u UNION ALL SELECT doc_id, 'random' FROM r""",
)
def strata_40_30_30(spark, sf_dir):
    pool = table(spark, sf_dir, "documents").select("doc_id", "n_chars", ((F.col("doc_id") * 7919) % 1000).alias("conf"))
    return sampling.strata(pool, 100, "doc_id", "n_chars", "conf")


@query(
    "batch_70_30_caps",
    f"""WITH f AS (SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3 ORDER BY n_chars DESC, doc_id LIMIT 35),
    used AS (SELECT source, count(*) AS c FROM f GROUP BY source),
    rest AS (SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY md5(concat_ws('|', '42', CAST(d.doc_id AS VARCHAR))), d.doc_id) AS r FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM f)),
    g AS (SELECT doc_id FROM rest LEFT JOIN used USING (source) WHERE r <= 3 - coalesce(c, 0) ORDER BY {_MD5}, doc_id LIMIT 15)
    SELECT doc_id, 'top' AS stratum FROM f UNION ALL SELECT doc_id, 'random' FROM g""",
)
def batch_70_30_caps(spark, sf_dir):
    return sampling.batch_with_caps(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), 50, "doc_id", "source", "n_chars")


@query("few_shot", f"SELECT label, doc_id FROM (SELECT label, doc_id, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS r FROM (SELECT doc_id, {_CLASS} AS label FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'en'))) WHERE r <= 3")
def few_shot(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", label_class().alias("label"))
    return sampling.few_shot(labels, "label", "doc_id", 3, table(spark, sf_dir, "documents").where("lang <> 'en'")).select("label", "doc_id")


@query("group_folds_hash", "SELECT doc_id, CAST(CAST('0x' || substr(md5(concat_ws('|', '42', source)), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM documents")
def group_folds_hash(spark, sf_dir):
    return sampling.hash_folds(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5).select("doc_id", "fold")


@query("group_folds_greedy")
def group_folds_greedy(spark, sf_dir):
    return sampling.greedy_folds(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5).select("doc_id", "source", "fold")


@query(
    "intersect_leakage",
    """SELECT 'source' AS check, (SELECT count(*) FROM (SELECT source FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT source FROM documents WHERE doc_id % 2 = 1)) AS overlap
    UNION ALL SELECT 'h', (SELECT count(*) FROM (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT md5(text) FROM documents WHERE doc_id % 2 = 1))
    UNION ALL SELECT 'doc_id', 0""",
)
def intersect_leakage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    return sampling.leakage(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["source", "h", "doc_id"])


@query("training_gates", "SELECT count(*) AS labels, CAST(sum(quality) AS BIGINT) AS positives, (SELECT CAST(min(p) AS BIGINT) FROM (SELECT sum(quality) AS p FROM labels GROUP BY doc_id % 5)) AS least_in_fold, count(*) >= 150 AND sum(quality) >= 30 AND (SELECT min(p) FROM (SELECT sum(quality) AS p FROM labels GROUP BY doc_id % 5)) >= 3 AS open FROM labels")
def training_gates(spark, sf_dir):
    return sampling.training_gate(table(spark, sf_dir, "labels").withColumn("fold", F.col("doc_id") % 5), "quality", "fold")


_PAIRS = "(SELECT l.doc_id AS id, CAST(l.quality AS BIGINT) AS y, CAST(round(log10(d.n_chars + 1) * 4) AS BIGINT) AS k, d.source FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"
_SCOREDP = f"(SELECT id, y, source, least(k, 19) / 20.0 AS score FROM {_PAIRS})"


def scored(spark, sf_dir):
    """Labelled documents with a coarse score, so that there are ties."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    k = F.round(F.log10(F.col("n_chars") + 1) * 4).cast("long")
    return d.select(F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("y"), "source", (F.least(k, F.lit(19)) / 20.0).alias("score"))


_TOP = f"(SELECT * FROM {_SCOREDP} ORDER BY score DESC, id LIMIT 25)"


@query("p_at_k", f"SELECT CAST(sum(y) AS DOUBLE) / count(*) AS p_at_k FROM {_TOP}")
def p_at_k(spark, sf_dir):
    return metrics.precision_at(scored(spark, sf_dir), 25).select("p_at_k")


@query("r_at_k", f"SELECT round((SELECT sum(y) FROM {_TOP}) / (SELECT sum(y) FROM {_SCOREDP}), 6) AS r_at_k")
def r_at_k(spark, sf_dir):
    return metrics.precision_at(scored(spark, sf_dir), 25).select(F.round("r_at_k", 6).alias("r_at_k"))


@query(
    "pr_auc_trapezoid",
    f"""WITH c AS (SELECT id, score, sum(y) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS tp, row_number() OVER (ORDER BY score DESC, id) AS pos, sum(y) OVER () AS total FROM {_SCOREDP}),
    p AS (SELECT pos, tp / total AS r, tp / pos AS p FROM c), q AS (SELECT r, p, coalesce(lag(r) OVER (ORDER BY pos), 0) AS r0, coalesce(lag(p) OVER (ORDER BY pos), 1) AS p0 FROM p)
    SELECT round(sum((r - r0) * (p + p0) / 2), 6) AS pr_auc FROM q""",
)
def pr_auc_trapezoid(spark, sf_dir):
    return metrics.pr_auc_trapezoid(scored(spark, sf_dir)).select(F.round("pr_auc", 6).alias("pr_auc"))


_CURVE = f"(SELECT score, p, n, sum(p) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS seen FROM (SELECT score, sum(y) AS p, count(*) AS n FROM {_SCOREDP} GROUP BY score))"


@query("avg_precision", f"SELECT round(sum(p * tp / seen) / sum(p), 6) AS average_precision FROM {_CURVE}")
def avg_precision(spark, sf_dir):
    return metrics.average_precision(scored(spark, sf_dir)).select(F.round("average_precision", 6).alias("average_precision"))


@query("roc_auc", f"SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) / count(*), 6) AS roc_auc FROM {_SCOREDP} a JOIN {_SCOREDP} b ON a.y = 1 AND b.y = 0")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(scored(spark, sf_dir)).select(F.round("roc_auc", 6).alias("roc_auc"))


@query(
    "kendall_tau_b",
    f"""WITH s AS (SELECT id, y, score FROM {_SCOREDP}), p AS (SELECT sign(b.score - a.score) * sign(b.y - a.y) AS c, a.score = b.score AS ts, a.y = b.y AS ty FROM s a JOIN s b ON a.id < b.id)
    SELECT round(sum(c) / sqrt(CAST(count(*) FILTER (NOT ts) AS DOUBLE) * count(*) FILTER (NOT ty)), 6) AS tau_b FROM p""",
)
def kendall_tau_b(spark, sf_dir):
    return metrics.kendall_tau_b(scored(spark, sf_dir), "score", "y").select(F.round("tau_b", 6).alias("tau_b"))


@query(
    "kappa",
    f"""WITH c AS (SELECT count(*) FILTER (y = 1 AND score >= 0.7) AS tp, count(*) FILTER (y = 0 AND score >= 0.7) AS fp, count(*) FILTER (y = 1 AND score < 0.7) AS fn, count(*) FILTER (y = 0 AND score < 0.7) AS tn FROM {_SCOREDP}),
    d AS (SELECT *, CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS agree, CAST((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp) AS DOUBLE) / ((tp + fp + fn + tn) * (tp + fp + fn + tn)) AS chance FROM c)
    SELECT tp, fp, fn, tn, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision, round(CAST(tp AS DOUBLE) / (tp + fn), 6) AS recall, round((agree - chance) / (1 - chance), 6) AS kappa FROM d""",
)
def kappa(spark, sf_dir):
    d = metrics.confusion(scored(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.7).cast("int")))
    return d.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "kappa")])


@query("ece_bins", f"SELECT CAST(floor(score * 10) AS INTEGER) AS bin, count(*) AS n, round(avg(y), 6) AS accuracy, round(avg(score), 6) AS mean_confidence FROM {_SCOREDP} WHERE floor(score * 10) < 10 GROUP BY 1")
def ece_bins(spark, sf_dir):
    d = metrics.calibration_bins(scored(spark, sf_dir), "y", "score")
    return d.select("bin", "n", F.round("accuracy", 6).alias("accuracy"), F.round("mean_confidence", 6).alias("mean_confidence"))


def _boot(unit: str) -> str:
    return f"""WITH u AS (SELECT {unit} AS u, sum(y) AS s, count(*) AS n, row_number() OVER (ORDER BY {unit}) - 1 AS no FROM {_SCOREDP} GROUP BY {unit}), z AS (SELECT count(*) AS z FROM u),
    d AS (SELECT t.range AS trial, i.range AS i FROM range(200) t CROSS JOIN range(100000) i WHERE i.range < (SELECT z FROM z)),
    m AS (SELECT trial, CAST(sum(s) AS DOUBLE) / sum(n) AS m FROM (SELECT trial, CAST('0x' || substr(md5(concat_ws('|', '42', CAST(trial AS VARCHAR), CAST(i AS VARCHAR))), 1, 8) AS BIGINT) % (SELECT z FROM z) AS no FROM d) JOIN u USING (no) GROUP BY trial)
    SELECT round(quantile_cont(m, 0.025), 6) AS low, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.975), 6) AS high FROM m"""


@query("bootstrap_ci", _boot("id"))
def bootstrap_ci(spark, sf_dir):
    return metrics.bootstrap(scored(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("low", "mean", "high")])


@query("bootstrap_ci_cluster", _boot("source"))
def bootstrap_ci_cluster(spark, sf_dir):
    return metrics.bootstrap(scored(spark, sf_dir), group="source").select(*[F.round(c, 6).alias(c) for c in ("low", "mean", "high")])


@query("char_ngram_lr")
def char_ngram_lr(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", title().alias("title"), "source")
    y = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y"))
    known = d.join(y, "doc_id")
    model = models.char_ngram(known, "title", "y")
    return models.probability(model, d).select("doc_id", F.round("probability", 4).alias("probability"))


@query("word_tfidf_lr")
def word_tfidf_lr(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    y = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y"))
    model = models.word_tfidf(d.join(y, "doc_id"), "text", "y")
    return models.probability(model, d).select("doc_id", F.round("probability", 4).alias("probability"))
