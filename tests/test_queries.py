"""Every query with SQL against DuckDB on the smallest tables; the others run and keep their columns."""

import math
import os

import pytest

from sievework.plans import catalogue

catalogue.load()
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    d = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(d.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in d.collect())
    if name not in catalogue.ORACLES:
        assert mine
        return
    r = duck.execute(catalogue.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert mine == sorted(repr(tuple(plain(row[i]) for i in at)) for row in r.fetchall())


def test_entry_lists_everything():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def _against_sql(spark, folder, name, **tables):
    """Rows of a query over tables of our own, and of its SQL."""
    import duckdb

    c = duckdb.connect()
    for t, sql in tables.items():
        c.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (ROW_GROUP_SIZE 5000)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    d = catalogue.QUERIES[name](spark, str(folder))
    r = c.execute(catalogue.ORACLES[name])
    at = [[x[0] for x in r.description].index(n) for n in d.columns]
    return sorted(map(repr, map(tuple, d.collect()))), sorted(repr(tuple(row[i] for i in at)) for row in r.fetchall())


def test_latest_by_lateral_with_null_keys_and_many_partitions(spark, tmp_path):
    made = "SELECT range AS event_id, TIMESTAMP '2024-01-01' + to_seconds(CAST(hash(range) % 100000 AS BIGINT)) AS ts, CASE WHEN range % 50 = 3 THEN NULL ELSE range * 7919 % 1500 END AS user_id, 'view' AS event_type, CAST(range AS DOUBLE) AS value FROM range(100000)"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        mine, theirs = _against_sql(spark, tmp_path, "latest_per_key_lateral", events=made)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert mine == theirs


def test_batch_signals_of_nulls_and_words_like_hex(spark, tmp_path):
    texts = ["NULL", "''", "'aededea bug'", "'bug'", "'...'", "'one two three four'", "'One two three'"]
    made = " UNION ALL ".join(f"SELECT {i * 3 + k} AS doc_id, {t} AS text, {who} AS source" for i, t in enumerate(texts) for k, who in enumerate(["NULL", "''", "'src1'"]))
    mine, theirs = _against_sql(spark, tmp_path, "gate_batch_signals", documents=made)
    assert mine == theirs


def test_systematic_sample_of_many_partitions(spark, tmp_path):
    made = "SELECT range * 37 % 400000 AS doc_id, chr(97 + CAST(range % 5 AS INTEGER)) || repeat('x', 200) AS lang, 'a' AS text FROM range(400000)"
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.shuffle.partitions")}
    for k, v in zip(keep, ("1m", "false", "64")):
        spark.conf.set(k, v)
    try:
        mine, theirs = _against_sql(spark, tmp_path, "systematic_sample", documents=made)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert mine == theirs


def test_hard_filter_of_letters_that_sql_does_not_know(spark, tmp_path):
    """A character beyond Latin-1 beside a word is no letter to the SQL, and a line it does not know as one goes on."""
    odd = ["chr(8551)", "chr(170)", "chr(181)", "chr(1635)", "chr(7838)", "chr(20013)", "chr(133)", "chr(8232)", "chr(13)", "chr(160)", "'x'"]
    texts = ["'5+ years of experience' || {0} || 'no'", "'3 years' || {0} || 'of experience'", "'votre mission' || {0} || ' technicien' || {0}", "'ITAR' || {0} || 'unpaid'"]
    made = " UNION ALL ".join(f"SELECT {n} AS doc_id, {t.format(c)} AS text, 'a' AS source" for n, (t, c) in enumerate((t, c) for t in texts for c in odd for _ in range(8)))
    mine, theirs = _against_sql(spark, tmp_path, "hard_filter_reasons", documents=made)
    assert mine == theirs
