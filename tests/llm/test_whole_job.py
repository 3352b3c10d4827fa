"""Tests of what a reviewer found left out: every one failed before its change."""

import inspect
import random

import numpy as np
from pyspark.sql import functions as F

from sievework.llm import lines, neighbours, simhash, toxicity
from sievework.session import written

WORDS = "the of and to in is that it for was with as at be this are from or by report river stone paper light water house green market small large quick brown".split()


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def test_keep_one_null_and_repeated_ids(spark):
    """Unlike documents stay though they share an id or have none; near copies go whatever their ids."""
    a, b, c, d = (text(60, 20 + i) for i in range(4))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (9, c), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()), key=str)
    assert kept == sorted([(None, a), (None, b), (7, c), (7, d)], key=str)


def test_keep_one_null_component_beside_a_named_one(spark):
    """A component of null ids only does not let null-id rows of other components through."""
    a, b = text(60, 30), text(60, 31)
    docs = spark.createDataFrame([(None, a), (None, b), (3, b)], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()), key=str) == sorted([(None, a), (3, b)], key=str)


def test_recall_of_queries_that_calibrate_nothing(spark):
    """The target is 0.97, and queries beyond the calibrating ones reach about as much (0.94 gave less)."""
    assert inspect.signature(neighbours.search).parameters["recall"].default >= 0.97
    r = np.random.default_rng(5)
    m = r.normal(size=(40, 16))[r.integers(0, 40, 3000)] + 0.4 * r.normal(size=(3000, 16))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    found: dict = {}
    for g in neighbours.search(d, d.where("vec_id % 5 = 0"), leaf_rows=60).collect():
        found.setdefault(g["query_id"], set()).add(g["vec_id"])
    score = m[::5] @ m.T
    score[np.arange(600), np.arange(0, 3000, 5)] = -np.inf
    want = [set(x) for x in np.argsort(-score, axis=1)[:, :20].tolist()]
    assert np.mean([len(w & found[5 * i]) / 20 for i, w in enumerate(want)]) >= 0.955


def test_bands_at_the_threshold(spark):
    """At a similarity of exactly 0.8 at least 98.5 % of 1,000 pairs share a band, on short lines too (of all: 99 %)."""
    r = random.Random(3)
    for union in (5, 10, 20, 40):
        whole = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(union + 7)) for _ in range(1000)]
        rows = [(2 * i, w) for i, w in enumerate(whole)] + [(2 * i + 1, w[: union * 4 // 5 + 7]) for i, w in enumerate(whole)]
        signed = lines.signatures(spark.createDataFrame(rows, "h long, norm string")).collect()
        m = {x["h"]: np.array([x[f"m{k}"] for k in range(lines.MINS)]) for x in signed}
        shared = [any((m[2 * i][b] == m[2 * i + 1][b]).all() for b in lines.bands()) for i in range(1000)]
        assert np.mean(shared) >= 0.985, union


def test_line_dedup_many_groups_in_one_bucket(spark):
    """Variants of one template, unlike each other, in groups of near copies: what stays is what all pairs give."""
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common, texts = word(80), []
    for _ in range(60):
        slot = word(12)
        texts += [common + slot + word(6) for _ in range(3)]
    r.shuffle(texts)
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    kept = {i for i in range(len(texts)) if find(i) == i}
    assert 40 <= len(kept) <= 60
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"] for x in lines.dedup_lines(d).where("text != ''").collect()} == kept


def test_no_toxic_feature_is_forgotten():
    """A word of late toxic documents is selected though the clean ones hold 2^20 features and bring more each time."""
    bulk = lambda at, n: " ".join(f"aaaaa{i:07d}" for i in range(at, at + n))
    texts, labels = [bulk(0, 1_040_000)] * 2, [0.0, 0.0]
    for k in range(6):
        texts += ["some vileword here", bulk(2_000_000 + 20_000 * k, 20_000)]
        labels += [1.0, 0.0]
    assert "vileword" in toxicity._select(texts, np.array(labels), 10)


def test_quality_with_clashing_columns(spark):
    from sievework.llm import quality

    names = ["_t", "_w", "_h", "_l", "_s", "_p", "n_words", "Kept", "_row", "_text", "other.name", "p_quality"]
    d = spark.createDataFrame([(i, text(60, 70 + i)) for i in range(5)] + [(9, None), (9, None), (None, "")], "doc_id long, text string")
    plain = {(r["doc_id"], r["n_words"], r["kept"], r["p_quality"]) for r in quality.judged(d).collect()}
    out = quality.judged(d.withColumns({n: F.lit(n) for n in names}))
    assert out.columns[:9] == ["doc_id", "_t", "_w", "_h", "_l", "_s", "_p", "_row", "_text"] and out.columns[9] == "other.name"
    got = out.collect()
    assert len(got) == 8 and {(r["doc_id"], r["n_words"], r["kept"], r["p_quality"]) for r in got} == plain and all(r["_t"] == "_t" for r in got)


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated ids and rows, clashing columns and an empty table pass through all five stages."""
    import pytest

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    good = [text(150, 300 + i) + "\n" + text(40, 400 + i) for i in range(12)]
    rows = [(i, t, None, "s", len(t)) for i, t in enumerate(good)] + [(3, good[3], "en", "s", 1), (4, good[5] + " more", "en", "s", 1), (None, good[6], "en", None, 1), (None, None, None, None, None), (7, "", "en", "s", 0), (None, text(150, 999), "en", "s", 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"_row": F.lit(1), "fp": F.lit("x"), "score": F.lit(2), "kept": F.lit(3), "h": F.lit(4), "n_words": F.lit(5)})
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    for name, frame_ in (("some", d), ("none", d.limit(0))):
        frame_.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, f"{tmp_path}/some"), "stage", keep=True)
        assert docs.columns == d.columns
    out = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert {r["doc_id"] for r in out} == {*range(12), None}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_scratch_of_other_queries_stays(spark, tmp_path):
    """A lazy result of one query can be read after another has run the pipeline, and a released table is gone."""
    import pytest

    from sievework.llm import packing
    from sievework.llm.queries import vocabulary

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = spark.createDataFrame([(i, text(80, 50 + i), "en", "s", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    lazy = packing.pack(d.select("doc_id", "text"), vocabulary("word_bpe_49k.json"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 20
    assert lazy.select("doc_id").distinct().count() == 20
