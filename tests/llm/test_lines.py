"""Line dedup against all pairs of the smallest table's lines, and characters beyond the base plane."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from sievework.llm import lines

DATA = "/root/testdata/sf0.001/documents.parquet"


@pytest.mark.skipif(not os.path.exists(DATA), reason="the driver's tables are not here")
def test_recall_against_all_pairs(spark):
    """Of the lines that brute force drops at least 99 % are dropped, and no other but those of components it joins."""
    docs = spark.read.parquet(DATA).select("doc_id", "text")
    every = [(r["doc_id"], pos, re.sub(r"\s+", " ", x).strip(" ").lower()) for r in docs.collect() if r["text"] is not None for pos, x in enumerate(r["text"].split("\n"))]
    every = [x for x in every if len(x[2]) >= 8]
    texts = sorted({x[2] for x in every})
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in texts]
    where: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in enumerate(sets):
        common: dict = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if c >= 0.8 * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    index, first, want = {t: i for i, t in enumerate(texts)}, {}, set()
    for d, pos, t in sorted(every):
        if find(index[t]) in first:
            want.add((d, pos))
        first.setdefault(find(index[t]), (d, pos))
    got = {(r["id"], r["pos"]) for r in lines.duplicate_lines(docs).collect()}
    assert want and len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_characters_beyond_the_base_plane(spark):
    """A shingle is eight characters for signatures and verification alike, with or without them in the line."""
    r = random.Random(4)
    base = "".join(r.choice("abcdefgh😀𝛼𝛽 ") for _ in range(120)).strip()
    rows = [(1, base), (2, base[:60] + "x" + base[61:]), (3, "😀" * 8), (4, "😀" * 8 + "\n" + "😀" * 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    m = {x["h"]: x for x in lines.signatures(d.select(F.col("doc_id").alias("h"), F.col("text").alias("norm")).where("h < 3")).collect()}
    agree = sum(m[1][f"m{k}"] == m[2][f"m{k}"] for k in range(lines.MINS))
    assert agree >= 14
    got = {x["doc_id"]: x["text"] for x in lines.dedup_lines(d).collect()}
    assert got == {1: base, 2: "", 3: "😀" * 8, 4: "😀" * 7}
    plain, mixed = "the quick brown fox jumps over the lazy dog and runs away from the bear", "the quick brown fox jumps over the lazy dog and runs away from the bear😀"
    d = spark.createDataFrame([(1, plain), (2, mixed)], "doc_id long, text string")
    assert {x["doc_id"]: x["text"] for x in lines.dedup_lines(d).collect()} == {1: plain, 2: ""}


def test_a_hub_among_its_variants(spark):
    """Variants that are like one line and unlike each other are one component through it."""
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    hub = word(300)
    rows = [(0, hub)]
    for i in range(1, 120):
        at = r.randrange(20, 240)
        rows.append((i, hub[:at] + word(13) + hub[at + 13 :]))  # 0.76 to another one, 0.87 to the hub
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert [x["doc_id"] for x in lines.dedup_lines(d).where("text != ''").collect()] == [0]


def test_no_partner_in_a_crowded_bucket_is_lost(spark):
    """Pairs of one bucket that neither the least, the leader, the neighbours nor the finer rounds bring together."""
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows, want = [], set()
    for i in range(0, 60, 2):  # thirty pairs, each alike in itself alone, all put into one bucket
        a = text(120)
        rows += [(i, a), (i + 1, a[:-2] + text(2))]
        want.add((i, i + 1))
    d = spark.createDataFrame(rows, "h long, norm string")
    crowds = d.select(F.lit(1).cast("long").alias("key"), "h")
    roots = spark.createDataFrame([], "node long, component long")
    pairs = lines.across(crowds, roots, d)
    assert pairs.count() == 60 * 59 // 2
    assert {(x["u"], x["v"]) for x in lines.verified(pairs, d).collect()} == want
    joined = spark.createDataFrame([(h, 0) for h in range(58)], "node long, component long")
    assert {(x["u"], x["v"]) for x in lines.across(crowds, joined, d).where("u > 57").collect()} == {(58, 59)}


def test_a_bucket_of_three_is_crowded(spark):
    m = [[1] * lines.MINS, [1] * lines.MINS, [1] * lines.MINS]
    signed = spark.createDataFrame([(h, 1, *x) for h, x in enumerate(m)], "h long, n long, " + ", ".join(f"m{k} long" for k in range(lines.MINS)))
    assert lines.candidates(signed)[1].count() == len(lines.bands())


def test_sketches_part_unlike_lines_and_no_alike_ones(spark):
    """Pairs at every similarity: none of at least 0.8 is held to be unlike by its sketches, nearly all below 0.6 are."""
    r = random.Random(12)
    text = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows, alike, unlike = [], set(), set()
    for i in range(0, 800, 2):
        a = "ab" * 30 if i < 20 else text(r.choice([20, 60, 250, 900]))
        keep = len(a) * r.randrange(50, 101) // 100
        b = a[:keep] + text(len(a) - keep)
        s, t = ({x[k : k + 8] for k in range(len(x) - 7)} for x in (a, b))
        j = len(s & t) / len(s | t)
        rows += [(i, a), (i + 1, b)]
        alike |= {i} if j >= 0.8 else set()
        unlike |= {i} if j < 0.6 else set()
    d = spark.createDataFrame(rows, "h long, norm string")
    pairs = d.where("h % 2 = 0").select(F.col("h").alias("u"), (F.col("h") + 1).alias("v"))
    got = {x["u"] for x in lines.hopeful(pairs, lines.sketches(d)).collect()}
    assert len(alike) > 50 and alike <= got and len(unlike) > 50 and len(unlike & got) <= 0.05 * len(unlike)


def test_a_crowded_bucket_makes_no_rows_for_unlike_lines(spark):
    """Lines of one bucket that are unlike are parted in the join; of alike ones every pair between components stays."""
    r = random.Random(13)
    text = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    base = [text(120) for _ in range(60)]
    rows = [(3 * i + k, a if k == 0 else a[:-2] + text(2)) for i, a in enumerate(base) for k in range(3)]
    d = spark.createDataFrame(rows, "h long, norm string")
    crowds = d.select(F.lit(1).cast("long").alias("key"), "h")
    roots = spark.createDataFrame([(0, 0), (1, 0), (4, 3), (3, 3)], "node long, component long")
    got = {(x["u"], x["v"]) for x in lines.across(crowds, roots, d, sketched=lines.sketches(d)).collect()}
    assert got == {(3 * i + a, 3 * i + b) for i in range(60) for a, b in ((0, 1), (0, 2), (1, 2))} - {(0, 1), (3, 4)}


def test_nearest_pairs_first_lose_no_link(spark):
    """A chain whose every line is like the next alone is one component, compared at once or the nearest pairs first."""
    r = random.Random(14)
    text = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    chain = [text(200)]
    for i in range(39):
        at = 8 * (i % 24)
        chain.append(chain[-1][:at] + text(8) + chain[-1][at + 8 :])
    rows = list(enumerate(chain)) + [(100 + i, text(200)) for i in range(20)]
    d = spark.createDataFrame(rows, "h long, norm string")
    crowds = d.select(F.lit(1).cast("long").alias("key"), "h")
    none = spark.createDataFrame([], "node long, component long")
    pairs = lines.across(crowds, none, d, sketched=lines.sketches(d))
    for few in (5, 100_000):
        got = {x["node"]: x["component"] for x in lines._linked(pairs, none, d, few, 8, 0.8).collect()}
        assert got == {i: 0 for i in range(40)}


def test_runs_of_shingles_hold_every_one_once(spark):
    """Lines about the ends of a run, with and without characters beyond the base plane: each shingle is hashed where it
    stands, alike in both forms, and a verified pair is one by the sets of shingles themselves."""
    r = random.Random(15)
    rows = []
    for n in (8, 9, 22, 23, 24, 25, 38, 39, 40, 200):
        a = "".join(r.choice("abcdeé中") for _ in range(n))
        rows += [a, a + "😀", "😀" + a, a[: n // 2] * 3, a[: n - n // 5] + "q" * (n // 5)]
    rows = [(h, t) for h, t in enumerate(rows) if len(t) >= 8]
    d = spark.createDataFrame(rows, "h long, norm string")
    pairs = spark.createDataFrame([(a, b) for a, _ in rows for b, _ in rows if a < b and b - a < 12], "u long, v long")
    cut = lambda t: [t[k : k + 8] for k in range(len(t) - 7)]
    text, got = dict(rows), {x["h"]: x["x"] for x in lines._hashed(d.repartition("h"), {"x": "norm"}, ["h"]).collect()}
    named: dict = {}
    for h, t in rows:
        assert len(got[h]) == len(cut(t))
        named.setdefault(frozenset(got[h]), set()).add(frozenset(cut(t)))
    assert all(len(x) == 1 for x in named.values()) and len({x for g in got.values() for x in g}) == len({x for t in text.values() for x in cut(t)})
    assert {x["h"]: x["size"] for x in lines.sketches(d).collect()} == {h: len(set(cut(t))) for h, t in rows}
    jaccard = lambda a, b: len(a & b) / len(a | b)
    want = {(x["u"], x["v"]) for x in pairs.collect() if jaccard(set(cut(text[x["u"]])), set(cut(text[x["v"]]))) >= 0.8}
    assert want and {(x["u"], x["v"]) for x in lines.verified(pairs, d).collect()} == want
