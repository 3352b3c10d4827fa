"""URL filters against enumerated segmentations, a posterior worked out by hand, unseen hosts and odd tables."""

import itertools
import math
import random

from pyspark.sql import functions as F

from sievework.llm import urls
from sievework.llm.queries import RULES


def page(url, title="river stone"):
    return url, f"<title>{title}</title><p>river stone house river</p>"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")


def test_viterbi_is_the_best_of_all_segmentations():
    r = random.Random(2)
    for _ in range(200):
        words = {"".join(r.choice("ab") for _ in range(r.randrange(1, 4))): r.randrange(1, 50) for _ in range(6)}
        total = float(sum(words.values()))
        run = "".join(r.choice("ab") for _ in range(r.randrange(1, 9)))
        cost = {w: -math.log(c / total) for w, c in words.items()}
        price = lambda w: cost.get(w, math.log(total) + math.log(10) * len(w))
        best = min(sum(price(run[i:j]) for i, j in itertools.pairwise((0, *cuts, len(run)))) for k in range(len(run)) for cuts in itertools.combinations(range(1, len(run)), k))
        got = urls.viterbi(run, cost, total)
        assert "".join(got) == run and math.isclose(sum(map(price, got)), best)


def test_posterior_by_hand(spark):
    """Tokens h:casino h:win p:x three times, h:river p:x seven times: counts, scale, smoothing and prior as written."""
    known = spark.createDataFrame([("casinowin", "x", 3, ["h:casino", "h:win", "p:x"]), ("river", "x", 7, ["h:river", "p:x"])], "host string, way string, n long, tokens array<string>")
    weights, prior = urls.train(known)
    got = {r["token"]: r["weight"] for r in weights.collect()}
    assert math.isclose(prior, math.log(4 / 8))
    b, a = 6, 14  # casino, the only seed of its host, is left out
    scale = b / a
    assert math.isclose(got["h:win"], math.log(3 + 1)) and math.isclose(got["h:river"], -math.log(7 * scale + 1))
    assert math.isclose(got["p:x"], math.log(3 + 1) - math.log(7 * scale + 1)) and math.isclose(got["h:casino"], math.log(urls.SEED_WEIGHT + 1))
    odds = {r["host"]: r["log_odds"] for r in urls.scored(known, weights, prior).collect()}
    assert math.isclose(odds["casinowin"], prior + got["h:casino"] + got["h:win"] + got["p:x"])


def test_words_beside_seeds_decide(spark):
    """An unseen host without a seed is blocked for the words that seeds keep company with; a seed among words of clean hosts is not."""
    rows = [page(f"https://casinowin.example.net/en/{i}") for i in range(30)] + [page(f"https://cheap-pills.example.net/en/{i}") for i in range(30)]
    rows += [page(f"https://riverstone.example.net/en/{i}") for i in range(300)] + [page(f"https://house.example.net/en/{i}") for i in range(300)]
    odd = [page("https://cheapwin.example.net/en/1"), page("https://adultriverstonehouse.example.net/en/2"), page("https://poker.example.net/en/3")]
    got = {r["host"]: r for r in urls.judged(frame(spark, rows + odd), RULES).collect()}
    assert got["cheapwin.example.net"]["words"] == "cheap win example net" and got["cheapwin.example.net"]["verdict"] == "block"
    assert got["adultriverstonehouse.example.net"]["words"] == "adult river stone house example net" and got["adultriverstonehouse.example.net"]["verdict"] == "allow"
    assert got["poker.example.net"]["verdict"] == "block" and got["casinowin.example.net"]["verdict"] == "block" and got["riverstone.example.net"]["verdict"] == "allow"


def test_odd_tables(spark):
    rows = [(None, None), ("", ""), ("nothing", None), ("https://" + "a" * 5000 + ".org", "<" * 100_000), ("https://x.org/ä/1", "y" * 100_000), ("https://x.org/ä/1", "z")]
    d = frame(spark, rows).withColumns({"host": F.lit(1), "Words": F.lit(2), "_row": F.lit(3), "way": F.lit(4), "n": F.lit(5), "token": F.lit(6)})
    out = urls.judged(d, RULES)
    assert out.columns == ["page_id", "url", "html", "_row", "way", "n", "token", "host", "path", "rule", "verdict", "log_odds", "words"]
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == 6 and [got[i]["host"] for i in range(3)] == [""] * 3 and all(r["_row"] == 3 for r in got.values())
    assert got[4]["verdict"] == got[5]["verdict"] == "allow" and got[4]["host"] == "x.org"
    assert urls.judged(d.limit(0), RULES).count() == 0
