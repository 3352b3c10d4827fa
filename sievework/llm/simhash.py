"""SimHash near-duplicates by tiled exact comparison of all fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.components import connected_components
from sievework.session import fresh, made_since, mark, release, text_batches, written

SHINGLE, RADIUS, TILE, SEED = 4, 4, 65_536, 42
#: Comparisons a task: a second or so.
TASK = 1 << 27
#: So many ids and text hashes (16 bytes) may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text, unsigned: see fingerprints()."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    hashes = np.array([xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist())], np.uint64)
    n, over = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a bounded block of unpacked bits at a time
        over += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(over * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fp") -> DataFrame:
    """Add the SimHash of a text column as a signed long.

    ASCII letters are lower-cased; words are runs of anything but space and \\x09-\\x0D; every run of four words,
    repeats included, is hashed by XXH64 with seed 42 (fewer words: the whole sequence). A bit is 1 if it is set
    in over half the hashes. Null and blank texts get 0. A column that is named like the result is replaced.
    """

    text_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(np.array([fingerprint(x) for x in s], np.uint64).view(np.int64))

    return docs.withColumn(to, udf(F.col(text)))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root) of the graph on n nodes with edges i-j."""
    label = np.arange(n)
    while True:
        was = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while not np.array_equal(label, up := label[label]):
            label = up
        if np.array_equal(was, label):
            child = np.nonzero(label != np.arange(n))[0]
            return child, label[child]


def near_in_tiles(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles of fingerprints: pairs of values.

    Exclusive-or and bit counts over blocks of 64 rows and 8192 columns, which stay in the processor's cache; rows
    are in order of the population count of their upper 16 bits, and a block skips the columns whose count differs
    beyond the radius.
    """
    top = lambda x: np.bitwise_count(x >> np.uint64(48)).astype(np.int16)
    a, b = a[np.argsort(top(a), kind="stable")], b[np.argsort(top(b), kind="stable")]
    pa, pb, n = top(a), top(b), len(a)
    left, right, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for at in range(0, n, 64):
        rows, p = a[at : at + 64], pa[at : at + 64]
        lo, hi = int(np.searchsorted(pb, p[0] - radius, "left")), int(np.searchsorted(pb, p[-1] + radius, "right"))
        for start in range(lo, hi, 8192):
            i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ b[None, start : min(hi, start + 8192)]) <= radius)
            left.append(i + at)
            right.append(j + start + n)
            held += len(i)
            if held > 1 << 20:  # many links: keep only a forest of them
                i, j = _forest(n + len(b), np.concatenate(left), np.concatenate(right))
                left, right, held = [i], [j], len(i)
    i, j = _forest(n + len(b), np.concatenate(left), np.concatenate(right))
    both = np.concatenate((a, b))
    keep = both[i] != both[j]
    return both[i][keep], both[j][keep]


def _halves(fp: Column) -> tuple[Column, Column]:
    return F.bit_count(F.shiftrightunsigned(fp, 32)).cast("int"), F.bit_count(fp.bitwiseAND(F.lit(0xFFFFFFFF))).cast("int")


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that connect all of the distinct fingerprints (column fp) within radius of each other.

    Fingerprints are sorted into classes by the population counts of their two halves; a class over the tile
    size is split by hash into tiles of bounded size. A pair of tiles is skipped if its counts already differ
    beyond the radius; every other pair is compared whole, in tasks whose number grows with the comparisons. A tile
    travels once for each pair it is in, and a pair returns a spanning forest of its links, so a group of many near
    copies never emits all its pairs.
    """
    spark = distinct.sparkSession
    hi, lo = _halves(F.col("fp"))
    classed = distinct.select("fp", hi.alias("hi"), lo.alias("lo"))
    sizes = {(r.hi, r.lo): r.n for r in classed.groupBy("hi", "lo").agg(F.count("*").alias("n")).collect()}  # 33 x 33 at most
    split = {k: -(-n // tile) for k, n in sizes.items()}
    rows, work = [], 0
    for (h, m), parts in split.items():
        near = [(h + x, m + y) for x in range(-radius, radius + 1) for y in range(abs(x) - radius, radius - abs(x) + 1)]
        near = [k for k in near if k in split]
        rows.append((h, m, parts, [(a, b, split[a, b]) for a, b in near]))
        work += sum(sizes[h, m] * sizes[k] for k in near) // 2
    meta = spark.createDataFrame(rows, "hi int, lo int, parts int, near array<struct<hi:int,lo:int,parts:int>>")
    sub = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    key = lambda h, m, s: F.format_string("%02d.%02d.%010d", h, m, s)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tile": [part["tile"].iloc[0]], "hi": [part["hi"].iloc[0]], "lo": [part["lo"].iloc[0]], "fps": [part["fp"].to_numpy(np.int64).tobytes()]})

    tiles = classed.join(F.broadcast(meta.drop("near")), ["hi", "lo"]).withColumn("tile", key(F.col("hi"), F.col("lo"), sub)).select("tile", "hi", "lo", "fp")
    tiles = written(tiles.groupBy("tile").applyInPandas(pack, "tile string, hi int, lo int, fps binary"), "tiles")
    each = tiles.join(F.broadcast(meta.drop("parts")), ["hi", "lo"]).select("tile", "fps", F.explode("near").alias("to"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("to.parts") - 1))).withColumn("other", key(F.col("to.hi"), F.col("to.lo"), F.col("other")))
    each = each.select(F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "fps")
    tasks = max(16, min(100_000, work // TASK))

    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        sides = [np.frombuffer(x, np.uint64) for x in pair["fps"]]
        u, v = near_in_tiles(sides[0], sides[-1], radius)  # a tile beside itself comes once
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return each.repartition(tasks, "a", "b").groupBy("a", "b").applyInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per input row: the id, fp (signed long) and component_id, the smallest id reachable over links.

    Two rows link if their fingerprints differ in at most radius bits. Null and blank texts share fingerprint
    zero and link like any other; null ids never name a component unless it holds nothing else. Repeated rows
    come back repeated; other columns are left out; an empty table gives an empty result.
    """
    fps = written(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))).select("id", "fp"), "fingerprints")
    rooted = _rooted(fps, F.min("id").alias("least"), radius, tile)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _rooted(fps: DataFrame, least: Column, radius: int, tile: int) -> DataFrame:
    """One row per distinct fingerprint: fp, root (which names its component), and an aggregate over its rows."""
    groups = written(fps.groupBy("fp").agg(least), "groups")
    node = connected_components(links(groups.select("fp"), radius, tile)).withColumnsRenamed({"node": "fp", "component": "root"})
    return groups.join(node, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """docs with one document of each near-duplicate component: the one with the smallest id.

    Columns stay. A survivor is known by its id and a 64-bit hash of its text, so unlike documents that share an
    id, or have none, each keep their own component's place; a row without an id stays only if its component holds
    no other. Rows alike in id and text are one document. An empty table stays empty.
    """
    key, th, hashed = fresh(docs, "_id", "_th", "_hash")
    began = mark()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    fps = written(fingerprints(rows).select("id", "th", "fp"), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first")  # a null id comes last
    named = _rooted(fps, first, radius, tile).groupBy("root").agg(F.min("first").alias("first"))
    named = written(named.select(F.col("first.id").alias(key), F.col("first.th").alias(th)), "kept")
    ids = named.count()
    wanted = F.broadcast(named) if ids <= BROADCAST_IDS else named
    copies = fps.join(wanted, F.col("id").eqNullSafe(F.col(key)) & (F.col("th") == F.col(th)), "left_semi").count()
    release(docs.sparkSession, made_since(began), but=named)
    boxed = docs.withColumn(hashed, F.xxhash64(text))
    out = boxed.join(wanted, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(hashed) == F.col(th)), "left_semi")
    return (out if copies == ids else out.dropDuplicates([id_col, hashed])).drop(hashed)
