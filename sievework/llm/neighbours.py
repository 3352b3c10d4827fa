"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.sample import bounded
from sievework.session import written

K, BRANCH, LEAF_ROWS, SAMPLE, CALIBRATION, RECALL, CELL, CHUNK = 20, 8, 200, 20_000, 200, 0.97, 16_384, 2048


def valid(table: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, x (array<double>) of the rows that can take part: an id, and a finite non-zero vector of the usual length."""
    x = F.col(vector).cast("array<double>")
    d = table.select(F.col(id_col).alias("id"), x.alias("x")).where("id IS NOT NULL AND x IS NOT NULL AND NOT exists(x, v -> v IS NULL OR isnan(v) OR abs(v) = double('infinity')) AND exists(x, v -> v != 0)")
    length = d.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return d.where(F.size("x") == (length["n"] if length else 0))


class Tree:
    """k-means, then k-means inside each cluster, down to leaves; inner product becomes distance by one more dimension.

    With M the largest norm, a row x gets sqrt(M^2 - |x|^2) and a query 0 as an extra component; the nearest
    row then is the one of largest inner product.
    """

    def __init__(self, sample: np.ndarray, norm: float, leaf: int, branch: int = BRANCH, seed: int = 7):
        self.norm, self.centres, self.children, self.leaf_of = norm, [np.zeros(sample.shape[1] + 1)], [[]], {}
        self.rng = np.random.default_rng(seed)
        self._split(0, self.augment(sample), leaf, branch)
        self.centres = np.array(self.centres)

    def augment(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1), 0))))

    def _split(self, node: int, x: np.ndarray, leaf: int, branch: int) -> None:
        distinct = np.unique(x, axis=0) if len(x) > leaf else x
        if len(x) <= leaf or len(distinct) < 2:
            self.leaf_of[node] = len(self.leaf_of)
            return
        centres = distinct[self.rng.choice(len(distinct), min(branch, len(distinct)), replace=False)]
        for _ in range(12):
            near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
            centres = np.array([x[near == j].mean(axis=0) if (near == j).any() else c for j, c in enumerate(centres)])
        near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        parts = [(c, x[near == j]) for j, c in enumerate(centres) if (near == j).any()]
        if len(parts) < 2:
            self.leaf_of[node] = len(self.leaf_of)
            return
        for c, part in parts:
            child = len(self.children)
            self.centres.append(c)
            self.children.append([])
            self.children[node].append(child)
            self._split(child, part, leaf, branch)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every level."""
        x, at = self.augment(x), np.zeros(len(x), np.int64)
        out = np.full(len(x), -1)
        while (out < 0).any():
            for node in np.unique(at[out < 0]):
                rows = np.nonzero((at == node) & (out < 0))[0]
                if node in self.leaf_of:
                    out[rows] = self.leaf_of[node]
                else:
                    kids = np.array(self.children[node])
                    c = self.centres[kids]
                    at[rows] = kids[((c**2).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)]
        return out

    def leaves(self, q: np.ndarray) -> Iterator[int]:
        """All leaves for a query, best bin first: a priority queue holds the nodes seen and not yet opened."""
        q, queue = np.append(q, 0.0), [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if node in self.leaf_of:
                yield self.leaf_of[node]
            else:
                kids = self.children[node]
                for d, kid in zip(((self.centres[kids] - q) ** 2).sum(axis=1).tolist(), kids):
                    heapq.heappush(queue, (d, kid))


def _matrix(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), np.float64)


def top(queries: np.ndarray, qid: np.ndarray, rows: np.ndarray, rid: np.ndarray, k: int, visits: np.ndarray | None = None, leaf: np.ndarray | None = None) -> pd.DataFrame:
    """Per query its k rows of largest inner product, not itself, ties to the smaller id: query_id, vec_id, score.

    visits: which leaves each query visits (queries x leaves), if not all; leaf: the leaf of each row.
    """
    out = []
    for at in range(0, len(queries), 64):
        q, ids, r, names = queries[at : at + 64], qid[at : at + 64], rows, rid
        rough = None
        if visits is not None:
            seen = visits[at : at + 64]
            some = seen.any(axis=0)[leaf]  # rows that no query of this block visits are not touched
            r, names, held = rows[some], rid[some], leaf[some]
            rough = q @ r.T
            rough[~seen[:, held]] = -np.inf
        else:
            rough = q @ r.T
        rough[ids[:, None] == names[None]] = -np.inf
        if len(names) > k:
            floor = np.partition(rough, len(names) - k, axis=1)[:, len(names) - k]
        else:
            floor = np.full(len(q), -np.inf)
        near = np.where(np.isfinite(floor), floor - 1e-9 * np.maximum(1, np.abs(floor)), -np.inf)
        i, j = np.nonzero((rough >= near[:, None]) & np.isfinite(rough))
        score = (q[i] * r[j]).sum(axis=1)  # summed alike for every pair, so equal vectors tie
        order = np.lexsort((names[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append(pd.DataFrame({"query_id": ids[i[keep]], "vec_id": names[j[keep]], "score": score[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})


_TOP = "query_id long, vec_id long, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact(vectors: DataFrame, queries: list, k: int = K) -> DataFrame:
    """Brute force for a bounded list of (id, x): all rows are compared, block by block."""
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in queries], np.int64), np.array([r["x"] for r in queries], np.float64)))

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, q = shared.value
        for part in parts:
            if len(part):
                yield top(q, qid, _matrix(part["x"]), part["id"].to_numpy(np.int64), k)

    return _best(vectors.select("id", "x").mapInPandas(scan, _TOP), k)


def search(table: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, recall: float = RECALL, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE, calibration: int = CALIBRATION) -> DataFrame:
    """Each query's k rows of largest inner product: query_id, rank, vec_id, score (double precision).

    The tree is fitted on at most `sample` rows in hash order of the id and indexes every row. `calibration`
    queries are answered by brute force as well; leaf visits widen until their mean recall reaches `recall`, and
    every query then visits so many leaves, and more until these hold k other rows. Leaves are gathered into cells
    of bounded size (a crowded leaf fills several) and the queries that visit a cell into chunks, so that a task
    returns a query's best of many leaves at once. Rows without an id or
    with a null, zero or non-finite vector take no part, nor do vectors of another length than the commonest, which
    have no inner product with it; rows with the query's id are its own; of queries with one id the least vector asks.
    """
    spark = table.sparkSession
    vectors, asked = valid(table, id_col, vector), valid(queries, id_col, vector).groupBy("id").agg(F.min("x").alias("x"))
    stats = vectors.agg(F.count("*").alias("n"), F.max(F.expr("aggregate(x, 0D, (a, v) -> a + v * v)")).alias("m")).first()
    if not stats["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = bounded(vectors, "id", sample, stats["n"])
    leaf = max(4, int(leaf_rows * min(1, len(drawn) / stats["n"])))
    tree = Tree(np.array([r["x"] for r in drawn], np.float64), float(np.sqrt(stats["m"])), leaf)
    shared = spark.sparkContext.broadcast(tree)  # at most sample / 4 leaves

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield part.assign(leaf=shared.value.assign(_matrix(part["x"])))

    placed = written(vectors.mapInPandas(assign, "id long, x array<double>, leaf int"), "leaves")
    sizes = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf
    trial = bounded(asked, "id", calibration)
    truth = exact(placed, trial, k).join(placed.select(F.col("id").alias("vec_id"), "leaf").dropDuplicates(["vec_id"]), "vec_id").select("query_id", "leaf").collect()
    wanted: dict[int, list[int]] = {}
    for r in truth:
        wanted.setdefault(r["query_id"], []).append(r["leaf"])
    ranks = []
    for r in trial:
        order = {name: i for i, name in enumerate(tree.leaves(np.array(r["x"])), 1)}
        ranks += [[order[name] for name in wanted.get(r["id"], [])]]
    visits, most = 1, len(tree.leaf_of)
    while visits < most and np.mean([np.mean([x <= visits for x in one]) for one in ranks if one] or [1]) < recall:
        visits += 1
    cell_of, cell, room = {}, 0, CELL  # leaves beside each other share a cell; a crowded leaf fills several
    for name in sorted(sizes):
        parts = -(-sizes[name] // CELL)
        for part in range(parts):
            need = min(CELL, -(-sizes[name] // parts))
            if need > room:
                cell, room = cell + 1, CELL
            cell_of[name, part] = cell
            room -= need
    cells: dict[int, list[int]] = {}
    for (name, _), c in cell_of.items():
        cells.setdefault(name, []).append(c)

    def visit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for i, x in zip(part["id"], part["x"]):
                held, n, seen = 0, 0, {}
                for name in shared.value.leaves(np.asarray(x, np.float64)):
                    n, held = n + 1, held + sizes.get(name, 0)
                    for c in set(cells.get(name, ())):
                        seen.setdefault(c, []).append(name)
                    if n >= visits and held > k:
                        break
                out += [(i, x, c, names) for c, names in seen.items()]
            yield pd.DataFrame(out, columns=["id", "x", "cell", "leaves"])

    visited = written(asked.mapInPandas(visit, "id long, x array<double>, cell int, leaves array<int>"), "visits")
    crowds = visited.groupBy("cell").agg(F.count("*").alias("n")).collect()  # a row for each cell
    dealt = spark.createDataFrame([(r["cell"], -(-r["n"] // CHUNK)) for r in crowds], "cell int, chunks int")
    where = spark.createDataFrame([(name, part, -(-sizes[name] // CELL), c) for (name, part), c in cell_of.items()], "leaf int, block int, blocks int, cell int")
    left = visited.join(F.broadcast(dealt), "cell").select("cell", F.pmod(F.xxhash64("id", F.lit(3)), "chunks").cast("int").alias("chunk"), "id", "x", "leaves")
    blocked = placed.join(F.broadcast(where.select("leaf", "blocks").distinct()), "leaf").withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), "blocks").cast("int"))
    right = blocked.join(F.broadcast(where.drop("blocks")), ["leaf", "block"]).join(F.broadcast(dealt), "cell")
    right = right.select("cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "x", "leaf")

    def compare(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return top(np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0, np.int64), k)
        names, leaf = np.unique(r["leaf"].to_numpy(), return_inverse=True)
        visits_of = np.array([np.isin(names, x) for x in q["leaves"]])
        return top(_matrix(q["x"]), q["id"].to_numpy(np.int64), _matrix(r["x"]), r["id"].to_numpy(np.int64), k, visits_of, leaf)

    found = left.groupBy("cell", "chunk").cogroup(right.groupBy("cell", "chunk")).applyInPandas(compare, _TOP)
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
