"""Sequence packing by cutting-stock column generation over the length histogram."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import text_batches, written

TARGET, GRID, END_ID, CACHED_WORDS, CHARS = 2048, 4, 1, 300_000, 4_000_000
#: Letters that NFC leaves alone and whose lower-case form is one letter, so that a word can be encoded by itself.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-įı-ſ]*")
#: The pre-tokenizer of the vocabulary file over that alphabet in lower case.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\sa-z0-9ß-öø-ſ]+")


class _Memo(dict):
    """Ids of frequent words; those of a batch's other words are in extra."""

    extra: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        return self.extra[word]


class WordEncoder:
    """Whole texts to ids, as the tokenizers library gives them, with the pieces of frequent words remembered.

    The vocabulary splits texts into words before merging, so a text in a plain alphabet is the concatenation of
    its words' ids. Any other text, or one that may spell a special token, goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.memo = Tokenizer.from_file(path), _Memo()

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """Per text its ids as little-endian unsigned 32-bit numbers, the end id included."""
        end = np.uint32(END_ID).tobytes()
        split = [_WORD.findall(t.lower()) if (t := x or "") is not None and _PLAIN.fullmatch(t) and "<|" not in t else None for x in texts]
        memo = self.memo
        missing = list(set().union(*[w for w in split if w]) - memo.keys())
        found = {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(missing, self.tok.encode_batch_fast(missing, add_special_tokens=False))}
        if len(memo) < CACHED_WORDS:
            memo.update(found)
            found = {}
        memo.extra = found
        for text, words in zip(texts, split):
            if words is None:
                yield np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + end
            else:
                yield b"".join(map(memo.__getitem__, words)) + end


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path)


def cuts(n: int, target: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, then a half if more is left, then the rest.

    A rest of more than half the target would seldom find a partner; two halves fill a sequence, and so do the
    many combinations of what is shorter.
    """
    half = target // 2
    out = [(at, target) for at in range(0, n - n % target, target)]
    at = n - n % target
    if n - at > half:
        out.append((at, half))
        at += half
    return [*out, (at, n - at)] if at < n else out


def pieces(docs: DataFrame, vocab: str, id_col: str = "doc_id", text: str = "text", target: int = TARGET, grid: int = GRID) -> DataFrame:
    """Tokenize whole texts and cut them: see cuts().

    Columns: id, start, length, ids_crc32, doc_tokens, class (length in grid steps, rounded up), and part, rank:
    a numbering of each class inside each input partition. Null and empty texts are one piece: the end id.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, seen, part = encoder(vocab), Counter(), TaskContext.get().partitionId()
        for frame in parts:
            out = []
            some = frame["text"].str.len().fillna(0).to_numpy().cumsum() // CHARS  # bounded memory
            for _, chunk in frame.groupby(some, sort=False):
                for i, ids in zip(chunk["id"], encode(chunk["text"].tolist())):
                    n = len(ids) // 4
                    for start, length in cuts(n, target):
                        c = -(-length // grid)
                        out.append((i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, c, part, seen[c]))
                        seen[c] += 1
            made = pd.DataFrame(out, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "rank"])
            yield made.astype({"id": "Int64"}) if made["id"].dtype == float else made

    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, rank long")


def price(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, dict[int, int]]:
    """Unbounded knapsack by dynamic programming: the most valuable pattern of sizes within the room."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        k = np.searchsorted(sizes, c, "right")
        if k:
            got = best[c - sizes[:k]] + value[:k]
            j = int(got.argmax())
            if got[j] > best[c] + 1e-12:
                best[c], took[c] = got[j], j
    pattern, c = Counter(), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[int(took[c])] += 1
            c -= sizes[took[c]]
    return float(best[room]), dict(pattern)


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 2e-4, most: int = 6000) -> list[tuple[float, dict[int, int]]]:
    """Solve the cutting-stock linear program: [(how often, {index of size: pieces})].

    Revised simplex: each round prices a new column by the knapsack program and stops once the dual bound shows
    the total within gap of the optimum.
    """
    m = len(sizes)
    patterns = [{i: int(room // s)} for i, s in enumerate(sizes)]
    inverse = np.diag([1.0 / p[i] for i, p in enumerate(patterns)])
    x = inverse @ demand
    for _ in range(most):
        dual = inverse.sum(axis=0)
        value, new = price(np.maximum(dual, 0), sizes, room)
        if value <= 1 + gap:
            break
        column = np.zeros(m)
        for i, n in new.items():
            column[i] = n
        way = inverse @ column
        up = way > 1e-9
        ratio = np.where(up, x / np.where(up, way, 1), np.inf)
        r = int(ratio.argmin())
        step = ratio[r]
        x = np.maximum(x - step * way, 0)
        x[r] = step
        row = inverse[r] / way[r]
        inverse -= np.outer(way, row)
        inverse[r] = row
        patterns[r] = new
    return list(zip(x.tolist(), patterns))


def plan(histogram: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """Whole patterns that hold exactly the pieces of the histogram {size: count}: [(how often, {size: pieces})].

    The program's patterns are rounded down; what is left is filled by those with the largest fractions while
    they fit, then by first-fit-decreasing patterns.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    out = [(n, {room: 1}) for n in [left.pop(room, 0)] if n]
    if not left:
        return out
    sizes = np.array(sorted(left))
    solved = column_generation(sizes, np.array([left[s] for s in sizes], float), room)
    for n, p in solved:
        p = {int(sizes[i]): a for i, a in p.items()}
        n = min([int(n + 1e-6), *(left[s] // a for s, a in p.items())])
        if n:
            out.append((n, p))
            for s, a in p.items():
                left[s] -= n * a
    for n, p in sorted(solved, key=lambda t: -(t[0] % 1)):
        p = {int(sizes[i]): a for i, a in p.items()}
        if all(left[s] >= a for s, a in p.items()):
            out.append((1, p))
            for s, a in p.items():
                left[s] -= a
    while any(left.values()):
        free, p = room, {}
        for s in sorted((s for s, n in left.items() if n), reverse=True):
            if a := min(left[s], free // s):
                p[s] = a
                free -= a * s
        n = min(left[s] // a for s, a in p.items())
        out.append((n, p))
        for s, a in p.items():
            left[s] -= n * a
    return out


def pack(docs: DataFrame, vocab: str, id_col: str = "doc_id", text: str = "text", target: int = TARGET, grid: int = GRID) -> DataFrame:
    """Pack whole documents into sequences of at most target tokens: one row for each piece.

    Columns: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document is cut at multiples
    of the target and at most once more, at a half; what is left stays whole. The histogram has target/grid classes at most, whatever the corpus,
    and is all that reaches the driver; documents are ranked inside each class through counts by input partition,
    so no class is gathered. Repeated rows and null ids are packed like any other; an empty table gives none.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, vocab, id_col, text, target, grid), "pieces")
    counts = written(cut.groupBy("class", "part").agg(F.count("*").alias("n")), "counts")
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # target/grid rows at most
    slots, at, base = [], Counter(), 0
    for n, p in plan(histogram, target // grid):
        for c, a in p.items():
            slots.append((c, at[c], at[c] + n * a, a, base))
            at[c] += n * a
        base += n
    table = spark.createDataFrame(slots, "class int, low long, high long, each long, base long")  # a few rows for each class
    before = counts.select("class", "part", (F.sum("n").over(Window.partitionBy("class").orderBy("part")) - F.col("n")).alias("before"))
    ranked = cut.join(before, ["class", "part"]).withColumn("place", F.col("before") + F.col("rank"))
    placed = ranked.join(F.broadcast(table), "class").where("place >= low AND place < high").withColumn("sequence_id", F.expr("base + (place - low) DIV each"))
    alone = placed.where(F.col("length") == target).withColumn("offset", F.lit(0).cast("long"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "part", "rank").rowsBetween(Window.unboundedPreceding, -1)
    shared = placed.where(F.col("length") < target).withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))
    out = alone.unionByName(shared)
    return out.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
