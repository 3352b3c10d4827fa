"""SentencePiece encoding and decoding: best segmentation by a max-plus scan over chunks."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import text_batches, written

CHUNK, SEGMENT, CACHED_WORDS = 1 << 16, 64, 100_000
NONE = -np.inf
SPACE = "▁"
little_endian = np.little_endian and array("I").itemsize == 4


def zipf(score: float) -> float:
    """The log probability of a piece whose score is its negative merge rank: that of its rank in a Zipf law.

    In steps of 2^-20, so that sums are exact in any order and a chunked text scores as the whole one does.
    """
    return -round((math.log(1 - score) + 2.4) * (1 << 20)) / (1 << 20)


class Vocabulary:
    """The pieces of a model file and the best segmentation of any text under the sum of their scores.

    Text is normalized as the file asks: one space before it and spaces as U+2581. A character without a piece is
    its UTF-8 bytes and scores ten less than the worst piece. Ties go to the longer last piece.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece, self.score, self.id, prefix = [], {}, {}, set()
        worst = 0.0
        self.byte = {}
        for i in range(sp.get_piece_size()):
            p, s = sp.id_to_piece(i), float(sp.get_score(i))
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.piece.append(p)
            elif sp.is_control(i) or sp.is_unknown(i):
                self.piece.append("")
            else:
                self.piece.append(p)
                s = zipf(s)
                self.id[p], self.score[p] = i, s
                worst = min(worst, s)
                prefix.update(p[:k] for k in range(1, len(p) + 1))
        self.unknown, self.longest = worst - 10, max(map(len, self.id))
        #: characters that no longer piece holds: hard boundaries on both sides
        joined = {c for p in self.id if len(p) > 1 for c in p}
        self.alone = "".join(c for c in "\n\r\t\v\f" if c not in joined)
        self.words = self._boundaries()
        #: score of each piece, none for what only begins one
        self.arc = {p: self.score.get(p) for p in prefix}
        self.tree = self._tree(prefix)
        #: score of each id: a character without a piece costs once, at its first byte
        self.by_id = np.zeros(len(self.piece))
        self.by_id[list(self.id.values())] = [self.score[p] for p in self.id]
        self.by_id[np.array([i for b, i in self.byte.items() if not 0x80 <= b < 0xC0], int)] = self.unknown
        self.is_byte = np.zeros(len(self.piece), bool)
        self.is_byte[np.array(list(self.byte.values()), int)] = True
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.memo: dict[str, bytes] = {}

    def _tree(self, prefix: set[str]) -> dict:
        """The pieces by their characters: each leads to the score of what it ends, if any, and to what may follow."""
        none: dict = {}
        inner = {p[:-1]: {} for p in prefix}
        for p in prefix:
            inner[p[:-1]][p[-1]] = (self.score.get(p), inner.get(p, none))
        return inner.get("", none)

    def _boundaries(self) -> re.Pattern:
        """A pattern whose matches no piece crosses: spaces and a run of letters, or of other characters.

        Read off the pieces: if one joins letters and others, or a space after something else, less is split.
        """
        letter, a = re.compile(r"[^\W\d_]"), re.escape(self.alone)
        pairs = {(x, y) for p in self.id for x, y in zip(p, p[1:])}
        odd = {c for x, y in pairs if SPACE not in (x, y) and bool(letter.match(x)) != bool(letter.match(y)) for c in (x, y) if letter.match(c)}
        is_letter = lambda c: bool(letter.match(c)) and c not in odd
        o = re.escape("".join(sorted(odd)))
        if any(y == SPACE != x for x, y in pairs):
            return re.compile(r"[\s\S]+")
        if any(SPACE not in (x, y) and is_letter(x) != is_letter(y) for x, y in pairs):
            return re.compile(rf"[{a}]|{SPACE}+[^{SPACE}{a}]*|[^{SPACE}{a}]+" if a else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        return re.compile((rf"[{a}]|" if a else "") + rf"{SPACE}*[^\W\d_{o}]+|{SPACE}*(?:[\d_{o}]|[^\w{SPACE}{a}])+|{SPACE}+")

    def arcs(self, t: str, i: int, end: int) -> Iterator[tuple[int, float]]:
        """(end, score) of the pieces that start at i; the character alone if it has none."""
        single = False
        for j in range(i + 1, min(end, i + self.longest) + 1):
            w = t[i:j]
            s = self.arc.get(w, 0)
            if s == 0:  # no piece begins so
                break
            if s is not None:
                single |= j == i + 1
                yield j, s
        if not single:
            yield i + 1, self.unknown

    def forward(self, t: str, start: int, end: int) -> tuple[list[float], list[int]]:
        """Best score and last start of each prefix of t[start:end]."""
        n = end - start
        best, back = [NONE] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            b = best[i]
            if b != NONE:
                for j, s in self.arcs(t, start + i, end):
                    j -= start
                    if b + s > best[j]:
                        best[j], back[j] = b + s, i
        return best, back

    def ids(self, t: str, cuts: list[int]) -> bytes:
        out = []
        for a, b in zip(cuts, cuts[1:]):
            i = self.id.get(t[a:b])
            out += [i] if i is not None else [self.byte.get(c, 0) for c in t[a:b].encode("utf-8", "replace")]
        return array("I", out).tobytes() if little_endian else np.array(out, "<u4").tobytes()

    def trace(self, t: str, start: int, end: int) -> list[int]:
        _, back = self.forward(t, start, end)
        cuts, j = [end], end - start
        while j:
            j = back[j]
            cuts.append(start + j)
        return cuts[::-1]

    def word(self, w: str) -> bytes:
        n, get, unknown = len(w), self.tree.get, self.unknown
        best, back = [NONE] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i, c in enumerate(w):
            b, got, j = best[i], get(c), i + 1
            s, rest = got or (None, None)
            s = b + (s or unknown)
            if s > best[j]:
                best[j], back[j] = s, i
            if not rest:  # no longer piece begins so
                continue
            for c in w[j:]:
                got = rest.get(c)
                if got is None:
                    break
                s, rest = got
                j += 1
                if s is not None and b + s > best[j]:
                    best[j], back[j] = b + s, i
        cuts, j = [n], n
        while j:
            j = back[j]
            cuts.append(j)
        return self.ids(w, cuts[::-1])

    def encode(self, t: str) -> tuple[bytes, float]:
        """Ids (little-endian unsigned 32-bit) and score of a normalized text; words between hard boundaries are remembered."""
        words, memo, extra = self.words.findall(t), self.memo, {}
        for w in set(words):
            if w not in memo:
                if len(memo) < CACHED_WORDS and len(w) < 32:
                    memo[w] = self.word(w)
                else:
                    extra[w] = self.word(w)
        ids = b"".join([memo[w] if w in memo else extra[w] for w in words]) if extra else b"".join(map(memo.__getitem__, words))
        return ids, float(self.by_id[np.frombuffer(ids, "<u4")].sum())

    def boundaries(self, t: str, n: int) -> list[int]:
        """The hard boundaries of t up to position n, its start left out."""
        return [m.start() for m in self.words.finditer(t) if 0 < m.start() <= n]

    def transfer(self, t: str, n: int) -> np.ndarray:
        """Max-plus matrix of a chunk t[:n], with what follows it as lookahead: [overhang in, overhang out].

        State a: the piece before ends a characters into the chunk. Boundary pieces never cross meet all paths, so
        only the ends before the first and after the last of them depend on the state.
        """
        k = self.longest
        m = np.full((k, k), NONE)
        hard = self.boundaries(t, n)
        first, last = (hard[0], hard[-1]) if hard else (None, 0)
        # the lookahead may hold a boundary too: no path crosses it, which arcs() sees by itself

        def ends(start: int) -> np.ndarray:
            out = np.full(k, NONE)
            best, _ = self.forward(t, start, n)
            out[0] = best[n - start]
            for i in range(max(start, n - k + 1), n):
                if best[i - start] != NONE:
                    for j, s in self.arcs(t, i, min(len(t), n + k - 1)):
                        if j > n:
                            out[j - n] = max(out[j - n], best[i - start] + s)
            return out

        if not hard:
            for a in range(min(k, n + 1)):
                m[a] = ends(a)
            return m
        middle = self.encode(t[first:last])[1] + ends(last)
        for a in range(min(k, first + 1)):
            m[a] = self.forward(t, a, first)[0][-1] + middle
        return m

    def between(self, t: str, n: int, a: int, b: int) -> bytes:
        """The ids of a chunk's pieces on the best path from overhang a to overhang b."""
        if b == 0:
            return self.ids(t, self.trace(t, a, n)) if not (hard := self.boundaries(t, n)) or hard[0] < a else self.ids(t, self.trace(t, a, hard[0])) + self.encode(t[hard[0] : n])[0]
        hard = [x for x in self.boundaries(t, n) if x >= a]
        at, head = (hard[-1], self.ids(t, self.trace(t, a, hard[0])) + self.encode(t[hard[0] : hard[-1]])[0]) if hard else (a, b"")
        best, _ = self.forward(t, at, n)
        options = [(best[i - at] + s, -i) for i in range(max(at, n - self.longest + 1), n) if best[i - at] != NONE for j, s in self.arcs(t, i, n + b) if j == n + b]
        i = -max(options)[1]
        return head + self.ids(t, [*self.trace(t, at, i), n + b])

    def decode(self, ids: bytes) -> str:
        """Text of ids: pieces joined, runs of byte pieces decoded, spaces restored, the one before the text dropped."""
        numbers = np.frombuffer(ids, "<u4")
        at = np.nonzero(self.is_byte[numbers])[0]
        get, n = self.piece.__getitem__, numbers.tolist()
        out, last = [], 0
        for run in np.split(at, np.nonzero(np.diff(at) > 1)[0] + 1) if len(at) else ():
            out.append("".join(map(get, n[last : run[0]])))
            last = int(run[-1]) + 1
            out.append(bytes(self.byte_of[i] for i in n[run[0] : last]).decode("utf-8", "replace"))
        text = "".join([*out, "".join(map(get, n[last:]))])
        return text.replace(SPACE, " ")[1:]


def normalized(text: str | None) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker."""
    return Vocabulary(path)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The associative max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def states(matrices: list[np.ndarray], a: int, b: int) -> list[int]:
    """The states at the boundaries of a run of chunks on the best path from state a to state b."""
    k = len(matrices[0])
    best, back = np.full(k, NONE), []
    best[a] = 0
    for m in matrices:
        through = best[:, None] + m
        back.append(through.argmax(axis=0))
        best = through.max(axis=0)
    out = [b]
    for way in reversed(back):
        out.append(int(way[out[-1]]))
    return out[::-1]


def encode(docs: DataFrame, model: str, text: str = "text", to: str = "ids", score: str = "score", chunk: int = CHUNK) -> DataFrame:
    """Add ids (binary, little-endian unsigned 32-bit) and score of the best segmentation of every whole text.

    Texts of at most `chunk` characters are segmented in one piece. A giant one is split into chunks; each gives a
    transfer matrix between the states at its two ends; matrices are multiplied in segments, and these by document;
    the states found go back down, and every chunk is traced by itself. Null and empty texts have no ids and score 0.
    Rows with equal giant texts share one segmentation, so null or repeated ids do not matter.
    """
    text_batches(docs.sparkSession)
    boxed = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    giant = boxed.where(F.length("_text") > chunk).select(F.sha2("_text", 256).alias("key"), "_text").dropDuplicates(["key"])

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for part in parts:
            for key, t in zip(part["key"], part["_text"]):
                t = normalized(t)
                for no, at in enumerate(range(0, len(t), chunk)):
                    yield pd.DataFrame({"key": [key], "no": [no], "n": [min(chunk, len(t) - at)], "t": [t[at : at + chunk + v.longest - 1]]})

    chunks = written(giant.mapInPandas(split, "key string, no int, n int, t string").repartition("key", "no"), "chunks")

    def matrix(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for part in parts:
            yield pd.DataFrame({"key": part["key"], "no": part["no"], "seg": part["no"] // SEGMENT, "m": [v.transfer(t, n).tobytes() for t, n in zip(part["t"], part["n"])]})

    matrices = written(chunks.mapInPandas(matrix, "key string, no int, seg int, m binary"), "matrices")

    def load(m: bytes) -> np.ndarray:
        flat = np.frombuffer(m, np.float64)
        return flat.reshape(int(len(flat) ** 0.5), -1)

    def multiply(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("no")
        total = load(part["m"].iloc[0])
        for m in part["m"].iloc[1:]:
            total = combine(total, load(m))
        return pd.DataFrame({"key": [part["key"].iloc[0]], "seg": [part["seg"].iloc[0]], "m": [total.tobytes()]})

    segments = matrices.groupBy("key", "seg").applyInPandas(multiply, "key string, seg int, m binary")

    def across(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seg")
        got = states([load(m) for m in part["m"]], 0, 0)
        return pd.DataFrame({"key": part["key"], "seg": part["seg"], "a": got[:-1], "b": got[1:]})

    outer = segments.groupBy("key").applyInPandas(across, "key string, seg int, a int, b int")

    def within(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("no")
        ms = [load(m) for m in part["m"]]
        got = states(ms, int(part["a"].iloc[0]), int(part["b"].iloc[0]))
        return pd.DataFrame({"key": part["key"], "no": part["no"], "a": got[:-1], "b": got[1:], "s": [m[x, y] for m, x, y in zip(ms, got, got[1:])]})

    inner = matrices.join(outer, ["key", "seg"]).groupBy("key", "seg").applyInPandas(within, "key string, no int, a int, b int, s double")

    def back(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for part in parts:
            yield pd.DataFrame({"key": part["key"], "no": part["no"], "s": part["s"], "ids": [v.between(t, n, a, b) for t, n, a, b in zip(part["t"], part["n"], part["a"], part["b"])]})

    traced = chunks.join(inner, ["key", "no"]).mapInPandas(back, "key string, no int, s double, ids binary")
    ordered = F.sort_array(F.collect_list(F.struct("no", "ids", "s")))  # the chunks of one text
    whole = traced.groupBy("key").agg(ordered.alias("c")).select("key", F.expr("reduce(c, unhex(''), (x, y) -> concat(x, y.ids))").alias("gids"), F.expr("aggregate(c, 0D, (x, y) -> x + y.s)").alias("gscore"))
    whole = written(whole, "giants")

    @F.pandas_udf("ids binary, score double")
    def direct(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for s in parts:
            got = [v.encode(normalized(t)) for t in s]
            yield pd.DataFrame({"ids": [x[0] for x in got], "score": [x[1] for x in got]})

    is_giant = F.length("_text") > chunk
    short = boxed.where(~F.coalesce(is_giant, F.lit(False))).withColumn("_got", direct("_text")).select("_row", "_got")
    long = boxed.where(is_giant).withColumn("key", F.sha2("_text", 256)).join(whole, "key").select("_row", F.struct(F.col("gids").alias("ids"), F.col("gscore").alias("score")).alias("_got"))
    both = short.unionByName(long)
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in (to.lower(), score.lower())]
    return both.select(*kept, F.col("_got.ids").alias(to), F.col("_got.score").alias(score))


def decode(rows: DataFrame, model: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the text of a binary id column; null ids give null, no ids an empty text."""

    @F.pandas_udf("string")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(model)
        for s in parts:
            yield pd.Series([None if x is None else v.decode(x) for x in s], dtype=object)

    return rows.withColumn(to, udf(F.col(ids)))
