"""Language-model scores: a gated recurrent network in numpy with a class-factored softmax."""

from __future__ import annotations

import copy
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.sample import bounded, frequent
from sievework.session import text_batches, written

#: Rows that start the network; words kept by the scorer; words with an output of their own; words in a class;
#: clusters of the other words; width; streams and steps of a training window; epochs; streams and steps in scoring, and
#: characters scored at a time.
SAMPLE, KNOWN, HEAD, CLASS, CLUSTERS, WIDTH, STREAMS, STEPS, EPOCHS, SLOTS, WINDOW, CHARS = 1500, 131_072, 992, 32, 16, 16, 64, 20, 5, 1024, 64, 6_000_000
#: The share of all training rows that the network then learns from; tokens a shard; step; streams and tokens at a time.
SHARE, SHARD, RATE, WIDE, CHUNK = 1, 2_000_000, 0.0007, 128, 1_000_000
#: Distinct words that a worker counts, or remembers the codes of, before it lets go of them, about; rows of states
#: whose probabilities are taken at a time.
HELD, ROWS = 200_000, 8192
#: Logarithms up to which e to their power, and sums of these, keep to single precision.
FAR = 60
END = ""  # no word is empty
LN10 = float(np.log(10))


def words_of(text: str | None) -> list[bytes]:
    """The tokens of a whole text but the end: A-Z lower-cased, runs of anything but space and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "replace").lower().split()  # of bytes: at just these characters


def counts(docs: DataFrame, text: str = "text", held: int = HELD) -> DataFrame:
    """word, c over all rows, the end of each text being the empty word: summed by some `held` words, then by word."""

    def rows(seen: Counter, ends: int) -> pd.DataFrame:
        return pd.DataFrame({"word": [END, *[w.decode("utf-8", "replace") for w in seen]], "n": [ends, *seen.values()]})

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        ends = 0
        for part in parts:
            for t in part["_text"]:
                seen.update(words_of(t))
            ends += len(part)
            if len(seen) > held:
                yield rows(seen, ends)
                seen, ends = Counter(), 0
        yield rows(seen, ends)

    return docs.select(F.col(text).alias("_text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c")).where("c > 0")


def _order(x: np.ndarray, most: int) -> np.ndarray:
    """A stable order of numbers from 0 to most; sorting is linear where 16 bits hold them."""
    return np.argsort(x.astype(np.int16) if most < 1 << 15 else x, kind="stable")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class _Codes(dict):
    """The codes of the known words and of the others seen last."""

    def __init__(self, lex: Lexicon):
        super().__init__(lex.index)
        self.lex = lex

    def __missing__(self, w: bytes) -> int:
        code = self[w] = -1 - self.lex.cluster(w)
        return code


@dataclass
class Lexicon:
    """Classes of words. A head word has its own output in a head class; any other word is in a cluster by its
    first and last two bytes, where it is as likely as its count says."""

    index: dict[bytes, int]  # most frequent words, head first
    heads: int
    word_class: np.ndarray  # by head word: class
    word_slot: np.ndarray  # by head word: place in the class
    edge: dict[tuple[bytes, int], np.ndarray]  # naive Bayes over the edges of words
    prior: np.ndarray

    def __post_init__(self):
        self.n_class = (int(self.word_class.max()) + 1) if self.heads else 0
        self.memo: dict[tuple[bytes, bytes], int] = {}
        self.codes = _Codes(self)

    def cluster(self, w: bytes) -> int:
        key = (w[:2], w[-2:])
        t = self.memo.get(key)
        if t is None:
            none = np.zeros(len(self.prior))
            t = self.memo[key] = int((self.prior + self.edge.get((key[0], 0), none) + self.edge.get((key[1], 1), none)).argmax())
            if len(self.memo) > 1 << 20:
                self.memo.clear()
        return t

    def code(self, words: list[bytes]) -> np.ndarray:
        """The index of each known word, -1 - cluster of any other."""
        if len(self.codes) > len(self.index) + HELD:
            self.codes = _Codes(self)
        return np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "codes"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.codes = _Codes(self)


def lexicon(texts: list[list[bytes]], known: list[tuple[str, int]], heads: int = HEAD, clusters: int = CLUSTERS, seed: int = 5) -> Lexicon:
    """Cluster words by the frequent words of the documents they occur in; heads by cluster into classes."""
    index = {w.encode("utf-8", "replace"): i for i, (w, _) in enumerate(known)}
    heads = min(heads, len(known))
    top = {w: i for w, i in index.items() if i < min(64, heads)}
    ids: dict[bytes, int] = {}
    for t in texts:
        for w in set(t):
            ids.setdefault(w, len(ids))
    x = np.zeros((len(ids), max(1, len(top))), np.float32)
    for t in texts:
        profile = np.bincount([top[w] for w in t if w in top], minlength=x.shape[1]).astype(np.float32)
        x[[ids[w] for w in set(t)]] += np.sqrt(profile / max(1.0, profile.sum()))
    label, k = np.zeros(len(ids), np.int64), 1
    if len(ids) > clusters:
        x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
        rng, k = np.random.default_rng(seed), clusters
        centres = x[rng.choice(len(x), k, replace=False)]
        for _ in range(15):
            label = (x @ centres.T).argmax(axis=1)
            for j in range(k):
                if (label == j).any():
                    c = x[label == j].sum(axis=0)
                    centres[j] = c / max(1e-9, float(np.linalg.norm(c)))
        label = (x @ centres.T).argmax(axis=1)
    del x
    order = sorted(range(heads), key=lambda i: (label[ids[w]] if (w := known[i][0].encode("utf-8", "replace")) in ids else -1, i))
    word_class, word_slot = np.zeros(heads, np.int64), np.zeros(heads, np.int64)
    for at, i in enumerate(order):
        word_class[i], word_slot[i] = divmod(at, CLASS)
    edge: dict[tuple[bytes, int], np.ndarray] = {}
    prior = np.ones(k)
    for w, i in ids.items():
        if index.get(w, heads) >= heads:
            prior[label[i]] += 1
            for key in ((w[:2], 0), (w[-2:], 1)):
                edge.setdefault(key, np.full(k, 0.1))[label[i]] += 1
    size = prior + 10
    return Lexicon(index, heads, word_class, word_slot, {key: np.log(v / size) for key, v in edge.items()}, np.log(prior / prior.sum()))


class Network:
    """Embedding, one gated recurrent layer, softmax over classes and over the head words inside a class."""

    def __init__(self, inputs: int, classes: int, head_classes: int, width: int = WIDTH, seed: int = 3):
        r = np.random.default_rng(seed)
        d, f = width, np.float32
        self.d, self.head_classes = d, head_classes
        self.p = {
            "emb": (r.normal(0, 0.1, (inputs, d))).astype(f),
            "w": (r.normal(0, d**-0.5, (d, 3 * d))).astype(f),
            "u": (r.normal(0, d**-0.5, (d, 3 * d))).astype(f),
            "b": np.zeros(3 * d, f),
            "c": np.zeros(d, f),
            "wc": np.zeros((d, classes), f),
            "bc": np.zeros(classes, f),
            "wv": np.zeros((max(1, head_classes), d, CLASS), f),
            "bv": np.zeros((max(1, head_classes), CLASS), f),
        }

    def step(self, gx: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step from the input part of the gates: the new state and what the way back needs."""
        d = self.d
        gh = h @ self.p["u"]
        zr = _sigmoid(gh[:, : 2 * d] + gx[:, : 2 * d])
        z, r = zr[:, :d], zr[:, d:]
        m = gh[:, 2 * d :] + self.p["c"]
        n = r * m
        n += gx[:, 2 * d :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, m, n

    def log_probabilities(self, h: np.ndarray, cls: np.ndarray, slot: np.ndarray, want_grad: bool = False):
        """ln P(class) plus, for head classes, ln P(word | class); and the gradients of their sum if asked for.

        Rows are taken in the order of their classes, so that each head class is one run of them.
        """
        p, rows = self.p, np.arange(len(h))
        order = _order(cls, len(p["bc"]))
        h, cls, slot = h[order], cls[order], slot[order]
        ends = np.searchsorted(cls, np.arange(self.head_classes + 1))
        runs = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())) if b > a]

        most = max(1.0, float(h.max()), -float(h.min())) if len(h) else 1.0

        def softmax(x: np.ndarray, at: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
            """ln P of what is at each row's place; x, which is h @ w + b, becomes the gradient."""
            i = rows[: len(x)]
            if most * np.abs(w).sum(axis=-2).max() + np.abs(b).max() > FAR:  # no power of e is beyond the numbers else
                x -= x.max(axis=1, keepdims=True)
            own = x[i, at]
            np.exp(x, out=x)
            s = x @ np.ones(x.shape[1], x.dtype)
            if want_grad:
                x *= (-1 / s)[:, None]
                x[i, at] += 1
            return own - np.log(s)

        x = h @ p["wc"]
        x += p["bc"]
        out = softmax(x, cls, p["wc"], p["bc"])
        grad, dh = {}, None
        if want_grad:
            grad["wc"], grad["bc"], dh = h.T @ x, np.ones(len(x), x.dtype) @ x, x @ p["wc"].T
            grad["wv"], grad["bv"] = np.zeros_like(p["wv"]), np.zeros_like(p["bv"])
        n = int(ends[-1])
        x = np.empty((n, CLASS), h.dtype)
        for k, run in runs:
            np.matmul(h[run], p["wv"][k], out=x[run])
        if n:
            x += p["bv"][cls[:n]]
            out[:n] += softmax(x, slot[:n], p["wv"], p["bv"])
        back = np.empty_like(out)
        back[order] = out
        if not want_grad:
            return back
        for k, run in runs:
            np.matmul(h[run].T, x[run], out=grad["wv"][k])
            dh[run] += x[run] @ p["wv"][k].T
        if n:
            grad["bv"][[k for k, _ in runs]] = np.add.reduceat(x, [run.start for _, run in runs], axis=0)
        whole = np.empty_like(dh)
        whole[order] = dh
        return back, grad, whole

    def window(self, inp: np.ndarray, fresh: np.ndarray, cls: np.ndarray, slot: np.ndarray, weight: np.ndarray, h: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Truncated backpropagation through one window (steps x streams): sum of ln P, its gradients, last state.

        A symbol's part of the gates is the same wherever it stands: it is made once for each symbol of the window.
        """
        p, d = self.p, self.d
        steps, streams = inp.shape
        flat = inp.ravel()
        order = _order(flat, len(p["emb"]))
        ordered = flat[order]
        starts = np.nonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))[0]
        symbols, which = ordered[starts], np.empty(len(flat), np.int64)
        which[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(flat))))
        emb = p["emb"][symbols]
        gx = (emb @ p["w"] + p["b"])[which].reshape(steps, streams, 3 * d)
        h0, m, n, hs = (np.empty((steps, streams, d), gx.dtype) for _ in range(4))
        zr, gh = np.empty((steps, streams, 2 * d), gx.dtype), np.empty((streams, 3 * d), gx.dtype)
        z, r = zr[:, :, :d], zr[:, :, d:]
        anew = fresh.any(axis=1)
        for t in range(steps):  # as in step(), into place
            if anew[t]:
                h = np.where(fresh[t][:, None], 0, h)
            h0[t] = h
            np.matmul(h0[t], p["u"], out=gh)
            _sigmoid(np.add(gh[:, : 2 * d], gx[t, :, : 2 * d], out=zr[t]))
            np.add(gh[:, 2 * d :], p["c"], out=m[t])
            nt = np.multiply(r[t], m[t], out=n[t])
            nt += gx[t, :, 2 * d :]
            np.tanh(nt, out=nt)
            h = np.subtract(h0[t], nt, out=hs[t])
            h *= z[t]
            h += nt
        h = h.copy()  # what predicts is read before a new document drops it
        live = np.nonzero(weight.ravel())[0]
        every = len(live) == len(flat)
        hs = hs.reshape(-1, d)
        out, grad, dhs = self.log_probabilities(hs if every else hs[live], cls.ravel()[live], slot.ravel()[live], True)
        if not every:
            hs[:] = 0
            hs[live] = dhs
            dhs = hs
        dhs = dhs.reshape(steps, streams, d)
        by_n, by_z, by_r = (1 - z) * (1 - n * n), (h0 - n) * z * (1 - z), m * r * (1 - r)
        dh, dgx, dgh = np.zeros((streams, d), gx.dtype), np.empty_like(gx), np.empty_like(gx)
        ut = np.ascontiguousarray(p["u"].T)
        for t in range(steps - 1, -1, -1):
            dh += dhs[t]
            dn = dgx[t, :, 2 * d :]
            np.multiply(dh, by_n[t], out=dn)
            np.multiply(dh, by_z[t], out=dgh[t, :, :d])
            np.multiply(dn, by_r[t], out=dgh[t, :, d : 2 * d])
            np.multiply(dn, r[t], out=dgh[t, :, 2 * d :])
            dh *= z[t]
            dh += dgh[t] @ ut
            if anew[t]:
                dh[fresh[t]] = 0
        dgx[:, :, : 2 * d] = dgh[:, :, : 2 * d]
        dgh = dgh.reshape(-1, 3 * d)
        grad["u"] = h0.reshape(-1, d).T @ dgh
        grad["c"] = dgh[:, 2 * d :].sum(axis=0)
        dgx = dgx.reshape(-1, 3 * d)
        grad["b"] = np.ones(len(dgx), dgx.dtype) @ dgx
        grad["w"] = emb[which].T @ dgx
        place = (flat[:, None] * d + np.arange(d)).ravel()
        grad["emb"] = np.bincount(place, (dgx @ p["w"].T).ravel(), minlength=p["emb"].size).reshape(-1, d).astype(gx.dtype)
        return float(out.sum()), grad, h


def slots_of(lengths: np.ndarray, slots: int) -> list[list[int]]:
    """Deal documents out to so many streams of about equal length, the longest first; longest stream first."""
    import heapq

    queue = [(0, s) for s in range(min(slots, max(1, len(lengths))))]
    held: list[list[int]] = [[] for _ in queue]
    for i in np.argsort(-lengths, kind="stable"):
        n, s = heapq.heappop(queue)
        held[s].append(int(i))
        heapq.heappush(queue, (n + int(lengths[i]), s))
    return sorted(held, key=lambda x: -sum(int(lengths[i]) for i in x))


@dataclass
class Model:
    """The lexicon, the network, and the counts that tell words of a class apart."""

    lex: Lexicon
    net: Network
    log_count: np.ndarray  # by known word: log10(c + 0.1)
    log_mass: np.ndarray  # by cluster: log10 of the sum of c + 0.1 over its words and one unseen

    def __post_init__(self):
        lex = self.lex
        n = len(lex.index)
        self.known_cluster = np.zeros(n, np.int64)
        for w, i in lex.index.items():
            if i >= lex.heads:
                self.known_cluster[i] = lex.cluster(w)
        k = len(lex.prior)
        self.symbol_class = np.concatenate((lex.word_class[: lex.heads], lex.n_class + np.arange(k))).astype(np.int32)
        self.symbol_slot = np.concatenate((lex.word_slot[: lex.heads], np.zeros(k, np.int64))).astype(np.int32)

    def symbols(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of each coded token, which names its class and slot, and what its cluster adds to its log10 P: for
        words beyond the heads, their part of the cluster (of those not known, without log10(c + 0.1))."""
        lex, n = self.lex, len(self.known_cluster)
        if not hasattr(self, "by_code"):  # by code, those of the clusters (from -1 down) at the end
            k = np.arange(len(lex.prior))[::-1]
            add = np.concatenate((self.log_count - self.log_mass[self.known_cluster], -self.log_mass[k]))
            add[: lex.heads] = 0
            self.by_code = np.concatenate((np.arange(lex.heads), lex.heads + self.known_cluster[lex.heads :], lex.heads + k)).astype(np.uint16), add
        assert len(self.by_code[1]) == n + len(lex.prior)
        return self.by_code[0][code], self.by_code[1][code]

    def end_symbol(self) -> int:
        return int(self.symbols(np.array([self.lex.index.get(b"", -1)]))[0][0])

    def arrays(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input symbol, class and slot of each coded token."""
        lex, head = self.lex, (code >= 0) & (code < self.lex.heads)
        cluster = np.where(code >= 0, self.known_cluster[np.maximum(code, 0)] if len(self.known_cluster) else 0, -1 - code)
        safe = np.where(head, code, 0)
        symbol = np.where(head, code, lex.heads + cluster)
        cls = np.where(head, lex.word_class[safe] if lex.heads else 0, lex.n_class + cluster)
        return symbol, cls, np.where(head, lex.word_slot[safe] if lex.heads else 0, 0)

    def scores(self, codes: list[np.ndarray]) -> np.ndarray:
        """log10 P of coded documents, but for log10(c + 0.1) of the words that are not known."""
        both = [self.symbols(c) for c in codes]
        return self.symbol_scores([x for x, _ in both]) + np.array([a.sum() for _, a in both]) if codes else np.zeros(0)

    def symbol_scores(self, symbols: list[np.ndarray]) -> np.ndarray:
        """log10 P of the symbols of documents.

        Streams of whole documents run side by side in windows; the state is carried from window to window and is
        zero at the start of a document, whose first input is the end symbol.
        """
        if not symbols:
            return np.zeros(0)
        net, p = self.net, self.net.p
        table = p["emb"] @ p["w"] + p["b"]
        lengths = np.array([len(c) for c in symbols])
        held = slots_of(lengths, SLOTS)
        total = np.zeros(len(symbols))
        end = self.end_symbol()
        docs = np.array([i for s in held for i in s], np.int64)
        symbol = np.concatenate([symbols[i] for i in docs])  # stream after stream
        cls, slot = self.symbol_class[symbol], self.symbol_slot[symbol]
        owner = np.repeat(docs, lengths[docs])
        fresh = np.zeros(len(symbol), bool)
        fresh[np.cumsum(lengths[docs]) - lengths[docs]] = True
        before = np.concatenate((symbol[:1], symbol[:-1]))
        before[fresh] = end
        sizes = np.array([int(lengths[s].sum()) for s in held])
        starts = np.cumsum(sizes) - sizes
        h = np.zeros((len(held), net.d), np.float32)
        for at in range(0, int(sizes.max()), WINDOW):
            live = int((sizes > at).sum())
            n = np.minimum(sizes[:live] - at, WINDOW)
            steps = int(n.max())
            mask = np.arange(steps)[:, None] < n
            where = np.where(mask, starts[:live] + at + np.arange(steps)[:, None], 0)
            inp, anew = before[where], fresh[where] & mask
            some = anew.any(axis=1)
            hs = np.empty((steps, live, net.d), np.float32)
            state = h[:live]
            for t in range(steps):
                if some[t]:
                    state = np.where(anew[t][:, None], 0, state)
                state = hs[t] = net.step(table.take(inp[t], axis=0), state)[0]
            h = state
            flat, where = (hs.reshape(-1, net.d), where.ravel()) if mask.all() else (hs[mask], where[mask])
            for a in range(0, len(flat), ROWS):
                i = where[a : a + ROWS]
                total += np.bincount(owner[i], net.log_probabilities(flat[a : a + ROWS], cls[i], slot[i]) / LN10, minlength=len(symbols))
        return total


class Adam:
    """Steps up the gradient by Adam, clipped, for the parameters of one network."""

    def __init__(self, net: Network):
        self.net, self.t = net, 0
        self.m1, self.m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))

    def step(self, grad: dict, n: int, rate: float) -> None:
        self.t += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grad.values())) / n
        scale = min(1.0, 1.0 / max(norm, 1e-9)) / n
        for k, g in grad.items():
            m1, m2 = self.m1[k], self.m2[k]
            g *= scale
            m1 *= 0.9
            m1 += 0.1 * g
            g *= g
            g *= 0.001
            m2 *= 0.999
            m2 += g
            g = np.sqrt(m2 / (1 - 0.999**self.t), out=g)
            g += 1e-6
            np.divide(m1, g, out=g)
            g *= rate / (1 - 0.9**self.t)
            self.net.p[k] += g


def epoch(model: Model, symbols: list[np.ndarray], adam: Adam, rate: float, streams: int) -> None:
    """One pass over documents as symbols, dealt to streams side by side, by truncated backpropagation in windows."""
    held = slots_of(np.array([len(c) for c in symbols]), streams)
    longest = max(sum(len(symbols[i]) for i in s) for s in held)
    inp, out = (np.zeros((longest, len(held)), np.int32) for _ in range(2))
    fresh, weight = np.zeros((longest, len(held)), bool), np.zeros((longest, len(held)), bool)
    first = model.end_symbol()
    for s, docs in enumerate(held):
        row = np.concatenate([symbols[i] for i in docs])
        n, sizes = len(row), np.array([len(symbols[i]) for i in docs])
        starts = np.cumsum(sizes) - sizes
        out[:n, s], inp[1:n, s], weight[:n, s] = row, row[:-1], True
        inp[starts, s], fresh[starts, s] = first, True
    cls, slot = model.symbol_class[out], model.symbol_slot[out]
    h = np.zeros((len(held), model.net.d), np.float32)
    for at in range(0, longest, STEPS):
        live = int(weight[at].sum())  # the longest streams come first, so those that go on are the first ones
        if not live:
            break
        part = (slice(at, at + STEPS), slice(0, live))
        _, grad, h = model.net.window(inp[part], fresh[part], cls[part], slot[part], weight[part], h[:live])
        adam.step(grad, int(weight[part].sum()), rate)


def train(texts: list[list[bytes]], lex: Lexicon, known: list[tuple[str, int]], model: Model, epochs: int = EPOCHS, rate: float = 0.01) -> None:
    """Start the network in place from documents (token lists with the end left out), by Adam over truncated windows."""
    end = lex.index.get(b"", 0)
    codes = [np.append(lex.code(t), end) for t in texts]
    if not codes:
        return
    net = model.net
    count = np.zeros(len(net.p["bc"]))
    for c in codes:
        count += np.bincount(model.arrays(c)[1], minlength=len(count))
    net.p["bc"][:] = np.log((count + 0.5) / (count + 0.5).sum())
    for i, (_, c) in enumerate(known[: lex.heads]):
        net.p["bv"][lex.word_class[i], lex.word_slot[i]] = np.log(c)
    filled = np.zeros_like(net.p["bv"], bool)
    filled[lex.word_class, lex.word_slot] = True
    net.p["bv"][~filled] = -30
    adam = Adam(net)
    for turn in range(epochs):
        epoch(model, [model.symbols(c)[0] for c in codes], adam, rate * 0.5**turn, STREAMS)
        net.p["bv"][~filled] = -30


def coded(docs: DataFrame, model: Model) -> DataFrame:
    """docs (id, text, held, h) without texts: part and row (which name a row), id, held, h, n (tokens), known (tokens
    whose count the model holds), head (the sum of their log10(c + 0.1)), model (what clusters add to the model's
    score), symbols (of 16 bits), tail (the other words)."""
    light = copy.copy(model)
    light.net = None  # codes are the same whatever the network has learned
    shared = docs.sparkSession.sparkContext.broadcast(light)

    def code(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, part_no, row = shared.value, TaskContext.get().partitionId(), 0
        for whole in parts:
            size = whole["text"].str.len().fillna(0).to_numpy().cumsum() // CHARS  # bounded memory: some texts at a time
            for _, part in whole.groupby(size, sort=False):
                words = [words_of(t) for t in part["text"]]
                for w in words:
                    w.append(b"")
                lengths = np.array([len(w) for w in words])
                flat = list(chain.from_iterable(words))
                codes = m.lex.code(flat)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                symbols, add = m.symbols(codes)
                known = codes >= 0
                off = np.nonzero(~known)[0]
                head = np.where(known, m.log_count[codes * known], 0.0)
                tail = [flat[i].decode("utf-8", "replace") for i in off]
                cut = np.searchsorted(off, np.append(starts, len(flat)))
                sums = {k: np.add.reduceat(x, starts) for k, x in (("known", known.astype(np.int64)), ("head", head), ("model", add))}
                yield pd.DataFrame({
                    "part": part_no, "row": np.arange(row, row + len(part)), "id": part["id"].array, "held": part["held"].array, "h": part["h"].array, "n": lengths, **sums,
                    "symbols": [symbols[a:b].tobytes() for a, b in zip(starts, ends)], "tail": [tail[a:b] for a, b in zip(cut, cut[1:])],
                })
                row += len(part)

    return docs.mapInPandas(code, f"part int, row long, id {dict(docs.dtypes)['id']}, held boolean, h long, n long, known long, head double, model double, symbols binary, tail array<string>")


def refine(learn: DataFrame, model: Model, tokens: int, share: float = SHARE, shard: int = SHARD, rate: float = RATE) -> int:
    """Go on training the network in place on a fixed share of all rows (id, text), however many: the tokens it saw.

    learn may hold the symbols of the texts in their place, and h, the hash of id and text. Rows are picked and dealt
    to shards by that hash, so that shards are the same wherever they lie.
    Every shard takes one pass of truncated backpropagation from the same start; the weights are then averaged, by
    tokens, first in groups on the executors and last on the driver, which holds as many sets of weights as the
    square root of the shards.
    """
    if not tokens:
        return 0
    shards = max(1, int(tokens * share / shard))
    if "symbols" not in learn.columns:
        learn = coded(learn.select("id", "text", F.lit(False).alias("held"), F.xxhash64("id", "text").alias("h")), model)
    picked = learn.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20))).select("h", "symbols")
    dealt = picked.repartition(shards, "h").sortWithinPartitions("h").select("symbols")
    shared = learn.sparkSession.sparkContext.broadcast(model)
    names = list(model.net.p)

    def pass_over(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = copy.copy(shared.value)
        m.net = copy.deepcopy(m.net)
        adam, seen, held, size = Adam(m.net), 0, [], 0

        def learn_from() -> None:
            nonlocal seen, held, size
            if held:
                epoch(m, held, adam, rate, WIDE)
                seen += size
            held, size = [], 0

        for part in parts:
            for x in part["symbols"]:
                held.append(np.frombuffer(x, np.uint16))
                size += len(held[-1])
                if size >= CHUNK:  # bounded memory: some texts at a time
                    learn_from()
        learn_from()
        if seen:
            flat = np.concatenate([m.net.p[k].ravel() for k in names]).astype(np.float64) * seen
            yield pd.DataFrame({"group": [TaskContext.get().partitionId() % groups], "seen": [seen], "sums": [flat.tobytes()]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in part["sums"])
        return pd.DataFrame({"group": [part["group"].iloc[0]], "seen": [int(part["seen"].sum())], "sums": [total.tobytes()]})

    groups, schema = math.isqrt(shards) + 1, "group int, seen long, sums binary"
    found = dealt.mapInPandas(pass_over, schema).groupBy("group").applyInPandas(add, schema).collect()
    seen = sum(r["seen"] for r in found)
    if seen:
        flat, at = sum(np.frombuffer(r["sums"]) for r in found) / seen, 0
        for k in names:
            p = model.net.p[k]
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
    return seen


def scored(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, known: int = KNOWN, share: float = SHARE) -> DataFrame:
    """Score every whole text: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: a Column over docs; rows where it is true are scored and never learned from (null is false). Counts
    cover all training rows. The network and the clusters of words start from at most `sample` of them, in hash order
    of the key; then the network goes on over a `share` of all of them: every one, if no less is asked. The `known` most frequent words are resolved where texts are scored; any other word goes back to the table of all
    counts through a join, so no count is cut off. Null and empty texts are one end token; repeated rows and null
    keys are scored like any other. The score is a normalized probability: class, then word in its class.
    """
    spark = docs.sparkSession
    text_batches(spark)
    base = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    learn = base.where(~F.col("held"))
    table = written(counts(learn), "counts")
    sums = table.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(sums["n"]), int(sums["v"])
    top = frequent(table, known, END)
    rows = top[0][1] if total else 0  # the end was counted once for each text
    texts = [words_of(r["text"]) for r in bounded(learn.select("id", "text"), "id", sample, rows)]
    lex = lexicon(texts, top)
    k = len(lex.prior)
    log_count = np.log10(np.array([c for _, c in top]) + 0.1)
    mass = np.full(k, 0.1)
    index = {w for w, i in lex.index.items() if i < lex.heads}

    def weigh(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got: Counter = Counter()
            for w, c in zip(part["word"], part["c"]):
                w = w.encode("utf-8", "replace")
                if w not in index:
                    got[lex.cluster(w)] += c + 0.1
            yield pd.DataFrame({"t": list(got), "m": [float(x) for x in got.values()]})

    for r in table.mapInPandas(weigh, "t int, m double").groupBy("t").agg(F.sum("m").alias("m")).collect():
        mass[r["t"]] += r["m"]
    net = Network(lex.heads + k, lex.n_class + k, lex.n_class)
    model = Model(lex, net, log_count, np.log10(mass))
    train(texts, lex, top, model)
    codes = written(coded(base.withColumn("h", F.xxhash64("id", "text")), model), "coded")
    refine(codes.where(~F.col("held")), model, total, share)
    shared = spark.sparkContext.broadcast(model)  # bounded by known words and the width

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for whole in parts:
            for _, part in whole.groupby(whole["n"].to_numpy().cumsum() // CHUNK, sort=False):
                yield part.drop(columns="symbols").assign(model=part["model"] + m.symbol_scores([np.frombuffer(x, np.uint16) for x in part["symbols"]]))

    first = codes.drop("tail", "h")
    first = first.mapInPandas(score, first.drop("symbols").schema)
    rest = codes.select("part", "row", F.explode("tail").alias("word")).join(table, "word", "left")
    rest = rest.groupBy("part", "row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("more"), F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("seen"))
    out = first.join(rest, ["part", "row"], "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
    ends_known = F.lit(0 if total else 1)  # with no training rows even the end is unknown
    each = float(np.log10(total + 0.1 * (distinct + 1)))
    head = F.col("head") if total else F.lit(-1.0)  # the end's log10(0 + 0.1)
    return out.select(
        F.col("id").alias(key),
        F.col("held").alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") - ends_known + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (head + F.col("more") - F.col("n") * F.lit(each)).alias("base_score"),
        (F.col("model") + F.col("more")).alias("score"),
    )
