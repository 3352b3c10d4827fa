"""HTML main-text extraction by minimum-cut labelling of blocks."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.sample import bounded
from sievework.session import text_batches

#: Pages that the classifier learns from, and the most bytes of one; how far labels are smoothed over neighbours in
#: page order, in one element or not, and over siblings; the most that a tag or class may say; elements deeper than
#: this add no level.
SAMPLE_PAGES, SAMPLE_BYTES = 400, 1 << 18
ADJACENT, APART, SIBLING = 1.2, 0.1, 0.9
MOST_BOILER, MOST_CONTENT, DEEPEST = 6.0, 2.0, 512
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Elements whose content is never text, and elements that do not break a line of text.
RAW = frozenset("script style noscript template textarea svg math iframe object canvas audio video select option datalist head title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, roles and class words that speak for boilerplate or for content.
BOILER_TAGS = frozenset("nav footer aside form button menu dialog fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
BOILER_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert disclaimer nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side aside rail widget widgets footer foot copyright masthead topbar header comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations popular trending newsletter subscribe subscription signup login popup modal overlay toolbar pagination pager tags taglist skip hidden".split())
CONTENT_TAGS = frozenset("article main".split())
CONTENT_WORDS = frozenset("article articlebody content post entry story main maincontent text body".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
FEATURES = ("bias", "length", "links", "paragraph", "heading", "item", "stops", "boiler", "content")
TEXTUAL = 7  # so many of them are of the text, the others of the elements around it
#: The weights before any page is seen.
PRIOR = np.array([-1.0, 2.8, -4.0, 1.5, 0.5, -0.5, 0.6, -MOST_BOILER / 2, MOST_CONTENT / 2])


@dataclass
class Block:
    """A run of text between block-level tags: the number of its element, and of the one around that."""

    up: int
    tag: str
    semantic: float
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    size: int = 0
    text: str = ""


def _evidence(tag: str, attributes: str, inside: bool) -> tuple[float, bool]:
    """What an element says of the text in it, and whether that text is not shown."""
    said, gone = 0.0, False
    if tag in BOILER_TAGS:
        said -= 10
    elif tag == "header":
        said -= 3 if inside else 10
    elif tag in CONTENT_TAGS:
        said += 4
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                gone = True
            elif name == "role":
                said += 4 if value.lower() in ("main", "article") else -10 if value.lower() in BOILER_ROLES else 0
            elif name in ("class", "id", "itemprop") and tag not in ("body", "html"):
                words = {w.lower() for w in _TOKEN.findall(value)} | {re.sub(r"[^a-z]", "", w.lower()) for w in value.split()}
                if words & BOILER_WORDS:
                    said -= 10
                elif words & CONTENT_WORDS:
                    said += 2
    return said, gone


class Scanner:
    """The markup of a page from left to right, in time that grows with its length however malformed it is.

    A quote counts only after an equals sign; once one has no end, quotes are read over from there on. What a search
    did not find it does not look for again.
    """

    def __init__(self, page: str):
        self.page, self.last, self.quotes, self.never = page, page.rfind(">"), True, set()

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag whose name ends at `at`."""
        page, where = self.page, at
        while self.quotes:
            m = _STOP.search(page, where)
            if not m:
                break
            if m[0] == ">":
                return m.start()
            where = m.end()
            if page[at : m.start()].rstrip()[-1:] == "=" if m.start() - at < 64 else page[m.start() - 1] == "=":
                close = page.find(m[0], where)
                if close < 0:
                    break
                where = close + 1
        self.quotes = False
        return page.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, bool, str]:
        """Where the next markup starts and ends, its tag (empty: none), is it an end tag, its attributes."""
        page = self.page
        while True:
            at = page.find("<", at)
            if at < 0:
                return len(page), len(page), "", False, ""
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, len(page) if end < 0 else end + 3, "", False, ""
            if at > self.last:
                return len(page), len(page), "", False, ""
            end_tag = page.startswith("/", at + 1)
            name = _NAME.match(page, at + 1 + end_tag)
            if name:
                stop = self.tag_end(name.end())
                return at, stop + 1, name[0].lower(), end_tag, page[name.end() : stop]
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                return at, page.find(">", at) + 1, "", False, ""
            at += 1

    def raw_end(self, tag: str, at: int) -> int:
        """Behind the end tag of a raw element, -1 if there is none."""
        if tag not in self.never:
            m = re.compile(rf"</{tag}\b[^<>]*>", re.I).search(self.page, at)
            if m:
                return m.end()
            self.never.add(tag)
        return -1


def blocks(page: str | None) -> list[Block]:
    """The shown blocks of text of a page in order, from a forgiving pass over its tags.

    Comments and raw elements are left out; unclosed paragraphs, items and cells end where HTML ends them; an end
    tag without its start is passed over; a page cut short ends all that is open; what is nested deeper than DEEPEST
    elements belongs to the deepest.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, int, float, bool]] = [("", 0, 0.0, False)]  # tag, number, evidence, not shown
    open_: Counter = Counter()
    number, links, at, current = 0, 0, 0, None
    inside, scanner = 0, Scanner(page)

    def say(text: str) -> None:
        nonlocal current
        if not text or stack[-1][3]:
            return
        if current is None:
            if text.isspace():
                return
            block = [x for x in stack if x[0] not in INLINE][-2:]
            current = Block(block[0][1], block[-1][0], stack[-1][2])
            out.append(current)
        current.parts.append(text)
        n = len(text)
        current.size += n
        if links:
            current.linked += n

    def close(upto: int) -> None:
        nonlocal links, inside
        for t, *_ in stack[upto:]:
            open_[t] -= 1
            links -= t == "a"
            inside -= t in CONTENT_TAGS
        del stack[upto:]

    while True:
        start, after, tag, end, attributes = scanner.next(at)
        if start > at:
            say(page[at:start])
        at = after
        if start >= len(page):
            break
        if not tag:
            continue
        if tag in RAW and not end:
            current = current if tag in INLINE else None
            stop = scanner.raw_end(tag, at)
            if stop >= 0:
                at = stop
            elif tag in ("script", "style", "textarea", "title", "template", "svg", "noscript", "select"):
                at = len(page)
            continue
        if tag not in INLINE:
            current = None
        if end:
            for k in range(len(stack) - 1, 0, -1) if open_[tag] > 0 else ():
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in _ENDS_P and open_["p"] > 0:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in _CLOSES and any(open_[t] > 0 for t in _CLOSES[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in _CLOSES[tag]:
                    close(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "menu", "nav", "div"):
                    break
        if tag in VOID:
            continue
        if attributes.endswith("/") and tag not in INLINE and tag not in _ENDS_P:
            continue
        if len(stack) > DEEPEST:
            continue
        said, gone = _evidence(tag, attributes, inside > 0)
        number += 1
        links += tag == "a"
        inside += tag in CONTENT_TAGS
        open_[tag] += 1
        stack.append((tag, number, max(-20.0, min(6.0, stack[-1][2] + said)), stack[-1][3] or gone))
    for b in out:
        b.text = " ".join(entities.unescape("".join(b.parts)).split())
    return [b for b in out if b.text]


def features(found: list[Block]) -> np.ndarray:
    """One row for each block: FEATURES, each between 0 and 1."""
    return np.array(
        [
            (1.0, min(1.0, len(b.text) / 120), b.linked / max(1, b.size), b.tag in ("p", "blockquote", "pre", "body", ""), b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), b.tag in ("li", "td", "th", "dd", "dt"), min(1.0, sum(map(b.text.count, ".!?")) / 3), min(1.0, max(0.0, -b.semantic) / 4), min(1.0, max(0.0, b.semantic) / 4))
            for b in found
        ],
        float,
    ).reshape(-1, len(FEATURES))


def fit(pages: list[str | None], strength: float = 4.0) -> np.ndarray:
    """Fit the weights in two steps.

    Of the text: logistic regression by Newton steps around the prior, on blocks whose elements say what they are.
    Of the elements: how far boilerplate and content marks go along with what the text weights say, as a log ratio
    of counts, between half of MOST_BOILER or MOST_CONTENT and the whole; so marks weigh as much as an unlikely
    text does, no more, and a block without marks is decided by its text and its neighbours.
    """
    got = np.concatenate([np.zeros((0, len(FEATURES))), *[features(blocks(p)) for p in pages]])
    w, k = PRIOR.copy(), TEXTUAL
    told = (got[:, k] >= 1) | (got[:, k + 1] >= 1)
    if not told.any():
        return w
    x, y = got[told, :k], (got[told, k + 1] >= 1).astype(float)
    scale = min(1.0, 200 / len(x))  # the prior weighs as much on any sample
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w[:k]))
        g = scale * x.T @ (y - p) - strength * (w[:k] - PRIOR[:k])
        h = scale * (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(k)
        step = np.linalg.solve(h, g)
        w[:k] += step
        if np.abs(step).max() < 1e-8:
            break
    agrees = (x @ w[:k] > 0) == (y > 0)
    for at, label, most in ((k, 0, MOST_BOILER), (k + 1, 1, MOST_CONTENT)):
        ok, bad = int(agrees[y == label].sum()), int((~agrees[y == label]).sum())
        size = min(most, max(most / 2, math.log((ok + 1) / (bad + 1)) + most / 2))
        w[at] = size if label else -size
    return w


def min_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Label nodes true (content) or false at the least total cost.

    A node pays |unary| for the label against its sign, an edge its weight if its ends differ. A node whose unary
    outweighs its edges keeps its sign in some optimum and is folded into its neighbours; what remains is solved
    by max-flow (Dinic) between the terminals, and the nodes that the source still reaches are content.
    """
    n = len(unary)
    u, near = list(unary), [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j:
            near[i][j] = near[i].get(j, 0) + w
            near[j][i] = near[j].get(i, 0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(u[i]) >= sum(near[i].values()):
            label[i] = u[i] > 0
            for j, w in near[i].items():
                u[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        index = {v: k for k, v in enumerate(rest)}
        s, t = len(rest), len(rest) + 1
        graph: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]
        for v, k in index.items():
            a, b = (s, k) if u[v] > 0 else (k, t)
            graph[a][b] = graph[a].get(b, 0) + abs(u[v])
            graph[b].setdefault(a, 0.0)
            for j, w in near[v].items():
                graph[k][index[j]] = w
        while True:
            level = {s: 0}
            order = deque([s])
            while order:
                a = order.popleft()
                for b, c in graph[a].items():
                    if c > 1e-12 and b not in level:
                        level[b] = level[a] + 1
                        order.append(b)
            if t not in level:
                break
            todo = {a: list(graph[a]) for a in level}
            way = [s]
            while way:
                a = way[-1]
                if a == t:
                    flow = min(graph[x][y] for x, y in zip(way, way[1:]))
                    for x, y in zip(way, way[1:]):
                        graph[x][y] -= flow
                        graph[y][x] = graph[y].get(x, 0) + flow
                    way = way[: next(k for k, (x, y) in enumerate(zip(way, way[1:])) if graph[x][y] <= 1e-12) + 1]
                    continue
                while todo[a]:
                    b = todo[a][-1]
                    if graph[a].get(b, 0) > 1e-12 and level.get(b) == level[a] + 1:
                        way.append(b)
                        break
                    todo[a].pop()
                else:
                    way.pop()
                    if way:
                        todo[way[-1]].pop()
        for v, k in index.items():
            label[v] = k in level
    return [bool(x) for x in label]


def edges_of(found: list[Block]) -> list[tuple[int, int, float]]:
    """What unlike labels cost between blocks that follow each other, most of all in one element, and between siblings.

    Where the elements around two blocks speak differently, a change of label costs less.
    """
    out, last = [], {}
    alike = lambda i, j: math.exp(-abs(max(-4.0, min(4.0, found[i].semantic)) - max(-4.0, min(4.0, found[j].semantic))) / 2)
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, (ADJACENT if b.up == found[i - 1].up else APART) * alike(i - 1, i)))
        if b.up in last:
            out.append((last[b.up], i, SIBLING * alike(last[b.up], i)))
        last[b.up] = i
    return out


def extract(page: str | None, weights: np.ndarray) -> list[tuple[str, bool, float]]:
    """The blocks of a page: (text, is it content, classifier logit)."""
    found = blocks(page)
    if not found:
        return []
    z = features(found) @ weights
    return [(b.text, keep, float(x)) for b, keep, x in zip(found, min_cut(z.tolist(), edges_of(found)), z)]


def train(pages: DataFrame, key: str = "page_id", html: str = "html", sample: int = SAMPLE_PAGES) -> np.ndarray:
    """Fit the block classifier on at most so many pages of at most SAMPLE_BYTES, in hash order of the key."""
    return fit([r["h"] for r in bounded(pages.select(F.col(key).alias("k"), F.col(html).alias("h")).where(F.octet_length("h") <= SAMPLE_BYTES), "k", sample)])


def main_text(pages: DataFrame, weights: np.ndarray, html: str = "html", to: str = "text") -> DataFrame:
    """Add the main text of every whole page: its content blocks in order, joined by a space.

    Character references are decoded and white space inside a block is one space. Null, empty and textless pages
    give an empty string; repeated rows give the same text each; an empty table stays empty; an input column named
    like the result is replaced by it.
    """
    text_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([" ".join(t for t, keep, _ in extract(p, weights) if keep) for p in s], dtype=object)

    return pages.withColumn(to, udf(F.col(html)))
