"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every block element and every run of text in it is a node with two states,
content or not. A node's features give a score for content, and a parent and
its child have a 2 x 2 table of scores by the kind of parent. Messages go from
the leaves to the root and back (sum-product), over all pages of a batch at
once, level by level; a run of text is kept if its marginal is above a half.

Weights are learnt from labelled pages: pages whose markup names its article,
with everything in the article content except what names itself otherwise.
Each such page is shown twice, as it is and with all names held back, so that
tags, lengths, links and ends of runs must explain the labels by themselves.
The fit is the most probable one under a normal prior around weights that
stand for layouts that those pages do not show.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelforge.llm.base import col, query, table, without

START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
EDGE = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I | re.S)

#: Names of HTML elements by what they do in a page.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul caption".split()
)
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
NEVER = {"head", "noscript", "template", "iframe", "svg", "button", "select", "option", "label", "legend", "canvas", "audio", "video", "datalist"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key closes an open element of the values, up to a table or list that holds it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
BARRIER = {"ul", "ol", "dl", "table", "menu"}

NEGATIVE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|notifications?|alert|popup|modal|overlay|"
    r"newsletter|subscri\w*|signup|login|nav\w*|menus?|breadcrumbs?|footer|header|masthead|sidebar|side|rail|widget\w*|related|"
    r"recommend\w*|share|sharing|social|comments?|commentlist|disqus|discussion|respond|replies|reply|pagination|pager|"
    r"toolbar|search|forms?|complementary|contentinfo|navigation)(?=$|[\s_-])", re.I,
)
POSITIVE = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|text|body)(?=$|[\s_-])", re.I)

#: Kinds of parents. Inside a named part of a page its kind goes on to what is below, until another part is named.
PLAIN, CONTENT, OTHER, TEXT, GRID = range(5)
FEATURES = (
    "article", "nav", "header", "footer", "aside", "form", "heading", "paragraph", "list", "table",
    "named_other", "named_content", "outside", "leaf", "words", "links", "sentence",
)
#: Features that are names.
NAMES = [FEATURES.index(x) for x in ("article", "named_other", "named_content", "outside")]
PRIOR = np.array([4.0, -5.0, -1.0, -5.0, -5.0, -5.0, 0.3, 0.8, -0.3, 0.0, -6.0, 3.0, -4.0, -0.5, 0.6, -2.0, 0.7])
#: Scores by kind of parent, then state of the parent, then state of the child.
PRIOR_EDGES = np.array([
    [[0.3, 0.0], [0.0, 0.3]],
    [[0.5, 0.0], [0.0, 4.0]],
    [[5.0, 0.0], [0.0, 1.0]],
    [[4.0, 0.0], [0.0, 6.0]],
    [[0.3, 0.0], [0.0, 0.5]],
])
_TAGS = {"article": 0, "main": 0, "nav": 1, "menu": 1, "header": 2, "footer": 3, "aside": 4, "form": 5, "search": 5, "dialog": 5,
         "p": 7, "blockquote": 7, "pre": 7, "figcaption": 7, "ul": 8, "ol": 8, "li": 8, "dl": 8, "dt": 8, "dd": 8, "table": 9, "tr": 9, "td": 9, "th": 9}
_TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "td", "th", "figcaption", "caption", "summary"}
_GRIDS = {"table", "tbody", "thead", "tfoot", "tr"}


class Scanner:
    """Tags of a page from left to right; work is linear in the page whatever its quotes and brackets are."""

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.open_quotes: set[int] = set()  # from these quotes on no end of a tag is found outside quotes

    def end(self, at: int) -> int:
        """Behind the end of the tag whose name ends at ``at``: the first ``>`` outside quotes, else the first one."""
        seen, i = [], at
        while m := EDGE.search(self.source, i):
            q = m.start()
            if m[0] == ">":
                return q + 1
            if q in self.open_quotes:
                break
            seen.append(q)
            i = self.source.find(m[0], q + 1) + 1
            if not i:
                break
        self.open_quotes.update(seen)
        return self.source.index(">", at) + 1

    def next(self, at: int):
        """The next tag: where it starts and ends, whether it closes, its name (none for comments) and attributes."""
        while m := START.search(self.source, at):
            if m[1]:
                end = self.source.find("-->", m.end())
                return m.start(), len(self.source) if end < 0 else end + 3, False, "", ""
            if m.end() > self.last:
                return None
            if m[2]:
                return m.start(), self.source.index(">", m.end()) + 1, False, "", ""
            end = self.end(m.end())
            return m.start(), end, bool(m[3]), m[4].lower(), self.source[m.end() : end - 1]
        return None


@dataclass
class Forest:
    """Nodes of many pages, parents before children."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    #: Kinds without what a named part passes on.
    shape: list[int] = field(default_factory=list)
    values: list[list[float]] = field(default_factory=list)
    part: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    #: Whether the markup says that a node is in the article; None where it names no article.
    label: list[bool | None] = field(default_factory=list)
    pages: list[int] = field(default_factory=lambda: [0])

    def add(self, source: str) -> None:
        """The nodes of one page."""
        first = len(self.parent)
        self._node(-1, "html", "", [])
        stack: list[tuple[str, int]] = [("html", first)]  # open blocks and elements that are never content
        places: dict[str, list[int]] = {}  # where in the stack each name is open
        scanner = Scanner(source)
        words: list[str] = []  # the run of text at hand
        linked = [0, 0]
        links = never = at = 0

        def flush() -> None:
            nonlocal words, linked
            text = " ".join(entities.unescape("".join(words)).split())
            if text:
                size = max(1, linked[0])
                self._leaf(stack[-1][1], text, min(1.0, linked[1] / size))
            words, linked = [], [0, 0]

        def close(depth: int) -> None:
            nonlocal never
            flush()
            for name, _ in stack[depth:]:
                never -= name in NEVER
                places[name].pop()
            del stack[depth:]

        def push(name: str, node: int) -> None:
            places.setdefault(name, []).append(len(stack))
            stack.append((name, node))

        def top(names) -> int:
            return max((places[x][-1] for x in names if places.get(x)), default=0)

        def take(text: str) -> None:
            if not never and text:
                words.append(text)
                size = len(text.split())
                linked[0] += size
                linked[1] += size if links else 0

        def opened(names: set[str], stop: set[str]) -> int:
            i = top(names)
            return i if i > top(stop) else 0

        while at < len(source):
            tag = scanner.next(at)
            if tag is None:
                take(source[at:])
                break
            start, end, closing, name, attributes = tag
            take(source[at:start])
            at = end
            if not name:
                continue
            if closing:
                if name == "a":
                    links = max(0, links - 1)
                elif name in BLOCKS or name in NEVER:
                    if i := opened({name}, set()):
                        close(i)
                elif name == "br":
                    take(" ")
                continue
            if name in RAW:
                close_ = re.compile(rf"</{name}[\s/>]", re.I).search(source, at)
                at = close_.start() if close_ else len(source)
                continue
            if name == "br":
                take(" ")
            elif name == "a":
                links += 1
            elif name in NEVER:
                if name == "option" and (i := opened({"option"}, {"select"})):
                    close(i)
                flush()
                push(name, stack[-1][1])
                never += 1
            elif name in BLOCKS:
                if name in CLOSES and (i := opened(CLOSES[name], BARRIER)):
                    close(i)
                elif i := opened({"p"}, BARRIER | {"td", "th", "div", "section", "article"} - {"p"}):
                    close(i)
                flush()
                links = 0
                if name in ("html", "body") or name in VOID:
                    continue
                node = stack[-1][1] if never else self._node(stack[-1][1], name, attributes, stack)
                push(name, node)
        flush()
        self._finish(first)

    def _node(self, parent: int, name: str, attributes: str, stack) -> int:
        values = [0.0] * len(FEATURES)
        if name in _TAGS:
            values[_TAGS[name]] = 1.0
        elif len(name) == 2 and name[0] == "h" and name[1].isdigit():
            values[6] = 1.0
        kind = TEXT if name in _TEXTUAL else GRID if name in _GRIDS else PLAIN
        named = " ".join(v.strip("\"'") for _, v in ATTRIBUTE.findall(attributes)) if attributes else ""
        other = [x.strip(" _-").lower() for x in NEGATIVE.findall(named)] if named else []
        good = bool(named and POSITIVE.search(named))
        if good and set(other) <= {"header"}:
            other = []
        if other:
            values[10] = 1.0
        elif good and not any(values[1:6]):
            values[11] = 1.0
        part = self.part[parent] if parent >= 0 else PLAIN
        if other or any(values[1:2]) or any(values[3:6]):
            part = OTHER
        elif values[0] or values[11]:
            part = CONTENT
        self.shape.append(kind)
        if part == OTHER or part == CONTENT and kind != TEXT:
            kind = part
        self.part.append(part)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind)
        self.values.append(values)
        self.text.append(None)
        self.label.append(None)
        return len(self.parent) - 1

    def _leaf(self, parent: int, text: str, links: float) -> None:
        node = self._node(parent, "", "", [])
        self.text[node] = text
        self.values[node][13:] = [1.0, float(np.log1p(text.count(" ") + 1)) - 2.0, links, float(text[-1] in ".!?:;…»”\"'")]

    def _finish(self, first: int) -> None:
        """What a node's place relative to a named article says."""
        n = len(self.parent)
        inside = [False] * (n - first)
        holds = [False] * (n - first)
        bad = [False] * (n - first)
        for i in range(first, n):
            p = self.parent[i] - first
            own = self.values[i][0] > 0
            inside[i - first] = own or (p >= 0 and inside[p])
            bad[i - first] = self.part[i] == OTHER or (p >= 0 and bad[p])
            if own:
                while p >= 0 and not holds[p]:
                    holds[p] = True
                    p = self.parent[p + first] - first
        if any(inside):
            for i in range(first, n):
                self.label[i] = inside[i - first] and not bad[i - first]
                if not inside[i - first] and not holds[i - first]:
                    self.values[i][12] = 1.0
        self.pages.append(n)


class Model:
    """Weights of the features, and scores of parent and child by kind of parent."""

    def __init__(self, weights=PRIOR, edges=PRIOR_EDGES):
        self.weights, self.edges = weights.copy(), edges.copy()

    def marginals(self, forest: Forest):
        """Probabilities of content; and, of each node with a parent, those of both states together."""
        p, both, _ = self._passed(Nodes(forest))
        return p, both

    def _passed(self, nodes: "Nodes"):
        """Marginals, joint marginals of child and parent, and the log of the sum over all assignments."""
        up = np.zeros((nodes.n, 2))
        up[:, 1] = nodes.x @ self.weights
        # Deep and thin trees are walked node by node, others a level at a time.
        message, down = (self._by_nodes if nodes.n < 16 * len(nodes.levels) else self._by_levels)(nodes, up)
        c, p = nodes.child, nodes.parent[nodes.child]
        both = np.zeros((nodes.n, 2, 2))
        joint = self.edges[nodes.kind[p]] + (up[p] + down[p] - message[c])[:, :, None] + up[c][:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        both[c] = joint / joint.sum((1, 2), keepdims=True)
        belief = up + down
        total = np.logaddexp(*up[nodes.parent < 0].T).sum()
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -40, 40))), both, total

    def _by_levels(self, nodes: "Nodes", up):
        parent, kind = nodes.parent, nodes.kind
        message, down = np.zeros_like(up), np.zeros_like(up)
        for at in reversed(nodes.levels):
            table_ = self.edges[kind[parent[at]]]  # parent's state, child's state
            message[at] = np.logaddexp(table_[:, :, 0] + up[at, None, 0], table_[:, :, 1] + up[at, None, 1])
            np.add.at(up, parent[at], message[at])
        for at in nodes.levels:
            joint = self.edges[kind[parent[at]]] + (up[parent[at]] + down[parent[at]] - message[at])[:, :, None]
            down[at] = np.logaddexp(joint[:, 0], joint[:, 1])
        return message, down

    def _by_nodes(self, nodes: "Nodes", up):
        def either(a: float, b: float) -> float:
            return max(a, b) + log1p(exp(-abs(a - b)))

        edges, n = self.edges.tolist(), nodes.n
        parent, kind = nodes.parent.tolist(), nodes.kind.tolist()
        u, m, d = up.tolist(), [(0.0, 0.0)] * n, [(0.0, 0.0)] * n
        for i in range(n - 1, -1, -1):
            q = parent[i]
            if q >= 0:
                (a, b), (c, e) = edges[kind[q]]
                x, y = u[i]
                m[i] = either(a + x, b + y), either(c + x, e + y)
                u[q][0] += m[i][0]
                u[q][1] += m[i][1]
        for i in range(n):
            q = parent[i]
            if q >= 0:
                (a, b), (c, e) = edges[kind[q]]
                x, y = u[q][0] + d[q][0] - m[i][0], u[q][1] + d[q][1] - m[i][1]
                d[i] = either(a + x, c + y), either(b + x, e + y)
        up[:] = np.array(u).reshape(n, 2)
        return np.array(m).reshape(n, 2), np.array(d).reshape(n, 2)

    def fit(self, forest: Forest, rounds: int = 200, hold: float = 0.02) -> "Model":
        """The most probable weights: likelihood of the labels a page, less ``hold`` / 2 times the squared distance from the prior.

        The likelihood is concave; steps are quasi-Newton (BFGS), halved until they climb, to a slope of 1e-4.
        """
        if not forest.parent:
            return self
        views = [Nodes(forest), Nodes(forest, names=False)]
        size = 2 * (len(forest.pages) - 1)
        y = np.array([bool(x) for x in forest.label], int)
        center = np.concatenate([PRIOR, PRIOR_EDGES.ravel()])
        k = len(PRIOR)

        def climbed(theta):
            """How good weights are, and the slope there."""
            model = Model(theta[:k], theta[k:].reshape(self.edges.shape))
            value, slope = -hold / 2 * ((theta - center) ** 2).sum(), -hold * (theta - center)
            for v in views:
                p, both, total = model._passed(v)
                c, q = v.child, v.parent[v.child]
                moved = np.zeros_like(self.edges)
                np.add.at(moved, (v.kind[q], y[q], y[c]), 1.0)
                seen = (v.x[y == 1].sum(0) @ model.weights) + (moved * model.edges).sum()
                np.subtract.at(moved, v.kind[q], both[c])
                value += (seen - total) / size
                slope += np.concatenate([v.x.T @ (y - p), moved.ravel()]) / size
            return value, slope

        theta = np.concatenate([self.weights, self.edges.ravel()])
        value, slope = climbed(theta)
        inverse = np.eye(len(theta))
        for _ in range(rounds):
            if np.abs(slope).max() < 1e-4:
                break
            way, pace = inverse @ slope, 1.0
            while (new := climbed(theta + pace * way))[0] < value + 1e-4 * pace * (way @ slope) and pace > 1e-8:
                pace /= 2
            step, bend = pace * way, slope - new[1]
            theta, value, slope = theta + step, *new
            if (s := step @ bend) > 1e-12:
                turn = np.eye(len(theta)) - np.outer(step, bend) / s
                inverse = turn @ inverse @ turn.T + np.outer(step, step) / s
        self.weights, self.edges = theta[:k], theta[k:].reshape(self.edges.shape)
        return self


class Nodes:
    """A forest as arrays; ``names=False`` holds back what names of elements, classes and ids say of the article."""

    def __init__(self, forest: Forest, names: bool = True):
        self.n = len(forest.parent)
        self.x = np.array(forest.values).reshape(self.n, len(FEATURES))
        self.parent = np.array(forest.parent, int)
        self.kind = np.array(forest.kind if names else forest.shape, int)
        if not names:
            self.x[:, NAMES] = 0.0
        depth = np.array(forest.depth, int)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        self.child = np.flatnonzero(self.parent >= 0)


def train(pages: DataFrame, id_: str = "page_id", html: str = "html", sample: int = 300, longest: int = 1 << 18) -> Model:
    """Fit on ``sample`` pages of at most ``longest`` bytes, by a hash of the id; of those, the ones that name an article."""
    short = pages.where(F.octet_length(col(html)) <= longest).select(col(html).alias("h"), F.xxhash64(col(id_), col(html)).alias("k"))
    # Only hashes are compared over all pages; the pages below the bound are read after.
    bound = short.select("k").orderBy("k").limit(sample).agg(F.max("k")).first()[0]
    forest = Forest()
    for r in short.where(F.col("k") <= F.lit(bound)).limit(sample).collect():
        one = Forest()
        one.add(r.h)
        if one.label[0] is not None:
            forest.add(r.h)
    return Model().fit(forest)


def extracted(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """``pages`` with main_text: the runs of text that are content, one a line, white space inside as one space.

    A null or empty page, or one without content, has an empty text. Pages are
    taken one by one, so repeated rows agree. Broken markup is read as far as
    it goes: a tag that never ends is text. A column of this name goes.
    """
    df = without(pages, "main_text")
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            column, out = batch.column(html), []
            # As many pages at a time as give some thousand nodes.
            for a in range(0, len(column), 64):
                forest = Forest()
                for x in column[a : a + 64].to_pylist():
                    forest.add(x or "")
                kept = sent.value.marginals(forest)[0] > 0.5
                for i, j in zip(forest.pages[:-1], forest.pages[1:]):
                    out.append("\n".join(forest.text[k] for k in range(i, j) if kept[k] and forest.text[k] is not None))
            yield batch.append_column("main_text", pa.array(out, pa.string()))

    return df.mapInArrow(run, df.select("*", F.lit("").alias("main_text")).schema)


@query("op5_html")
def op5_html(spark, folder):
    """All pages."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    got = extracted(pages, train(pages))
    return got.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
