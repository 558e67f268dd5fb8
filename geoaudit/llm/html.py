"""Main-text extraction from HTML: boosted trees over DOM nodes, decoded so that no node contradicts another.

A page becomes a tree of its block elements. Each is described by its tag, attribute tokens, depth,
siblings and the density of text, links and tags below it, and gradient-boosted trees give the odds that
it belongs to the article. A node can only be kept below kept ones, so the decoding picks the set of nodes,
closed towards the root, whose log-odds add up to the most. The trees are grown here, from pages that a
generator lays out with known articles.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Their content is no text of the page.
HIDDEN = frozenset("script style noscript template iframe object svg math head title textarea select canvas audio video datalist".split())
GROUPS = {
    "nav": "nav menu", "header": "header hgroup", "footer": "footer address", "aside": "aside dialog", "form": "form fieldset button label legend",
    "article": "article", "main": "main", "section": "section", "div": "div center body html details summary", "p": "p",
    "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl", "item": "li dt dd", "table": "table thead tbody tfoot tr caption", "cell": "td th",
    "quote": "blockquote pre", "figure": "figure figcaption",
}
TAG_GROUP = {tag: k for k, tags in enumerate(GROUPS.values()) for tag in tags.split()}
#: Words of class, id and role, by what they tell.
TOKENS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs skip",
    "frame": "header footer masthead topbar bottombar copyright legal site",
    "advert": "ad ads advert adverts advertisement banner sponsor sponsored promo promotion promoted",
    "notice": "notice cookie cookies consent gdpr popup modal alert overlay warning message",
    "comment": "comment comments reply replies disqus discussion respond feedback",
    "side": "sidebar aside side rail widget related recommended more share social sharing tags trending popular",
    "form": "form search login signup subscribe newsletter input",
    "content": "article content post entry story body text main page paragraph",
}
TOKEN_GROUP = {word: k for k, words in enumerate(TOKENS.values()) for word in words.split()}
_CONTENT = len(TOKENS) - 1
_FORM, _FRAME_RUNS = list(TOKENS).index("form"), 3
_BOILER_TAGS = {TAG_GROUP[t] for t in ("nav", "footer", "aside", "form")}
_ARTICLE_TAGS = {TAG_GROUP[t] for t in ("article", "main")}

_NAME = re.compile(r"[a-zA-Z][^\s/<>]*")
_SPECIAL = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")


@dataclass
class Node:
    group: int
    parent: int
    depth: int
    tokens: int  #: bits of token groups
    tag: str
    place: int = 0  #: among its parent's children
    children: list[int] = field(default_factory=list)
    tags: int = 0  #: tags of any kind directly in it
    chars: int = 0
    linked: int = 0
    runs: int = 0
    stops: int = 0


_CLOSED_BY = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"})}


class Page:
    """The block elements of a page in page order, and its runs of text with the element each is in."""

    def __init__(self, source: str):
        self.nodes = [Node(TAG_GROUP["html"], -1, 0, 0, "#")]
        self.runs: list[tuple[int, str]] = []
        self._open = [0]
        self._places: dict[str, list[int]] = defaultdict(list)  # of open elements among all that are open, by tag
        self._dead: set[int] = set()  # signs outside of quotes after which no tag has an end
        self._sign = (0, -1)  # the first sign at or after the one place is the other
        self._ends: dict[str, re.Pattern | None] = {}
        self._text: list[str] = []
        self._links = self._linked = 0
        self._read(source)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                node = self.nodes[self._open[-1]]
                node.runs += 1
                node.chars += len(text)
                node.linked += min(self._linked, len(text))
                node.stops += text.count(".") + text.count(",")
                self.runs.append((self._open[-1], text))
            self._text, self._linked = [], 0

    def _close(self, names: set[str], within: set[str]) -> None:
        """Close the innermost open element of ``names``, unless one of ``within`` is nearer."""
        at = max((self._places[name][-1] for name in names if self._places[name]), default=0)
        if not at or any(self._places[name] and self._places[name][-1] > at for name in within):
            return
        for node in self._open[at:]:
            self._places[self.nodes[node].tag].pop()
        del self._open[at:]

    def _start(self, tag: str, attributes: str) -> None:
        self._flush()
        if tag in _CLOSED_BY:
            names, within = _CLOSED_BY[tag]
            self._close(set(names.split()), within)
        else:
            self._close({"p"}, _SCOPES)
        tokens = 0
        if attributes:
            for found in _ATTRIBUTE.finditer(attributes):
                for word in _WORDS.findall((found[1] or found[2] or found[3] or "").lower()):
                    if (k := TOKEN_GROUP.get(word)) is not None:
                        tokens |= 1 << k
        parent = self._open[-1]
        place = len(self.nodes[parent].children)
        self.nodes[parent].children.append(len(self.nodes))
        self._places[tag].append(len(self._open))
        self._open.append(len(self.nodes))
        self.nodes.append(Node(TAG_GROUP[tag], parent, self.nodes[parent].depth + 1, tokens, tag, place))

    def _tag_end(self, source: str, at: int, last: dict[str, int]) -> int:
        """Where the tag whose name ends at ``at`` is closed, not in quotes; -1 if nowhere."""
        if at > last[">"]:
            return -1
        seen = []
        while True:
            if not self._sign[0] <= at <= self._sign[1]:  # else the next sign is the one found before
                found = _SPECIAL.search(source, at)
                self._sign = (at, found.start() if found else len(source))
            place = self._sign[1]
            if place == len(source) or place in self._dead:
                break
            sign, at = source[place], place + 1
            if sign == ">":
                return place
            seen.append(place)
            if at <= last[sign]:  # a quote that is never closed is a sign like others
                at = source.index(sign, at) + 1
        self._dead.update(seen)  # so that no sign is gone through twice
        return -1

    def _add(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self._text.append(text)
        if self._links:
            self._linked += len(text.strip())

    def _read(self, source: str) -> None:
        at, last = 0, {sign: source.rfind(sign) for sign in ">\"'"}
        while at < len(source):
            start = source.find("<", at)
            if start != at:
                start = len(source) if start < 0 else start
                self._add(source[at:start])
                at = start
                continue
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                at = len(source) if end < 0 else end + 3
                continue
            if source.startswith(("<!", "<?"), at) and at < last[">"]:
                at = source.index(">", at) + 1
                continue
            closing = source.startswith("/", at + 1)
            name = _NAME.match(source, at + 1 + closing)
            end = self._tag_end(source, name.end(), last) if name else -1
            if end < 0:
                self._add("<")
                at += 1
                continue
            tag, attributes, at = name[0], source[name.end() : end], end + 1
            tag = tag.lower()
            self.nodes[self._open[-1]].tags += 1
            if closing:
                if tag in TAG_GROUP:
                    self._flush()
                    self._close({tag}, set())
                elif tag == "a":
                    self._links = max(0, self._links - 1)
            elif tag in HIDDEN:
                if not attributes.endswith("/") or tag in ("script", "style"):
                    if tag not in self._ends:
                        self._ends[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I)
                    found = self._ends[tag] and self._ends[tag].search(source, at)
                    if found:
                        at = found.end()
                    else:
                        self._ends[tag] = None  # none follows further on either
                        if tag != "head":
                            at = len(source)
            elif tag in TAG_GROUP:
                self._start(tag, attributes)
            elif tag in ("br", "hr"):
                self._text.append(" ")
                if tag == "hr":
                    self._flush()
            elif tag == "a":
                self._links += 1
        self._flush()


_SCOPES = {"td", "th", "caption", "button", "table", "article", "section", "div", "li"}


N_FEATURES = len(GROUPS) + 2 * len(TOKENS) + 18


def node_features(page: Page) -> np.ndarray:
    """One row for each node but the root, which is no element.

    A form round half of the page's text and more, in several runs, is no form to fill in but the page's own frame,
    as some site builders have it; it is told like a block without a kind.
    """
    nodes = page.nodes
    n = len(nodes)
    below = np.array([[x.chars, x.linked, x.runs, x.stops, x.tags, 1] for x in nodes], float)
    above = np.zeros((n, 3), int)  # token bits, boilerplate tags, article tags
    out = np.zeros((n, N_FEATURES))
    for k in range(n - 1, 0, -1):
        below[nodes[k].parent] += below[k]
    for k in range(1, n):
        if nodes[k].tag == "form" and 2 * below[k][0] >= below[0][0] and below[k][2] >= _FRAME_RUNS:
            nodes[k].group, nodes[k].tokens = TAG_GROUP["div"], nodes[k].tokens & ~(1 << _FORM)
    g, t = len(GROUPS), len(TOKENS)
    alike = Counter((x.parent, x.group) for x in nodes[1:])
    for k in range(1, n):
        x = nodes[k]
        up = above[x.parent]
        above[k] = (up[0] | x.tokens, up[1] + (x.group in _BOILER_TAGS), up[2] + (x.group in _ARTICLE_TAGS))
        family = nodes[x.parent].children
        place = x.place
        row = out[k]
        row[x.group] = 1
        for b in range(t):
            row[g + b] = x.tokens >> b & 1
            row[g + t + b] = int(up[0]) >> b & 1
        chars, linked, runs, stops, tags, size = below[k]
        own = below[x.parent][0]
        row[g + 2 * t :] = (
            x.depth, len(family), place, len(family) - 1 - place, len(x.children), np.log1p(size), np.log1p(chars), np.log1p(x.chars), linked / (chars + 1), tags / (chars + 1) * 100,
            chars / (runs + 1), stops / (chars + 1) * 100, chars / (own + 1), chars / (below[0][0] + 1), up[1], up[2],
            alike[x.parent, x.group], (below[family[place - 1]][1] / (below[family[place - 1]][0] + 1)) if place else -1,
        )
    return out[1:]


# --- boosted trees --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class BoostConfig:
    """Trees, their depth, and the generator's pages."""

    trees: int = 60
    depth: int = 4
    rate: float = 0.2
    bins: int = 24
    ridge: float = 2.0
    pages: int = 500
    seed: int = 17


class BoostedTrees:
    """Binary classifier: complete trees of one depth, each fitted to the logistic loss's gradient."""

    def __init__(self, x: np.ndarray, y: np.ndarray, config: BoostConfig):
        self.config = config
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, config.bins + 1)[1:-1])) for c in x.T]
        codes = self._codes(x)
        self.split = np.zeros((config.trees, (1 << config.depth) - 1, 2), np.int64)  # feature, last code to the left
        self.leaf = np.zeros((config.trees, 1 << config.depth))
        self.start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        odds = np.full(len(y), self.start)
        for tree in range(config.trees):
            p = 1 / (1 + np.exp(-odds))
            odds += self._grow(tree, codes, p - y, p * (1 - p))

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _grow(self, tree: int, codes: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
        node, width, ridge = np.zeros(len(codes), np.int64), self.config.bins, self.config.ridge
        for level in range(self.config.depth):
            first, count = (1 << level) - 1, 1 << level
            best = np.full(count, 1e-9)
            choice = np.tile([0, width], (count, 1))
            for f in range(codes.shape[1]):
                if not len(self.edges[f]):
                    continue
                cell = node * width + codes[:, f]
                g = np.bincount(cell, slope, count * width).reshape(count, width).cumsum(axis=1)
                h = np.bincount(cell, curve, count * width).reshape(count, width).cumsum(axis=1)
                total_g, total_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
                at = gain.argmax(axis=1)
                value = gain[np.arange(count), at]
                better = value > best
                best[better] = value[better]
                choice[better, 0], choice[better, 1] = f, at[better]
            self.split[tree, first : first + count] = choice
            node = 2 * node + (codes[np.arange(len(codes)), choice[node, 0]] > choice[node, 1])
        leaves = 1 << self.config.depth
        self.leaf[tree] = -self.config.rate * np.bincount(node, slope, leaves) / (np.bincount(node, curve, leaves) + ridge)
        return self.leaf[tree][node]

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        codes, rows = self._codes(x), np.arange(len(x))
        out = np.full(len(x), self.start)
        for split, leaf in zip(self.split, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.config.depth):
                at = split[(1 << level) - 1 + node]
                node = 2 * node + (codes[rows, at[:, 0]] > at[:, 1])
            out += leaf[node]
        return out


# --- pages to learn from ----------------------------------------------------------------------------------


class PageMaker:
    """Pages laid out at random, with the article's nodes marked by an attribute that no feature reads."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def _pick(self, choices):
        return choices[int(self.rng.integers(len(choices)))]

    def _words(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        words = ["".join(self._pick(("ka", "to", "ri", "men", "sul", "pe", "on", "da")) for _ in range(int(self.rng.integers(1, 4)))) for _ in range(n)]
        for k in range(0, n, 9):
            words[min(n - 1, k + 8)] += self._pick((".", ",", ".", "", ""))
        return " ".join(words)

    def _named(self, group: str, plain: float = 0.2) -> str:
        if self.rng.random() < plain:
            return ""
        return f' {self._pick(("class", "id"))}="{self._pick(TOKENS[group].split())}{self._pick(("", "", "-box", " wide", "-1"))}"'

    def _links(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{self._words(1, 3)}</a></li>' for k in range(n)) + "</ul>"

    def _plain(self) -> str:
        """An article without paragraph tags: blocks of its own, or lines parted by breaks, under any name or none."""
        kind = self.rng.random()
        head = f"<{(h := self._pick(('h1', 'h2', 'div')))} data-k>{self._words(2, 9)}</{h}>" if self.rng.random() < 0.7 else ""
        blocks = [self._words(*self._pick(((4, 15), (10, 60), (40, 120)))) for _ in range(int(self.rng.integers(2, 12)))]
        if kind < 0.5:
            inner = "".join(f"<div data-k{self._named('content', 0.8)}>{b}</div>" for b in blocks)
        elif kind < 0.8:
            inner = self._pick(("<br>", "<br><br>", "<br/>\n")).join(blocks)
        else:
            inner = "".join(f"<section data-k>{self._words(2, 5) if self.rng.random() < 0.3 else ''}<div data-k>{b}</div></section>" for b in blocks)
        tag = self._pick(("article", "div", "div", "div", "main", "section"))
        return f"<{tag} data-k{self._named('content', 0.4)}>{head}{inner}</{tag}>"

    def _article(self) -> str:
        if self.rng.random() < 0.3:
            return self._plain()
        parts = [f"<h1 data-k>{self._words(2, 10)}</h1>"] if self.rng.random() < 0.85 else []
        for _ in range(int(self.rng.integers(1, 14))):
            kind = self.rng.random()
            if kind < 0.78:
                low, high = self._pick(((1, 3), (2, 12), (10, 60), (40, 120)))
                text = self._words(low, high)
                if self.rng.random() < 0.2:
                    text += f' <a href="/x">{self._words(1, 8)}</a>'
                if self.rng.random() < 0.15:
                    text = "<b>" + text + "<br>"
                parts.append(f"<p data-k>{text}" + self._pick(("</p>", "</p>", "</p>", "")))
            elif kind < 0.84:
                parts.append(f"<h2 data-k>{self._words(1, 6)}</h2>")
            elif kind < 0.90:
                parts.append("<ul data-k>" + "".join(f"<li data-k>{self._words(1, 15)}</li>" for _ in range(int(self.rng.integers(1, 6)))) + "</ul>")
            elif kind < 0.94:
                parts.append(f"<blockquote data-k><p data-k>{self._words(3, 40)}</p></blockquote>")
            elif kind < 0.97:
                parts.append("<table data-k>" + "".join(f"<tr data-k><td data-k>{self._words(1, 3)}</td><td data-k>{self._words(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                parts.append(f"<pre data-k>{self._words(2, 30)}</pre>")
            if self.rng.random() < 0.06:
                parts.append(self._extra())
        if self.rng.random() < 0.7:
            return f"<article data-k>{''.join(parts)}</article>"
        return f"<{(tag := self._pick(('div', 'section', 'main', 'div')))} data-k{self._named('content', 0.1)}>{''.join(parts)}</{tag}>"

    def _extra(self) -> str:
        """Something beside the article."""
        kind = self._pick(("advert", "notice", "side", "form", "comment", "menu", "frame"))
        inner = self._pick((self._words(2, 25), f"<p>{self._words(3, 40)}</p>", self._links(int(self.rng.integers(1, 6))), f"<h3>{self._words(1, 4)}</h3>{self._links(3)}"))
        if kind == "comment":
            inner = f"<h3>{self._words(1, 2)}</h3>" + "".join(f"<div{self._named('comment')}><p>{self._words(2, 60)}</p></div>" for _ in range(int(self.rng.integers(1, 5))))
            return f"<{(tag := self._pick(('div', 'section')))}{self._named(kind, 0)}>{inner}</{tag}>"
        if kind == "form" and self.rng.random() < 0.7:
            return f"<form{self._named(kind)}><label>{self._words(1, 3)}</label><input><button>{self._words(1, 2)}</button><p>{self._words(2, 15)}</p></form>"
        if kind in ("side", "menu") and self.rng.random() < 0.6:
            return f"<{(tag := 'aside' if kind == 'side' else 'nav')}{self._named(kind, 0.5)}>{inner}</{tag}>"
        return f"<div{self._named(kind, 0)}>{inner}</div>"

    def page(self) -> str:
        before, after = [], []
        if self.rng.random() < 0.5:
            before.append(f"<header{self._named('frame', 0.5)}>{self._pick((f'<h1>{self._words(1, 4)}</h1>', f'<p>{self._words(2, 12)}</p>', self._links(4), self._words(1, 6)))}</header>")
        if self.rng.random() < 0.8:
            before.append(f"<nav{self._named('menu', 0.6)}>{self._links(int(self.rng.integers(2, 9)))}</nav>")
        for where in (before, after):
            for _ in range(int(self.rng.integers(0, 3))):
                where.append(self._extra())
        if self.rng.random() < 0.9:
            tag = self._pick(("footer", "footer", "div"))
            after.append(f"<{tag}{self._named('frame', 0.6 if tag == 'footer' else 0)}>{self._pick((f'<p>{self._words(3, 30)}</p>', self._words(3, 30), self._links(3)))}</{tag}>")
        middle = self._article()
        if self.rng.random() < 0.4:
            beside = [self._extra() for _ in range(int(self.rng.integers(0, 3)))]
            middle = f"<{(tag := self._pick(('div', 'main', 'section')))} data-k{self._named('content', 0.6)}>{middle}{''.join(beside)}</{tag}>"
        body = "".join([*before, middle, *after])
        if self.rng.random() < 0.3:
            body = f"<div data-k{self._named('content', 0.7)}>{body}</div>"
        return f"<html><head><title>x</title></head><body data-k>{body}</body></html>"


_MARKED = re.compile(r"<(?!/)([a-z][a-z0-9]*)( data-k)?")


def learn_trees(config: BoostConfig = BoostConfig()) -> BoostedTrees:
    maker, rows, marks = PageMaker(config.seed), [], []
    for _ in range(config.pages):
        source = maker.page()
        page = Page(source)
        order = [bool(m[2]) for m in _MARKED.finditer(source.partition("</head>")[2]) if m[1] in TAG_GROUP]
        found = [False] + order if page.nodes[1].tag == "html" else order
        if page.nodes[1].tag == "html":
            found[0] = True
        assert len(found) == len(page.nodes) - 1
        rows.append(node_features(page))
        marks.append(np.array(found, float))
    return BoostedTrees(np.vstack(rows), np.concatenate(marks), config)


def main_text(page: Page, odds: np.ndarray) -> str:
    """Runs of the best set of nodes that holds the parent of each of its nodes."""
    nodes = page.nodes
    worth = np.concatenate([[0.0], odds])
    for k in range(len(nodes) - 1, 0, -1):
        if worth[k] > 0:
            worth[nodes[k].parent] += worth[k]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for k in range(1, len(nodes)):
        kept[k] = kept[nodes[k].parent] and worth[k] > 0
    return "\n".join(text for k, text in page.runs if kept[k])


def extract(pages: DataFrame, config: BoostConfig = BoostConfig()) -> DataFrame:
    """``page_id, url, text, n_chars`` for each page.

    ``pages`` has ``page_id, url, html``; further columns are not read. Character references are decoded,
    white space within a block becomes one space, and blocks are joined in page order by a line feed. A null
    or empty page, and one without an article, gives an empty text. Repeated rows come as often as they do;
    text outside any block counts as part of the page's body.
    """
    trees = pages.sparkSession.sparkContext.broadcast(learn_trees(config))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                some = batch.slice(row, 256)
                parsed = [Page(h or "") for h in some.column("html").to_pylist()]
                rows = [node_features(p) for p in parsed]
                odds = trees.value.odds(np.vstack(rows))
                texts, at = [], 0
                for page, x in zip(parsed, rows, strict=True):
                    texts.append(main_text(page, odds[at : at + len(x)]))
                    at += len(x)
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
