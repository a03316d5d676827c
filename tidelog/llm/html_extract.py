"""Main text of web pages by wrapper induction.

A page becomes a tree of block elements whose leaves are blocks of text, menus and footers included; only what is never
shown (head, scripts, controls) is left out. The pages of a host with the same structural elements are a layout, and one
of them stands for it; pages of a layout with fewer than LEAST_PAGES go by the host's commonest. Every page is aligned
with its layout's by simple tree matching and votes, for each of its leaves, whether the aligned text is the same; leaves
of pages that pair with none are counted exactly, by place, class and text, over the host. A text that LEAST_PAGES pages
have, and CONSTANT of those that vote, is the host's template, all others are slots. Pages whose texts are all the same vote once, so copies don't turn into template. From each page the texts
that are template at their place go; slots are content.

Names (nav, footer, class="ad" and so on) decide only what votes leave open: a slot in a region that is named as
boilerplate goes, unless the region holds most of the text that varies on the host's pages that have it. Classes and ids
name containers only, ids by the whole id; inside an article only whole classes and ids of known widgets count. Where a host has
fewer than LEAST_PAGES different pages nothing can vote: then an article or main part counts alone if it holds most of
the page's text, and else lists of nothing but links go too. A page of which template leaves nothing keeps its texts.

Defined cases: a null page counts as empty and has an empty text; without a host in the url there is no template;
unclosed and misnested elements are closed where a block of the same kind begins; an unclosed comment or script lasts
to the end; repeated rows are extracted each; an empty table gives no rows; other columns are ignored, whatever their
names. Nothing is cut, however long.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import materialise, text_chunks

#: Different pages from which a host's leaves are told apart, and the share of equal ones that makes a leaf template.
LEAST_PAGES, CONSTANT = 3, 0.9
#: Share of the text above which a named region or an article holds most of it.
MOST = 0.5
#: What equal texts and equal classes add to a pair of nodes.
SAME_TEXT, SAME_CLASS = 1.0, 0.25
#: Elements nested deeper count as part of the one above; their text is the same.
DEPTH = 200
#: Cells up to which a table of weights is kept whole, children from which its rows are arrays, scores that are kept of small
#: tables, and numbers up to which nodes get one for each set of texts. They bear on cost only.
CELLS, WIDE, SCORES, NUMBERS = 250_000, 64, 1_000_000, 200_000
#: Bytes of references or templates that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
WORD = re.compile(r"[a-z]+|[0-9]+")
#: Elements whose content isn't markup, up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption button select option noscript template svg canvas object video audio label".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An element of the first kind that is open ends where one of the second begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
INSIDE = frozenset("ul ol dl table div article section main body select".split())
#: Never shown as text, or the inside of a control.
HIDDEN = frozenset("head script style noscript template svg canvas object video audio button select label".split())
DROPPED = frozenset("nav footer aside form dialog menu".split())
#: Elements that make a layout; what an article holds inside doesn't.
STRUCTURE = frozenset("html body header nav main article aside footer section div form dialog menu".split())
DROPPED_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget complementary contentinfo".split()
)
#: Only outside an article; inside, a header holds its title.
PAGE_WORDS = frozenset(("header", "masthead", "topbar"))
#: Elements that a class or id can name as boilerplate; headings, paragraphs, items and cells are text.
NAMED = frozenset("div section ul ol dl table details center header hgroup fieldset address".split())
#: Whole classes and ids that name a widget inside an article too.
WIDGETS = frozenset("ad ads adsbygoogle adsense advert adverts advertisement advertising breadcrumb breadcrumbs comments cookie-notice cookie-banner disqus disqus_thread navbar newsletter newsletter-signup pagination pager popup promo related-posts related-articles respond share-buttons sharedaddy sharing sidebar social-share sponsored subscribe toolbar".split())
ROLES = frozenset("navigation complementary contentinfo banner search dialog alertdialog menu menubar toolbar".split())

Node = list  # [tag, text key or None, children, leaf number, class]


@lru_cache(maxsize=1 << 16)
def below(path: int, name: str) -> int:
    """The path of an element of this name below another."""
    return xxhash.xxh3_64_intdigest(f"{path}/{name}") >> 1


class Leaf(NamedTuple):
    text: str
    #: Elements around it that are named as boilerplate.
    regions: tuple[int, ...]
    article: bool
    links: bool
    path: int
    parent: int
    #: Its text at its place.
    mark: int
    #: Its place and the class there.
    slot: int


def tag_end(html: str, at: int, failed: set[int]) -> int:
    """Where the tag ends whose attributes begin here: the first > outside quotes; -1 if quotes don't close before one. failed:
    openings of quotes from which none was found, so that nothing is searched twice."""
    seen = []
    while m := SPECIAL.search(html, at):
        i = m.start()
        if html[i] == ">":
            return i
        if i in failed:
            break
        seen.append(i)
        if (close := html.find(html[i], i + 1)) < 0:
            break
        at = close + 1
    failed.update(seen)
    return -1


def tags(html: str) -> Iterator[tuple[int, int, str, str]]:
    """Tags, comments and declarations in order: start, end, name (empty if none; / before a closing one) and attributes.

    Reads the page once. Quotes that don't close don't count: then a tag ends at the first >."""
    failed: set[int] = set()
    last, start = html.rfind(">"), html.find("<")
    while 0 <= start < last:
        second, name, attributes = html[start + 1 : start + 2], "", ""
        if html.startswith("<!--", start):
            close = html.find("-->", start + 4)
            end = close + 3 if close >= 0 else len(html)
        elif m := NAME.match(html, start + 1):
            close = tag_end(html, m.end(), failed)
            end = (close if close >= 0 else html.find(">", m.end())) + 1
            name, attributes = m[0].lower(), html[m.end() : end - 1]
        elif second and second in "!?/":
            end = html.find(">", start + 2) + 1
        else:
            start = html.find("<", start + 1)
            continue
        # where an element's content isn't markup, the reader asks to go on behind it
        further = yield start, end, name, attributes
        start = html.find("<", further or end)
    if start >= 0 and (start := html.find("<!--", start)) >= 0:
        yield start, len(html), "", ""


class Page:
    """The block tree of a page, and its leaves."""

    def __init__(self, html: str):
        self.root: Node = ["", None, [], -1, 0]
        self.leaves: list[Leaf] = []
        self.layout: set[int] = set()
        # tag, node, regions (None if hidden), in the article, path, number of the element
        self._opened = 0
        self._stack: list[tuple[str, Node, tuple[int, ...] | None, bool, int, int]] = [("", self.root, (), False, 0, 0)]
        self._text: list[str] = []
        self._links = self._chars = self._in_link = 0
        self._open_now: Counter[str] = Counter()
        at, size = 0, len(html)
        found, further = tags(html), None
        while True:
            try:
                start, end, name, attributes = found.send(further)
            except StopIteration:
                break
            further = None
            if start > at:
                self._add(html[at:start])
            at = end
            if name.startswith("/"):
                self._close(name[1:])
            elif name:
                self._open(name, attributes)
                if name in RAW:
                    closing = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
                    at = further = closing.end() if closing else size
                    if name in BLOCKS:
                        self._close(name)
        if at < size:
            self._add(html[at:])
        self._flush()
        folded(self.root)

    def _add(self, text: str) -> None:
        self._text.append(text)
        n = len(text) - text.count(" ")
        self._chars += n
        if self._in_link:
            self._links += n

    def _flush(self) -> None:
        if self._text:
            raw = "".join(self._text)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                name, node, regions, article, path, _ = self._stack[-1]
                if regions is not None:
                    key = xxhash.xxh3_64_intdigest(text) >> 12
                    # a list's item counts with its list
                    parent = self._stack[-2][5] if len(self._stack) > 1 else 0
                    node[2].append(["#", key, (), len(self.leaves), 0])
                    self.leaves.append(Leaf(text, regions, article, 0 < self._chars <= self._links, path, parent, below(path, str(key)), below(path, str(node[4]))))
            self._text = []
        self._links = self._chars = 0

    def _open(self, name: str, attributes: str) -> None:
        if name not in BLOCKS:
            if name == "br":
                self._text.append(" ")
            elif name == "a":
                self._in_link = 1
            return
        self._flush()
        self._in_link = 0
        if self._stack[-1][0] == "p":
            self._cut(len(self._stack) - 1)
        if name in ENDS and any(self._open_now[other] for other in ENDS[name]):
            for k in range(len(self._stack) - 1, 0, -1):
                if self._stack[k][0] in ENDS[name]:
                    self._cut(k)
                    break
                if self._stack[k][0] in INSIDE:
                    break
        if name in VOID:
            return
        _, parent, regions, article, path, _ = self._stack[-1]
        path = below(path, name)
        self._opened += 1
        words: set[str] = set()
        tokens: set[str] = set()
        roles: set[str] = set()
        label = name
        if attributes and ("=" in attributes):
            for kind, value in ATTRIBUTE.findall(attributes):
                value, kind = value.strip("\"'").lower(), kind.lower()
                if kind == "role":
                    roles.update(value.split())
                elif kind == "class":
                    label = f"{name}.{value}"
                    words.update(WORD.findall(value))
                    tokens.update(value.split())
                elif name != "section":
                    tokens.add(value)
        named = name in DROPPED or bool(roles & ROLES)
        if name in NAMED:
            named = named or bool(tokens & WIDGETS)
            if not article:
                named = named or name == "header" or not words.isdisjoint(DROPPED_WORDS | PAGE_WORDS) or not tokens.isdisjoint(DROPPED_WORDS | PAGE_WORDS)
        if (name in ("article", "main") or "main" in roles) and not regions and not named:
            article = True
        if name in HIDDEN:
            regions = None
        if regions is not None:
            if named and len(self._stack) < DEPTH:
                regions = (*regions, below(path, label))
            if name in STRUCTURE:
                self.layout.add(path)
        node: Node = [name, None, [], -1, below(0, label)] if len(self._stack) < DEPTH else parent
        if regions is not None and node is not parent:
            parent[2].append(node)
        self._stack.append((name, node, regions, article, path, self._opened))
        self._open_now[name] += 1

    def _cut(self, k: int) -> None:
        """Closes what is open from the k-th on."""
        for opened in self._stack[k:]:
            self._open_now[opened[0]] -= 1
        del self._stack[k:]

    def _close(self, name: str) -> None:
        if name == "a":
            self._in_link = 0
        if name not in BLOCKS:
            return
        self._flush()
        if self._open_now[name]:
            self._cut(next(k for k in range(len(self._stack) - 1, 0, -1) if self._stack[k][0] == name))


def folded(node: Node) -> None:
    """Makes an element with a single text its leaf."""
    for child in node[2]:
        folded(child)
    if len(node[2]) == 1 and node[2][0][0] == "#" and node[0]:
        node[1:4] = node[2][0][1:4]


class Columns:
    """A long list of nodes' numbers, as the columns of a table of weights."""

    def __init__(self, trees: Matching, y: tuple[int, ...]):
        self.trees = trees
        self.nodes = [*dict.fromkeys(y)]
        places = {q: k for k, q in enumerate(self.nodes)}
        self.at = np.array([places[q] for q in y])
        shapes = [trees.shape[q] for q in self.nodes]
        self.shapes = [*dict.fromkeys(shapes)]
        places = {q: k for k, q in enumerate(self.shapes)}
        self.shape_at = np.array([places[q] for q in shapes])
        self.having: dict[int, list[int]] = {}
        for k, q in enumerate(self.nodes):
            for text in trees.texts[q]:
                self.having.setdefault(text, []).append(k)

    def weights(self, p: int) -> np.ndarray:
        """Of a node with each column. Without a text in common only shapes count."""
        trees = self.trees
        shape = trees.shape[p]
        found = np.array([trees.weight(shape, q) for q in self.shapes])[self.shape_at]
        for k in {k for text in trees.texts[p] for k in self.having.get(text, ())}:
            found[k] = trees.weight(p, self.nodes[k])
        return found[self.at]


class Matching:
    """Two trees whose nodes are numbered such that nodes of one number weigh the same with any node of the other tree: texts
    and classes that only one tree has count as one."""

    def __init__(self, a: Node, b: Node):
        (keys, kinds), (other_keys, other_kinds) = (self._held(x) for x in (a, b))
        self._keys, self._kinds = keys & other_keys, kinds & other_kinds
        self._numbers: dict[tuple, int] = {}
        self._scores: dict[tuple[int, int], float] = {}
        self._columns: dict[tuple[int, ...], Columns] = {}
        self._cut: dict[tuple[int, frozenset[int]], int] = {}
        self.tag: list[str] = []
        self.key: list[int | str | None] = []
        self.kind: list[int | str] = []
        self.inner: list[tuple[int, ...]] = []
        self.side: list[str] = []
        #: Texts below a node that both trees have, and the number of the node without them.
        self.texts: list[frozenset[int]] = []
        self.shape: list[int] = []
        self.roots = self._number(a, "a"), self._number(b, "b")

    @staticmethod
    def _held(node: Node) -> tuple[set, set]:
        keys, kinds, rest = set(), set(), [node]
        while rest:
            _, key, children, _, kind = rest.pop()
            keys.add(key)
            kinds.add(kind)
            rest += children
        return keys - {None}, kinds

    def _number(self, node: Node, side: str) -> int:
        tag, key, children, _, kind = node
        inner = tuple([self._number(child, side) for child in children])
        return self._of(tag, key if key is None or key in self._keys else side, kind if kind in self._kinds else side, inner, side)

    def _of(self, tag: str, key: int | str | None, kind: int | str, inner: tuple[int, ...], side: str) -> int:
        same = (side, tag, key, kind, inner)
        if (found := self._numbers.get(same)) is not None:
            return found
        texts = self.texts[inner[0]] if len(inner) == 1 else frozenset().union(*(self.texts[k] for k in inner))
        if key is not None and key != side:
            texts |= {key}
        shape = self._of(tag, None if key is None else side, kind, tuple([self.shape[k] for k in inner]), side) if texts else len(self.tag)
        found = self._numbers[same] = len(self.tag)
        for column, value in zip((self.tag, self.key, self.kind, self.inner, self.side, self.texts, self.shape), (tag, key, kind, inner, side, texts, shape), strict=True):
            column.append(value)
        return found

    def weight(self, p: int, q: int) -> float:
        """Of the pair of two nodes and all that can be paired below; 0 if their tags differ."""
        if self.tag[p] != self.tag[q]:
            return 0.0
        own = SAME_CLASS if self.kind[p] == self.kind[q] else 0.0
        if self.inner[p] and self.inner[q]:
            return own + self._score(p, q)
        return own + (1.0 + SAME_TEXT if not self.inner[p] and self.key[p] == self.key[q] else 1.0)

    def _score(self, p: int, q: int) -> float:
        if self.texts[p].isdisjoint(self.texts[q]):
            p, q = self.shape[p], self.shape[q]
        else:
            shared = self.texts[p] & self.texts[q]
            p, q = self._only(p, shared), self._only(q, shared)
        found = self._scores.get((p, q))
        if found is None:
            x, y = self.inner[p], self.inner[q]
            for row in self._rows(x, y):
                pass
            found = 1.0 + float(row[-1])
            if len(self._scores) < SCORES or len(x) * len(y) >= WIDE:
                self._scores[p, q] = found
        return found

    def _only(self, p: int, texts: frozenset[int]) -> int:
        """The number of a node without its other texts, which count as one; larger nodes keep theirs."""
        if len(self.texts[p]) >= WIDE or self.texts[p] <= texts:
            return p
        found = self._cut.get((p, texts))
        if found is None:
            if len(self.tag) >= NUMBERS:
                return p
            key, side = self.key[p], self.side[p]
            found = self._cut[p, texts] = self._of(self.tag[p], key if key is None or key in texts else side, self.kind[p], tuple([self._only(k, texts) for k in self.inner[p]]), side)
        return found

    def _rows(self, x: tuple[int, ...], y: tuple[int, ...], row: list[float] | np.ndarray | None = None) -> Iterator[list[float] | np.ndarray]:
        """The table's rows of x, below the one given: the greatest weight of the nodes so far with the first 0, 1, ... of y."""
        if len(y) < WIDE:
            row = row or [0.0] * (len(y) + 1)
            for p in x:
                last, row, left = row, [0.0], 0.0
                for j, q in enumerate(y):
                    best = last[j + 1]
                    if left > best:
                        best = left
                    w = last[j] + self.weight(p, q)
                    if w > best:
                        best = w
                    left = best
                    row.append(best)
                yield row
            return
        if (columns := self._columns.get(y)) is None:
            columns = self._columns[y] = Columns(self, y)
        row, before = np.zeros(len(y) + 1) if row is None else row, None
        for p in x:
            if p != before:
                weights, before = columns.weights(p), p
            last, row = row, np.zeros(len(y) + 1)
            np.maximum.accumulate(np.maximum(last[1:], last[:-1] + weights), out=row[1:])
            yield row

    def pair(self, a: Node, b: Node, p: int, q: int, pairs: list[tuple[int, int, bool]]) -> float:
        """Adds the leaves paired below two nodes of these numbers; the pair's score. Of a table of more than CELLS some rows
        are kept, and the rows between them made again."""
        x, y = self.inner[p], self.inner[q]
        i, j = len(x), len(y)
        step = i if i * j <= CELLS else min(i, isqrt(i) + 1)
        kept, end = [None], 0.0
        table: list = []
        for k, row in enumerate(self._rows(x, y), 1):
            if step == len(x):
                table.append(row)
            elif k % step == 0:
                kept.append(row)
        end = 1.0 + float(row[-1])
        for start in range((len(x) - 1) // step * step, -1, -step):
            if step < len(x):
                table = [*self._rows(x[start : start + step], y, kept[start // step])]
            table.insert(0, [0.0] * (len(y) + 1) if kept[start // step] is None else kept[start // step])
            while i > start and j:
                here = table[i - start][j]
                if here == table[i - start - 1][j]:
                    i -= 1
                elif here == table[i - start][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    m, n = a[2][i], b[2][j]
                    if m[3] >= 0 and n[3] >= 0:
                        pairs.append((m[3], n[3], m[1] == n[1]))
                    elif m[2] and n[2]:
                        self.pair(m, n, x[i], y[j], pairs)
        return end


def match(a: Node, b: Node, pairs: list[tuple[int, int, bool]]) -> float:
    """Simple tree matching of two nodes of one tag: the greatest number of nodes that can be paired in order, level by
    level, plus SAME_TEXT for each pair of leaves with the same text and SAME_CLASS for nodes of the same class; the same
    whatever the size. pairs: gets the leaves paired, and if they are the same."""
    if not a[2] or not b[2]:
        return 1.0
    trees = Matching(a, b)
    return trees.pair(a, b, *trees.roots, pairs)


def main_text(page: Page, template: set[int], voted: bool = False, overruled: frozenset[int] = frozenset()) -> str:
    """template: leaves of the page that are their host's template; voted: whether its host has pages enough to tell slots
    from template; overruled: regions whose name doesn't count."""
    named = [leaf for leaf in page.leaves if overruled.issuperset(leaf.regions)]
    kept = [leaf for k, leaf in enumerate(page.leaves) if k not in template and overruled.issuperset(leaf.regions)] or named
    if not voted:
        if sum(len(leaf.text) for leaf in kept if leaf.article) > MOST * sum(len(leaf.text) for leaf in kept):
            kept = [leaf for leaf in kept if leaf.article]
        else:
            links = Counter(leaf.parent for leaf in kept if leaf.links)
            links.subtract(Counter({leaf.parent: len(kept) for leaf in kept if not leaf.links}))
            kept = [leaf for leaf in kept if links[leaf.parent] < 2 or leaf.article]
    return "\n\n".join(leaf.text for leaf in kept)


def with_host(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host.alias("_host"))


def digests(paged: DataFrame) -> DataFrame:
    """Per host and different texts of a page: its layout, its tree and what its leaves are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "_html"):
            pages = [Page(h) for h in batch.column("_html").to_pylist()]
            layouts = [xxhash.xxh3_64_intdigest(json.dumps(sorted(p.layout))) >> 1 for p in pages]
            content = [xxhash.xxh3_128_hexdigest(json.dumps([leaf.mark for leaf in p.leaves])) for p in pages]
            trees = [json.dumps([p.root, [(leaf.mark, leaf.slot, len(leaf.text), leaf.regions) for leaf in p.leaves]]) for p in pages]
            yield pa.RecordBatch.from_arrays([batch.column("_host"), pa.array(layouts, pa.int64()), pa.array(content, pa.string()), pa.array(trees, pa.string())], ["_host", "layout", "content", "tree"])

    found = paged.where((F.col("_host") != "") & F.col("_html").isNotNull()).select("_host", "_html").mapInArrow(run, "_host string, layout long, content string, tree string")
    return found.groupBy("_host", "layout", "content").agg(F.min("tree").alias("tree"))


def joined(left: DataFrame, right: DataFrame, on: list[str], size_of: str) -> DataFrame:
    """Left join; right is broadcast if it is small."""
    size = right.agg(F.sum(F.length(F.col(size_of).cast("string")))).first()[0] or 0
    return left.join(F.broadcast(right) if size <= BROADCAST_BYTES else right, on, "left")


@lru_cache(maxsize=64)
def reference_of(packed: str) -> list:
    return json.loads(packed)


def template_votes(pages: DataFrame) -> DataFrame:
    """Per host: `template`, the marks of the leaves that are constant. pages: digests, each with its standard layout and
    its reference. A slot is a leaf of a reference, or, for leaves that pair with none, a place and class of the host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "tree"):
            same: Counter[tuple[str, str, int]] = Counter()
            votes: Counter[tuple[str, str, int]] = Counter()
            for host, layout, packed, reference in zip(*(batch.column(c).to_pylist() for c in ("_host", "standard", "tree", "reference")), strict=True):
                (tree, own), (standard, marks) = json.loads(packed), reference_of(reference)
                pairs: list[tuple[int, int, bool]] = []
                match(standard, tree, pairs)
                for mine, _, equal in pairs:
                    key = (host, f"{layout}:{mine}", marks[mine][0])
                    votes[key] += 1
                    same[key] += equal
                paired = {leaf for _, leaf, _ in pairs}
                extra = {(slot, mark) for k, (mark, slot, *_) in enumerate(own) if k not in paired}
                same.update((host, f"+{slot}", mark) for slot, mark in extra)
                votes.update((host, f"+{slot}", 0) for slot in {slot for slot, _ in extra})
            if votes:
                keys = [*(votes.keys() | same.keys())]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([k[2] for k in keys], pa.int64()), pa.array([same[k] for k in keys], pa.int64()), pa.array([votes[k] for k in keys], pa.int64())], ["_host", "slot", "mark", "same", "votes"])

    counted = pages.select("_host", "standard", "tree", "reference").mapInArrow(run, "_host string, slot string, mark long, same long, votes long").groupBy("_host", "slot", "mark").agg(F.sum("same").alias("same"), F.sum("votes").alias("votes"))
    kept = materialise(counted.where((F.col("same") >= LEAST_PAGES) | (F.col("votes") > 0)))
    totals = kept.groupBy("_host", "slot").agg(F.sum("votes").alias("all"))
    constant = kept.where(F.col("same") >= LEAST_PAGES).join(totals, ["_host", "slot"]).where(F.col("same") >= CONSTANT * F.col("all"))
    return constant.groupBy("_host").agg(F.collect_set("mark").alias("template"))


def overruled_names(pages: DataFrame) -> DataFrame:
    """Per host: `overruled`, the named regions that hold most of the varying text of the pages that have them. pages:
    digests, each with its host's template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "tree"):
            own: Counter[tuple[str, int]] = Counter()
            total: Counter[tuple[str, int]] = Counter()
            for host, packed, constant in zip(*(batch.column(c).to_pylist() for c in ("_host", "tree", "template")), strict=True):
                known, size, inside = {*(constant or ())}, 0, Counter()
                for mark, _, chars, regions in json.loads(packed)[1]:
                    if mark not in known:
                        size += chars
                        for region in regions:
                            inside[region] += chars
                for region, chars in inside.items():
                    own[host, region] += chars
                    total[host, region] += size
            if own:
                keys = [*own]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int64()), pa.array([*own.values()], pa.int64()), pa.array([total[k] for k in keys], pa.int64())], ["_host", "region", "own", "total"])

    counted = pages.select("_host", "tree", "template").mapInArrow(run, "_host string, region long, own long, total long").groupBy("_host", "region").agg(F.sum("own").alias("own"), F.sum("total").alias("total"))
    return counted.where(F.col("own") > MOST * F.col("total")).groupBy("_host").agg(F.collect_set("region").alias("overruled"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: the id, the url and `text`, the main text's blocks with an empty line between them."""
    paged = with_host(pages, id_col, url_col, html_col)
    digest = materialise(digests(paged))
    layouts = materialise(digest.groupBy("_host", "layout").agg(F.count("*").alias("n"), F.min_by("tree", F.struct(F.xxhash64("tree"), "tree")).alias("reference")))
    # pages of a layout too rare to vote are aligned with the host's commonest
    common = layouts.groupBy("_host").agg(F.max_by("layout", F.struct("n", "layout")).alias("commonest"))
    standards = layouts.join(common, "_host").select("_host", "layout", F.when(F.col("n") >= LEAST_PAGES, F.col("layout")).otherwise(F.col("commonest")).alias("standard"))
    references = layouts.select("_host", F.col("layout").alias("standard"), "reference")
    aligned = joined(joined(digest, standards, ["_host", "layout"], "standard"), references, ["_host", "standard"], "reference")
    template = materialise(template_votes(aligned))
    counts = digest.groupBy("_host").agg(F.count("*").alias("pages"))
    voted = digest.join(counts.where(F.col("pages") >= LEAST_PAGES), "_host", "left_semi")
    overruled = overruled_names(joined(voted, template, ["_host"], "template"))
    known = materialise(counts.join(template, "_host", "left").join(overruled, "_host", "left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "_html"):
            texts = []
            for html, n, constant, regions in zip(*(batch.column(c).to_pylist() for c in ("_html", "pages", "template", "overruled")), strict=True):
                page = Page(html or "")
                marks = {*(constant or ())}
                leaves = {k for k, leaf in enumerate(page.leaves) if leaf.mark in marks} if marks else set()
                texts.append(main_text(page, leaves, (n or 0) >= LEAST_PAGES, frozenset(regions or ())))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string())], [id_col, url_col, "text"])

    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    return joined(paged, known, ["_host"], "template").select("_id", "_url", "_html", "pages", "template", "overruled").mapInArrow(run, f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string")
