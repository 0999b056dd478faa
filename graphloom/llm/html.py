"""Operator 1, main-text extraction by wrapper induction.

Each host gets a reference page (the smallest id with any html). Every page of the host is aligned with it by simple tree
matching: of two nodes with equal tags, children are aligned in order so that the whole subtrees match in the most nodes.
Weights of subtrees depend on their shape alone, so they are worked out once per pair of shapes; equal shapes at both
ends are paired first, which never costs a node, and long child lists are aligned in linear memory. Counts of matched and
of equal leaves, added up per host with map-side sums, tell constant leaves (template) from varying slots (content). In a
second pass a page is aligned again, its leaves that equal the template's constant ones fall away, and of the rest the
article is taken, without regions whose element, role or class name marks menus, headers, footers, sidebars, notices,
adverts, forms, scripts or comments. A class name marks as a whole or as a compound of known words ("left-sidebar", not
"has-sidebar"), and never what holds the article (see :func:`spare`).

References travel as skeletons (tags, depths, leaf hashes), found by id, so no html is shuffled while the hosts' list is
small. Defined results: null or empty html gives an empty text; unclosed, stray and cut-off tags are repaired as they
come; a page that is alone on its host has nothing to be compared with and is judged by its structure; all its articles
(or mains) in page order count, and a page without any gives the smallest element around all its paragraphs (without
paragraphs: around all its text) that is not template; a text that would be template throughout, or an article that would
lose more than TEMPLATE_IN_ARTICLE of itself, is kept whole (pages of one article, not a template); equal pages and
repeated rows each get their row, equal pages count once; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm.common import pinned, spread, table

#: Element names by role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript template svg math object select button canvas audio video".split())
BLOCK = frozenset(
    "html head body article section main header footer nav aside form fieldset div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption"
    " blockquote pre figure figcaption address details summary dialog center hgroup menu search".split()
)
DROPPED = frozenset("head header footer nav aside form fieldset menu dialog search".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words of class, id or role that mark a region as no part of the article.
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside"
    " header masthead footer foot copyright notice notices cookie cookies consent alert popup modal newsletter subscribe signup login form search share sharing social related"
    " recommended comment comments commentlist reply replies disqus respond widget toolbar pagination pager complementary contentinfo".split()
)
#: Words that go with a mark in one class name; the second ones not with header, which may hold the article's heading.
PLACES = frozenset(
    "site page main global top bottom left right primary secondary first second upper lower fixed sticky list item items bar box block area container wrapper wrap inner outer section region group"
    " panel module row col column links link button buttons icons media slot unit banner message policy overlay google leaderboard text content info js id c".split()
)
OWNERS = frozenset("article post posts entry story blog".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_NAMES = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: A leaf is template if it is equal in this share of its matches, over at least so many pages.
SHARE, LEAST_PAGES = 0.6, 2
#: An element marked up as article or main loses constant leaves only if they are at most this share of its text.
TEMPLATE_IN_ARTICLE = 0.2
#: Skeletons of all hosts are broadcast up to so many bytes together, else joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Counts of equal pages are broadcast up to so many rows, else joined by shuffle; so are the hosts' reference ids.
BROADCAST_COPIES = BROADCAST_HOSTS = 200_000
#: Child lists up to so many cells are aligned in one table; larger ones are halved (Hirschberg), with the same weight.
CELLS = 1 << 20


class Node:
    """An element, or a leaf (tag ``#t``) with the text of one run of inline content."""

    __slots__ = ("tag", "out", "kids", "text", "links", "key")

    def __init__(self, tag: str, out: bool = False) -> None:
        self.tag, self.out, self.kids, self.text, self.links, self.key = tag, out, [], "", 0, -1


def parse(html: str) -> Node:
    root = Node("#root")
    stack, run, linked, anchors = [root], [], 0, 0
    at, n = 0, len(html)

    def flush() -> None:
        nonlocal run, linked
        text = " ".join("".join(run).split())
        if text:
            leaf = Node("#t")
            leaf.text, leaf.links = text, min(linked, len(text))
            stack[-1].kids.append(leaf)
        run, linked = [], 0

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            piece = unescape(html[at:lt])
            run.append(piece)
            linked += len(piece) if anchors else 0
        if lt >= n:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(html, lt) or _LOOSE.match(html, lt)
        if not m:
            if lt + 1 < n and (html[lt + 1].isalpha() or html[lt + 1] == "/") and html.find(">", lt) < 0:
                break  # a tag cut off at the end
            run.append("<")
            at = lt + 1
            continue
        close, tag, attrs = m[1], m[2].lower(), m[3]
        at = m.end()
        if tag in RAW and not close and not attrs.endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = n if end is None else end.end()
            run.append(" ")
        elif tag == "a":
            anchors = max(0, anchors + (-1 if close else 1))
        elif tag == "br":
            run.append(" ")
        elif tag in BLOCK:
            flush()
            if close:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
            else:
                if stack[-1].tag == "p" or stack[-1].tag in CLOSES.get(tag, ()):
                    stack.pop()
                names = " ".join(x for g in _NAMES.findall(attrs) for x in g if x).lower() if "=" in attrs else ""
                marked = any(map(marks, names.split())) and tag not in ("html", "body")
                node = Node(tag, tag in DROPPED or marked or "hidden" in attrs.lower().split())
                stack[-1].kids.append(node)
                stack.append(node)
    flush()
    spare(root)
    return root


def marks(token: str) -> bool:
    """A class, id or role that is a mark, or a compound of marks and of words that say where a region is or what holds it."""
    words = [w for w in re.split(r"[^a-z]+", token) if w]
    found = [w for w in words if w in MARKS]
    return bool(found) and all(w in MARKS or w in PLACES or w in OWNERS and "header" not in found for w in words)


def spare(root: Node) -> None:
    """Takes the mark off what is or holds the main element; where no article or main is left unmarked, also off what is or holds an article with, or simply holds, more than half of the page's paragraph text."""
    order, above, todo = [], {root: None}, [root]
    while todo:
        v = todo.pop()
        order.append(v)
        for k in v.kids:
            above[k] = v
        todo.extend(v.kids)
    if not any(v.out for v in order):
        return
    text = {v: 0 for v in order}
    for v in reversed(order):
        text[v] += len(v.text) if v.tag == "#t" and above[v].tag == "p" else 0
        if above[v] is not None:
            text[above[v]] += text[v]

    def free(v: Node | None) -> None:
        while v is not None:
            v.out, v = False, above[v]

    def reached(v: Node | None) -> bool:
        while v is not None:
            if v.out:
                return False
            v = above[v]
        return True

    for v in order:
        if v.tag == "main":
            free(v)
    if any(v.tag in ("article", "main") and reached(v) for v in order):
        return
    for v in order:
        if v.out and 2 * text[v] > text[root]:
            free(v)


def digest(text: str) -> int:
    return crc32(text.encode("utf-8", "replace"))


def skeleton(root: Node) -> list[tuple[str, int, int]]:
    """(tag, depth, hash of a leaf's text) in page order."""
    out, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        out.append((node.tag, depth, digest(node.text) if node.tag == "#t" else 0))
        todo.extend((k, depth + 1) for k in reversed(node.kids))
    return out


def grown(rows: list) -> Node:
    """The tree of a skeleton; a node's key is its place, its text hash lies in links."""
    stack: list[Node] = []
    for i, (tag, depth, text) in enumerate(rows):
        node = Node(tag)
        node.key, node.links = i, text
        del stack[depth:]
        if stack:
            stack[-1].kids.append(node)
        stack.append(node)
    return stack[0]


class Matching:
    """Simple tree matching of trees by shape: a shape is a tag and the shapes of its children, numbered as met."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.parts: list[tuple] = []
        self.sizes: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def shapes(self, root: Node) -> dict[Node, int]:
        order, todo, out = [], [root], {}
        while todo:
            v = todo.pop()
            order.append(v)
            todo.extend(v.kids)
        for v in reversed(order):
            part = (v.tag, *(out[k] for k in v.kids))
            if (number := self.numbers.get(part)) is None:
                number = self.numbers[part] = len(self.parts)
                self.parts.append(part)
                self.sizes.append(1 + sum(self.sizes[k] for k in part[1:]))
            out[v] = number
        return out

    def weight(self, a: int, b: int) -> int:
        """Most nodes that two shapes can match; pairs that are still needed are worked out first, so depth is no matter."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.known:
                todo.pop()
                continue
            if x == y or self.parts[x][0] != self.parts[y][0]:
                self.known[x, y] = self.sizes[x] if x == y else 0
                continue
            p, q = self.parts[x][1:], self.parts[y][1:]
            i, j = ends(p, q)
            p, q = p[i : len(p) - j], q[i : len(q) - j]
            need = [(u, v) for u in set(p) for v in set(q) if (u, v) not in self.known]
            if need:
                todo.extend(need)
                continue
            same = sum(self.sizes[k] for k in (*self.parts[x][1 : 1 + i], *(self.parts[x][len(self.parts[x]) - j :] if j else ())))
            self.known[x, y] = 1 + same + int(scores(self.table(p, q))[-1] if p and q else 0)
        return self.known[a, b]

    def table(self, p: tuple, q: tuple) -> Pairs:
        """Weights of all pairs of two child lists."""
        left, at = np.unique(np.array(p), return_inverse=True)
        right, to = np.unique(np.array(q), return_inverse=True)
        few = np.array([[self.weight(int(u), int(v)) for v in right] for u in left], np.int64)
        return Pairs(few, at, to)

    def pairs(self, p: list[int], q: list[int]) -> list[tuple[int, int]]:
        """Places of children that are matched, of an alignment with the largest weight."""
        i, j = ends(p, q)
        out = [*((k, k) for k in range(i)), *((len(p) - 1 - k, len(q) - 1 - k) for k in range(j))]
        p, q = p[i : len(p) - j], q[i : len(q) - j]
        if p and q:
            out += ((i + u, i + v) for u, v in aligned(self.table(tuple(p), tuple(q))))
        return out


class Pairs:
    """A matrix of weights by (row class, column class)."""

    def __init__(self, few: np.ndarray, at: np.ndarray, to: np.ndarray) -> None:
        self.few, self.at, self.to = few, at, to

    def row(self, i: int) -> np.ndarray:
        return self.few[self.at[i]][self.to]

    def cut(self, rows: slice, cols: slice) -> Pairs:
        return Pairs(self.few, self.at[rows], self.to[cols])


def ends(p, q) -> tuple[int, int]:
    """How many equal shapes two lists start with, and how many more they end with."""
    n = min(len(p), len(q))
    i = 0
    while i < n and p[i] == q[i]:
        i += 1
    j = 0
    while j < n - i and p[-1 - j] == q[-1 - j]:
        j += 1
    return i, j


def scores(w: Pairs) -> np.ndarray:
    """Largest weight of the whole of w's rows against each leading part of its columns."""
    best = np.zeros(len(w.to) + 1, np.int64)
    for i in range(len(w.at)):
        step = best.copy()
        np.maximum(step[1:], best[:-1] + w.row(i), out=step[1:])
        best = np.maximum.accumulate(step)
    return best


def aligned(w: Pairs) -> list[tuple[int, int]]:
    """(row, column) pairs, in order, of positive weight and of the largest sum."""
    n, m = len(w.at), len(w.to)
    if n > 1 and n * m > CELLS:
        half = n // 2
        first = scores(w.cut(slice(0, half), slice(None)))
        second = scores(Pairs(w.few, w.at[half:][::-1], w.to[::-1]))[::-1]
        k = int(np.argmax(first + second))
        return [*aligned(w.cut(slice(0, half), slice(0, k))), *((half + i, k + j) for i, j in aligned(w.cut(slice(half, None), slice(k, None))))]
    best = np.zeros((n + 1, m + 1), np.int64)
    for i in range(n):
        step = best[i].copy()
        np.maximum(step[1:], best[i, :-1] + w.row(i), out=step[1:])
        best[i + 1] = np.maximum.accumulate(step)
    out, i, j = [], n, m
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def matched(page: Node, ref: Node) -> None:
    """Sets key of page's nodes to that of their partners in ref, by simple tree matching."""
    m = Matching()
    shape, other = m.shapes(page), m.shapes(ref)
    page.key, todo = ref.key, [(page, ref)]
    while todo:
        a, b = todo.pop()
        for i, j in m.pairs([shape[k] for k in a.kids], [other[k] for k in b.kids]):
            u, v = a.kids[i], b.kids[j]
            u.key = v.key
            if u.kids and v.kids:
                todo.append((u, v))


def main_text(root: Node, constant: dict[int, int] | None = None) -> str:
    """Blocks of the article in page order, two line ends between them; constant: place and text hash of the template's leaves."""
    known = constant or {}

    def fixed(v: Node) -> bool:
        return v.key in known and known[v.key] == digest(v.text)

    found: dict[str, list[Node]] = {"article": [], "main": []}
    above: dict[Node, Node | None] = {root: None}
    holders: dict[bool, list[Node]] = {True: [], False: []}
    todo = [root]
    while todo:
        v = todo.pop()
        if v.tag in found:
            found[v.tag].append(v)
        for c in v.kids:
            if c.tag == "#t" and not fixed(c):
                holders[v.tag == "p"].append(v)
            elif not c.out:
                above[c] = v
        todo.extend(k for k in reversed(v.kids) if not k.out)

    def line(v: Node | None) -> list[Node]:
        out = []
        while v is not None:
            out.append(v)
            v = above[v]
        return out[::-1]

    tops = found["article"] or found["main"]
    if tops:
        inside = set(tops)
        start = [t for t in tops if inside.isdisjoint(line(t)[:-1])]
    else:
        blocks = holders[True] or holders[False]
        shared = line(blocks[0] if blocks else root)
        for v in blocks[1:]:
            shared = [x for x, y in zip(shared, line(v)) if x is y]
        start = [above[shared[-1]] if shared[-1].tag == "p" else shared[-1]]
    leaves, todo = [], start[::-1]
    while todo:
        v = todo.pop()
        if v.tag == "#t":
            leaves.append(v)
        elif not (v.tag in ("ul", "ol", "table") and menu(v)):
            todo.extend(k for k in reversed(v.kids) if not k.out)
    own = [v for v in leaves if not fixed(v)]
    dropped, whole = sum(len(v.text) for v in leaves if fixed(v)), sum(len(v.text) for v in leaves)
    if not own or tops and dropped > TEMPLATE_IN_ARTICLE * whole:
        own = leaves  # pages of one article, not a template
    return "\n\n".join(v.text for v in own)


def menu(node: Node) -> bool:
    """A list whose text is links nearly throughout."""
    chars = links = 0
    todo = list(node.kids)
    while todo:
        v = todo.pop()
        chars, links = chars + len(v.text), links + v.links
        todo.extend(v.kids)
    return chars > 0 and links >= 0.9 * chars


def _host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit("")))


def reference(trees: dict[str, tuple[list, Node]], host: str, ref: str) -> tuple[list, Node]:
    """A host's skeleton and its tree, made once a batch."""
    if host not in trees:
        rows = json.loads(ref)
        trees[host] = rows, grown(rows)
    return trees[host]


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    rows = _host(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")))
    named = F.when(F.col("html") != "", F.col("page_id"))
    first = pinned(rows.groupBy("host").agg(F.min(named).alias("page_id"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= LEAST_PAGES) & F.col("page_id").isNotNull()).select("host", "page_id"))

    def outline(batch: pa.Array) -> pa.Array:
        return pa.array([json.dumps(skeleton(parse(h.as_py())), separators=(",", ":")) for h in batch], pa.string())

    outline.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    # Only skeletons of the chosen pages are shuffled; of several rows with the reference's id the smallest counts.
    chosen = rows.filter(F.col("html") != "").select("host", "page_id", "html").join(F.broadcast(first) if first.count() <= BROADCAST_HOSTS else spread(first), ["host", "page_id"])
    refs = pinned(chosen.select("host", F.arrow_udf(outline, "string")("html").alias("ref")).groupBy("host").agg(F.min("ref").alias("ref")))
    small = (refs.agg(F.sum(F.octet_length("ref") + 64)).first()[0] or 0) <= BROADCAST_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, int], list[float]] = {}
            trees: dict[str, tuple[list, Node]] = {}
            for host, html_, ref, w in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "ref", "w"))):
                rows_, tree = reference(trees, host, ref)
                page = parse(html_)
                matched(page, tree)
                todo = [page]
                while todo:
                    v = todo.pop()
                    if v.tag == "#t" and v.key >= 0:
                        c = seen.setdefault((host, v.key), [0.0, 0.0])
                        c[0] += w
                        c[1] += w * (digest(v.text) == rows_[v.key][2])
                    todo.extend(v.kids)
            if seen:
                yield pa.RecordBatch.from_pydict({"host": [k[0] for k in seen], "leaf": [k[1] for k in seen], "n": [c[0] for c in seen.values()], "same": [c[1] for c in seen.values()]})

    keyed = rows.join(F.broadcast(refs) if small else spread(refs), "host")
    # Equal pages of a host count as one: each of c copies by 1 / c.
    copies = pinned(rows.groupBy("host", F.xxhash64("html").alias("payload")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    few = copies.count() <= BROADCAST_COPIES
    keyed = keyed.withColumn("payload", F.xxhash64("html")).join(F.broadcast(copies) if few else spread(copies), ["host", "payload"], "left")
    keyed = keyed.select("host", "html", "ref", (F.lit(1.0) / F.coalesce("c", F.lit(1))).alias("w"))
    counts = keyed.mapInArrow(count, "host string, leaf long, n double, same double").groupBy("host", "leaf").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
    fixed = counts.filter((F.col("n") >= LEAST_PAGES - 1e-6) & (F.col("same") >= SHARE * F.col("n") - 1e-6)).groupBy("host").agg(F.sort_array(F.collect_list("leaf")).alias("fixed"))
    known = pinned(refs.join(fixed, "host"))
    small = (known.agg(F.sum(F.octet_length("ref") + 8 * F.size("fixed") + 64)).first()[0] or 0) <= BROADCAST_BYTES

    def text(host: pa.Array, html_: pa.Array, ref: pa.Array, fixed_: pa.Array) -> pa.Array:
        out, trees = [], {}
        for o, h, r, f in zip(host.to_pylist(), html_.to_pylist(), ref.to_pylist(), fixed_.to_pylist()):
            page, rows_ = parse(h), []
            if f:
                rows_, tree = reference(trees, o, r)
                matched(page, tree)
            out.append(main_text(page, {k: rows_[k][2] for k in f or ()}))
        return pa.array(out, pa.string())

    text.__annotations__ = {"host": pa.Array, "html_": pa.Array, "ref": pa.Array, "fixed_": pa.Array, "return": pa.Array}
    done = rows.join(F.broadcast(known) if small else spread(known), "host", "left").select("page_id", "url", F.arrow_udf(text, "string")("host", "html", "ref", "fixed").alias("text"))
    return done.select(F.col("page_id").alias(page_id), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
