"""HTML extraction by wrapper induction.

The different pages of a host are dealt into groups of about GROUP. Within a group their block trees are aligned with the largest of them by simple tree matching;
aligned blocks that say the same on both pages are constant, those that differ are slots. Counts of constants from all groups of
a host are added, and what is constant on SHARE of its pages is the host's template; the varying slots are content. A
hot host is therefore many small groups, whose counts a shuffle combines. Only trees of hashes are shuffled, never html.

What is no article by its markup (navigation, page headers and footers, asides, forms, scripts, styles, and elements whose class, id or role names
them an advert, a notice, a sidebar, reader comments and so on) goes first; of the rest, articles or the main element if there are any, else the
body; of that, all blocks that are not template.

Defined results: null or empty html, and a page without text, give an empty text; a null url is a host of its own; copies of a page
count once when constants are counted, so a page that a host repeats is not taken for template; repeated rows each get a row.
"""

from __future__ import annotations

import html as references
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .urls import _host

GROUP = 32
#: Of the different pages of a host, the part on which a block is constant if it is template, and how many pages it takes.
SHARE, LEAST = 0.8, 4
#: What an equal leaf scores: more than all pairs of nodes together.
EQUAL = 2**32
#: Lists of children up to this product of lengths are aligned in one table, longer ones in rows of it.
SMALL = 4096
#: Trees higher than this are scored with a stack.
DEEP = 200

#: Comments, tags and declarations. In a tag a quote opens only behind an equals sign, and one that nothing closes is an ordinary character.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?", re.S)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br", "option", "caption"}
_CLOSES_P = _BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "body", "html"}
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
_WALL = {"table", "ul", "ol", "dl", "td", "th", "div", "article", "section", "body", "main", "select", "nav", "aside", "header", "footer", "form"}
#: Elements that never hold an article's text.
_NOT_TEXT = {"nav", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "button", "select", "dialog", "menu", "head", "textarea", "input", "title", "object", "canvas", "audio", "video", "noembed", "noframes", "xmp"}
#: Words in class, id or role that name something other than the article.
_NOT_NAME = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisements?|advertising|banners?|promos?|promoted|sponsor(?:ed|s)?|nav|navbar|navigation|menus?|breadcrumbs?|side-?bars?|asides?|foot(?:er)?|masthead|page-?header|site-?header|top-?bar|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|widgets?|comments?|replies|disqus|respond|reader-?comments?|contentinfo|complementary|search|skip-?link|pagination|pager|toc|copyright)(?![a-z])",
    re.I,
)


class Node:
    __slots__ = ("tag", "name", "children", "label")

    def __init__(self, tag: str, name: str):
        self.tag, self.name, self.children = tag, name, []  # children: nodes and strings
        self.label = zlib.crc32(f"{tag} {name}".encode())


def parse(text: str) -> Node:
    """A tree of elements and text. Tags that are missing are closed where HTML implies it; what is open at the end closes there."""
    root = Node("#root", "")
    stack, at, end = [root], 0, len(text)
    opened: Counter = Counter()  # tags on the stack

    def drop(k: int) -> None:
        opened.subtract(n.tag for n in stack[k:])
        del stack[k:]

    while at < end:
        m = _TOKEN.search(text, at)
        if m is None:
            stack[-1].children.append(text[at:])
            break
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if not opened[tag]:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    drop(k)
                    break
                if tag not in _BLOCK and stack[k].tag in _BLOCK and stack[k].tag != "p":
                    break  # an inline end tag does not close a block
            continue
        attrs = m[3] or ""
        name = ""
        if attrs and not attrs.isspace():
            found: dict[str, str] = {}
            for a in _ATTR.finditer(attrs):
                found.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
            hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
            name = " ".join(found[k] for k in ("class", "id", "role") if k in found) + (" #hidden" if hidden else "")
        if tag in _CLOSES_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    drop(k)
                    break
                if stack[k].tag in _WALL:
                    break
        if tag in _IMPLIED:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _IMPLIED[tag]:
                    drop(k)
                    break
                if stack[k].tag in _WALL and stack[k].tag not in ("td", "th") or stack[k].tag in ("table", "ul", "ol", "dl"):
                    break
        node = Node(tag, name)
        stack[-1].children.append(node)
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(text, at)
            node.children.append(text[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in _VOID and not attrs.rstrip().endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


class Block:
    """One block of text: how many of the elements around the block before are around it, too, the labels of its further ones, a hash of all of them, what it says, and whether an article holds it.

    A page of any depth takes as much as it has elements and text.
    """

    __slots__ = ("keep", "labels", "place", "text", "inside")

    def __init__(self, keep: int, labels: list[int], place: int, text: str, inside: bool):
        self.keep, self.labels, self.place, self.text, self.inside = keep, labels, place, text, inside


def blocks(text: str | None) -> list[Block]:
    """The blocks of a page that its markup does not name something else, in page order; inside: of an article or the main element."""
    if not text:
        return []
    out: list[Block] = []
    held: list[str] = []
    trail: list[int] = []  # labels of the open elements
    last: list[int] = []  # those around the last block
    low = 0  # up to here trail has not changed since

    def close(place, inside):
        nonlocal low
        said = " ".join(references.unescape("".join(held)).split())
        held.clear()
        if said:
            keep = low
            while keep < min(len(trail), len(last)) and trail[keep] == last[keep]:
                keep += 1
            out.append(Block(keep, trail[keep:], place, said, inside))
            last[keep:] = trail[keep:]
            low = len(trail)

    # An explicit stack: pages may nest deeper than Python recurses. (node, place, inside, next child)
    stack = [[parse(text), 0, False, 0]]
    while stack:
        frame = stack[-1]
        node, place, inside, i = frame
        if i >= len(node.children):
            if node.tag in _BLOCK or node.tag == "#root":
                close(place, inside)
            stack.pop()
            if trail:
                trail.pop()
                low = min(low, len(trail))
            continue
        frame[3] += 1
        x = node.children[i]
        if isinstance(x, str):
            held.append(x)
            continue
        if x.tag in _NOT_TEXT or "#hidden" in x.name or (x.name and x.tag not in ("body", "html") and _NOT_NAME.search(x.name)):
            if x.tag in _BLOCK or x.tag in _NOT_TEXT:
                close(place, inside)
            continue
        if x.tag == "footer" or x.tag == "header" and not inside:
            close(place, inside)
            continue
        if x.tag in _BLOCK:
            close(place, inside)
        if x.tag in _VOID:
            continue
        within = inside or x.tag in ("article", "main") or "main" in x.name.split() or "article" in x.name.split()
        trail.append(x.label)
        stack.append([x, (place * _TIMES + x.label + 1) % _PRIME, within, 0])
    return out


_TIMES, _PRIME = 0x1B873593CC9E2D51, 2**61 - 1
#: The label of the leaves of a block tree.
_LEAF = zlib.crc32(b"leaf")


def said(text: str) -> int:
    """A number for what a block says."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def tree(page: Iterable[tuple[int, Sequence[int], int, int]]) -> tuple:
    """The block tree of (keep, labels, place, said): (label, children) for elements, (_LEAF, (place, said)) as a leaf for each block."""
    root: tuple = (0, [])
    trail = [root]
    for keep, labels, place, text in page:
        del trail[keep + 1 :]
        for label in labels:
            node = (int(label), [])
            trail[-1][1].append(node)
            trail.append(node)
        trail[-1][1].append((_LEAF, (int(place), int(text))))
    return root


class Matching:
    """Simple tree matching of two block trees: of the pairs of nodes with equal labels that keep order and ancestry, those with the most leaves
    that are equal and, of these, the most pairs. Scores are EQUAL for each equal leaf and 1 for each pair.

    Subtrees become kinds: leaves that only one tree has are all one kind, so like siblings are scored once. Kinds that share no leaf score by shape.
    """

    def __init__(self, a: tuple, b: tuple):
        self.common = _leaves(a) & _leaves(b)
        self.number: dict[tuple, int] = {}
        self.label: list[int] = []
        self.kids: list[tuple[int, ...] | None] = []
        self.bare: list[int] = []  # the kind of the same shape without leaves that both trees have
        self.whole: list[int] = []  # score with itself if both trees have all its leaves, else 0
        self.height: list[int] = []
        self.held: dict[tuple[int, int], int] = {}
        # Of each side: the common leaves in order, where each stands, and the range of them below a kind.
        self.order: tuple[list, list] = ([], [])
        self.places: tuple[dict, dict] = ({}, {})
        self.span: tuple[dict, dict] = ({}, {})
        self.a, self.b = self.placed(a, 0), self.placed(b, 1)

    def kind(self, label: int, text: tuple | None, kids: tuple[int, ...] | None) -> int:
        if (k := self.number.get((label, text, kids))) is None:
            bare = None
            if text is not None:
                bare = self.kind(label, None, None)
            elif kids and any(self.bare[x] != x for x in kids):
                bare = self.kind(label, None, tuple(self.bare[x] for x in kids))
            k = self.number[label, text, kids] = len(self.label)
            self.label.append(label)
            self.kids.append(kids)
            self.bare.append(k if bare is None else bare)
            parts = [self.whole[x] for x in kids or ()]
            self.whole.append(EQUAL + 1 if text else 1 + sum(parts) if kids and all(parts) else 0)
            self.height.append(1 + max((self.height[x] for x in kids or ()), default=0))
        return k

    def placed(self, t: tuple, side: int) -> tuple:
        """(kind, what a leaf says, placed children) for each node, children first."""
        order, places, span = self.order[side], self.places[side], self.span[side]
        stack: list[tuple[tuple, list, int]] = [(t, [], 0)]
        while True:
            node, done, begin = stack[-1]
            if isinstance(node[1], tuple):
                text = node[1] if node[1] in self.common else None
                if text:
                    places.setdefault(text, []).append(len(order))
                    order.append(text)
                out = (self.kind(node[0], text, None), node[1], None)
            elif len(done) < len(node[1]):
                stack.append((node[1][len(done)], [], len(order)))
                continue
            else:
                out = (self.kind(node[0], None, tuple(x[0] for x in done)), None, done)
            span.setdefault(out[0], (begin, len(order)))
            stack.pop()
            if not stack:
                return out
            stack[-1][1].append(out)

    def keys(self, k: int, side: int) -> list[tuple]:
        """The common leaves below a kind."""
        begin, end = self.span[side].get(k, (0, 0))
        return self.order[side][begin:end]

    def apart(self, x: int, y: int) -> bool:
        """Whether no leaf is below both."""
        (a, b), (c, d) = self.span[0].get(x, (0, 0)), self.span[1].get(y, (0, 0))
        one, places = (self.order[0][a:b], self.places[1]) if b - a <= d - c else (self.order[1][c:d], self.places[0])
        lo, hi = (c, d) if b - a <= d - c else (a, b)
        for key in one:
            at = places[key]
            i = bisect_left(at, lo)
            if i < len(at) and at[i] < hi:
                return False
        return True

    def known(self, x: int, y: int) -> int | tuple[int, int]:
        """The score of two kinds, or the pair to work out."""
        if self.label[x] != self.label[y]:
            return 0
        if x == y and self.whole[x]:
            return self.whole[x]
        if self.kids[x] is None or self.kids[y] is None:
            return int(self.kids[x] is self.kids[y])
        if (s := self.held.get((x, y))) is not None:
            return s
        if self.apart(x, y):
            bare = self.bare[x], self.bare[y]
            if bare != (x, y):
                s = self.held.get(bare)
                return bare if s is None else s
        return x, y

    def score(self, x: int, y: int) -> int:
        s = self.known(x, y)
        if isinstance(s, int):
            return s
        x, y = s
        if min(self.height[x], self.height[y]) > DEEP:  # deeper than Python recurses: from below, with a stack
            stack = [s]
            while stack:
                p, q = stack[-1]
                if (p, q) in self.held:
                    stack.pop()
                elif todo := [k for k in self.asked(self.kids[p], self.kids[q]) if min(self.height[k[0]], self.height[k[1]]) > DEEP]:
                    stack.extend(todo)
                else:
                    self.held[p, q] = 1 + int(self.rows(self.kids[p], self.kids[q])[-1])
                    stack.pop()
        else:
            self.held[s] = 1 + int(self.rows(self.kids[x], self.kids[y])[-1])
        return self.held[s]

    def asked(self, x: Sequence[int], y: Sequence[int]) -> list[tuple[int, int]]:
        """The pairs that `rows` needs of high kinds and does not know."""
        high = lambda kinds: [k for k in set(kinds) if self.height[k] > DEEP]
        return [s for p in high(x) for q in high(y) for s in (self.known(p, q), self.known(self.bare[p], self.bare[q])) if not isinstance(s, int)]

    def rows(self, x: Sequence[int], y: Sequence[int]) -> Sequence[int]:
        """The best score of all of x with each beginning of y; a row of the table at a time."""
        if len(x) * len(y) <= SMALL:
            row = [0] * (len(y) + 1)
            for p in x:
                before, row = row, [0]
                for j, q in enumerate(y):
                    row.append(max(before[j + 1], row[j], before[j] + self.score(p, q)))
            return row
        kinds, place = np.unique(np.array(y), return_inverse=True)
        shapes, shape = np.unique([self.bare[q] for q in kinds], return_inverse=True)
        kinds, shapes = kinds.tolist(), shapes.tolist()
        having: dict[tuple, list[int]] = {}
        for j, q in enumerate(kinds):
            for key in self.keys(q, 1):
                having.setdefault(key, []).append(j)
        by_shape: dict[int, np.ndarray] = {}
        best = np.zeros(len(y) + 1, dtype=np.int64)
        for p in x:
            if (v := by_shape.get(self.bare[p])) is None:
                v = by_shape[self.bare[p]] = np.array([self.score(self.bare[p], q) for q in shapes], dtype=np.int64)
            v = v[shape]
            for j in {j for key in self.keys(p, 0) for j in having.get(key, ())}:
                v[j] = self.score(p, kinds[j])
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + v[place]))
        return best

    def aligned(self, x: list, y: list) -> Iterator[tuple[tuple, tuple]]:
        """The pairs of the best alignment of two lists of placed nodes, in memory linear in their lengths."""
        i, j, n, m = 0, 0, len(x), len(y)
        while i < n and j < m and x[i][0] == y[j][0] and self.whole[x[i][0]]:  # what begins or ends alike belongs together
            yield x[i], y[j]
            i, j = i + 1, j + 1
        while i < n and j < m and x[n - 1][0] == y[m - 1][0] and self.whole[x[n - 1][0]]:
            n, m = n - 1, m - 1
            yield x[n], y[m]
        x, y = x[i:n], y[j:m]
        if not x or not y:
            return
        p, q = [v[0] for v in x], [v[0] for v in y]
        if len(x) == 1:
            scores = [self.score(p[0], k) for k in q]
            if best := max(scores):
                yield x[0], y[scores.index(best)]
        elif len(x) * len(y) <= SMALL:
            table = [[0] * (len(y) + 1)]
            for k in p:
                before, row = table[-1], [0]
                for j, l in enumerate(q):
                    row.append(max(before[j + 1], row[j], before[j] + self.score(k, l)))
                table.append(row)
            i, j = len(x), len(y)
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    yield x[i], y[j]
        else:
            half = len(x) // 2
            # A list from its end scores as from its beginning, with the children of each element in their own order.
            both = np.asarray(self.rows(p[:half], q)) + np.asarray(self.rows(p[half:][::-1], q[::-1]))[::-1]
            cut = int(both.argmax())
            yield from self.aligned(x[:half], y[:cut])
            yield from self.aligned(x[half:], y[cut:])

    def leaves(self) -> Iterator[tuple[tuple, tuple]]:
        """The pairs of leaves."""
        stack = [(self.a, self.b)]
        while stack:
            p, q = stack.pop()
            if p[2] is None:
                yield p[1], q[1]
            else:
                stack.extend(self.aligned(p[2], q[2]))


def _leaves(t: tuple) -> set[tuple]:
    found, stack = set(), [t]
    while stack:
        node = stack.pop()
        if isinstance(node[1], tuple):
            found.add(node[1])
        else:
            stack.extend(node[1])
    return found


def matching(a: tuple, b: tuple, pairs: list | None = None) -> int:
    """The number of pairs that Matching finds. pairs gets the leaves so matched."""
    m = Matching(a, b)
    score = m.score(m.a[0], m.b[0])
    if score and pairs is not None:
        pairs.extend(m.leaves())
    return score % EQUAL


def _parsed(batches):
    """Host, page and block tree of pages, as lists of numbers."""
    for pdf in batches:
        rows = [blocks(x) for x in pdf["html"]]
        tree_of = {"keeps": lambda b: b.keep, "labels": lambda b: b.labels, "places": lambda b: b.place, "texts": lambda b: said(b.text)}
        yield pd.DataFrame({"host": pdf["host"]} | {k: [[f(b) for b in page] for page in rows] for k, f in tree_of.items()})


def _constants(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Aligns a group's pages with one of them; counts on how many each block of it is constant."""
    trees = []
    for texts, keeps, labels, places in sorted(zip(map(tuple, pdf["texts"]), pdf["keeps"], pdf["labels"], pdf["places"]), key=lambda x: x[0]):
        trees.append((len(texts), tree(zip(keeps, labels, places, texts))))
    seen: Counter = Counter()
    if trees:
        model = max(trees, key=lambda t: t[0])[1]  # the page with most blocks has a place for what the others say
        for _, t in trees:
            pairs: list = []
            matching(model, t, pairs)
            seen.update({p for p, q in pairs if p == q})
    rows = [(key[0], place, text, n, 0) for (place, text), n in seen.items()] + [(key[0], 0, 0, 0, len(trees))]
    return pd.DataFrame(rows, columns=["host", "place", "said", "n", "pages"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, constants): the (place, text) hashes of each host's template blocks; fewer than a few pages' blocks."""
    rows = pages.selectExpr(f"coalesce({_host('url')}, '') as host", "html")
    trees = rows.mapInPandas(_parsed, "host string, keeps array<int>, labels array<array<long>>, places array<long>, texts array<long>")
    # Copies count once on the whole host, so they become one page before pages are dealt.
    trees = stored(trees.groupBy("host", "texts").agg(F.min(F.struct("keeps", "labels", "places")).alias("t")).select("host", "texts", "t.*"), "page-trees")
    sizes = stored(trees.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "host-pages").selectExpr("host as of_host", "n as of_n")
    dealt = trees.join(sizes, F.expr("host = of_host")).selectExpr("host", f"pmod(xxhash64(texts), greatest(1, of_n div {GROUP})) as g", "keeps", "labels", "places", "texts")
    counted = dealt.groupBy("host", "g").applyInPandas(_constants, "host string, place long, said long, n long, pages long")
    summed = counted.groupBy("host", "place", "said").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"))
    summed = stored(summed, "host-constants")
    of = summed.where("pages > 0").selectExpr("host as of_host", "pages as of_pages")
    const = summed.where("pages = 0").join(of, F.expr("host = of_host")).where(f"of_pages >= {LEAST} and n >= {SHARE} * of_pages")
    return const.groupBy("host").agg(F.collect_list(F.struct("place", "said")).alias("constants"))


def content(page: list[Block], constants: set[tuple[int, int]]) -> str:
    """The text of a page's article: its blocks that are no template, of the article if one is marked."""
    page = [b for b in page if b.inside] or page
    return " ".join(b.text for b in page if not constants or (b.place, said(b.text)) not in constants)


def _extracted(batches):
    for pdf in batches:
        texts = [content(blocks(h), {(c["place"], c["said"]) for c in cs} if cs is not None else set()) for h, cs in zip(pdf["html"], pdf["constants"])]
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""
    found = stored(templates(pages), "templates").selectExpr("host as of_host", "constants")
    rows = pages.selectExpr("page_id", "url", "html", f"coalesce({_host('url')}, '') as host").join(found, F.expr("host = of_host"), "left").select("page_id", "url", "html", "constants")
    return rows.mapInPandas(_extracted, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
