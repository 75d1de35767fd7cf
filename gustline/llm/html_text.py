"""Main text of web pages by wrapper induction.

A page is reduced to its skeleton, the tree of its block elements in which
paragraphs and the like that are siblings are one node, with a hash of each
node's own text.
Skeletons of a host are aligned by simple tree matching: nodes whose text is the
same on all its pages are template, the others are slots.  A page's text is what
its slots hold, without what its markup says is a menu, a form, an advert or
another thing beside the article.

Pages of a host are counted by skeleton before they are shuffled, and skeletons
are folded into templates in rounds of bounded fan-in; no host's pages meet in
one task.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustline.llm.staging import Staging

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]{0,63}+)"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.S,
)
#: The end of a tag, or an attribute with its value; a quoted one up to its opening quote.
_ATTRIBUTE = re.compile(
    r"""[\s/]*+(?:(?P<end>>)|(?P<name>[^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:(?P<quote>["'])|(?P<value>[^\s>]*+)))?+)"""
)
_NAME = re.compile(r"[a-z0-9]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea noscript iframe template svg canvas object".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: Plain text elements: inside an article they belong to it even where all pages of the host share them.
PLAIN = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody thead tr td th figure figcaption".split())
#: Elements that are never text of the page, and those that usually stand beside the article.
UNSEEN = {"head"} | RAW
BESIDE = set("nav footer aside form button select dialog menu".split())
#: Words of classes and ids that usually name such things, if what else the name says is a place or a size.
BESIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup share sharing social related recommended recommendations teaser comment "
    "comments respond replies disqus widget toolbar pagination pager login search form".split()
)
QUALIFIERS = set(
    "top bottom left right main primary secondary global site page post entry inner outer upper lower side sticky fixed "
    "mobile desktop small large mini header body box bar block list links link item items wrap wrapper container area "
    "section row col column content text icon icons button buttons inline".split()
)
SITE_HEADER = set("header site global top main page mobile sticky fixed".split())
BESIDE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}}
#: Share of a host's unlike pages that a node must be on to be template.
TEMPLATE_SHARE = 0.25
#: Skeletons that one task folds into a template.
FAN = 32
_LISTS = set("ul ol dl table article section div body main".split())


@dataclass
class Page:
    """A parsed page: skeleton (label, parent and children of each node) and blocks of text in order."""

    labels: list[str] = field(default_factory=lambda: ["#"])
    children: list[dict[tuple[str, int], int]] = field(default_factory=lambda: [{}])
    texts: list[list[str]] = field(default_factory=lambda: [[]])
    blocks: list[tuple[int, str, tuple[int, ...], int, bool]] = field(default_factory=list)
    """Node, text, elements around it that may be beside the article, number of its article (0: none, -1: main), mostly links."""

    def hashes(self) -> list[int]:
        return [xxhash.xxh3_64_intdigest("\n".join(t)) - (1 << 63) for t in self.texts]

    def shape(self) -> str:
        """The skeleton as text: nested lists of label and children."""
        return json.dumps([self.labels, [list(c.values()) for c in self.children]], ensure_ascii=False)


def _attributes(source: str, at: int, last: dict[str, int]) -> tuple[int, list[tuple[str, str]]]:
    """Where the tag ends whose attributes begin at a place, and their names and values; -1 if it does not end.

    Only a quote directly after "=" opens a quoted value, which may have any length; where its partner is missing, the
    value ends at the next ">".  last: the last places of ">" and of the quotes.
    """
    found: list[tuple[str, str]] = []
    if at > last[">"]:
        return -1, found
    begin = at
    while token := _ATTRIBUTE.match(source, at):
        at = token.end()
        if token["end"]:
            return at, found
        name, quote = token["name"].lower(), token["quote"]
        if not quote:
            found.append((name, token["value"] or ""))
            continue
        paired = at <= last[quote]
        end = source.find(quote if paired else ">", at)
        if end < 0:
            break
        found.append((name, source[at:end]))
        at = end + paired
    return source.index(">", begin) + 1, found


#: How an element stands to the article: in it as far as it tells, beside it by a hint, beside it by its kind, never seen.
INSIDE, HINTED, BESIDE_KIND, NEVER = 0, 1, 2, 3


def _named_beside(name: str, within: bool) -> bool:
    """Whether a whole class or id names a thing beside the article: every part of it does, or says where or how large."""
    parts = _NAME.findall(name)
    if "header" in parts and not within and all(p in SITE_HEADER for p in parts):
        return True
    return not BESIDE_NAMES.isdisjoint(parts) and all(p in BESIDE_NAMES or p in QUALIFIERS for p in parts)


def _beside(tag: str, attributes: list[tuple[str, str]], within: bool) -> tuple[int, str]:
    """How an element stands to the article, and its label.

    Parts of names with digits in them belong to one page and are no part of the label.
    """
    kind = NEVER if tag in UNSEEN else BESIDE_KIND if tag in BESIDE or tag == "header" and not within else INSIDE
    if tag == "form":
        kind = HINTED
    if not attributes:
        return kind, tag
    names: list[str] = []
    for key, value in attributes:
        value = value.lower()
        if key in ("class", "id"):
            own = value.split()
            names += [p for n in own for p in _NAME.findall(n) if p.isalpha()]
            if tag not in ("html", "body", "article", "main") or not {"comment", "teaser"}.isdisjoint(own):
                kind = max(kind, HINTED * any(_named_beside(n, within) for n in own))
        elif key == "role":
            kind = max(kind, HINTED * (value in BESIDE_ROLES))
        hides = key == "hidden" or key == "aria-hidden" and value == "true"
        if hides or key == "style" and "display:none" in value.replace(" ", ""):
            kind = NEVER
    return kind, ".".join([tag, *sorted(set(names))])


def parse(source: str) -> Page:
    """The page of whatever markup there is; elements that are left open end where others make them end."""
    page = Page()
    # open elements: tag, node (inline ones have their block's), those that may be beside (below 0: that are), article, whether it
    # is a link, children by label
    stack: list[tuple[str, int, tuple[int, ...], int, bool, dict]] = [("#", 0, (), 0, False, {})]
    words: list[str] = []
    linked = articles = marked = 0

    def within(around: tuple[int, ...], kind: int) -> tuple[int, ...]:
        nonlocal marked
        marked += 1
        return around if kind == INSIDE else (*around, marked if kind == HINTED else -kind)

    def flush() -> None:
        nonlocal linked
        if words:
            joined = " ".join(html.unescape("".join(words)).split())
            if joined:
                _, node, beside, article, *_ = stack[-1]
                page.blocks.append((node, joined, beside, article, linked * 10 > len(joined) * 7))
                page.texts[node].append(joined)
            words.clear()
        linked = 0

    def leave(upto: int) -> None:
        for tag, *_ in reversed(stack[upto:]):
            if tag not in INLINE:
                flush()
            stack.pop()

    at, size = 0, len(source)
    last = {mark: source.rfind(mark) for mark in ">\"'"}
    while at < size:
        token = _TOKEN.match(source, at)
        if token is None:  # a "<" that begins nothing
            words.append("<")
            at += 1
            continue
        at = token.end()
        text = token["text"]
        if text is not None:
            words.append(text)
            if stack[-1][4]:
                linked += len(text)
            continue
        if token["tag"] is None:
            continue
        tag = token["tag"].lower()
        end, attributes = _attributes(source, at, last)
        if end < 0:  # cut off
            words.append(token[0])
            continue
        at = end
        if token["close"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    leave(k)
                    break
                if stack[k][0] in ("td", "th", "table") and tag not in ("td", "th", "tr", "table", "tbody", "body", "html"):
                    break
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                words.append(" ")
            continue
        if tag in INLINE:
            _, node, beside, article, link, inner = stack[-1]
            kind = _beside(tag, attributes, article != 0)[0] if attributes else INSIDE
            hidden = within(beside, kind)
            if kind != INSIDE:
                flush()
                stack.append(("x-hidden", node, hidden, article, link, inner))
            stack.append((tag, node, hidden, article, link or tag == "a", inner))
            continue
        flush()
        for k in range(len(stack) - 1, 0, -1):  # elements that this one ends
            open_tag = stack[k][0]
            if open_tag == "p" or open_tag in _CLOSES.get(tag, ()):
                leave(k)
                break
            if open_tag in _LISTS:
                break
        while stack[-1][0] in INLINE:  # an inline element is not parent of a block
            stack.pop()
        _, parent, beside, article, _, inner = stack[-1]
        own, label = _beside(tag, attributes, article != 0)
        nth = inner[label] = inner.get(label, 0) + (tag not in PLAIN)
        node = page.children[parent].get((label, nth))
        if node is None:
            node = page.children[parent][label, nth] = len(page.labels)
            page.labels.append(label)
            page.children.append({})
            page.texts.append([])
        beside = within(beside, own)
        if tag == "article" and article <= 0:
            articles += 1
            article = articles
        elif tag == "main" and article == 0:
            article = -1
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
            at = end.start() if end else size
        stack.append((tag, node, beside, article, False, {}))
    leave(1)
    flush()
    return page


def _beside_blocks(page: Page) -> list[bool]:
    """Whether each block stands beside the article.

    What an element's name hints at is believed, unless next to nothing of the page would be left: a page may as a
    whole stand in a form, or in an element whose class tells of its sidebar.  Then the element that holds most of it
    is taken to be part of the page, and so on.
    """
    believed = [(len(text), around) for _, text, around, *_ in page.blocks if not any(e < 0 for e in around)]
    total, doubted = sum(size for size, _ in believed), set()
    while True:
        left = sum(size for size, around in believed if doubted.issuperset(around))
        if left * 50 >= total:
            break
        sizes: dict[int, int] = {}
        for size, around in believed:
            for element in around:
                if element not in doubted:
                    sizes[element] = sizes.get(element, 0) + size
        doubted.add(max(sizes, key=lambda e: (sizes[e], -e)))
    return [any(e < 0 or e not in doubted for e in around) for _, _, around, *_ in page.blocks]


def candidates(page: Page) -> list[tuple[int, bool, str]]:
    """Node, whether it stays in any case, and text of the blocks that may be the article's.

    The article is what its ``article`` elements hold, else ``main``, else all of the page.  Only in the last case does
    text that is mostly links fall out.
    """
    blocks = [b for b, beside in zip(page.blocks, _beside_blocks(page)) if not beside]
    kinds = {b[3] for b in blocks}
    if any(k > 0 for k in kinds):
        found = [b for b in blocks if b[3] > 0]
    elif -1 in kinds:
        found = [b for b in blocks if b[3] == -1]
    else:
        return [(n, False, t) for n, t, _, _, links in blocks if not links]
    return [(n, page.labels[n].partition(".")[0] in PLAIN | {"article", "main"}, t) for n, t, *_ in found]


@dataclass
class Node:
    """A node of a template: least and greatest hash of its text, and how many pages have it."""

    label: str
    low: int
    high: int
    pages: int
    children: list[Node] = field(default_factory=list)

    def nodes(self) -> list[Node]:
        """The tree's nodes, each before its children; pages may be nested deeper than Python calls."""
        found, todo = [], [self]
        while todo:
            found.append(todo.pop())
            todo += reversed(found[-1].children)
        return found

    def pack(self) -> list:
        """A flat list with the number of each node's children."""
        return [[n.label, n.low, n.high, n.pages, len(n.children)] for n in self.nodes()]

    @staticmethod
    def unpack(given: list) -> Node:
        ready: list[Node] = []
        for *own, inner in reversed(given):  # the first child is on top
            ready.append(Node(*own, [ready.pop() for _ in range(inner)]))
        return ready[0]

    def varies(self) -> bool:
        return any(n.low != n.high for n in self.nodes())


def from_shape(shape: str, low: list[int], high: list[int], pages: int) -> tuple[Node, list[Node]]:
    """The template of one skeleton, and its nodes in the skeleton's order."""
    labels, children = json.loads(shape)
    nodes = [Node(label, low[i], high[i], pages) for i, label in enumerate(labels)]
    for node, inner in zip(nodes, children):
        node.children = [nodes[c] for c in inner]
    return nodes[0], nodes


def _shapes(a: Node, b: Node) -> tuple[dict[int, int], list[list[int]], list[int]]:
    """Number of the shape (labels alone) of every subtree of two trees, and the children and size of each shape."""
    known: dict[tuple, int] = {}
    shape, inner, sizes = {}, [], []
    for tree in (a, b):
        for node in reversed(tree.nodes()):  # children before parents
            own = [shape[id(c)] for c in node.children]
            number = shape[id(node)] = known.setdefault((node.label, *own), len(known))
            if number == len(inner):
                inner.append(own)
                sizes.append(1 + sum(sizes[c] for c in own))
    return shape, inner, sizes


def _row(above: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """The next row of best weights: what pairing one more sibling with each of the others gains."""
    row = above.copy()
    np.maximum(row[1:], above[:-1] + gains, out=row[1:])
    return np.maximum.accumulate(row)


def _align(xs: list[int], ys: list[int], weight: Callable[[int, int], int]) -> tuple[int, list[tuple[int, int]]]:
    """The weightiest alignment of two lists of shapes in order: its weight, and the places of its pairs.

    Equal ends are paired at once, as nothing can weigh more.  Of the rest's table of best weights only every so many rows are
    kept, and those between worked out again on the way back, so that memory grows with the root of its size.
    """
    m, n, pairs, total = len(xs), len(ys), [], 0
    while m and n and xs[m - 1] == ys[n - 1]:
        m, n = m - 1, n - 1
        total += weight(xs[m], ys[n])
        pairs.append((m, n))
    if not m or not n:
        return total, pairs
    kinds, places = np.unique(np.array(ys[:n]), return_inverse=True)
    gains = {x: np.array([weight(x, int(y)) for y in kinds], np.int64)[places] for x in set(xs[:m])}
    step = max(1, math.isqrt(m))
    kept, row = [], np.zeros(n + 1, np.int64)
    for i in range(m):
        if i % step == 0:
            kept.append(row)
        row = _row(row, gains[xs[i]])
    total += int(row[n])
    i, j, low = m, n, -1
    while i and j:
        if low != (i - 1) // step:
            low = (i - 1) // step
            rows = [kept[low]]
            for k in range(low * step, i):
                rows.append(_row(rows[-1], gains[xs[k]]))
        here, above, gain = rows[i - low * step], rows[i - 1 - low * step], int(gains[xs[i - 1]][j - 1])
        if gain and here[j] == above[j - 1] + gain:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif here[j] == above[j]:
            i -= 1
        else:
            j -= 1
    return total, pairs


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the most nodes that two trees of equal root label share in order, and which they are.

    What two subtrees share depends on their shapes alone, so each pair of unlike shapes is weighed once.
    """
    if a.label != b.label:
        return 0, []
    shape, inner, sizes = _shapes(a, b)
    labels = {shape[id(n)]: n.label for tree in (a, b) for n in tree.nodes()}
    aligned: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def weight(x: int, y: int) -> int:
        if x == y:
            return sizes[x]
        return 1 + aligned[x, y][0] if labels[x] == labels[y] else 0

    def unlike(x: int, y: int) -> list[tuple[int, int]]:
        """Pairs of shapes that the children of two are to be weighed by."""
        xs, ys = inner[x], inner[y]
        same = next((k for k in range(min(len(xs), len(ys))) if xs[-1 - k] != ys[-1 - k]), min(len(xs), len(ys)))
        by_label: dict[str, list[int]] = {}
        for d in set(ys[: len(ys) - same]):
            by_label.setdefault(labels[d], []).append(d)
        return [(c, d) for c in set(xs[: len(xs) - same]) for d in by_label.get(labels[c], ()) if c != d and (c, d) not in aligned]

    todo = [(shape[id(a)], shape[id(b)])] if shape[id(a)] != shape[id(b)] else []
    while todo:  # pages may be nested deeper than Python calls
        x, y = todo[-1]
        waiting = unlike(x, y) if (x, y) not in aligned else []
        if waiting:
            todo += waiting
            continue
        todo.pop()
        if (x, y) not in aligned:
            aligned[x, y] = _align(inner[x], inner[y], weight)
    pairs, left = [], [(a, b)]
    while left:
        x, y = left.pop()
        pairs.append((x, y))
        s, t = shape[id(x)], shape[id(y)]
        if s == t:
            left += zip(reversed(x.children), reversed(y.children))
        else:
            left += [(x.children[i], y.children[j]) for i, j in aligned[s, t][1]]
    return weight(shape[id(a)], shape[id(b)]), pairs


def merge(a: Node, b: Node) -> Node:
    """The template of two: matched nodes become one, the others stay with the pages that have them."""
    pairs = match(a, b)[1]
    partner = {id(y): x for x, y in pairs}
    for x, y in pairs:
        x.low, x.high, x.pages = min(x.low, y.low), max(x.high, y.high), x.pages + y.pages
    for x, y in pairs:
        # children without a partner stand before the next one that has one
        before: dict[int, list[Node]] = {}
        waiting: list[Node] = []
        for child in y.children:
            twin = partner.get(id(child))
            if twin is None:
                waiting.append(child)
            elif waiting:
                before[id(twin)], waiting = waiting, []
        x.children = [c for own in x.children for c in (*before.get(id(own), ()), own)] + waiting
    return a


def template_nodes(template: Node, root: Node, nodes: list[Node]) -> list[int]:
    """Places of a skeleton's nodes that all pages of the host share, where some of the host's pages differ at all."""
    if not template.varies():
        return []
    least = max(2, TEMPLATE_SHARE * template.pages)
    shared = {id(y) for x, y in match(template, root)[1] if x.low == x.high and x.pages >= least}
    return [i for i, node in enumerate(nodes) if id(node) in shared]


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, shape, low, high and contents (hashes of unlike pages), one row for each skeleton of a host in the batch."""
    for batch in batches:
        found: dict[tuple[str, str], list] = {}
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = parse(source or "")
            hashes = page.hashes()
            cell = found.setdefault((host, page.shape()), [set(), hashes, hashes])
            cell[0].add(xxhash.xxh3_64_intdigest(repr(hashes)) - (1 << 63))
            cell[1], cell[2] = list(map(min, cell[1], hashes)), list(map(max, cell[2], hashes))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in found], pa.string()),
                pa.array([k[1] for k in found], pa.string()),
                *[pa.array([list(v[i]) for v in found.values()], pa.list_(pa.int64())) for i in range(3)],
            ],
            ["host", "shape", "contents", "low", "high"],
        )


def _fold(group: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for packed in sorted(group["template"]):
        node = Node.unpack(json.loads(packed))
        whole = node if whole is None else merge(whole, node)
    return pd.DataFrame({"host": [group["host"].iloc[0]], "template": [json.dumps(whole.pack(), ensure_ascii=False)]})


def _first_templates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        packed = [
            json.dumps(from_shape(s, [int(x) for x in lo], [int(x) for x in hi], int(n))[0].pack(), ensure_ascii=False)
            for s, lo, hi, n in zip(rows["shape"], rows["low"], rows["high"], rows["pages"])
        ]
        yield pd.DataFrame({"host": rows["host"], "template": packed})


def fold_templates(first: DataFrame, staging: Staging, fan: int = FAN) -> DataFrame:
    """One template for each host (host, template), folded in rounds of at most ``fan`` templates a task."""
    turn = 0
    fan = max(2, fan)
    while True:
        nth = F.row_number().over(Window.partitionBy("host").orderBy(F.xxhash64("template"), "template")) - 1
        first = staging.table(first.withColumn("part", F.floor(nth / fan)), f"templates-{turn}")
        last = (first.agg(F.max("part")).first()[0] or 0) == 0
        first = first.groupBy("host", "part").applyInPandas(_fold, "host string, template string")
        if last:
            return first
        turn += 1


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        shared = []
        for shape, packed in zip(rows["shape"], rows["template"]):
            zero = [0] * len(json.loads(shape)[0])
            shared.append(template_nodes(Node.unpack(json.loads(packed)), *from_shape(shape, zero, zero, 1)))
        yield pd.DataFrame({"host": rows["host"], "shape": rows["shape"], "shared": shared})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("node", pa.int32()), ("stays", pa.bool_()), ("text", pa.string())]))
    for batch in batches:
        pages = [parse(source or "") for source in batch.column("html").to_pylist()]
        blocks = [[{"node": n, "stays": s, "text": t} for n, s, t in candidates(p)] for p in pages]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array([p.shape() for p in pages], pa.string()), pa.array(blocks, kind)],
            [*batch.schema.names[:-1], "shape", "blocks"],
        )


def extract(pages: DataFrame, fan: int = FAN, staging: Staging | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    Reads ``page_id``, ``url`` and ``html`` only.  Blocks come in page order, their white space single spaces, joined
    by two line ends; ``text`` is empty where there is none.  Null or empty html has no text.  Pages without a host in
    their url (or with a null one) are one host.  A node is template if its text is the same on all pages that have it,
    and these are TEMPLATE_SHARE of the host's unlike pages and two at least; so where a host has a single page, or pages
    all alike, nothing is template.  Neither is a paragraph, heading, list or table inside an article, so that lines
    that articles share stay.  If all that a page has is template, the page keeps it.  Repeated rows are extracted each.  An empty table gives no
    rows.
    """
    staging = staging or Staging(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", host.alias("host"), "html")
    counted = rows.select("host", "html").mapInArrow(
        _skeletons, "host string, shape string, contents array<long>, low array<long>, high array<long>"
    )
    counted = staging.table(counted, "skeletons")
    pairs = F.posexplode(F.arrays_zip("low", "high")).alias("at", "pair")
    nodes = (
        counted.select("host", "shape", pairs)
        .groupBy("host", "shape", "at")
        .agg(F.min("pair.low").alias("low"), F.max("pair.high").alias("high"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("at", "low", "high")))
    unlike = counted.select("host", "shape", F.explode("contents").alias("content")).distinct()
    unlike = unlike.groupBy("host", "shape").agg(F.count("*").alias("pages"))
    shapes = nodes.groupBy("host", "shape").agg(ordered.alias("nodes")).join(unlike, ["host", "shape"])
    shapes = staging.table(shapes.select("host", "shape", "pages", F.col("nodes.low"), F.col("nodes.high")), "shapes")
    templates = fold_templates(shapes.mapInPandas(_first_templates, "host string, template string"), staging, fan)
    decided = shapes.select("host", "shape").join(templates, "host")
    decided = staging.table(decided.mapInPandas(_decide, "host string, shape string, shared array<int>"), "decided")
    kinds = dict(pages.dtypes)
    blocks = rows.mapInArrow(
        _blocks,
        f"page_id {kinds['page_id']}, url string, host string, shape string, "
        "blocks array<struct<node:int,stays:boolean,text:string>>",
    )
    joined = blocks.join(decided, ["host", "shape"], "left")
    slots = F.filter("blocks", lambda b: b["stays"] | ~F.array_contains("shared", b["node"]))
    kept = joined.select("page_id", "url", F.when(F.size(slots) > 0, slots).otherwise(F.col("blocks")).alias("kept"))
    text = F.array_join(F.transform("kept", lambda b: b["text"]), "\n\n")
    return kept.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
