"""Main text of web pages by wrapper induction.

A page's markup becomes a tree of block elements; inline elements leave only their text.  Each page is
aligned with the first page of its host by simple tree matching.  Matched nodes whose text is the same
on most of the host's pages are its template; the slots that vary are content, and where one node of the
wrapper holds nearly all that varies, with all headings, only what lies below it.  So that this doesn't hang
on what the first page has, blocks are also counted by place (the labels above them) and text over all
different pages of the host: those on most pages that have the place are template too, and outside of article
and main elements so is a place whose other texts mostly come on several pages.  Pages that are the same but for a few
words, as copies of an article with a date line, count as one page there, so what they share is no template; nor does
prose beside the node that holds most of what varies go.  Names are hints only.  Menus,
footers, forms and the like, and blocks with telling classes, are no content, unless such a class is on an
element that holds an article or, on pages without one, other elements with most of the text.  On hosts with one page, the blocks of an
article or main element are the text if they have half of the page's at least, and a page that is all
template keeps them.  Pages of a host never meet in one task: the alignment is with one reference page, and
votes for a node are counted by aggregation.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgen.llm.tables import written
from relgen.llm.urls import host

SHARE, LEAST_PAGES = 0.5, 3
#: Share of the varying text that leads down to one child.
REGION = 0.8
#: A page is a copy where this many times what varies is no more than its whole text, in blocks of fewer words than ``FEW_WORDS``.
COPY, FEW_WORDS = 10, 8
#: Words of a block that make it prose where it ends as a sentence does.
PROSE = 18
_SENTENCE_ENDS = ".!?…。！？\"'”’»)"
MAX_BROADCAST_BYTES = 32 << 20
#: Lists of so many siblings are aligned in numpy, with the same result.
LONG = 64
#: Shapes, sizes and pairs that are kept for the next page with the same reference; beyond, they are found anew.
MOST_HELD = 2_000
#: No tag has a < outside quotes, and none is scanned twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title)\b[^<>]*+>.*?(?:</\1\s*>|\Z)|<[!?][^<>]*+>|</?[a-zA-Z](?:\"[^\"]*+\"|'[^']*+'|[^'\"<>])*+>", re.S | re.I)
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CLASSES = re.compile(r"[^\s]+")
_WORDS = re.compile(r"[a-z]+")
# fixed values: names of HTML elements
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NO_CONTENT = frozenset("head nav footer aside form button select menu dialog object applet".split())
_ARTICLE = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2".split())
_MARKED = frozenset("ad ads adbox adslot advert advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets footer masthead topbar share sharing social related recommended comment comments discussion replies disqus toolbar pagination pager contentinfo complementary search skip".split())
_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_P_BARRIER = frozenset("button td th table".split())
_CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())


class Node:
    __slots__ = ("bad", "children", "content", "label", "name", "number", "own", "parent", "shape", "telling")

    def __init__(self, name: str, label: str) -> None:
        self.name, self.label, self.content = name, label, True
        self.children: list[Node] = []
        self.own = ""
        self.number = self.shape = -1
        self.parent: Node | None = None
        self.bad = self.telling = False  # no content by name; by class


def _text(raw: str) -> str:
    return html.unescape(raw)


def parse(page: str) -> Node:
    """The page's blocks; a run of text between block tags is a leaf named #text."""
    root = Node("#root", "#root")
    stack, run, within = [root], [], Counter()

    def flush() -> None:
        if run:
            text = " ".join(_text("".join(run)).split())
            run.clear()
            if text:
                leaf = Node("#text", "#text")
                leaf.own = text
                stack[-1].children.append(leaf)

    def close(name: str, barrier: tuple | frozenset) -> None:
        """Closes the innermost element of this name and those in it, if no barrier lies between."""
        flush()
        if within[name]:
            at = len(stack) - 1
            while stack[at].name != name:
                if stack[at].name in barrier:
                    return
                at -= 1
            for x in stack[at:]:
                within[x.name] -= 1
            del stack[at:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        tag = m[0]
        if m[1] or tag[1] in "!?":
            continue
        name = _NAME.match(tag)[1].lower()
        if name in _INLINE:
            continue
        if name in ("br", "wbr"):
            run.append(" ")
            continue
        if tag[1] == "/":
            close(name, ())
            continue
        if name in _CLOSE_P and within["p"]:
            close("p", _P_BARRIER)
        if name in _CLOSES and within[name]:
            close(name, _CLOSES[name])
        flush()
        if name in _EMPTY:
            continue
        if "=" in tag:
            classes = [w for x in _MARKS.findall(tag) for w in _CLASSES.findall("".join(x).lower())]
            parts = [_WORDS.findall(w) for w in classes]
            marks = sorted({w for x in parts for w in x})
            node = Node(name, f"{name}.{'.'.join(marks)}")
            if name not in ("body", "html", *_ARTICLE):
                inside = any(within[x] for x in _ARTICLE)
                node.telling = any(_MARKED.intersection(x) for x in parts if len(x) < 3 or not inside)
        else:
            node = Node(name, f"{name}.")
        node.bad = name in _NO_CONTENT or (name == "header" and not any(within[x] for x in _ARTICLE))
        stack[-1].children.append(node)
        if not tag.endswith("/>"):
            stack.append(node)
            within[name] += 1
    rest = page[at:]
    cut = _OPEN.search(rest, rest.rfind(">") + 1)
    run.append(rest[: cut.start()] if cut else rest)
    flush()
    _mark(root)
    return root


def _mark(root: Node) -> None:
    """Numbers the nodes in page order and settles which are content by name and class."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(order)
        order.append(node)
        todo += reversed(node.children)
    size, article = [0] * len(order), [False] * len(order)
    for node in reversed(order):
        if not node.bad:
            size[node.number] = len(node.own) + sum(size[c.number] for c in node.children)
        article[node.number] = node.name in _ARTICLE or any(article[c.number] for c in node.children)
    for node in order:
        wrapper = article[node.number] or (not article[0] and not _flat(node) and 2 * size[node.number] > size[0])
        if node.bad or (node.telling and not wrapper):
            node.content = False
        for child in node.children:
            child.content, child.parent = node.content, node


def leaves(root: Node) -> list[tuple[Node, bool]]:
    """Text leaves in page order, and whether they lie in an article."""
    out, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.name in _ARTICLE
        if node.name == "#text":
            out.append((node, inside))
        todo += [(c, inside) for c in reversed(node.children)]
    return out


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"\n".join(parts), digest_size=8).digest()


def leaf_hashes(root: Node) -> dict[int, tuple[int, int]]:
    """Hashes of each content leaf, by its number: of the labels above it, and of these with its text.

    Places within an article or main element have odd hashes, others even ones.
    """
    out, todo = {}, [(root, b"", False)]
    while todo:
        node, above, inside = todo.pop()
        inside = inside or node.name in _ARTICLE
        if node.name == "#text":
            if node.content:
                whole = _digest(above, node.own.encode("utf-8", "replace"))
                place, block = (int.from_bytes(x, "little", signed=True) for x in (above, whole))
                out[node.number] = (place & -2 | inside, block)
        else:
            here = _digest(above, node.label.encode("utf-8", "replace"))
            todo += [(c, here, inside) for c in node.children]
    return out


class Matching:
    """Simple tree matching of two trees, from the leaves up without recursion.

    The size of the largest matching of two subtrees with equal labels that keeps order and levels.  It hangs
    on their shapes alone (label and shapes of the children), so each pair of shapes is matched once, and
    equal ones match child by child.  The matching is a largest one for lists of children of any length.
    What is found is kept for further trees, as long as the second one stays the same.
    """

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.shapes: dict[tuple, int] = {}
        #: Of each shape: its label and its children's shapes; its nodes; whether it is flat.
        self.kinds: list[tuple] = []
        self.sizes: list[int] = []
        self.flat: list[bool] = []
        #: Of each pair of shapes with equal labels and with children: the size of its best matching.
        self.memo: dict[int, dict[int, int]] = {}
        #: Of pairs that are matched themselves: the positions of the matched children.
        self.pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.second: Node | None = None
        self.held = 0

    def _shape(self, root: Node) -> int:
        order, todo = [], [root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo += node.children
        for node in reversed(order):
            kind = (node.label, *[c.shape for c in node.children])
            if (found := self.shapes.get(kind)) is None:
                found = self.shapes[kind] = len(self.kinds)
                self.kinds.append(kind)
                self.held += len(kind)
                self.sizes.append(1 + sum(self.sizes[c] for c in kind[1:]))
                self.flat.append(_flat(node))
            node.shape = found
        return root.shape

    def size(self, a: Node, b: Node) -> int:
        p, q = self._shape(a), b.shape if b is self.second else self._shape(b)
        self.second = b
        if self._open(p, q):
            todo = [(p, q, self._needed(p, q))]
            while todo:
                x, y, needed = todo[-1]
                if (pair := next(needed, None)) is not None:
                    todo.append((*pair, self._needed(*pair)))
                else:
                    todo.pop()
                    self.memo.setdefault(x, {})[y] = 1 + self._total(x, y)
                    self.held += 1
        return self._weight(p, q)

    def _open(self, p: int, q: int) -> bool:
        """Whether the size of this pair has to be found from its children's and hasn't been."""
        a, b = self.kinds[p], self.kinds[q]
        return p != q and a[0] == b[0] and len(a) > 1 and len(b) > 1 and q not in self.memo.get(p, ())

    def _middle(self, p: int, q: int) -> tuple[int, int, int]:
        """Equal flat children at either end match each other in some best matching: where the others begin and end."""
        xs, ys, flat = self.kinds[p], self.kinds[q], self.flat
        i, n, m = 1, len(xs), len(ys)
        while i < n and i < m and xs[i] == ys[i] and flat[xs[i]]:
            i += 1
        while n > i and m > i and xs[n - 1] == ys[m - 1] and flat[xs[n - 1]]:
            n, m = n - 1, m - 1
        return i, n, m

    def _needed(self, p: int, q: int) -> Iterator[tuple[int, int]]:
        i, n, m = self._middle(p, q)
        others: dict[str, list[int]] = {}
        for y in dict.fromkeys(self.kinds[q][i:m]):
            others.setdefault(self.kinds[y][0], []).append(y)
        for x in dict.fromkeys(self.kinds[p][i:n]):
            for y in others.get(self.kinds[x][0], ()):
                if self._open(x, y):
                    yield x, y

    def _weight(self, p: int, q: int) -> int:
        a, b = self.kinds[p], self.kinds[q]
        if a[0] != b[0]:
            return 0
        if p == q:
            return self.sizes[p]
        return self.memo[p][q] if len(a) > 1 and len(b) > 1 else 1

    def _rows(self, last: list[int] | np.ndarray, xs: tuple, ys: tuple) -> Iterator[list[int] | np.ndarray]:
        """The rows after ``last`` of the table of the heaviest matchings of the first of ``xs`` with the first of ``ys``."""
        if isinstance(last, list):
            for x in xs:
                row, here, label = [0], 0, self.kinds[x][0]
                for j, y in enumerate(ys):
                    if last[j + 1] > here:
                        here = last[j + 1]
                    if self.kinds[y][0] == label and (met := last[j] + self._weight(x, y)) > here:
                        here = met
                    row.append(here)
                last = row
                yield row
            return
        different, at = np.unique(np.array(ys, np.int64), return_inverse=True)
        different = different.tolist()

        @lru_cache(maxsize=16)
        def weights(x: int) -> np.ndarray:
            return np.array([self._weight(x, y) for y in different], np.int32)[at]

        for x in xs:
            row = np.zeros(len(ys) + 1, np.int32)
            np.add(last[:-1], weights(x), out=row[1:])
            np.maximum(row, last, out=row)
            np.maximum.accumulate(row, out=row)
            last = row
            yield row

    @staticmethod
    def _first(ys: tuple) -> list[int] | np.ndarray:
        """The table's first row; an array where numpy is faster, which changes no result."""
        return [0] * (len(ys) + 1) if len(ys) < LONG else np.zeros(len(ys) + 1, np.int32)

    def _total(self, p: int, q: int) -> int:
        """The size of the best matching of two shapes' children, whose own sizes are known."""
        i, n, m = self._middle(p, q)
        xs, ys = self.kinds[p], self.kinds[q]
        ends = sum(self.sizes[x] for part in (xs[1:i], xs[n:]) for x in part)
        last = self._first(ys[i:m])
        for row in self._rows(last, xs[i:n], ys[i:m]):
            last = row
        return ends + int(last[-1])

    def _best(self, xs: tuple, ys: tuple) -> list[tuple[int, int]]:
        """The positions that the heaviest matching pairs; of several, the one found from the end.

        One row in about the root of all is kept and those between are computed again, so that long
        lists need time by the product of their lengths, but no such memory.
        """
        step = max(isqrt(len(xs)), LONG)
        last = self._first(ys)
        kept = [last]
        for k, row in enumerate(self._rows(last, xs[: (len(xs) - 1) // step * step], ys), 1):
            if k % step == 0:
                kept.append(row)
        p, q, found = len(xs), len(ys), []
        for k in range(len(kept) - 1, -1, -1):
            low = k * step
            begin = kept.pop()[: q + 1]
            rows = [begin, *self._rows(begin, xs[low:p], ys[:q])]
            while p > low and q:
                here, above = rows[p - low], rows[p - low - 1]
                w = self._weight(xs[p - 1], ys[q - 1])
                if w and here[q] == above[q - 1] + w:
                    p, q = p - 1, q - 1
                    found.append((p, q))
                elif here[q] == above[q]:
                    p -= 1
                else:
                    q -= 1
            if not q:
                break
        return found[::-1]

    def children(self, x: Node, y: Node) -> list[tuple[Node, Node]]:
        """The matched children of two matched nodes of the trees whose size is known."""
        p, q = x.shape, y.shape
        if p == q:
            return [*zip(x.children, y.children, strict=True)]
        if (pairs := self.pairs.get((p, q))) is None:
            i, n, m = self._middle(p, q)
            xs, ys = self.kinds[p], self.kinds[q]
            pairs = [(k, k) for k in range(i - 1)]
            pairs += [(i - 1 + a, i - 1 + b) for a, b in self._best(xs[i:n], ys[i:m])]
            pairs += [(n - 1 + k, m - 1 + k) for k in range(len(xs) - n)]
            self.pairs[p, q] = pairs
            self.held += len(pairs)
        return [(x.children[a], y.children[b]) for a, b in pairs]


def _flat(x: Node) -> bool:
    return not x.children or (len(x.children) == 1 and x.children[0].name == "#text")


def align(page: Node, reference: Node, matching: Matching | None = None) -> dict[int, Node]:
    """The reference node of each matched node of the page, by the page node's number."""
    matching, found, todo = matching or Matching(), {}, [(page, reference)]
    matching.size(page, reference)
    while todo:
        x, y = todo.pop()
        found[x.number] = y
        todo += matching.children(x, y)
    return found


@lru_cache(maxsize=256)
def _reference(page: str) -> tuple[Node, Matching]:
    return parse(page), Matching()


def _twins(tree: Node, page: str, reference: str | None) -> dict[int, Node]:
    if not reference or reference == page:
        return {}
    other, matching = _reference(reference)
    found = align(tree, other, matching)
    if matching.held > MOST_HELD:
        matching.forget()
    return found


_LEAF = "key string, page bigint, leaf int, place bigint, block bigint, node int, same boolean, slot int, chars int, words int, heading boolean"


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each different page tells of its host's wrapper: a row for each content block.

    The hashes of its place and of place and text; the node of the reference page that it met, and whether
    with the same text; for others, the reference's node right above it.
    """
    types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
    names = [c.split()[0] for c in _LEAF.split(", ")]
    for batch in batches:
        rows, seen = [], set()
        for key, page, reference in zip(*(batch.column(n).to_pylist() for n in ("key", "html", "reference")), strict=True):
            if not reference or not page:
                continue
            own = int.from_bytes(_digest(page.encode("utf-8", "replace")), "little", signed=True)
            if (key, own) in seen:
                continue
            seen.add((key, own))
            tree = parse(page)
            places = leaf_hashes(tree)
            twins = _twins(tree, page, reference)
            for leaf, _ in leaves(tree):
                if not leaf.content:
                    continue
                twin, slot = twins.get(leaf.number), None
                same = twin is not None and twin.own == leaf.own
                if twins and not same:
                    above = leaf.parent
                    while above.number not in twins:
                        above = above.parent
                    slot = twins[above.number].number
                rows.append((key, own, leaf.number, *places[leaf.number], twin.number if twin else None, same, slot, len(leaf.own), leaf.own.count(" ") + 1, leaf.parent.name in _HEADINGS))
        columns = zip(*rows, strict=True) if rows else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def constants(leaves: DataFrame, share: float, least_pages: int) -> DataFrame:
    """(key, place, block, n, constant): on how many pages a block is, and whether on ``least_pages`` and ``share`` of those with its place."""
    blocks = leaves.select("key", "place", "block", "page").distinct().groupBy("key", "place", "block").agg(F.count("*").alias("n"))
    pages = leaves.select("key", "place", "page").distinct().groupBy("key", "place").agg(F.count("*").alias("all"))
    return blocks.join(pages, ["key", "place"]).select("key", "place", "block", "n", ((F.col("n") >= least_pages) & (F.col("n") >= F.col("all") * share)).alias("constant"))


def different_pages(leaves: DataFrame, share: float, least_pages: int) -> DataFrame:
    """``leaves`` with one page number for pages that tell nothing apart, and whether they are such (``copy``).

    Where nearly all of a page is constant and what varies is no more than a few words in a block, as in a
    date line, the page is a copy of others with the same constant blocks, and all of them count once: what
    they share may be an article as well as a template.
    """
    known = written(constants(leaves, share, least_pages).where("constant").select("key", "place", "block", F.lit(True).alias("known")), "constants")
    rest = leaves.join(known, ["key", "place", "block"], "left")
    other = F.when(F.col("known").isNull(), F.col("chars"))
    mark = F.when(F.col("known"), F.xxhash64("place", "block"))
    told = rest.groupBy("key", "page").agg(F.sum("chars").alias("all"), F.coalesce(F.sum(other), F.lit(0)).alias("rest"), F.max(F.when(F.col("known").isNull(), F.col("words"))).alias("words"), F.bit_xor(mark).alias("as"))
    copies = told.where((F.col("rest") * COPY <= F.col("all")) & (F.coalesce("words", F.lit(0)) < FEW_WORDS)).select("key", "page", "as")
    copies = written(copies, "copies")
    if not copies.limit(1).count():
        return leaves.withColumn("copy", F.lit(False))
    return leaves.join(copies, ["key", "page"], "left").withColumn("copy", F.col("as").isNotNull()).withColumn("page", F.coalesce("as", "page")).drop("as")


def template_nodes(leaves: DataFrame, share: float, least_pages: int) -> DataFrame:
    """(key, fixed, slots): nodes of the reference page with the same text on ``share`` of the pages that have them, and what varies below which."""
    met = leaves.where("node is not null").groupBy("key", "node", "page").agg(F.max(F.col("same").cast("int")).alias("same"))
    votes = met.groupBy("key", "node").agg(F.count("*").alias("n"), F.sum("same").alias("same"))
    same = (F.col("same") >= least_pages - 1) & (F.col("same") >= F.col("n") * share)
    fixed = votes.where(same).groupBy("key").agg(F.collect_list("node").alias("fixed"))
    below = leaves.where("slot is not null and not copy").groupBy("key", "slot").agg(F.sum("chars").alias("chars"), F.sum(F.col("heading").cast("bigint")).alias("heads"))
    slots = below.groupBy("key").agg(F.collect_list(F.struct(F.col("slot").alias("node"), "chars", "heads")).alias("slots"))
    return fixed.join(slots, "key", "full")


def region(reference: Node, slots: list[dict]) -> int:
    """The number of the node that holds the host's varying text: from the root down while one child has nearly all of it and all headings."""
    order, todo = [], [reference]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += reversed(node.children)
    chars, heads = [0] * len(order), [0] * len(order)
    for x in slots:
        chars[x["node"]], heads[x["node"]] = x["chars"], x["heads"]
    for node in reversed(order[1:]):
        chars[node.parent.number] += chars[node.number]
        heads[node.parent.number] += heads[node.number]
    at = reference
    while at.children:
        best = max(at.children, key=lambda c: chars[c.number])
        if _flat(best) or chars[best.number] < REGION * chars[at.number] or heads[best.number] < heads[at.number] or not chars[best.number]:
            break
        at = best
    return at.number


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            found = region(parse(row.column(1)[0].as_py()), row.column(3)[0].as_py() or [])
            yield pa.RecordBatch.from_arrays([*(row.column(i) for i in (0, 1, 2, 4, 5)), pa.array([found], pa.int32())], ["__key", "reference", "fixed", "shared", "places", "region"])


def shared_blocks(leaves: DataFrame, share: float, least_pages: int) -> DataFrame:
    """(key, shared, places): the constant blocks, and places outside of articles whose other texts are on two different pages or more on average."""
    blocks = written(constants(leaves, share, least_pages), "blocks")
    shared = blocks.where("constant").groupBy("key").agg(F.collect_set("block").alias("shared"))
    again = blocks.where(~F.col("constant") & (F.col("place") % 2 == 0)).groupBy("key", "place").agg(F.sum("n").alias("n"), F.count("*").alias("different"))
    places = again.where((F.col("different") <= F.col("n") * (1 - share)) & (F.col("n") >= 2 * least_pages)).groupBy("key").agg(F.collect_set("place").alias("places"))
    return shared.join(places, "key", "full")


def _below(tree: Node, main: int, twins: dict[int, Node], chosen: list[Node]) -> list[Node]:
    """The leaves below the node that is the reference's node ``main``; all where a page has no such node."""
    todo, top = [tree], None
    while todo and top is None:
        node = todo.pop()
        twin = twins.get(node.number) if twins else node
        if twin is not None and twin.number == main:
            top = node
        todo += reversed(node.children)
    if top is None:
        return chosen
    last = top
    while last.children:
        last = last.children[-1]
    within = lambda leaf: top.number <= leaf.number <= last.number
    # prose beside the region stays, with what stands beside it in a container of its own
    prose = [leaf for leaf in chosen if not within(leaf) and is_prose(leaf.own)]
    alone, holders, above = {leaf.number for leaf in prose}, set(), top
    over = set()
    while above is not None:
        over.add(above.number)
        above = above.parent
    for leaf in prose:
        holder = leaf.parent.parent or leaf.parent
        if holder.number not in over:
            holders.add(holder.number)
    return [leaf for leaf in chosen if within(leaf) or leaf.number in alone or (leaf.parent.parent or leaf.parent).number in holders]


def is_prose(text: str) -> bool:
    """Whether a block is a run of sentences, and no label, notice or link."""
    return text.count(" ") >= PROSE - 1 and text[-1] in _SENTENCE_ENDS


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The content blocks that are no template; without a reference, those in an article that has half of their text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            out = []
            columns = (part.column(n).to_pylist() for n in ("html", "reference", "fixed", "shared", "places", "region"))
            for page, reference, fixed, shared, places, main in zip(*columns, strict=True):
                tree = parse(page or "")
                blocks = [(leaf, inside) for leaf, inside in leaves(tree) if leaf.content]
                article = [leaf for leaf, inside in blocks if inside]
                template = set(fixed or ())
                chosen = [leaf for leaf, _ in blocks]
                if template or main:
                    twins = {} if page == reference else _twins(tree, page, reference)
                    if main:
                        chosen = _below(tree, main, twins, chosen)
                    if template and page == reference:
                        chosen = [leaf for leaf in chosen if leaf.number not in template]
                    elif template:
                        chosen = [leaf for leaf in chosen if not ((twin := twins.get(leaf.number)) and twin.number in template and twin.own == leaf.own)]
                if shared or places:
                    known, again, at_place = set(shared or ()), set(places or ()), leaf_hashes(tree)
                    chosen = [leaf for leaf in chosen if at_place[leaf.number][1] not in known and at_place[leaf.number][0] not in again]
                if reference:
                    chosen = chosen or article
                elif 2 * sum(len(leaf.own) for leaf in article) >= sum(len(leaf.own) for leaf in chosen):
                    chosen = article
                out.append(" ".join(leaf.own for leaf in chosen))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


def extracted(pages: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text): the main text, blocks joined by one space.

    Null and empty pages, and pages without content, have an empty text.  A null or malformed url has no
    host, and its page no reference.  Copies of the reference page cast no vote and lose its template
    nodes as they are.  Repeated rows are extracted each, and vote once; other columns are ignored, and an empty table gives
    an empty result.  Pages of any length and depth are parsed whole, in time linear in their length, and aligned
    by a best matching, in time up to the product of their different shapes and of their siblings' numbers.

    The learning and the extracting pass parse each page, as that costs less than writing its blocks.
    References and wrappers of all hosts go to every executor up to ``MAX_BROADCAST_BYTES`` of reference
    pages.  Beyond it pages are dealt by host, twice; the other side is a written table with an exchange
    of its own, so that hot hosts can be split.
    """
    site = F.nullif(host(F.col("url")), F.lit(""))
    own = pages.select("page_id", "url", F.coalesce(F.concat(F.lit("h"), site), F.concat(F.lit("p"), F.col("page_id").cast("string"))).alias("key"), "html")
    first = pages.select(site.alias("host"), "page_id", "html").where("host is not null and html <> ''").groupBy("host").agg(F.min(F.struct("page_id", "html")).alias("x"), F.count("*").alias("n")).where(F.col("n") >= max(2, least_pages - 1))
    first = written(first.select("host", F.col("x.html").alias("reference")), "references")
    key = F.concat(F.lit("h"), F.col("host")).alias("__key")
    total = first.agg(F.sum(F.octet_length("reference"))).first()[0] or 0
    sent = F.broadcast if total <= MAX_BROADCAST_BYTES else lambda x: x
    one = first.select(key, "reference")
    learned = written(own.join(sent(one), own["key"] == one["__key"], "left").select("key", "html", "reference", "page_id", "url").mapInArrow(_learned, _LEAF).dropDuplicates(["key", "page", "leaf"]), "learned")
    learned = different_pages(learned, share, 2)
    fixed = template_nodes(learned, share, least_pages)
    shared = shared_blocks(learned, share, least_pages)
    two = one.join(fixed.withColumnRenamed("key", "__fixed"), F.col("__key") == F.col("__fixed"), "left").join(shared, F.col("__key") == shared["key"], "left").select("__key", "reference", "fixed", "slots", "shared", "places")
    two = written(two.mapInArrow(_regions, "__key string, reference string, fixed array<int>, shared array<bigint>, places array<bigint>, region int"), "wrappers")
    joined = own.join(sent(two), own["key"] == two["__key"], "left").select("page_id", "url", "html", "reference", "fixed", "shared", "places", "region")
    return joined.mapInArrow(_texts, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")


def digest(extracted: DataFrame) -> DataFrame:
    return extracted.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
