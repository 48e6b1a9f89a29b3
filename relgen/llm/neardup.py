"""MinHash near-duplicate detection with min-max hashing.

Each permutation of the shingle hashes gives two signature values, its least and its greatest, so 96
permutations make the 192 values of 32 bands of 6.  A pair at similarity 0.85 shares no band with
probability (1 - 0.85**6)**32 = 3e-7.  Documents with equal shingle sets are one class from the start.

Classes that share a band, directly or over others, form a family; the texts of a family's classes
travel once to one place, where links are confirmed on the full sets.  A family above ``block`` shingles is
not gathered: its members are first held against the heads of their bands, which links near all of a large
group of copies in one pass.  In both cases sets that are not yet connected meet only on a shingle among the
rarest of both, as all linked sets do, so that no family is squared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relgen.llm import kernel as K
from relgen.llm.tables import components, grouped_stream, written

BANDS, ROWS = 32, 6
BLOCK = 1_000_000
#: Shingles that are compared at once.
CHUNK = 2_000_000


def shingle_sets(words: K.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    n_words = words.counts()
    count = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    at = K.ranges(words.off[:-1], count)
    text = np.repeat(np.arange(len(count)), count)
    span = np.minimum(n_words, size)[text]
    h = K.span_hash(words.hash, at, at + span, 7)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(count) + 1))


def signatures(h: np.ndarray, off: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (text x band) from the least and greatest value under each permutation; texts without shingles are left out."""
    begin = off[:-1][np.diff(off) > 0]
    keys = np.zeros((len(begin), bands), dtype=np.uint64)
    values = bands * rows
    low = high = None
    for v in range(values):
        if v % 2 == 0:
            p = K.mix(h, 100 + v // 2)
            low, high = np.minimum.reduceat(p, begin), np.maximum.reduceat(p, begin)
        x = low if v % 2 == 0 else high
        # a permutation's two values go to bands far apart
        band = (v // 2 + (v % 2) * (bands // 2)) % bands
        keys[:, band] = K.mix(keys[:, band] * np.uint64(0x9E3779B97F4A7C15) + x, 31)
    return keys


def _sketch(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in K.slices(batch, most=K.SLICE_BYTES // 2):
                h, at = shingle_sets(K.words_of(data, off, lower=True), size)
                n = np.diff(at)
                full = n > 0
                one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                keys = np.zeros((len(n), bands), np.uint64)
                if full.any():
                    begin = at[:-1][full]
                    one[full] = K.mix(np.add.reduceat(K.mix(h, 8), begin), 1)
                    two[full] = K.mix(np.add.reduceat(K.mix(h, 9), begin), 2)
                    keys[full] = signatures(h, at, bands, rows) + np.arange(bands, dtype=np.uint64)[None, :]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), K.signed(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), K.signed(one), K.signed(two), lists], ["doc_id", "n_shingles", "one", "two", "bands"])

    return run


class Sets:
    """Some shingle sets in one task: which of them are linked, found through the rarest shingles of each."""

    def __init__(self, h: np.ndarray, off: np.ndarray, percent: int) -> None:
        self.start, self.size, self.percent = off[:-1], np.diff(off), percent
        self.owner = np.repeat(np.arange(len(off) - 1), self.size)
        self.code = np.unique(h, return_inverse=True)[1]
        self.codes = int(self.code.max()) + 1 if len(h) else 1
        self.key = self.owner * self.codes + self.code

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """(shingle, set), sorted, of shingles in the prefixes of two sets or more.

        In one order of all shingles, rarest first, a set needs ``percent`` of its shingles in another to
        link with it; so two linked sets meet in their first size - percent + 1.
        """
        times = np.bincount(self.code, minlength=self.codes)
        order = np.lexsort((self.code, times[self.code], self.owner))
        owner, code = self.owner[order], self.code[order]
        rank = np.arange(len(order)) - self.start[owner]
        on = (rank <= self.size[owner] + (-self.percent * self.size // 100)[owner]) & (times[code] > 1)
        owner, code = owner[on], code[on]
        order = np.lexsort((owner, code))
        owner, code = owner[order], code[order]
        on = np.bincount(code, minlength=self.codes)[code] > 1
        return code[on], owner[on]

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of sets is linked, a bounded number of shingles at a time."""
        x, y = self.size[a], self.size[b]
        out = 100 * np.minimum(x, y) >= self.percent * np.maximum(x, y)
        todo = np.flatnonzero(out)
        cut = np.searchsorted(np.cumsum(y[todo]), np.arange(0, int(y[todo].sum()) + CHUNK, CHUNK), "right")
        for lo, hi in zip(np.append(0, cut[:-1]), cut, strict=True):
            part = todo[lo:hi]
            if len(part):
                n = self.size[b[part]]
                want = np.repeat(a[part], n) * self.codes + self.code[K.ranges(self.start[b[part]], n)]
                hit = self.key[np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)] == want
                common = np.add.reduceat(hit.astype(np.int64), np.append(0, np.cumsum(n)[:-1]))
                out[part] = 100 * common >= self.percent * (self.size[a[part]] + n - common)
        return out


def _rooted(parent: np.ndarray) -> np.ndarray:
    while (parent != parent[parent]).any():
        parent = parent[parent]
    return parent


def confirm(h: np.ndarray, off: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked among some sets: a pair only if its two sets weren't connected before.

    Sets on one list are held against its first; then only lists with sets of several components give
    further pairs, of sets outside a list's largest component with those of other components.
    """
    sets, links = Sets(h, off, percent), []
    parent = np.arange(len(off) - 1)
    code, owner = sets.lists()
    if not len(code):
        return links

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                links.append((x, y))
                parent[max(p, q)] = min(p, q)

    def tested(a: np.ndarray, b: np.ndarray) -> None:
        pair = np.unique(np.minimum(a, b) * len(parent) + np.maximum(a, b))
        for i in range(0, len(pair), 50_000):
            own = _rooted(parent.copy())
            a, b = np.divmod(pair[i : i + 50_000], len(parent))
            apart = own[a] != own[b]
            a, b = a[apart], b[apart]
            on = sets.linked(a, b)
            join(a[on], b[on])

    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    size = np.diff(np.append(first, len(code)))
    head = np.repeat(owner[first], size)
    tested(head[head != owner], owner[head != owner])
    own = _rooted(parent.copy())
    mixed = np.minimum.reduceat(own[owner], first) < np.maximum.reduceat(own[owner], first)
    left, right, waiting = [], [], 0
    for at, n in zip(first[mixed].tolist(), size[mixed].tolist(), strict=True):
        members = owner[at : at + n]
        label = _rooted(parent)[members] if n > 1000 else np.array([root(x) for x in members.tolist()])
        values, times = np.unique(label, return_counts=True)
        rest = members[label != values[times.argmax()]]
        step = max(1, 1_000_000 // n)
        for i in range(0, len(rest), step):
            some = rest[i : i + step]
            a, b = np.repeat(some, n), np.tile(members, len(some))
            left.append(a[a != b])
            right.append(b[a != b])
            waiting += len(left[-1])
            if waiting > 1_000_000:
                tested(np.concatenate(left), np.concatenate(right))
                left, right, waiting = [], [], 0
    if waiting:
        tested(np.concatenate(left), np.concatenate(right))
    return links


def _links(size: int, percent: int):
    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group, doc = table.column("family").to_pylist(), table.column("doc_id").to_numpy()
        h, off = shingle_sets(K.words_of(*K.text_buffers(table.column("text").combine_chunks()), lower=True), size)
        out: list[tuple[int, int]] = []
        at = 0
        while at < len(group):
            to = at
            while to < len(group) and group[to] == group[at]:
                to += 1
            if to - at > 1:
                out += [(int(doc[at + a]), int(doc[at + b])) for a, b in confirm(h[off[at] : off[to]], off[at : to + 1] - off[at], percent)]
            at = to
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _to_heads(size: int, percent: int):
    """Links of a group's head ``a`` with the other rows of the group."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        head, salt, doc = (table.column(c).to_numpy() for c in ("a", "salt", "doc_id"))
        h, off = shingle_sets(K.words_of(*K.text_buffers(table.column("text").combine_chunks()), lower=True), size)
        sizes = np.diff(off)
        cut = np.flatnonzero((head[1:] != head[:-1]) | (salt[1:] != salt[:-1])) + 1
        found = []
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(head)], strict=True):
            owner = np.repeat(np.arange(hi - lo), sizes[lo:hi])
            for r in np.flatnonzero(doc[lo:hi] == head[lo]).tolist():
                own = h[off[lo + r] : off[lo + r + 1]]
                common = np.bincount(owner, weights=np.isin(h[off[lo] : off[hi]], own), minlength=hi - lo)
                found.append(lo + np.flatnonzero((sizes[lo:hi] > 0) & (100 * common >= percent * (len(own) + sizes[lo:hi] - common))))
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        at = at[doc[at] != head[at]]
        yield pa.RecordBatch.from_arrays([pa.array(head[at], pa.int64()), pa.array(doc[at], pa.int64())], ["a", "b"])

    return run


def head_links(near: DataFrame, members: DataFrame, texts: DataFrame, percent: int, size: int, block: int) -> DataFrame:
    """(a, b): confirmed links of ``members`` (node, n_shingles) with the heads of their bands.

    A head with many members is dealt out by a salt, its own text once to each.
    """
    pairs = near.join(members, near["b"] == members["node"]).select("a", "b", "n_shingles")
    salts = pairs.groupBy("a").agg(F.ceil(F.sum("n_shingles") * 2 / F.lit(block)).cast("int").alias("salts"))
    dealt = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.col("b").alias("doc_id"))
    heads = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("doc_id"))
    return grouped_stream(dealt.unionByName(heads).join(texts, "doc_id").select("a", "salt", "doc_id", "text"), ["a", "salt"], _to_heads(size, percent), "a bigint, b bigint")


def _exploded(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in K.slices(batch, most=K.SLICE_BYTES // 4):
                h, at = shingle_sets(K.words_of(data, off, lower=True), size)
                n = np.diff(at)
                owner = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(owner) for c in ("node", "label", "copy")), pa.array(np.repeat(n, n)), K.signed(h)], ["node", "label", "copy", "n", "h"])

    return run


def open_pairs(members: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """(a, b): pairs of ``members`` (node, family, label) with different labels that may be linked.

    As in ``Sets.lists``, with one order of the shingles of all members; families of one label are left out.
    """
    split = members.groupBy("family").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("family")
    own = members.join(split, "family", "left_semi").select("node", "label")
    rows = written(own.join(texts, own["node"] == texts["doc_id"]).select("node", "label", F.xxhash64("text").alias("copy"), "text").mapInArrow(_exploded(size), "node bigint, label bigint, copy bigint, n bigint, h bigint"), "shingles")
    times = written(rows.groupBy("h").agg(F.count("*").alias("times")).where("times > 1"), "times")
    ranked = rows.join(times, "h", "left").withColumn("rank", F.row_number().over(Window.partitionBy("node", "copy").orderBy(F.coalesce("times", F.lit(1)), "h")))
    lists = written(ranked.where((F.col("times") > 1) & (F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).select("h", "node", "label", "n").distinct(), "lists")
    by_label = lists.groupBy("h", "label").agg(F.count("*").alias("members"))
    mixed = written(by_label.groupBy("h").agg(F.max_by("label", F.struct("members", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").select("h", "main"), "mixed-lists")
    rest = lists.join(mixed, "h").where("label <> main").select("h", F.col("node").alias("a"), F.col("label").alias("own"), F.col("n").alias("size"))
    pairs = rest.join(lists.join(mixed, "h"), "h").where("own <> label and (label = main or a < node)")
    close = 100 * F.least("n", "size") >= percent * F.greatest("n", "size")
    return pairs.where(close).select("a", F.col("node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document.

    Words are lower-cased (A-Z); a set has the distinct ``size``-word shingles, or the whole text where it
    is shorter.  Sets are linked at 100 * common >= percent * all, on the full sets; component_id is the
    least doc_id reachable.  Null, empty and wordless texts have no shingles and link with nothing; rows
    without a doc_id have a null component and are kept; rows that repeat a doc_id are one document with
    the links of each.  Other columns are ignored, and an empty table gives an empty result.  A very long
    text is one row, and one numpy pass.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketch = written(own.mapInArrow(_sketch(size, bands, rows), "doc_id bigint, n_shingles bigint, one bigint, two bigint, bands array<bigint>"), "sketches")
    real = sketch.where("doc_id is not null and n_shingles > 0")
    classes = real.groupBy("one", "two").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("x")).select("one", "two", "x.*")
    keys = written(classes.select("doc_id", F.explode("bands").alias("key")), "keys")
    # small written tables have exchanges of their own in joins, so that the other side of a hot key can be split
    heads = written(keys.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head < last").select("key", "head"), "heads")
    near = keys.join(heads, "key").where("head <> doc_id").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    near = written(near, "candidates")
    families = written(components(near).withColumnRenamed("component", "family"), "families")
    sized = families.join(real.select(F.col("doc_id").alias("node"), "n_shingles").groupBy("node").agg(F.max("n_shingles").alias("n_shingles")), "node")
    large = written(sized.groupBy("family").agg(F.sum("n_shingles").alias("total")).where(F.col("total") > block).select("family"), "large-families")
    placed = sized.join(large, "family", "left_anti").select("family", F.col("node").alias("doc_id"))
    texts = own.where("doc_id is not null")
    links = grouped_stream(texts.join(placed, "doc_id").select("family", "doc_id", "text"), ["family"], _links(size, percent), "a bigint, b bigint")
    if not large.isEmpty():
        members = written(sized.join(large, "family", "left_semi"), "members")
        first = written(head_links(near, members, texts, percent, size, block), "head-links")
        known = components(first).withColumnRenamed("component", "label")
        members = written(members.join(known, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
        more = written(open_pairs(members, texts, percent, size), "open-pairs")
        links = links.unionByName(first).unionByName(head_links(more, members, texts, percent, size, block))
    links = written(links, "links")
    copied = written(real.groupBy("one", "two").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last")).where("a < last").select("one", "two", "a"), "copied")
    exact = real.select("one", "two", "doc_id").join(copied, ["one", "two"]).where("a <> doc_id").select("a", F.col("doc_id").alias("b"))
    # equal sets hang on their class, so only links between classes need the rounds, and documents that belong to several classes
    several = real.groupBy("doc_id").agg(F.min(F.struct("one", "two")).alias("lo"), F.max(F.struct("one", "two")).alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("b"))
    joined = components(links.unionByName(exact.join(several, "b", "left_semi").select("a", "b")))
    root = exact.groupBy("b").agg(F.min("a").alias("a"))
    return sketch.select("doc_id", "n_shingles").join(root, sketch["doc_id"] == root["b"], "left").withColumn("class", F.coalesce("a", "doc_id")).join(joined, F.col("class") == joined["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "class").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def recall_at(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Chance that a pair of this similarity shares a band."""
    return 1 - math.pow(1 - similarity**rows, bands)


ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(words) - 3, 2)), lambda i: hash(array_to_string(words[i : i + 4], ' ')))) AS hs FROM d WHERE len(words) > 0
), e AS (SELECT doc_id, len(hs) AS n, unnest(hs) AS h FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), c AS (SELECT a, min(least(a, b)) AS component FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(len(s.hs), 0) AS BIGINT) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
