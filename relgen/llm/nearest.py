"""Approximate nearest neighbours by inner product: probed lists with an adaptive scan of dimensions.

Vectors are dealt to lists around centroids.  A query probes its nearest lists, as many as a calibration on
the sample finds to be enough.  In a list, query and vectors are rotated and compared a block of columns
after the other: a hypothesis test abandons a vector as soon as its distance over the columns so far is too
large a share for one that would still be among the nearest (shares of a random rotation follow a Beta
law).  What is left is scored exactly on the original vectors, added up in double precision from the first
component to the last.

Inner products become distances by one more component, sqrt(R**2 - |x|**2), R being a norm that nearly all
vectors of the sample stay below; the longer ones form lists of their own, which each query scans whole.
Each query scans its home list first; the last of its nearest there is the bar for the other lists.  If the
probed lists hold too few vectors to fill the ranks, the query goes on to all lists.

Lists are fitted on a bounded sample (SAMPLE different vectors with the least hashes); every vector is
indexed.  Vectors go to a cell, a part of a list of bounded size; of one vector with many ids only as many
ids as can be among the nearest go along, so equal vectors cost nothing wherever a third of the rows are
one.  Queries with equal vectors are searched for once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgen.llm.kernel import bytes_hash, ranges
from relgen.llm.tables import written
from relgen.llm.vectors import matrix

#: Different vectors that lists are fitted on, which the driver holds: 8 MB with 64 components.
SAMPLE = 32_768
#: Lists at most; larger ones have more cells.
MOST_LISTS = 1_024
#: Vectors of a cell, about.
CELL = 8_192
#: Of which so many are compared before the bar is raised.
PIECE = 2_048
#: Columns of a block.
BLOCK = 16
#: Chance that one test of a block abandons a vector that is among the nearest.
RISK = 1e-3
#: Queries that a task compares at a time.
AT_ONCE = 256


def beta_quantile(a: float, b: float, p: float) -> float:
    """By the summed density on a fine grid."""
    x = (np.arange(1 << 16) + 0.5) / (1 << 16)
    log = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    mass = np.cumsum(np.exp(log - log.max()))
    return float(x[np.searchsorted(mass, p * mass[-1])])


@dataclass
class Index:
    """What the sample gives: all that tasks need to know, of bounded size."""

    dims: int
    radius: float
    centroids: np.ndarray
    rotation: np.ndarray
    probes: int
    parts: np.ndarray
    k: int

    def __post_init__(self) -> None:
        #: Cells of long vectors come first, then those of each list.
        self.first_cell = self.parts[0] + np.concatenate([[0], np.cumsum(self.parts[1:])])
        width = self.dims + 1
        self.cuts = [min(i, width) for i in range(BLOCK, width + BLOCK, BLOCK)]
        self.share = [beta_quantile(c / 2, (width - c) / 2, 1 - RISK) if c < width else 1.0 for c in self.cuts]

    def augmented(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.radius**2 - (x * x).sum(1), 0)
        return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The nearest list of each vector."""
        c = self.centroids
        return ((c * c).sum(1) - 2 * (self.augmented(x) @ c.T)).argmin(1)

    def near(self, q: np.ndarray) -> np.ndarray:
        """All lists, nearest first."""
        c = self.centroids
        far = (c * c).sum(1) - 2 * (q @ c[:, :-1].T)
        return np.argsort(far, axis=1, kind="stable")


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first component to the last."""
    out = np.zeros(len(q))
    for i in range(q.shape[1]):
        out += q[:, i] * x[:, i]
    return out


def trained(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Centroids of the sample."""
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.diff(near[order], prepend=-1))
        full = near[order][at]
        c[full] = np.add.reduceat(x[order], at, axis=0) / np.diff(np.append(at, len(x)))[:, None]
    return c


def fitted(x: np.ndarray, rows: int, dims: int, k: int, recall: float, seed: int = 7) -> Index:
    """An index for ``rows`` vectors from the different vectors ``x`` of a sample."""
    norm = np.sqrt((x * x).sum(1))
    radius = float(np.quantile(norm, 0.999)) * 1.05
    short = x[norm <= radius]
    lists = int(min(max(1, math.sqrt(rows) / 2), MOST_LISTS, len(short)))
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims + 1, dims + 1)))[0]
    index = Index(dims, radius, np.zeros((lists, dims + 1)), rotation, lists, np.ones(lists + 1, np.int64), k)
    inside = index.augmented(short)
    index.centroids = trained(inside, lists)
    at = index.lists(short)
    # as many probes as find enough of the sample's own nearest vectors
    asked = short[np.linspace(0, len(short) - 1, min(256, len(short))).astype(int)]
    best = np.argsort(-(asked @ short.T), axis=1)[:, 1 : k + 1]
    place = np.empty((len(asked), lists), np.int64)
    np.put_along_axis(place, index.near(asked), np.arange(lists)[None, :], axis=1)
    if best.size:
        needed = np.sort(np.take_along_axis(place, at[best], axis=1).ravel())
        index.probes = int(needed[min(len(needed) - 1, int(recall * len(needed)))]) + 1
    share = np.bincount(at, minlength=lists) / len(x)
    long = (len(x) - len(short)) / len(x)
    index.parts = np.maximum(1, np.ceil(np.append(long, share) * rows / CELL)).astype(np.int64)
    index.__post_init__()
    return index


def coded(vectors: DataFrame, dims: int, most: int | None = None) -> DataFrame:
    """(vec_id, k1, k2, vec): the vectors that take part, as bytes, and their hash; of each batch the ``most`` least ids of a vector, or all."""
    whole = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    kind = np.float64 if whole == "double" else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = matrix(batch.column(1), dims)
            values = values.astype(kind) + kind(0)
            there = (values != 0).any(axis=1) & batch.column(0).take(pa.array(rows)).is_valid().to_numpy(zero_copy_only=False)
            rows, values = rows[there], np.ascontiguousarray(values[there])
            ids = batch.column(0).take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64)
            data, size = values.view(np.uint8).ravel(), dims * values.itemsize
            start = np.arange(len(rows)) * size
            h = [bytes_hash(data, start, start + size, salt).view(np.int64) if len(rows) else np.zeros(0, np.int64) for salt in (31, 32)]
            kept = least(h[0], h[1], ids, most or len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept]), pa.array(h[0][kept]), pa.array(h[1][kept]), pa.array([values[i].tobytes() for i in kept], pa.binary())], ["vec_id", "k1", "k2", "vec"])

    return vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(run, "vec_id bigint, k1 bigint, k2 bigint, vec binary")


def least(k1: np.ndarray, k2: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Rows of the ``most`` least different ids of each key."""
    order = np.lexsort((ids, k2, k1))
    a, b, c = k1[order], k2[order], ids[order]
    key = np.ones(len(order), bool)
    key[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    new = key.copy()
    new[1:] |= c[1:] != c[:-1]
    order, key = order[new], key[new]
    place = np.arange(len(order))
    return order[place - np.maximum.accumulate(np.where(key, place, 0)) < most] if len(order) else order


def _numbers(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of a binary column."""
    parts = b"".join(column.to_pylist())
    kind = np.float64 if len(parts) == len(column) * dims * 8 else np.float32
    return np.frombuffer(parts, kind).reshape(-1, dims).astype(np.float64)


_ROW = "cell int, kind tinyint, k1 bigint, k2 bigint, vec_id bigint, bar double, vec binary"


def _row(cell, kind, k1, k2, ids, bar, vec) -> pa.RecordBatch:
    n = len(cell)
    return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.full(n, kind, np.int8)), pa.array(k1), pa.array(k2), pa.array(ids), pa.array(bar), vec], ["cell", "kind", "k1", "k2", "vec_id", "bar", "vec"])


def _dealt(shared) -> Callable:
    """Vectors with their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _numbers(batch.column(3), index.dims)
            ids, k1, k2 = (batch.column(i).to_numpy() for i in range(3))
            long = np.sqrt((x * x).sum(1)) > index.radius
            home = index.lists(x)
            part = k1 & (2**63 - 1)
            cell = np.where(long, part % index.parts[0], index.first_cell[home] + part % index.parts[1 + home])
            yield _row(cell, 0, k1, k2, ids, np.zeros(len(x)), batch.column(3))

    return run


def _asked(shared, first: int, last: int, long: bool) -> Callable:
    """Queries with each cell of their nearest lists, from number ``first`` to below ``last``, and with those of long vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                near = index.near(_numbers(batch.column(2), index.dims))
                lists = near[:, first:last]
                owner, of = np.repeat(np.arange(len(near)), lists.shape[1]), lists.ravel()
                cell = ranges(index.first_cell[of], index.parts[1 + of])
                owner = np.repeat(owner, index.parts[1 + of])
                if long:
                    cell = np.concatenate([np.tile(np.arange(index.parts[0]), len(near)), cell])
                    owner = np.concatenate([np.repeat(np.arange(len(near)), index.parts[0]), owner])
                k1, k2, bar = (batch.column(i).to_numpy(zero_copy_only=False)[owner] for i in (0, 1, 3))
                yield _row(cell, 1, k1, k2, np.zeros(len(owner), np.int64), bar, batch.column(2).take(pa.array(owner)))

    return run


class Piece:
    """Some vectors of a cell, rotated, and the scan of them."""

    def __init__(self, index: Index, long: bool, k1: np.ndarray, k2: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        self.index, self.long, self.k1, self.k2, self.ids, self.x = index, long, k1, k2, ids, x
        turned = (index.augmented(x) @ index.rotation).astype(np.float32)
        edges = [0, *index.cuts]
        self.blocks = [np.ascontiguousarray(turned[:, a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        self.squares = [(b * b).sum(1) for b in self.blocks]

    def candidates(self, q: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, vector) that no test abandons."""
        index, n = self.index, len(self.ids)
        if self.long:
            return np.repeat(np.arange(len(q)), n), np.tile(np.arange(n), len(q))
        turned = (np.concatenate([q, np.zeros((len(q), 1))], axis=1) @ index.rotation).astype(np.float32)
        size = (q * q).sum(1) + index.radius**2
        # squared distance at the bar, with room for the rounding of floats
        limit = np.where(np.isfinite(bar), np.maximum(size - 2 * np.where(np.isfinite(bar), bar, 0), 0) + 1e-5 * size, np.inf).astype(np.float32)
        a = b = before = total = sparse = None
        at = 0
        for block, square, cut, share in zip(self.blocks, self.squares, index.cuts, index.share, strict=True):
            part = turned[:, at:cut]
            at = cut
            if a is None or len(a) > len(q) * n // 8:
                # many are left: the block of all pairs
                far = (part * part).sum(1)[:, None] + square - 2 * (part @ block.T)
                total = far if a is None else total + far
                alive = total <= (share * limit)[:, None]
                if a is not None:
                    alive &= before
                before = alive
                a, b = np.nonzero(alive)
            else:
                # few are left: theirs alone
                sparse = total[a, b] if sparse is None else sparse
                sparse = sparse + ((part[a] - block[b]) ** 2).sum(1)
                kept = sparse <= share * limit[a]
                a, b, sparse = a[kept], b[kept], sparse[kept]
        return a, b


def nearest(cell: list[Piece], k: int, k1: np.ndarray, k2: np.ndarray, q: np.ndarray, bar: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The ``k`` + 1 nearest of each query that reach its bar; equal scores by the smaller id.  Each piece raises the bar for the next."""
    for part in cell:
        a, b = part.candidates(q, bar)
        score = np.empty(len(a))
        for i in range(0, len(a), 1 << 15):
            some = slice(i, i + (1 << 15))
            score[some] = exact(q[a[some]], part.x[b[some]])
        kept = score >= bar[a]
        a, b, score = a[kept], b[kept], score[kept]
        order = np.lexsort((part.ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        last = place == k
        bar = bar.copy()
        bar[a[last]] = np.maximum(bar[a[last]], score[last])
        kept = place <= k
        a, b, score = a[kept], b[kept], score[kept]
        same = (part.k1[b] == k1[a]) & (part.k2[b] == k2[a])
        yield pa.RecordBatch.from_arrays([pa.array(k1[a]), pa.array(k2[a]), pa.array(score), pa.array(part.ids[b]), pa.array(same)], ["k1", "k2", "score", "vec_id", "same"])


def _scanned(shared) -> Callable:
    """Rows sorted by cell, its vectors before its queries: holds one cell and a run of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        held: list[tuple] = []
        now, cell, grown = -1, None, 0

        def compact() -> None:
            nonlocal held, grown
            whole = tuple(np.concatenate(c) for c in zip(*held, strict=True))
            kept = least(whole[0], whole[1], whole[2], index.k + 1)
            held, grown = [tuple(c[kept] for c in whole)], len(kept)

        for batch in batches:
            cells, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero((np.diff(cells, prepend=-1) != 0) | (np.diff(kinds, prepend=-1) != 0))
            for i, j in zip(cut, np.append(cut[1:], batch.num_rows), strict=True):
                part = batch.slice(i, j - i)
                if cells[i] != now:
                    now, held, cell, grown = cells[i], [], None, 0
                k1, k2, ids, bar = (part.column(c).to_numpy() for c in (2, 3, 4, 5))
                if kinds[i] == 0:
                    held.append((k1, k2, ids, _numbers(part.column(6), index.dims)))
                    if sum(len(h[0]) for h in held) > 2 * grown + CELL:
                        compact()
                    continue
                if cell is None:
                    if not held:
                        continue
                    compact()
                    cell = [Piece(index, now < index.parts[0], *(c[at : at + PIECE] for c in held[0])) for at in range(0, grown, PIECE)]
                q = _numbers(part.column(6), index.dims)
                for at in range(0, len(q), AT_ONCE):
                    s = slice(at, at + AT_ONCE)
                    yield from nearest(cell, index.k, k1[s], k2[s], q[s], bar[s])

    return run


_FOUND = "k1 bigint, k2 bigint, score double, vec_id bigint, same boolean"


def _best(found: DataFrame, most: int) -> DataFrame:
    """(k1, k2, best): each query vector's nearest, at most ``most``, nearest first.  Ranks are cut before the shuffle."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id"))
    top = found.withColumn("r", rank).where(F.col("r") <= most)
    return top.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("r", "score", "vec_id", "same"))).alias("best"))


def searched(vectors: DataFrame, every: int = 20, k: int = 20, dims: int = 64, recall: float = 0.96) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each row whose vec_id is divisible by ``every``.

    Candidates are all rows but the query's own.  Vectors that are null, zero, of another length or hold a
    null or non-finite component take no part, nor do rows without a vec_id.  Rows with the same vec_id and
    vector count once; rows with one vec_id and different vectors are rows, and queries, of their own.  Equal
    scores go by the smaller vec_id.  Other columns are ignored; an empty table gives an empty result.
    ``recall`` is the share of the sample's own nearest that the probed lists have to hold.
    """
    spark = vectors.sparkSession
    rows = coded(vectors, dims, k + 1)
    total = rows.count()
    share = min(1.0, 4 * SAMPLE / max(total, 1))
    drawn = rows.where(F.col("k1") <= int(-(2**63) + share * (2**64 - 1))) if share < 1 else rows
    picked = drawn.groupBy("k1", "k2").agg(F.first("vec").alias("vec")).orderBy("k1", "k2").limit(SAMPLE).select("vec").toArrow().column(0)
    if not len(picked):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    index = fitted(_numbers(picked.combine_chunks(), dims), total, dims, k, recall)
    shared = spark.sparkContext.broadcast(index)
    cells = rows.mapInArrow(_dealt(shared), _ROW)
    queries = coded(vectors.where(F.col("vec_id") % every == 0), dims)
    different = written(queries.groupBy("k1", "k2").agg(F.first("vec").alias("vec")), "queries")
    none = F.lit(float("-inf"))

    def wave(asked: DataFrame, first: int, last: int, long: bool = False) -> DataFrame:
        both = cells.unionByName(asked.mapInArrow(_asked(shared, first, last, long), _ROW))
        return both.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(_scanned(shared), _FOUND)

    def flat(best: DataFrame) -> DataFrame:
        return best.select("k1", "k2", F.explode("best").alias("b")).select("k1", "k2", "b.score", "b.vec_id", "b.same")

    near = written(_best(wave(different.withColumn("bar", none), 0, 1), k + 1), "home")
    bar = near.where(F.size("best") > k).select("k1", "k2", F.element_at("best", k + 1)["score"].alias("bar"))
    barred = different.join(bar, ["k1", "k2"], "left").select("k1", "k2", "vec", F.coalesce("bar", none).alias("bar"))
    found = written(_best(flat(near).unionByName(wave(barred, 1, index.probes, True)), k + 1), "found")
    short = found.where(F.size("best") <= k).select("k1", "k2").unionByName(different.join(found, ["k1", "k2"], "left_anti").select("k1", "k2"))
    if index.probes < len(index.centroids) and short.limit(1).count():
        # lists too small to fill the ranks: all others are probed too
        rest = different.join(short, ["k1", "k2"], "left_semi").withColumn("bar", none)
        found = _best(flat(found).unionByName(wave(rest, index.probes, len(index.centroids))), k + 1)
    asked = queries.select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct()
    others = F.filter("best", lambda b: ~(b["same"] & (b["vec_id"] == F.col("query_id"))))
    ranked = asked.join(found, ["k1", "k2"]).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", "b.score")
