"""Centroid clustering by Hamerly's bounds.

Each vector keeps, beside its cluster, one upper bound of the distance to its centroid and one lower bound
of the distance to the second-nearest one; both are written to the shared folder between the rounds.  When
centroids move, the bounds are loosened by the drift.  A vector whose upper bound stays below its lower
bound, or below half the way from its centroid to the next, keeps its cluster unread; one whose upper
bound doesn't hold after it has been made tight is scanned against all centroids in exact integers.

Defined cases: vectors of another length, null ones and those with a null or non-finite component take no
part, nor do those with a component of 2**19 or more in size, whose squared distances leave a bigint.  Rows
that repeat a vec_id or a vector are vectors of their own; a null vec_id counts as an empty text where the
first centroids are chosen, and ties of hashes go by the vectors.  With fewer vectors than centroids there
are as many centroids as vectors; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgen.llm.tables import dropped, written
from relgen.llm.vectors import matrix

#: Integers below this have them exactly in doubles.
_DOUBLE = 1 << 21
#: Share by which bounds are widened, above the rounding of their doubles.
_SLACK = 1e-12


def limit(dims: int) -> int:
    """Integers below this in size have squared distances that fit into 63 bits; 2**27 for 64 components."""
    return 1 << (62 - (dims - 1).bit_length()) // 2 - 1


def integers(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * component), as integers."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = matrix(batch.column(1), dims)
            whole = np.floor(values * scale)
            small = (np.abs(whole) < limit(dims)).all(axis=1)
            flat = pa.array(whole[small].astype(np.int32).ravel())
            made = pa.ListArray.from_arrays(pa.array(np.arange(small.sum() + 1, dtype=np.int32) * dims), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[small])), made], ["vec_id", "v"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, v array<int>")


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row for each vector and a column for each centroid."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < _DOUBLE:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((v - x) ** 2).sum(1) for x in c], axis=1)


def own_distances(v: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((v - c[cluster]) ** 2).sum(1)


def scan(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equal ones) with its squared distance, and the second-nearest's."""
    d = distances(v, c)
    best = d.argmin(1)
    rows = np.arange(len(v))
    first = d[rows, best]
    if len(c) == 1:
        return best, first, np.full(len(v), -1)
    d[rows, best] = np.iinfo(np.int64).max
    return best, first, d.min(1)


def bounds(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bound from exact squared distances; -1 stands for no second centroid."""
    lower = np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0)) * (1 - _SLACK))
    return np.sqrt(first) * (1 + _SLACK), lower


def moved(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds after the centroids went from ``old`` to ``new``, and the number of full scans."""
    drift = np.sqrt(((new - old) ** 2).sum(1).astype(np.float64)) * (1 + _SLACK)
    top = int(drift.argmax())
    others = np.full(len(new), drift[top])
    others[top] = np.delete(drift, top).max(initial=0.0)
    upper = (upper + drift[cluster]) * (1 + _SLACK)
    lower = (lower - others[cluster]) * np.where(lower > others[cluster], 1 - _SLACK, 1 + _SLACK)
    between = distances(new, new)
    np.fill_diagonal(between, np.iinfo(np.int64).max)
    half = np.sqrt(between.min(1).astype(np.float64)) / 2 * (1 - _SLACK) if len(new) > 1 else np.full(1, np.inf)
    safe = np.maximum(lower, half[cluster])
    cluster = cluster.copy()
    loose = np.flatnonzero(~(upper < safe))
    upper[loose] = np.sqrt(own_distances(v[loose], new, cluster[loose])) * (1 + _SLACK)
    open_ = loose[~(upper[loose] < safe[loose])]
    if len(open_):
        cluster[open_], first, second = scan(v[open_], new)
        upper[open_], lower[open_] = bounds(first, second)
    return cluster, upper, lower, len(open_)


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _step(dims: int, old: np.ndarray | None, new: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One assignment of all vectors; the first one, without ``old``, scans them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch, dims)
            if not len(v):
                continue
            if old is None:
                cluster, first, second = scan(v, new)
                upper, lower = bounds(first, second)
            else:
                cluster, upper, lower = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                cluster, upper, lower, _ = moved(v, cluster.astype(np.int64), upper.copy(), lower.copy(), old, new)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower)], ["vec_id", "v", "cluster", "upper", "lower"])

    return run


def _last(dims: int, old: np.ndarray, new: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The last assignment, with exact distances."""
    step = _step(dims, old, new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in step(batches):
            far = own_distances(_vectors(batch, dims), new, batch.column(2).to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(far)], ["vec_id", "cluster", "distance"])

    return run


def _sums(dims: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task's vectors add to each centroid: (cluster, part, value), the number of vectors as part -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            cluster, v = batch.column(0).to_numpy(), _vectors(batch, dims)
            np.add.at(total, cluster, v)
            count += np.bincount(cluster, minlength=k)
        full = np.flatnonzero(count)
        made = np.concatenate([count[full, None], total[full]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(full, dims + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, dims), len(full)).astype(np.int32)), pa.array(made.ravel())], ["cluster", "part", "value"])

    return run


def _updated(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the clusters' exact means; empty clusters stay.  The driver gets a number for each component of each centroid."""
    k, dims = centroids.shape
    parts = state.select("cluster", "v").mapInArrow(_sums(dims, k), "cluster int, part int, value bigint")
    out, count, sums = centroids.copy(), [0] * k, {}
    for r in parts.groupBy("cluster", "part").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        if r["part"] < 0:
            count[r["cluster"]] = int(r["value"])
        else:
            sums[r["cluster"], r["part"]] = int(r["value"])
    for (c, i), total in sums.items():
        out[c, i] = total // count[c]
    return out


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of (vec_id, embedding).

    The first centroids are the vectors with the least SHA-256 of ``salt`` and vec_id.  Only centroids, k
    rows, go through the driver and to all tasks.
    """
    whole = integers(vectors, dims, scale)
    chosen = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = whole.select("v", chosen.alias("h")).orderBy("h", "v").limit(k).collect()
    kind = whole.schema["vec_id"].dataType.simpleString()
    if not first:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centroids = np.array([r["v"] for r in first], dtype=np.int64)
    schema = f"vec_id {kind}, v array<int>, cluster int, upper double, lower double"
    state = written(whole.mapInArrow(_step(dims, None, centroids), schema), "bounds")
    old = centroids
    for i in range(rounds):
        old, centroids = centroids, _updated(state, centroids)
        if i + 1 < rounds:
            before, state = state, written(state.mapInArrow(_step(dims, old, centroids), schema), "bounds")
            dropped(before)
    last = written(state.mapInArrow(_last(dims, old, centroids), f"vec_id {kind}, cluster int, distance bigint"), "clusters")
    dropped(state)
    inertia = last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    total = sum(int(r["s"]) for r in inertia)
    made = [(r["cluster"], int(r["s"]), total, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in inertia]
    about = vectors.sparkSession.createDataFrame(made, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return last.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Plain k-means in SQL: every vector against every centroid in every round."""
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        near = "list_inner_product(v, v) + list_inner_product(m, m) - 2 * list_inner_product(v, m)"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM (SELECT r, vec_id, v, c, {near} AS d FROM v, c{i}) GROUP BY r)")
        if i < rounds:
            sums = f"(SELECT c, list(s ORDER BY i) AS m FROM (SELECT c, i, floor(sum(v[i]) / count(*)) AS s FROM a{i}, range(1, {dims + 1}) t(i) GROUP BY c, i) GROUP BY c)"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN {sums} n USING (c))")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(m, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""


ORACLE_SQL = oracle()
