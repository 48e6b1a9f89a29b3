"""op11 to op13 against brute force, and on hostile tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from relgen.llm import clusters, nearest, trie

TURNS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    made = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - math.fmod(c, 5), [])[:h] + x[h:]
    nodes = defaultdict(list)
    for c, x in made.items():
        for d in range(len(x) + 1):
            nodes[tuple(x[:d])].append(c)
    kids = defaultdict(list)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)
    out = {}
    for path in sorted(nodes, key=len, reverse=True):
        below = [out[k] for k in kids[path]]
        saved = (len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0
        ends = ",".join(str(c) for c in sorted(nodes[path]) if len(made[c]) == len(path))
        out[path] = (min(nodes[path]), len(path), min(nodes[path[:-1]]) if path else None, len(nodes[path]), len(below), sum(b[5] for b in below) or 1, saved + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def some_turns(n, seed):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-12, 4 * n), n):
        for turn in range(r.randint(1, 12)):
            rows.append((c, r.choice([turn, turn, turn, None, 0]), r.choice(["user", "assistant", None]), r.choice(["a", "a", "a", "bé", "", None])))
    rows += [(7, i, "user", "x" * (i % 3)) for i in range(3000)] + [(8, 1, "user", "same")] * 500 + [(None, 1, "user", "lost")] * 3
    rows += [(1000 + i, 0, "user", "hot") for i in range(400)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [64, 5])
def test_trie_is_that_of_brute_force(spark, bits):
    rows = some_turns(120, bits)
    df = spark.createDataFrame(rows, TURNS).repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = [tuple(r) for r in trie.trie(df, bits=bits).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(got, key=str) == brute_trie(rows)


def test_trie_of_few_rows(spark):
    for rows in ([], [(None, None, None, None)], [(3, None, None, None)], [(5, 1, "user", "a" * 100_000), (6, 1, "user", "a" * 100_000)]):
        clashing = spark.createDataFrame([(*r, 1, 2, 3, "d") for r in rows], TURNS + ", a int, b int, split int, d string")
        assert sorted((tuple(r) for r in trie.trie(clashing).collect()), key=str) == (brute_trie(rows) if any(r[0] is not None for r in rows) else [])


def test_arithmetic_modulo():
    r = random.Random(1)
    a, b = ([r.randrange(trie.P) for _ in range(500)] + [0, 1, trie.P - 1] for _ in range(2))
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    assert trie.mulmod(x, y).tolist() == [i * j % trie.P for i, j in zip(a, b)]
    assert trie.submod(x, y).tolist() == [(i - j) % trie.P for i, j in zip(a, b)]
    assert trie.summed(x).tolist() == [sum(a[: i + 1]) % trie.P for i in range(len(a))]
    n = np.array([-8, -1, 0, 1, 5, 100_000])
    assert trie.power(12345, n).tolist() == [pow(12345, int(i), trie.P) for i in n]


def brute_clusters(rows, k=40, rounds=5, dims=64):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda x: (name(x[0]), x[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for i in range(rounds + 1):
        at = [min((far(v, m), j) for j, m in enumerate(c)) for _, v in kept]
        if i < rounds:
            for j in range(len(c)):
                own = [v for (_, v), a in zip(kept, at) if a[1] == j]
                c[j] = [sum(x) // len(own) for x in zip(*own)] if own else c[j]
    inertia = defaultdict(int)
    for d, j in at:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at)), key=str)


def some_vectors(n, dims, seed, scale=1.0):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(6, dims))
    rows = [(i, (scale * (middle[i % 6] + r.normal(size=dims))).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(n // 3)] + [rows[1]] * 5
    bad = [None, [], [1.0], [None] + [1.0] * (dims - 1), [math.nan] + [1.0] * (dims - 1), [math.inf] + [1.0] * (dims - 1), [0.0] * (dims + 1)]
    return rows + [(100_000 + i, b) for i, b in enumerate(bad)]


@pytest.mark.parametrize(("n", "scale"), [(300, 1.0), (60, 1000.0), (20, 0.01)])
def test_clusters_are_those_of_brute_force(spark, n, scale):
    rows = [(*r, 1, 2.0, "x") for r in some_vectors(n, 16, n, scale)] + [(None, [scale] * 16, 1, 2.0, "x")]
    df = spark.createDataFrame(rows, VECTORS + ", cluster int, upper double, v string").repartition(5)
    assert sorted((tuple(r) for r in clusters.clustered(df, dims=16).collect()), key=str) == brute_clusters(rows, dims=16)


def test_bounds_spare_scans_and_keep_the_nearest():
    r = np.random.default_rng(3)
    v = np.floor(256 * (np.repeat(r.normal(size=(8, 16)) * 4, 50, axis=0) + r.normal(size=(400, 16)))).astype(np.int64)
    old = v[::50].copy()
    cluster, first, second = clusters.scan(v, old)
    upper, lower = clusters.bounds(first, second)
    new = np.stack([v[cluster == i].sum(0) // max(1, (cluster == i).sum()) for i in range(8)])
    got, upper, lower, scans = clusters.moved(v, cluster, upper, lower, old, new)
    d = clusters.distances(v, new)
    assert got.tolist() == d.argmin(1).tolist() and scans < len(v) / 2
    assert (upper**2 >= d[np.arange(400), got]).all() and (lower <= np.sqrt(np.sort(d, axis=1)[:, 1])).all()
    assert clusters.distances(v * 10_000, new * 10_000).tolist() == (d * 10**8).tolist()


def test_no_vectors(spark):
    empty = spark.createDataFrame([(1, None)], VECTORS)
    for df in (empty, empty.limit(0)):
        assert clusters.clustered(df).count() == 0 and nearest.searched(df).count() == 0


def brute_nearest(rows, k):
    items = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in items:
        if i % 20 == 0:
            scores = []
            for j, w in items - {(i, v)}:
                s = 0.0
                for x, y in zip(v, w):
                    s += x * y
                scores.append((-s, j))
            out[i, v] = sorted(scores)[:k]
    return out


@pytest.mark.parametrize("long", [False, True])
def test_nearest_finds_what_brute_force_does(spark, monkeypatch, long):
    monkeypatch.setattr(nearest, "SAMPLE", 256)
    monkeypatch.setattr(nearest, "CELL", 64)
    monkeypatch.setattr(nearest, "PIECE", 32)
    rows = some_vectors(1500, 16, 5) + [(100_100, [0.0] * 16), (None, [1.0] * 16)]
    if long:
        rows += [(200_000 + i, [1e6 * (i + 1)] + [float(i)] * 15) for i in range(40)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS + ", k1 int, vec string").repartition(6)
    got = defaultdict(list)
    for r in nearest.searched(df, dims=16).collect():
        got[r["query_id"]].append((r["rank"], -r["score"], r["vec_id"]))
    want = {i: x for (i, _), x in brute_nearest(rows, 20).items()}
    assert got.keys() == want.keys()
    assert all([x[0] for x in sorted(g)] == list(range(1, 21)) for g in got.values())
    hits = sum(len(set(want[i]) & {x[1:] for x in g}) for i, g in got.items())
    assert hits >= 0.9 * 20 * len(want)
    # where vectors are equal the smaller ids come first, and the query is not its own neighbour
    assert [x[1:] for x in sorted(got[0])] == want[0] and all(i not in {x[2] for x in g} for i, g in got.items())


def test_nearest_among_few(spark):
    rows = [(20 * i, [1.0 + i % 3] * 16) for i in range(5)]
    found = nearest.searched(spark.createDataFrame(rows, VECTORS), dims=16).collect()
    want = {i: [(j, -s) for s, j in x] for (i, _), x in brute_nearest(rows, 20).items()}
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert dict(got) == want


def test_abandoned_vectors_are_rarely_near():
    r = np.random.default_rng(9)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = nearest.fitted(x, len(x), 64, 20, 0.9)
    q = x[:50]
    score = q @ x.T
    bar = np.sort(score, axis=1)[:, -21]
    piece = nearest.Piece(index, False, np.arange(4000), np.arange(4000), np.arange(4000), x)
    a, b = piece.candidates(q, bar)
    near = set(zip(*np.nonzero(score >= bar[:, None])))
    assert len(near & set(zip(a, b))) >= 0.98 * len(near) and len(a) < 0.05 * score.size
