"""Prefix trie of rebuilt conversations by polynomial rolling fingerprints.

Turns are sorted by range, so that one conversation may lie in many tasks; numpy scans of each task's runs
give fingerprints of all prefixes, sum(turn_j * base**j) modulo 2**61 - 1 in two bases, and what the
runs before add is told to the few tasks where a conversation goes on.  A conversation that begins with
another one's turns is no new scan: its own turns' sums are shifted by a power of the base.

Fingerprints only propose groups.  Turns are compared by role and text wherever their hashes agree, and
different ones with one hash are numbered.  Prefixes of one depth and fingerprint are compared turn by turn
with their representative, by induction: its last turn and its parent have to be those of every member.
Where a group differs it is split by scanning again in other bases.

The rollup needs no walk over levels.  The smallest member of a node represents it, so the nodes that one
conversation represents are the end of its path; what they save and whether they end in a leaf counts for
each node that has the conversation among its members.

Defined cases: turns go by turn (null first), then role and text; null roles and texts are empty; repeated
rows are turns of their own; rows without a conv_id take no part.  Other columns are ignored, and an empty
table gives an empty result.  ``%`` is the remainder with the sign of conv_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgen.llm.tables import dropped, written

P = (1 << 61) - 1
_P = np.uint64(P)
#: Conversations share the first turns of the first one of each family.
FAMILY = 5
#: Of which they take fewer than so many.
MOST = 9
#: Ids of a packed row.
PACKED = 1 << 16


def mulmod(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a * b modulo P, for numbers below P."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    mid = a1 * b0 + a0 * b1
    x = np.uint64(2) * a1 * b1 + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << half) + a0 * b0
    return _reduced(x)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def submod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _reduced(a + (_P - b))


def power(base: int, n: np.ndarray) -> np.ndarray:
    """base**n modulo P; negative powers are those of the inverse."""
    out = np.ones(len(n), np.uint64)
    for sign, b in ((1, base), (-1, pow(base, -1, P))):
        rest = np.maximum(n * sign, 0)
        while rest.any():
            out = np.where(rest & 1, mulmod(out, np.uint64(b)), out)
            rest, b = rest >> 1, b * b % P
    return out


def summed(x: np.ndarray) -> np.ndarray:
    """Running sums modulo P."""
    low = np.cumsum(x & np.uint64((1 << 31) - 1))
    high = np.cumsum(x >> np.uint64(31))
    return _reduced(mulmod(_reduced(high), np.full(len(x), 1 << 31, np.uint64)) + _reduced(low))


def bases(attempt: int) -> tuple[int, int]:
    made = [int(hashlib.sha256(f"{attempt}:{i}".encode()).hexdigest()[:15], 16) | 1 for i in range(2)]
    return made[0], made[1]


def _values(batch: pa.RecordBatch, names: tuple[str, ...] = ("t1", "t2")) -> list[np.ndarray]:
    """The two numbers of each turn below P."""
    split = batch.column("split").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [_reduced(batch.column(n).to_numpy().view(np.uint64) + split) for n in names]


def _runs(bases: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns in order with their task, their place in the task's run of the conversation, and the run's sums so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, last, at, sums = TaskContext.get().partitionId(), None, 0, [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            new = np.diff(conv, prepend=conv[0] if last is None else last) != 0
            new[0] |= last is None
            place = np.arange(len(conv))
            begin = np.maximum.accumulate(np.where(new, place, -1))
            local = np.where(begin < 0, at + place, place - begin)
            cols = []
            for k, x in enumerate(_values(batch)):
                total = summed(mulmod(x, power(bases[k], local)))
                before = np.where(begin > 0, total[np.maximum(begin - 1, 0)], np.uint64(0))
                carried = np.where(begin < 0, np.uint64(sums[k]), np.uint64(0))
                cols.append(_reduced(submod(total, before) + carried))
                sums[k] = int(cols[k][-1])
            last, at = conv[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), pid, np.int32)), batch.column("conv_id"), pa.array(local), *(pa.array(c.view(np.int64)) for c in cols), *(batch.column(n) for n in ("t1", "t2", "split", "bytes"))], ["pid", "conv_id", "at", "a", "b", "t1", "t2", "split", "bytes"])

    return run


def continued(runs: DataFrame, values: list[str]) -> list[tuple]:
    """(conv_id, pid, number of rows, last values) of each run of a conversation that lies in several tasks; two for a task at most."""
    ends = runs.groupBy("pid").agg(F.min("conv_id").alias("x"), F.max("conv_id").alias("y")).collect()
    seen: dict[int, int] = {}
    for c in (c for r in ends for c in {r["x"], r["y"]}):
        seen[c] = seen.get(c, 0) + 1
    on = [(c,) for c, n in seen.items() if n > 1]
    if not on:
        return []
    named = F.broadcast(runs.sparkSession.createDataFrame(on, "conv_id bigint"))
    parts = runs.join(named, "conv_id").groupBy("conv_id", "pid").agg(F.count("*").alias("n"), *(F.max_by(v, "at").alias(v) for v in values))
    return sorted(tuple(r) for r in parts.collect())


def _placed(runs: DataFrame, bases: tuple[int, int]) -> DataFrame:
    """Every turn's place in its conversation and the fingerprints of the prefix that it ends."""
    before: dict[int, tuple[int, tuple[int, int, int]]] = {}  # by task: the conversation that it goes on with, and what came before
    now, at = None, (0, 0, 0)
    for conv, pid, n, a, b in continued(runs, ["a", "b"]):
        if conv != now:
            now, at = conv, (0, 0, 0)
        if at[0]:
            before[pid] = (conv, at)
        at = (at[0] + n, (at[1] + a * pow(bases[0], at[0], P)) % P, (at[2] + b * pow(bases[1], at[0], P)) % P)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pid, conv = batch.column("pid").to_numpy(), batch.column("conv_id").to_numpy()
            place, sums = batch.column("at").to_numpy().copy(), [batch.column(n).to_numpy().view(np.uint64).copy() for n in ("a", "b")]
            for p in np.unique(pid).tolist():
                if p in before:
                    c, at = before[p]
                    rows = np.flatnonzero((pid == p) & (conv == c))
                    place[rows] += at[0]
                    for k in range(2):
                        sums[k][rows] = _reduced(mulmod(sums[k][rows], np.uint64(pow(bases[k], at[0], P))) + np.uint64(at[1 + k]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(place), *(pa.array(s.view(np.int64)) for s in sums), *(batch.column(n) for n in ("t1", "t2", "split", "bytes"))], ["conv_id", "i", "a", "b", "t1", "t2", "split", "bytes"])

    return runs.mapInArrow(run, "conv_id bigint, i bigint, a bigint, b bigint, t1 bigint, t2 bigint, split int, bytes bigint")


_MEMBER = "conv_id bigint, d bigint, a bigint, b bigint, pa bigint, pb bigint, t1 bigint, t2 bigint, split int, bytes bigint, last boolean"


def _shifted(bases: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A conversation's own turns at their depth in the rebuilt one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda n: batch.column(n).to_numpy()  # noqa: B023, E731
            depth = col("taken") + col("i") - col("h") + 1
            made = []
            for k, x in enumerate(_values(batch)):
                own = submod(col("ab"[k]).view(np.uint64), col(("oa", "ob")[k]).view(np.uint64))
                whole = _reduced(mulmod(own, power(bases[k], col("taken") - col("h"))) + col(("ba", "bb")[k]).view(np.uint64))
                made.append((whole, submod(whole, mulmod(x, power(bases[k], depth - 1)))))
            sums = [pa.array(made[k][j].view(np.int64)) for j in range(2) for k in range(2)]
            last = pa.array(col("i") == col("n") - 1)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(depth), *sums, *(batch.column(n) for n in ("t1", "t2", "split", "bytes")), last], [c.split()[0] for c in _MEMBER.split(", ")])

    return run


def _packed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (d, a, b, conv_id) as one row for each run of a node's ids."""
    for whole in batches:
        for at in range(0, whole.num_rows, PACKED):
            batch = whole.slice(at, PACKED)
            d, a, b, conv = (batch.column(i).to_numpy() for i in range(4))
            cut = np.flatnonzero((np.diff(d, prepend=-1) != 0) | (np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))
            ids = [",".join(map(str, x)) for x in np.split(conv.tolist(), cut[1:])] if len(cut) else []
            yield pa.RecordBatch.from_arrays([pa.array(d[cut]), pa.array(a[cut]), pa.array(b[cut]), pa.array(conv[cut]), pa.array(ids, pa.string())], ["d", "a", "b", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, read piece by piece in order."""
    key, sha = None, None
    names = ["d", "a", "b", "ends"]
    for batch in batches:
        done = []
        for d, a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (d, a, b) == key:
                sha.update(b"," + ids.encode())
                continue
            if key:
                done.append((*key, sha.hexdigest()))
            key, sha = (d, a, b), hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, sha.hexdigest())], names)


def _chain_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes sorted by representative and depth, with the task and what its run of the representative has saved so far."""
    from pyspark import TaskContext

    pid, last, at, run = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, w = batch.column("conv_id").to_numpy(), batch.column("w").to_numpy()
        new = np.diff(conv, prepend=conv[0] if last is None else last) != 0
        new[0] |= last is None
        place = np.arange(len(conv))
        begin = np.maximum.accumulate(np.where(new, place, -1))
        total = np.cumsum(w)
        sums = total - np.where(begin > 0, total[np.maximum(begin - 1, 0)], 0) + np.where(begin < 0, run, 0)
        local = np.where(begin < 0, at + place, place - begin)
        last, at, run = conv[-1], int(local[-1]) + 1, int(sums[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), pid, np.int32)), batch.column("conv_id"), pa.array(local), pa.array(sums), *(batch.column(n) for n in ("w", "d", "a", "b"))], ["pid", "conv_id", "at", "run", "w", "d", "a", "b"])


def _turns(conversations: DataFrame, bits: int) -> DataFrame:
    """Turns with two hashes, and a number that tells different turns with the same hashes apart."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    keep = F.lit((1 << bits) - 1 if bits < 64 else -1)
    rows = rows.withColumns({"t1": F.xxhash64("role", "text").bitwiseAND(keep), "t2": F.xxhash64(F.lit(1), "text", "role").bitwiseAND(keep)})
    different = rows.select("t1", "t2", "role", "text").distinct()
    clash = written(different.groupBy("t1", "t2").agg(F.count("*").alias("n")).where("n > 1").select("t1", "t2"), "clash")
    if not clash.limit(1).count():
        return rows.withColumn("split", F.lit(0))
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("t1", "t2").orderBy("role", "text"))
    numbered = different.join(clash, ["t1", "t2"], "left_semi").withColumn("split", number)
    return rows.join(numbered, ["t1", "t2", "role", "text"], "left").withColumn("split", F.coalesce("split", F.lit(0)))


def _members(conversations: DataFrame, bases: tuple[int, int], bits: int) -> tuple[DataFrame, DataFrame]:
    """(members, plan): a row for each turn of each rebuilt conversation, and one for each conversation."""
    turns = _turns(conversations, bits)
    # the last range key only parts equal rows, whose order is of no account
    parted = turns.repartitionByRange("conv_id", "turn", "role", "text", F.rand(11)).sortWithinPartitions("conv_id", "turn", "role", "text")
    light = parted.select("conv_id", "t1", "t2", "split", F.octet_length("text").cast("bigint").alias("bytes"))
    runs = written(light.mapInArrow(_runs(bases), "pid int, conv_id bigint, at bigint, a bigint, b bigint, t1 bigint, t2 bigint, split int, bytes bigint"), "runs")
    placed = _placed(runs, bases)
    head = F.when(F.col("i") < MOST - 1, F.struct("i", "a", "b", "t1", "t2", "split", "bytes"))
    heads = placed.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(head)).alias("head"))
    take = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST
    heads = written(heads.withColumn("h", take), "heads")
    first = heads.select(F.col("conv_id").alias("first"), F.col("n").alias("first_n"), F.col("head").alias("first_head"))
    both = heads.join(first, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("first"), "left")
    both = both.withColumn("taken", F.least("h", F.coalesce("first_n", F.lit(0))))
    zero = F.lit(0).cast("bigint")
    at = lambda c, k, f: F.when(k > 0, F.get(F.col(c), (k - 1).cast("int"))[f]).otherwise(zero)
    own = F.least("h", "n")
    plan = both.select(
        "conv_id", "n", "h", "taken", *(at("first_head", F.col("taken"), f).alias(f"b{f}") for f in "ab"), *(at("head", own, f).alias(f"o{f}") for f in "ab"),
        F.when(F.col("taken") > 0, F.slice("first_head", F.lit(1), F.col("taken").cast("int"))).alias("shared"),
    )
    plan = written(plan, "plan")
    scalar = plan.select("conv_id", "n", "h", "taken", "ba", "bb", "oa", "ob")
    later = placed.join(scalar, "conv_id").where("i >= h").mapInArrow(_shifted(bases), _MEMBER)
    before = lambda f: F.when(F.col("at") > 0, F.get(F.col("shared"), F.col("at") - 1)[f]).otherwise(zero)
    ends = (F.col("at") + 1 == F.col("taken")) & (F.col("n") <= F.col("h"))
    opened = plan.where("taken > 0").select("conv_id", "n", "h", "taken", "shared", F.posexplode("shared").alias("at", "t"))
    copied = opened.select("conv_id", (F.col("at") + 1).cast("bigint").alias("d"), "t.a", "t.b", before("a").alias("pa"), before("b").alias("pb"), "t.t1", "t.t2", "t.split", "t.bytes", ends.alias("last"))
    members = written(later.unionByName(copied), "members")
    dropped(runs)
    dropped(heads)
    return members, plan.select("conv_id", ((F.col("taken") == 0) & (F.col("n") <= F.col("h"))).alias("turnless"))


def trie(conversations: DataFrame, bits: int = 64) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    ``bits`` are kept of a hash in the first try (fewer only in tests); groups that turn out to hold different prefixes
    are split by another one.
    """
    cut = F.lit((1 << bits) - 1 if bits < 61 else P)
    for attempt in range(8):
        members, plan = _members(conversations, bases(attempt), bits)
        if attempt == 0 and bits < 61:
            members = members.withColumns({c: F.col(c).bitwiseAND(cut) for c in ("a", "b", "pa", "pb")})
        same = ["pa", "pb", "t1", "t2", "split"]
        nodes = members.groupBy("d", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.min("bytes").alias("bytes"), *(f(c).alias(f"{name}_{c}") for c in same for f, name in ((F.min, "least"), (F.max, "most"))))
        nodes = written(nodes.select("d", "a", "b", "conv_id", "n", "bytes", F.col("least_pa").alias("pa"), F.col("least_pb").alias("pb"), F.expr(" or ".join(f"least_{c} <> most_{c}" for c in same)).alias("mixed")), "nodes")
        if not nodes.where("mixed").limit(1).count():
            break
        dropped(nodes)
    else:
        raise RuntimeError("prefixes with the same fingerprints could not be told apart")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = plan.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).where("n > 0")
    root = root.select(zero.alias("d"), zero.alias("a"), zero.alias("b"), "conv_id", "n", zero.alias("bytes"), none.alias("pa"), none.alias("pb"))
    nodes = nodes.drop("mixed").unionByName(root)
    up = nodes.select((F.col("d") - 1).alias("d"), F.col("pa").alias("a"), F.col("pb").alias("b")).where("d >= 0")
    kids = up.groupBy("d", "a", "b").agg(F.count("*").alias("kids"))
    parent = nodes.select(F.col("d").alias("up_d"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    known = nodes.join(kids, ["d", "a", "b"], "left").join(parent, (F.col("d") - 1 == F.col("up_d")) & (F.col("pa") == F.col("up_a")) & (F.col("pb") == F.col("up_b")), "left")
    known = written(known.select("d", "a", "b", "conv_id", "n", "parent_conv_id", F.coalesce("kids", zero).alias("kids"), ((F.col("n") - 1) * F.col("bytes")).alias("w")), "known")
    chains = written(known.groupBy("conv_id").agg(F.sum("w").alias("total"), F.min("d").alias("begin"), F.max((F.col("kids") == 0).cast("bigint")).alias("leaf")), "chains")

    ordered = known.select("conv_id", "d", "a", "b", "w").repartitionByRange("conv_id", "d").sortWithinPartitions("conv_id", "d")
    runs = written(ordered.mapInArrow(_chain_sums, "pid int, conv_id bigint, at bigint, run bigint, w bigint, d bigint, a bigint, b bigint"), "sums")
    before, now, sofar = [], None, 0
    for conv, pid, _, run in continued(runs, ["run"]):
        sofar = 0 if conv != now else sofar
        before.append((conv, pid, sofar))
        now, sofar = conv, sofar + run
    told = F.broadcast(known.sparkSession.createDataFrame(before, "conv_id bigint, pid int, sofar bigint"))
    below = runs.join(told, ["conv_id", "pid"], "left").join(chains.select("conv_id", "total"), "conv_id")
    below = below.select("d", "a", "b", (F.col("total") - F.col("run") - F.coalesce("sofar", zero) + F.col("w")).alias("saved"))

    everyone = members.select("conv_id", "d", "a", "b").unionByName(plan.select("conv_id", zero.alias("d"), zero.alias("a"), zero.alias("b")))
    given = everyone.join(chains, "conv_id").select("d", "a", "b", F.when(F.col("begin") > F.col("d"), F.col("total")).otherwise(zero).alias("saved"), F.col("leaf").alias("leaves"))

    ends = members.where("last").select("d", "a", "b", "conv_id").unionByName(plan.where("turnless").select(zero.alias("d"), zero.alias("a"), zero.alias("b"), "conv_id"))
    packed = ends.repartitionByRange("d", "a", "b", "conv_id").sortWithinPartitions("d", "a", "b", "conv_id").mapInArrow(_packed_ids, "d bigint, a bigint, b bigint, first bigint, ids string")
    digests = packed.repartition("d", "a", "b").sortWithinPartitions("d", "a", "b", "first").mapInArrow(_digests, "d bigint, a bigint, b bigint, ends string")

    parts = known.select("d", "a", "b", "conv_id", "parent_conv_id", "n", "kids").unionByName(given, True).unionByName(below, True).unionByName(digests, True)
    total = lambda c: F.coalesce(F.sum(c), zero)
    whole = parts.groupBy("d", "a", "b").agg(*(F.max(c).alias(c) for c in ("conv_id", "parent_conv_id", "n", "kids", "ends")), total("leaves").alias("n_leaves"), total("saved").alias("saved_tokens"))
    return whole.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


ORACLE_SQL = f"""
WITH o AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), n AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id
), c AS (
  SELECT c.conv_id, c.conv_id - c.conv_id % {FAMILY} AS first, coalesce(b.n, 0) AS first_n,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(c.conv_id AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT) % {MOST} AS h
  FROM n c LEFT JOIN n b ON b.conv_id = c.conv_id - c.conv_id % {FAMILY}
), m AS (
  SELECT c.conv_id, i + 1 AS d, role, text FROM c JOIN o ON o.conv_id = first WHERE i < h
  UNION ALL SELECT c.conv_id, least(h, first_n) + i - h + 1, role, text FROM c JOIN o ON o.conv_id = c.conv_id WHERE i >= h
), p AS (
  SELECT conv_id, d, strlen(text) AS bytes, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d) AS path,
    coalesce(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS up,
    d = max(d) OVER (PARTITION BY conv_id) AS last FROM m
  UNION ALL SELECT conv_id, 0, 0, '', NULL, conv_id NOT IN (SELECT conv_id FROM m) FROM c
), v AS (
  SELECT d, path, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(bytes) AS w,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM p GROUP BY d, path
), k AS (SELECT up AS path, count(*) AS kids FROM v WHERE d > 0 GROUP BY up
), w AS (SELECT v.*, coalesce(kids, 0) AS kids FROM v LEFT JOIN k USING (path)
), s AS (SELECT a.path, sum(b.w) AS saved, count(*) FILTER (b.kids = 0) AS leaves FROM w a JOIN w b ON starts_with(b.path, a.path) GROUP BY a.path)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n AS n_convs, w.kids AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
FROM w JOIN s USING (path) LEFT JOIN w u ON u.path = w.up AND w.d > 0
"""
