"""Tables in the shared folder, streams of complete groups, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgen.steps import dropped, shared_dir, written

__all__ = ["apart", "components", "dropped", "grouped_stream", "shared_dir", "written"]


def apart(df: DataFrame, used: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with all columns but ``used`` under names that no helper column has, and what gives the caller's columns back."""
    names = {c: c if c in set(used) else f"__own_{i}" for i, c in enumerate(df.columns)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.select(*(quoted(c).alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def grouped_stream(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, least: int = 4 << 20, order: list[str] | None = None) -> DataFrame:
    """Like a grouped map, but ``fn`` gets many complete groups at a time, about ``least`` bytes of them.

    Rows are dealt out by ``keys`` and sorted within a partition, so that one task holds no more than
    the groups it is working on.  Callers split groups that are not bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            if size >= least:
                cut = 0
                while cut < batch.num_rows and tuple(c[cut].as_py() for c in cols) == last:
                    cut += 1
                if cut < batch.num_rows:
                    yield from fn(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held, size, batch = [], 0, batch.slice(cut)
                    cols = [c.slice(cut) for c in cols]
            held.append(batch)
            size += batch.nbytes
            last = tuple(c[batch.num_rows - 1].as_py() for c in cols)
        if held:
            yield from fn(pa.Table.from_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges`` (a, b), for every node that has one.

    Labels fall to the least label around, then jump to their label's label; each round is written to
    the shared folder.  The driver sees only the number of changed labels.
    """
    both = edges.where("a is not null and b is not null").select("a", "b")
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        # a node hooks its label's root as well, so that long chains close in a logarithmic number of rounds
        seen = labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "c").alias("c"))
        hooks = seen.where("c < component").groupBy(F.col("component").alias("root")).agg(F.min("c").alias("h"))
        new = seen.join(hooks, seen["node"] == hooks["root"], "left").select("node", F.col("component").alias("old"), F.least("c", "h").alias("c"))
        new = written(new, "hooked")
        jump = new.select(F.col("node").alias("to"), F.col("c").alias("far"))
        labels = written(new.join(jump, new["c"] == jump["to"], "left").select("node", "old", F.least("c", "far").alias("component")), "labels")
        if labels.where("component <> old").limit(1).count() == 0:
            return labels.select("node", "component")
        labels = labels.select("node", "component")
    raise RuntimeError("components did not settle")
