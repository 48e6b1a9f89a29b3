"""Structured Streaming with state of its own: the rate limit, repeated keys and late parents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from relgen.operators.admission import folded
from relgen.operators.validate import display_key

#: Keyed state of this kind is kept by this provider alone.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(spark: SparkSession) -> None:
    """Sets the state store that keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Admission(StatefulProcessor):
    """A visitor's window and how many events it has let in; a timer forgets visitors whose window is over."""

    def __init__(self, limit: int, size: int) -> None:
        self.limit, self.size = limit, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "begin bigint, count bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        begin, count = self.window.get() if self.window.exists() else (None, 0)
        allowed, _, begin, count = folded(whole["at"].to_numpy(np.int64), begin, count, self.limit, self.size)
        self.window.update((begin, count))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer((begin + self.size) // 1000 + 1)
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(whole), dtype="object"), "id": whole["id"].to_numpy(), "allowed": allowed})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.window.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype="object"), "id": pd.Series([], dtype="int64"), "allowed": pd.Series([], dtype="bool")})

    def close(self) -> None:
        pass


def admitted(events: DataFrame, key: str, at: str, id: str, limit: int = 60, seconds: float = 60, delay: str = "10 seconds") -> DataFrame:
    """(key, id, allowed) of arriving events, as ``operators.admission.admitted`` gives them for events that arrive in order."""
    rows = events.withWatermark(at, delay).select(F.col(key).alias("key"), F.col(id).cast("bigint").alias("id"), F.unix_micros(at).alias("at"), F.col(at).alias("time"))
    kind = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("id", T.LongType()), T.StructField("allowed", T.BooleanType())])
    return rows.groupBy("key").transformWithStateInPandas(_Admission(limit, round(seconds * 1_000_000)), kind, "Append", "EventTime")


class _Repeats(StatefulProcessor):
    """The first row that had a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "row bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        first = self.first.get()[0] if self.first.exists() else None
        for part in rows:
            at = np.sort(part["row_index"].to_numpy(np.int64))
            if first is None:
                first, at = int(at[0]), at[1:]
                self.first.update((first,))
            yield pd.DataFrame({"value": pd.Series([key[0]] * len(at), dtype="object"), "row_index": at, "first": [first] * len(at)})

    def close(self) -> None:
        pass


def repeats(rows: DataFrame, table: str, key: list[str], rule: str) -> DataFrame:
    """Arriving rows whose key an earlier row had, as violations; null equals null.

    The store keeps each different key with its first row for as long as the stream lives.
    """
    what = "primary key" if rule == "PK_UNIQUE" else "unique value"
    keyed = rows.select(display_key(key).alias("key"), F.col("row_index").cast("bigint").alias("row_index"))
    found = keyed.groupBy("key").transformWithStateInPandas(_Repeats(), "value string, row_index bigint, first bigint", "Append", "None")
    message = F.format_string(f'duplicate {what} "%s" (first seen at row %d)', "value", "first")
    return found.select(F.lit(table).alias("table"), "row_index", "value", F.lit(rule).alias("rule"), message.alias("message"))


def late_orphans(child: DataFrame, parent: DataFrame, column: str, ref: str, child_at: str, parent_at: str, wait: str, delay: str = "10 seconds") -> DataFrame:
    """Arriving rows whose parent doesn't arrive until ``wait`` after them; a parent of any earlier time within ``wait`` counts too.

    An outer join of both streams: a row is given out as an orphan when the watermark has passed its time and ``wait``.
    """
    rows = child.withWatermark(child_at, delay)
    keys = parent.withWatermark(parent_at, delay).select(F.col(ref).alias("__ref"), F.col(parent_at).alias("__at"))
    near = (F.col(column) == F.col("__ref")) & (F.col("__at") <= F.col(child_at) + F.expr(f"interval {wait}")) & (F.col("__at") >= F.col(child_at) - F.expr(f"interval {wait}"))
    return rows.join(keys, near, "left_outer").where(F.col("__ref").isNull() & F.col(column).isNotNull()).drop("__ref", "__at")
