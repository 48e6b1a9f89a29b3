"""A rate limit whose windows begin with a visitor's first event.

An event later than its visitor's window opens the next one; of a window's events the first ``limit`` are
allowed.  As each window begins where the one before let it, a visitor's events are folded in order: rows
are dealt by visitor and sorted, and a task holds one batch of them and one window, whoever the visitor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def folded(at: np.ndarray, begin: int | None, count: int, limit: int, size: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Allowed and window of sorted times of one visitor, after a window that began at ``begin`` with ``count`` events let in."""
    allowed, window, i = np.zeros(len(at), bool), np.zeros(len(at), np.int64), 0
    while i < len(at):
        if begin is None or at[i] - begin > size:
            begin, count = int(at[i]), 0
        j = int(np.searchsorted(at, begin + size, "right"))
        let = min(j - i, max(limit - count, 0))
        # the event that opens a window is let in whatever the limit
        let = max(let, 1) if count == 0 else let
        allowed[i : i + let] = True
        window[i:j] = begin
        count, i = count + let, j
    return allowed, window, begin, count


def admitted(events: DataFrame, key: str, at: str, limit: int = 60, seconds: float = 60, order: list[str] | None = None) -> DataFrame:
    """``events`` with ``allowed`` and ``window_start``; ties of ``at`` go by ``order``.

    Events without a visitor are one visitor's; those without a time come first and are all allowed, in no window.
    """
    size = round(seconds * 1_000_000)
    names = [c for c in events.columns if c not in ("allowed", "window_start")]
    rows = events.select(*names, F.unix_micros(F.col(at).cast("timestamp")).alias("__at"), F.xxhash64(key).alias("__key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begin, count = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            visitor = batch.column(batch.schema.get_field_index(key)).to_pylist()
            times, known = batch.column("__at").fill_null(0).to_numpy(), batch.column("__at").is_valid().to_numpy(zero_copy_only=False)
            allowed, window = np.ones(len(times), bool), np.zeros(len(times), np.int64)
            cut = [0, *(i for i in range(1, len(visitor)) if visitor[i] != visitor[i - 1]), len(visitor)]
            for i, j in zip(cut, cut[1:], strict=False):
                if (visitor[i],) != last:
                    last, begin, count = (visitor[i],), None, 0
                k = i + int((~known[i:j]).sum())
                allowed[k:j], window[k:j], begin, count = folded(times[k:j], begin, count, limit, size)
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(allowed), pa.array(window, pa.int64(), mask=~known)], [*names, "allowed", "__window"])

    kinds = T.StructType([*(events.schema[n] for n in names), T.StructField("allowed", T.BooleanType()), T.StructField("__window", T.LongType())])
    ordered = rows.repartition("__key").sortWithinPartitions("__key", key, "__at", *(order or []))
    return ordered.mapInArrow(run, kinds).select(*names, "allowed", F.timestamp_micros("__window").alias("window_start"))
