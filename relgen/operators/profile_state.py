"""Profiles that are stored and merged: what is counted of appended rows joins what was counted before.

A state is a DataFrame with one row for the totals of each column, one for each text value, and integers by
buckets of 32,768 neighbours: as sorted positions where a bucket has few of them, else as a bitmap.  It
grows with the number of different values, not of rows; distinct counts stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgen.operators.profile import SAMPLES, finished, typed_values

#: A bucket with so many values or more is a bitmap of 4 KB.
DENSE = 512


def _integers(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(integers as (column, bucket, pos), other values as (column, value, n)); texts that only look alike, as 07 and 7, are kept apart."""
    number = F.col("value").try_cast("bigint")
    whole = F.coalesce(number.cast("string") == F.col("value"), F.lit(False)) & (number > F.lit(-(2**62)))
    place = values.where(whole).select("column", F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("pos"))
    return place, values.where(~whole)


def _compact(positions: DataFrame, bitmaps: DataFrame | None = None) -> DataFrame:
    """(column, bucket, positions, bitmap): each bucket once, in the form for its number of values.

    Sparse buckets never meet a bitmap's buffer; a bucket's positions are bounded by its size.
    """
    key = ["column", "bucket"]
    sets = positions.groupBy(*key).agg(F.sort_array(F.collect_set("pos")).alias("positions"))
    dense = F.size("positions") >= DENSE
    if bitmaps is not None:
        known = bitmaps.select(F.col("column").alias("__c"), F.col("bucket").alias("__b")).distinct()
        sets = sets.join(known, (F.col("column") == F.col("__c")) & (F.col("bucket") == F.col("__b")), "left")
        dense = dense | F.col("__c").isNotNull()
    sparse = sets.where(~dense).select(*key, "positions", F.lit(None).cast("binary").alias("bitmap"))
    full = sets.where(dense).select(*key, F.explode("positions").alias("pos")).groupBy(*key).agg(F.bitmap_construct_agg("pos").alias("bitmap"))
    if bitmaps is not None:
        full = full.unionByName(bitmaps.select(*key, "bitmap")).groupBy(*key).agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return sparse.unionByName(full.select(*key, F.lit(None).cast("array<bigint>").alias("positions"), "bitmap"))


def _state(totals: DataFrame, buckets: DataFrame, values: DataFrame) -> DataFrame:
    out = totals.withColumn("kind", F.lit("total")).unionByName(buckets.withColumn("kind", F.lit("integers")), True)
    return out.unionByName(values.withColumn("kind", F.lit("value")), True)


def _first(samples: Column) -> Column:
    return F.slice(F.array_sort(samples), 1, SAMPLES)


def profile_state(df: DataFrame, columns: list[str] | None = None, order_by: str | None = None, batch: int = 0) -> DataFrame:
    """The state of some rows.  ``order_by`` orders samples; without it later rows need a higher ``batch``."""
    rows = typed_values(df, columns or df.columns, order_by)
    names = df.sparkSession.createDataFrame(list(enumerate(columns or df.columns)), "i int, column string")
    counted = rows.groupBy("i", "value").agg(F.count("*").alias("n"))
    found = counted.join(F.broadcast(names), "i")
    known = F.col("value").isNotNull()
    totals = finished(found, "column").drop("n_distinct").join(_samples(rows, names, batch), "column", "left")
    place, others = _integers(found.where(known).select("column", "value", "n"))
    return _state(totals, _compact(place), others)


def _samples(rows: DataFrame, names: DataFrame, batch: int) -> DataFrame:
    """(column, samples): the first values of each column with their places; each task sends its own first ones only."""
    from pyspark.sql import Window

    first = rows.where("value is not null").withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy("at", "value"))).where(F.col("k") <= SAMPLES)
    held = F.struct(F.lit(batch).cast("bigint").alias("batch"), "at", "value")
    return first.join(F.broadcast(names), "i").groupBy("column").agg(F.array_sort(F.collect_list(held)).alias("samples"))


def merged(*states: DataFrame) -> DataFrame:
    """The state of all rows of some states."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    rows = every.where("kind = 'total'")
    add = [F.sum(c).alias(c) for c in ("total", "nulls")] + [F.bool_and(c).alias(c) for c in ("number", "whole")]
    totals = rows.groupBy("column").agg(*add, _first(F.flatten(F.collect_list("samples"))).alias("samples"))
    buckets = every.where("kind = 'integers'")
    place = buckets.where("positions is not null").select("column", "bucket", F.explode("positions").alias("pos"))
    values = every.where("kind = 'value'").groupBy("column", "value").agg(F.sum("n").alias("n"))
    return _state(totals, _compact(place, buckets.where("bitmap is not null")), values)


def profile_of(state: DataFrame) -> DataFrame:
    """The profile that a state stands for, as ``profile`` gives it for the rows."""
    size = F.when(F.col("bitmap").isNotNull(), F.bitmap_count("bitmap")).when(F.col("positions").isNotNull(), F.size("positions")).when(F.col("kind") == "value", 1)
    distinct = state.groupBy("column").agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0)).alias("n_distinct"))
    totals = state.where("kind = 'total'").select("column", "total", "nulls", "number", "whole", "samples")
    kind = F.when(F.col("whole"), "integer").when(F.col("number"), "decimal").otherwise("text")
    samples = F.coalesce(F.transform("samples", lambda x: x["value"]), F.expr("cast(array() as array<string>)"))
    return totals.join(distinct, "column").select("column", "total", "nulls", "n_distinct", kind.alias("type"), samples.alias("samples"))
