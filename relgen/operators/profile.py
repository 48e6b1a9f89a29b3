"""Column profiles of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 3


def typed_values(df: DataFrame, columns: list[str], order_by: str | None = None) -> DataFrame:
    """(at, i, value): the trimmed text of each column of each row, null for empty ones and the word null."""
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    text = lambda c: F.trim(name(c).cast("string"))
    at = name(order_by) if order_by else F.monotonically_increasing_id()
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.when(~text(c).isin("", "NULL", "null"), text(c)).alias("value")) for i, c in enumerate(columns))))
    return df.select(at.alias("at"), pairs.alias("p")).select("at", "p.*")


def finished(counted: DataFrame, by: str) -> DataFrame:
    """Totals of a column from its counted values (value, n): total, nulls, n_distinct, and whether all are numbers, or whole ones."""
    number = F.col("value").try_cast("double")
    numeric = F.coalesce(number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), F.lit(False))
    known = F.col("value").isNotNull()
    return counted.groupBy(by).agg(
        F.sum("n").alias("total"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("nulls"),
        F.count("value").alias("n_distinct"),
        F.bool_and(F.when(known, numeric)).alias("number"),
        F.bool_and(F.when(known, numeric & ~F.contains("value", F.lit(".")))).alias("whole"),
    )


def profile(df: DataFrame, columns: list[str] | None = None, order_by: str | None = None) -> DataFrame:
    """(column, total, nulls, n_distinct, type, samples) of each column.

    Empty texts and the word null count as nulls; type is integer (numbers without a point), decimal or
    text; samples are the first three values that are not null, by ``order_by`` and among equals by value,
    or in the order of the rows as they are read.  Values are counted as (column, value) pairs, which are
    aggregated before they are shuffled; the first values of each task alone travel for the samples.
    """
    columns = columns or df.columns
    rows = typed_values(df, columns, order_by)
    counted = rows.groupBy("i", "value").agg(F.count("*").alias("n"))
    found = finished(counted, "i")
    first = rows.where("value is not null").withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy("at", "value"))).where(F.col("k") <= SAMPLES)
    samples = first.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("s")).select("i", F.transform("s", lambda x: x["value"]).alias("samples"))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "i int, column string")
    out = names.join(found, "i", "left").join(samples, "i", "left")
    kind = F.when(F.col("whole"), "integer").when(F.col("number"), "decimal").otherwise("text")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("column", *map(zero, ("total", "nulls", "n_distinct")), kind.alias("type"), F.coalesce("samples", F.expr("cast(array() as array<string>)")).alias("samples"))
