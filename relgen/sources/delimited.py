"""Lines of comma-separated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fields(line: Column) -> Column:
    """The line's fields: a quotation mark opens or closes quoting and goes, commas inside are text."""
    parts = F.transform(F.split(line, '"', -1), lambda x, i: F.when(i % 2 == 0, F.replace(x, F.lit(","), F.lit("\n"))).otherwise(x))
    return F.split(F.array_join(parts, ""), "\n", -1)


def from_csv(lines: DataFrame, columns: list[str], line: str = "line") -> DataFrame:
    """``lines`` with a text column for each field; a missing field is null, and surplus fields go."""
    rows = lines.withColumn("__f", fields(F.col(line)))
    return rows.select(*(F.col(c) for c in lines.columns if c != line), *(F.try_element_at("__f", F.lit(i + 1)).alias(c) for i, c in enumerate(columns)))
