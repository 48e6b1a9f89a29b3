"""Structured Streaming: constraint checks on arriving rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgen.sources.model import Model, Table


def row_violations(rows: DataFrame, table: Table, model: Model, key: str) -> DataFrame:
    """(key, column, rule) of checks on single rows; no state is kept."""
    found = []
    for c in table.columns:
        bad = F.lit(False)
        if not c.nullable:
            found.append(F.when(F.col(c.name).isNull(), F.struct(F.lit(c.name).alias("column"), F.lit("NOT_NULL").alias("rule"))))
        if e := model.enum(c.type):
            bad = F.col(c.name).isNotNull() & ~F.col(c.name).isin(e.values)
            found.append(F.when(bad, F.struct(F.lit(c.name).alias("column"), F.lit("ENUM").alias("rule"))))
        if c.length and c.type in ("varchar", "char"):
            found.append(F.when(F.octet_length(c.name) > c.length, F.struct(F.lit(c.name).alias("column"), F.lit("LENGTH").alias("rule"))))
    return rows.select(F.col(key).alias("key"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("v")).select("key", "v.*")


def first_of_key(rows: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    """Rows without later repeats of their key within the watermark."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)
