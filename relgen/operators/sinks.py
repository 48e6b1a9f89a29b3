"""SQL, CSV and Parquet exports."""

from __future__ import annotations

import codecs
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgen.functions.formatting import csv_field, quote_identifier, sql_literal
from relgen.sources.model import Model
from relgen.steps import filesystem, shared_dir


def sql_rows(df: DataFrame, types: dict[str, str] | None = None, compatible: bool = False) -> DataFrame:
    """A column ``line`` with each row's parenthesised values; other columns go."""
    columns = [c for c in df.columns if c != "row_index"]
    values = [sql_literal(F.col(c), df.schema[c].dataType, (types or {}).get(c, ""), compatible) for c in columns]
    order = ["row_index"] if "row_index" in df.columns else []
    return df.select(*order, F.concat(F.lit("("), F.concat_ws(", ", *values), F.lit(")")).alias("line"))


def csv_rows(df: DataFrame) -> DataFrame:
    columns = [c for c in df.columns if c != "row_index"]
    order = ["row_index"] if "row_index" in df.columns else []
    return df.select(*order, F.concat_ws(",", *(csv_field(F.col(c), df.schema[c].dataType) for c in columns)).alias("line"))


@dataclass
class Segment:
    """A piece of a file: some text, or a part that executors wrote, less its last ``cut`` bytes."""

    text: str = ""
    path: str = ""
    size: int = 0
    cut: int = 0


def _parts(lines: DataFrame, separator: str) -> list[Segment]:
    """The rows' lines, each with the separator after it, as part files in the order of row_index.

    Executors write all parts at once, each a range of row_index; the driver sees their names and sizes.
    """
    spark = lines.sparkSession
    path = f"{shared_dir(spark)}/relgen-{uuid.uuid4().hex}-text"
    if "row_index" in lines.columns:
        lines = lines.repartitionByRange("row_index", "line").sortWithinPartitions("row_index", "line")
    lines.select("line").write.option("lineSep", separator).text(path)
    fs, at = filesystem(spark, path)
    fs.deleteOnExit(at)
    found = [(f.getPath().getName(), f.getLen()) for f in fs.listStatus(at)]
    return [Segment(path=f"{path}/{name}", size=size) for name, size in sorted(found) if name.startswith("part-") and size]


def sql_segments(tables: dict[str, DataFrame], model: Model, schema: str = "", compatible: bool = False) -> list[Segment]:
    """One INSERT for each table that has rows."""
    out: list[Segment] = []
    for name, df in tables.items():
        types = {c.name: c.type for c in model.table(name).columns}
        names = ", ".join(quote_identifier(c) for c in df.columns if c != "row_index")
        if parts := _parts(sql_rows(df, types, compatible), ",\n"):
            parts[-1].cut = 2
            out += [Segment(f"INSERT INTO {schema + '.' if schema else ''}{name} ({names}) VALUES\n"), *parts, Segment(";\n\n")]
    return out


def csv_segments(tables: dict[str, DataFrame], header: bool = True) -> list[Segment]:
    """The tables one after the other, parted by an empty line."""
    out: list[Segment] = []
    for i, df in enumerate(tables.values()):
        out += [Segment("\n")] * (i > 0)
        if header:
            out.append(Segment(",".join(quote_identifier(c) for c in df.columns if c != "row_index") + "\n"))
        out += _parts(csv_rows(df), "\n")
    return out


def one_file(spark: SparkSession, segments: list[Segment], path: str) -> None:
    """Puts segments into one file, byte after byte in buffers of the file system's client; rows are not read again."""
    io = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    fs, at = filesystem(spark, path)
    out = fs.create(at, True)
    try:
        for s in segments:
            if s.text:
                out.write(bytearray(s.text.encode()))
            if s.path:
                source, part = filesystem(spark, s.path)
                held = source.open(part)
                try:
                    io.copyLarge(held, out, 0, s.size - s.cut)
                finally:
                    held.close()
    finally:
        out.close()


def text_of(spark: SparkSession, segments: list[Segment], block: int = 1 << 20) -> Iterator[str]:
    """The segments as text, a block at a time, for a caller that prints or sends it."""
    decode = codecs.getincrementaldecoder("utf-8")()
    for s in segments:
        if s.text:
            yield decode.decode(s.text.encode())
        if s.path:
            source, part = filesystem(spark, s.path)
            held, left = source.open(part), s.size - s.cut
            try:
                while left > 0:
                    data = bytes(held.readNBytes(min(block, left)))
                    left -= len(data)
                    yield decode.decode(data)
            finally:
                held.close()


def _session(tables: dict[str, DataFrame]) -> SparkSession:
    return next(iter(tables.values())).sparkSession


def sql_text(tables: dict[str, DataFrame], model: Model, schema: str = "", compatible: bool = False) -> Iterator[str]:
    """One INSERT for each table that has rows, as blocks of text."""
    if tables:
        yield from text_of(_session(tables), sql_segments(tables, model, schema, compatible))


def csv_text(tables: dict[str, DataFrame], header: bool = True) -> Iterator[str]:
    """The tables in one stream, parted by an empty line, as blocks of text."""
    if tables:
        yield from text_of(_session(tables), csv_segments(tables, header))


def write(tables: dict[str, DataFrame], path: str, kind: str = "parquet", model: Model | None = None) -> None:
    """A folder for each table, written by all executors."""
    for name, df in tables.items():
        if kind == "parquet":
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        else:
            types = {c.name: c.type for c in model.table(name).columns} if model else None
            rows = sql_rows(df, types) if kind == "sql" else csv_rows(df)
            rows.select("line").write.mode("overwrite").text(f"{path}/{name}")


def save(text: Iterator[str], path: str) -> None:
    with Path(path).open("w") as f:
        f.writelines(text)


def preview(tables: dict[str, DataFrame], kind: str = "sql", limit: int | None = None) -> dict[str, list[str]]:
    """The first lines of each table: 10 of SQL, 20 of CSV."""
    limit = limit or (10 if kind == "sql" else 20)
    rows = {n: sql_rows(d) if kind == "sql" else csv_rows(d) for n, d in tables.items()}
    return {n: [r["line"] for r in (d.orderBy("row_index") if "row_index" in d.columns else d).limit(limit).collect()] for n, d in rows.items()}
