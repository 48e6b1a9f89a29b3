"""Canonical column types: their raw spellings and Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: PostgreSQL spellings of each canonical type
SPELLINGS = {
    "int": "int|integer|int4|serial|serial4",
    "bigint": "bigint|int8|bigserial|serial8",
    "smallint": "smallint|int2|smallserial|serial2",
    "text": "text|name|citext|cidr",
    "varchar": "varchar|character varying",
    "char": "char|character|bpchar",
    "boolean": "bool|boolean",
    "decimal": "numeric|decimal|dec",
    "float": "real|float4|float",
    "double": "double|double precision|float8",
    "date": "date",
    "time": "time|timetz|time with time zone|time without time zone",
    "timestamp": "timestamp|timestamptz|timestamp with time zone|timestamp without time zone",
    "interval": "interval",
    "uuid": "uuid",
    "json": "json",
    "jsonb": "jsonb",
    "bytea": "bytea",
    "inet": "inet",
    "macaddr": "macaddr",
}
CANONICAL = {raw: name for name, spellings in SPELLINGS.items() for raw in spellings.split("|")}
SERIAL = frozenset("serial serial4 bigserial serial8 smallserial serial2".split())
NUMERIC = frozenset("int bigint smallint decimal float double".split())
TEXT = frozenset("text varchar char".split())
TEMPORAL = frozenset("date time timestamp interval".split())


def normalize_type(raw: str) -> str:
    """The canonical name; ``unknown`` where there is none (an enum, or an error)."""
    return CANONICAL.get(raw.lower().strip(), "unknown")


def is_serial(raw: str) -> bool:
    return raw.lower().strip() in SERIAL


def is_numeric(canonical: str) -> bool:
    return canonical in NUMERIC


def is_text(canonical: str) -> bool:
    return canonical in TEXT


def is_temporal(canonical: str) -> bool:
    return canonical in TEMPORAL


def spark_type(canonical: str, length: int | None = None, scale: int | None = None) -> T.DataType:
    simple = {"int": T.IntegerType(), "bigint": T.LongType(), "smallint": T.ShortType(), "boolean": T.BooleanType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "bytea": T.BinaryType()}
    if canonical == "decimal":
        return T.DecimalType(length or 10, scale if scale is not None else (0 if length else 2))
    return simple.get(canonical, T.StringType())


def display_type(name: str, length: int | None, scale: int | None) -> str:
    return name if length is None else f"{name}({length}{'' if scale is None else f',{scale}'})"
