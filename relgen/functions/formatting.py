"""Values as SQL literals and CSV fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgen.sources.types import NUMERIC


def quote_identifier(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _number(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.format_string("%.2f", value.cast("double"))
    return value.cast("string")


def unsigned_year(text: Column) -> Column:
    """A date's or time's text without the plus sign that Spark puts before years of more than four digits."""
    return F.regexp_replace(text, "^[+]", "")


def second(value: Column) -> Column:
    """A time's text to the second."""
    return unsigned_year(F.date_format(value, "yyyy-MM-dd HH:mm:ss"))


def _text(value: Column, kind: T.DataType) -> Column:
    text = value.cast("string")
    return unsigned_year(text) if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else text


def sql_literal(value: Column, kind: T.DataType, target: str = "", compatible: bool = False) -> Column:
    """``target``: the declared type; text columns quote numbers too.  ``compatible``: decimals are quoted."""
    quoted = F.concat(F.lit("'"), F.replace(_text(value, kind), F.lit("'"), F.lit("''")), F.lit("'"))
    if isinstance(kind, T.BooleanType):
        out = F.when(value, "TRUE").otherwise("FALSE")
    elif isinstance(kind, T.NumericType):
        plain = (not target or target in NUMERIC) and not (compatible and isinstance(kind, T.DecimalType))
        out = _number(value, kind) if plain else F.concat(F.lit("'"), _number(value, kind), F.lit("'"))
    else:
        out = quoted
    return F.when(value.isNull(), "NULL").otherwise(out)


def shortest(value: Column) -> Column:
    """A float's or double's shortest decimal text, with an exponent below 1e-4 and from 1e6 on.

    Spark writes an exponent below 1e-3 and from 1e7 on; only the texts between the two rules are moved.
    """
    text, size = value.cast("string"), F.abs(value)
    plain = F.regexp_replace(text, "[.]0$", "")
    small = F.regexp_replace(F.regexp_replace(text, "^(-?)([0-9])[.]([0-9]+)E-4$", "$10.000$2$3"), "0$", "")
    millions = F.concat(F.regexp_replace(F.regexp_replace(text, "^(-?[0-9])([0-9]{6})[.]([0-9]+)$", "$1.$2$3"), "[.]?0+$", ""), F.lit("e+06"))
    exponent = F.regexp_replace(F.regexp_replace(text, "([.]0)?E", "E"), "E(-?)([0-9])$", "E$10$2")
    exponent = F.regexp_replace(F.replace(exponent, F.lit("E-"), F.lit("e-")), "E", "e+")
    special = F.when(F.isnan(value), "NaN").when(value == F.lit(float("inf")), "+Inf").when(value == F.lit(float("-inf")), "-Inf")
    return special.when((size == 0) | ((size >= 1e-3) & (size < 1e6)), plain).when((size >= 1e-4) & (size < 1e-3), small).when((size >= 1e6) & (size < 1e7), millions).otherwise(exponent)


def csv_field(value: Column, kind: T.DataType) -> Column:
    """Null is empty, text is always quoted, numbers and booleans are plain; no digit of a number is lost."""
    if isinstance(kind, T.BooleanType):
        out = F.when(value, "true").otherwise("false")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        out = shortest(value)
    elif isinstance(kind, T.NumericType):
        out = value.cast("string")
    else:
        out = F.concat(F.lit('"'), F.replace(_text(value, kind), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.isNull(), "").otherwise(out)


def fingerprint(*parts: object) -> Column:
    """The first 16 bytes of a request's SHA-256, in hexadecimal."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.lit(str(p)) for p in parts)), 256), 1, 32)
