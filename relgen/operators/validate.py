"""Constraint checks as DataFrames of violations, and their counts."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgen.sources.model import ForeignKey, Model, Table
from relgen.steps import written

SCHEMA = "table string, column string, row_index bigint, value string, rule string, message string"
_COLUMNS = ("table", "column", "row_index", "value", "rule", "message")
ROW = "row_index"


def col(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def display_key(columns: list[str]) -> Column:
    return F.concat_ws("::", *(F.coalesce(col(c).cast("string"), F.lit("<nil>")) for c in columns))


def _out(table: str, df: DataFrame, column: Column, value: Column, rule: str, message: Column) -> DataFrame:
    return df.select(F.lit(table).alias("table"), column.cast("string").alias("column"), F.col(ROW).cast("bigint").alias("row_index"), value.cast("string").alias("value"), F.lit(rule).alias("rule"), message.alias("message"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass
class Single:
    """A check of one row: when it fails, as SQL, and what to say."""

    rule: str
    column: str
    fails: str
    value: Callable[[], Column]
    message: Callable[[], Column]


def single_checks(table: Table, model: Model, columns: list[str]) -> list[Single]:
    """Checks of single rows in the order NOT_NULL, ENUM, LENGTH; a column that the data lacks has no value in any row."""
    # fixed values: the messages
    out, there = [], set(columns)
    for c in table.columns:
        if not c.nullable:
            text = f"has {'nil' if c.name in there else 'no'} value"
            message = lambda c=c, text=text: F.concat(F.lit(f'column "{c.name}" is NOT NULL but row '), F.col(ROW).cast("string"), F.lit(f" {text}"))
            out.append(Single("NOT_NULL", c.name, f"{quoted(c.name)} is null" if c.name in there else "true", lambda: F.lit(None).cast("string"), message))
    for c in table.columns:
        if (e := model.enum(c.type)) and c.name in there:
            value = lambda c=c: col(c.name).cast("string")
            message = lambda value=value, e=e: F.concat(F.lit('value "'), value(), F.lit(f'" is not a valid enum value for type "{e.name}"'))
            known = f" not in ({', '.join(map(text_literal, e.values))})" if e.values else " is not null"
            out.append(Single("ENUM", c.name, f"coalesce(cast({quoted(c.name)} as string){known}, false)", value, message))
    for c in table.columns:
        if c.length and c.type in ("varchar", "char") and c.name in there:
            message = lambda c=c: F.concat(F.lit("string length "), F.octet_length(col(c.name)).cast("string"), F.lit(f" exceeds column limit {c.length}"))
            out.append(Single("LENGTH", c.name, f"coalesce(octet_length({quoted(c.name)}) > {c.length}, false)", lambda c=c: col(c.name).cast("string"), message))
    return out


def failing(table: str, df: DataFrame, checks: list[Single]) -> DataFrame:
    """The rows that fail single-row checks, all in one scan."""
    made = F.array(*(F.when(F.expr(c.fails), F.struct(F.lit(c.column).alias("column"), c.value().alias("value"), F.lit(c.rule).alias("rule"), c.message().alias("message"))) for c in checks))
    rows = df.select(ROW, F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x"))
    return rows.select(F.lit(table).alias("table"), "x.column", F.col(ROW).cast("bigint").alias("row_index"), "x.value", "x.rule", "x.message")


def not_null(table: Table, df: DataFrame) -> DataFrame | None:
    checks = [c for c in single_checks(table, Model(), df.columns) if c.rule == "NOT_NULL"]
    return failing(table.name, df, checks) if checks else None


#: Keys of failing groups up to this number go to all tasks; more are joined by a shuffle of both sides.
MAX_BROADCAST_KEYS = 100_000


def duplicates(table: str, df: DataFrame, key: list[str], rule: str) -> DataFrame:
    """Every row after the first with its key; null equals null.

    Rows go by row_index, a null one first; of the first row's ties all but one are reported.  Keys that
    occur twice are found first, by hash and with partial counts; only their rows are looked at by value.
    """
    t = Table(table, unique=[key] if rule == "UNIQUE" else [], primary_key=key if rule == "PK_UNIQUE" else [])
    checks = key_checks({table: df}, Model([t]), False)
    return keyed_rows({table: df}, checks, failing_keys(groups({table: df}, checks), checks)).select(*_COLUMNS)


def enum(table: str, df: DataFrame, column: str, name: str, values: list[str]) -> DataFrame:
    bad = df.where(col(column).isNotNull() & ~col(column).cast("string").isin(values))
    return _out(table, bad, F.lit(column), col(column), "ENUM", F.format_string(f'value "%s" is not a valid enum value for type "{name}"', col(column).cast("string")))


def length(table: str, df: DataFrame, column: str, limit: int) -> DataFrame:
    """Length is in bytes."""
    bad = df.where(F.octet_length(col(column)) > limit)
    return _out(table, bad, F.lit(column), col(column), "LENGTH", F.format_string(f"string length %d exceeds column limit {limit}", F.octet_length(col(column))))


def orphans(child: DataFrame, parent: DataFrame, columns: list[str], ref_columns: list[str]) -> DataFrame:
    """Rows whose key the parent lacks.  A null single key is no reference; composite keys compare nulls as values."""
    refs = [f"__ref{i}" for i in range(len(ref_columns))]
    keys = parent.select(*(col(c).alias(r) for c, r in zip(ref_columns, refs, strict=True)))
    if len(columns) == 1:
        child = child.where(col(columns[0]).isNotNull())
    same = []
    for c, r in zip(columns, refs, strict=True):
        a, b = col(c), F.col(r)
        if child.schema[c].dataType != keys.schema[r].dataType and not (isinstance(child.schema[c].dataType, T.NumericType) and isinstance(keys.schema[r].dataType, T.NumericType)):
            a, b = a.cast("string"), b.cast("string")
        same.append(a == b if len(columns) == 1 else a.eqNullSafe(b))
    return child.join(keys, same, "left_anti")


def foreign_key(table: str, child: DataFrame, parent: DataFrame, fk: ForeignKey, ref_columns: list[str]) -> DataFrame:
    bad = orphans(child, parent, fk.columns, ref_columns).withColumn("__key", display_key(fk.columns))
    text = "composite value" if len(fk.columns) > 1 else "value"
    column = F.lit(fk.columns[0]) if len(fk.columns) == 1 else F.lit(None)
    return _out(table, bad, column, F.col("__key"), "FK", F.format_string(f'foreign key {text} "%s" not found in referenced table "{fk.ref_table}" PK values', "__key"))


@dataclass
class KeyCheck:
    """A check that compares rows: of a key (ref_table is empty) or of a reference."""

    id: int
    rule: str
    table: str
    columns: list[str]
    ref_table: str = ""
    ref_columns: list[str] = field(default_factory=list)


def _whole(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with nulls for the named columns that it lacks."""
    lacking = [n for n in names if n not in df.columns]
    return df.withColumns({n: F.lit(None).cast("string") for n in lacking}) if lacking else df


def key_checks(tables: dict[str, DataFrame], model: Model, strict_compat: bool) -> list[KeyCheck]:
    """All checks of keys, table by table: primary key, unique groups, references."""
    out: list[KeyCheck] = []
    for t in (model.table(n) for n in tables):
        if t is None:
            continue
        for rule, keys in (("PK_UNIQUE", [t.primary_key] if t.primary_key else []), ("UNIQUE", t.unique)):
            out += [KeyCheck(len(out) + i, rule, t.name, key) for i, key in enumerate(keys)]
        for fk in t.foreign_keys:
            parent = model.table(fk.ref_table)
            if fk.ref_table in tables and parent is not None and not (strict_compat and fk.ref_columns != parent.primary_key):
                out.append(KeyCheck(len(out), "FK", t.name, fk.columns, fk.ref_table, model.ref_columns(fk)))
    return out


#: The types of the columns of each table: read once, as each look at a DataFrame's schema is a call to the JVM.
Kinds = dict[str, dict[str, T.DataType]]


def kinds_of(tables: dict[str, DataFrame]) -> Kinds:
    return {n: {f.name: f.dataType for f in d.schema.fields} for n, d in tables.items()}


def _comparable(a: T.DataType, b: T.DataType) -> str | None:
    """The type that values of two types are compared in; None for their own."""
    if a == b:
        return None
    if not (isinstance(a, T.NumericType) and isinstance(b, T.NumericType)):
        return "string"
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return "bigint"
    if any(isinstance(x, (T.FloatType, T.DoubleType)) for x in (a, b)):
        return "double"
    return f"decimal(38,{max(getattr(x, 'scale', 0) for x in (a, b))})"


def _key_values(check: KeyCheck, kinds: Kinds, parent: bool = False) -> list[str]:
    """The values of a check's key as SQL, on the side of the rows or of the parents; null for a column that is lacking."""
    own, out = kinds[check.ref_table if parent else check.table], []
    for i, name in enumerate(check.ref_columns if parent else check.columns):
        value = quoted(name) if name in own else "cast(null as string)"
        if check.ref_table:
            both = kinds[check.table].get(check.columns[i], T.StringType()), kinds[check.ref_table].get(check.ref_columns[i], T.StringType())
            value = f"cast({value} as {kind})" if (kind := _comparable(*both)) else value
        out.append(value)
    return out


def _item(check: KeyCheck, kinds: Kinds, parent: bool = False) -> str:
    """(check, hash of the key in 128 bits, whether it is a parent's) as SQL; null where a single key is null and hence no reference."""
    values = _key_values(check, kinds, parent)
    parts = [x for v in values for x in (f"{v} is null", v)]
    item = f"named_struct('check', {check.id}, 'h1', xxhash64({', '.join(parts)}), 'h2', xxhash64(1, {', '.join(parts[::-1])}), 'parent', {str(parent).lower()})"
    return f"if({values[0]} is null, null, {item})" if check.ref_table and len(values) == 1 else item


def groups(tables: dict[str, DataFrame], checks: list[KeyCheck], singles: dict[str, list[Single]] | None = None) -> DataFrame | None:
    """(check, h1, h2, n, found): how many rows have a key, and whether it is a parent's.

    All keys of all tables go through one exchange, counted in each task before; each table is read once.
    Checks of single rows ride along: negative numbers of check, 62 each, with what fails as bits in h1.
    """
    out, number, kinds = None, 0, kinds_of(tables)
    for name, df in tables.items():
        items = [_item(c, kinds) for c in checks if c.table == name] + [_item(c, kinds, True) for c in checks if c.ref_table == name]
        single = (singles or {}).get(name, [])
        for at in range(0, len(single), 62):
            number += 1
            bits = " | ".join(f"if({c.fails}, {1 << i}L, 0L)" for i, c in enumerate(single[at : at + 62]))
            items.append(f"if(({bits}) = 0L, null, named_struct('check', {-number}, 'h1', {bits}, 'h2', 0L, 'parent', false))")
        if items:
            rows = df.select(F.expr(f"explode(array({', '.join(items)})) as x")).where("x is not null").select("x.*")
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        return None
    return out.groupBy("check", "h1", "h2").agg(F.sum((~F.col("parent")).cast("bigint")).alias("n"), F.max("parent").alias("found"))


def failing_keys(counted: DataFrame, checks: list[KeyCheck]) -> DataFrame:
    """(check, h1, h2) of keys that occur twice and of references without a parent; written, with their number as ``keys``."""
    references = [c.id for c in checks if c.ref_table]
    is_reference = F.col("check").isin(references) if references else F.lit(False)
    bad = F.when(is_reference, ~F.col("found") & (F.col("n") > 0)).otherwise(F.col("n") > 1)
    return written(counted.where(bad).select("check", "h1", "h2"), "failing-keys")


def keyed_rows(tables: dict[str, DataFrame], checks: list[KeyCheck], bad: DataFrame) -> DataFrame:
    """The violations of keys, with their check's number in ``__check``; only rows with failing keys are compared by value."""
    few = bad.count() <= MAX_BROADCAST_KEYS
    parts, kinds = [], kinds_of(tables)
    wanted = {r["check"] for r in bad.select("check").distinct().collect()}
    for name, df in tables.items():
        own = [c for c in checks if c.table == name and c.id in wanted]
        if not own:
            continue
        whole = _whole(df, [n for c in own for n in c.columns])
        item = lambda c: F.when(F.expr(_item(c, kinds)).isNotNull(), F.struct(F.expr(_item(c, kinds)).alias("item"), F.array(*(F.expr(f"cast({v} as string)") for v in _key_values(c, kinds))).alias("key"), display_key(c.columns).alias("value")))
        rows = whole.select(F.col(ROW), F.explode(F.array(*map(item, own))).alias("x")).where("x is not null").select(ROW, "x.item.check", "x.item.h1", "x.item.h2", "x.key", "x.value")
        parts.append(rows.join(F.broadcast(bad) if few else bad, ["check", "h1", "h2"]).withColumn("table", F.lit(name)))
    spark = bad.sparkSession
    if not parts:
        return spark.createDataFrame([], SCHEMA + ", __check int")
    rows = _union(parts, "", tables)
    refs = [(c.id, c.rule, c.columns[0] if c.ref_table and len(c.columns) == 1 else None, ("composite value" if len(c.columns) > 1 else "value") if c.ref_table else "primary key" if c.rule == "PK_UNIQUE" else "unique value", c.ref_table) for c in checks]
    named = rows.join(F.broadcast(spark.createDataFrame(refs, "check int, rule string, column string, what string, ref string")), "check")
    out = lambda df, message: df.select("table", "column", F.col(ROW).cast("bigint").alias("row_index"), "value", "rule", message.alias("message"), F.col("check").alias("__check"))
    orphaned = out(named.where("ref <> ''"), F.format_string('foreign key %s "%s" not found in referenced table "%s" PK values', "what", "value", "ref"))
    again = named.where("ref = ''")
    about = ["check", "table", "rule", "column", "what", "key", "value"]
    # the first row of each key by value, and how many rows share its row_index
    first = again.groupBy(*about, ROW).agg(F.count("*").alias("c")).groupBy(*about).agg(F.min(F.struct(F.col(ROW).isNotNull().alias("s"), F.col(ROW).alias("r"), "c")).alias("first"))
    message = F.format_string('duplicate %s "%s" (first seen at row %d)', "what", "value", F.col("first.r"))
    ties = first.where("first.c > 1").withColumn(ROW, F.col("first.r")).withColumn("__i", F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("first.c"))))
    keys = first.select("check", F.col("key").alias("__key"), "first")
    # equal keys have equal texts; nulls in them compare as values
    later = again.join(keys.withColumnRenamed("check", "__c"), (F.col("check") == F.col("__c")) & F.col("key").eqNullSafe(F.col("__key")))
    later = later.where(F.col(ROW).isNotNull() & (~F.col("first.s") | (F.col(ROW) > F.col("first.r"))))
    return orphaned.unionByName(out(ties, message)).unionByName(out(later, message))


def _union(parts: list[DataFrame], schema: str, tables: dict[str, DataFrame]) -> DataFrame:
    if not parts:
        spark = next(iter(tables.values())).sparkSession if tables else SparkSession.getActiveSession()
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _required(tables: dict[str, DataFrame] | None, model: Model | None) -> None:
    if tables is None or model is None:
        raise ValueError("dataset is nil" if tables is None else "model is nil")


def _violations(tables: dict[str, DataFrame], model: Model, strict_compat: bool) -> DataFrame:
    """Violations with ``__table`` and ``__check``, their place in a report."""
    _required(tables, model)
    parts: list[DataFrame] = []
    place = {n: i for i, n in enumerate(tables)}
    for name, df in tables.items():
        t = model.table(name)
        if t is None:
            rows = df.sparkSession.createDataFrame([(name, None, None, None, "INTERNAL", f'table "{name}" not found in schema model')], SCHEMA)
            parts.append(rows.withColumn("__check", F.lit(0)))
        elif single := single_checks(t, model, df.columns):
            parts.append(failing(name, df, single).withColumn("__check", F.lit(0)))
    known = {n: d for n, d in tables.items() if model.table(n) is not None}
    if checks := key_checks(known, model, strict_compat):
        parts.append(keyed_rows(known, checks, failing_keys(groups(known, checks), checks)))
    out = _union(parts, SCHEMA + ", __check int", tables)
    at = F.lit(0)
    for name, i in place.items():
        at = F.when(F.col("table") == name, i).otherwise(at)
    return out.withColumn("__table", at)


def violations(tables: dict[str, DataFrame], model: Model, strict_compat: bool = False) -> DataFrame:
    """All violations.  Each DataFrame needs a row_index column that orders its rows.

    A column that a table lacks counts as null in every row.  Foreign keys to tables that are not given are
    not checked.  ``strict_compat``: nor are those that don't name the parent's primary key.  Keys that fail
    are found at once, in a first pass over all tables; the rows come from a second one.
    """
    return _violations(tables, model, strict_compat).select(*_COLUMNS)


def report(tables: dict[str, DataFrame], model: Model, strict_compat: bool = False) -> DataFrame:
    """All violations in order: by table as given, then NOT_NULL, keys, ENUM, LENGTH and references, then by row and column."""
    order = ("INTERNAL", "NOT_NULL", "PK_UNIQUE", "UNIQUE", "ENUM", "LENGTH", "FK")
    rule = F.array_position(F.array(*map(F.lit, order)), F.col("rule"))
    return _violations(tables, model, strict_compat).orderBy("__table", rule, "__check", "row_index", "column", "value").select(*_COLUMNS)


def reference_counts(tables: dict[str, DataFrame], model: Model) -> DataFrame:
    """(child, fk, orphans) of each reference, zero counts too; one scan of each table and one exchange for all keys."""
    checks = [c for c in key_checks(tables, model, False) if c.ref_table]
    spark = next(iter(tables.values())).sparkSession
    about = spark.createDataFrame([(c.id, c.table, ",".join(c.columns)) for c in checks], "check int, child string, fk string")
    lost = groups(tables, checks).where("not found").groupBy("check").agg(F.sum("n").alias("n"))
    return about.join(lost, "check", "left").select("child", "fk", F.coalesce("n", F.lit(0)).cast("bigint").alias("orphans"))


def check_counts(tables: dict[str, DataFrame], model: Model, strict_compat: bool = False) -> DataFrame | None:
    """(table, rule, columns, violations) of each check, zero counts too; one scan of each table."""
    known = {n: d for n, d in tables.items() if model.table(n) is not None}
    checks = key_checks(known, model, strict_compat)
    singles = {n: single_checks(model.table(n), model, d.columns) for n, d in known.items()}
    counted = groups(known, checks, singles)
    if counted is None:
        return None
    names: list[tuple] = [(c.id, None, c.table, c.rule, c.columns, bool(c.ref_table)) for c in checks]
    number = 0
    for n in known:
        for at in range(0, len(singles[n]), 62):
            number += 1
            names += [(-number, i, n, c.rule, [c.column], False) for i, c in enumerate(singles[n][at : at + 62])]
    mask = F.when(F.col("check") < 0, F.col("h1"))
    again, orphaned = F.sum(F.col("n") - 1), F.sum(F.when(~F.col("found"), F.col("n")).otherwise(F.lit(0)))
    sums = counted.groupBy("check", mask.alias("mask")).agg(again.alias("again"), orphaned.alias("orphaned"), F.sum("n").alias("n"))
    spark = next(iter(tables.values())).sparkSession
    about = spark.createDataFrame(names, "check int, bit int, table string, rule string, columns array<string>, reference boolean")
    hit = F.call_function("shiftright", F.col("mask"), F.col("bit")).bitwiseAND(F.lit(1).cast("bigint")) == 1
    n = F.when(F.col("bit").isNotNull(), F.when(hit, F.col("n"))).when(F.col("reference"), F.col("orphaned")).otherwise(F.col("again"))
    rows = about.join(sums, "check", "left").groupBy("check", "bit", "table", "rule", "columns").agg(F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("violations"))
    return rows.select("table", "rule", "columns", "violations")


def summary(tables: dict[str, DataFrame], model: Model, strict_compat: bool = False) -> DataFrame:
    """(table, rule, violations): the number of violations of each kind that is checked, zero counts too; one scan of each table."""
    _required(tables, model)
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.getActiveSession()
    lost = spark.createDataFrame([(n, "INTERNAL", 1) for n in tables if model.table(n) is None], "table string, rule string, violations bigint")
    found = check_counts(tables, model, strict_compat)
    return lost if found is None else found.groupBy("table", "rule").agg(F.sum("violations").alias("violations")).unionByName(lost)


def held(tables: dict[str, DataFrame], model: Model) -> Model:
    """The model less what the data breaks: keys, references, NOT NULL, enums (text instead) and lengths (none instead).

    What the graph, roles and relationships of a declared schema are worth depends on what its rows keep;
    one row for each check comes to the driver.
    """
    found, out = check_counts(tables, model), copy.deepcopy(model)
    for r in (found.where("violations > 0").collect() if found is not None else []):
        t = out.table(r["table"])
        columns = list(r["columns"])
        if r["rule"] == "PK_UNIQUE":
            t.primary_key = []
            for c in t.columns:
                c.is_primary_key = False
        elif r["rule"] == "UNIQUE":
            t.unique = [u for u in t.unique if u != columns]
        elif r["rule"] == "FK":
            t.foreign_keys = [f for f in t.foreign_keys if f.columns != columns]
        else:
            c = t.column(columns[0])
            if r["rule"] == "NOT_NULL":
                c.nullable = True
            elif r["rule"] == "ENUM":
                c.type = "text"
            else:
                c.length = None
    return out
