"""The schema model: tables, columns, keys and enums, and its catalog DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class SchemaError(ValueError):
    """A schema that can't be built."""


@dataclass
class Column:
    name: str
    type: str
    raw_type: str = ""
    length: int | None = None
    scale: int | None = None
    nullable: bool = True
    default: str | None = None
    is_serial: bool = False
    is_array: bool = False
    is_primary_key: bool = False
    semantic: str | None = None


@dataclass
class ForeignKey:
    columns: list[str]
    ref_table: str
    ref_columns: list[str] = field(default_factory=list)
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"


@dataclass
class Check:
    expression: str
    name: str = ""


@dataclass
class Table:
    name: str
    columns: list[Column] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    checks: list[Check] = field(default_factory=list)

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)


@dataclass
class Enum:
    name: str
    values: list[str]


@dataclass
class Model:
    tables: list[Table] = field(default_factory=list)
    enums: list[Enum] = field(default_factory=list)

    def table(self, name: str) -> Table | None:
        return next((t for t in self.tables if t.name == name), None)

    def enum(self, name: str) -> Enum | None:
        return next((e for e in self.enums if e.name == name), None)

    def ref_columns(self, fk: ForeignKey) -> list[str]:
        """The referenced columns; the parent's primary key where none are named."""
        parent = self.table(fk.ref_table)
        return fk.ref_columns or (parent.primary_key if parent else [])


def preflight(model: Model) -> list[tuple[str, str]]:
    """Every (table, message) that is wrong with a model."""
    found = []
    for t in model.tables:
        names = [c.name for c in t.columns]
        found += [(t.name, f'duplicate column "{n}"') for n in dict.fromkeys(names) if names.count(n) > 1]
        found += [(t.name, f'primary key column "{n}" does not exist') for n in t.primary_key if n not in names]
        found += [(t.name, f'unique column "{n}" does not exist') for u in t.unique for n in u if n not in names]
        for fk in t.foreign_keys:
            parent = model.table(fk.ref_table)
            if parent is None:
                found.append((t.name, f'foreign key references unknown table "{fk.ref_table}"'))
            found += [(t.name, f'foreign key column "{n}" does not exist') for n in fk.columns if n not in names]
            if parent is not None:
                found += [(t.name, f'referenced column "{n}" does not exist in "{fk.ref_table}"') for n in fk.ref_columns if parent.column(n) is None]
    return found


def validate(model: Model) -> None:
    """Raises the first thing that makes a model unusable."""
    names: set[str] = set()
    for t in model.tables:
        if not t.columns:
            raise SchemaError(f'table "{t.name}" has no columns')
        if t.name in names:
            raise SchemaError(f'duplicate table "{t.name}"')
        names.add(t.name)
    for table, message in preflight(model):
        raise SchemaError(f'table "{table}": {message}')
    for t in model.tables:
        for c in t.columns:
            if c.type == "unknown":
                raise SchemaError(f'table "{t.name}", column "{c.name}": undefined enum or type "{c.raw_type}"')


def catalog(spark: SparkSession, model: Model) -> dict[str, DataFrame]:
    """The model as DataFrames: tables, columns, keys, fks, enums, checks, in declaration order."""
    rows: dict[str, list[tuple]] = {k: [] for k in ("tables", "columns", "keys", "fks", "enums", "checks")}
    for i, t in enumerate(model.tables):
        rows["tables"].append((i, t.name))
        for j, c in enumerate(t.columns):
            rows["columns"].append((t.name, j, c.name, c.type, c.length, c.scale, c.nullable, c.is_primary_key, c.is_serial, c.default, c.semantic))
        if t.primary_key:
            rows["keys"].append((t.name, "primary", 0, t.primary_key))
        rows["keys"] += [(t.name, "unique", j, u) for j, u in enumerate(t.unique)]
        rows["fks"] += [(t.name, j, f.columns, f.ref_table, model.ref_columns(f), f.on_delete, f.on_update) for j, f in enumerate(t.foreign_keys)]
        rows["checks"] += [(t.name, j, c.name, c.expression) for j, c in enumerate(t.checks)]
    rows["enums"] = [(e.name, j, v) for e in model.enums for j, v in enumerate(e.values)]
    schemas = {
        "tables": "ord int, table string",
        "columns": "table string, ord int, column string, type string, length int, scale int, nullable boolean, is_primary_key boolean, is_serial boolean, default string, semantic string",
        "keys": "table string, kind string, ord int, columns array<string>",
        "fks": "table string, ord int, columns array<string>, ref_table string, ref_columns array<string>, on_delete string, on_update string",
        "enums": "enum string, ord int, value string",
        "checks": "table string, ord int, name string, expression string",
    }
    return {k: spark.createDataFrame(v, schemas[k]) for k, v in rows.items()}
