"""CREATE TABLE and CREATE TYPE .. AS ENUM statements to a schema model."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path
from typing import Protocol

from pyspark.sql import SparkSession

from relgen.sources.model import Check, Column, Enum, ForeignKey, Model, SchemaError, Table, validate
from relgen.sources.types import CANONICAL, is_serial, normalize_type

MAX_BYTES = 10 << 20


class ParseError(ValueError):
    """Text that isn't a supported statement, with its place."""

    def __init__(self, message: str, line: int, column: int) -> None:
        super().__init__(f"{line}:{column}: {message}")
        self.line, self.column = line, column


class SchemaParser(Protocol):
    name: str
    extensions: tuple[str, ...]

    def parse(self, text: str) -> Model: ...


_LEX = re.compile(r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>[eE]?'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*")|(?P<number>\d+(?:\.\d+)?)|(?P<word>[A-Za-z_\u0080-￿][\w$\u0080-￿]*)|(?P<sign>::|<=|>=|<>|!=|\|\||[-+*/%<>=~!@#&|^(),;.\[\]:?])""", re.S)
_COLUMN_ENDS = frozenset("not null default primary unique references check constraint generated collate deferrable initially".split())
_TABLE_STARTS = frozenset("primary unique foreign check constraint exclude like".split())
_ACTIONS = ("no action", "restrict", "cascade", "set null", "set default")


class _Tokens:
    def __init__(self, text: str) -> None:
        self.text, self.at, self.items = text, 0, []
        pos = 0
        while pos < len(text):
            m = _LEX.match(text, pos)
            if not m:
                raise self.error(f"unexpected {text[pos]!r}", pos)
            if m.lastgroup != "skip":
                self.items.append((m.lastgroup, m[0], m.start(), m.end()))
            pos = m.end()

    def error(self, message: str, pos: int | None = None) -> ParseError:
        if pos is None:
            pos = self.items[self.at][2] if self.at < len(self.items) else len(self.text)
        before = self.text[:pos]
        return ParseError(message, before.count("\n") + 1, pos - (before.rfind("\n") + 1) + 1)

    def peek(self, ahead: int = 0) -> str:
        """The next token: words and signs in lower case, others empty."""
        if self.at + ahead >= len(self.items):
            return ""
        kind, text, *_ = self.items[self.at + ahead]
        return text.lower() if kind in ("word", "sign") else ""

    def take(self, *words: str) -> bool:
        if all(self.peek(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        for w in words:
            if not self.take(w):
                raise self.error(f"expected {w!r}")

    def name(self) -> str:
        kind, text = self.items[self.at][:2] if self.at < len(self.items) else ("", "")
        if kind not in ("word", "quoted"):
            raise self.error("expected a name")
        self.at += 1
        return text[1:-1].replace('""', '"') if kind == "quoted" else text.lower()

    def qualified(self) -> str:
        parts = [self.name()]
        while self.take("."):
            parts.append(self.name())
        return ".".join(parts)

    def names(self) -> list[str]:
        self.need("(")
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        self.need(")")
        return out

    def string(self) -> str:
        if self.at >= len(self.items) or self.items[self.at][0] != "string":
            raise self.error("expected a string")
        self.at += 1
        return self.items[self.at - 1][1].lstrip("eE")[1:-1].replace("''", "'")

    def parenthesised(self) -> str:
        """The source between a pair of parentheses."""
        begin = self.items[self.at][3] if self.at < len(self.items) else 0
        self.need("(")
        depth = 1
        while depth:
            if self.at >= len(self.items):
                raise self.error("unclosed parenthesis")
            depth += {"(": 1, ")": -1}.get(self.peek(), 0)
            self.at += 1
        return self.text[begin : self.items[self.at - 1][2]].strip()

    def expression(self) -> str:
        """The source up to the next column constraint or the end of the column."""
        begin, depth, end = self.at, 0, self.items[self.at][2] if self.at < len(self.items) else 0
        while self.at < len(self.items):
            t = self.peek()
            if depth == 0 and (t in (",", ")") or t in _COLUMN_ENDS and not (t == "null" and self.at == begin)):
                break
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(t, 0)
            end = self.items[self.at][3]
            self.at += 1
        return self.text[self.items[begin][2] : end]


class PostgresParser:
    name, extensions = "postgresql", (".sql",)

    def parse(self, text: str) -> Model:
        if len(text.encode()) > MAX_BYTES:
            raise SchemaError("the schema is over 10 MB")
        t, model = _Tokens(text), Model()
        enums: dict[str, Enum] = {}
        while t.at < len(t.items):
            if t.take(";"):
                continue
            if t.take("create", "type"):
                name = t.qualified()
                t.need("as", "enum", "(")
                values = [] if t.peek() == ")" else [t.string()]
                while t.take(","):
                    values.append(t.string())
                t.need(")")
                enums[name] = Enum(name, values)
            elif t.peek() == "create" and (t.peek(1) == "table" or t.peek(2) == "table"):
                t.at += 1
                if t.peek() != "table":
                    t.at += 1
                t.need("table")
                t.take("if", "not", "exists")
                model.tables.append(_table(t))
            else:
                raise t.error("only CREATE TABLE and CREATE TYPE .. AS ENUM are supported")
            if t.at < len(t.items):
                t.need(";")
        model.enums = list(enums.values())
        _link(model)
        validate(model)
        return model


def _table(t: _Tokens) -> Table:
    table = Table(t.qualified())
    t.need("(")
    inline_fks: list[ForeignKey] = []
    while t.peek() != ")":
        if t.peek() in _TABLE_STARTS and not (t.items[t.at][0] == "quoted"):
            _table_constraint(t, table)
        else:
            _column(t, table, inline_fks)
        if not t.take(","):
            break
    t.need(")")
    table.foreign_keys += inline_fks  # those of the table come first
    return table


def _column(t: _Tokens, table: Table, fks: list[ForeignKey]) -> None:
    column = Column(t.name(), "")
    words: list[str] = []
    if t.at < len(t.items) and t.items[t.at][0] == "quoted":
        words = [t.qualified()]
    while t.items[t.at : t.at + 1] and t.items[t.at][0] == "word" and t.peek() not in _COLUMN_ENDS:
        if words and " ".join([*words, t.peek()]) not in CANONICAL and not any(k.startswith(" ".join([*words, t.peek()]) + " ") for k in CANONICAL) and t.peek() != "array":
            raise t.error(f"unexpected {t.peek()!r} after the type")
        if t.take("array"):
            column.is_array = True
            continue
        words.append(t.qualified() if t.peek(1) == "." else t.name())
        if t.take("("):
            mods = []
            while not t.take(")"):
                mods.append(t.items[t.at][1])
                t.at += 1
            mods = [int(m) for m in mods if m.isdigit()]
            if words[0] not in ("timestamp", "time", "interval", "timestamptz", "timetz"):
                column.length = mods[0] if mods else None
                column.scale = mods[1] if len(mods) > 1 else None
    while t.take("["):
        column.is_array = True
        while not t.take("]"):
            t.at += 1
    column.raw_type = " ".join(words).removeprefix("pg_catalog.")
    if not column.raw_type:
        raise t.error("expected a type")
    column.type, column.is_serial = normalize_type(column.raw_type), is_serial(column.raw_type)
    while t.peek() not in (",", ")", ""):
        if t.take("constraint"):
            t.name()
        elif t.take("not", "null"):
            column.nullable = False
        elif t.take("null"):
            column.nullable = True
        elif t.take("primary", "key"):
            table.primary_key.append(column.name)
        elif t.take("unique"):
            table.unique.append([column.name])
        elif t.take("default"):
            column.default = t.expression()
        elif t.take("check"):
            table.checks.append(Check(t.parenthesised()))
        elif t.take("collate"):
            t.qualified()
        elif t.take("references"):
            fks.append(_references(t, [column.name]))
        elif t.take("generated"):
            while t.peek() not in ("(", ",", ")", "identity", ""):
                t.at += 1
            t.take("identity")
            if t.peek() == "(":
                t.parenthesised()
            t.take("stored")
        else:
            raise t.error(f"unexpected {t.items[t.at][1]!r}")
    table.columns.append(column)


def _references(t: _Tokens, columns: list[str]) -> ForeignKey:
    fk = ForeignKey(columns, t.qualified())
    if t.peek() == "(":
        fk.ref_columns = t.names()
    while True:
        if t.take("on"):
            which = "on_delete" if t.take("delete") else "on_update"
            if which == "on_update":
                t.need("update")
            for a in _ACTIONS:
                if t.take(*a.split()):
                    setattr(fk, which, a.upper())
                    break
            else:
                raise t.error("expected an action")
        elif t.take("match") or t.take("initially"):
            t.name()
        elif not (t.take("deferrable") or t.take("not", "deferrable")):
            return fk


def _table_constraint(t: _Tokens, table: Table) -> None:
    name = t.name() if t.take("constraint") else ""
    if t.take("primary", "key"):
        table.primary_key += t.names()
    elif t.take("unique"):
        table.unique.append(t.names())
    elif t.take("foreign", "key"):
        columns = t.names()
        t.need("references")
        table.foreign_keys.append(_references(t, columns))
    elif t.take("check"):
        table.checks.append(Check(t.parenthesised(), name))
    else:
        raise t.error("unsupported constraint")


def _link(model: Model) -> None:
    """Enum types, key columns, and unique groups that say more than the key."""
    short = {e.name.rpartition(".")[2]: e.name for e in model.enums}
    for table in model.tables:
        table.primary_key = list(dict.fromkeys(table.primary_key))
        for c in table.columns:
            if c.type == "unknown" and (name := c.raw_type if model.enum(c.raw_type) else short.get(c.raw_type)):
                c.type = name
            if c.name in table.primary_key:
                c.is_primary_key, c.nullable = True, False
        groups: list[list[str]] = []
        for u in table.unique:
            u = list(dict.fromkeys(u))
            if set(u) != set(table.primary_key) and all(set(u) != set(g) for g in groups):
                groups.append(u)
        table.unique = groups


class UnknownParser(KeyError):
    """No parser goes by that name."""


class Registry:
    """Schema parsers by name."""

    def __init__(self) -> None:
        self.parsers: dict[str, SchemaParser] = {}

    def register(self, parser: SchemaParser) -> None:
        self.parsers[parser.name] = parser

    def names(self) -> list[str]:
        return sorted(self.parsers)

    def get(self, name: str) -> SchemaParser:
        if name not in self.parsers:
            raise UnknownParser(name)
        return self.parsers[name]


def default_registry() -> Registry:
    registry = Registry()
    registry.register(PostgresParser())
    return registry


def parse(text: str) -> Model:
    return PostgresParser().parse(text)


def parse_file(path: str, spark: SparkSession | None = None, registry: Registry | None = None) -> Model:
    """By the parser of the file's extension, else by the first that can; with a session, from any store Spark reads."""
    text = spark.read.text(path, wholetext=True).first()[0] if spark else Path(path).read_text()
    parsers = list((registry or default_registry()).parsers.values())
    fit = [p for p in parsers if Path(path).suffix.lower() in p.extensions] or parsers
    error: Exception | None = None
    for parser in fit:
        attempt: Callable[[str], Model] = parser.parse
        try:
            return attempt(text)
        except (ParseError, SchemaError) as e:
            error = error or e
    raise error or UnknownParser(path)
