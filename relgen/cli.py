"""Command line: generate, inspect, serve, config, version."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from relgen import __version__

log = logging.getLogger("relgen")
MAX_ROWS = 100_000
CONFIG = "verbose: false\ngenerate:\n  input: schema.sql\n  rows: 10\n  seed: 42\n  format: sql\ninspect:\n  input: schema.sql\n  graph: false\n  semantic: false\n"


def load_config(path: str | None) -> dict:
    """Two levels of a YAML file."""
    if not path:
        return {}
    try:
        import yaml

        return yaml.safe_load(Path(path).read_text()) or {}
    except ImportError:
        out: dict = {}
        section = out
        for line in Path(path).read_text().splitlines():
            name, _, value = line.split("#")[0].partition(":")
            if not name.strip():
                continue
            if not line.startswith(" "):
                section = out
            if value.strip():
                v = value.strip().strip("\"'")
                section[name.strip()] = {"true": True, "false": False}.get(v, int(v) if v.isdigit() else v)
            else:
                section = out[name.strip()] = {}
        return out


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="relgen")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("generate", "inspect"):
        s = sub.add_parser(name)
        s.add_argument("--input", "-i")
        s.add_argument("--config")
        s.add_argument("--verbose", "-v", action="store_true")
    g, i = sub.choices["generate"], sub.choices["inspect"]
    g.add_argument("--rows", "-n", type=int)
    g.add_argument("--seed", type=int)
    g.add_argument("--format", choices=("sql", "csv", "parquet"))
    g.add_argument("--output", "-o")
    g.add_argument("--schema", default="")
    i.add_argument("--graph", action="store_true")
    i.add_argument("--semantic", action="store_true")
    w = sub.add_parser("serve")
    w.add_argument("--port", type=int, default=8080)
    w.add_argument("--host", default="127.0.0.1")
    w.add_argument("--job-file")
    c = sub.add_parser("config")
    c.add_argument("--output", "-o")
    sub.add_parser("version")
    return p


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    if args.command == "config":
        if args.output:
            Path(args.output).write_text(CONFIG)
        else:
            sys.stdout.write(CONFIG)
        return 0
    if args.command == "serve":
        return _serve(args)
    whole = load_config(args.config)
    config = whole.get(args.command) or {}
    logging.basicConfig(level=logging.DEBUG if args.verbose or whole.get("verbose") or config.get("verbose") else logging.WARNING, stream=sys.stderr)
    path = args.input or config.get("input")
    if not path:
        log.error("--input is missing")
        return 1
    from pyspark.sql import SparkSession

    from relgen.sources.ddl import ParseError, parse_file
    from relgen.sources.model import SchemaError

    spark = SparkSession.builder.appName("relgen").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        model = parse_file(path)
        return _generate(spark, model, args, config) if args.command == "generate" else _inspect(spark, model, args, config)
    except (ParseError, SchemaError, ValueError) as e:
        log.error("%s", e)
        return 1


def _serve(args) -> int:
    from pyspark.sql import SparkSession

    from relgen.server import server

    logging.basicConfig(level=logging.INFO, stream=sys.stderr)
    spark = SparkSession.builder.appName("relgen").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    running = server(spark, args.port, args.job_file, host=args.host)
    try:
        running.serve_forever()
    except KeyboardInterrupt:
        running.server_close()
    return 0


def _generate(spark, model, args, config: dict) -> int:
    from relgen.operators import sinks
    from relgen.operators.generate import generate
    from relgen.operators.validate import violations

    pick = lambda given, name, default: given if given is not None else config.get(name, default)
    rows, seed, kind = pick(args.rows, "rows", 10), pick(args.seed, "seed", 42), pick(args.format, "format", "sql")
    if not 0 <= rows <= MAX_ROWS:
        raise ValueError(f"rows must be between 0 and {MAX_ROWS}")
    data = generate(spark, model, rows, seed, progress=lambda t, i, n: log.info("%s (%d/%d)", t, i, n))
    for table, message in data.errors:
        log.error("%s: %s", table, message)
    if bad := violations(data.tables, model).limit(20).collect():
        for v in bad:
            log.error("%s: %s", v["table"], v["message"])
        return 1
    output = pick(args.output, "output", None)
    if kind == "parquet":
        sinks.write(data.tables, output or "relgen-out")
        return 0
    text = sinks.sql_text(data.tables, model, args.schema) if kind == "sql" else sinks.csv_text(data.tables)
    if output:
        sinks.save(text, output)
    else:
        sys.stdout.writelines(text)
    return 0


def catalog_semantics(cat):
    """(table, ord, column, semantic) of the columns whose name has a meaning."""
    from pyspark.sql import functions as F

    from relgen.functions.semantics import column_semantic

    return cat["columns"].select("table", "ord", "column", column_semantic(F.col("column")).alias("semantic")).where("semantic is not null")


def _inspect(spark, model, args, config: dict) -> int:
    from relgen.plans import graph
    from relgen.sources.model import catalog
    from relgen.sources.types import display_type

    for t in model.tables:
        print(f"{t.name}: {len(t.columns)} columns, {len(t.foreign_keys)} foreign keys, {len(t.unique)} unique, {len(t.checks)} checks")
        for c in t.columns:
            print(f"  {c.name} {display_type(c.type, c.length, c.scale)}{'' if c.nullable else ' not null'}{f' default {c.default}' if c.default is not None else ''}")
        if t.primary_key:
            print(f"  primary key ({', '.join(t.primary_key)})")
        for u in t.unique:
            print(f"  unique ({', '.join(u)})")
        for f in t.foreign_keys:
            print(f"  foreign key ({', '.join(f.columns)}) -> {f.ref_table}({', '.join(model.ref_columns(f))}) on delete {f.on_delete.lower()} on update {f.on_update.lower()}")
        for c in t.checks:
            print(f"  check {c.expression}")
    for e in model.enums:
        print(f"enum {e.name}: {', '.join(e.values)}")
    print(f"{len(model.tables)} tables, {len(model.enums)} enums")
    cat = catalog(spark, model)
    if args.graph or config.get("graph"):
        for name, df in (("nodes", graph.nodes(cat)), ("edges", graph.edges(cat))):
            for r in df.groupBy("kind").count().orderBy("kind").collect():
                print(f"{name} {r['kind']}: {r['count']}")
    if args.semantic or config.get("semantic"):
        for r in graph.table_roles(cat).orderBy("table", "role").collect():
            print(f"{r['table']}: {r['role']} {r['score'] / 100:.2f}")
            for line in r["evidence"]:
                print(f"  {line}")
        for r in graph.relationship_kinds(cat).orderBy("table", "ref_table", "columns").collect():
            print(f"{r['table']}({', '.join(r['columns'])}) -> {r['ref_table']}: {r['kind']}")
        for r in catalog_semantics(cat).orderBy("table", "ord").collect():
            print(f"{r['table']}.{r['column']}: {r['semantic']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
