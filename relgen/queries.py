"""The registered queries over the driver's star schema, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgen import jobs, library, star
from relgen.functions.formatting import fingerprint, second
from relgen.functions.generators import DOMAINS, FIRST, LAST, PLACES, Registry
from relgen.functions.rng import below
from relgen.functions.semantics import column_semantic, tokens
from relgen.operators import admission, sinks
from relgen.operators.generate import Generator, backfilled, extended
from relgen.operators.profile import profile
from relgen.operators.profile_state import merged, profile_of, profile_state
from relgen.operators.validate import duplicates, enum, held, length, not_null, orphans, reference_counts, report, summary
from relgen.plans import graph
from relgen.plans.planner import build_plan
from relgen.sources.ddl import parse
from relgen.sources.delimited import from_csv
from relgen.sources.model import Model, catalog
from relgen.steps import shared_dir, written
from relgen.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
SHOP = """
CREATE TYPE mood AS ENUM ('sad', 'ok', 'happy');
CREATE TABLE users (id BIGINT PRIMARY KEY, score INT, mood mood, active BOOLEAN);
CREATE TABLE items (id BIGINT PRIMARY KEY, price DECIMAL(10,2) NOT NULL);
CREATE TABLE orders (id BIGINT PRIMARY KEY, user_id BIGINT NOT NULL REFERENCES users(id), gift_for BIGINT REFERENCES users(id));
CREATE TABLE likes (user_id BIGINT REFERENCES users(id), item_id BIGINT REFERENCES items(id), PRIMARY KEY (user_id, item_id));
CREATE TABLE staff (id BIGINT PRIMARY KEY, boss_id BIGINT REFERENCES staff(id), created_at TIMESTAMP);
CREATE TABLE people (id BIGINT PRIMARY KEY, first_name TEXT, last_name TEXT, city TEXT, state TEXT, zip TEXT, email TEXT, phone TEXT, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP, deleted_at TIMESTAMP, ip INET, mac MACADDR, token UUID);
"""
#: The given tables that the generated ones are as long as.
LIKE = {"users": "customer", "items": "part", "orders": "orders", "likes": "lineitem", "staff": "supplier", "people": "events"}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cat(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The catalog of those declarations that the given rows keep."""
    return catalog(spark, held(star.tables(spark, sf_dir), star.model()))


def _shop(spark: SparkSession, sf_dir: str) -> Generator:
    """A generator of tables that are as long as given ones; links are at most half of all pairs."""
    rows = {t: _t(spark, sf_dir, given).count() for t, given in LIKE.items()}
    rows["likes"] = min(rows["likes"], rows["users"] * rows["items"] // 2)
    return Generator(parse(SHOP), rows)


def _made(table: str) -> Query:
    return lambda spark, sf_dir: _shop(spark, sf_dir).table(spark, table)


def fk_integrity_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of every foreign key of the star schema, zero counts too."""
    return reference_counts(star.tables(spark, sf_dir), star.model())


def fk_composite_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    return orphans(c.select("conv_id", (F.col("turn") + 1).alias("following")), c, ["conv_id", "following"], ["conv_id", "turn"])


def pk_duplicates_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat an order's supplier, as duplicates of a composite key."""
    rows = _t(spark, sf_dir, "lineitem").withColumn("row_index", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return duplicates("lineitem", rows, ["l_orderkey", "l_suppkey"], "PK_UNIQUE").select("row_index", "value", "rule", "message")


def unique_part_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").withColumn("row_index", F.col("p_partkey"))
    return duplicates("part", rows, ["p_name"], "UNIQUE").select("row_index", "value", "message")


def _enum(table: str, column: str, values: list[str], key: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _t(spark, sf_dir, table).withColumn("row_index", F.col(key))
        return enum(table, rows, column, "narrow", values).select("row_index", "value", "rule")

    return run


def profile_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored profiles of two parts of the events, the later one appended, as one."""
    events, columns = _t(spark, sf_dir, "events"), ["event_id", "user_id", "event_type", "props"]
    later = F.col("event_id") % 3 == 1
    states = [written(profile_state(events.where(part), columns, "event_id"), "profile-state") for part in (~later, later)]
    return profile_of(merged(*states)).withColumn("samples", F.array_join("samples", "|"))


def _profile(table: str, columns: list[str], order_by: str) -> Query:
    return lambda spark, sf_dir: profile(_t(spark, sf_dir, table), columns, order_by).withColumn("samples", F.array_join("samples", "|"))


def not_null_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label, as a column that may not be null; and a column that the data lacks."""
    table = parse("CREATE TABLE labelled (doc_id BIGINT NOT NULL, quality INT NOT NULL, lacking INT NOT NULL);").tables[0]
    rows = _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("doc_id").alias("row_index"), "doc_id", "quality")
    return not_null(table, rows).select("column", "row_index", "message")


def export_csv_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles as CSV fields, with all their digits."""
    rows = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_index"), "l_quantity", "l_discount", (F.col("l_tax") / 8).alias("share"))
    return sinks.csv_rows(rows)


def export_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of one CSV file that holds all of lineitem under a header."""
    rows = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_index"), "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    path = f"{shared_dir(spark)}/relgen-{uuid.uuid4().hex}.csv"
    sinks.one_file(spark, sinks.csv_segments({"lineitem": rows}), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported lines read back, with commas and quotation marks in them."""
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_index"), F.concat(F.lit("a, "), "p_name").alias("name"), "p_brand", "p_size")
    return from_csv(sinks.csv_rows(rows), ["name", "brand", "size", "more"])


def catalog_columns_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = _cat(spark, sf_dir)["columns"]
    return columns.select("table", "column", column_semantic(F.col("column")).alias("semantic"), F.array_join(tokens(F.col("column")), " ").alias("words"))


def gen_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made("people")(spark, sf_dir).select("row_index", *(second(F.col(c)).alias(c) for c in ("created_at", "updated_at", "deleted_at")))


def _columns(*names: str) -> Query:
    return lambda spark, sf_dir: _made("people")(spark, sf_dir).select("row_index", *names)


EXTENDED = """
CREATE TYPE segment AS ENUM ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY');
CREATE TABLE nation (n_nationkey INT PRIMARY KEY);
CREATE TABLE customer (c_custkey BIGINT PRIMARY KEY, c_nationkey INT NOT NULL REFERENCES nation(n_nationkey), c_mktsegment segment, c_acctbal NUMERIC(7,2), host INET UNIQUE, opens TIME, rate REAL UNIQUE, tag JSONB UNIQUE, desk TEXT UNIQUE, UNIQUE (c_mktsegment, c_acctbal), UNIQUE (c_nationkey, c_mktsegment, opens));
"""


def unique_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` made twice as large: how many of the new rows have a key of their own, of the declared kind, that no given row has.

    ``desk`` has a registered generator with few values more than there are rows.
    """
    given = _t(spark, sf_dir, "customer")
    n = given.count()
    # given hosts, times, rates and tags follow from the key, so that new ones can meet them
    nulls = {"host": F.concat_ws(".", F.lit("10"), *(F.floor(F.col("c_custkey") / 256**i).cast("bigint") % 256 for i in (2, 1, 0))), "opens": F.date_format(F.timestamp_seconds(F.col("c_custkey") % 86400), "HH:mm:ss"), "rate": F.col("c_custkey").cast("float"), "tag": F.concat(F.lit('{"id":'), "c_custkey", F.lit("}")), "desk": F.concat(F.lit("D"), F.col("c_custkey") % F.lit(4 * n))}
    registry = Registry()
    registry.register("text", lambda c: F.concat(F.lit("D"), below(c.u(), 4 * n).cast("string")))
    model = parse(EXTENDED)
    new = extended({"customer": given.withColumns(nulls), "nation": _t(spark, sf_dir, "nation")}, model, "customer", n, registry=registry)
    new = written(new, "extended")
    both = new.select("*", F.lit(True).alias("new")).drop("row_index").unionByName(given.withColumns(nulls).select(*(c.name for c in model.table("customer").columns), F.lit(False).alias("new")))
    ip = "^([0-9]{1,3}[.]){3}[0-9]{1,3}$"
    kinds = {"c_custkey": "c_custkey > 0", "host": f"host rlike '{ip}'", "rate": "rate >= 0 and rate < 10000", "tag": "tag rlike '^[{].*[}]$'", "desk": "desk rlike '^D[0-9]+$'", "c_mktsegment,c_acctbal": "c_mktsegment in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')", "c_nationkey,c_mktsegment,opens": "c_nationkey between 0 and 24 and opens rlike '^[0-2][0-9]:[0-5][0-9]:[0-5][0-9]$'"}
    out = None
    for key, kind in kinds.items():
        columns = key.split(",")
        kept = both.groupBy(*columns).agg(F.sum(F.col("new").cast("int")).alias("n"), F.max((~F.col("new")).cast("int")).alias("old"), F.bool_and(F.expr(kind)).alias("good"))
        row = kept.where("n > 0").agg(F.sum("n").alias("n_rows"), F.count(F.when(F.col("n") == 1, True)).alias("n_unique"), F.sum("old").cast("bigint").alias("n_given"), F.count(F.when(F.col("good"), True)).alias("n_of_kind")).select(F.lit(key).alias("key"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def keys_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments, two for each order on average, whose keys are drawn from the given orders."""
    model = parse("CREATE TABLE orders (o_orderkey BIGINT PRIMARY KEY); CREATE TABLE shipment (id BIGINT PRIMARY KEY, order_key BIGINT NOT NULL REFERENCES orders(o_orderkey), back_order BIGINT REFERENCES orders(o_orderkey));")
    orders = _t(spark, sf_dir, "orders").select("o_orderkey")
    none = spark.createDataFrame([], "id bigint, order_key bigint, back_order bigint")
    return extended({"orders": orders, "shipment": none}, model, "shipment", 2 * orders.count()).select("id", "order_key", "back_order")


def backfilled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without a user get one of the given customers."""
    rows = _t(spark, sf_dir, "events").select(F.col("event_id").alias("row_index"), "event_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("user_id"))
    return backfilled(rows, star.model().table("events"), "user_id", _t(spark, sf_dir, "customer"), "c_custkey").select("event_id", "user_id")


def backfilled_earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that follow an earlier order: where none is named, any of the earlier ones; the first follows none."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_index"), "o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey")).alias("follows"))
    table = parse("CREATE TABLE orders (o_orderkey BIGINT PRIMARY KEY, follows BIGINT REFERENCES orders(o_orderkey));").tables[0]
    return backfilled(orders, table, "follows", orders, "o_orderkey").select("o_orderkey", "follows")


def violations_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All violations of the star schema in the order of a report, with their place."""
    tables = star.tables(spark, sf_dir)
    key = {"lineitem": F.col("l_orderkey") * 100 + F.col("l_linenumber")}
    rows = {n: d.withColumn("row_index", key.get(n, F.col(d.columns[0]))) for n, d in tables.items()}
    return report(rows, star.model()).select("table", "rule", "column", "row_index", "value", "message")


def plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planner's order of the star schema's tables."""
    model = held(star.tables(spark, sf_dir), star.model())
    return spark.createDataFrame(list(enumerate(build_plan(model, 10).order)), "ord int, `table` string")


def generated_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of the generated tables: no row violates any."""
    g = _shop(spark, sf_dir)
    return summary({t.name: g.table(spark, t.name) for t in g.model.tables}, g.model)


def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(_cat(spark, sf_dir))


def export_lines(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _t(spark, sf_dir, "nation").withColumn("row_index", F.col("n_nationkey"))
        return (sinks.sql_rows if kind == "sql" else sinks.csv_rows)(rows)

    return run


def preview_sql_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preview of an export: its first ten lines."""
    return export_lines("sql")(spark, sf_dir).orderBy("row_index").limit(10)


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.rate_limited(_t(spark, sf_dir, "events"), "event_type", "ts", 3, "1 hour").select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


#: Events of a user that are let in, in windows that begin with the user's first event.
LIMIT, WINDOW_DAYS = 2, 3


def admitted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = admission.admitted(_t(spark, sf_dir, "events"), "user_id", "ts", LIMIT, WINDOW_DAYS * 86400, ["event_id"])
    return made.select("event_id", "user_id", "allowed", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"))


def _streamed(spark: SparkSession, sf_dir: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over the files of events gives once it has read them all."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a stream takes one file by a pattern only
    path = f"{sf_dir}/events.parque[t]"
    state.prepared(spark)
    out = f"{shared_dir(spark)}/relgen-{uuid.uuid4().hex}-stream"
    # streams count time by instants
    stream = made(spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")))
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def stream_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda e: state.admitted(e, "user_id", "ts", "event_id", LIMIT, WINDOW_DAYS * 86400)).select(F.col("id").alias("event_id"), F.col("key").alias("user_id"), "allowed")


def stream_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving events of a user who has had one, as violations of a key."""
    return _streamed(spark, sf_dir, lambda e: state.repeats(e.withColumn("row_index", F.col("event_id")), "events", ["user_id"], "UNIQUE")).select("row_index", "value", "message")


def queries() -> dict[str, Query]:
    strip = lambda f: lambda spark, sf_dir: f(_cat(spark, sf_dir))
    return {
        "fk_orphans_documents_labels": lambda s, d: orphans(_t(s, d, "documents").select("doc_id"), _t(s, d, "labels"), ["doc_id"], ["doc_id"]),
        "fk_integrity_star": fk_integrity_star,
        "unique_extended": unique_extended,
        "keys_from_orders": keys_from_orders,
        "backfilled_events": backfilled_events,
        "backfilled_earlier": backfilled_earlier,
        "violations_report": violations_report,
        "fk_composite_check": fk_composite_check,
        "pk_duplicates_lineitem": pk_duplicates_lineitem,
        "unique_part_name": unique_part_name,
        "not_null_left_join": lambda s, d: _t(s, d, "documents").select("doc_id").join(_t(s, d, "labels"), "doc_id", "left").where("quality is null").select("doc_id"),
        "not_null_labels": not_null_labels,
        "export_csv_doubles": export_csv_doubles,
        "export_one_file": export_one_file,
        "csv_fields": csv_fields,
        "enum_event_type": _enum("events", "event_type", ["click", "purchase", "signup", "view"], "event_id"),
        "enum_segment": _enum("customer", "c_mktsegment", ["BUILDING", "MACHINERY"], "c_custkey"),
        "length_part_name": lambda s, d: length("part", _t(s, d, "part").withColumn("row_index", F.col("p_partkey")), "p_name", 10).select("row_index", "value", "message"),
        "violation_summary": lambda s, d: summary(star.tables(s, d), star.model()),
        "profile_orders": _profile("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "o_orderkey"),
        "profile_events": _profile("events", ["event_id", "user_id", "event_type", "props"], "event_id"),
        "profile_merged": profile_merged,
        "catalog_columns_semantic": catalog_columns_semantic,
        "graph_edges": strip(lambda c: graph.edges(c).select("src", "dst", "kind", F.array_join("local", ",").alias("local"), "cardinality")),
        "graph_node_counts": strip(lambda c: graph.nodes(c).groupBy("kind").agg(F.count("*").alias("n"))),
        "graph_edge_counts": strip(lambda c: graph.edges(c).groupBy("kind").agg(F.count("*").alias("n"))),
        "graph_degrees": strip(graph.degrees),
        "fk_cardinality": strip(lambda c: graph.cardinalities(c).select("table", F.array_join("columns", ",").alias("fk"), "cardinality")),
        "relationship_kind": strip(lambda c: graph.relationship_kinds(c).select("table", "ref_table", F.array_join("columns", ",").alias("fk"), "kind")),
        "table_roles": strip(lambda c: graph.table_roles(c).drop("evidence")),
        "topo_levels": topo_levels,
        "transitive_dependencies": strip(graph.closure),
        "graph_roots": strip(graph.roots),
        "graph_leaves": strip(graph.leaves),
        "gen_users": _made("users"),
        "gen_items_decimal": lambda s, d: _made("items")(s, d).select("row_index", "id", F.col("price").cast("string").alias("price")),
        "gen_orders_fk": _made("orders"),
        "gen_junction_pairs": _made("likes"),
        "gen_self_ref": lambda s, d: _made("staff")(s, d).select("row_index", "id", "boss_id", second(F.col("created_at")).alias("created_at")),
        "gen_temporal": gen_temporal,
        "gen_geo_name": _columns("first_name", "last_name", "city", "state", "zip"),
        "gen_contact": _columns("email", "phone"),
        "gen_network": _columns("ip", "mac", "token"),
        "generated_violations": generated_violations,
        "schema_overview": strip(graph.overview),
        "graph_junctions": strip(graph.junctions),
        "graph_isolated": strip(graph.isolated),
        "graph_search": strip(lambda c: graph.search(graph.nodes(c), graph.edges(c), "ORDER")[0].select("id", "label")),
        "graph_incident": strip(lambda c: graph.incident(graph.edges(c), "table:orders").select("src", "dst", "kind")),
        "graph_dependencies": strip(lambda c: graph.dependencies(c, "lineitem")),
        "graph_dependents": strip(lambda c: graph.dependents(c, "orders")),
        "plan_order": plan_order,
        "export_sql_values": export_lines("sql"),
        "export_csv_lines": export_lines("csv"),
        "request_fingerprint": lambda s, d: s.range(1).select(fingerprint("SELECT", 10, 42, "sql", "public").alias("key")),
        "jobs_latest": lambda s, d: _t(s, d, "events").select("event_id", "event_type").orderBy(F.desc("event_id")),
        "preview_sql_lines": preview_sql_lines,
        "role_badges": strip(graph.badges),
        "optional_references": strip(lambda c: graph.optional_references(c).select("table", "ref_table", F.array_join("columns", ",").alias("fk"))),
        "column_types": strip(graph.column_types),
        "rate_limit": rate_limit,
        "admitted_events": admitted_events,
        "stream_admitted": stream_admitted,
        "stream_repeats": stream_repeats,
    } | library.queries()


def _values(rows: list[tuple], names: str) -> str:
    def lit(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") {names}"


def _catalog_sql(m: Model) -> str:
    """Common table expressions with the catalog's rows: what is declared and what the rows keep."""
    t = _values([(i, x.name, len(x.checks)) for i, x in enumerate(m.tables)], "t(ord, tab, n_checks)")
    columns, fks, pks, unique = [], [], [], []
    for x in m.tables:
        for c in x.columns:
            nullable = "true" if c.nullable else f"EXISTS (SELECT 1 FROM {x.name} WHERE {c.name} IS NULL)"
            kind, size = f"'{c.type}'", "''" if c.length is None else f"'({c.length})'"
            if e := m.enum(c.type):
                kind = f"CASE WHEN EXISTS (SELECT 1 FROM {x.name} WHERE {c.name} NOT IN ({', '.join(repr(v) for v in e.values)})) THEN 'text' ELSE {kind} END"
            if c.length and c.type in ("varchar", "char"):
                size = f"CASE WHEN EXISTS (SELECT 1 FROM {x.name} WHERE strlen({c.name}) > {c.length}) THEN '' ELSE {size} END"
            columns.append(f"SELECT '{x.name}' AS tab, '{c.name}' AS col, {kind} AS type, {nullable} AS nullable, {size} AS size")
        for f in x.foreign_keys:
            held = f"NOT EXISTS (SELECT 1 FROM {x.name} a WHERE a.{f.columns[0]} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {f.ref_table} b WHERE b.{m.ref_columns(f)[0]} = a.{f.columns[0]}))"
            fks.append(f"SELECT '{x.name}' AS tab, '{f.columns[0]}' AS col, '{f.ref_table}' AS ref, '{f.on_delete}' AS on_delete WHERE {held}")
        once = lambda key: f"NOT EXISTS (SELECT 1 FROM {x.name} GROUP BY {', '.join(key)} HAVING count(*) > 1)"  # noqa: B023, E731
        pks += [f"SELECT '{x.name}' AS tab, '{p}' AS col WHERE {once(x.primary_key)}" for p in x.primary_key]
        unique += [f"SELECT '{x.name}' AS tab WHERE {once(u)}" for u in x.unique]
    e = _values([(x.name,) for x in m.enums], "e(enum)")
    every = lambda rows: " UNION ALL ".join(rows)
    return f"tabs AS (SELECT * FROM {t}), cols AS MATERIALIZED ({every(columns)}), fks AS MATERIALIZED ({every(fks)}), pks AS MATERIALIZED ({every(pks)}), uniques AS MATERIALIZED ({every(unique)}), enums AS (SELECT * FROM {e})"


_CARD = """card AS (SELECT f.*, CASE
  WHEN n = 1 AND EXISTS (SELECT 1 FROM pks p WHERE p.tab = f.tab AND p.col = f.col) THEN 'one_to_one'
  WHEN n > 1 AND NOT EXISTS (SELECT 1 FROM pks p WHERE p.tab = f.tab AND NOT EXISTS (SELECT 1 FROM fks g WHERE g.tab = p.tab AND g.col = p.col)) THEN 'many_to_many'
  ELSE 'one_to_many' END AS cardinality
  FROM fks f LEFT JOIN (SELECT tab, count(*) AS n FROM pks GROUP BY tab) USING (tab))"""
_EDGES = """edges AS (
  SELECT 'table:' || tab AS src, 'column:' || tab || '.' || col AS dst, 'contains' AS kind, NULL AS local, NULL AS cardinality FROM cols
  UNION ALL SELECT 'table:' || tab, 'table:' || ref, 'references', col, cardinality FROM card
  UNION ALL SELECT 'table:' || ref, 'table:' || tab, 'referenced_by', col, cardinality FROM card
  UNION ALL SELECT 'table:' || tab, 'table:' || ref, 'depends_on', col, cardinality FROM card
  UNION ALL SELECT 'column:' || tab || '.' || col, 'enum:' || type, 'uses_enum', NULL, NULL FROM cols JOIN enums ON type = enum)"""


def _u(table: str, column: str, k: str = "") -> str:
    return f"('0x' || substr(md5('42:{table}:{column}:' || i{k}), 1, 15))::BIGINT"


def _n(table: str) -> str:
    """How many rows a generated table has."""
    if table == "likes":
        return f"least((SELECT count(*) FROM {LIKE[table]}), {_n('users')} * {_n('items')} // 2)"
    return f"(SELECT count(*) FROM {LIKE[table]})"


def _perm(domain: str, salt: str, row: str = "i") -> str:
    """The same coefficients as the generator's, for a domain that is counted."""
    import hashlib

    x = int(hashlib.md5(f"42:{salt}".encode()).hexdigest()[:12], 16)
    start = f"greatest({x} % greatest(1, least({domain}, {1 << 30})), 1)"
    a = f"(SELECT min(s.a) FROM (SELECT {start} + unnest(range(1000)) AS a) s WHERE gcd(s.a, {domain}) = 1)"
    return f"(({row}::BIGINT * {a} + {x >> 7} % {domain}) % {domain})"


def oracle_sql() -> dict[str, str]:
    m = star.model()
    cat = "WITH " + _catalog_sql(m)
    rec = cat.replace("WITH ", "WITH RECURSIVE ", 1)
    fks = [(t.name, f.columns[0], f.ref_table, m.ref_columns(f)[0]) for t in m.tables for f in t.foreign_keys]
    orphan = lambda t, c, p, r: f"SELECT count(*) FROM {t} x WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.{r} = x.{c})"
    counts: dict[tuple[str, str], list[str]] = {}
    for t in m.tables:
        for c in t.columns:
            if not c.nullable:
                counts.setdefault((t.name, "NOT_NULL"), []).append(f"SELECT count(*) FROM {t.name} WHERE {c.name} IS NULL")
            if e := m.enum(c.type):
                counts.setdefault((t.name, "ENUM"), []).append(f"SELECT count(*) FROM {t.name} WHERE {c.name} NOT IN ({', '.join(repr(v) for v in e.values)})")
            if c.length and c.type in ("varchar", "char"):
                counts.setdefault((t.name, "LENGTH"), []).append(f"SELECT count(*) FROM {t.name} WHERE strlen({c.name}) > {c.length}")
        for rule, keys in (("PK_UNIQUE", [t.primary_key]), ("UNIQUE", t.unique)):
            for k in keys:
                counts.setdefault((t.name, rule), []).append(f"SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {t.name} GROUP BY {', '.join(k)})")
        for f in t.foreign_keys:
            counts.setdefault((t.name, "FK"), []).append(orphan(t.name, f.columns[0], f.ref_table, m.ref_columns(f)[0]))
    violation = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{r}' AS rule, CAST({' + '.join(f'({q})' for q in qs)} AS BIGINT) AS violations" for (t, r), qs in counts.items())

    found = []
    for t in m.tables:
        r = "l_orderkey * 100 + l_linenumber" if t.name == "lineitem" else t.columns[0].name
        row = lambda rule, column, value, message, source: found.append(f"SELECT '{t.name}' AS \"table\", '{rule}' AS rule, {column} AS \"column\", CAST(r AS BIGINT) AS row_index, CAST({value} AS VARCHAR) AS value, {message} AS message FROM {source}")  # noqa: B023, E731
        rows = f"(SELECT *, {r} AS r FROM {t.name})"
        for c in t.columns:
            if not c.nullable:
                row("NOT_NULL", f"'{c.name}'", "NULL", f"'column \"{c.name}\" is NOT NULL but row ' || r || ' has nil value'", f"{rows} WHERE {c.name} IS NULL")
            if e := m.enum(c.type):
                row("ENUM", f"'{c.name}'", c.name, f"'value \"' || {c.name} || '\" is not a valid enum value for type \"{e.name}\"'", f"{rows} WHERE {c.name} NOT IN ({', '.join(repr(v) for v in e.values)})")
            if c.length and c.type in ("varchar", "char"):
                row("LENGTH", f"'{c.name}'", c.name, f"'string length ' || strlen({c.name}) || ' exceeds column limit {c.length}'", f"{rows} WHERE strlen({c.name}) > {c.length}")
        for rule, keys in (("PK_UNIQUE", [t.primary_key]), ("UNIQUE", t.unique)):
            for k in keys:
                value = " || '::' || ".join(k)
                part = f"OVER (PARTITION BY {', '.join(k)}"
                row(rule, "NULL", value, f"'duplicate {'primary key' if rule == 'PK_UNIQUE' else 'unique value'} \"' || {value} || '\" (first seen at row ' || f || ')'", f"(SELECT *, row_number() {part} ORDER BY r) AS k, min(r) {part}) AS f FROM {rows}) WHERE k > 1")
        for f in t.foreign_keys:
            c = f.columns[0]
            row("FK", f"'{c}'", c, f"'foreign key value \"' || {c} || '\" not found in referenced table \"{f.ref_table}\" PK values'", f"{rows} x WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {f.ref_table} y WHERE y.{m.ref_columns(f)[0]} = x.{c})")

    def profiled(table: str, columns: dict[str, str], key: str) -> str:
        known = lambda c: f"trim(CAST({c} AS VARCHAR)) NOT IN ('', 'NULL', 'null')"
        samples = lambda c: f"(SELECT string_agg(trim(CAST({c} AS VARCHAR)), '|' ORDER BY {key}) FROM (SELECT {key}, {c} FROM {table} WHERE {known(c)} ORDER BY {key} LIMIT 3))"
        return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS total, count(*) FILTER (({known(c)}) IS NOT TRUE) AS nulls, count(DISTINCT {c}) FILTER ({known(c)}) AS n_distinct, '{kind}' AS type, coalesce({samples(c)}, '') AS samples FROM {table}" for c, kind in columns.items())

    from relgen.functions.semantics import semantic_of

    words = lambda n: " ".join(w for w in n.lower().split("_") if w)
    semantic = _values([(t.name, c.name, semantic_of(c.name), words(c.name)) for t in m.tables for c in t.columns], 'v("table", "column", semantic, words)')
    shop = parse(SHOP)
    checked = []
    for t in shop.tables:
        rules = {"PK_UNIQUE"} | ({"UNIQUE"} if t.unique else set()) | ({"FK"} if t.foreign_keys else set())
        for c in t.columns:
            rules |= ({"NOT_NULL"} if not c.nullable else set()) | ({"ENUM"} if shop.enum(c.type) else set()) | ({"LENGTH"} if c.length and c.type in ("varchar", "char") else set())
        checked += [(t.name, r, 0) for r in sorted(rules)]
    of = lambda values, u: f"[{', '.join(repr(v) for v in values)}][{u} % {len(values)} + 1]"
    p = lambda column, k=None: _u("people", column, "" if k is None else f" || chr(58) || {k}")
    last = f"CAST(floor({p('*name')} / 64) AS BIGINT)"
    made = f"1577836800 + i * 86400 + {p('*created')} % 86400"
    at = lambda s: f"strftime(make_timestamp(({s}) * 1000000), '%Y-%m-%d %H:%M:%S')"
    digest = f"md5(({p('mac')})::VARCHAR)"
    pair = _perm(f"({_n('users')} * {_n('items')})", "likes:user_id,item_id")
    seconds = f"1577836800 + i * 86400 + {_u('staff', '*created')} % 86400"
    admitted = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
      n AS (SELECT e.user_id, e.k, min(x.k) AS later FROM e JOIN e x ON x.user_id = e.user_id AND x.ts > e.ts + INTERVAL {WINDOW_DAYS} DAY GROUP BY ALL),
      w AS (SELECT user_id, CAST(1 AS BIGINT) AS k FROM e WHERE k = 1 UNION ALL SELECT w.user_id, n.later FROM w JOIN n ON n.user_id = w.user_id AND n.k = w.k),
      b AS (SELECT e.*, (SELECT max(k) FROM w WHERE w.user_id = e.user_id AND w.k <= e.k) AS begin FROM e),
      a AS (SELECT b.event_id, b.user_id, row_number() OVER (PARTITION BY b.user_id, begin ORDER BY b.k) AS n, e.ts AS began FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.begin)"""
    sql_lines = "SELECT n_nationkey AS row_index, '(' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''', ' || n_regionkey || ')' AS line FROM nation"
    roles = f"""{cat}, d AS (SELECT tab, (SELECT count(*) FROM cols c WHERE c.tab = t.tab) AS n, (SELECT count(*) FROM fks f WHERE f.tab = t.tab) AS o, (SELECT count(*) FROM fks f WHERE f.ref = t.tab) AS i,
          (SELECT count(*) FROM pks p WHERE p.tab = t.tab) >= 2 AND NOT EXISTS (SELECT 1 FROM pks p WHERE p.tab = t.tab AND NOT EXISTS (SELECT 1 FROM fks f WHERE f.tab = t.tab AND f.col = p.col)) AS j FROM tabs t),
          r AS (SELECT tab, 'junction' AS role, CASE WHEN j THEN 95 ELSE 0 END AS score, 1 AS least FROM d
          UNION ALL SELECT tab, 'lookup', CASE WHEN o = 0 THEN 40 ELSE 0 END + CASE WHEN i >= 2 THEN 30 ELSE 0 END + CASE WHEN n <= 6 THEN 20 ELSE 0 END + 10, 50 FROM d
          UNION ALL SELECT tab, 'transactional', CASE WHEN o >= 1 THEN 30 ELSE 0 END + CASE WHEN NOT j THEN 15 ELSE 0 END, 55 FROM d
          UNION ALL SELECT tab, 'entity', 50, 1 FROM d)"""
    return {
        "fk_orphans_documents_labels": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
        "fk_integrity_star": " UNION ALL ".join(f"SELECT '{t}' AS child, '{c}' AS fk, ({orphan(t, c, p, r)}) AS orphans" for t, c, p, r in fks),
        "unique_extended": "SELECT key, n AS n_rows, n AS n_unique, CAST(0 AS BIGINT) AS n_given, n AS n_of_kind FROM (SELECT count(*) AS n FROM customer), (VALUES ('c_custkey'), ('host'), ('rate'), ('tag'), ('desk'), ('c_mktsegment,c_acctbal'), ('c_nationkey,c_mktsegment,opens')) v(key)",
        "keys_from_orders": f"WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders), s AS (SELECT i, {_u('shipment', 'order_key')} AS a, {_u('shipment', 'back_order')} AS b, {_u('shipment', 'back_order', ' || chr(58) || 1')} AS c FROM range((SELECT 2 * count(*) FROM orders)) r(i)) SELECT i + 1 AS id, x.o_orderkey AS order_key, CASE WHEN c % 100 >= 20 THEN y.o_orderkey END AS back_order FROM s JOIN o x ON x.k = a % x.n JOIN o y ON y.k = b % y.n",
        "backfilled_events": f"WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer) SELECT event_id, CASE WHEN event_id % 7 <> 0 AND user_id IS NOT NULL THEN user_id ELSE c_custkey END AS user_id FROM (SELECT *, {_u('backfill:events', 'user_id').replace('i)', 'event_id)')} AS u FROM events) e JOIN p ON p.k = u % p.n",
        "backfilled_earlier": f"WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, {_u('backfill:orders', 'follows').replace('i)', 'o_orderkey)')} AS u FROM orders) SELECT a.o_orderkey, CASE WHEN a.o_orderkey % 5 = 0 THEN a.o_orderkey ELSE b.o_orderkey END AS follows FROM o a LEFT JOIN o b ON a.k > 0 AND b.k = a.u % greatest(a.k, 1)",
        "fk_composite_check": "SELECT conv_id, turn + 1 AS following FROM conversations a WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.turn IS NOT DISTINCT FROM a.turn + 1)",
        "pk_duplicates_lineitem": "SELECT r AS row_index, l_orderkey || '::' || l_suppkey AS value, 'PK_UNIQUE' AS rule, 'duplicate primary key \"' || l_orderkey || '::' || l_suppkey || '\" (first seen at row ' || f || ')' AS message FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY r) AS k, min(r) OVER (PARTITION BY l_orderkey, l_suppkey) AS f FROM (SELECT *, l_orderkey * 100 + l_linenumber AS r FROM lineitem)) WHERE k > 1",
        "not_null_labels": "SELECT 'quality' AS \"column\", doc_id AS row_index, 'column \"quality\" is NOT NULL but row ' || doc_id || ' has nil value' AS message FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL UNION ALL SELECT 'lacking', doc_id, 'column \"lacking\" is NOT NULL but row ' || doc_id || ' has no value' FROM documents",
        "export_csv_doubles": "SELECT l_orderkey * 100 + l_linenumber AS row_index, " + " || ',' || ".join(f"regexp_replace(CAST({x} AS VARCHAR), '[.]0$', '')" for x in ("l_quantity", "l_discount", "l_tax / 8")) + " AS line FROM lineitem",
        "export_one_file": "SELECT '\"l_orderkey\",\"l_linenumber\",\"l_quantity\",\"l_discount\",\"l_returnflag\"' AS line UNION ALL SELECT l_orderkey || ',' || l_linenumber || ',' || " + " || ',' || ".join(f"regexp_replace(CAST({x} AS VARCHAR), '[.]0$', '')" for x in ("l_quantity", "l_discount")) + " || ',\"' || l_returnflag || '\"' FROM lineitem",
        "csv_fields": "SELECT p_partkey AS row_index, 'a, ' || p_name AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS size, CAST(NULL AS VARCHAR) AS more FROM part",
        "unique_part_name": "SELECT p_partkey AS row_index, p_name AS value, 'duplicate unique value \"' || p_name || '\" (first seen at row ' || f || ')' AS message FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_name) AS f FROM part) WHERE p_partkey > f",
        "not_null_left_join": "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NULL",
        "enum_event_type": "SELECT event_id AS row_index, event_type AS value, 'ENUM' AS rule FROM events WHERE event_type NOT IN ('click', 'purchase', 'signup', 'view')",
        "enum_segment": "SELECT c_custkey AS row_index, c_mktsegment AS value, 'ENUM' AS rule FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')",
        "length_part_name": "SELECT p_partkey AS row_index, p_name AS value, 'string length ' || strlen(p_name) || ' exceeds column limit 10' AS message FROM part WHERE strlen(p_name) > 10",
        "violation_summary": violation,
        "violations_report": " UNION ALL ".join(found),
        "profile_orders": profiled("orders", {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "text", "o_orderpriority": "text"}, "o_orderkey"),
        "profile_events": profiled("events", {"event_id": "integer", "user_id": "integer", "event_type": "text", "props": "text"}, "event_id"),
        "profile_merged": profiled("events", {"event_id": "integer", "user_id": "integer", "event_type": "text", "props": "text"}, "event_id"),
        "catalog_columns_semantic": f"SELECT * FROM {semantic}",
        "graph_edges": f"{cat}, {_CARD}, {_EDGES} SELECT * FROM edges",
        "graph_node_counts": f"{cat} SELECT 'table' AS kind, count(*) AS n FROM tabs UNION ALL SELECT 'enum', count(*) FROM enums UNION ALL SELECT 'column', count(*) FROM cols",
        "graph_edge_counts": f"{cat}, {_CARD}, {_EDGES} SELECT kind, count(*) AS n FROM edges GROUP BY kind",
        "graph_degrees": f'{cat} SELECT tab AS "table", (SELECT count(*) FROM cols c WHERE c.tab = t.tab) AS n_columns, (SELECT count(*) FROM fks f WHERE f.tab = t.tab) AS n_outgoing, (SELECT count(*) FROM fks f WHERE f.ref = t.tab) AS n_incoming, (SELECT count(*) FROM fks f WHERE f.tab = t.tab AND f.ref = t.tab) AS n_self FROM tabs t',
        "fk_cardinality": f'{cat}, {_CARD} SELECT tab AS "table", col AS fk, cardinality FROM card',
        "relationship_kind": f"""{cat}, {_CARD} SELECT c.tab AS "table", c.ref AS ref_table, c.col AS fk, CASE WHEN c.tab = c.ref THEN 'hierarchy' WHEN cardinality = 'many_to_many' THEN 'many_to_many' WHEN NOT nullable AND on_delete = 'CASCADE' THEN 'composition' WHEN nullable THEN 'aggregation' ELSE 'association' END AS kind FROM card c JOIN cols x ON x.tab = c.tab AND x.col = c.col""",
        "table_roles": f"""{roles}
          SELECT tab AS "table", role, score FROM r WHERE score >= least""",
        "topo_levels": f'{rec}, l AS (SELECT tab, 0 AS level FROM tabs UNION SELECT f.tab, l.level + 1 FROM fks f JOIN l ON l.tab = f.ref) SELECT tab AS "table", max(level) AS level FROM l GROUP BY tab',
        "transitive_dependencies": f'{rec}, p AS (SELECT tab, ref, 1 AS distance FROM fks UNION SELECT p.tab, f.ref, distance + 1 FROM p JOIN fks f ON f.tab = p.ref) SELECT tab AS "table", ref AS ancestor, min(distance) AS distance FROM p GROUP BY ALL',
        "graph_roots": f'{cat} SELECT tab AS "table" FROM tabs WHERE tab NOT IN (SELECT tab FROM fks)',
        "graph_leaves": f'{cat} SELECT tab AS "table" FROM tabs WHERE tab NOT IN (SELECT ref FROM fks)',
        "gen_users": f"SELECT i AS row_index, i + 1 AS id, ({_u('users', 'score')} % 2147483647 + 1)::INTEGER AS score, ['sad', 'ok', 'happy'][{_u('users', 'mood')} % 3 + 1] AS mood, {_u('users', 'active')} % 2 = 0 AS active FROM range({_n('users')}) r(i)",
        "gen_items_decimal": f"SELECT i AS row_index, i + 1 AS id, ({_u('items', 'price')} % 99999999 + 1) || '.' || lpad(({_u('items', 'price', chr(32) + '|| chr(58) || 1')} % 100)::VARCHAR, 2, '0') AS price FROM range({_n('items')}) r(i)",
        "gen_orders_fk": f"SELECT i AS row_index, i + 1 AS id, {_u('orders', 'user_id')} % {_n('users')} + 1 AS user_id, CASE WHEN {_u('orders', 'gift_for', ' || chr(58) || 1')} % 100 >= 20 THEN {_u('orders', 'gift_for')} % {_n('users')} + 1 END AS gift_for FROM range({_n('orders')}) r(i)",
        "gen_junction_pairs": f"SELECT i AS row_index, {pair} % {_n('users')} + 1 AS user_id, {pair} // {_n('users')} + 1 AS item_id FROM range({_n('likes')}) r(i)",
        "gen_self_ref": f"SELECT i AS row_index, i + 1 AS id, CASE WHEN i > 0 THEN {_u('staff', 'boss_id')} % greatest(i, 1) + 1 END AS boss_id, strftime(make_timestamp(({seconds}) * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at FROM range({_n('staff')}) r(i)",
        "gen_temporal": f"SELECT i AS row_index, {at(made)} AS created_at, {at(made + ' + ' + p('*updated') + ' % 720 * 3600')} AS updated_at, CASE WHEN {p('deleted_at')} % 10 = 0 THEN {at(made + ' + ' + p('*deleted') + ' % 730 * 86400')} END AS deleted_at FROM range({_n('people')}) r(i)",
        "gen_geo_name": f"SELECT i AS row_index, {of(FIRST, p('*name'))} AS first_name, {of(LAST, last)} AS last_name, " + ", ".join(f"{of([x[k] for x in PLACES], p('*place'))} AS {c}" for k, c in enumerate(("city", "state", "zip"))) + f" FROM range({_n('people')}) r(i)",
        "gen_contact": f"SELECT i AS row_index, lower({of(FIRST, p('*name'))}) || ({p('email')} % 999 + 1) || '@' || {of(DOMAINS, p('email', 1))} AS email, '(' || ({p('phone')} % 800 + 200) || ') ' || lpad(({p('phone', 1)} % 1000)::VARCHAR, 3, '0') || '-' || lpad(({p('phone', 2)} % 10000)::VARCHAR, 4, '0') AS phone FROM range({_n('people')}) r(i)",
        "gen_network": f"SELECT i AS row_index, " + " || '.' || ".join(f"({p('ip', k)} % {n} + {a})" for k, (n, a) in enumerate(((223, 1), (256, 0), (256, 0), (254, 1)))) + " AS ip, " + " || ':' || ".join(f"substr({digest}, {k}, 2)" for k in range(1, 13, 2)) + f" AS mac, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', CAST({p('token')} % 4 + 1 AS INTEGER), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS token FROM (SELECT i, md5('42:people:token:' || i) AS h FROM range({_n('people')}) r(i))",
        "generated_violations": f"""SELECT tab AS "table", rule, CAST(n AS BIGINT) AS violations FROM {_values(checked, "v(tab, rule, n)")}""",
        "schema_overview": f'{cat} SELECT tab AS "table", (SELECT count(*) FROM cols c WHERE c.tab = v.tab) AS n_columns, (SELECT count(*) FROM fks f WHERE f.tab = v.tab) AS n_foreign_keys, (SELECT count(*) FROM uniques u WHERE u.tab = v.tab) AS n_unique, n_checks FROM tabs v',
        "graph_junctions": f"{cat}, {_CARD} SELECT DISTINCT tab AS \"table\" FROM card WHERE cardinality = 'many_to_many'",
        "graph_isolated": f'{cat} SELECT tab AS "table" FROM tabs WHERE tab NOT IN (SELECT tab FROM fks WHERE tab <> ref UNION SELECT ref FROM fks WHERE tab <> ref)',
        "graph_search": f"{cat} SELECT * FROM (SELECT 'table:' || tab AS id, tab AS label FROM tabs UNION ALL SELECT 'enum:' || enum, enum FROM enums UNION ALL SELECT 'column:' || tab || '.' || col, col FROM cols) WHERE lower(label) LIKE '%order%'",
        "graph_incident": f"{cat}, {_CARD}, {_EDGES} SELECT src, dst, kind FROM edges WHERE 'table:orders' IN (src, dst)",
        "graph_dependencies": f"{cat} SELECT DISTINCT ref AS \"table\" FROM fks WHERE tab = 'lineitem'",
        "graph_dependents": f"{cat} SELECT DISTINCT tab AS \"table\" FROM fks WHERE ref = 'orders'",
        "export_sql_values": sql_lines,
        "export_csv_lines": "SELECT n_nationkey AS row_index, n_nationkey || ',\"' || replace(n_name, '\"', '\"\"') || '\",' || n_regionkey AS line FROM nation",
        "request_fingerprint": "SELECT substr(sha256('SELECT|10|42|sql|public'), 1, 32) AS key",
        "jobs_latest": "SELECT event_id, event_type FROM events ORDER BY event_id DESC",
        "preview_sql_lines": f"{sql_lines} ORDER BY n_nationkey LIMIT 10",
        "role_badges": f"""{roles}, g AS (SELECT tab, bool_or(role = 'junction') AS j, bool_or(role = 'transactional') AS t, bool_or(role = 'lookup') AS l FROM r WHERE score >= least GROUP BY tab)
          SELECT tab AS "table", CASE WHEN j THEN 'junction' WHEN tab IN (SELECT tab FROM fks WHERE tab = ref) THEN 'hierarchical' WHEN t THEN 'transactional' WHEN l THEN 'lookup' ELSE 'entity' END AS badge FROM g""",
        "optional_references": f'{cat} SELECT f.tab AS "table", f.ref AS ref_table, f.col AS fk FROM fks f JOIN cols c ON c.tab = f.tab AND c.col = f.col WHERE c.nullable',
        "column_types": f'{cat} SELECT tab AS "table", col AS "column", type || size AS type FROM cols',
        "admitted_events": f"{admitted} SELECT event_id, user_id, n <= {LIMIT} AS allowed, strftime(began, '%Y-%m-%d %H:%M:%S') AS window_start FROM a",
        "stream_admitted": f"{admitted} SELECT event_id, user_id, n <= {LIMIT} AS allowed FROM a",
        "stream_repeats": "SELECT event_id AS row_index, CAST(user_id AS VARCHAR) AS value, 'duplicate unique value \"' || user_id || '\" (first seen at row ' || f || ')' AS message FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS f FROM events) WHERE event_id > f",
        "rate_limit": "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 3",
        "plan_order": "SELECT * FROM (VALUES (0, 'part'), (1, 'region'), (2, 'nation'), (3, 'customer'), (4, 'supplier'), (5, 'orders'), (6, 'events'), (7, 'lineitem')) v(ord, \"table\")",
    } | library.oracle_sql()
