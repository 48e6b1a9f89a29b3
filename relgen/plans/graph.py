"""The schema graph and its analytics as DataFrames over the catalog."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE_KINDS = ("contains", "references", "referenced_by", "depends_on", "uses_enum")


class GraphError(ValueError):
    """A graph with duplicate nodes or edges, or edges without an end."""


def nodes(cat: dict[str, DataFrame]) -> DataFrame:
    """(id, kind, label): tables, then enums, then columns."""
    tables = cat["tables"].select(F.concat(F.lit("table:"), "table").alias("id"), F.lit("table").alias("kind"), F.col("table").alias("label"))
    enums = cat["enums"].select("enum").distinct().select(F.concat(F.lit("enum:"), "enum").alias("id"), F.lit("enum").alias("kind"), F.col("enum").alias("label"))
    columns = cat["columns"].select(F.concat(F.lit("column:"), "table", F.lit("."), "column").alias("id"), F.lit("column").alias("kind"), F.col("column").alias("label"))
    return tables.unionByName(enums).unionByName(columns)


def cardinalities(cat: dict[str, DataFrame]) -> DataFrame:
    """fks with cardinality: one_to_one where the columns are the child's key, many_to_many where the key is composite and all foreign, else one_to_many."""
    keys = cat["keys"].where("kind = 'primary'").select("table", F.col("columns").alias("pk"))
    owned = cat["fks"].select("table", F.explode("columns").alias("c")).groupBy("table").agg(F.collect_set("c").alias("foreign"))
    rows = cat["fks"].join(keys, "table", "left").join(owned, "table")
    inside = lambda a, b: F.size(F.array_except(a, b)) == 0
    one = (F.size("columns") == F.size("pk")) & inside("columns", "pk")
    many = (F.size("pk") > 1) & inside("pk", "foreign")
    kind = F.when(one, "one_to_one").when(many, "many_to_many").otherwise("one_to_many")
    return rows.select("table", "ord", "columns", "ref_table", "ref_columns", "on_delete", "on_update", kind.alias("cardinality"))


def edges(cat: dict[str, DataFrame]) -> DataFrame:
    """(src, dst, kind, local, cardinality)."""
    none, empty = F.lit(None).cast("string"), F.expr("cast(null as array<string>)")
    contains = cat["columns"].select(F.concat(F.lit("table:"), "table").alias("src"), F.concat(F.lit("column:"), "table", F.lit("."), "column").alias("dst"), F.lit("contains").alias("kind"), empty.alias("local"), none.alias("cardinality"))
    child, parent = F.concat(F.lit("table:"), "table"), F.concat(F.lit("table:"), "ref_table")
    three = F.array(
        F.struct(child.alias("src"), parent.alias("dst"), F.lit("references").alias("kind")),
        F.struct(parent.alias("src"), child.alias("dst"), F.lit("referenced_by").alias("kind")),
        F.struct(child.alias("src"), parent.alias("dst"), F.lit("depends_on").alias("kind")),
    )
    foreign = cardinalities(cat).select(F.explode(three).alias("e"), F.col("columns").alias("local"), "cardinality").select("e.*", "local", "cardinality")
    enums = cat["enums"].select(F.col("enum").alias("type")).distinct()
    uses = cat["columns"].join(F.broadcast(enums), "type").select(F.concat(F.lit("column:"), "table", F.lit("."), "column").alias("src"), F.concat(F.lit("enum:"), "type").alias("dst"), F.lit("uses_enum").alias("kind"), empty.alias("local"), none.alias("cardinality"))
    return contains.unionByName(foreign).unionByName(uses)


def check(nodes: DataFrame, edges: DataFrame) -> None:
    """Raises the first fault of a graph."""
    if row := nodes.groupBy("id").count().where("count > 1").first():
        raise GraphError(f"duplicate node {row['id']}")
    ids = nodes.select("id")
    for end in ("src", "dst"):
        if row := edges.join(ids, edges[end] == ids["id"], "left_anti").first():
            raise GraphError(f"edge without {end}: {row['src']} -> {row['dst']}")
    key = F.when(F.col("kind").isin("contains", "uses_enum"), F.expr("cast(null as array<string>)")).otherwise(F.col("local"))
    if row := edges.groupBy("src", "dst", "kind", key.alias("local")).count().where("count > 1").first():
        raise GraphError(f"duplicate edge {row['src']} -> {row['dst']}")


def degrees(cat: dict[str, DataFrame]) -> DataFrame:
    """(table, n_columns, n_outgoing, n_incoming, n_self)."""
    columns = cat["columns"].groupBy("table").agg(F.count("*").alias("n_columns"))
    out = cat["fks"].groupBy("table").agg(F.count("*").alias("n_outgoing"), F.sum((F.col("table") == F.col("ref_table")).cast("bigint")).alias("n_self"))
    into = cat["fks"].groupBy(F.col("ref_table").alias("table")).agg(F.count("*").alias("n_incoming"))
    joined = cat["tables"].select("table").join(columns, "table", "left").join(out, "table", "left").join(into, "table", "left")
    return joined.select("table", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_columns", "n_outgoing", "n_incoming", "n_self")))


def roots(cat: dict[str, DataFrame]) -> DataFrame:
    """Tables that depend on no other."""
    other = cat["fks"].where("table <> ref_table").select("table").distinct()
    return cat["tables"].select("table").join(other, "table", "left_anti")


def leaves(cat: dict[str, DataFrame]) -> DataFrame:
    """Tables on which no other depends."""
    other = cat["fks"].where("table <> ref_table").select(F.col("ref_table").alias("table")).distinct()
    return cat["tables"].select("table").join(other, "table", "left_anti")


def isolated(cat: dict[str, DataFrame]) -> DataFrame:
    return roots(cat).join(leaves(cat), "table", "left_semi")


def dependencies(cat: dict[str, DataFrame], table: str) -> DataFrame:
    return cat["fks"].where(F.col("table") == table).select(F.col("ref_table").alias("table")).distinct()


def dependents(cat: dict[str, DataFrame], table: str) -> DataFrame:
    return cat["fks"].where(F.col("ref_table") == table).select("table").distinct()


def closure(cat: dict[str, DataFrame], limit: int = 10_000) -> DataFrame:
    """(table, ancestor, distance): all transitive dependencies with the shortest distance.

    Joins double the known distance in each round, and rounds end when nothing is added; the catalog is
    small, so the rounds run on the driver's plan and not on data.
    """
    paths = cat["fks"].select("table", F.col("ref_table").alias("ancestor")).distinct().withColumn("distance", F.lit(1))
    n = paths.count()
    for _ in range(limit):
        right = paths.select(F.col("table").alias("ancestor"), F.col("ancestor").alias("far"), F.col("distance").alias("d"))
        longer = paths.join(right, "ancestor").select("table", F.col("far").alias("ancestor"), (F.col("distance") + F.col("d")).alias("distance"))
        rows = paths.unionByName(longer).groupBy("table", "ancestor").agg(F.min("distance").alias("distance")).collect()
        paths = cat["fks"].sparkSession.createDataFrame(rows, "table string, ancestor string, distance int")
        if len(rows) == n:
            break
        n = len(rows)
    return paths


def levels(cat: dict[str, DataFrame]) -> DataFrame:
    """(table, level): the longest chain of dependencies below each table of an acyclic schema; tables on a cycle are left out."""
    rows = {(r["table"], r["ref_table"]) for r in cat["fks"].select("table", "ref_table").collect() if r["table"] != r["ref_table"]}
    level = {r["table"]: 0 if not any(a == r["table"] for a, _ in rows) else None for r in cat["tables"].select("table").collect()}
    changed = True
    while changed:
        changed = False
        for t in [t for t, v in level.items() if v is None]:
            below = [level.get(b) for a, b in rows if a == t]
            if all(v is not None for v in below):
                level[t], changed = 1 + max(below), True
    return cat["fks"].sparkSession.createDataFrame([(t, v) for t, v in level.items() if v is not None], "table string, level int")


def search(nodes: DataFrame, edges: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Nodes whose label holds ``text``, whatever the case, and edges between them."""
    kept = nodes.where(F.contains(F.lower("label"), F.lit(text.lower())))
    ids = kept.select("id")
    return kept, edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")


def incident(edges: DataFrame, node: str) -> DataFrame:
    return edges.where((F.col("src") == node) | (F.col("dst") == node))


def overview(cat: dict[str, DataFrame]) -> DataFrame:
    """(table, n_columns, n_foreign_keys, n_unique, n_checks)."""
    part = lambda kind, rows: rows.select("table", F.lit(kind).alias("kind"))
    kinds = {"columns": cat["columns"], "foreign_keys": cat["fks"], "unique": cat["keys"].where("kind = 'unique'"), "checks": cat["checks"]}
    found = part("", cat["tables"])
    for kind, rows in kinds.items():
        found = found.unionByName(part(kind, rows))
    return found.groupBy("table").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds))


def junctions(cat: dict[str, DataFrame]) -> DataFrame:
    return cardinalities(cat).where("cardinality = 'many_to_many'").select("table").distinct()


def relationship_kinds(cat: dict[str, DataFrame]) -> DataFrame:
    """(table, ref_table, columns, kind): hierarchy, many_to_many, composition, aggregation or association."""
    nullable = cat["columns"].select("table", F.col("column").alias("c"), "nullable")
    local = cardinalities(cat).select("*", F.explode("columns").alias("c")).join(nullable, ["table", "c"]).groupBy("table", "ord").agg(F.bool_or("nullable").alias("optional"))
    rows = cardinalities(cat).join(local, ["table", "ord"])
    kind = F.when(F.col("table") == F.col("ref_table"), "hierarchy").when(F.col("cardinality") == "many_to_many", "many_to_many").when(~F.col("optional") & (F.col("on_delete") == "CASCADE"), "composition").when(F.col("optional"), "aggregation").otherwise("association")
    return rows.select("table", "ref_table", "columns", kind.alias("kind"))


@dataclass(frozen=True)
class Rule:
    """How a role is inferred: parts that each add to the score where they hold, with their evidence.

    ``parts``: functions of the facts of ``table_facts`` that give (condition, hundredths, evidence); a
    condition or an evidence may be a Column.  The role is given from ``least`` hundredths on; ``extra``
    gives more evidence as an array.
    """

    role: str
    parts: tuple[Callable[[], tuple[Column, int, Column]], ...]
    least: int = 1
    extra: Callable[[], Column] | None = None


def _part(condition: str, score: int, evidence: str) -> Callable[[], tuple[Column, int, Column]]:
    """``evidence`` with {facts} in braces."""

    def made() -> tuple[Column, int, Column]:
        pieces = re.split(r"\{(\w+)\}", evidence)
        return F.expr(condition), score, F.concat(*(F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(pieces)))

    return made


# fixed values: roles, their conditions, confidence in hundredths and evidence
RULES = (
    Rule("junction", (_part("junction", 95, "composite primary key has {n_pk} columns, all of which are foreign keys"),), extra=lambda: F.transform("pk", lambda c: F.concat(F.lit('primary key column "'), c, F.lit('" is also a foreign key column')))),
    Rule("hierarchical", (_part("n_self > 0", 95, "table has {n_self} self-referencing foreign key(s), forming a hierarchical structure"),)),
    Rule("lookup", (_part("n_outgoing = 0", 40, "has no outgoing foreign keys (does not depend on other tables)"), _part("n_incoming >= 2", 30, "referenced by {n_incoming} other tables (frequently used reference)"), _part("n_columns <= 6", 20, "has only {n_columns} column(s) — small, focused table"), _part("created_at = 0 and updated_at = 0", 10, "has no temporal tracking columns (stable, infrequently modified)")), 50),
    Rule("transactional", (_part("created_at = 1", 40, 'has a "created_at" column indicating event timestamping'), _part("n_outgoing >= 1", 30, "has {n_outgoing} outgoing foreign key(s) referencing domain entities"), _part("updated_at = 1", 15, 'has an "updated_at" column indicating lifecycle tracking'), _part("not junction", 15, "is not a junction table — has an independent identity")), 55),
    Rule("entity", (_part("true", 50, "every table is a domain entity by default"),)),
    Rule("temporal", tuple(_part(f"{n} = 1", s, f"has {n}") for n, s in (("created_at", 100), ("updated_at", 100), ("deleted_at", 100)))),
    Rule("soft_delete", (_part("deleted_at = 1", 100, "has deleted_at"),)),
    Rule("audit", tuple(_part(f"{n} = 1", 100, f"has {n}") for n in ("created_by", "updated_by", "deleted_by"))),
)


def table_facts(cat: dict[str, DataFrame]) -> DataFrame:
    """What rules may ask: degrees, pk, n_pk, junction, and 0 or 1 for each name of a moment or an author."""
    named = lambda n: F.max((F.lower("column") == n).cast("int")).alias(n)
    names = ("created_at", "updated_at", "deleted_at", "created_by", "updated_by", "deleted_by")
    flags = cat["columns"].groupBy("table").agg(*map(named, names))
    pk = cat["keys"].where("kind = 'primary'").select("table", F.col("columns").alias("pk"))
    foreign = cat["fks"].select("table", F.explode("columns").alias("c")).groupBy("table").agg(F.collect_set("c").alias("foreign"))
    rows = degrees(cat).join(flags, "table").join(pk, "table", "left").join(foreign, "table", "left")
    junction = F.coalesce((F.size("pk") >= 2) & (F.size(F.array_except("pk", F.coalesce("foreign", F.expr("cast(array() as array<string>)")))) == 0), F.lit(False))
    return rows.withColumns({"junction": junction, "n_pk": F.size("pk")})


def table_roles(cat: dict[str, DataFrame], rules: Sequence[Rule] = RULES) -> DataFrame:
    """(table, role, score, evidence): roles with a confidence in hundredths, 100 at most, and what speaks for each."""
    found = []
    for rule in rules:
        parts = [p() for p in rule.parts]
        score = F.least(F.lit(100), sum((F.when(c, n).otherwise(0) for c, n, _ in parts), F.lit(0)))
        said = F.filter(F.array(*(F.when(c, e) for c, _, e in parts)), lambda x: x.isNotNull())
        if rule.extra:
            said = F.concat(F.coalesce(rule.extra(), F.expr("cast(array() as array<string>)")), said)
        found.append(F.struct(F.lit(rule.role).alias("role"), score.alias("score"), F.lit(rule.least).alias("least"), said.alias("evidence")))
    return table_facts(cat).select("table", F.explode(F.array(*found)).alias("s")).where("s.score >= s.least").select("table", "s.role", "s.score", "s.evidence")


def badges(cat: dict[str, DataFrame]) -> DataFrame:
    """(table, badge): the one role that a table is shown under, the most telling first."""
    order = ("junction", "hierarchical", "transactional", "lookup")
    roles = table_roles(cat).groupBy("table").agg(F.collect_set("role").alias("roles"))
    badge = F.coalesce(*(F.when(F.array_contains("roles", r), r) for r in order), F.lit("entity"))
    return roles.select("table", badge.alias("badge"))


def optional_references(cat: dict[str, DataFrame]) -> DataFrame:
    """(table, ref_table, columns): foreign keys all of whose columns may be null, where a cycle can be opened."""
    nullable = cat["columns"].select("table", F.col("column").alias("c"), "nullable")
    local = cat["fks"].select("*", F.explode("columns").alias("c")).join(nullable, ["table", "c"])
    rows = local.groupBy("table", "ord", "ref_table", "columns").agg(F.bool_and("nullable").alias("optional"))
    return rows.where("optional").select("table", "ref_table", "columns")


def column_types(cat: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type): types as they are shown, with length and scale."""
    size = F.when(F.col("scale").isNotNull(), F.format_string("(%d,%d)", "length", "scale")).when(F.col("length").isNotNull(), F.format_string("(%d)", "length")).otherwise("")
    return cat["columns"].select("table", "column", F.concat("type", size).alias("type"))
