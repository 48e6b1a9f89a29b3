import pytest

from relgen.functions.semantics import semantic_of
from relgen.plans import graph
from relgen.plans.planner import PlanError, build_plan, strong_components, topological_sort
from relgen.sources.ddl import ParseError, default_registry, parse
from relgen.sources.model import SchemaError, catalog, preflight

SHOP = """
-- a comment; with a semicolon
CREATE TYPE state AS ENUM ('new', 'it''s; paid');
CREATE TABLE users (id BIGSERIAL PRIMARY KEY, email VARCHAR(255) UNIQUE NOT NULL, note TEXT DEFAULT 'a -- b');
CREATE TABLE "Mixed" ("Id" SERIAL PRIMARY KEY, parent INT REFERENCES "Mixed"("Id"));
CREATE TABLE orders (id BIGINT, user_id BIGINT NOT NULL, state state DEFAULT 'new', total NUMERIC(12, 2) CHECK (total > (0)),
  at TIMESTAMP WITH TIME ZONE DEFAULT now(), tags TEXT[], PRIMARY KEY (id), UNIQUE (id), CONSTRAINT f FOREIGN KEY (user_id) REFERENCES users (id) ON DELETE CASCADE);
CREATE TABLE likes (user_id BIGINT REFERENCES users, order_id BIGINT REFERENCES orders(id), PRIMARY KEY (user_id, order_id));
"""


def test_parse():
    m = parse(SHOP)
    orders = m.table("orders")
    assert m.enum("state").values == ["new", "it's; paid"]
    assert [c.type for c in orders.columns] == ["bigint", "bigint", "state", "decimal", "timestamp", "text"]
    assert (orders.column("total").length, orders.column("total").scale) == (12, 2)
    assert orders.checks[0].expression == "total > (0)" and orders.column("tags").is_array
    assert orders.unique == [] and orders.foreign_keys[0].on_delete == "CASCADE"
    assert m.table("users").column("id").is_serial and not m.table("users").column("id").nullable
    assert m.table("users").column("note").default == "'a -- b'"
    assert m.ref_columns(m.table("likes").foreign_keys[0]) == ["id"]
    assert m.table("Mixed").columns[0].name == "Id"
    assert default_registry().names() == ["postgresql"]


@pytest.mark.parametrize("text", ["SELECT 1;", "CREATE TABLE a (b INT", "CREATE TABLE a (b INT) garbage;"])
def test_parse_errors(text):
    with pytest.raises(ParseError) as e:
        parse(text)
    assert e.value.line == 1


@pytest.mark.parametrize("text", ["CREATE TABLE a (b INT, b INT);", "CREATE TABLE a (b mood);", "CREATE TABLE a (b INT REFERENCES c(d));", "CREATE TABLE a (b INT); CREATE TABLE a (b INT);", "CREATE TABLE a (b INT, PRIMARY KEY (c));"])
def test_schema_errors(text):
    with pytest.raises(SchemaError):
        parse(text)


def test_graph(spark):
    cat = catalog(spark, parse(SHOP))
    nodes, edges = graph.nodes(cat), graph.edges(cat)
    graph.check(nodes, edges)
    assert {r["kind"]: r["n"] for r in edges.groupBy("kind").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()} == {"contains": 13, "references": 4, "referenced_by": 4, "depends_on": 4, "uses_enum": 1}
    assert {r["table"] for r in graph.junctions(cat).collect()} == {"likes"}
    kinds = {(r["table"], r["ref_table"]): r["kind"] for r in graph.relationship_kinds(cat).collect()}
    assert kinds == {("Mixed", "Mixed"): "hierarchy", ("orders", "users"): "composition", ("likes", "users"): "many_to_many", ("likes", "orders"): "many_to_many"}
    roles = {(r["table"], r["role"]) for r in graph.table_roles(cat).collect()}
    assert {("likes", "junction"), ("Mixed", "hierarchical"), ("users", "entity"), ("users", "lookup")} <= roles
    assert [r["table"] for r in graph.isolated(cat).collect()] == ["Mixed"]
    assert {(r["table"], r["ancestor"]): r["distance"] for r in graph.closure(cat).collect()}[("likes", "users")] == 1
    with pytest.raises(graph.GraphError):
        graph.check(nodes.union(nodes), edges)


def test_plan():
    assert build_plan(parse(SHOP), 5).order == ["users", "orders", "likes", "Mixed"]
    assert topological_sort(["b", "a", "c"], [("c", "a")]) == (["a", "b", "c"], [])
    assert sorted(map(sorted, strong_components(["a", "b", "c"], [("a", "b"), ("b", "a"), ("c", "a")]))) == [["a", "b"], ["c"]]
    cycle = "CREATE TABLE a (id INT PRIMARY KEY, b INT {} REFERENCES b(id)); CREATE TABLE b (id INT PRIMARY KEY, a INT NOT NULL REFERENCES a(id));"
    assert build_plan(parse(cycle.format("")), 1).deferred[0][0] == "a"
    with pytest.raises(PlanError):
        build_plan(parse(cycle.format("NOT NULL")), 1)
    chain = [f"t{i}" for i in range(3000)]
    assert len(strong_components(chain, list(zip(chain[1:], chain[:-1], strict=True)))) == 3000


@pytest.mark.parametrize(("name", "meaning"), [("first_name", "first_name"), ("products_name", "full_name"), ("country_code", "country"), ("email_address", "email"), ("status_code", "code"), ("shipping-city", "city"), ("EMAIL", None), ("comments", None)])
def test_semantics(spark, name, meaning):
    from pyspark.sql import functions as F

    from relgen.functions.semantics import column_semantic

    assert semantic_of(name) == meaning
    assert spark.range(1).select(column_semantic(F.lit(name))).first()[0] == meaning


def test_preflight():
    m = parse("CREATE TABLE a (b INT);")
    m.tables[0].unique = [["x"]]
    m.tables[0].primary_key = ["y"]
    assert len(preflight(m)) == 2
