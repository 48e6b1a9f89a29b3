"""A second schema: self references, a junction, composite and nullable keys, a cycle, enums, capitals in names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgen.functions.semantics import column_semantic, tokens
from relgen.operators.generate import Generator
from relgen.operators.validate import summary, violations
from relgen.plans import graph
from relgen.plans.planner import build_plan
from relgen.sources.ddl import parse
from relgen.sources.model import Column, ForeignKey, Model, Table, catalog, preflight

DDL = """
CREATE TYPE loan_state AS ENUM ('open', 'late', 'closed');
CREATE TABLE branch (id INT PRIMARY KEY, city VARCHAR(40) NOT NULL UNIQUE, "zipCode" CHAR(5), manager_id INT REFERENCES staff(id));
CREATE TABLE staff (id SERIAL PRIMARY KEY, branch_id INT NOT NULL REFERENCES branch(id), email_address TEXT);
CREATE TABLE genre (id INT PRIMARY KEY, label VARCHAR(30) NOT NULL, parent_id INT REFERENCES genre(id));
CREATE TABLE member (id BIGSERIAL PRIMARY KEY, "firstName" TEXT NOT NULL, "lastName" TEXT, mail VARCHAR(80) UNIQUE, sponsor BIGINT REFERENCES member(id), home_branch INT REFERENCES branch(id), created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP, deleted_at TIMESTAMP, created_by TEXT);
CREATE TABLE title (id BIGINT PRIMARY KEY, "bookTitle" VARCHAR(200) NOT NULL, price NUMERIC(8,2) CHECK (price >= 0), website TEXT, UNIQUE ("bookTitle", price));
CREATE TABLE title_genre (title_id BIGINT REFERENCES title(id), genre_id INT REFERENCES genre(id), PRIMARY KEY (title_id, genre_id));
CREATE TABLE copy (title_id BIGINT NOT NULL REFERENCES title(id) ON DELETE CASCADE, nr INT NOT NULL, branch_id INT REFERENCES branch(id), shelf_code VARCHAR(8), PRIMARY KEY (title_id, nr));
CREATE TABLE loan (id BIGINT PRIMARY KEY, member_id BIGINT NOT NULL REFERENCES member(id), title_id BIGINT, nr INT, state loan_state NOT NULL DEFAULT 'open', created_at TIMESTAMP, updated_at TIMESTAMP, FOREIGN KEY (title_id, nr) REFERENCES copy(title_id, nr) ON DELETE CASCADE);
CREATE TABLE setting ("Key" TEXT PRIMARY KEY, "Value" TEXT);
"""
#: A model with a fault of each kind.
BROKEN = Model(
    [
        Table("a", [Column("id", "int"), Column("x", "int"), Column("x", "text")], ["id", "none"], [ForeignKey(["y"], "nowhere"), ForeignKey(["x"], "b", ["z"])], [["id", "q"]]),
        Table("b", [Column("id", "int")], ["id"]),
    ]
)
#: Tables whose rows break every rule, made from the given tables.
FAULTY = """
CREATE TYPE segment AS ENUM ('BUILDING', 'MACHINERY', 'HOUSEHOLD');
CREATE TABLE land (k INT PRIMARY KEY, region INT NOT NULL UNIQUE, "a.b" VARCHAR(6), gone INT NOT NULL);
CREATE TABLE spot (a INT, b INT, PRIMARY KEY (a, b));
CREATE TABLE buyer (id BIGINT PRIMARY KEY, land INT REFERENCES land(k), segment segment NOT NULL, a INT, b INT, FOREIGN KEY (a, b) REFERENCES spot(a, b));
"""


def model() -> Model:
    return parse(DDL)


def faulty(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return {
        "land": t("nation").select(F.col("n_nationkey").alias("row_index"), F.expr("int(n_nationkey / 2) * 2").alias("k"), F.col("n_regionkey").alias("region"), F.col("n_name").alias("a.b")),
        "spot": t("region").select(F.col("r_regionkey").alias("row_index"), F.col("r_regionkey").alias("a"), F.when(F.col("r_regionkey") > 0, 1).alias("b")),
        "buyer": t("customer").select(F.col("c_custkey").alias("row_index"), F.expr("c_custkey - c_custkey % 2").alias("id"), F.col("c_nationkey").alias("land"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).alias("segment"), (F.col("c_nationkey") % 6).cast("int").alias("a"), F.when(F.col("c_custkey") % 3 > 0, 1).alias("b")),
        "stray": t("region").select(F.col("r_regionkey").alias("row_index")),
    }


def _joined(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.array_join(c, ",").alias(c) if c in names else F.col(c) for c in df.columns))


def queries() -> dict:
    cat = lambda s: catalog(s, model())
    over = lambda f: lambda s, d: f(cat(s))
    return {
        "lib_columns": over(lambda c: c["columns"].drop("semantic")),
        "lib_semantics": over(lambda c: c["columns"].select("table", "column", column_semantic(F.col("column")).alias("semantic"), F.array_join(tokens(F.col("column")), " ").alias("words"))),
        "lib_keys": over(lambda c: _joined(c["keys"], "columns")),
        "lib_foreign_keys": over(lambda c: _joined(graph.cardinalities(c), "columns", "ref_columns")),
        "lib_enums": over(lambda c: c["enums"]),
        "lib_checks": over(lambda c: c["checks"]),
        "lib_relationships": over(lambda c: _joined(graph.relationship_kinds(c), "columns")),
        "lib_role_evidence": over(lambda c: graph.table_roles(c).select("table", "role", "score", F.array_join("evidence", "; ").alias("evidence"))),
        "lib_badges": over(graph.badges),
        "lib_junctions": over(graph.junctions),
        "lib_isolated": over(graph.isolated),
        "lib_roots": over(graph.roots),
        "lib_leaves": over(graph.leaves),
        "lib_levels": over(graph.levels),
        "lib_degrees": over(graph.degrees),
        "lib_optional": over(lambda c: _joined(graph.optional_references(c), "columns")),
        "lib_dependencies": over(lambda c: graph.closure(c).where("table = 'loan'")),
        "lib_plan_order": lambda s, d: s.createDataFrame(list(enumerate(build_plan(model(), 10).order)), "ord int, `table` string"),
        "lib_plan_deferred": lambda s, d: s.createDataFrame([(t, ",".join(f.columns), f.ref_table) for t, f in build_plan(model(), 10).deferred], "`table` string, fk string, ref_table string"),
        "lib_preflight": lambda s, d: s.createDataFrame(preflight(BROKEN), "`table` string, message string"),
        "lib_generated_violations": lambda s, d: summary({t.name: Generator(model(), 500).table(s, t.name) for t in model().tables}, model()).where("violations > 0 or rule = 'FK'"),
        "violations_all": lambda s, d: violations(faulty(s, d), parse(FAULTY)),
        "violations_all_summary": lambda s, d: summary(faulty(s, d), parse(FAULTY)),
    }


def _literal(names: str, text: str, integers: str = "") -> str:
    """SQL of the rows in ``text``, a line each with fields parted by |; an empty field is null."""
    columns = names.split()
    rows = []
    for line in text.strip().splitlines():
        parts = [x.strip() for x in line.strip().split("|")]
        rows.append("(" + ", ".join("NULL" if x == "" else x if c in integers.split() else "'" + x.replace("'", "''") + "'" for c, x in zip(columns, parts, strict=True)) + ")")
    quoted = ", ".join(f'"{c}"' for c in columns)
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v({quoted})"


ENTITY, LOOKUP = "every table is a domain entity by default", "has no temporal tracking columns (stable, infrequently modified)"
NO_FK, SELF = "has no outgoing foreign keys (does not depend on other tables)", "table has 1 self-referencing foreign key(s), forming a hierarchical structure"
MOVING = 'has a "created_at" column indicating event timestamping; has 2 outgoing foreign key(s) referencing domain entities; has an "updated_at" column indicating lifecycle tracking; is not a junction table — has an independent identity'
_FAULTS = """
land AS (SELECT n_nationkey AS row_index, n_nationkey // 2 * 2 AS k, n_regionkey AS region, n_name AS ab FROM nation),
spot AS (SELECT r_regionkey AS row_index, r_regionkey AS a, CASE WHEN r_regionkey > 0 THEN 1 END AS b FROM region),
buyer AS (SELECT c_custkey AS row_index, c_custkey - c_custkey % 2 AS id, c_nationkey AS land, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS segment, c_nationkey % 6 AS a, CASE WHEN c_custkey % 3 > 0 THEN 1 END AS b FROM customer),
faults AS (
  SELECT 'stray' AS "table", NULL AS "column", NULL AS row_index, NULL AS value, 'INTERNAL' AS rule, 'table "stray" not found in schema model' AS message
  UNION ALL SELECT 'land', 'gone', row_index, NULL, 'NOT_NULL', 'column "gone" is NOT NULL but row ' || row_index || ' has no value' FROM land
  UNION ALL SELECT 'land', NULL, row_index, CAST(k AS VARCHAR), 'PK_UNIQUE', 'duplicate primary key "' || k || '" (first seen at row ' || f || ')' FROM (SELECT *, min(row_index) OVER (PARTITION BY k) AS f FROM land) WHERE row_index > f
  UNION ALL SELECT 'land', NULL, row_index, CAST(region AS VARCHAR), 'UNIQUE', 'duplicate unique value "' || region || '" (first seen at row ' || f || ')' FROM (SELECT *, min(row_index) OVER (PARTITION BY region) AS f FROM land) WHERE row_index > f
  UNION ALL SELECT 'land', 'a.b', row_index, ab, 'LENGTH', 'string length ' || strlen(ab) || ' exceeds column limit 6' FROM land WHERE strlen(ab) > 6
  UNION ALL SELECT 'spot', 'b', row_index, NULL, 'NOT_NULL', 'column "b" is NOT NULL but row ' || row_index || ' has nil value' FROM spot WHERE b IS NULL
  UNION ALL SELECT 'buyer', NULL, row_index, CAST(id AS VARCHAR), 'PK_UNIQUE', 'duplicate primary key "' || id || '" (first seen at row ' || f || ')' FROM (SELECT *, min(row_index) OVER (PARTITION BY id) AS f FROM buyer) WHERE row_index > f
  UNION ALL SELECT 'buyer', 'segment', row_index, NULL, 'NOT_NULL', 'column "segment" is NOT NULL but row ' || row_index || ' has nil value' FROM buyer WHERE segment IS NULL
  UNION ALL SELECT 'buyer', 'segment', row_index, segment, 'ENUM', 'value "' || segment || '" is not a valid enum value for type "segment"' FROM buyer WHERE segment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
  UNION ALL SELECT 'buyer', 'land', row_index, CAST(land AS VARCHAR), 'FK', 'foreign key value "' || land || '" not found in referenced table "land" PK values' FROM buyer WHERE land NOT IN (SELECT k FROM land)
  UNION ALL SELECT 'buyer', NULL, row_index, a || '::' || coalesce(CAST(b AS VARCHAR), '<nil>'), 'FK', 'foreign key composite value "' || a || '::' || coalesce(CAST(b AS VARCHAR), '<nil>') || '" not found in referenced table "spot" PK values'
    FROM buyer x WHERE NOT EXISTS (SELECT 1 FROM spot y WHERE y.a IS NOT DISTINCT FROM x.a AND y.b IS NOT DISTINCT FROM x.b))"""


def oracle_sql() -> dict[str, str]:
    """What the schema above has to give, written by hand."""
    checks = "land NOT_NULL, land PK_UNIQUE, land UNIQUE, land LENGTH, spot NOT_NULL, spot PK_UNIQUE, buyer NOT_NULL, buyer PK_UNIQUE, buyer ENUM, buyer FK, stray INTERNAL"
    return {
        "lib_columns": _literal(
            "table ord column type length scale nullable is_primary_key is_serial default",
            """branch|0|id|int|||false|true|false|
            branch|1|city|varchar|40||false|false|false|
            branch|2|zipCode|char|5||true|false|false|
            branch|3|manager_id|int|||true|false|false|
            staff|0|id|int|||false|true|true|
            staff|1|branch_id|int|||false|false|false|
            staff|2|email_address|text|||true|false|false|
            genre|0|id|int|||false|true|false|
            genre|1|label|varchar|30||false|false|false|
            genre|2|parent_id|int|||true|false|false|
            member|0|id|bigint|||false|true|true|
            member|1|firstName|text|||false|false|false|
            member|2|lastName|text|||true|false|false|
            member|3|mail|varchar|80||true|false|false|
            member|4|sponsor|bigint|||true|false|false|
            member|5|home_branch|int|||true|false|false|
            member|6|created_at|timestamp|||false|false|false|
            member|7|updated_at|timestamp|||true|false|false|
            member|8|deleted_at|timestamp|||true|false|false|
            member|9|created_by|text|||true|false|false|
            title|0|id|bigint|||false|true|false|
            title|1|bookTitle|varchar|200||false|false|false|
            title|2|price|decimal|8|2|true|false|false|
            title|3|website|text|||true|false|false|
            title_genre|0|title_id|bigint|||false|true|false|
            title_genre|1|genre_id|int|||false|true|false|
            copy|0|title_id|bigint|||false|true|false|
            copy|1|nr|int|||false|true|false|
            copy|2|branch_id|int|||true|false|false|
            copy|3|shelf_code|varchar|8||true|false|false|
            loan|0|id|bigint|||false|true|false|
            loan|1|member_id|bigint|||false|false|false|
            loan|2|title_id|bigint|||true|false|false|
            loan|3|nr|int|||true|false|false|
            loan|4|state|loan_state|||false|false|false|'open'
            loan|5|created_at|timestamp|||true|false|false|
            loan|6|updated_at|timestamp|||true|false|false|
            setting|0|Key|text|||false|true|false|
            setting|1|Value|text|||true|false|false|""",
            "ord length scale nullable is_primary_key is_serial",
        ),
        "lib_semantics": _literal(
            "table column semantic words",
            """branch|id||id
            branch|city|city|city
            branch|zipCode|zip|zip code
            branch|manager_id||manager id
            staff|id||id
            staff|branch_id||branch id
            staff|email_address|email|email address
            genre|id||id
            genre|label||label
            genre|parent_id||parent id
            member|id||id
            member|firstName|first_name|first name
            member|lastName|last_name|last name
            member|mail|email|mail
            member|sponsor||sponsor
            member|home_branch||home branch
            member|created_at||created at
            member|updated_at||updated at
            member|deleted_at||deleted at
            member|created_by||created by
            title|id||id
            title|bookTitle|title|book title
            title|price||price
            title|website|url|website
            title_genre|title_id|title|title id
            title_genre|genre_id||genre id
            copy|title_id|title|title id
            copy|nr||nr
            copy|branch_id||branch id
            copy|shelf_code|code|shelf code
            loan|id||id
            loan|member_id||member id
            loan|title_id|title|title id
            loan|nr||nr
            loan|state|state|state
            loan|created_at||created at
            loan|updated_at||updated at
            setting|Key||key
            setting|Value||value""",
        ),
        "lib_keys": _literal("table kind ord columns", "branch|primary|0|id\nbranch|unique|0|city\nstaff|primary|0|id\ngenre|primary|0|id\nmember|primary|0|id\nmember|unique|0|mail\ntitle|primary|0|id\ntitle|unique|0|bookTitle,price\ntitle_genre|primary|0|title_id,genre_id\ncopy|primary|0|title_id,nr\nloan|primary|0|id\nsetting|primary|0|Key", "ord"),
        "lib_foreign_keys": _literal(
            "table ord columns ref_table ref_columns on_delete on_update cardinality",
            """branch|0|manager_id|staff|id|NO ACTION|NO ACTION|one_to_many
            staff|0|branch_id|branch|id|NO ACTION|NO ACTION|one_to_many
            genre|0|parent_id|genre|id|NO ACTION|NO ACTION|one_to_many
            member|0|sponsor|member|id|NO ACTION|NO ACTION|one_to_many
            member|1|home_branch|branch|id|NO ACTION|NO ACTION|one_to_many
            title_genre|0|title_id|title|id|NO ACTION|NO ACTION|many_to_many
            title_genre|1|genre_id|genre|id|NO ACTION|NO ACTION|many_to_many
            copy|0|title_id|title|id|CASCADE|NO ACTION|one_to_many
            copy|1|branch_id|branch|id|NO ACTION|NO ACTION|one_to_many
            loan|0|title_id,nr|copy|title_id,nr|CASCADE|NO ACTION|one_to_many
            loan|1|member_id|member|id|NO ACTION|NO ACTION|one_to_many""",
            "ord",
        ),
        "lib_enums": _literal("enum ord value", "loan_state|0|open\nloan_state|1|late\nloan_state|2|closed", "ord"),
        "lib_checks": "SELECT 'title' AS \"table\", 0 AS ord, '' AS name, 'price >= 0' AS expression",
        "lib_relationships": _literal(
            "table ref_table columns kind",
            """branch|staff|manager_id|aggregation
            staff|branch|branch_id|association
            genre|genre|parent_id|hierarchy
            member|member|sponsor|hierarchy
            member|branch|home_branch|aggregation
            title_genre|title|title_id|many_to_many
            title_genre|genre|genre_id|many_to_many
            copy|title|title_id|composition
            copy|branch|branch_id|aggregation
            loan|copy|title_id,nr|aggregation
            loan|member|member_id|association""",
        ),
        "lib_role_evidence": _literal(
            "table role score evidence",
            "\n".join(f"{t}|entity|50|{ENTITY}" for t in "branch staff genre member title title_genre copy loan setting".split())
            + f"""
            branch|lookup|60|referenced by 3 other tables (frequently used reference); has only 4 column(s) — small, focused table; {LOOKUP}
            genre|lookup|60|referenced by 2 other tables (frequently used reference); has only 3 column(s) — small, focused table; {LOOKUP}
            title|lookup|100|{NO_FK}; referenced by 2 other tables (frequently used reference); has only 4 column(s) — small, focused table; {LOOKUP}
            setting|lookup|70|{NO_FK}; has only 2 column(s) — small, focused table; {LOOKUP}
            genre|hierarchical|95|{SELF}
            member|hierarchical|95|{SELF}
            title_genre|junction|95|primary key column "title_id" is also a foreign key column; primary key column "genre_id" is also a foreign key column; composite primary key has 2 columns, all of which are foreign keys
            member|transactional|100|{MOVING}
            loan|transactional|100|{MOVING}
            member|temporal|100|has created_at; has updated_at; has deleted_at
            loan|temporal|100|has created_at; has updated_at
            member|soft_delete|100|has deleted_at
            member|audit|100|has created_by""",
            "score",
        ),
        "lib_badges": _literal("table badge", "branch|lookup\nstaff|entity\ngenre|hierarchical\nmember|hierarchical\ntitle|lookup\ntitle_genre|junction\ncopy|entity\nloan|transactional\nsetting|lookup"),
        "lib_junctions": _literal("table", "title_genre"),
        "lib_isolated": _literal("table", "setting"),
        "lib_roots": _literal("table", "genre\ntitle\nsetting"),
        "lib_leaves": _literal("table", "title_genre\nloan\nsetting"),
        "lib_levels": _literal("table level", "genre|0\ntitle|0\nsetting|0\ntitle_genre|1", "level"),
        "lib_degrees": _literal("table n_columns n_outgoing n_incoming n_self", "branch|4|1|3|0\nstaff|3|1|1|0\ngenre|3|1|2|1\nmember|10|2|2|1\ntitle|4|0|2|0\ntitle_genre|2|2|0|0\ncopy|4|2|1|0\nloan|7|2|0|0\nsetting|2|0|0|0", "n_columns n_outgoing n_incoming n_self"),
        "lib_optional": _literal("table ref_table columns", "branch|staff|manager_id\ngenre|genre|parent_id\nmember|member|sponsor\nmember|branch|home_branch\ncopy|branch|branch_id\nloan|copy|title_id,nr"),
        "lib_dependencies": _literal("table ancestor distance", "loan|copy|1\nloan|member|1\nloan|title|2\nloan|branch|2\nloan|staff|3", "distance"),
        "lib_plan_order": _literal("ord table", "0|setting\n1|title\n2|genre\n3|branch\n4|staff\n5|member\n6|copy\n7|title_genre\n8|loan", "ord"),
        "lib_plan_deferred": _literal("table fk ref_table", "genre|parent_id|genre\nbranch|manager_id|staff\nmember|sponsor|member"),
        "lib_preflight": _literal("table message", 'a|duplicate column "x"\na|primary key column "none" does not exist\na|unique column "q" does not exist\na|foreign key references unknown table "nowhere"\na|foreign key column "y" does not exist\na|referenced column "z" does not exist in "b"'),
        "lib_generated_violations": _literal("table rule violations", "\n".join(f"{t}|FK|0" for t in "branch staff genre member title_genre copy loan".split()), "violations"),
        "violations_all": f"WITH {_FAULTS} SELECT * FROM faults",
        "violations_all_summary": f"WITH {_FAULTS} SELECT split_part(c, ' ', 1) AS \"table\", split_part(c, ' ', 2) AS rule, (SELECT count(*) FROM faults f WHERE f.\"table\" || ' ' || rule = c) AS violations FROM (SELECT unnest(string_split('{checks}', ', ')) AS c)",
    }
