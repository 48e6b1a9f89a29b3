import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgen import jobs, queries, star
from relgen.functions.generators import ExhaustedError
from relgen.functions.formatting import csv_field, shortest, sql_literal
from relgen.operators import sinks
from relgen.operators.generate import Generator, generate, stream_events
from relgen.operators.profile import profile
from relgen.operators.validate import summary, violations
from relgen.plans import graph
from relgen.sources.ddl import parse
from relgen.sources.model import catalog
from relgen.streaming.monitor import row_violations

DDL = """
CREATE TYPE mood AS ENUM ('sad', 'ok');
CREATE TABLE users (id INT PRIMARY KEY, email VARCHAR(60) NOT NULL UNIQUE, mood mood, city TEXT, zip TEXT);
CREATE TABLE pairs (a INT, b INT, note VARCHAR(5), PRIMARY KEY (a, b));
CREATE TABLE likes (user_id INT REFERENCES users(id), a INT, b INT, kind INT, PRIMARY KEY (user_id, a), FOREIGN KEY (a, b) REFERENCES pairs(a, b));
CREATE TABLE profiles (id INT PRIMARY KEY REFERENCES users(id), at TIMESTAMP, day DATE, t TIME, x REAL, u UUID, j JSONB, raw BYTEA, ip INET, mac MACADDR, span INTERVAL, p NUMERIC(5,2));
CREATE TABLE tree (id INT PRIMARY KEY, up INT REFERENCES tree(id));
"""


def test_generated_data_is_valid(spark):
    m = parse(DDL)
    data = generate(spark, m, 40)
    assert not data.errors
    assert violations(data.tables, m).count() == 0
    assert all(r["violations"] == 0 for r in summary(data.tables, m).collect())
    assert data.tables["tree"].where("up >= id").count() == 0


def test_same_on_any_partitioning(spark):
    g, other = Generator(parse(DDL), 100), Generator(parse(DDL), 100, seed=1)
    one, eight = (sorted(map(str, g.table(spark, "users", n).collect())) for n in (1, 8))
    assert one == eight != sorted(map(str, other.table(spark, "users").collect()))


def test_exhausted(spark):
    data = generate(spark, parse("CREATE TABLE a (id INT PRIMARY KEY, c VARCHAR(1) UNIQUE);"), 100)
    assert data.errors and not data.tables
    with pytest.raises(ExhaustedError):
        Generator(parse("CREATE TABLE a (id SMALLINT PRIMARY KEY);"), 40_000).table(spark, "a")
    assert list(stream_events(spark, parse(DDL), 1))[-1] == {"event": "complete", "tables": 5}


def test_violations(spark):
    m = parse("CREATE TYPE e AS ENUM ('x'); CREATE TABLE p (id INT PRIMARY KEY); CREATE TABLE c (id INT PRIMARY KEY, n VARCHAR(2) NOT NULL, e e, p INT REFERENCES p(id), u TEXT UNIQUE);")
    p = spark.createDataFrame([(0, 1)], "row_index long, id int")
    c = spark.createDataFrame([(0, 1, "ab", "x", 1, None), (1, 1, "é€", "y", 2, None), (2, 2, None, None, None, "k")], "row_index long, id int, n string, e string, p int, u string")
    found = {(r["rule"], r["column"], r["row_index"], r["value"]): r["message"] for r in violations({"p": p, "c": c}, m).collect()}
    assert set(found) == {("PK_UNIQUE", None, 1, "1"), ("NOT_NULL", "n", 2, None), ("ENUM", "e", 1, "y"), ("LENGTH", "n", 1, "é€"), ("FK", "p", 1, "2"), ("UNIQUE", None, 1, "<nil>")}
    assert found[("PK_UNIQUE", None, 1, "1")] == 'duplicate primary key "1" (first seen at row 0)'
    assert {r["rule"]: r["violations"] for r in summary({"p": p, "c": c}, m).where("table = 'c'").collect()} == {"PK_UNIQUE": 1, "NOT_NULL": 1, "ENUM": 1, "LENGTH": 1, "FK": 1, "UNIQUE": 1}
    assert violations({"z": p}, m).first()["rule"] == "INTERNAL"


def test_sinks(spark, tmp_path):
    m = parse("CREATE TABLE t (id INT PRIMARY KEY, name TEXT, ok BOOLEAN, x DOUBLE PRECISION);")
    df = spark.createDataFrame([(0, 1, "it's", True, 1.5), (1, 2, None, None, None)], "row_index long, id int, name string, ok boolean, x double")
    assert "".join(sinks.sql_text({"t": df}, m, "public")) == 'INSERT INTO public.t ("id", "name", "ok", "x") VALUES\n(1, \'it\'\'s\', TRUE, 1.50),\n(2, NULL, NULL, NULL);\n\n'
    assert "".join(sinks.csv_text({"t": df, "u": df.limit(0)})) == '"id","name","ok","x"\n1,"it\'s",true,1.5\n2,,,\n\n"id","name","ok","x"\n'
    assert "".join(sinks.sql_text({"t": df.limit(0)}, m)) == ""
    sinks.write({"t": df}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    assert len(sinks.preview({"t": df})["t"]) == 2


def test_profile(spark):
    df = spark.createDataFrame([(1, "5", ""), (2, "6.5", "b"), (3, "5", "null"), (4, None, "c")], "k int, a string, b string")
    got = {r["column"]: (r["nulls"], r["n_distinct"], r["type"], r["samples"]) for r in profile(df, order_by="k").collect()}
    assert got["a"] == (1, 2, "decimal", ["5", "6.5", "5"]) and got["b"] == (2, 2, "text", ["b", "c"]) and got["k"][2] == "integer"
    tied = spark.createDataFrame([(1, ""), (1, None), (1, "y"), (1, "x"), (2, "1e5")], "`k.x` int, v string")
    got = {r["column"]: r for r in profile(tied, order_by="k.x").collect()}
    assert got["v"]["samples"] == ["x", "y", "1e5"] and got["v"]["total"] == 5 and got["v"]["nulls"] == 2 and got["k.x"]["n_distinct"] == 2
    assert {r["total"] for r in profile(tied.limit(0)).collect()} == {0}


def test_shortest_numbers(spark):
    want = {0.001: "0.001", 0.0: "0", 100.0: "100", 1234567.0: "1.234567e+06", 1e-05: "1e-05", 0.0001: "0.0001", -2.5: "-2.5", 1e300: "1e+300", 99999.99: "99999.99"}
    got = {r["x"]: r["s"] for r in spark.createDataFrame([(x,) for x in want], "x double").select("x", shortest(F.col("x")).alias("s")).collect()}
    assert got == want and all(float(s) == x for x, s in got.items())


def test_years_over_9999_have_no_sign(spark):
    g = Generator(parse(queries.SHOP), {**dict.fromkeys(queries.LIKE, 10), "people": 2_914_700})
    last = g.table(spark, "people").where("row_index in (0, 2914699)").orderBy("row_index")
    want = ["2020-01-01", "10000-03-05"]
    made = last.select(queries.second(F.col("created_at")), sql_literal(F.col("created_at"), last.schema["created_at"].dataType), csv_field(F.col("created_at").cast("date"), T.DateType())).collect()
    assert [r[0][:-9] for r in made] == want and [r[1][1:-10] for r in made] == want and [r[2][1:-1] for r in made] == want


def test_hostile_tables(spark):
    m = parse('CREATE TABLE p (id INT PRIMARY KEY); CREATE TABLE c ("a.b" INT UNIQUE, n INT NOT NULL, p INT REFERENCES p(id), u VARCHAR(2), UNIQUE (n, u));')
    c = spark.createDataFrame([(0, 1), (1, 1)], "row_index long, `a.b` int")
    for tables in ({"c": c}, {"c": c, "p": spark.createDataFrame([(0, 1)], "row_index long, id int")}, {"z": c}, {"c": c.limit(0)}, {}):
        found = {(r["table"], r["rule"]): r["n"] for r in violations(tables, m).groupBy("table", "rule").agg(F.count("*").alias("n")).collect()}
        assert {(r["table"], r["rule"]): r["violations"] for r in summary(tables, m).where("violations > 0").collect()} == found
    assert violations({"c": c}, m).where("rule = 'NOT_NULL'").first()["message"] == 'column "n" is NOT NULL but row 0 has no value'


def test_custom_rules(spark):
    m = parse("CREATE TABLE a (id INT PRIMARY KEY, x INT, y INT);")
    rule = graph.Rule("wide", (graph._part("n_columns > 2", 70, "has {n_columns} columns"),))
    assert [tuple(r) for r in graph.table_roles(catalog(spark, m), (rule,)).collect()] == [("a", "wide", 70, ["has 3 columns"])]


def test_jobs(tmp_path, spark):
    store = jobs.JobStore(str(tmp_path / "jobs.json"))
    store.add(tables=1)
    store.add(tables=2)
    again = jobs.JobStore(str(tmp_path / "jobs.json"))
    assert [j["id"] for j in again.list()] == [2, 1] and again.delete(1) and not again.delete(1)
    assert again.add()["id"] == 3 and again.frame(spark).count() == 2
    cache = jobs.ResultCache(60)
    cache.put("a", 1)
    assert cache.get("a") == 1 and jobs.ResultCache(0).get("a") is None


def test_stream(spark, tmp_path):
    m = star.model()
    rows = spark.createDataFrame([(1, "click"), (2, "boom")], "event_id long, event_type string").withColumns({"ts": F.current_timestamp(), "user_id": F.lit(1).cast("long"), "value": F.lit(1.0), "props": F.lit("")})
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = row_violations(stream, m.table("events"), m, "event_id").writeStream.format("memory").queryName("bad").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("bad").collect()] == [(2, "event_type", "ENUM")]


def test_queries_match_their_sql(spark):
    import collections
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels conversations".split():
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    sql = queries.oracle_sql()
    for name, run in queries.queries().items():
        df = run(spark, sf)
        cols = sorted(df.columns)
        if name not in sql:
            assert df.count() > 0, name
            continue
        want = c.execute(sql[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == cols, name
        assert collections.Counter(tuple(str(r[x]) for x in cols) for r in df.collect()) == collections.Counter(tuple(str(r[names.index(x)]) for x in cols) for r in want.fetchall()), name


def test_cli(capsys, tmp_path, spark):
    from relgen.cli import main

    path = tmp_path / "s.sql"
    path.write_text("CREATE TABLE t (id INT PRIMARY KEY, name TEXT);")
    assert main(["generate", "-i", str(path), "--rows", "2"]) == 0
    assert capsys.readouterr().out.startswith('INSERT INTO t ("id", "name") VALUES\n(1, ')
    assert main(["inspect", "-i", str(path), "--graph", "--semantic"]) == 0
    assert "t: entity 0.50" in capsys.readouterr().out
    assert main(["version"]) == 0
