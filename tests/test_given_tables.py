"""Rows for given tables, unique values, one-pass validation, stored profiles, exports, streams and progress."""

import time

import pytest
from pyspark.sql import functions as F

from relgen.functions.generators import ExhaustedError, Registry
from relgen.functions.rng import below
from relgen.operators import sinks
from relgen.operators.admission import admitted, folded
from relgen.operators.generate import Extension, Generator, backfilled, extended
from relgen.operators.numbering import numbered
from relgen.operators.profile import profile
from relgen.operators.profile_state import merged, profile_of, profile_state
from relgen.operators.progress import kept_rows, tracked
from relgen.operators.unique import redrawn
from relgen.operators.validate import report, summary, violations
from relgen.sources.ddl import parse
from relgen.streaming import state

KINDS = """
CREATE TYPE mood AS ENUM ('sad', 'ok', 'happy');
CREATE TABLE u (id INET PRIMARY KEY, m mood UNIQUE, b BOOLEAN UNIQUE);
CREATE TABLE v (id BIGINT PRIMARY KEY, j JSONB UNIQUE, mac MACADDR UNIQUE, t TIME UNIQUE, raw BYTEA UNIQUE, r REAL UNIQUE, phone TEXT UNIQUE, span INTERVAL UNIQUE, u_id INET REFERENCES u(id));
CREATE TABLE w (u_id INET REFERENCES u(id), m mood, day DATE, PRIMARY KEY (u_id, m));
"""


def test_unique_values_keep_their_kind(spark):
    m = parse(KINDS)
    g = Generator(m, {"u": 2, "v": 60, "w": 6})
    tables = {n: g.table(spark, n) for n in ("u", "v", "w")}
    assert violations(tables, m).count() == 0 and all(r["violations"] == 0 for r in summary(tables, m).collect())
    v = tables["v"]
    forms = {"j": r"^\{.+\}$", "mac": "^([0-9a-f]{2}:){5}[0-9a-f]{2}$", "t": "^[0-2][0-9]:[0-5][0-9]:[0-5][0-9]$", "phone": r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$", "span": "^[0-9]+ days$"}
    assert v.where(" and ".join(f"{c} rlike '{p}'" for c, p in forms.items()).replace("\\", "\\\\")).count() == 60
    assert {r["m"] for r in tables["u"].collect()} <= {"sad", "ok", "happy"} and tables["w"].select("u_id", "m").distinct().count() == 6
    with pytest.raises(ExhaustedError):
        Generator(m, {"u": 3, "v": 1, "w": 1}).table(spark, "u")


def test_registered_generators_and_exhaustion(spark):
    m = parse("CREATE TABLE t (id BIGINT PRIMARY KEY, label TEXT UNIQUE, n INT UNIQUE);")
    registry = Registry()
    registry.register("text", lambda c: F.concat(F.lit("N"), below(c.u(), 30).cast("string")))
    registry.register("int", lambda c: below(c.u(), 1000).cast("int") * 2)
    rows = Generator(m, 20, registry=registry).table(spark, "t").collect()
    assert len({r["label"] for r in rows}) == 20 and all(r["label"][0] == "N" for r in rows) and len({r["n"] for r in rows}) == 20 and all(r["n"] % 2 == 0 for r in rows)
    again = Generator(m, 20, registry=registry).table(spark, "t", 3).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    with pytest.raises(ExhaustedError):
        Generator(m, 31, registry=registry).table(spark, "t")


def test_redraw_takes_what_is_left(spark):
    rows = spark.range(8).select(F.col("id").alias("row_index"))
    draw = lambda k: {"x": F.pmod(F.xxhash64("row_index", F.lit(k)), F.lit(10))}
    taken = spark.createDataFrame([(0,), (9,)], "x bigint")
    assert sorted(r["x"] for r in redrawn(rows, draw, taken).collect()) == list(range(1, 9))
    with pytest.raises(ExhaustedError):
        redrawn(rows, draw, spark.createDataFrame([(i,) for i in range(3)], "x bigint"))
    assert redrawn(rows.limit(0), draw).count() == 0


def test_rows_for_given_tables(spark):
    m = parse("CREATE TABLE p (k TEXT PRIMARY KEY); CREATE TABLE c (id INT PRIMARY KEY, k TEXT NOT NULL REFERENCES p(k), up INT REFERENCES c(id), ok BOOLEAN, UNIQUE (k, ok));")
    p = spark.createDataFrame([(f"p{i}",) for i in range(40)] + [(None,)], "k string")
    c = spark.createDataFrame([(i, f"p{i}", None, True) for i in range(30)], "id int, k string, up int, ok boolean")
    new = extended({"p": p, "c": c}, m, "c", 25)
    assert {r["id"] for r in new.collect()} == set(range(30, 55))
    both = new.drop("row_index").unionByName(c)
    assert violations({"p": p.where("k is not null").withColumn("row_index", F.lit(0)), "c": both.withColumn("row_index", F.col("id"))}, m).count() == 0
    other = extended({"p": p.repartition(5), "c": c.repartition(3)}, m, "c", 25)
    assert sorted(map(str, new.collect())) == sorted(map(str, other.collect()))


def test_keys_that_share_columns(spark):
    m = parse("CREATE TYPE e AS ENUM ('x', 'y', 'z'); CREATE TABLE p (id BIGINT PRIMARY KEY); CREATE TABLE q (id BIGINT PRIMARY KEY); CREATE TABLE t (p_id BIGINT REFERENCES p(id), q_id BIGINT REFERENCES q(id), a TEXT, e e, PRIMARY KEY (p_id, q_id), UNIQUE (a, e), UNIQUE (e, q_id));")
    registry = Registry()
    registry.register("text", lambda c: below(c.u(), 8).cast("string"))
    g = Generator(m, {"p": 6, "q": 6, "t": 8}, registry=registry)
    tables = {n: g.table(spark, n) for n in ("p", "q", "t")}
    assert tables["t"].count() == 8 and violations(tables, m).count() == 0
    given = {n: d.drop("row_index") for n, d in tables.items()}
    given["t"] = given["t"].where("e <> 'x'")
    new = extended(given, m, "t", 5, registry=registry)
    both = new.drop("row_index").unionByName(given["t"]).withColumn("row_index", F.monotonically_increasing_id())
    assert new.count() == 5 and violations(tables | {"t": both}, m).count() == 0


def test_redraw_of_several_keys(spark):
    rows = spark.range(12).select(F.col("id").alias("row_index"))
    draw = lambda k: {c: F.pmod(F.xxhash64("row_index", F.lit(f"{k}{c}")), F.lit(n)) for c, n in (("x", 6), ("y", 4), ("z", 6))}
    taken = spark.createDataFrame([(0, 0, 1), (5, 3, 2)], "x bigint, y bigint, z bigint")
    got = redrawn(rows, draw, taken, keys=[["x", "y"], ["y", "z"]]).collect()
    for left in ("x", "z"):
        assert len({(r[left], r["y"]) for r in got} - {(r[left], r["y"]) for r in taken.collect()}) == 12
    again = redrawn(rows.repartition(3), draw, taken.repartition(2), keys=[["x", "y"], ["y", "z"]]).collect()
    assert sorted(got) == sorted(again)


def test_floats_beyond_cents(spark):
    m = parse("CREATE TABLE t (id BIGINT PRIMARY KEY, r REAL UNIQUE);")
    given = spark.range(1_000_000).select("id", (F.col("id") / 100).cast("float").alias("r"))
    new = [r["r"] for r in extended({"t": given}, m, "t", 20).collect()]
    assert len(set(new)) == 20 and all(0 <= x < 10_000 for x in new) and given.where(F.col("r").isin(new)).count() == 0


def test_tries_may_be_a_column(spark):
    m = parse("CREATE TYPE e AS ENUM ('x', 'y'); CREATE TABLE p (id BIGINT PRIMARY KEY); CREATE TABLE t (p_id BIGINT REFERENCES p(id), e e, u UUID, r REAL, d NUMERIC(7,2), j JSONB, w TEXT, at TIME, ip INET, UNIQUE (p_id, e, u, r, d, j, w, at, ip));")
    registry = Registry()
    given = {"p": spark.range(9), "t": spark.createDataFrame([], "p_id long")}
    g, t = Extension(given, m, "t", 30, registry=registry), m.table("t")
    assert g._counted(t, t.unique[0])
    rows = spark.range(30).select(F.col("id").alias("row_index"), F.lit(7).alias("k"))
    one, column = (sorted(map(str, rows.select("row_index", *(c.alias(n) for n, c in g._draws(t, t.unique[0], k).items())).collect())) for k in (7, F.col("k")))
    assert one == column
    registry.register("float", lambda c: F.lit(1.0))
    assert not g._counted(t, t.unique[0]) and not Generator(m, 3)._counted(t, t.unique[0])


def test_numbers_and_backfill(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(6)
    assert all(r["n"] == r["x"] for r in numbered(df, ["x"], "n").collect()) and numbered(df.limit(0), ["x"]).count() == 0
    m = parse("CREATE TABLE t (id BIGINT PRIMARY KEY, up BIGINT REFERENCES t(id), p BIGINT REFERENCES q(id)); CREATE TABLE q (id BIGINT PRIMARY KEY);")
    t = spark.createDataFrame([(10 * i, i, 0 if i == 5 else None, None) for i in range(20)], "row_index long, id long, up long, p long")
    up = {r["id"]: r["up"] for r in backfilled(t, m.tables[0], "up", t, "id").collect()}
    assert up[0] is None and up[5] == 0 and all(up[i] < i for i in range(1, 20))
    q = spark.createDataFrame([(7,), (8,), (None,)], "id long")
    assert {r["p"] for r in backfilled(t, m.tables[0], "p", q, "id").collect()} == {7, 8}
    with pytest.raises(ExhaustedError):
        backfilled(t, m.tables[0], "p", q.limit(0), "id")


def test_validation_reads_each_table_once(spark):
    m = parse("CREATE TYPE e AS ENUM ('x'); CREATE TABLE p (id INT PRIMARY KEY, a INT, b TEXT, UNIQUE (a, b)); CREATE TABLE c (id INT PRIMARY KEY, n VARCHAR(2) NOT NULL, e e, p BIGINT REFERENCES p(id), q INT REFERENCES p(id), UNIQUE (n, e));")
    p = spark.createDataFrame([(0, 1, None, "z"), (1, 2, None, "z"), (1, 1, 5, None)], "row_index long, id int, a int, b string")
    c = spark.createDataFrame([(0, 1, "ab", "x", 1, None), (0, 1, "ab", "x", 9, 2), (None, 1, "abc", "y", None, 3), (4, 2, None, None, 2, 1)], "row_index long, id int, n string, e string, p long, q int")
    plan = summary({"p": p, "c": c}, m)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD[row_index") + plan.count("LocalTableScan [row_index") <= 2
    counts = {(r["table"], r["rule"]): r["violations"] for r in summary({"p": p, "c": c}, m).collect()}
    rows = report({"p": p, "c": c}, m).collect()
    found = {}
    for r in rows:
        found[r["table"], r["rule"]] = found.get((r["table"], r["rule"]), 0) + 1
    assert found == {k: v for k, v in counts.items() if v} == {("p", "PK_UNIQUE"): 1, ("p", "UNIQUE"): 1, ("c", "PK_UNIQUE"): 2, ("c", "UNIQUE"): 1, ("c", "NOT_NULL"): 1, ("c", "ENUM"): 1, ("c", "LENGTH"): 1, ("c", "FK"): 2}
    assert [r["table"] for r in rows] == sorted((r["table"] for r in rows), key=["p", "c"].index)
    quoted = parse("CREATE TYPE e AS ENUM ('it''s', 'a\\b'); CREATE TABLE t (id INT PRIMARY KEY, e e);")
    t = spark.createDataFrame([(0, 1, "it's"), (1, 2, "a\\b"), (2, 3, "no")], "row_index long, id int, e string")
    assert [r["value"] for r in violations({"t": t}, quoted).collect()] == ["no"]


def test_profiles_merge(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 40 - 20).alias("few"), (F.col("id") * 1_000_003).alias("wide"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("0"), F.col("id") % 50)).otherwise("null").alias("text"), (F.col("id") / 4).alias("x"))
    parts = [rows.where(f"id % 3 = {i}") for i in range(3)]
    states = [profile_state(p, order_by="id") for p in parts]
    want = {r["column"]: r for r in profile(rows, order_by="id").collect()}
    for s in (merged(*states), merged(merged(*states[:2]), states[2]), merged(profile_state(rows, order_by="id"))):
        assert {r["column"]: r for r in profile_of(s).collect()} == want
    assert {r["n_distinct"] for r in profile_of(profile_state(rows.limit(0), order_by="id")).collect()} <= {0}


def test_one_ordered_file(spark, tmp_path):
    m = parse("CREATE TABLE t (id BIGINT PRIMARY KEY, name TEXT); CREATE TABLE none (id BIGINT PRIMARY KEY);")
    t = spark.range(3000).select((2999 - F.col("id")).alias("row_index"), "id", F.concat(F.lit("é, "), "id").alias("name")).repartition(7)
    tables = {"t": t, "none": spark.createDataFrame([], "id bigint"), "again": t.limit(2)}
    sinks.one_file(spark, sinks.csv_segments(tables), str(tmp_path / "x.csv"))
    text = (tmp_path / "x.csv").read_text()
    lines = [f'{2999 - i},"é, {2999 - i}"\n' for i in range(3000)]
    assert text.startswith('"id","name"\n' + "".join(lines) + '\n"id"\n\n"id","name"\n')
    assert "".join(sinks.csv_text({"t": t})) == '"id","name"\n' + "".join(lines)
    sinks.one_file(spark, sinks.sql_segments({"t": t, "none": tables["none"]}, m), str(tmp_path / "x.sql"))
    assert (tmp_path / "x.sql").read_text() == 'INSERT INTO t ("id", "name") VALUES\n' + ",\n".join(f"({2999 - i}, 'é, {2999 - i}')" for i in range(3000)) + ";\n\n"


def test_windows_begin_with_the_first_event(spark):
    import numpy as np

    allowed, window, begin, count = folded(np.array([0, 5, 9, 10, 11, 12, 30]), None, 0, 2, 10)
    assert allowed.tolist() == [True, True, False, False, True, True, True] and window.tolist() == [0, 0, 0, 0, 11, 11, 30] and (begin, count) == (30, 1)
    assert folded(np.array([3, 11]), 0, 2, 2, 10)[0].tolist() == [False, True]
    events = spark.createDataFrame([("a", i, i) for i in range(0, 200, 7)] + [(None, 1, 1), ("b", None, 2)], "who string, s long, allowed long").withColumn("at", F.timestamp_seconds("s"))
    got = {(r["who"], r["s"]): r["allowed"] for r in admitted(events.withColumnRenamed("allowed", "id"), "who", "at", 3, 60, ["id"]).collect()}
    assert got[None, 1] and got["b", None] and [s for (w, s), a in sorted(got.items(), key=str) if w == "a" and a and s < 63] and sum(a for (w, _), a in got.items() if w == "a") == 3 * 3 + 2


def test_streams_give_the_batch_rows(spark, tmp_path):
    rows = [(i, f"k{i * i % 7}", 100 + i) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, who string, s long").withColumn("at", F.timestamp_seconds("s"))
    for i in range(3):
        df.where(f"id div 20 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.prepared(spark)

    def run(made, name):
        q = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    try:
        stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = run(state.admitted(stream(), "who", "at", "id", 2, 20), "let_in")
        assert {tuple(r) for r in got.select("id", "allowed").collect()} == {tuple(r) for r in admitted(df, "who", "at", 2, 20, ["id"]).select("id", "allowed").collect()}
        got = run(state.repeats(stream().withColumn("row_index", F.col("id")), "t", ["who"], "UNIQUE"), "again")
        m = parse("CREATE TABLE t (who TEXT UNIQUE);")
        assert {tuple(r) for r in got.select("row_index", "value", "message").collect()} == {tuple(r) for r in violations({"t": df.withColumn("row_index", F.col("id"))}, m).select("row_index", "value", "message").collect()}
        keys = spark.createDataFrame([(f"k{i}", 110) for i in range(3)], "ref string, s long").withColumn("there", F.timestamp_seconds("s"))
        keys.coalesce(1).write.parquet(str(tmp_path / "keys"))
        late = spark.createDataFrame([("k0", 100_000)], "ref string, s long").withColumn("there", F.timestamp_seconds("s"))
        late.coalesce(1).write.mode("append").parquet(str(tmp_path / "keys"))
        spark.createDataFrame([(1000, "k0", 100_000)], "id long, who string, s long").withColumn("at", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        parents = spark.readStream.schema(keys.schema).parquet(str(tmp_path / "keys"))
        lost = run(state.late_orphans(stream(), parents, "who", "ref", "at", "there", "1 hour"), "lost")
        assert {r["id"] for r in lost.collect()} == {i for i, w, _ in rows if w not in ("k0", "k1", "k2")}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_progress_and_cancelling(spark, tmp_path):
    seen = []
    slow = spark.range(0, 64, 1, 64).select(F.expr("java_method('java.lang.Thread', 'sleep', 250L)").alias("s"), "id")
    begun = []

    def cancelled():
        begun.append(time.time())
        return len(seen) > 2 and seen[-1].tasks >= 8

    out = kept_rows(slow, str(tmp_path / "kept"), seen.append, cancelled)
    assert not out.finished and 8 <= out.progress.tasks < 64 and time.time() - begun[-1] < 2
    assert [p.tasks for p in seen] == sorted(p.tasks for p in seen) and 8 <= spark.read.parquet(str(tmp_path / "kept")).count() < 64
    spark.range(100).write.parquet(str(tmp_path / "in"))
    done = tracked(spark, lambda: spark.read.parquet(str(tmp_path / "in")).agg(F.sum("id")).collect())
    assert done.finished and done.progress.rows == 100
    with pytest.raises(ZeroDivisionError):
        tracked(spark, lambda: 1 / 0)
