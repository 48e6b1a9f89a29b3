"""The driver's star schema as a declared model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relgen.sources.ddl import parse
from relgen.sources.model import Model

DDL = """
CREATE TYPE order_state AS ENUM ('F', 'O');
CREATE TYPE event_kind AS ENUM ('click', 'purchase', 'signup', 'view');
CREATE TABLE region (r_regionkey INT PRIMARY KEY, r_name VARCHAR(25) NOT NULL UNIQUE);
CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name VARCHAR(25) NOT NULL, n_regionkey INT NOT NULL REFERENCES region(r_regionkey));
CREATE TABLE customer (c_custkey BIGINT PRIMARY KEY, c_name VARCHAR(25) NOT NULL, c_nationkey INT NOT NULL REFERENCES nation(n_nationkey), c_acctbal DOUBLE PRECISION, c_mktsegment VARCHAR(9));
CREATE TABLE supplier (s_suppkey BIGINT PRIMARY KEY, s_name VARCHAR(25) NOT NULL, s_nationkey INT NOT NULL REFERENCES nation(n_nationkey), s_acctbal DOUBLE PRECISION);
CREATE TABLE part (p_partkey BIGINT PRIMARY KEY, p_name VARCHAR(10) NOT NULL UNIQUE, p_brand VARCHAR(10), p_type VARCHAR(25), p_size INT, p_retailprice DOUBLE PRECISION);
CREATE TABLE orders (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT NOT NULL REFERENCES customer(c_custkey), o_orderstatus order_state, o_totalprice DOUBLE PRECISION, o_orderdate TIMESTAMP, o_orderpriority VARCHAR(15));
CREATE TABLE lineitem (l_orderkey BIGINT NOT NULL REFERENCES orders(o_orderkey) ON DELETE CASCADE, l_partkey BIGINT NOT NULL REFERENCES part(p_partkey), l_suppkey BIGINT NOT NULL REFERENCES supplier(s_suppkey), l_linenumber INT NOT NULL, l_quantity DOUBLE PRECISION, l_extendedprice DOUBLE PRECISION, l_discount DOUBLE PRECISION, l_tax DOUBLE PRECISION, l_returnflag CHAR(1), l_linestatus CHAR(1), l_shipdate TIMESTAMP, PRIMARY KEY (l_orderkey, l_linenumber));
CREATE TABLE events (event_id BIGINT PRIMARY KEY, ts TIMESTAMP NOT NULL, user_id BIGINT REFERENCES customer(c_custkey), event_type event_kind, value DOUBLE PRECISION, props TEXT);
"""


def model() -> Model:
    return parse(DDL)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t.name: spark.read.parquet(f"{sf_dir}/{t.name}.parquet") for t in model().tables}
