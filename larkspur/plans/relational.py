"""One query for each relational operator, beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import compat
from larkspur.operators.relational import aggregate, distinct, having, join, limit, ranked, scan, sort, theta_join, top_k, values

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
C = F.col


class Tables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return scan(self.spark, f"{self.folder}/{name}.parquet")


def query(name: str, sql: str) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    def add(f: Callable[[Tables], DataFrame]) -> Query:
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        SQL[name] = sql
        return QUERIES[name]

    return add


def money(x: F.Column) -> F.Column:
    """Sums of doubles depend on their order: rounded."""
    return F.round(x, 2)


# scans

query("scan_full", "SELECT * FROM nation")(lambda t: t.nation)
query("scan_pruned", "SELECT o_orderkey, o_orderstatus FROM orders")(lambda t: t.orders.select("o_orderkey", "o_orderstatus"))
query("scan_point", "SELECT * FROM customer WHERE c_custkey = 77")(lambda t: t.customer.where(C("c_custkey") == 77))
query("scan_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 900")(
    lambda t: t.orders.where(C("o_orderkey").between(100, 900)).select("o_orderkey", "o_custkey"),
)
query("values_inline", "SELECT * FROM (VALUES (1, 'a', 1.5::DOUBLE), (2, 'b', NULL), (3, NULL, -2.5::DOUBLE)) AS v(id, name, x)")(
    lambda t: values(t.spark, [(1, "a", 1.5), (2, "b", None), (3, None, -2.5)], "id int, name string, x double"),
)
query("select_const", "SELECT 1 AS one, 2 > 1 AS yes, 12.5::DOUBLE AS x, 'text' AS s")(
    lambda t: t.spark.sql("SELECT 1 AS one, 2 > 1 AS yes, 12.5D AS x, 'text' AS s"),
)


@query("copy_from", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def copy_from(t: Tables) -> DataFrame:
    """Writes nation as a delimited file to the shared folder and loads it through COPY FROM."""
    from larkspur.scratch import scratch_dir
    from larkspur.session import Engine

    root = scratch_dir(t.spark)
    t.nation.write.csv(f"{root}/nation.tbl", sep="|")
    engine = Engine(t.spark, f"{root}/db")
    engine.sql("CREATE TABLE n (n_nationkey INT PRIMARY KEY, n_name VARCHAR(25) NOT NULL, n_regionkey INT)")
    engine.sql(f"COPY n FROM '{root}/nation.tbl' (DELIMITER '|')")
    return engine.sql("SELECT * FROM n")


# projections and filters

query("project_expr", "SELECT p_partkey, p_size + 1 AS next_size, round(p_retailprice * 2, 2) AS twice FROM part")(
    lambda t: t.part.select("p_partkey", (C("p_size") + 1).alias("next_size"), money(C("p_retailprice") * 2).alias("twice")),
)
query("project_alias", "SELECT p_partkey AS k, p_name AS label FROM part WHERE p_size > 10")(
    lambda t: t.part.where("p_size > 10").select(C("p_partkey").alias("k"), C("p_name").alias("label")),
)
query("project_qualified_star", "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name <> 'ASIA'")(
    lambda t: join(t.nation.alias("n"), t.region.alias("r"), C("n_regionkey") == C("r_regionkey")).where("r_name <> 'ASIA'").select("n.*"),
)
query("table_alias", "SELECT x.s_suppkey, x.s_name FROM supplier AS x WHERE x.s_acctbal > 0")(
    lambda t: t.supplier.alias("x").where("x.s_acctbal > 0").select("x.s_suppkey", "x.s_name"),
)
query("filter_cmp", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03 AND l_returnflag <> 'A'")(
    lambda t: t.lineitem.where((C("l_quantity") >= 45) & (C("l_discount") < 0.03) & (C("l_returnflag") != "A")).select("l_orderkey", "l_linenumber", "l_quantity"),
)
query("filter_logic", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 5 OR l_quantity > 48) AND NOT (l_linestatus = 'O')")(
    lambda t: t.lineitem.where(((C("l_quantity") < 5) | (C("l_quantity") > 48)) & ~(C("l_linestatus") == "O")).select("l_orderkey", "l_linenumber"),
)
query("filter_null", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 WHERE o.o_orderkey IS NULL")(
    lambda t: join(t.customer, t.orders.where("o_totalprice > 300000"), C("c_custkey") == C("o_custkey"), "left").where(C("o_orderkey").isNull()).select("c_custkey", "o_orderkey"),
)
query("filter_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')")(
    lambda t: t.orders.where(C("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~C("o_orderstatus").isin("P")).select("o_orderkey", "o_orderpriority"),
)
query("filter_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND p_name NOT LIKE '_a%'")(
    lambda t: t.part.where(C("p_type").like("%A%") & ~C("p_name").like("_a%")).select("p_partkey", "p_type"),
)
query("filter_datetime", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '1996-12-31 12:00:00'")(
    lambda t: t.orders.where("o_orderdate > '1995-01-01 00:00:00' AND o_orderdate <= '1996-12-31 12:00:00'").select("o_orderkey"),
)

# joins

query("join_inner_equi", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")(
    lambda t: join(t.orders, t.customer, C("o_custkey") == C("c_custkey")).select("o_orderkey", "c_name"),
)
query("join_multi_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 40")(
    lambda t: join(t.lineitem.where("l_quantity > 40").select("l_orderkey", "l_linenumber"), t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"]),
)
query("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")(
    lambda t: join(t.customer, t.orders, C("c_custkey") == C("o_custkey"), "left").select("c_custkey", "o_orderkey"),
)
query("join_right", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey")(
    lambda t: join(t.orders, t.customer, C("c_custkey") == C("o_custkey"), "right").select("o_orderkey", "c_custkey"),
)
query("join_full", "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey - 5")(
    lambda t: join(t.supplier, t.customer, C("s_suppkey") == C("c_custkey") - 5, "full").select("s_suppkey", "c_custkey"),
)
query("join_equi_residual", "SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20")(
    lambda t: join(t.orders, t.customer, (C("o_custkey") == C("c_custkey")) & (C("o_totalprice") > C("c_acctbal") * 20)).select("o_orderkey", "c_custkey"),
)
query("join_left_residual", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000")(
    lambda t: join(t.customer, t.orders, (C("o_custkey") == C("c_custkey")) & (C("o_totalprice") > 200000), "left").select("c_custkey", "o_orderkey"),
)
query("join_full_residual", "SELECT s.s_suppkey, n.n_nationkey FROM supplier s FULL JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 0")(
    lambda t: join(t.supplier, t.nation, (C("s_nationkey") == C("n_nationkey")) & (C("s_acctbal") > 0), "full").select("s_suppkey", "n_nationkey"),
)
query("join_theta", "SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_regionkey > r.r_regionkey")(
    lambda t: theta_join(t.nation, t.region, C("n_regionkey") > C("r_regionkey")).select("n_nationkey", "r_regionkey"),
)
query("join_const_pred", "SELECT n.n_nationkey, r.r_name FROM nation n JOIN region r ON n.n_regionkey = 1")(
    lambda t: theta_join(t.nation, t.region, C("n_regionkey") == 1).select("n_nationkey", "r_name"),
)
query("join_left_theta", "SELECT s.s_suppkey, r.r_regionkey FROM supplier s LEFT JOIN region r ON s.s_nationkey < r.r_regionkey")(
    lambda t: theta_join(t.supplier, t.region, C("s_nationkey") < C("r_regionkey"), "left").select("s_suppkey", "r_regionkey"),
)
query("join_right_theta", "SELECT r.r_regionkey, s.s_suppkey FROM region r RIGHT JOIN supplier s ON s.s_nationkey < r.r_regionkey")(
    lambda t: theta_join(t.region, t.supplier, C("s_nationkey") < C("r_regionkey"), "right").select("r_regionkey", "s_suppkey"),
)
query("join_full_theta", "SELECT n.n_nationkey, r.r_regionkey FROM nation n FULL JOIN region r ON n.n_nationkey < r.r_regionkey")(
    lambda t: theta_join(t.nation, t.region, C("n_nationkey") < C("r_regionkey"), "full").select("n_nationkey", "r_regionkey"),
)
query("join_cross", "SELECT n.n_name, r.r_name FROM nation n CROSS JOIN region r")(
    lambda t: join(t.nation, t.region, None, "cross").select("n_name", "r_name"),
)
query("join_three_way", "SELECT s.s_suppkey, n.n_name, r.r_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")(
    lambda t: join(join(t.supplier, t.nation, C("s_nationkey") == C("n_nationkey")), t.region, C("n_regionkey") == C("r_regionkey")).select("s_suppkey", "n_name", "r_name"),
)
query("join_subquery", "SELECT n.n_name, s.n_suppliers FROM nation n JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY s_nationkey) AS s ON n.n_nationkey = s.s_nationkey")(
    lambda t: join(t.nation, aggregate(t.supplier, ["s_nationkey"], F.count("*").alias("n_suppliers")), C("n_nationkey") == C("s_nationkey")).select("n_name", "n_suppliers"),
)

# aggregation

query("agg_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price FROM lineitem")(
    lambda t: aggregate(t.lineitem, [], F.count("*").alias("n"), money(F.sum("l_quantity")).alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("price")),
)
query("agg_global_empty", "SELECT count(*) AS n, sum(l_quantity) AS qty, max(l_shipdate) AS last FROM lineitem WHERE l_quantity < 0")(
    lambda t: aggregate(t.lineitem.where("l_quantity < 0"), [], F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.max("l_shipdate").alias("last")),
)
query("agg_group_by", "SELECT l_returnflag, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem GROUP BY l_returnflag")(
    lambda t: aggregate(t.lineitem, ["l_returnflag"], money(F.sum("l_quantity")).alias("qty"), F.count("*").alias("n")),
)
query("agg_group_multi", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus")(
    lambda t: aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], money(F.sum(C("l_extendedprice") * (1 - C("l_discount")))).alias("revenue")),
)
query("agg_group_expr", "SELECT p_size % 5 AS k, count(*) AS n FROM part GROUP BY p_size % 5")(
    lambda t: aggregate(t.part, [(C("p_size") % 5).alias("k")], F.count("*").alias("n")),
)
query("agg_group_alias", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY status")(
    lambda t: aggregate(t.orders.withColumnRenamed("o_orderstatus", "status"), ["status"], F.count("*").alias("n")),
)
query("agg_group_null", "SELECT nullif(p_size, 1) AS size, count(*) AS n FROM part GROUP BY nullif(p_size, 1)")(
    lambda t: aggregate(t.part, [F.nullif(C("p_size"), F.lit(1)).alias("size")], F.count("*").alias("n")),
)
query("agg_count", "SELECT count(*) AS n, count(nullif(p_size, 1)) AS known FROM part")(
    lambda t: aggregate(t.part, [], F.count("*").alias("n"), F.count(F.nullif(C("p_size"), F.lit(1))).alias("known")),
)
query("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")(
    lambda t: aggregate(t.lineitem, ["l_returnflag"], F.count_distinct("l_partkey").alias("parts")),
)
query("agg_sum", "SELECT CAST(sum(p_size) AS BIGINT) AS sizes FROM part")(lambda t: aggregate(t.part, [], F.sum("p_size").alias("sizes")))
query("agg_sum_distinct", "SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS sizes FROM part")(
    lambda t: aggregate(t.part, [], F.sum_distinct(C("p_size")).alias("sizes")),
)
query("agg_avg", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS price FROM orders GROUP BY o_orderpriority")(
    lambda t: aggregate(t.orders, ["o_orderpriority"], F.round(F.avg("o_totalprice"), 4).alias("price")),
)
query("agg_min_max", "SELECT event_type, min(ts) AS first_ts, max(ts) AS last_ts, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")(
    lambda t: aggregate(t.events, ["event_type"], F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("value").alias("low"), F.max("value").alias("high")),
)
query("agg_expr", "SELECT count(*) + 1 AS more, -count(*) AS less, CAST(sum(p_size) + max(p_partkey) AS BIGINT) AS both FROM part")(
    lambda t: aggregate(t.part, [], (F.count("*") + 1).alias("more"), (-F.count("*")).alias("less"), (F.sum("p_size") + F.max("p_partkey")).alias("both")),
)
query("agg_of_expr", "SELECT round(sum(l_quantity * 2 + l_tax), 2) AS x FROM lineitem")(
    lambda t: aggregate(t.lineitem, [], money(F.sum(C("l_quantity") * 2 + C("l_tax"))).alias("x")),
)
query("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")(
    lambda t: having(aggregate(t.orders, ["o_custkey"], F.count("*").alias("n")), C("n") > 12),
)
query("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")(
    lambda t: distinct(t.orders, "o_orderstatus", "o_orderpriority"),
)
query("distinct_agg", "SELECT DISTINCT count(*) AS n FROM nation GROUP BY n_regionkey")(
    lambda t: distinct(aggregate(t.nation, ["n_regionkey"], F.count("*").alias("n")), "n"),
)

# order

query("sort_multi", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey ASC, c_acctbal DESC, c_custkey")(
    lambda t: sort(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), C("c_nationkey").asc(), C("c_acctbal").desc(), "c_custkey"),
)


@query("sort_nulls", "SELECT p_partkey, nullif(p_size, 7) AS size, row_number() OVER (ORDER BY nullif(p_size, 7) ASC NULLS FIRST, p_partkey) AS place FROM part")
def sort_nulls(t: Tables) -> DataFrame:
    return ranked(t.part.select("p_partkey", F.nullif(C("p_size"), F.lit(7)).alias("size")), C("size").asc(), "p_partkey")


@query("sort_nulls_last", "SELECT p_partkey, nullif(p_size, 1) AS size, row_number() OVER (ORDER BY nullif(p_size, 1) ASC NULLS LAST, p_partkey) AS place FROM part")
def sort_nulls_last(t: Tables) -> DataFrame:
    return ranked(t.part.select("p_partkey", F.nullif(C("p_size"), F.lit(1)).alias("size")), C("size").asc_nulls_last(), "p_partkey")


@query("sort_alias", "SELECT o_custkey AS cust, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS place FROM orders GROUP BY o_custkey")
def sort_alias(t: Tables) -> DataFrame:
    return ranked(aggregate(t.orders, [C("o_custkey").alias("cust")], F.count("*").alias("n")), C("n").desc(), "cust")


query("limit_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20")(
    lambda t: limit(sort(t.customer.select("c_custkey", "c_name"), "c_custkey"), 10, 20),
)
query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")(
    lambda t: top_k(t.orders.select("o_orderkey", "o_totalprice"), 25, C("o_totalprice").desc(), "o_orderkey"),
)

# expressions

query("expr_arith", "SELECT l_orderkey, l_linenumber, l_linenumber + 2 - 1 AS a, l_linenumber * 3 AS b, round(l_extendedprice - l_quantity, 4) AS c FROM lineitem")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", (C("l_linenumber") + 2 - 1).alias("a"), (C("l_linenumber") * 3).alias("b"), F.round(C("l_extendedprice") - C("l_quantity"), 4).alias("c")),
)
query("expr_div", "SELECT p_partkey, round(CAST(p_size AS DOUBLE) / 7, 6) AS a, round(p_retailprice / nullif(CAST(p_size - 1 AS DOUBLE), 0), 6) AS b FROM part")(
    lambda t: t.part.select("p_partkey", F.round(C("p_size") / 7, 6).alias("a"), F.round(compat.divide(C("p_retailprice"), C("p_size") - 1), 6).alias("b")),
)
query("expr_unary", "SELECT c_custkey, -c_acctbal AS minus, +c_nationkey AS plus FROM customer")(
    lambda t: t.customer.select("c_custkey", (-C("c_acctbal")).alias("minus"), C("c_nationkey").alias("plus")),
)
query("expr_not", "SELECT p_partkey, NOT (p_size > 25) AS small FROM part")(
    lambda t: t.part.select("p_partkey", (~(C("p_size") > 25)).alias("small")),
)
query("expr_mod", "SELECT p_partkey, p_partkey % 7 AS m FROM part")(lambda t: t.part.select("p_partkey", (C("p_partkey") % 7).alias("m")))
query("expr_xor", "SELECT p_partkey, (p_size > 25) <> (p_retailprice > 1000) AS x FROM part")(
    lambda t: t.part.select("p_partkey", compat.xor(C("p_size") > 25, C("p_retailprice") > 1000).alias("x")),
)
query("expr_concat", "SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS VARCHAR) AS label FROM nation")(
    lambda t: t.nation.select("n_nationkey", F.concat("n_name", F.lit("-"), C("n_regionkey").cast("string")).alias("label")),
)
query("expr_cast", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) AS k, CAST(o_orderdate AS DATE) AS d, CAST(o_custkey AS DOUBLE) AS x FROM orders")(
    lambda t: t.orders.select("o_orderkey", C("o_orderkey").cast("string").alias("s"), C("o_orderkey").cast("string").cast("bigint").alias("k"), C("o_orderdate").cast("date").alias("d"), C("o_custkey").cast("double").alias("x")),
)
query("expr_null_safe_eq", "SELECT p_partkey, nullif(p_size, 1) IS NOT DISTINCT FROM nullif(p_size, 2) AS same FROM part")(
    lambda t: t.part.select("p_partkey", compat.equal_with_nulls(F.nullif(C("p_size"), F.lit(1)), F.nullif(C("p_size"), F.lit(2))).alias("same")),
)

# subqueries

query("subquery_from", "SELECT x.c_custkey, x.rich FROM (SELECT c_custkey, c_acctbal > 5000 AS rich FROM customer WHERE c_nationkey < 10) AS x WHERE x.rich")(
    lambda t: t.customer.where("c_nationkey < 10").select("c_custkey", (C("c_acctbal") > 5000).alias("rich")).where("rich"),
)
query("subquery_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)")(
    lambda t: join(t.orders, aggregate(t.orders, [], (1.5 * F.avg("o_totalprice")).alias("bound")), None, "cross").where("o_totalprice > bound").select("o_orderkey"),
)


# changes: the table's state after the statement, by the engine itself


def _engine(t: Tables, name: str, ddl: str, source: DataFrame):
    from larkspur.scratch import scratch_dir
    from larkspur.session import Engine

    engine = Engine(t.spark, f"{scratch_dir(t.spark)}/db")
    engine.sql(f"CREATE TABLE {name} ({ddl})")
    engine.append(name, source)
    return engine


_SUPPLIER = "s_suppkey BIGINT PRIMARY KEY, s_name VARCHAR(40) NOT NULL, s_nationkey INT, s_acctbal DOUBLE"


@query("dml_insert", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT * FROM (VALUES (-1::BIGINT, 'new one', 3, NULL::DOUBLE), (-2::BIGINT, 'new two', NULL, 7.5::DOUBLE)) v")
def dml_insert(t: Tables) -> DataFrame:
    engine = _engine(t, "supplier", _SUPPLIER, t.supplier)
    engine.sql("INSERT INTO supplier VALUES (-1, 'new one', 3), (-2, 'new two', NULL, 7.5)")
    return engine.sql("SELECT * FROM supplier")


@query("dml_upsert", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (1, 2) UNION ALL SELECT * FROM (VALUES (1::BIGINT, 'first', 1, 1.0::DOUBLE), (2::BIGINT, 'second', 2, 2.0::DOUBLE), (-5::BIGINT, 'new', 3, 3.0::DOUBLE)) v")
def dml_upsert(t: Tables) -> DataFrame:
    engine = _engine(t, "supplier", _SUPPLIER, t.supplier)
    engine.sql("INSERT OVERWRITE supplier VALUES (1, 'first', 1, 1.0), (2, 'second', 2, 2.0), (-5, 'new', 3, 3.0)")
    return engine.sql("SELECT * FROM supplier")


@query("dml_update", "SELECT p_partkey, p_name, CASE WHEN p_size > 20 THEN p_size + 100 ELSE p_size END AS p_size FROM part")
def dml_update(t: Tables) -> DataFrame:
    engine = _engine(t, "part", "p_partkey BIGINT PRIMARY KEY, p_name VARCHAR, p_size INT", t.part.select("p_partkey", "p_name", "p_size"))
    engine.sql("UPDATE part SET p_size = p_size + 100 WHERE p_size > 20")
    return engine.sql("SELECT * FROM part")


@query("dml_delete", "SELECT p_partkey, p_size FROM part WHERE NOT (p_size BETWEEN 10 AND 30)")
def dml_delete(t: Tables) -> DataFrame:
    engine = _engine(t, "part", "p_partkey BIGINT PRIMARY KEY, p_size INT", t.part.select("p_partkey", "p_size"))
    engine.sql("DELETE FROM part WHERE p_size >= 10 AND p_size <= 30")
    return engine.sql("SELECT * FROM part")


@query("sql_select", "SELECT n.n_name AS name, count(*) AS n, round(sum(c.c_acctbal), 2) AS total FROM nation n JOIN customer c ON n.n_nationkey = c.c_nationkey WHERE c.c_acctbal > 0 GROUP BY n.n_name HAVING count(*) > 2 ORDER BY total DESC LIMIT 12")
def sql_select(t: Tables) -> DataFrame:
    """A whole SELECT through the engine's SQL."""
    engine = _engine(t, "nation", "n_nationkey INT PRIMARY KEY, n_name VARCHAR, n_regionkey INT", t.nation)
    engine.sql("CREATE TABLE customer (c_custkey BIGINT PRIMARY KEY, c_nationkey INT, c_acctbal DOUBLE)")
    engine.append("customer", t.customer.select("c_custkey", "c_nationkey", "c_acctbal"))
    return engine.sql("SELECT n.n_name AS name, count(*) AS n, round(sum(c.c_acctbal), 2) AS total FROM nation n JOIN customer c ON n.n_nationkey = c.c_nationkey WHERE c.c_acctbal > 0 GROUP BY n.n_name HAVING count(*) > 2 ORDER BY total DESC LIMIT 12")


@query("flagship", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 1 ORDER BY l_returnflag, l_linestatus LIMIT 10")
def flagship(t: Tables) -> DataFrame:
    """Pushed filter, pruned scan, partial and final aggregation, having, top-k."""
    net = C("l_extendedprice") * (1 - C("l_discount"))
    grouped = aggregate(t.lineitem.where("l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'"), ["l_returnflag", "l_linestatus"], money(F.sum("l_quantity")).alias("sum_qty"), money(F.sum("l_extendedprice")).alias("sum_base"), money(F.sum(net)).alias("sum_disc"), money(F.sum(net * (1 + C("l_tax")))).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n"))
    return top_k(having(grouped, C("n") > 1), 10, "l_returnflag", "l_linestatus")
