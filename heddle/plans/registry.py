"""Every query of the relational, matrix and graph layers with its SQL counterpart.

QUERIES: name -> (spark, folder) -> DataFrame. ORACLES: the same rows in ANSI SQL.
All run over whole tables. Sums of doubles go through exact decimals or rounding, so
that no engine's order of summation shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import fused, graph, matrix, relational
from heddle.plans import strategy
from heddle.plans.engine import Engine
from heddle.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _money(x: str) -> str:
    """Exact sum of a double with up to four decimals."""
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,4))) AS DOUBLE)"


def _sql(name: str, query: str, oracle: str | None = None) -> None:
    """A query given as SQL; oracle: where the other engine needs other words."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        engine = Engine(spark)
        words = query.lower()
        engine.create_parquet(folder, [t for t in tables.NAMES if t in words])
        return engine.sql(query)

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, oracle or query


def _built(oracle: str | None):
    """A query built from the library's operators."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _read(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [tables.read_parquet(spark, folder, n) for n in names]


# Scans, filters and projections -----------------------------------------------------------------

_L = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE "
_sql("scan_filter_and", _L + "l_quantity > 45 AND l_discount >= 0.05 AND l_returnflag = 'R'")
_sql("scan_filter_or", _L + "l_quantity <= 2 OR l_discount > 0.09 OR l_linestatus = 'X'")
_sql("scan_filter_nested", _L + "(l_quantity < 5 AND (l_returnflag = 'A' OR l_linestatus = 'O')) OR (l_quantity > 48 AND NOT (l_discount < 0.05))")
_sql("filter_neq", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority != '1-URGENT'")
_sql("filter_float_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000.5 AND o_totalprice < 250000")
_sql("filter_string_eq", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
_sql("filter_string_order", "SELECT p_partkey, p_brand FROM part WHERE p_brand > 'Brand#2' AND p_brand <= 'Brand#4'")
_sql("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE '%STEEL%'")
_sql("filter_in", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 4)")
_sql("filter_in_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
_sql("filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 1000 AND 1200")
_sql("filter_not", "SELECT s_suppkey FROM supplier WHERE NOT (s_acctbal > 0 OR s_nationkey = 3)")
_sql("filter_is_null", "SELECT c.c_custkey, o.o_orderkey IS NULL AS without_order FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL OR o.o_orderstatus IS NOT NULL")
_sql("filter_col_vs_col", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey OR l_discount > l_tax")
_sql("filter_any_all", "SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_size < 20) OR p_size + 1 < ANY (SELECT s_nationkey FROM supplier) OR p_partkey = SOME (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_linenumber = 7)")
_sql("filter_regexp", "SELECT p_partkey, p_brand FROM part WHERE REGEXP_LIKE(p_brand, '^Brand#[12][0-9]*$')", "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '^Brand#[12][0-9]*$')")
_sql("filter_nan", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE isnan(CAST(CASE WHEN l_linenumber = 3 THEN 'NaN' ELSE '1' END AS DOUBLE)) AND NOT isnan(CAST(l_quantity AS DOUBLE))")
_sql("select_star", "SELECT * FROM nation")
_sql("select_qualified_star", "SELECT n.* FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_name <> 'ASIA'")
_sql("project_arith", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, -l_quantity AS minus_quantity, (l_quantity + 1) - 2 AS shifted, l_extendedprice / l_quantity AS unit FROM lineitem")
_sql(
    "project_case_cast",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS status, CAST(o_orderkey AS DOUBLE) AS as_double, CAST(o_custkey AS VARCHAR(20)) AS as_text FROM orders",
)
_sql("project_concat_pow", "SELECT n_nationkey, n_name || '/' || n_regionkey AS path, CAST(POWER(n_nationkey, 2) AS DOUBLE) AS squared FROM nation")
_sql("project_safe_divide", "SELECT l_orderkey, l_linenumber, l_extendedprice / NULLIF(l_tax, 0) AS ratio FROM lineitem")

_sql("project_strings", "SELECT p_partkey, UPPER(p_name) AS loud, LENGTH(p_name) AS n, SUBSTRING(p_brand, 7, 2) AS number, REPLACE(p_type, ' ', '_') AS type, TRIM(CONCAT(' ', p_brand, ' ')) AS brand, LPAD(CAST(p_size AS VARCHAR(9)), 4, '0') AS padded FROM part")
_sql("project_math", "SELECT o_orderkey, ABS(o_totalprice - 100000) AS off, CAST(FLOOR(o_totalprice / 1000) AS BIGINT) AS thousands, ROUND(SQRT(o_totalprice), 6) AS root, ROUND(LN(o_totalprice), 6) AS log, GREATEST(o_custkey, o_orderkey) AS top FROM orders")
_sql("project_json", "SELECT event_id, GET_JSON_OBJECT(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")

# Joins --------------------------------------------------------------------------------------------

_sql("join_inner_2way", "SELECT o.o_totalprice, l.l_quantity FROM orders o, lineitem l WHERE o.o_orderkey = l.l_orderkey")
_sql("join_explicit_on", "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
_sql("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT OUTER JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'")
_sql("join_right", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT OUTER JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000")
_sql("join_full", "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey AND s.s_nationkey = c.c_nationkey")
_sql("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
_sql("join_using", "SELECT k, a.n_name, b.r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)")
_sql("join_natural", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b")
_sql("join_composite", "SELECT a.l_orderkey, a.l_linenumber, b.n FROM lineitem a JOIN (SELECT l_partkey, l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey")
_sql("join_theta", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey < r.r_regionkey AND n.n_nationkey > 3 * r.r_regionkey")
_sql("join_self", "SELECT a.n_name AS n_name, b.n_name AS neighbour FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
_sql("join_semi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O')")
_sql("join_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' AND o.o_totalprice > 200000)")
_sql("join_multiway", "SELECT l.l_orderkey, l.l_linenumber, c.c_name, n.n_name, r.r_name FROM lineitem l, orders o, customer c, nation n, region r WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey AND l.l_quantity > 49")


@_built(f"SELECT n.n_name, p.p_brand, {_money('l.l_extendedprice')} AS revenue, COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey WHERE s.s_acctbal > 0 GROUP BY n.n_name, p.p_brand")
def star_join_agg(spark: SparkSession, folder: str) -> DataFrame:
    line, orders, customer, nation, supplier, part = _read(spark, folder, "lineitem", "orders", "customer", "nation", "supplier", "part")
    supplier = supplier.filter("s_acctbal > 0")
    joined = relational.star_join(line, [(supplier, line.l_suppkey == supplier.s_suppkey), (part, line.l_partkey == part.p_partkey)])
    joined = joined.join(orders, joined.l_orderkey == orders.o_orderkey)
    joined = relational.star_join(joined, [(customer, orders.o_custkey == customer.c_custkey), (nation, customer.c_nationkey == nation.n_nationkey)])
    return joined.groupBy("n_name", "p_brand").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double").alias("revenue"), F.count("*").alias("n"))


@_built("SELECT a.s_suppkey AS a_s_suppkey, a.s_nationkey AS a_s_nationkey, b.c_custkey AS b_c_custkey, b.c_nationkey AS b_c_nationkey FROM supplier a JOIN customer b ON a.s_nationkey = b.c_nationkey AND a.s_suppkey = b.c_custkey")
def entity_match_keys(spark: SparkSession, folder: str) -> DataFrame:
    supplier, customer = _read(spark, folder, "supplier", "customer")
    found = relational.entity_match(supplier.withColumnRenamed("s_suppkey", "k").withColumnRenamed("s_nationkey", "n"), customer.withColumnRenamed("c_custkey", "k").withColumnRenamed("c_nationkey", "n"), {"k": "k", "n": "n"}, ["k", "n"])
    return found.toDF("a_s_suppkey", "a_s_nationkey", "b_c_custkey", "b_c_nationkey")


@_built("SELECT a.p_partkey AS a_p_partkey, a.p_brand AS a_p_brand, b.p_partkey AS b_p_partkey, b.p_brand AS b_p_brand FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size")
def entity_match_name(spark: SparkSession, folder: str) -> DataFrame:
    (part,) = _read(spark, folder, "part")
    on = {c: c for c in ("p_name", "p_brand", "p_type", "p_size")}
    return relational.entity_match(part, part, on, ["p_partkey", "p_brand"])


@_built("SELECT CAST(SUM(a.n * b.n) AS BIGINT) AS join_count FROM (SELECT p_type AS k, COUNT(*) AS n FROM part GROUP BY 1) a JOIN (SELECT p_type AS k, COUNT(*) AS n FROM part GROUP BY 1) b USING (k)")
def entity_match_low_selectivity(spark: SparkSession, folder: str) -> DataFrame:
    """How many pairs a match on a column of few values has, without making them."""
    (part,) = _read(spark, folder, "part")
    return fused.join_count(part, part, "p_type")


@_built("SELECT s.r_regionkey, p.p_partkey, p.p_retailprice FROM part p JOIN (SELECT r_regionkey, 900.0 + 250 * r_regionkey AS lo, 1250.0 + 250 * r_regionkey AS hi FROM region) s ON p.p_retailprice >= s.lo AND p.p_retailprice < s.hi")
def join_interval(spark: SparkSession, folder: str) -> DataFrame:
    part, region = _read(spark, folder, "part", "region")
    spans = region.select("r_regionkey", (900.0 + 250 * F.col("r_regionkey")).alias("lo"), (1250.0 + 250 * F.col("r_regionkey")).alias("hi"))
    return relational.interval_join(part, spans, "p_retailprice", "lo", "hi", 250.0).select("r_regionkey", "p_partkey", "p_retailprice")


@_built("SELECT a.o_orderkey, a.o_custkey, b.o_orderkey AS of_o_orderkey, b.o_totalprice AS of_o_totalprice FROM orders a ASOF LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') b ON a.o_custkey = b.o_custkey AND a.o_orderkey >= b.o_orderkey")
def join_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """Each order with its customer's last finished one up to it."""
    (orders,) = _read(spark, folder, "orders")
    return relational.as_of_join(orders.select("o_orderkey", "o_custkey"), orders.filter("o_orderstatus = 'F'"), "o_custkey", "o_orderkey", ["o_orderkey", "o_totalprice"])


# Aggregates ---------------------------------------------------------------------------------------

_sql("agg_sum", f"SELECT l_returnflag, l_linestatus, {_money('l_quantity')} AS sum_qty, {_money('l_extendedprice')} AS sum_price FROM lineitem GROUP BY l_returnflag, l_linestatus")
_sql("agg_sum_int", "SELECT p_brand, CAST(SUM(p_size) AS BIGINT) AS sizes FROM part GROUP BY p_brand")
_sql("agg_avg", "SELECT l_returnflag, ROUND(AVG(l_quantity), 6) AS avg_qty, ROUND(AVG(l_extendedprice * (1 - l_discount)), 4) AS avg_net FROM lineitem GROUP BY l_returnflag")
_sql("agg_count", "SELECT o_orderstatus, COUNT(*) AS n, COUNT(o_custkey) AS n_cust FROM orders GROUP BY o_orderstatus")
_sql("agg_min_max", "SELECT p_brand, MIN(p_retailprice) AS lo, MAX(p_retailprice) AS hi, MIN(p_type) AS first_type, MAX(p_size) AS top_size FROM part GROUP BY p_brand")
_sql("agg_count_distinct", "SELECT l_returnflag, COUNT_DISTINCT(l_suppkey) AS suppliers, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
_sql("agg_global", f"SELECT COUNT(*) AS n, {_money('o_totalprice')} AS total, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders")
_sql("agg_having", f"SELECT o_custkey, COUNT(*) AS n, {_money('o_totalprice')} AS total FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 12 AND SUM(o_totalprice) > 100000")
_sql("agg_expr", "SELECT l_returnflag, ROUND(SUM(l_extendedprice * l_discount) / COUNT(*), 4) AS mean_cut, ROUND(SUM(l_tax) / SUM(l_discount), 6) AS ratio FROM lineitem GROUP BY l_returnflag")
_sql("agg_group_expr", "SELECT l_partkey % 10 AS bucket, l_quantity > 25 AS many, COUNT(*) AS n FROM lineitem GROUP BY l_partkey % 10, l_quantity > 25")
_sql("agg_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("agg_grouping_sets", "SELECT p_brand, p_type, COUNT(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
_sql("distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
_sql("agg_percentile", "SELECT l_returnflag, ROUND(PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY l_extendedprice), 6) AS middle, ROUND(PERCENTILE_CONT(0.9) WITHIN GROUP (ORDER BY l_quantity), 6) AS high FROM lineitem GROUP BY l_returnflag")
_sql("agg_statistics", "SELECT p_type, ROUND(STDDEV_SAMP(p_retailprice), 4) AS deviation, ROUND(VAR_POP(p_retailprice), 3) AS variance FROM part GROUP BY p_type")


@_built("SELECT COUNT(*) AS group_count FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def agg_group_count(spark: SparkSession, folder: str) -> DataFrame:
    return fused.group_count(*_read(spark, folder, "lineitem"), ["l_partkey", "l_suppkey"])


# Joins with sums on top ---------------------------------------------------------------------------

_LO = "lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"


def _line_orders(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    line, orders = _read(spark, folder, "lineitem", "orders")
    return line.withColumnRenamed("l_orderkey", "k"), orders.withColumnRenamed("o_orderkey", "k")


def _dec(x: str):
    return F.expr(f"CAST({x} AS DECIMAL(18,4))")


def _as_double(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


@_built(f"SELECT o.o_orderpriority, {_money('l.l_quantity')} AS total FROM {_LO} GROUP BY o.o_orderpriority")
def join_groupby_right(spark: SparkSession, folder: str) -> DataFrame:
    return _as_double(fused.join_sum(*_line_orders(spark, folder), "k", _dec("l_quantity"), right_groups=["o_orderpriority"]), "total")


@_built(f"SELECT l.l_returnflag, {_money('l.l_quantity')} AS total FROM {_LO} GROUP BY l.l_returnflag")
def join_groupby_left(spark: SparkSession, folder: str) -> DataFrame:
    return _as_double(fused.join_sum(*_line_orders(spark, folder), "k", _dec("l_quantity"), left_groups=["l_returnflag"]), "total")


@_built(f"SELECT l.l_returnflag, o.o_orderstatus, {_money('l.l_quantity')} AS total FROM {_LO} GROUP BY l.l_returnflag, o.o_orderstatus")
def join_groupby_both(spark: SparkSession, folder: str) -> DataFrame:
    return _as_double(fused.join_sum(*_line_orders(spark, folder), "k", _dec("l_quantity"), ["l_returnflag"], ["o_orderstatus"]), "total")


@_built("SELECT CAST(SUM(CAST(l.l_quantity AS BIGINT) * o.o_custkey) AS BIGINT) AS total FROM " + _LO)
def join_sum_product(spark: SparkSession, folder: str) -> DataFrame:
    line, orders = _line_orders(spark, folder)
    return fused.join_sum_product(line, orders, "k", F.col("l_quantity").cast("long"), F.col("o_custkey"))


@_built("SELECT CAST(SUM(CAST(a.l_linenumber AS BIGINT) * b.l_linenumber) AS BIGINT) AS total FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey")
def join_sum_product_many(spark: SparkSession, folder: str) -> DataFrame:
    """Sum over a many-to-many join whose pairs are never made."""
    (line,) = _read(spark, folder, "lineitem")
    return fused.join_sum_product(line, line, "l_suppkey", F.col("l_linenumber").cast("long"), F.col("l_linenumber").cast("long"))


@_built(f"SELECT COUNT(*) AS join_count FROM {_LO}")
def join_count(spark: SparkSession, folder: str) -> DataFrame:
    return fused.join_count(*_line_orders(spark, folder), "k")


@_built(f"SELECT {_money('l.l_quantity * l.l_linenumber')} AS total FROM {_LO} WHERE o.o_orderstatus = 'F'")
def ssb_q1_shape(spark: SparkSession, folder: str) -> DataFrame:
    line, orders = _line_orders(spark, folder)
    return _as_double(fused.join_sum(line, orders.filter("o_orderstatus = 'F'"), "k", _dec("l_quantity * l_linenumber")), "total")


@_built(f"SELECT l.l_linestatus, o.o_orderpriority, {_money('l.l_extendedprice - l.l_quantity')} AS total FROM {_LO} GROUP BY l.l_linestatus, o.o_orderpriority")
def ssb_q4_shape(spark: SparkSession, folder: str) -> DataFrame:
    return _as_double(fused.join_sum(*_line_orders(spark, folder), "k", _dec("l_extendedprice - l_quantity"), ["l_linestatus"], ["o_orderpriority"]), "total")


@_built(f"SELECT ROUND(SUM(CAST(0.85 AS DOUBLE) * l.l_quantity / o.o_totalprice), 6) AS total FROM {_LO}")
def join_sum_ratio(spark: SparkSession, folder: str) -> DataFrame:
    found = fused.join_sum_ratio(*_line_orders(spark, folder), "k", F.col("l_quantity"), F.col("o_totalprice"), 0.85)
    return found.select(F.round("total", 6).alias("total"))


# Order, limits, sets, sub-queries ------------------------------------------------------------------


@_built("SELECT CAST(ROW_NUMBER() OVER (ORDER BY o_orderpriority ASC, o_totalprice DESC, o_orderkey) AS BIGINT) AS place, o_orderkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') x ORDER BY o_orderpriority ASC, o_totalprice DESC, o_orderkey")
def order_by_two_keys(spark: SparkSession, folder: str) -> DataFrame:
    (orders,) = _read(spark, folder, "orders")
    some = orders.filter("o_orderstatus = 'P'").select("o_orderpriority", "o_totalprice", "o_orderkey")
    placed = graph.numbered(some, "o_orderpriority", F.desc("o_totalprice"), "o_orderkey", name="place")
    return placed.select((F.col("place") + 1).cast("long").alias("place"), "o_orderkey").orderBy("place")


_sql("order_by_alias_desc", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey")
_sql("order_by_expression", "SELECT n_name FROM nation ORDER BY n_regionkey * 10 - n_nationkey, n_name")
_sql("order_nulls", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey ORDER BY o.o_orderkey ASC NULLS LAST, c.c_custkey")
_sql("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_sql("top_k_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 15")
_sql("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
_sql("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
_sql("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
_sql("except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 AND l_linenumber = 1")
_sql("from_subquery", "SELECT t.c_nationkey, t.n FROM (SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey) t WHERE t.n > 3")
_sql("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)")
_sql("correlated_subquery", "SELECT o_orderkey FROM orders o WHERE o_totalprice >= (SELECT MAX(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
_sql("cte", "WITH per AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT n, COUNT(*) AS customers FROM per GROUP BY n")
_sql("window_rank", "SELECT o_orderkey, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS place, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders")

# Statistics ---------------------------------------------------------------------------------------


@_built("SELECT COUNT(DISTINCT k) AS n_distinct, CAST(COUNT(*) // 2 AS BIGINT) AS mean_rows FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey AS k FROM customer)")
def join_key_stats(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = _read(spark, folder, "orders", "customer")
    return tables.join_key_stats(orders, customer, "o_custkey", "c_custkey")


@_built(" UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT({c}) AS n, COUNT(DISTINCT {c}) AS n_distinct, CAST(MIN({c}) AS VARCHAR) AS min_value, CAST(MAX({c}) AS VARCHAR) AS max_value FROM part" for c in ("p_partkey", "p_brand", "p_size")))
def column_stats(spark: SparkSession, folder: str) -> DataFrame:
    return tables.column_stats(*_read(spark, folder, "part"), ["p_partkey", "p_brand", "p_size"])


# Matrices -----------------------------------------------------------------------------------------
# Rows: vectors; columns: their components. The product of the transpose with the matrix itself.

_EMB = "SELECT vec_id AS i, UNNEST(range(len(embedding))) AS j, CAST(UNNEST(embedding) AS DOUBLE) AS v FROM embeddings"
_GRAM = f"WITH m AS ({_EMB}) SELECT a.j AS i, b.j AS j, ROUND(SUM(a.v * b.v), 6) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j"
_PS = "SELECT l_suppkey AS i, l_linenumber AS j, CAST(SUM(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2"


def _matrix(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.vectors(*_read(spark, folder, "embeddings"), "vec_id", "embedding")


def _gram(kind: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        m = _matrix(spark, folder)
        return matrix.matmul(matrix.transpose(m), m, kind).select("i", "j", F.round("v", 6).alias("v"))

    run.__name__ = f"matmul_{kind}"
    return run


for _kind in ("sparse", "dense", "blocked", "auto"):
    _built(_GRAM)(_gram(_kind))


@_built(f"WITH m AS ({_PS}) SELECT a.i AS i, b.i AS j, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM m a JOIN m b ON a.j = b.j GROUP BY a.i, b.i")
def matmul_counts(spark: SparkSession, folder: str) -> DataFrame:
    """SUM(A.v * B.v) grouped by both outer indexes, for integer matrices made from a relation."""
    m = matrix.coo(*_read(spark, folder, "lineitem"), "l_suppkey", "l_linenumber", F.col("l_quantity").cast("long"))
    return matrix.matmul(m, matrix.transpose(m), "sparse")


# Join-and-sum and matrix shapes given as SQL; keys repeat on both sides, so the plans are factored (plans/rewrite.py).
_sql(
    "sql_matmul",
    "SELECT a.l_suppkey AS i, b.l_suppkey AS j, CAST(SUM(CAST(a.l_quantity AS BIGINT) * CAST(b.l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem a, lineitem b WHERE a.l_linenumber = b.l_linenumber GROUP BY a.l_suppkey, b.l_suppkey",
    f"WITH m AS ({_PS}) SELECT a.i AS i, b.i AS j, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM m a JOIN m b ON a.j = b.j GROUP BY a.i, b.i",
)
_sql("sql_matmul_cte", f"WITH m AS ({_PS}) SELECT a.j AS i, b.j AS j, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j")
_sql("sql_join_groupby_both", f"SELECT c.c_mktsegment, s.s_nationkey, COUNT(*) AS n, MAX(s.s_suppkey) AS top, {_money('c.c_acctbal')} AS total FROM customer c, supplier s WHERE c.c_nationkey = s.s_nationkey AND s.s_acctbal > 0 GROUP BY c.c_mktsegment, s.s_nationkey")
_sql("sql_join_count", "SELECT COUNT(*) AS n FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey")


@_built(f"WITH m AS ({_PS}) SELECT j AS i, i AS j, v FROM m")
def matrix_transpose(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.transpose(matrix.coo(*_read(spark, folder, "lineitem"), "l_suppkey", "l_linenumber", F.col("l_quantity").cast("long")))


@_built(f"WITH m AS ({_EMB}) SELECT i, ROUND(SUM(v), 6) AS v FROM m GROUP BY i")
def matrix_row_reduce(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.row_sums(_matrix(spark, folder)).select("i", F.round("v", 6).alias("v"))


@_built(f"WITH m AS ({_EMB}) SELECT j, ROUND(SUM(v), 6) AS v FROM m GROUP BY j")
def matrix_column_reduce(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.column_sums(_matrix(spark, folder)).select("j", F.round("v", 6).alias("v"))


@_built(f"WITH m AS ({_EMB}) SELECT COUNT(*) AS nnz FROM m WHERE v <> 0")
def matrix_nnz(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.non_zero(_matrix(spark, folder))


@_built(f"WITH m AS ({_PS}) SELECT MIN(i) AS min_i, MAX(i) AS max_i, MIN(j) AS min_j, MAX(j) AS max_j, MIN(v) AS min_v, MAX(v) AS max_v FROM m")
def matrix_extent(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.extent(matrix.coo(*_read(spark, folder, "lineitem"), "l_suppkey", "l_linenumber", F.col("l_quantity").cast("long")))


_JOINS = [("nation", "region", "n_regionkey", "r_regionkey"), ("supplier", "customer", "s_nationkey", "c_nationkey"), ("lineitem", "orders", "l_orderkey", "o_orderkey")]


@_built(" UNION ALL ".join(f"SELECT '{a}' AS one, CASE WHEN COUNT(DISTINCT k) < 4096 THEN 'dense' ELSE 'sparse' END AS strategy FROM (SELECT {x} AS k FROM {a} UNION ALL SELECT {y} FROM {b})" for a, b, x, y in _JOINS))
def strategy_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The form that the chooser takes for key domains of several sizes."""
    found = []
    for a, b, x, y in _JOINS:
        s = tables.join_key_stats(*_read(spark, folder, a, b), x, y).first()
        found.append((a, strategy.choose(s.n_distinct, s.mean_rows, False).strategy))
    return spark.createDataFrame(found, "one string, strategy string")


# Graphs -------------------------------------------------------------------------------------------
# Parts point at the suppliers that have supplied them; suppliers have ids from 10^9.

_EDGES = "SELECT DISTINCT l_partkey AS src, 1000000000 + l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT 1000000000 + l_suppkey AS src, l_partkey % 7 AS dst FROM lineitem"


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    (line,) = _read(spark, folder, "lineitem")
    there = line.select(F.col("l_partkey").alias("src"), (1000000000 + F.col("l_suppkey")).alias("dst"))
    back = line.select((1000000000 + F.col("l_suppkey")).alias("src"), F.pmod("l_partkey", F.lit(7)).cast("long").alias("dst"))
    return there.union(back).distinct()


@_built(f"WITH e AS ({_EDGES}) SELECT src AS id, COUNT(*) AS degree FROM e GROUP BY src")
def pagerank_outdegree(spark: SparkSession, folder: str) -> DataFrame:
    return graph.out_degree(_edges(spark, folder))


@_built("SELECT p_partkey AS id, COUNT(l_partkey) + 1 AS degree FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey")
def outdegree_smoothed(spark: SparkSession, folder: str) -> DataFrame:
    part, line = _read(spark, folder, "part", "lineitem")
    return graph.out_degree(line.select(F.col("l_partkey").alias("src")), part.select(F.col("p_partkey").alias("id")), 1)


@_built(f"WITH e AS ({_EDGES}), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT id, ROUND(CAST(1 - 0.85 AS DOUBLE) / (SELECT COUNT(*) FROM n), 9) AS ranking FROM n")
def pagerank_init(spark: SparkSession, folder: str) -> DataFrame:
    return graph.initial_ranks(graph.nodes_of(_edges(spark, folder))).select("id", F.round("ranking", 9).alias("ranking"))


@_built(f"WITH e AS ({_EDGES}), d AS (SELECT src AS id, COUNT(*) AS degree FROM e GROUP BY src), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT ROUND(SUM(CAST(0.85 AS DOUBLE) * (CAST(1 - 0.85 AS DOUBLE) / (SELECT COUNT(*) FROM n)) / d.degree), 9) AS ranking FROM n JOIN d USING (id)")
def pagerank_step(spark: SparkSession, folder: str) -> DataFrame:
    edges = _edges(spark, folder)
    found = fused.join_sum_ratio(graph.initial_ranks(graph.nodes_of(edges)), graph.out_degree(edges), "id", F.col("ranking"), F.col("degree"), 0.85, "ranking")
    return found.select(F.round("ranking", 9).alias("ranking"))


def _unrolled(rounds: int) -> str:
    parts = [f"e AS ({_EDGES})", "d AS (SELECT src, COUNT(*) AS degree FROM e GROUP BY src)", "n AS (SELECT src AS id FROM e UNION SELECT dst FROM e)", "r0 AS (SELECT id, CAST(0.15 AS DOUBLE) / (SELECT COUNT(*) FROM n) AS ranking FROM n)"]
    for k in range(rounds):
        parts.append(f"c{k} AS (SELECT e.dst, SUM(r.ranking / d.degree) AS got FROM e JOIN d ON e.src = d.src JOIN r{k} r ON r.id = e.src GROUP BY e.dst)")
        parts.append(f"r{k + 1} AS (SELECT n.id, CAST(0.15 AS DOUBLE) / (SELECT COUNT(*) FROM n) + CAST(0.85 AS DOUBLE) * COALESCE(c.got, 0) AS ranking FROM n LEFT JOIN c{k} c ON n.id = c.dst)")
    return f"WITH {', '.join(parts)} SELECT id, ROUND(ranking, 9) AS ranking FROM r{rounds}"


@_built(_unrolled(4))
def pagerank_k_iter(spark: SparkSession, folder: str) -> DataFrame:
    return graph.pagerank(_edges(spark, folder), 4).select("id", F.round("ranking", 9).alias("ranking"))


_NATIONS = "SELECT c_nationkey AS k, MIN(c_custkey) AS component, COUNT(*) + 1 AS size FROM customer GROUP BY 1"


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    (customer,) = _read(spark, folder, "customer")
    return customer.select(F.col("c_custkey").alias("src"), (1000000000 + F.col("c_nationkey")).cast("long").alias("dst"))


@_built(f"WITH n AS ({_NATIONS}) SELECT c_custkey AS id, n.component FROM customer JOIN n ON c_nationkey = k UNION ALL SELECT 1000000000 + k, component FROM n")
def weak_components(spark: SparkSession, folder: str) -> DataFrame:
    return graph.components(_customers(spark, folder))


@_built(f"WITH n AS ({_NATIONS} ORDER BY size DESC, component LIMIT 1) SELECT c_custkey AS id, n.component FROM customer JOIN n ON c_nationkey = k UNION ALL SELECT 1000000000 + k, component FROM n")
def largest_wcc(spark: SparkSession, folder: str) -> DataFrame:
    return graph.largest_component(_customers(spark, folder))


@_built("SELECT o_orderkey AS id, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS label FROM orders")
def graph_relabel(spark: SparkSession, folder: str) -> DataFrame:
    (orders,) = _read(spark, folder, "orders")
    return graph.relabel(orders.select(F.col("o_orderkey").alias("id"))).select("id", F.col("label").cast("long").alias("label"))


@_built("SELECT COUNT(DISTINCT l_suppkey) AS nodes_left, CAST(1 AS BIGINT) AS parts FROM lineitem")
def graph_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes and connected parts of the suppliers' graph after contraction to as many nodes as there are suppliers."""
    (line,) = _read(spark, folder, "lineitem")
    left = graph.contract(_edges(spark, folder), line.select("l_suppkey").distinct().count())
    return graph.components(left).agg(F.count("*").alias("nodes_left"), F.countDistinct("component").alias("parts"))


# Streams ------------------------------------------------------------------------------------------


@_built("SELECT event_type, strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def stream_hourly(spark: SparkSession, folder: str) -> DataFrame:
    from heddle.streaming import windows

    return windows.hourly(spark, folder)
