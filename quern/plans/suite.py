"""Queries over the driver's tables: the engine's text beside an oracle's.

RELATIONAL: name -> (text for the engine, SQL for DuckDB, or None if the text
itself is right there too). SCALAR: name -> (table, key, expression for the
engine, expression for DuckDB).
"""

from __future__ import annotations

R: dict[str, tuple[str, str | None]] = {}
S: dict[str, tuple[str, str, str, str]] = {}


def both(name: str, sql: str, oracle: str | None = None) -> None:
    R[name] = (sql, oracle)


def fn(name: str, expr: str, oracle: str | None = None, table: str = "customer", key: str = "c_custkey") -> None:
    S[f"fn_{name}"] = (table, key, expr, oracle or expr)


def date_fn(name: str, expr: str, oracle: str | None = None) -> None:
    fn(name, expr, oracle, "orders", "o_orderkey")


def event_fn(name: str, expr: str, oracle: str | None = None) -> None:
    fn(name, expr, oracle, "events", "event_id")


# --- benchmark shapes
both("bench_q1", "SELECT COUNT(*) AS cnt FROM orders")
both("bench_q2", "SELECT COUNT(*) AS cnt FROM orders WHERE o_orderstatus = 'F'")
both("bench_q3", "SELECT o_orderstatus, COUNT(*) AS cnt, ROUND(AVG(o_totalprice), 2) AS avg_amt FROM orders GROUP BY o_orderstatus ORDER BY cnt DESC")
_REGION = "orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"
both("bench_q4", f"SELECT r.r_name AS region, o.o_orderstatus AS status, COUNT(*) AS cnt, ROUND(SUM(o.o_totalprice), 2) AS total FROM {_REGION} GROUP BY r.r_name, o.o_orderstatus ORDER BY total DESC, region, status LIMIT 20")
both("bench_q5", "SELECT YEAR(o_orderdate) AS yr, MONTH(o_orderdate) AS mo, COUNT(*) AS cnt, ROUND(SUM(o_totalprice), 2) AS revenue FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1998-01-01' GROUP BY yr, mo ORDER BY yr, mo",
     "SELECT CAST(YEAR(o_orderdate) AS INTEGER) AS yr, CAST(MONTH(o_orderdate) AS INTEGER) AS mo, COUNT(*) AS cnt, ROUND(SUM(o_totalprice), 2) AS revenue FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1998-01-01' GROUP BY ALL")
both("bench_q6", "SELECT o_custkey, COUNT(*) AS order_count, ROUND(SUM(o_totalprice), 2) AS total_spent FROM orders GROUP BY o_custkey ORDER BY total_spent DESC, o_custkey LIMIT 10")
both("bench_q7", f"SELECT r.r_name AS region, COUNT(*) AS cnt, ROUND(SUM(o_totalprice), 2) AS total, ROUND(AVG(o_totalprice), 2) AS avg_amt, ROUND(MIN(o_totalprice), 2) AS min_amt, ROUND(MAX(o_totalprice), 2) AS max_amt, COUNT(DISTINCT o_custkey) AS unique_users FROM {_REGION} WHERE o_orderdate BETWEEN '1996-01-01' AND '1997-12-31' GROUP BY r.r_name ORDER BY total DESC")
both("bench_q8", f"SELECT r.r_name AS region, COUNT(*) AS cnt, ROUND(SUM(o_totalprice), 2) AS total FROM {_REGION} GROUP BY r.r_name ORDER BY total DESC")
both("bench_n1", "SELECT COUNT(*) AS cnt FROM orders WHERE o_orderstatus = 'O' AND o_orderkey >= 2")
both("bench_n2", "SELECT o_orderpriority, COUNT(*) AS cnt, ROUND(AVG(o_totalprice), 2) AS avg_amt FROM orders WHERE o_orderkey >= 3 GROUP BY o_orderpriority ORDER BY cnt DESC")
both("bench_n3", R["bench_q5"][0].replace("1997-01-01", "1996-07-01").replace("1998-01-01", "1997-07-01"), R["bench_q5"][1].replace("1997-01-01", "1996-07-01").replace("1998-01-01", "1997-07-01"))
both("bench_n4", R["bench_q7"][0].replace("1996-01-01", "1998-01-01").replace("1997-12-31", "1999-12-31"))
both("tpch_q1", "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base_price, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, ROUND(AVG(l_quantity), 4) AS avg_qty, ROUND(AVG(l_extendedprice), 2) AS avg_price, ROUND(AVG(l_discount), 4) AS avg_disc, COUNT(*) AS count_order FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus")
both("tpch_q3", "SELECT l.l_orderkey, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, o.o_orderdate FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderdate < '1998-03-15' AND l.l_shipdate > '1998-03-15' GROUP BY l.l_orderkey, o.o_orderdate ORDER BY revenue DESC, l.l_orderkey LIMIT 10")
both("tpch_q5", "SELECT n.n_name, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA' AND o.o_orderdate >= '1996-01-01' AND o.o_orderdate < '1998-01-01' GROUP BY n.n_name ORDER BY revenue DESC")
both("tpch_q10", "SELECT c.c_custkey, c.c_name, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, c.c_acctbal, n.n_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderdate >= '1997-10-01' AND o.o_orderdate < '1998-01-01' AND l.l_returnflag = 'R' GROUP BY c.c_custkey, c.c_name, c.c_acctbal, n.n_name ORDER BY revenue DESC, c.c_custkey LIMIT 20")

# --- scans, filters, projections
both("scan_count", "SELECT COUNT(*) AS n, COUNT(c_name) AS named FROM customer")
both("filter_count", "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity < 10 AND l_discount >= 0.05")
both("filter_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
both("filter_in_list", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9, 15)")
both("filter_like", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1_'")
both("filter_regexp", "SELECT c_custkey FROM customer WHERE c_name REGEXP '[05]$'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[05]$')")
both("filter_null_safe", "SELECT o.o_orderkey, NULLIF(o.o_orderstatus, 'F') <=> NULL AS is_f FROM orders o", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') IS NOT DISTINCT FROM NULL AS is_f FROM orders")
both("case_when", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS big FROM orders")
both("cast_matrix", "SELECT c_custkey, CAST(c_acctbal AS SIGNED) AS i, CAST(c_acctbal AS DECIMAL(15, 1)) AS d, CAST(c_custkey AS CHAR) AS s, CAST('12abc' AS SIGNED) AS prefix, CAST(c_custkey AS CHAR(1)) AS one FROM customer",
     "SELECT c_custkey, CAST(round(CAST(c_acctbal AS DECIMAL(38,6))) AS BIGINT) AS i, CAST(c_acctbal AS DECIMAL(15,1)) AS d, CAST(c_custkey AS VARCHAR) AS s, CAST(12 AS BIGINT) AS prefix, left(CAST(c_custkey AS VARCHAR), 1) AS one FROM customer")
both("arith_div_mod", "SELECT o_orderkey, o_orderkey DIV 7 AS q, o_orderkey % 7 AS m, MOD(o_orderkey, 5) AS m5, o_totalprice / 0 AS z FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS m, o_orderkey % 5 AS m5, CAST(NULL AS DOUBLE) AS z FROM orders")
both("arith_divide", "SELECT o_orderkey, o_orderkey / 7 AS q, 3 * o_orderkey / 8 AS p, o_totalprice / 4 AS d, CAST(o_totalprice AS DECIMAL(15, 2)) / 3 AS e FROM orders", "SELECT o_orderkey, CAST(round(CAST(o_orderkey AS DECIMAL(28, 10)) / 7, 4) AS DOUBLE) AS q, round(3 * o_orderkey / 8, 4) AS p, o_totalprice / 4 AS d, round(CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS DOUBLE) / 3, 6) AS e FROM orders")
both("bit_ops", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, o_orderkey ^ 5 AS x, o_orderkey << 2 AS l, o_orderkey >> 1 AS r FROM orders", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, xor(o_orderkey, 5) AS x, o_orderkey << 2 AS l, o_orderkey >> 1 AS r FROM orders")
both("row_constructor_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('R', 'F'), ('N', 'O')) AND l_linenumber = 1")
both("logic_xor", "SELECT o_orderkey, (o_orderstatus = 'F') XOR (o_totalprice > 100000) AS x FROM orders", "SELECT o_orderkey, (o_orderstatus = 'F') <> (o_totalprice > 100000) AS x FROM orders")
both("temporal_range", "SELECT COUNT(*) AS n FROM orders WHERE DATE(o_orderdate) = '1996-05-05' OR YEAR(o_orderdate) = 1997", "SELECT COUNT(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) = '1996-05-05' OR YEAR(o_orderdate) = 1997")
both("point_scan", "SELECT * FROM customer WHERE c_custkey IN (3, 5, 8, 1000000)")
both("reverse_scan", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 25")
both("is_true_forms", "SELECT o_orderkey, (o_totalprice > 100000) IS TRUE AS t, (NULLIF(o_orderstatus, 'P') = 'F') IS NOT FALSE AS nf, (NULLIF(o_orderstatus, 'P') = 'F') IS UNKNOWN AS u FROM orders", "SELECT o_orderkey, (o_totalprice > 100000) IS TRUE AS t, (NULLIF(o_orderstatus, 'P') = 'F') IS NOT FALSE AS nf, (NULLIF(o_orderstatus, 'P') = 'F') IS NULL AS u FROM orders")
both("sounds_like", "SELECT n_nationkey, n_name SOUNDS LIKE 'CHYNA' AS s FROM nation", "SELECT n_nationkey, n_name = 'CHINA' AS s FROM nation")
both("table_statement", "TABLE region", "SELECT * FROM region")
both("interval_arithmetic", "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS a, o_orderdate - INTERVAL 2 MONTH AS b FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS a, o_orderdate - INTERVAL 2 MONTH AS b FROM orders")

# --- joins
both("join_inner", "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
both("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000")
both("join_right", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'")
both("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
both("join_comma", "SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey = n.n_regionkey")
both("join_multi_key", "SELECT COUNT(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
both("join_residual", "SELECT COUNT(*) AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_extendedprice > o.o_totalprice / 4")
both("join_theta", "SELECT COUNT(*) AS n FROM supplier s JOIN nation n ON s.s_acctbal > n.n_nationkey * 300")
both("join_semi_exists", "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 150000)")
both("join_anti_not_exists", "SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
both("join_not_in_null_aware", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
both("join_not_in_with_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, 1) FROM orders)")
both("join_null_safe", "SELECT COUNT(*) AS n FROM (SELECT NULLIF(o_orderstatus, 'P') AS s FROM orders) a JOIN (SELECT DISTINCT NULLIF(o_orderstatus, 'P') AS s FROM orders) b ON a.s <=> b.s", "SELECT COUNT(*) AS n FROM (SELECT NULLIF(o_orderstatus, 'P') AS s FROM orders) a JOIN (SELECT DISTINCT NULLIF(o_orderstatus, 'P') AS s FROM orders) b ON a.s IS NOT DISTINCT FROM b.s")
both("join_using", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)")
both("join_natural", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b")
both("join_self", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("join_bushy_left", "SELECT c.c_custkey, x.n_name, x.r_name FROM customer c LEFT JOIN (nation n2 JOIN region r2 ON n2.n_regionkey = r2.r_regionkey) ON c.c_nationkey = n2.n_nationkey LEFT JOIN (SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey) x ON x.n_nationkey = n2.n_nationkey")
both("join_straight", "SELECT STRAIGHT_JOIN n.n_name FROM nation n STRAIGHT_JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'", "SELECT n.n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'")
both("join_lateral_topn", "SELECT c.c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 2) t")
both("join_left_lateral", "SELECT c.c_custkey, t.m FROM customer c LEFT JOIN LATERAL (SELECT MAX(o.o_totalprice) AS m FROM orders o WHERE o.o_custkey = c.c_custkey) t ON TRUE")
both("join_on_exists", "SELECT n.n_name, r.r_name FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey)", "SELECT n.n_name, CASE WHEN EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey) THEN r.r_name END AS r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
both("join_mixed_type_key", "SELECT COUNT(*) AS n FROM nation n JOIN (SELECT CAST(r_regionkey AS CHAR) AS k FROM region) r ON n.n_regionkey = CAST(r.k AS SIGNED)", "SELECT COUNT(*) AS n FROM nation n JOIN (SELECT CAST(r_regionkey AS VARCHAR) AS k FROM region) r ON n.n_regionkey = CAST(r.k AS BIGINT)")

# --- aggregates
both("agg_basic", "SELECT l_returnflag, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS s, ROUND(AVG(l_discount), 4) AS a, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi FROM lineitem GROUP BY l_returnflag")
both("agg_distinct", "SELECT COUNT(DISTINCT l_suppkey) AS s, COUNT(DISTINCT l_returnflag) AS f FROM lineitem")
both("agg_distinct_tuple", "SELECT COUNT(DISTINCT NULLIF(l_returnflag, 'A'), l_linestatus) AS n FROM lineitem", "SELECT COUNT(*) AS n FROM (SELECT DISTINCT NULLIF(l_returnflag, 'A') AS a, l_linestatus FROM lineitem) WHERE a IS NOT NULL")
both("agg_sum_distinct", "SELECT SUM(DISTINCT p_size) AS s, ROUND(AVG(DISTINCT p_size), 4) AS a FROM part", "SELECT CAST(SUM(DISTINCT p_size) AS BIGINT) AS s, ROUND(AVG(DISTINCT p_size), 4) AS a FROM part")
both("agg_std_pop", "SELECT ROUND(STD(c_acctbal), 4) AS a, ROUND(STDDEV(c_acctbal), 4) AS b, ROUND(STDDEV_POP(c_acctbal), 4) AS c FROM customer", "SELECT ROUND(stddev_pop(c_acctbal), 4) AS a, ROUND(stddev_pop(c_acctbal), 4) AS b, ROUND(stddev_pop(c_acctbal), 4) AS c FROM customer")
both("agg_std_samp", "SELECT c_mktsegment, ROUND(STDDEV_SAMP(c_acctbal), 4) AS v FROM customer GROUP BY c_mktsegment")
both("agg_var_pop", "SELECT ROUND(VARIANCE(c_acctbal), 2) AS a, ROUND(VAR_POP(c_acctbal), 2) AS b FROM customer", "SELECT ROUND(var_pop(c_acctbal), 2) AS a, ROUND(var_pop(c_acctbal), 2) AS b FROM customer")
both("agg_var_samp", "SELECT c_mktsegment, ROUND(VAR_SAMP(c_acctbal), 2) AS v FROM customer GROUP BY c_mktsegment")
both("agg_bit", "SELECT c_mktsegment, BIT_AND(c_custkey) AS a, BIT_OR(c_custkey) AS o, BIT_XOR(c_custkey) AS x FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, bit_and(c_custkey) AS a, bit_or(c_custkey) AS o, bit_xor(c_custkey) AS x FROM customer GROUP BY c_mktsegment")
both("agg_group_concat", "SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name DESC SEPARATOR '; ') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
both("agg_group_concat_distinct", "SELECT o_orderstatus, GROUP_CONCAT(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS p FROM orders GROUP BY o_orderstatus")
both("agg_json_object", "SELECT n_regionkey, JSON_EXTRACT(JSON_OBJECTAGG(n_name, n_nationkey), '$.NATION_7') AS seven, JSON_LENGTH(JSON_OBJECTAGG(n_name, n_nationkey)) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, max(CASE WHEN n_name = 'NATION_7' THEN CAST(n_nationkey AS VARCHAR) END) AS seven, CAST(count(*) AS INTEGER) AS n FROM nation GROUP BY n_regionkey")
both("agg_json_array", "SELECT n_regionkey, JSON_ARRAYAGG(n_name) AS names FROM (SELECT n_regionkey, MIN(n_name) AS n_name FROM nation GROUP BY n_regionkey) t GROUP BY n_regionkey", "SELECT n_regionkey, '[\"' || MIN(n_name) || '\"]' AS names FROM nation GROUP BY n_regionkey")
both("agg_any_value", "SELECT r.r_regionkey, ANY_VALUE(r.r_name) AS r_name, COUNT(*) AS c FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_regionkey", "SELECT r.r_regionkey, max(r.r_name) AS r_name, COUNT(*) AS c FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_regionkey")
both("agg_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus WITH ROLLUP", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
both("agg_grouping_fn", "SELECT l_returnflag, GROUPING(l_returnflag) AS g, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag WITH ROLLUP", "SELECT l_returnflag, CAST(GROUPING(l_returnflag) AS TINYINT) AS g, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag)")
both("agg_having_alias", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 15")
both("agg_empty_input", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, BIT_OR(o_orderkey) AS b FROM orders WHERE o_orderkey < 0", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, CAST(0 AS BIGINT) AS b FROM orders WHERE o_orderkey < 0")
both("agg_decimal_exact", "SELECT l_returnflag, SUM(CAST(l_extendedprice AS DECIMAL(15, 2))) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(SUM(CAST(l_extendedprice AS DECIMAL(15, 2))) AS DECIMAL(25, 2)) AS s FROM lineitem GROUP BY l_returnflag")
both("agg_functional_dependence", "SELECT n.n_nationkey, n.n_name, COUNT(*) AS c FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey", "SELECT n.n_nationkey, any_value(n.n_name) AS n_name, COUNT(*) AS c FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey")
both("agg_expression_key", "SELECT o_orderkey % 10 AS k, COUNT(*) AS n FROM orders GROUP BY 1")

# --- windows
_W = "FROM orders"
for _name, _expr in {
    "row_number": "ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "rank": "RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus)",
    "dense_rank": "DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus)",
    "ntile": "NTILE(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)",
}.items():
    both(f"win_{_name}", f"SELECT o_orderkey, {_expr} AS v {_W}", f"SELECT o_orderkey, CAST({_expr} AS INTEGER) AS v {_W}")
for _name, _expr in {
    "percent_rank": "ROUND(PERCENT_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 6)",
    "cume_dist": "ROUND(CUME_DIST() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 6)",
    "lag_lead": "COALESCE(LAG(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) + LEAD(o_orderkey, 2, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "first_last_nth": "FIRST_VALUE(o_orderkey) OVER w + LAST_VALUE(o_orderkey) OVER w + COALESCE(NTH_VALUE(o_orderkey, 2) OVER w, 0)",
    "running_sum": "ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2)",
    "rows_frame": "COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)",
    "range_numeric": "COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND CURRENT ROW)",
    "named": "MAX(o_totalprice) OVER w",
    "min_max": "MIN(o_orderdate) OVER (PARTITION BY o_custkey)",
}.items():
    both(f"win_{_name}", f"SELECT o_orderkey, {_expr} AS v {_W}" + (" WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)" if " w" in _expr else ""))
both("win_range_interval", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS v FROM orders")
both("win_over_grouped", "SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS s, RANK() OVER (ORDER BY COUNT(*) DESC) AS r, ROUND(AVG(SUM(o_totalprice)) OVER (PARTITION BY COUNT(*)), 2) AS a FROM orders GROUP BY o_custkey", "SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS s, CAST(RANK() OVER (ORDER BY COUNT(*) DESC) AS INTEGER) AS r, ROUND(AVG(SUM(o_totalprice)) OVER (PARTITION BY COUNT(*)), 2) AS a FROM orders GROUP BY o_custkey")

# --- sort, limit, sets
both("sort_multi_nulls", "SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS s, ROW_NUMBER() OVER (ORDER BY NULLIF(o_orderstatus, 'P'), o_orderkey DESC) AS pos FROM orders ORDER BY s, o_orderkey DESC", "SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS s, CAST(ROW_NUMBER() OVER (ORDER BY NULLIF(o_orderstatus, 'P') NULLS FIRST, o_orderkey DESC) AS INTEGER) AS pos FROM orders")
both("sort_hidden_column", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
both("topk", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
both("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10, 5", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 10")
both("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0")
both("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
both("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
both("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
both("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
both("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 15")
both("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
both("setop_branch_limit", "(SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) UNION ALL (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 2)")
both("setop_precedence", "SELECT 1 AS k UNION ALL SELECT 2 INTERSECT SELECT 2")
both("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")

# --- subqueries, CTEs
both("subq_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)")
both("subq_correlated_agg", "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice = (SELECT MAX(x.o_totalprice) FROM orders x WHERE x.o_custkey = o.o_custkey)")
both("subq_correlated_inequality", "SELECT n.n_nationkey, (SELECT COUNT(*) FROM nation m WHERE m.n_nationkey < n.n_nationkey) AS below FROM nation n")
both("subq_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
both("subq_exists", "SELECT n_name FROM nation n WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000)")
both("subq_all", "SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_size = 10)")
both("subq_any", "SELECT p_partkey FROM part WHERE p_retailprice < ANY (SELECT p_retailprice FROM part WHERE p_size = 10)")
both("subq_eq_any", "SELECT s_suppkey FROM supplier WHERE s_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
both("subq_select_list", "SELECT r.r_name, (SELECT COUNT(*) FROM nation n WHERE n.n_regionkey = r.r_regionkey) AS nations FROM region r")
both("subq_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > (SELECT AVG(c) FROM (SELECT COUNT(*) AS c FROM orders GROUP BY o_custkey) t)")
both("derived_table", "SELECT t.k, COUNT(*) AS n FROM (SELECT o_custkey % 5 AS k FROM orders WHERE o_orderstatus <> 'P') t GROUP BY t.k")
both("cte", "WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE s > 1000000) SELECT COUNT(*) AS n FROM top")
both("cte_recursive", "WITH RECURSIVE seq(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM seq WHERE n < 300) SELECT n, n * n AS sq FROM seq")
both("values_rows", "SELECT * FROM (VALUES ROW(1, 'a'), ROW(2, 'b')) AS t(k, v)", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(k, v)")
both("system_variables", "SELECT @@autocommit AS a, @@lower_case_table_names AS l, 0x4142 AS b", "SELECT 1 AS a, 0 AS l, 'AB'::BLOB AS b")

both("json_table_text", "SELECT e.event_id, jt.ord, jt.k, jt.h FROM events e, JSON_TABLE(CONCAT('[', e.props, ',{}]'), '$[*]' COLUMNS (ord FOR ORDINALITY, k INT PATH '$.k' DEFAULT '-1' ON EMPTY, h INT EXISTS PATH '$.k')) AS jt", "SELECT event_id, CAST(ord AS INTEGER) AS ord, CASE ord WHEN 1 THEN CAST(props ->> '$.k' AS INTEGER) ELSE -1 END AS k, CASE ord WHEN 1 THEN 1 ELSE 0 END AS h FROM events, (VALUES (1), (2)) t(ord)")
both("json_table_text_nested", "SELECT e.event_id, jt.a, jt.b FROM events e LEFT JOIN JSON_TABLE(CONCAT('{\"a\": [1, 2], \"b\": [', e.user_id, ']}'), '$' COLUMNS (NESTED PATH '$.a[*]' COLUMNS (a BIGINT PATH '$'), NESTED PATH '$.b[*]' COLUMNS (b BIGINT PATH '$'))) AS jt ON TRUE", "SELECT event_id, CAST(a AS BIGINT) AS a, CASE WHEN a IS NULL THEN user_id END AS b FROM events, (VALUES (1), (2), (NULL)) t(a)")
both("json_table_wildcard", "SELECT e.event_id, jt.ord, jt.k FROM events e, JSON_TABLE(CONCAT('{\"a\": [', e.props, ', {\"k\": null}, {}]}'), '$.a[*].k' COLUMNS (ord FOR ORDINALITY, k INT PATH '$')) AS jt", "SELECT event_id, CAST(ord AS INTEGER) AS ord, CASE ord WHEN 1 THEN CAST(props ->> '$.k' AS INTEGER) END AS k FROM events, (VALUES (1), (2)) t(ord)")
both("json_table_on_error", "SELECT e.event_id, jt.ord, jt.k, jt.h FROM events e, JSON_TABLE(CONCAT('[', e.props, ', {\"k\": null}, {\"k\": \"x\"}, {}]'), '$[*]' COLUMNS (ord FOR ORDINALITY, k INT PATH '$.k' DEFAULT '-1' ON EMPTY DEFAULT '-2' ON ERROR, h INT EXISTS PATH '$.k')) AS jt", "SELECT event_id, CAST(ord AS INTEGER) AS ord, CASE ord WHEN 1 THEN CAST(props ->> '$.k' AS INTEGER) WHEN 3 THEN -2 WHEN 4 THEN -1 END AS k, CASE WHEN ord < 4 THEN 1 ELSE 0 END AS h FROM events, (VALUES (1), (2), (3), (4)) t(ord)")
both("cte_recursive_distinct_text", "WITH RECURSIVE reach(src, dst) AS (SELECT a.n_nationkey, b.n_nationkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey - a.n_nationkey = 5 UNION SELECT r.src, b.n_nationkey FROM reach r JOIN nation b ON (b.n_nationkey - r.dst) % 25 IN (5, -20)) SELECT src, COUNT(*) AS n, SUM(dst) AS total FROM reach GROUP BY src")
both("cast_unsigned", "SELECT c_custkey, CAST(-1 - c_custkey AS UNSIGNED) AS wrapped, CAST(c_custkey AS UNSIGNED) AS same FROM customer", "SELECT c_custkey, CAST(18446744073709551615 - c_custkey AS DECIMAL(20, 0)) AS wrapped, CAST(c_custkey AS DECIMAL(20, 0)) AS same FROM customer")
both("numeric_truth", "SELECT c_custkey, IF(MOD(c_custkey, 2), 'odd', 'even') AS v FROM customer WHERE FIND_IN_SET(c_mktsegment, 'BUILDING,MACHINERY') AND 1 AND NOT INSTR(c_name, '7')", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 'odd' ELSE 'even' END AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name NOT LIKE '%7%'")
both("straight_subquery_ops", "SELECT COUNT(*) AS n FROM orders WHERE o_orderkey BETWEEN 5 AND 50 AND 1 = 1")

# --- strings
fn("concat", "CONCAT(c_name, '-', c_mktsegment)")
fn("concat_ws", "CONCAT_WS('/', c_name, NULLIF(c_mktsegment, 'BUILDING'), 'x')")
fn("substring", "SUBSTRING(c_name, 3, 5)")
fn("substring_negative", "SUBSTR(c_name, -4)", "substr(c_name, -4)")
fn("substring_from", "SUBSTRING(c_name FROM 2 FOR 3)", "substring(c_name, 2, 3)")
fn("mid", "MID(c_name, 0, 3)", "''")
fn("left", "LEFT(c_name, 4)")
fn("right", "RIGHT(c_name, 4)")
fn("substring_index", "SUBSTRING_INDEX(c_name, '#', 1)", "split_part(c_name, '#', 1)")
fn("lower", "LOWER(c_mktsegment)")
fn("lcase", "LCASE(c_mktsegment)", "lower(c_mktsegment)")
fn("upper", "UPPER(c_name)")
fn("ucase", "UCASE(c_name)", "upper(c_name)")
fn("trim", "TRIM(CONCAT('  ', c_name, ' '))")
fn("trim_both", "TRIM(BOTH 'xy' FROM CONCAT('xyxy', c_name, 'xy'))", "c_name")
fn("ltrim", "LTRIM(CONCAT('  ', c_name))")
fn("rtrim", "RTRIM(CONCAT(c_name, '  '))")
fn("length", "LENGTH(CONCAT(c_name, 'é'))", "CAST(strlen(concat(c_name, 'é')) AS INTEGER)")
fn("octet_length", "OCTET_LENGTH(c_name)", "CAST(strlen(c_name) AS INTEGER)")
fn("char_length", "CHAR_LENGTH(CONCAT(c_name, 'é'))", "CAST(length(concat(c_name, 'é')) AS INTEGER)")
fn("character_length", "CHARACTER_LENGTH(c_name)", "CAST(length(c_name) AS INTEGER)")
fn("bit_length", "BIT_LENGTH(c_name)", "CAST(8 * strlen(c_name) AS INTEGER)")
fn("replace", "REPLACE(c_name, '0', 'oo')")
fn("locate", "LOCATE('0', c_name)", "CAST(instr(c_name, '0') AS INTEGER)")
fn("position", "POSITION('r' IN c_name)", "CAST(instr(c_name, 'r') AS INTEGER)")
fn("instr", "INSTR(c_name, 'mer')", "CAST(instr(c_name, 'mer') AS INTEGER)")
fn("reverse", "REVERSE(c_name)")
fn("repeat", "REPEAT(c_mktsegment, 2)")
fn("insert", "INSERT(c_name, 2, 3, '__')", "concat(substr(c_name, 1, 1), '__', substr(c_name, 5))")
fn("space", "CONCAT('[', SPACE(3), ']')", "'[   ]'")
fn("lpad", "LPAD(c_custkey, 8, '0')", "lpad(CAST(c_custkey AS VARCHAR), 8, '0')")
fn("rpad", "RPAD(c_mktsegment, 12, '.')")
fn("find_in_set", "FIND_IN_SET(c_mktsegment, 'BUILDING,MACHINERY,HOUSEHOLD')", "CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 0 END")
fn("field", "FIELD(c_mktsegment, 'MACHINERY', 'BUILDING')", "CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 0 END")
fn("elt", "ELT(c_custkey % 3 + 1, 'a', 'b')", "CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END")
fn("ascii", "ASCII(c_mktsegment)", "CAST(ascii(c_mktsegment) AS INTEGER)")
fn("ord", "ORD(c_mktsegment)", "CAST(ascii(c_mktsegment) AS BIGINT)")
fn("char", "CAST(CHAR(77, 121) AS CHAR)", "'My'")
fn("hex", "HEX(c_mktsegment)", "hex(c_mktsegment)")
fn("hex_number", "HEX(c_custkey)", "to_hex(c_custkey)")
fn("unhex", "CAST(UNHEX(HEX(c_name)) AS CHAR)", "c_name")
fn("to_base64", "TO_BASE64(c_name)", "to_base64(encode(c_name))")
fn("from_base64", "CAST(FROM_BASE64(TO_BASE64(c_name)) AS CHAR)", "c_name")
fn("quote", "QUOTE(c_mktsegment)", "concat('''', c_mktsegment, '''')")
fn("format", "FORMAT(c_acctbal, 2)", "format('{:,.2f}', c_acctbal)")
fn("make_set", "MAKE_SET(c_custkey % 8, 'a', 'b', 'c')", "concat_ws(',', CASE WHEN (c_custkey % 8) & 1 > 0 THEN 'a' END, CASE WHEN (c_custkey % 8) & 2 > 0 THEN 'b' END, CASE WHEN (c_custkey % 8) & 4 > 0 THEN 'c' END)")
fn("export_set", "EXPORT_SET(c_custkey % 4, 'Y', 'N', ',', 3)", "CASE c_custkey % 4 WHEN 0 THEN 'N,N,N' WHEN 1 THEN 'Y,N,N' WHEN 2 THEN 'N,Y,N' ELSE 'Y,Y,N' END")
fn("strcmp", "STRCMP(c_mktsegment, 'FURNITURE')", "CASE WHEN c_mktsegment < 'FURNITURE' THEN -1 WHEN c_mktsegment = 'FURNITURE' THEN 0 ELSE 1 END")
fn("conv", "CONV(c_custkey, 10, 16)", "to_hex(c_custkey)")
fn("bin", "BIN(c_custkey)", "to_binary(c_custkey)")
fn("oct", "OCT(c_custkey)", "printf('%o', c_custkey)")
fn("soundex", "SOUNDEX('Hello World')", "'H4643'")
fn("regexp_like", "REGEXP_LIKE(c_name, '1.*2')", "regexp_matches(c_name, '1.*2')")
fn("regexp_substr", "REGEXP_SUBSTR(c_name, '[1-9]+')", "nullif(regexp_extract(c_name, '[1-9]+'), '')")
fn("regexp_instr", "REGEXP_INSTR(c_name, '#')", "CAST(instr(c_name, '#') AS INTEGER)")
fn("regexp_replace", "REGEXP_REPLACE(c_name, '[0-9]+', 'N')", "regexp_replace(c_name, '[0-9]+', 'N', 'g')")
fn("regexp_replace_nth", "REGEXP_REPLACE('a1b2c3', '[0-9]', 'N', 1, 2)", "'a1bNc3'")
fn("md5", "MD5(c_name)")
fn("sha1", "SHA1(c_name)")
fn("sha", "SHA(c_name)", "sha1(c_name)")
fn("sha2", "SHA2(c_name, 256)", "sha256(c_name)")
fn("crc32", "CRC32('MySQL')", "CAST(3259397556 AS BIGINT)")
fn("uuid", "LENGTH(UUID())", "36")
fn("is_uuid", "IS_UUID('6ccd780c-baba-1026-9564-5b8c656024db')", "TRUE")
fn("uuid_to_bin", "BIN_TO_UUID(UUID_TO_BIN('6ccd780c-baba-1026-9564-5b8c656024db', 1), 1)", "'6ccd780c-baba-1026-9564-5b8c656024db'")
fn("bin_to_uuid", "HEX(UUID_TO_BIN('6ccd780c-baba-1026-9564-5b8c656024db', 1))", "'1026BABA6CCD780C95645B8C656024DB'")
fn("inet_aton", "INET_ATON(CONCAT('10.0.', c_custkey % 256, '.7'))", "CAST(167772160 + (c_custkey % 256) * 256 + 7 AS BIGINT)")
fn("inet_ntoa", "INET_NTOA(167772160 + c_custkey % 256)", "concat('10.0.0.', c_custkey % 256)")
fn("inet6", "INET6_NTOA(INET6_ATON('2001:db8::ff'))", "'2001:db8::ff'")
fn("is_ipv4", "IS_IPV4(CONCAT('10.0.0.', c_custkey))", "CASE WHEN c_custkey <= 255 THEN 1 ELSE 0 END")
fn("is_ipv6", "IS_IPV6('::1')", "1")
fn("is_ipv4_mapped", "IS_IPV4_MAPPED(INET6_ATON('::ffff:1.2.3.4'))", "1")
fn("is_ipv4_compat", "IS_IPV4_COMPAT(INET6_ATON('::1.2.3.4'))", "1")

# --- numbers
fn("abs", "ABS(c_acctbal)")
fn("round", "ROUND(CAST(c_acctbal AS DECIMAL(15, 2)), 1)", "CAST(round(CAST(c_acctbal AS DECIMAL(15, 2)), 1) AS DECIMAL(15, 1))")
fn("truncate", "TRUNCATE(c_acctbal, 1)", "trunc(CAST(c_acctbal AS DECIMAL(15, 2)) * 10)::DOUBLE / 10")
fn("ceil", "CEIL(c_acctbal)", "CAST(ceil(c_acctbal) AS BIGINT)")
fn("ceiling", "CEILING(c_acctbal)", "CAST(ceil(c_acctbal) AS BIGINT)")
fn("floor", "FLOOR(c_acctbal)", "CAST(floor(c_acctbal) AS BIGINT)")
fn("sign", "SIGN(c_acctbal)", "CAST(sign(c_acctbal) AS INTEGER)")
fn("mod", "MOD(c_custkey, 7)", "c_custkey % 7")
fn("mod_zero", "MOD(c_custkey, 0)", "CAST(NULL AS BIGINT)")
for _n, _d in {"pow": "POW(c_custkey, 2)", "power": "POWER(c_custkey, 0.5)", "exp": "EXP(c_custkey / 1e3)", "log2": "LOG2(c_custkey)", "log10": "LOG10(c_custkey)", "sin": "SIN(c_custkey)", "cos": "COS(c_custkey)", "tan": "TAN(c_custkey)", "cot": "COT(c_custkey)", "atan": "ATAN(c_custkey)", "atan2": "ATAN2(c_custkey, 3)", "degrees": "DEGREES(c_custkey)", "radians": "RADIANS(c_custkey)", "pi": "PI()", "ln": "LN(c_custkey)", "asin": "ASIN(1e0 / c_custkey)", "acos": "ACOS(1e0 / c_custkey)"}.items():
    fn(_n, f"ROUND({_d}, 5)", f"round({_d.replace('LOG2(c_custkey', 'LOG2(nullif(c_custkey, 0)').replace('LOG10(c_custkey', 'LOG10(nullif(c_custkey, 0)').replace('LN(c_custkey', 'LN(nullif(c_custkey, 0)')}, 5)")
fn("sqrt", "ROUND(SQRT(c_acctbal), 5)", "CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 5) END")
fn("log", "ROUND(LOG(c_custkey), 5)", "round(ln(nullif(c_custkey, 0)), 5)")
fn("log_base", "ROUND(LOG(3, c_custkey), 5)", "round(ln(nullif(c_custkey, 0)) / ln(3), 5)")
fn("rand", "RAND(7) < 1", "TRUE")
fn("greatest", "GREATEST(c_custkey, 50, NULLIF(c_nationkey, 3))", "CASE WHEN c_nationkey <> 3 THEN CAST(greatest(c_custkey, 50, c_nationkey) AS BIGINT) END")
fn("least", "LEAST(c_custkey, 50)", "least(c_custkey, 50)")
fn("bit_count", "BIT_COUNT(c_custkey)", "CAST(bit_count(c_custkey) AS INTEGER)")
fn("interval", "INTERVAL(c_custkey, 10, 50, 100)", "CASE WHEN c_custkey >= 100 THEN 3 WHEN c_custkey >= 50 THEN 2 WHEN c_custkey >= 10 THEN 1 ELSE 0 END")
fn("if", "IF(c_acctbal > 0, 'plus', 'minus')", "CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END")
fn("ifnull", "IFNULL(NULLIF(c_nationkey, 3), -1)", "coalesce(nullif(c_nationkey, 3), -1)")
fn("coalesce", "COALESCE(NULL, NULLIF(c_nationkey, 3), 99)")
fn("nullif", "NULLIF(c_mktsegment, 'BUILDING')")
fn("isnull", "ISNULL(NULLIF(c_nationkey, 3))", "CASE WHEN c_nationkey = 3 THEN 1 ELSE 0 END")
fn("session_info", "CONCAT(DATABASE(), CONNECTION_ID(), ROW_COUNT())", "'default1-1'")

# --- dates
for _n, _f in {"year": "YEAR", "month": "MONTH", "day": "DAY", "dayofmonth": "DAYOFMONTH", "hour": "HOUR", "minute": "MINUTE", "second": "SECOND", "quarter": "QUARTER", "dayofyear": "DAYOFYEAR"}.items():
    date_fn(_n, f"{_f}(o_orderdate)", f"CAST({_f}(o_orderdate) AS INTEGER)")
date_fn("dayofweek", "DAYOFWEEK(o_orderdate)", "CAST(dayofweek(o_orderdate) + 1 AS INTEGER)")
date_fn("weekday", "WEEKDAY(o_orderdate)", "CAST(isodow(o_orderdate) - 1 AS INTEGER)")
date_fn("weekofyear", "WEEKOFYEAR(o_orderdate)", "CAST(weekofyear(o_orderdate) AS INTEGER)")
date_fn("week_mode3", "WEEK(o_orderdate, 3)", "CAST(weekofyear(o_orderdate) AS BIGINT)")
date_fn("week", "WEEK(o_orderdate)", "CAST(strftime(o_orderdate, '%U') AS BIGINT)")
date_fn("week_mode5", "WEEK(o_orderdate, 5)", "CAST(strftime(o_orderdate, '%W') AS BIGINT)")
date_fn("yearweek", "YEARWEEK(o_orderdate, 3)", "CAST(yearweek(o_orderdate) AS BIGINT)")
date_fn("date", "DATE(o_orderdate)", "CAST(o_orderdate AS DATE)")
date_fn("microsecond", "MICROSECOND(o_orderdate)", "0")
date_fn("dayname", "DAYNAME(o_orderdate)", "dayname(o_orderdate)")
date_fn("monthname", "MONTHNAME(o_orderdate)", "monthname(o_orderdate)")
date_fn("last_day", "LAST_DAY(o_orderdate)", "last_day(o_orderdate)")
date_fn("to_days", "TO_DAYS(o_orderdate)", "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719528 AS INTEGER)")
date_fn("from_days", "FROM_DAYS(TO_DAYS(o_orderdate))", "CAST(o_orderdate AS DATE)")
date_fn("to_seconds", "TO_SECONDS(o_orderdate)", "CAST(epoch(o_orderdate) AS BIGINT) + CAST(719528 AS BIGINT) * 86400")
date_fn("time_to_sec", "TIME_TO_SEC('12:34:56')", "CAST(45296 AS BIGINT)")
date_fn("sec_to_time", "SEC_TO_TIME(o_orderkey)", "concat(CASE WHEN o_orderkey < 36000 THEN '0' ELSE '' END, o_orderkey // 3600, strftime(TIMESTAMP '1970-01-01' + to_seconds(o_orderkey), ':%M:%S'))")
date_fn("period_add", "PERIOD_ADD(199811, 3)", "CAST(199902 AS BIGINT)")
date_fn("period_diff", "PERIOD_DIFF(200002, 199811)", "CAST(15 AS BIGINT)")
date_fn("addtime", "ADDTIME(o_orderdate, '01:30:00')", "strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S')")
date_fn("subtime", "SUBTIME('10:00:00', '01:30:00')", "'08:30:00'")
date_fn("timediff", "TIMEDIFF(o_orderdate + INTERVAL 5 HOUR, o_orderdate)", "'05:00:00'")
date_fn("makedate", "MAKEDATE(YEAR(o_orderdate), DAYOFYEAR(o_orderdate))", "CAST(o_orderdate AS DATE)")
date_fn("maketime", "MAKETIME(12, 15, 30)", "'12:15:30'")
date_fn("time", "TIME('2003-12-31 01:02:03')", "'01:02:03'")
date_fn("timestamp", "TIMESTAMP('2003-12-31')", "TIMESTAMP '2003-12-31'")
date_fn("str_to_date", "STR_TO_DATE(DATE_FORMAT(o_orderdate, '%d,%m,%Y'), '%d,%m,%Y')", "CAST(o_orderdate AS DATE)")
date_fn("date_format", "DATE_FORMAT(o_orderdate, '%Y/%m/%d %H:%i:%s %W %M %j %p')", "strftime(o_orderdate, '%Y/%m/%d %H:%M:%S %A %B %j %p')")
date_fn("date_format_week", "DATE_FORMAT(o_orderdate, '%x-%v %U')", "strftime(o_orderdate, '%G-%V %U')")
date_fn("date_format_ordinal", "DATE_FORMAT(o_orderdate, '%D')", "concat(day(o_orderdate), CASE WHEN day(o_orderdate) IN (1, 21, 31) THEN 'st' WHEN day(o_orderdate) IN (2, 22) THEN 'nd' WHEN day(o_orderdate) IN (3, 23) THEN 'rd' ELSE 'th' END)")
date_fn("time_format", "TIME_FORMAT('13:05:09', '%h:%i %p')", "'01:05 PM'")
date_fn("get_format", "GET_FORMAT(DATE, 'EUR')", "'%d.%m.%Y'")
date_fn("datediff", "DATEDIFF(o_orderdate, '1995-01-01')", "CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER)")
date_fn("timestampdiff", "TIMESTAMPDIFF(MONTH, '1995-01-15', o_orderdate)", "datesub('month', TIMESTAMP '1995-01-15', o_orderdate)")
date_fn("timestampadd", "TIMESTAMPADD(WEEK, 2, o_orderdate)", "strftime(o_orderdate + INTERVAL 14 DAY, '%Y-%m-%d %H:%M:%S')")
date_fn("date_add", "DATE_ADD(DATE(o_orderdate), INTERVAL 1 MONTH)", "strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH, '%Y-%m-%d')")
date_fn("date_sub", "DATE_SUB(DATE(o_orderdate), INTERVAL 1 YEAR)", "strftime(CAST(o_orderdate AS DATE) - INTERVAL 1 YEAR, '%Y-%m-%d')")
date_fn("adddate", "ADDDATE(DATE(o_orderdate), 10)", "strftime(CAST(o_orderdate AS DATE) + INTERVAL 10 DAY, '%Y-%m-%d')")
date_fn("date_add_compound", "DATE_ADD(o_orderdate, INTERVAL '1:30' HOUR_MINUTE)", "strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S')")
date_fn("extract", "EXTRACT(YEAR_MONTH FROM o_orderdate)", "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER)")
date_fn("convert_tz", "CONVERT_TZ(o_orderdate, '+00:00', '+02:30')", "o_orderdate + INTERVAL 150 MINUTE")
date_fn("unix_timestamp", "UNIX_TIMESTAMP(o_orderdate)", "CAST(epoch(o_orderdate) AS BIGINT)")
date_fn("from_unixtime", "FROM_UNIXTIME(UNIX_TIMESTAMP(o_orderdate), '%Y-%m')", "strftime(o_orderdate, '%Y-%m')")
date_fn("now", "NOW() > o_orderdate AND CURDATE() >= DATE(o_orderdate)", "TRUE")

# --- JSON
event_fn("json_extract", "props -> '$.k'", "props ->> '$.k'")
event_fn("json_unquote_extract", "props ->> '$.k'", "props ->> '$.k'")
event_fn("json_value", "JSON_VALUE(props, '$.k' RETURNING SIGNED)", "CAST(props ->> '$.k' AS BIGINT)")
event_fn("json_valid", "JSON_VALID(props)", "1")
event_fn("json_type", "JSON_TYPE(props)", "'OBJECT'")
event_fn("json_length", "JSON_LENGTH(props)", "1")
event_fn("json_depth", "JSON_DEPTH(props)", "2")
event_fn("json_keys", "JSON_KEYS(props)", "'[\"k\"]'")
event_fn("json_contains", "JSON_CONTAINS(props, '1', '$.k')", "CASE WHEN props ->> '$.k' = '1' THEN 1 ELSE 0 END")
event_fn("json_contains_path", "JSON_CONTAINS_PATH(props, 'one', '$.x', '$.k')", "1")
event_fn("json_search", "JSON_SEARCH('[\"abc\", {\"x\": \"abc\"}]', 'all', 'a%')", "'[\"$[0]\", \"$[1].x\"]'")
event_fn("json_overlaps", "JSON_OVERLAPS('[1, 2]', '[2, 3]')", "1")
event_fn("json_set", "JSON_SET(props, '$.z', 5)", "concat('{\"k\": ', props ->> '$.k', ', \"z\": 5}')")
event_fn("json_insert", "JSON_INSERT(props, '$.k', 5)", "concat('{\"k\": ', props ->> '$.k', '}')")
event_fn("json_replace", "JSON_REPLACE(props, '$.k', 5)", "'{\"k\": 5}'")
event_fn("json_array_append", "JSON_ARRAY_APPEND('[1, [2]]', '$[1]', 3)", "'[1, [2, 3]]'")
event_fn("json_array_insert", "JSON_ARRAY_INSERT('[1, 2]', '$[1]', 9)", "'[1, 9, 2]'")
event_fn("json_remove", "JSON_REMOVE(props, '$.k')", "'{}'")
event_fn("json_merge_preserve", "JSON_MERGE_PRESERVE('{\"a\": 1}', '{\"a\": 2}')", "'{\"a\": [1, 2]}'")
event_fn("json_merge", "JSON_MERGE('[1]', '2')", "'[1, 2]'")
event_fn("json_merge_patch", "JSON_MERGE_PATCH('{\"a\": 1, \"b\": 2}', '{\"a\": null}')", "'{\"b\": 2}'")
event_fn("json_quote", "JSON_QUOTE(event_type)", "concat('\"', event_type, '\"')")
event_fn("json_unquote", "JSON_UNQUOTE('\"a b\"')", "'a b'")
event_fn("json_pretty", "JSON_PRETTY('{\"a\":1}')", "concat('{', chr(10), '  \"a\": 1', chr(10), '}')")
event_fn("json_object", "JSON_OBJECT('kind', event_type, 'n', 1)", "concat('{\"n\": 1, \"kind\": \"', event_type, '\"}')")
event_fn("json_array", "JSON_ARRAY(1, event_type, NULL)", "concat('[1, \"', event_type, '\", null]')")
event_fn("json_member_of", "'2' MEMBER OF ('[\"2\", 3]')", "1")

# --- spatial
for _n, (_e, _o) in {
    "st_astext": ("ST_ASTEXT(ST_GEOMFROMTEXT('POINT(1 2)'))", "'POINT(1 2)'"), "st_x": ("ST_X(POINT(c_custkey, 2))", "CAST(c_custkey AS DOUBLE)"), "st_y": ("ST_Y(POINT(1, c_custkey))", "CAST(c_custkey AS DOUBLE)"),
    "st_distance": ("ST_DISTANCE(POINT(0, 0), POINT(3, 4))", "CAST(5 AS DOUBLE)"), "st_area": ("ST_AREA(ST_GEOMFROMTEXT('POLYGON((0 0,4 0,4 3,0 3,0 0))'))", "CAST(12 AS DOUBLE)"), "st_length": ("ST_LENGTH(ST_GEOMFROMTEXT('LINESTRING(0 0,3 4)'))", "CAST(5 AS DOUBLE)"),
    "st_contains": ("ST_CONTAINS(ST_GEOMFROMTEXT('POLYGON((0 0,100 0,100 100,0 100,0 0))'), POINT(c_custkey, 50))", "CASE WHEN c_custkey BETWEEN 1 AND 99 THEN 1 ELSE 0 END"), "st_within": ("ST_WITHIN(POINT(1, 1), ST_GEOMFROMTEXT('POLYGON((0 0,4 0,4 4,0 4,0 0))'))", "1"),
    "st_intersects": ("ST_INTERSECTS(ST_GEOMFROMTEXT('LINESTRING(0 0,2 2)'), ST_GEOMFROMTEXT('LINESTRING(0 2,2 0)'))", "1"), "st_disjoint": ("ST_DISJOINT(POINT(1, 1), POINT(2, 2))", "1"), "st_srid": ("ST_SRID(ST_SRID(POINT(1, 1), 4326))", "4326"),
    "st_geometrytype": ("ST_GEOMETRYTYPE(ST_GEOMFROMTEXT('MULTIPOINT((1 1),(2 2))'))", "'MULTIPOINT'"), "st_numpoints": ("ST_NUMPOINTS(ST_GEOMFROMTEXT('LINESTRING(0 0,1 1,2 2)'))", "3"), "st_centroid": ("ST_ASTEXT(ST_CENTROID(ST_GEOMFROMTEXT('POLYGON((0 0,4 0,4 4,0 4,0 0))')))", "'POINT(2 2)'"),
    "st_envelope": ("ST_ASTEXT(ST_ENVELOPE(ST_GEOMFROMTEXT('LINESTRING(0 0,2 1)')))", "'POLYGON((0 0,2 0,2 1,0 1,0 0))'"), "st_pointn": ("ST_ASTEXT(ST_POINTN(ST_GEOMFROMTEXT('LINESTRING(0 0,1 5)'), 2))", "'POINT(1 5)'"), "mbrcontains": ("MBRCONTAINS(ST_GEOMFROMTEXT('LINESTRING(0 0,4 4)'), POINT(1, 2))", "1"),
    "st_asgeojson": ("ST_ASGEOJSON(POINT(1, 2))", "'{\"type\": \"Point\", \"coordinates\": [1.0, 2.0]}'"), "st_distance_sphere": ("ROUND(ST_DISTANCE_SPHERE(POINT(0, 0), POINT(0, 90)))", "CAST(10007521 AS DOUBLE)"), "st_geomfromwkb": ("ST_ASTEXT(ST_GEOMFROMWKB(ST_ASWKB(POINT(3, 4))))", "'POINT(3 4)'"),
}.items():
    fn(_n, _e, _o)
_HOLED = "ST_GEOMFROMTEXT('POLYGON((0 0,9 0,9 9,0 9,0 0),(1 1,2 1,2 2,1 1))')"
_LINE, _SQUARE = "ST_GEOMFROMTEXT('LINESTRING(0 0,1 5,3 4)')", "ST_GEOMFROMTEXT('POLYGON((0 0,4 0,4 4,0 4,0 0))')"
for _n, (_e, _o) in {
    "mbrdisjoint": (f"MBRDISJOINT({_SQUARE}, POINT(5, 5))", "1"), "mbrequals": (f"MBREQUALS({_SQUARE}, ST_GEOMFROMTEXT('LINESTRING(0 0,4 4)'))", "1"), "mbrintersects": (f"MBRINTERSECTS({_SQUARE}, {_LINE})", "1"), "mbrwithin": (f"MBRWITHIN(POINT(1, 1), {_SQUARE})", "1"),
    "st_asbinary": (f"LENGTH(ST_ASBINARY({_LINE}))", "57"), "st_aswkt": (f"ST_ASWKT({_LINE})", "'LINESTRING(0 0,1 5,3 4)'"), "st_dimension": (f"ST_DIMENSION({_SQUARE})", "2"), "st_startpoint": (f"ST_ASTEXT(ST_STARTPOINT({_LINE}))", "'POINT(0 0)'"), "st_endpoint": (f"ST_ASTEXT(ST_ENDPOINT({_LINE}))", "'POINT(3 4)'"),
    "st_exteriorring": (f"ST_ASTEXT(ST_EXTERIORRING({_HOLED}))", "'LINESTRING(0 0,9 0,9 9,0 9,0 0)'"), "st_interiorringn": (f"ST_ASTEXT(ST_INTERIORRINGN({_HOLED}, 1))", "'LINESTRING(1 1,2 1,2 2,1 1)'"), "st_numinteriorrings": (f"ST_NUMINTERIORRINGS({_HOLED})", "1"), "st_numinteriorring": (f"ST_NUMINTERIORRING({_SQUARE})", "0"),
    "st_geometryn": ("ST_ASTEXT(ST_GEOMETRYN(ST_GEOMFROMTEXT('MULTIPOINT((1 1),(2 2))'), 2))", "'POINT(2 2)'"), "st_numgeometries": ("ST_NUMGEOMETRIES(ST_GEOMFROMTEXT('GEOMETRYCOLLECTION(POINT(1 1),LINESTRING(0 0,1 1))'))", "2"), "st_isclosed": ("ST_ISCLOSED(ST_GEOMFROMTEXT('LINESTRING(0 0,1 1,0 0)'))", "1"), "st_isempty": ("ST_ISEMPTY(ST_GEOMFROMTEXT('GEOMETRYCOLLECTION EMPTY'))", "1"),
    "st_latitude": ("ST_LATITUDE(ST_SRID(POINT(7, 8), 4326))", "CAST(8 AS DOUBLE)"), "st_longitude": ("ST_LONGITUDE(ST_SRID(POINT(7, 8), 4326))", "CAST(7 AS DOUBLE)"),
    **{f"st_{w}fromtext": (f"ST_ASTEXT(ST_{w.upper()}FROMTEXT('{t}'))", f"'{t}'") for w, t in {"geometry": "POINT(1 2)", "point": "POINT(1 2)", "line": "LINESTRING(0 0,1 1)", "linestring": "LINESTRING(0 0,1 1)", "poly": "POLYGON((0 0,1 0,1 1,0 0))", "polygon": "POLYGON((0 0,1 0,1 1,0 0))", "mpoint": "MULTIPOINT((1 1),(2 2))", "multipoint": "MULTIPOINT((1 1),(2 2))", "mline": "MULTILINESTRING((0 0,1 1),(2 2,3 3))", "multilinestring": "MULTILINESTRING((0 0,1 1),(2 2,3 3))", "mpoly": "MULTIPOLYGON(((0 0,1 0,1 1,0 0)))", "multipolygon": "MULTIPOLYGON(((0 0,1 0,1 1,0 0)))", "geomcoll": "GEOMETRYCOLLECTION(POINT(1 1))", "geometrycollection": "GEOMETRYCOLLECTION(POINT(1 1))"}.items()},
    **{f"st_{w}fromwkb": (f"ST_ASTEXT(ST_{w.upper()}FROMWKB(ST_ASWKB(ST_GEOMFROMTEXT('{t}'))))", f"'{t}'") for w, t in {"geometry": "POINT(1 2)", "point": "POINT(1 2)", "line": "LINESTRING(0 0,1 1)", "linestring": "LINESTRING(0 0,1 1)", "poly": "POLYGON((0 0,1 0,1 1,0 0))", "polygon": "POLYGON((0 0,1 0,1 1,0 0))"}.items()},
    "json_extract_paths": ("""JSON_EXTRACT('{"a": [1, 2, {"b": 3}]}', '$.a[last].b', '$.a[0 to 1]')""", "'[3, 1, 2]'"), "json_extract_deep": ("""JSON_EXTRACT('{"a": {"k": 1}, "k": 2}', '$**.k')""", "'[2, 1]'"),
    "session_constants": ("CONCAT(CHARSET('a'), COLLATION('a'), COERCIBILITY('a'), CURRENT_ROLE(), LAST_INSERT_ID(), VERSION(), SCHEMA())", "'utf8mb4utf8mb4_0900_ai_ci4NONE08.4.0-querndefault'"), "user": ("USER() = CURRENT_USER() AND SESSION_USER() = SYSTEM_USER()", "TRUE"),
    "clocks": ("UTC_DATE() >= '2020-01-01' AND CURRENT_DATE() >= '2020-01-01' AND UTC_TIMESTAMP() > '2020-01-01' AND SYSDATE() > '2020-01-01' AND LOCALTIMESTAMP > '2020-01-01' AND CURTIME() <= '23:59:59' AND UTC_TIME() >= '00:00:00' AND CURRENT_TIMESTAMP() > '2020-01-01'", "TRUE"), "uuid_short": ("UUID_SHORT() > 0", "TRUE"),
}.items():
    fn(_n, _e, _o)

# --- shapes of the filter and commerce workloads, re-cast on these tables
both("filter_point", "SELECT event_id, event_type, value FROM events WHERE event_id = 77")
both("filter_recent", "SELECT event_id, ts FROM events WHERE ts >= '2024-01-20 00:00:00' AND event_type <> 'view' ORDER BY ts DESC, event_id LIMIT 50")
both("filter_or_ranges", "SELECT COUNT(*) AS n, ROUND(SUM(value), 2) AS s FROM events WHERE (value BETWEEN 1 AND 5) OR (value > 90 AND event_type IN ('click', 'error')) OR user_id = 3")
both("product_performance", "SELECT p.p_brand, COUNT(DISTINCT o.o_orderkey) AS n_orders, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, RANK() OVER (ORDER BY SUM(l.l_extendedprice * (1 - l.l_discount)) DESC) AS pos FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderstatus <> 'P' GROUP BY p.p_brand", "SELECT p.p_brand, COUNT(DISTINCT o.o_orderkey) AS n_orders, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, CAST(RANK() OVER (ORDER BY SUM(l.l_extendedprice * (1 - l.l_discount)) DESC) AS INTEGER) AS pos FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderstatus <> 'P' GROUP BY p.p_brand")
both("regional_cohorts", "WITH firsts AS (SELECT o_custkey, MIN(o_orderdate) AS first_at FROM orders GROUP BY o_custkey) SELECT r.r_name, YEAR(f.first_at) AS cohort, COUNT(DISTINCT f.o_custkey) AS customers, ROUND(SUM(o.o_totalprice), 2) AS revenue FROM firsts f JOIN orders o ON o.o_custkey = f.o_custkey JOIN customer c ON c.c_custkey = f.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name, cohort", "WITH firsts AS (SELECT o_custkey, MIN(o_orderdate) AS first_at FROM orders GROUP BY o_custkey) SELECT r.r_name, CAST(YEAR(f.first_at) AS INTEGER) AS cohort, COUNT(DISTINCT f.o_custkey) AS customers, ROUND(SUM(o.o_totalprice), 2) AS revenue FROM firsts f JOIN orders o ON o.o_custkey = f.o_custkey JOIN customer c ON c.c_custkey = f.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY ALL")
both("customer_latest_order", "SELECT c.c_custkey, (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_orderdate DESC, o.o_orderkey DESC LIMIT 1) AS latest FROM customer c")
both("interval_join", "SELECT s.s_suppkey, COUNT(*) AS n FROM supplier s JOIN part p ON p.p_retailprice BETWEEN s.s_acctbal / 10 AND s.s_acctbal / 10 + 200 GROUP BY s.s_suppkey")
both("gap_and_island", "SELECT o_custkey, COUNT(*) AS orders_n, SUM(fresh) AS bursts FROM (SELECT o_custkey, CASE WHEN LAG(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL OR DATEDIFF(o_orderdate, LAG(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) > 90 THEN 1 ELSE 0 END AS fresh FROM orders) t GROUP BY o_custkey", "SELECT o_custkey, COUNT(*) AS orders_n, CAST(SUM(fresh) AS BIGINT) AS bursts FROM (SELECT o_custkey, CASE WHEN LAG(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL OR date_diff('day', CAST(LAG(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE), CAST(o_orderdate AS DATE)) > 90 THEN 1 ELSE 0 END AS fresh FROM orders) t GROUP BY o_custkey")
both("rollup_having", "SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey WITH ROLLUP HAVING COUNT(*) > 20", "SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey) HAVING COUNT(*) > 20")

# --- windows and grouping without what Spark asks for
both("win_row_number_no_order", "SELECT COUNT(*) AS n, MAX(r) AS top FROM (SELECT ROW_NUMBER() OVER () AS r FROM customer) t")
both("win_ignored_frame", "SELECT n_nationkey, RANK() OVER (PARTITION BY n_regionkey ORDER BY n_name ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS r FROM nation", "SELECT n_nationkey, CAST(RANK() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS INTEGER) AS r FROM nation")
both("agg_grouping_pair", "SELECT c_nationkey, c_mktsegment, GROUPING(c_nationkey, c_mktsegment) AS g, COUNT(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment WITH ROLLUP", "SELECT c_nationkey, c_mktsegment, GROUPING(c_nationkey, c_mktsegment) AS g, COUNT(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")

# --- text that meets numbers, and numbers that stand as conditions
both("coerce_text_literal", "SELECT c_custkey, c_custkey + '2 more' AS more FROM customer WHERE c_custkey <= '10abc'", "SELECT c_custkey, c_custkey + 2 AS more FROM customer WHERE c_custkey <= 10")
both("coerce_text_column", "SELECT COUNT(*) AS n FROM customer WHERE c_mktsegment = 0 AND c_mktsegment < 1", "SELECT COUNT(*) AS n FROM customer")
both("coerce_join_key", "SELECT n.n_nationkey, r.r_name FROM nation n JOIN (SELECT CAST(r_regionkey AS CHAR) AS key_text, r_name FROM region) r ON n.n_regionkey = r.key_text", "SELECT n.n_nationkey, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
both("numeric_column_truth", "SELECT n_nationkey FROM nation WHERE n_regionkey AND NOT n_nationkey OR n_regionkey", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 0 AND NOT n_nationkey <> 0 OR n_regionkey <> 0")

# --- joins on ranges, from text: cells instead of a nested loop
both("range_join_times", "SELECT a.event_type, COUNT(*) AS n FROM events a JOIN events b ON a.ts >= b.ts AND a.ts < b.ts + INTERVAL 1 HOUR AND b.event_type = 'error' GROUP BY a.event_type")
both("range_join_numbers", "SELECT l.l_orderkey, COUNT(*) AS n FROM lineitem AS l INNER JOIN nation ON l_quantity BETWEEN n_nationkey - 3 AND n_nationkey + n_regionkey * 2 GROUP BY l.l_orderkey")

both("counted_inequality", "SELECT c.c_nationkey, COUNT(s.s_suppkey) AS n FROM customer c LEFT JOIN supplier s ON s.s_acctbal < c.c_acctbal GROUP BY c.c_nationkey")
both("counted_inequality_inner", "SELECT c.c_nationkey AS k, COUNT(*) AS n FROM customer c JOIN supplier s ON c.c_acctbal < s.s_acctbal GROUP BY c.c_nationkey")
both("counted_inequality_subquery", "SELECT c.c_custkey, (SELECT COUNT(*) FROM supplier s WHERE s.s_acctbal >= c.c_acctbal) AS above, (SELECT COUNT(*) FROM nation n WHERE c.c_nationkey > n.n_nationkey) AS low FROM customer c")

# --- collations: named in the text
both("collate_equal", "SELECT COUNT(*) AS n FROM customer WHERE c_mktsegment COLLATE utf8mb4_0900_ai_ci = 'Bu\u00eflding'", "SELECT COUNT(*) AS n FROM customer WHERE strip_accents(lower(c_mktsegment)) = 'building'")
both("collate_binary", "SELECT SUM(BINARY c_mktsegment = 'building') AS low, COUNT(*) AS n FROM customer".replace("SUM(BINARY c_mktsegment = 'building')", "COUNT(CASE WHEN BINARY c_mktsegment = 'building' THEN 1 END)"), "SELECT 0 AS low, COUNT(*) AS n FROM customer")

#: Queries over tables whose text columns have the dialect's default collation: name -> (text, oracle).
COLLATED: dict[str, tuple[str, str]] = {
    "ci_equal": ("SELECT COUNT(*) AS n FROM customer WHERE c_mktsegment = 'building'", "SELECT COUNT(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building'"),
    "ci_in": ("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('building', 'Machinery')", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')"),
    "ci_between": ("SELECT n_nationkey FROM nation WHERE n_name BETWEEN 'nation_1' AND 'Nation_15'", "SELECT n_nationkey FROM nation WHERE lower(n_name) BETWEEN 'nation_1' AND 'nation_15'"),
    "ci_group": ("SELECT COUNT(*) AS groups, SUM(n) AS n FROM (SELECT s, COUNT(*) AS n FROM (SELECT c_mktsegment AS s FROM customer UNION ALL SELECT LOWER(c_mktsegment) FROM customer) t GROUP BY s) u", "SELECT COUNT(*) AS groups, CAST(SUM(n) AS BIGINT) AS n FROM (SELECT lower(c_mktsegment) AS s, 2 * COUNT(*) AS n FROM customer GROUP BY 1)"),
    "ci_distinct": ("SELECT COUNT(DISTINCT s) AS n FROM (SELECT n_name AS s FROM nation UNION ALL SELECT LOWER(n_name) FROM nation) t", "SELECT COUNT(DISTINCT lower(n_name)) AS n FROM nation"),
    "ci_join": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN (SELECT n_nationkey, LOWER(n_name) AS low FROM nation) b ON a.n_name = b.low", "SELECT n_nationkey AS a, n_nationkey AS b FROM nation"),
    "ci_order": ("SELECT s, ROW_NUMBER() OVER (ORDER BY s) AS k FROM (SELECT n_name AS s FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT LOWER(n_name) FROM nation WHERE n_nationkey % 2 = 1) t", "SELECT s, CAST(ROW_NUMBER() OVER (ORDER BY lower(s)) AS INTEGER) AS k FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS s FROM nation)"),
    "ci_min_max": ("SELECT MIN(s) AS lo, MAX(s) AS hi FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE LOWER(n_name) END AS s FROM nation) t", "SELECT arg_min(s, lower(s)) AS lo, arg_max(s, lower(s)) AS hi FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS s FROM nation)"),
}
