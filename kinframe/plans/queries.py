"""QUERIES and ORACLE_SQL for the operators of the library.

Money is cast to decimal before it is multiplied or summed, and results have one
fixed type on both sides; nested results are flattened to figures.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsoncol, names
from ..functions.predicate import And, Cmp, Col, Not, Or, any_in, expect_one, to_column, where, where_in
from ..operators import assign, compare, discover, integrity, keyblocks, matching, measure, metadata, paging, rangejoin, relation, select
from ..sources import tables as source
from ..sources.scratch import shared_folder
from ..spec import Cardinality, EntitySpec, RelationSpec
from . import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def money(c: str | Column, kind: str = "decimal(12,2)") -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(kind)


def total(c: Column) -> Column:
    """Sums on both sides as decimal(18,2)."""
    return c.cast("decimal(18,2)")


def orders(s, d):
    return source.scan(s, t.ORDERS, d)


def lines(s, d):
    return source.scan(s, t.LINEITEM, d)


def customers(s, d):
    return source.scan(s, t.CUSTOMER, d)


def suppliers(s, d):
    return source.scan(s, t.SUPPLIER, d)


def parts(s, d):
    return source.scan(s, t.PART, d)


def events(s, d):
    return source.scan(s, t.EVENTS, d)


def nations(s, d):
    return source.scan(s, t.NATION, d)


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


# sources and mapping


@query("SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS total FROM orders")
def src1_scan_orders(s, d):
    return select.scalar(select.project(orders(s, d)), select.aggregate_column("count", "*", "n"), total(F.sum(money("o_totalprice"))).alias("total"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_tax FROM lineitem WHERE l_tax = 0.05 AND l_quantity < 3")
def src2_sql_parameters(s, d):
    return source.sql_params(s, "SELECT l_orderkey, l_linenumber, l_partkey, l_tax FROM {lines} WHERE l_tax = :tax AND l_quantity < :q", {"tax": 0.05, "q": 3.0}, lines=lines(s, d))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 25, 600, 999, 123456789)")
def src3_sql_list_parameter(s, d):
    return source.sql_params(s, "SELECT o_orderkey, o_custkey, o_orderstatus FROM {orders} WHERE array_contains(:ids, o_orderkey)", {"ids": [1, 25, 600, 999, 123456789]}, orders=orders(s, d))


@query('SELECT s_suppkey AS "SupplierID", s_name AS "SupplierName", CAST(s_acctbal AS DECIMAL(18,2)) AS "Balance", s_nationkey AS "NationID", \'none\' AS "Reference" FROM supplier')
def src4_conform_supplier(s, d):
    return source.conform(suppliers(s, d), t.SUPPLIER_ENTITY)


@query('SELECT o_orderkey AS "OrderID", o_orderstatus AS "OrderStatus", CAST(o_totalprice AS DECIMAL(12,2)) AS "TotalIncludingTax" FROM orders')
def src5_property_names(s, d):
    spaced = orders(s, d).select(F.col("o_orderkey").alias("WWI Order ID"), F.col("o_orderstatus").alias("WWI Order Status"), money("o_totalprice").alias("Total Including Tax"))
    return names.to_property_names(spaced, "WWI ")


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS sum_k FROM events GROUP BY event_type")
def src6_owned_json(s, d):
    typed = events(s, d).withColumn("props", jsoncol.owned_json("props", "k int"))
    return select.group(typed, ["event_type"], [F.sum("props.k").alias("sum_k")])


def event_lists(s, d) -> DataFrame:
    """(user_id, day, types): the event types of a user's day as a JSON array string."""
    return events(s, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.to_json(F.sort_array(F.collect_set("event_type"))).alias("types"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, CAST(count(DISTINCT event_type) AS INTEGER) AS n_types, min(event_type) AS first_type FROM events GROUP BY user_id, CAST(ts AS DATE)")
def src7_json_array(s, d):
    typed = event_lists(s, d).withColumn("types", jsoncol.json_array("types"))
    return typed.select("user_id", "day", F.size("types").alias("n_types"), F.element_at("types", 1).alias("first_type"))


CHANGES = """
SELECT o.o_orderkey, l.l_linenumber, l.l_partkey, CAST(l.l_quantity AS DECIMAL(12,2)) AS quantity,
       CAST(round(CAST(l.l_quantity AS DECIMAL(12,2)) * CAST(l.l_extendedprice AS DECIMAL(18,4)) * (1 + CAST(l.l_tax AS DECIMAL(6,4))), 2) AS DECIMAL(18,2)) AS total
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
WHERE o.o_orderdate > TIMESTAMP '1998-01-01' AND o.o_orderdate <= TIMESTAMP '1999-01-01'
"""


@query(CHANGES)
def src8_extract_changes(s, d):
    changed = source.extract_changes(orders(s, d), lines(s, d), ts("1998-01-01"), ts("1999-01-01"), changed="o_orderdate", key=("o_orderkey", "l_orderkey"), quantity="l_quantity", price="l_extendedprice", tax="l_tax")
    return changed.select("o_orderkey", "l_linenumber", "l_partkey", money("l_quantity").alias("quantity"), total(F.col("total_including_tax")).alias("total"))


def measurements(s, d) -> DataFrame:
    """Workload, query, option, cost and mem made from events."""
    cell = [(F.col("user_id") % 20).alias("workload"), F.col("event_type").alias("query"), (F.col("user_id") % 7).alias("option")]
    return events(s, d).groupBy(*cell).agg(F.sum(money("value", "decimal(18,2)")).cast("double").alias("cost"), F.count(F.lit(1)).alias("mem"))


MEASUREMENTS = "SELECT user_id % 20 AS workload, event_type AS query, user_id % 7 AS option, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS cost, count(*) AS mem FROM events GROUP BY ALL"


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(round(sum(CAST(CAST(value AS DECIMAL(18,3)) AS DOUBLE)) / 1000, 1) AS DECIMAL(18,1)) AS sum_us FROM events GROUP BY event_type")
def src9_read_report(s, d):
    """A report as the benchmark tool writes it (quoted numbers with units), written from events and read back."""
    folder = shared_folder(s, "report")
    text = F.concat(F.format_number(money("value", "decimal(18,3)"), 3), F.lit(" ns"))
    events(s, d).select(F.col("event_type").alias("Method"), text.alias("Mean")).write.csv(folder, sep=";", header=True, quoteAll=True)
    rows = source.read_report(s, folder).withColumn("ns", measure.with_unit("Mean"))
    return rows.groupBy(F.col("Method").alias("event_type")).agg(F.count("ns").alias("n"), F.round(F.sum("ns") / 1000, 1).cast("decimal(18,1)").alias("sum_us"))


@query(f"SELECT workload, count(*) AS n, CAST(sum(mem) AS BIGINT) AS mem FROM ({MEASUREMENTS}) GROUP BY workload")
def src10_write_measurements(s, d):
    folder = shared_folder(s, "measurements")
    source.write_measurements(measurements(s, d), folder, ("query",))
    back = s.read.parquet(folder)
    return back.groupBy(F.col("workload").cast("long").alias("workload")).agg(F.count(F.lit(1)).alias("n"), F.sum("mem").alias("mem"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 26 AND 29")
def src10_clustered(s, d):
    """Lines written in order of their order, and four orders looked up in the files."""
    folder = shared_folder(s, "clustered")
    source.write_clustered(lines(s, d), folder, ["l_orderkey", "l_linenumber"], bloom=["l_partkey"])
    return where(s.read.parquet(folder), Cmp("l_orderkey", "between", (26, 29))).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


# projection


@query("SELECT * FROM supplier")
def prj1_all_columns(s, d):
    return select.project(suppliers(s, d))


@query("SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier")
def prj2_columns_with_aliases(s, d):
    return select.project(suppliers(s, d), ("s_suppkey", "id"), ("s_name", "name"), ("s_nationkey", "nation"), ("s_acctbal", "balance"))


@query("SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS total FROM orders GROUP BY o_orderstatus")
def prj3_aggregate_in_projection(s, d):
    priced = orders(s, d).withColumn("price", money("o_totalprice"))
    return select.group(priced, ["o_orderstatus"], [select.aggregate_column("sum", "price", "total")]).withColumn("total", total(F.col("total")))


@query("SELECT s_suppkey AS contact_key, s_name AS contact_name, s_nationkey AS bank_nation, s_acctbal AS bank_balance FROM supplier")
def prj4_several_entities(s, d):
    both = select.split_entities(suppliers(s, d), contact=["s_suppkey", "s_name"], bank=["s_nationkey", "s_acctbal"])
    return both.select(F.col("contact.s_suppkey").alias("contact_key"), F.col("contact.s_name").alias("contact_name"), F.col("bank.s_nationkey").alias("bank_nation"), F.col("bank.s_acctbal").alias("bank_balance"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS DECIMAL(12,2)) * CAST(l_extendedprice AS DECIMAL(12,2)) AS DECIMAL(18,2)) AS amount FROM lineitem")
def prj5_computed_column(s, d):
    return lines(s, d).select("l_orderkey", "l_linenumber", total(money("l_quantity") * money("l_extendedprice")).alias("amount"))


@query("SELECT count(DISTINCT o_custkey) AS n_customers FROM orders")
def prj6_single_scalar(s, d):
    return select.scalar(orders(s, d), F.count_distinct("o_custkey").alias("n_customers"))


# filters

OPS = [("=", "eq"), ("<>", "ne"), (">", "gt"), (">=", "ge"), ("<", "lt"), ("<=", "le")]


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE o_custkey {op} 100) AS n_{a}" for op, a in OPS) + " FROM orders")
def flt1_comparisons(s, d):
    from ..functions.predicate import to_column

    return select.scalar(orders(s, d), *[F.count_if(to_column(Cmp("o_custkey", op, 100))).alias(f"n_{a}") for op, a in OPS])


@query("SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice >= c.c_acctbal * 100")
def flt2_column_with_column(s, d):
    met = select.join(orders(s, d), customers(s, d), [("o_custkey", "c_custkey")], aliases=("o", "c"))
    return where(met, Cmp("o.o_totalprice", ">=", F.col("c.c_acctbal") * 100)).select("o_orderkey", "c_custkey")


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'PR%O'")
def flt3_like(s, d):
    return where(parts(s, d), Cmp("p_type", "like", "PR%O")).select("p_partkey", "p_type")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'o')")
def flt4_contains(s, d):
    return where(parts(s, d), Cmp("p_name", "contains", "o")).select("p_partkey", "p_name")


@query("SELECT p_type, p_brand, count(*) AS n, count(*) FILTER (WHERE p_brand ILIKE 'BRAND#1_') AS n_like FROM part WHERE lower(p_type) IN ('promo', 'economy') OR contains(lower(p_type), 'stand') GROUP BY ALL")
def flt4_without_case(s, d):
    """As flt3 to flt5 on a database whose collation ignores case; patterns and columns differ in case."""
    raised = parts(s, d).withColumn("shouted", F.upper("p_type"))
    some = where(raised, Or(Cmp("shouted", "in", ("Promo", "ECONOMY"), ci=True), Cmp("shouted", "contains", "Stand", ci=True)))
    return some.groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(to_column(Cmp("p_brand", "like", "BRAND#1_", ci=True))).alias("n_like"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey IN (1, 2, 3, 700, 800)")
def flt5_in_list(s, d):
    return where(orders(s, d), Cmp("o_orderkey", "in", (1, 2, 3, 700, 800))).select("o_orderkey", "o_orderdate")


@query("SELECT count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT unnest(range(1, 3001)))")
def flt5_long_list(s, d):
    return select.scalar(where_in(lines(s, d), "l_partkey", range(1, 3001)), select.aggregate_column("count", "*", "n"))


def with_nulls(s, d) -> DataFrame:
    """orders with null for an unspecified priority."""
    return orders(s, d).withColumn("priority", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")))


NULLS = "(SELECT *, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority FROM orders)"


@query(f"SELECT count(*) FILTER (WHERE priority IS NULL) AS n_null, count(*) FILTER (WHERE priority IS NOT NULL) AS n_known FROM {NULLS}")
def flt6_is_null(s, d):
    df = with_nulls(s, d)
    return select.scalar(where(df, Cmp("priority", "is null")), F.count(F.lit(1)).alias("n_null")).crossJoin(select.scalar(where(df, Cmp("priority", "is not null")), F.count(F.lit(1)).alias("n_known")))


@query(f"SELECT o_orderkey FROM {NULLS} WHERE priority IS NULL AND o_orderstatus = 'F'")
def flt7_null_literal(s, d):
    return where(with_nulls(s, d), Cmp("priority", "=", None), Cmp("o_orderstatus", "=", "F")).select("o_orderkey")


@query("SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE (o_orderstatus = 'F' OR o_custkey < 50) AND o_totalprice > 1000")
def flt8_and_or(s, d):
    tree = (Cmp("o_orderstatus", "=", "F") | Cmp("o_custkey", "<", 50)) & Cmp("o_totalprice", ">", 1000)
    return where(orders(s, d), tree).select("o_orderkey", "o_orderstatus", "o_custkey")


@query(f"SELECT o_orderkey, priority FROM {NULLS} WHERE NOT (priority = '1-URGENT' OR o_orderstatus = 'F')")
def flt9_not(s, d):
    return where(with_nulls(s, d), Not(Or(Cmp("priority", "=", "1-URGENT"), Cmp("o_orderstatus", "=", "F")))).select("o_orderkey", "priority")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 50000")
def flt10_several_wheres(s, d):
    return where(where(orders(s, d), Cmp("o_orderstatus", "=", "O")), Cmp("o_totalprice", "<", 50000)).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-03-12'")
def flt11_range(s, d):
    return where(lines(s, d), Cmp("l_shipdate", "between", (ts("1997-03-01"), ts("1997-03-12")))).select("l_orderkey", "l_linenumber", "l_shipdate")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 26")
def flt12_by_key(s, d):
    return where(lines(s, d), Cmp("l_orderkey", "=", 26)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem WHERE l_tax = 0.02")
def flt12_by_any_column(s, d):
    return select.scalar(where(lines(s, d), Cmp("l_tax", "=", 0.02)), F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


@query("SELECT * FROM orders WHERE o_orderkey = 25")
def flt13_exactly_one(s, d):
    return expect_one(orders(s, d), Cmp("o_orderkey", "=", 25))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING sum(CAST(o_totalprice AS DECIMAL(12,2))) > 1000000")
def flt14_function_operand(s, d):
    grouped = orders(s, d).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(money("o_totalprice")).alias("total"))
    return where(grouped, Cmp(F.col("total"), ">", 1000000)).select("o_custkey", "n")


@query("SELECT user_id, CAST(ts AS DATE) AS day FROM events GROUP BY ALL HAVING bool_or(event_type = 'purchase')")
def flt15_exists_in_array(s, d):
    return where(event_lists(s, d), any_in(jsoncol.json_array("types"), "purchase")).select("user_id", "day")


@query("SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 48")
def flt16_any_child(s, d):
    return relation.with_any_child(orders(s, d).select("o_orderkey"), lines(s, d), t.ORDER_LINES, Cmp("l_quantity", ">", 48))


# joins


@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'")
def jon1_inner(s, d):
    met = select.join(orders(s, d), customers(s, d), [("o_custkey", "c_custkey")], aliases=("o", "c"))
    return where(met, Cmp("c.c_mktsegment", "=", "BUILDING")).select("o_orderkey", "c_name")


@query("SELECT o.o_orderkey FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL")
def jon2_left_outer(s, d):
    met = select.join(orders(s, d), lines(s, d), [("o_orderkey", "l_orderkey")], "left", ("o", "l"))
    return where(met, Cmp("l.l_orderkey", "is null")).select("o_orderkey")


@query("SELECT n.n_name, s.s_suppkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000")
def jon3_right_outer(s, d):
    rich = where(suppliers(s, d), Cmp("s_acctbal", ">", 9000))
    return select.join(rich, nations(s, d), [("s_nationkey", "n_nationkey")], "right", ("s", "n")).select("n_name", "s_suppkey")


@query("SELECT coalesce(c.k, s.k) AS nation, coalesce(c.n, 0) AS n_customers, coalesce(s.n, 0) AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 20 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 4 GROUP BY 1) s ON c.k = s.k")
def jon4_full_outer(s, d):
    per = lambda df, k: df.groupBy(F.col(k).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    c = per(where(customers(s, d), Cmp("c_nationkey", "<", 20)), "c_nationkey")
    p = per(where(suppliers(s, d), Cmp("s_nationkey", ">", 4)), "s_nationkey")
    met = select.join(c, p, [("k", "k")], "full", ("c", "s"))
    return met.select(F.coalesce("c.k", "s.k").alias("nation"), F.coalesce("c.n", F.lit(0)).alias("n_customers"), F.coalesce("s.n", F.lit(0)).alias("n_suppliers"))


def part_supplier_pairs(s, d) -> DataFrame:
    return lines(s, d).select("l_partkey", "l_suppkey").distinct()


@query("SELECT count(*) AS n, CAST(sum(l.l_linenumber) AS BIGINT) AS lines FROM lineitem l JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45) p ON l.l_partkey = p.l_partkey AND l.l_suppkey = p.l_suppkey")
def jon5_composite_key(s, d):
    big = where(lines(s, d), Cmp("l_quantity", ">", 45)).select("l_partkey", "l_suppkey").distinct()
    met = select.join(lines(s, d), big, [("l_partkey", "l_partkey"), ("l_suppkey", "l_suppkey")])
    return select.scalar(met, F.count(F.lit(1)).alias("n"), F.sum("l.l_linenumber").alias("lines"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def jon6_semi(s, d):
    return select.join(orders(s, d), where(lines(s, d), Cmp("l_returnflag", "=", "R")), [("o_orderkey", "l_orderkey")], "semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def jon6_anti(s, d):
    return select.join(orders(s, d), lines(s, d), [("o_orderkey", "l_orderkey")], "anti").select("o_orderkey")


@query("SELECT o.o_orderkey, l.l_linenumber, l.l_quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND (l.l_quantity > 49 OR o.o_orderstatus = 'P')")
def jon7_condition_tree(s, d):
    on = And(Cmp("o.o_orderkey", "=", Col("l.l_orderkey")), Or(Cmp("l.l_quantity", ">", 49), Cmp("o.o_orderstatus", "=", "P")))
    return select.join(orders(s, d), lines(s, d), on, aliases=("o", "l")).select("o_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 250")
def jon7_band(s, d):
    """Customers and suppliers of a nation with balances within 250."""
    met = rangejoin.band_join(customers(s, d), suppliers(s, d), "c_acctbal", "s_acctbal", 250.0, [("c_nationkey", "s_nationkey")])
    return met.select("c_custkey", "s_suppkey")


@query("SELECT o_orderkey, l_orderkey, l_linenumber, count(*) AS n FROM orders JOIN lineitem ON o_custkey = l_partkey AND o_orderdate BETWEEN l_shipdate AND l_shipdate + to_days(CAST(l_quantity AS INTEGER)) GROUP BY ALL")
def jon7_interval(s, d):
    """Orders within as many days of a line's shipment as its quantity, by customer and part number."""
    spans = lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", (F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int"))).alias("until"))
    met = rangejoin.interval_join(orders(s, d).select("o_orderkey", "o_custkey", "o_orderdate"), spans, "o_orderdate", "l_shipdate", "until", [("o_custkey", "l_partkey")])
    return met.groupBy("o_orderkey", "l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c.c_mktsegment, count(*) AS n FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY c.c_mktsegment")
def jon8_chain(s, d):
    first = select.join(customers(s, d), orders(s, d), [("c_custkey", "o_custkey")], aliases=("c", "o"))
    met = select.join(first, lines(s, d), [("o_orderkey", "l_orderkey")], aliases=("co", "l"))
    return select.group(met, ["c_mktsegment"], [F.count(F.lit(1)).alias("n")])


@query("SELECT a.s_suppkey AS first_key, b.s_suppkey AS second_key FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def jon9_self_join(s, d):
    on = And(Cmp("a.s_nationkey", "=", Col("b.s_nationkey")), Cmp("a.s_suppkey", "<", Col("b.s_suppkey")))
    return select.join(suppliers(s, d), suppliers(s, d), on, aliases=("a", "b")).select(F.col("a.s_suppkey").alias("first_key"), F.col("b.s_suppkey").alias("second_key"))


NESTED = "SELECT o_orderkey, CAST(count(l_orderkey) AS INTEGER) AS n_lines, min(l_linenumber) AS first_line, max(l_linenumber) AS last_line FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"


def nested_figures(nested: DataFrame) -> DataFrame:
    number = F.transform("lines", lambda x: x["l_linenumber"])
    return nested.select("o_orderkey", F.size("lines").alias("n_lines"), F.array_min(number).alias("first_line"), F.array_max(number).alias("last_line"))


@query(NESTED)
def jon10_key_lookup(s, d):
    return nested_figures(relation.lookup(orders(s, d), lines(s, d).select("l_orderkey", "l_linenumber"), t.ORDER_LINES))


# relations


@query(NESTED)
def rel1_include_many(s, d):
    child = lines(s, d).select("l_orderkey", "l_linenumber", "l_quantity")
    return nested_figures(relation.include_many(orders(s, d), child, t.ORDER_LINES, order_by=["l_linenumber"]))


CHUNKS = """
WITH k AS (SELECT n_nationkey, c_custkey, (row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1) // 16 AS place FROM nation JOIN customer ON n_nationkey = c_nationkey),
f AS (SELECT n_nationkey, c_custkey, place - min(place) OVER (PARTITION BY n_nationkey) AS chunk FROM k)
SELECT n.n_nationkey, coalesce(chunk, 0) AS chunk, count(c_custkey) AS n_customers, min(c_custkey) AS first_customer FROM nation n LEFT JOIN f ON n.n_nationkey = f.n_nationkey GROUP BY ALL
"""


@query(CHUNKS)
def rel1_in_chunks(s, d):
    """Nations with their customers, 16 a row."""
    by_nation = RelationSpec("customers", Cardinality.ONE_TO_MANY, (("n_nationkey", "c_nationkey"),))
    met = relation.include_in_chunks(nations(s, d), customers(s, d).select("c_nationkey", "c_custkey"), by_nation, 16, order_by=["c_custkey"])
    return met.select("n_nationkey", "chunk", F.size("customers").cast("long").alias("n_customers"), F.array_min(F.transform("customers", lambda x: x["c_custkey"])).alias("first_customer"))


@query("SELECT count(*) AS n_orders, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS n_empty FROM orders")
def rel2_optional_many(s, d):
    nested = relation.include_many(orders(s, d), lines(s, d).select("l_orderkey", "l_linenumber"), t.ORDER_LINES)
    return select.scalar(nested, F.count(F.lit(1)).alias("n_orders"), F.count_if(F.size("lines") == 0).alias("n_empty"))


@query("SELECT p_partkey, CAST(count(k) AS INTEGER) AS n_suppliers, min(k) AS first_supplier, max(k) AS last_supplier FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) ON p_partkey = l_partkey GROUP BY p_partkey")
def rel3_many_to_many(s, d):
    nested = relation.include_many_to_many(parts(s, d), lines(s, d), suppliers(s, d).select("s_suppkey", "s_name"), t.PART_SUPPLIERS)
    key = F.transform("suppliers", lambda x: x["s_suppkey"])
    return nested.select("p_partkey", F.size("suppliers").alias("n_suppliers"), F.array_min(key).alias("first_supplier"), F.array_max(key).alias("last_supplier"))


@query("SELECT s_suppkey, CAST(count(k) AS INTEGER) AS n_parts, min(k) AS first_part, max(k) AS last_part FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey, l_partkey AS k FROM lineitem JOIN part ON l_partkey = p_partkey) ON s_suppkey = l_suppkey GROUP BY s_suppkey")
def rel4_many_to_many_inverse(s, d):
    nested = relation.include_many_to_many(suppliers(s, d), lines(s, d), parts(s, d).select("p_partkey", "p_name"), t.PART_SUPPLIERS.inverse(), "parts")
    key = F.transform("parts", lambda x: x["p_partkey"])
    return nested.select("s_suppkey", F.size("parts").alias("n_parts"), F.array_min(key).alias("first_part"), F.array_max(key).alias("last_part"))


@query("SELECT o_orderkey, c_name AS customer_name, c_custkey IS NULL AS no_customer FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey < 10")
def rel5_include_one(s, d):
    some = where(customers(s, d), Cmp("c_nationkey", "<", 10))
    nested = relation.include_one(orders(s, d), some, t.ORDER_CUSTOMER, "customer")
    return nested.select("o_orderkey", F.col("customer.c_name").alias("customer_name"), F.col("customer").isNull().alias("no_customer"))


@query("SELECT p.l_partkey, p.l_suppkey, CAST(count(*) AS INTEGER) AS n_lines FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) p JOIN lineitem l ON p.l_partkey = l.l_partkey AND p.l_suppkey = l.l_suppkey GROUP BY ALL")
def rel6_composite_relation(s, d):
    rel = RelationSpec("lines", Cardinality.ONE_TO_MANY, (("l_partkey", "l_partkey"), ("l_suppkey", "l_suppkey")))
    nested = relation.include_many(part_supplier_pairs(s, d), lines(s, d).select("l_partkey", "l_suppkey", "l_linenumber"), rel)
    return nested.select("l_partkey", "l_suppkey", F.size("lines").alias("n_lines"))


@query("SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def rel7_flatten(s, d):
    nested = relation.include_many(orders(s, d).select("o_orderkey"), lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey"), t.ORDER_LINES)
    return relation.flatten(nested, "lines").select("o_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c_custkey, CAST(count(DISTINCT o_orderkey) AS INTEGER) AS n_orders, CAST(count(l_orderkey) AS INTEGER) AS n_lines FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_custkey")
def rel8_third_level(s, d):
    deep = relation.include_many(orders(s, d).select("o_orderkey", "o_custkey"), lines(s, d).select("l_orderkey", "l_linenumber"), t.ORDER_LINES)
    nested = relation.include_many(customers(s, d), deep, t.CUSTOMER_ORDERS)
    n_lines = F.aggregate("orders", F.lit(0), lambda a, o: a + F.size(o["lines"]))
    return nested.select("c_custkey", F.size("orders").alias("n_orders"), n_lines.alias("n_lines"))


FLAGSHIP = """
SELECT o_orderkey, o_orderstatus, CAST(count(l_orderkey) AS INTEGER) AS n_lines,
       CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(6,4)))), 0) AS DECIMAL(18,2)) AS revenue
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
"""


@query(FLAGSHIP)
def flagship_orders_with_lines(s, d):
    """Orders with their lines nested, revenue from the nested rows, empty orders kept."""
    child = lines(s, d).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    nested = relation.include_many(orders(s, d).select("o_orderkey", "o_orderstatus"), child, t.ORDER_LINES, order_by=["l_linenumber"])
    zero = F.lit(0).cast("decimal(28,6)")
    revenue = F.aggregate("lines", zero, lambda a, x: (a + money(x["l_extendedprice"]) * (F.lit(1) - money(x["l_discount"], "decimal(6,4)"))).cast("decimal(28,6)"))
    return nested.select("o_orderkey", "o_orderstatus", F.size("lines").alias("n_lines"), total(revenue).alias("revenue"))


# aggregation


@query("SELECT l_tax, count(*) AS n FROM lineitem GROUP BY l_tax")
def agg1_count_by_tax(s, d):
    return select.count_by(lines(s, d), "l_tax")


@query("SELECT max(l_extendedprice) AS max_price FROM lineitem")
def agg2_global_max(s, d):
    return select.scalar(lines(s, d), select.aggregate_column("max", "l_extendedprice", "max_price"))


@query("SELECT CAST(sum(CAST(l_quantity AS DECIMAL(12,2)) * CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(24,2)) AS sales FROM lineitem")
def agg3_sum_of_product(s, d):
    return select.scalar(lines(s, d), F.sum(money("l_quantity") * money("l_extendedprice")).cast("decimal(24,2)").alias("sales"))


@query("SELECT count(o_orderkey) AS n, CAST(sum(o_custkey) AS BIGINT) AS sum_cust, min(o_orderdate) AS first_date, max(o_totalprice) AS max_price, CAST(round(avg(o_custkey), 4) AS DECIMAL(18,4)) AS avg_cust FROM orders")
def agg4_five_aggregates(s, d):
    out = select.scalar(orders(s, d), select.aggregate_column("count", "o_orderkey", "n"), select.aggregate_column("sum", "o_custkey", "sum_cust"), select.aggregate_column("min", "o_orderdate", "first_date"), select.aggregate_column("max", "o_totalprice", "max_price"), select.aggregate_column("avg", "o_custkey", "avg_cust"))
    return out.withColumn("avg_cust", F.round("avg_cust", 4).cast("decimal(18,4)"))


@query(f"SELECT o_orderstatus, count(priority) AS n_known, count(*) AS n_rows FROM {NULLS} GROUP BY o_orderstatus")
def agg5_count_skips_nulls(s, d):
    return select.group(with_nulls(s, d), ["o_orderstatus"], [select.aggregate_column("count", "priority", "n_known"), select.aggregate_column("count", "*", "n_rows")])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS quantity FROM lineitem GROUP BY ALL")
def agg6_several_keys(s, d):
    return select.group(lines(s, d), ["l_returnflag", "l_linestatus"], [F.count(F.lit(1)).alias("n"), total(F.sum(money("l_quantity"))).alias("quantity")])


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 200000")
def agg7_having(s, d):
    made = [F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top")]
    return select.group(orders(s, d), ["o_custkey"], made, [Cmp("n", ">", 12), Cmp("top", ">", 200000)], keep=["o_custkey"])


REVENUE = "SELECT c_name, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' GROUP BY c_name HAVING sum(CAST(o_totalprice AS DECIMAL(12,2))) > 500000"


@query(f"SELECT *, row_number() OVER (ORDER BY revenue DESC, c_name) AS place FROM ({REVENUE}) ORDER BY place LIMIT 100")
def agg8_whole_query(s, d):
    met = where(select.join(customers(s, d), orders(s, d), [("c_custkey", "o_custkey")]), Cmp("o_orderstatus", "<>", "P"))
    grouped = select.group(met, ["c_name"], [total(F.sum(money("o_totalprice"))).alias("revenue")], Cmp("revenue", ">", 500000))
    top = select.order(grouped, ("revenue", False), "c_name").limit(100)
    return integrity.dense_keys(top.withColumn("down", -F.col("revenue")), ["down", "c_name"], "place").drop("down")


@query("SELECT DISTINCT o_orderpriority FROM orders")
def agg9_distinct(s, d):
    return select.distinct_values(orders(s, d), "o_orderpriority")


@query("SELECT string_agg(k || '=' || n, ',' ORDER BY k) AS text FROM (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1)")
def agg10_as_map(s, d):
    mapped = select.as_map(select.count_by(orders(s, d), "o_orderstatus"), "o_orderstatus", "n")
    return mapped.select(F.array_join(F.transform(F.array_sort(F.map_entries("map")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("text"))


# windows, order, pages, sets


@query("SELECT event_id, CAST(round(avg(CAST(value AS DECIMAL(18,6))) OVER w + 0.00000007, 3) AS DECIMAL(18,3)) AS running FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def win1_running_mean(s, d):
    out = measure.running_mean(events(s, d).withColumn("v", money("value", "decimal(18,6)")), ["event_type", "user_id"], ["ts", "event_id"], "v")
    return out.select("event_id", F.round(F.col("running_mean").cast("double") + 0.00000007, 3).cast("decimal(18,3)").alias("running"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def srt1_several_keys(s, d):
    return select.order(orders(s, d), ("o_totalprice", False), "o_orderkey").limit(50).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT o_custkey, count(*) AS orders_made FROM orders GROUP BY o_custkey ORDER BY orders_made DESC, o_custkey LIMIT 20")
def srt2_by_alias(s, d):
    grouped = select.group(orders(s, d), ["o_custkey"], [F.count(F.lit(1)).alias("orders_made")])
    return select.order(grouped, ("orders_made", False), "o_custkey").limit(20)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1000")
def srt3_first_1000(s, d):
    return select.first_n(orders(s, d).select("o_orderkey", "o_orderdate"), t.ORDERS, 1000, "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 1000")
def srt4_page(s, d):
    return select.page(orders(s, d).select("o_orderkey", "o_orderdate"), t.ORDERS, 1000, 50, "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET (SELECT CAST(floor(count(*) * 0.9) AS BIGINT) FROM orders)")
def srt4_page_by_rank(s, d):
    """A page nine tenths into the orders, latest first."""
    found = orders(s, d).select("o_orderkey", "o_orderdate")
    return paging.page_by_rank(found, t.ORDERS, int(found.count() * 0.9), 50, ("o_orderdate", False))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50")
def srt5_page_after(s, d):
    return select.page_after(orders(s, d).select("o_orderkey", "o_custkey"), t.ORDERS, 1000, 50)


def supplier_keys(s, d, *trees) -> DataFrame:
    return where(suppliers(s, d), *trees).select("s_suppkey", "s_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey < 8 UNION SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey BETWEEN 5 AND 10")
def set1_union(s, d):
    return select.set_operation(supplier_keys(s, d, Cmp("s_suppkey", "<", 8)), supplier_keys(s, d, Cmp("s_suppkey", "between", (5, 10))), "union")


@query("SELECT s_suppkey, count(*) AS n FROM (SELECT s_suppkey FROM supplier WHERE s_suppkey < 8 UNION ALL SELECT s_suppkey FROM supplier WHERE s_suppkey BETWEEN 5 AND 10) GROUP BY 1")
def set2_union_all(s, d):
    both = select.set_operation(supplier_keys(s, d, Cmp("s_suppkey", "<", 8)), supplier_keys(s, d, Cmp("s_suppkey", "between", (5, 10))), "union all")
    return select.group(both, ["s_suppkey"], [F.count(F.lit(1)).alias("n")])


@query("SELECT l_partkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity < 5")
def set3_intersect(s, d):
    keys = lambda op, q: where(lines(s, d), Cmp("l_quantity", op, q)).select("l_partkey")
    return select.set_operation(keys(">", 45), keys("<", 5), "intersect")


@query("SELECT l_partkey FROM lineitem WHERE l_quantity > 25 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 5")
def set4_except(s, d):
    keys = lambda op, q: where(lines(s, d), Cmp("l_quantity", op, q)).select("l_partkey")
    return select.set_operation(keys(">", 25), keys("<", 5), "except")


@query("SELECT l_partkey, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 25 EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_quantity < 15) GROUP BY 1")
def set5_except_all(s, d):
    keys = lambda op, q: where(lines(s, d), Cmp("l_quantity", op, q)).select("l_partkey")
    return select.group(select.set_operation(keys(">", 25), keys("<", 15), "except all"), ["l_partkey"], [F.count(F.lit(1)).alias("n")])


# functions


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) = 69")
def fun1_json_path(s, d):
    return where(events(s, d).withColumn("k", jsoncol.json_value("props", "$.k", "int")), Cmp("k", "=", 69)).select("event_id", "k")


@query("SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events")
def fun2_json_array_rows(s, d):
    return event_lists(s, d).select("user_id", "day", F.explode(jsoncol.json_array("types")).alias("event_type"))


@query("SELECT event_type, CAST(round(sqrt(var_samp(value)), 6) AS DECIMAL(18,6)) AS deviation FROM events GROUP BY event_type")
def fun6_deviation(s, d):
    return select.group(events(s, d), ["event_type"], [F.round(F.sqrt(F.var_samp("value")), 6).cast("decimal(18,6)").alias("deviation")])


# metadata


@query("SELECT 'orders' AS table_name, count(*) AS n_rows, count(DISTINCT o_orderkey) AS keys FROM orders UNION ALL SELECT 'supplier', count(*), count(DISTINCT s_suppkey) FROM supplier")
def met3_key_candidates(s, d):
    facts = [metadata.profile(df.select(*spec.key), spec.table_name, exact=True) for spec, df in ((t.ORDERS, orders(s, d)), (t.SUPPLIER, suppliers(s, d)))]
    return facts[0].unionByName(facts[1]).filter("key_candidate").select("table_name", "n_rows", F.col("n_distinct").alias("keys"))


PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct, {f'CAST(max(length({c})) AS INTEGER)' if text else 'CAST(NULL AS INTEGER)'} AS max_length FROM orders" for c, text in (("o_orderkey", False), ("o_custkey", False), ("o_orderstatus", True), ("o_totalprice", False), ("o_orderdate", False), ("o_orderpriority", True)))


@query(PROFILE)
def met3_profile_orders(s, d):
    return metadata.profile(orders(s, d), "orders", exact=True).select("column_name", "n_nulls", "n_distinct", "max_length")


KEY_TABLES = (t.EVENTS, t.PART)
SETS = {spec.table_name: [c for size in (1, 2, 3) for c in combinations([p.name for p in spec.properties], size)] for spec in KEY_TABLES}
COUNTED_SETS = " UNION ALL ".join(f"SELECT '{name}' AS table_name, [{', '.join(repr(c) for c in cols)}] AS cols, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(cols)} FROM {name})) = (SELECT count(*) FROM {name}) AS is_key" for name, sets in SETS.items() for cols in sets)


@query(f"""
WITH s AS ({COUNTED_SETS}), k AS (SELECT table_name, cols FROM s WHERE is_key)
SELECT table_name, array_to_string(cols, ',') AS columns, CAST(len(cols) AS INTEGER) AS n_columns FROM k
WHERE NOT EXISTS (SELECT 1 FROM k AS o WHERE o.table_name = k.table_name AND len(o.cols) < len(k.cols) AND list_has_all(k.cols, o.cols))
""")
def met3_composite_keys(s, d):
    """Every minimal key of up to three columns of events and part."""
    return discover.composite_keys({spec.table_name: source.scan(s, spec, d) for spec in KEY_TABLES})


KINDS = {"bigint": "i", "int": "i", "string": "s", "double": "d", "timestamp_ntz": "t"}
VALUES = " UNION ALL ".join(f"SELECT '{spec.table_name}' AS t, '{p.name}' AS c, '{KINDS[p.type.simpleString()]}' AS kind, CAST({p.name} AS VARCHAR) AS v, count(*) AS n FROM {spec.table_name} WHERE {p.name} IS NOT NULL GROUP BY ALL" for spec in t.ALL for p in spec.properties)


@query(f"""
WITH v AS MATERIALIZED ({VALUES}), c AS (SELECT t, c, kind, count(*) AS n_values, max(n) = 1 AS is_unique FROM v GROUP BY ALL),
keys AS (SELECT * FROM c WHERE is_unique),
met AS (SELECT a.t AS at, a.c AS ac, b.t AS bt, b.c AS bc, count(*) AS n FROM v a JOIN v b ON a.kind = b.kind AND a.v = b.v JOIN keys k ON b.t = k.t AND b.c = k.c WHERE (a.t, a.c) <> (b.t, b.c) GROUP BY ALL)
SELECT met.at AS table_name, met.ac AS column_name, met.bt AS ref_table, met.bc AS ref_column, x.n_values, k.n_values AS n_ref, x.is_unique
FROM met JOIN c x ON x.t = met.at AND x.c = met.ac JOIN keys k ON k.t = met.bt AND k.c = met.bc WHERE n = x.n_values
""")
def met3_inclusions(s, d):
    """Every column of every table whose values all occur in a key of any table."""
    return discover.inclusions({spec.table_name: source.scan(s, spec, d) for spec in t.ALL})


SPARK_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP"}


MET_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
COUNTED = " UNION ALL ".join(f"SELECT '{x}' AS table_name, count(*) AS n_rows FROM {x}" for x in MET_TABLES)


@query(f"SELECT c.table_name, column_name, CAST(column_index AS INTEGER) AS position, data_type, n_rows, CAST(0 AS BIGINT) AS n_nulls FROM duckdb_columns() c JOIN ({COUNTED}) t ON c.table_name = t.table_name")
def met1_column_types(s, d):
    """Types from the schemas, rows and nulls from the data (which has no null)."""
    rows = metadata.column_facts(s, {spec.table_name: source.scan(s, spec, d) for spec in t.ALL})
    names_ = F.create_map(*[F.lit(x) for kv in SPARK_NAMES.items() for x in kv])
    return rows.select("table_name", "column_name", "position", F.element_at(names_, F.col("data_type")).alias("data_type"), "n_rows", "n_nulls")


FOUND = """
WITH t AS ({COUNTED}), wanted AS (SELECT unnest(['Supplier', 'order', 'parts', 'nobody']) AS name),
ranked AS (
  SELECT name, table_name, n_rows, row_number() OVER (PARTITION BY name ORDER BY (table_name <> lower(name))::INT, table_name) AS k
  FROM wanted JOIN t ON table_name = lower(name) OR table_name = lower(name) || 's' OR table_name || 's' = lower(name))
SELECT 'dbo' AS table_schema, table_name, n_rows FROM ranked WHERE k = 1
""".replace("{COUNTED}", COUNTED)


@query(FOUND)
def met2_find_table(s, d):
    """Three names that stand for tables and one that does not, with the rows of what is found."""
    rows = metadata.column_facts(s, {spec.table_name: source.scan(s, spec, d) for spec in t.ALL}, "dbo")
    found = None
    for name in ("Supplier", "order", "parts", "nobody"):
        one = metadata.find_table(rows, name, "dbo")
        found = one if found is None else found.unionByName(one)
    return found.join(rows.groupBy("table_schema", "table_name").agg(F.max("n_rows").alias("n_rows")), ["table_schema", "table_name"])


# integrity


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key1_duplicate_keys(s, d):
    return integrity.duplicate_keys(lines(s, d), ["l_orderkey", "l_linenumber"])


KEYED_ORDERS = EntitySpec("Order", tuple(p if p.name != "o_orderpriority" else type(p)(p.name, p.type, nullable=False, max_length=8) for p in t.ORDERS.properties), ("o_orderkey",), "orders")


@query("SELECT * FROM (SELECT 'o_orderkey: null' AS rule, count(*) FILTER (WHERE o_orderkey IS NULL) AS n FROM o UNION ALL SELECT 'o_orderpriority: null', count(*) FILTER (WHERE p IS NULL) FROM o UNION ALL SELECT 'o_orderpriority: longer than 8', count(*) FILTER (WHERE length(p) > 8) FROM o UNION ALL SELECT 'key: repeated', (SELECT count(*) FROM (SELECT o_orderkey FROM o GROUP BY 1 HAVING count(*) > 1)))".replace("FROM o ", "FROM (SELECT *, nullif(o_orderpriority, '4-NOT SPECIFIED') AS p FROM orders) o ").replace("FROM o)", "FROM orders)"))
def key1_rule_summary(s, d):
    df = with_nulls(s, d).withColumn("o_orderpriority", F.col("priority")).drop("priority")
    return integrity.summary(df, KEYED_ORDERS)


@query("SELECT o_orderkey, k FROM (SELECT o_orderkey, o_custkey + 1 AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer)")
def key2_orphans(s, d):
    moved = orders(s, d).select("o_orderkey", (F.col("o_custkey") + 1).alias("k"))
    return integrity.orphans(moved, customers(s, d), RelationSpec("customer", Cardinality.MANY_TO_ONE, (("k", "c_custkey"),)))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def key3_one_to_one(s, d):
    return integrity.shared_parents(orders(s, d), RelationSpec("customer", Cardinality.ONE_TO_ONE, (("o_custkey", "c_custkey"),)))


@query("SELECT 'repeated pair' AS rule, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'no left side', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3) UNION ALL SELECT 'no right side', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'other columns', CAST(0 AS BIGINT)")
def key4_junction(s, d):
    some = where(parts(s, d), Cmp("p_size", ">", 3))
    to_part = RelationSpec("part", Cardinality.MANY_TO_ONE, (("l_partkey", "p_partkey"),))
    to_supplier = RelationSpec("supplier", Cardinality.MANY_TO_ONE, (("l_suppkey", "s_suppkey"),))
    return integrity.junction_report(part_supplier_pairs(s, d), some, suppliers(s, d), to_part, to_supplier)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders")
def key5_dense_keys(s, d):
    return integrity.dense_keys(orders(s, d).select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus = 'P', o_orderkey) AS id, true AS again FROM orders")
def key5_two_batches(s, d):
    """Open and closed orders, then orders in progress: keys go on, and the first batch again has its old ones."""
    ledger = shared_folder(s, "ledger")
    done, rest = (orders(s, d).where(c).select("o_orderkey") for c in ("o_orderstatus <> 'P'", "o_orderstatus = 'P'"))
    first = keyblocks.continued_keys(done, ["o_orderkey"], ledger, "done")
    second = keyblocks.continued_keys(rest, ["o_orderkey"], ledger, "rest")
    again = keyblocks.continued_keys(done, ["o_orderkey"], ledger, "done").unionByName(keyblocks.continued_keys(rest, ["o_orderkey"], ledger, "rest"))
    return first.unionByName(second).join(again.withColumnRenamed("id", "old"), "o_orderkey").select("o_orderkey", "id", (F.col("id") == F.col("old")).alias("again"))


@query("SELECT count(*) AS n, count(*) AS n_ids FROM orders")
def key6_hilo_keys(s, d):
    return select.scalar(integrity.hilo_keys(orders(s, d)), F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


@query("SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS n_ids, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys, 36 AS length FROM lineitem")
def key7_name_keys(s, d):
    named = integrity.name_keys(lines(s, d), ["l_orderkey", "l_linenumber"])
    return select.scalar(named, F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), F.count_distinct("l_orderkey", "l_linenumber").alias("n_keys"), F.max(F.length("id")).alias("length"))


# measurements


@query("SELECT event_id, CAST(CAST(value AS DECIMAL(18,2)) * 1000 AS DECIMAL(20,2)) AS ns FROM events")
def msr1_units(s, d):
    text = events(s, d).select("event_id", F.concat(F.format_number(money("value", "decimal(18,2)"), 2), F.lit(" us")).alias("shown"))
    return text.select("event_id", F.round(measure.with_unit("shown"), 2).cast("decimal(20,2)").alias("ns"))


BYTES = "CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END"


@query(f"SELECT event_id, CAST(round(CAST(abs(CAST(value AS DECIMAL(18,2))) AS DOUBLE) * {BYTES}, 0) AS BIGINT) AS bytes FROM events")
def msr1_byte_units(s, d):
    """Allocations as a report shows them: B, KB, MB and GB, with thousands separators."""
    unit = F.element_at(F.array(*[F.lit(u) for u in (" B", " KB", " MB", " GB")]), (F.col("event_id") % 4 + 1).cast("int"))
    text = events(s, d).select("event_id", F.concat(F.format_number(F.abs(money("value", "decimal(18,2)")), 2), unit).alias("shown"))
    return text.select("event_id", F.round(measure.with_unit("shown"), 0).cast("long").alias("bytes"))


@query("SELECT event_id, trim(event_type || ' ' || CASE WHEN user_id % 3 = 0 THEN '' ELSE CAST(user_id % 3 AS VARCHAR) END) AS label FROM events WHERE event_type IN ('purchase', 'click')")
def msr2_result_rows(s, d):
    raw = events(s, d).withColumn("params", F.when(F.col("user_id") % 3 != 0, (F.col("user_id") % 3).cast("string")))
    return measure.result_rows(raw, "event_type", "event_type", "params", ("purchase", "click")).select("event_id", "label")


@query("SELECT event_type, count(value) AS n, CAST(round(avg(value), 6) AS DECIMAL(18,6)) AS mean, CAST(round(sqrt(var_samp(value) / count(value)), 6) AS DECIMAL(18,6)) AS std_error FROM events GROUP BY event_type")
def msr3_mean_error(s, d):
    out = measure.mean_error(events(s, d), ["event_type"], "value")
    return out.select("event_type", "n", F.round("mean", 6).cast("decimal(18,6)").alias("mean"), F.round("std_error", 6).cast("decimal(18,6)").alias("std_error"))


SCALED = "(SELECT event_type, round(abs(value) * 1000000) + 2000000 AS v FROM events)"


@query(f"SELECT event_type, unit, CAST(round(sum(v / f), 2) AS DECIMAL(24,2)) AS scaled FROM (SELECT *, CASE WHEN m > 1e9 THEN 'sec' WHEN m > 1e6 THEN 'ms' WHEN m > 1e3 THEN 'us' ELSE 'ns' END AS unit, CASE WHEN m > 1e9 THEN 1e9 WHEN m > 1e6 THEN 1e6 WHEN m > 1e3 THEN 1e3 ELSE 1 END AS f FROM {SCALED}, (SELECT min(v) AS m FROM {SCALED})) GROUP BY event_type, unit")
def msr4_common_unit(s, d):
    raw = events(s, d).select("event_type", (F.round(F.abs("value") * 1000000) + 2000000).alias("v"))
    out = measure.common_unit(raw, "v")
    return out.groupBy("event_type", "unit").agg(F.round(F.sum("scaled"), 2).cast("decimal(24,2)").alias("scaled"))


@query("SELECT event_id, CAST(round(avg(CAST(value AS DECIMAL(18,6))) OVER w + 0.00000007, 3) AS DECIMAL(18,3)) AS running FROM events WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def msr5_running_mean_per_launch(s, d):
    clicks = where(events(s, d), Cmp("event_type", "=", "click")).withColumn("v", money("value", "decimal(18,6)"))
    return measure.running_mean(clicks, ["user_id"], ["ts", "event_id"], "v").select("event_id", F.round(F.col("running_mean").cast("double") + 0.00000007, 3).cast("decimal(18,3)").alias("running"))


BOX = """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
m AS (SELECT e.event_type, value, q1, q2, q3, value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) AS inside FROM events e JOIN q USING (event_type))
SELECT event_type, CAST(round(q1, 6) AS DECIMAL(18,6)) AS q1, CAST(round(q2, 6) AS DECIMAL(18,6)) AS q2, CAST(round(q3, 6) AS DECIMAL(18,6)) AS q3,
       CAST(min(value) FILTER (WHERE inside) AS DECIMAL(18,6)) AS low, CAST(max(value) FILTER (WHERE inside) AS DECIMAL(18,6)) AS high, count(*) FILTER (WHERE NOT inside) AS n_outliers
FROM m GROUP BY event_type, m.q1, m.q2, m.q3
"""


@query(BOX)
def msr6_box_figures(s, d):
    out = measure.box_figures(events(s, d), ["event_type"], "value")
    return out.select("event_type", *[F.round(c, 6).cast("decimal(18,6)").alias(c) for c in ("q1", "q2", "q3", "low", "high")], "n_outliers")


OUTLIERS = """
WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS q2, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_totalprice < q2 THEN 'low' ELSE 'high' END AS side FROM orders JOIN q USING (o_orderpriority) WHERE o_totalprice < q1 - 0.4 * (q3 - q1) OR o_totalprice > q3 + 0.4 * (q3 - q1)
"""


@query(OUTLIERS)
def msr6_outliers(s, d):
    return measure.outliers(orders(s, d), ["o_orderpriority"], "o_totalprice", 0.4).select("o_orderkey", "side")


HISTOGRAM = """
WITH e AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
SELECT x.event_type, CAST(least(floor((value - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM events x JOIN e ON x.event_type = e.event_type GROUP BY ALL
"""


@query(HISTOGRAM)
def msr7_histogram(s, d):
    return measure.histogram(events(s, d), ["event_type"], "value", 20).select("event_type", "bin", "n")


@query("SELECT event_type, " + ", ".join(f"CAST(round(avg(CAST(value AS DECIMAL(18,6))) FILTER (WHERE user_id % 7 = {o}), 4) AS DECIMAL(18,4)) AS o{o}" for o in range(7)) + " FROM events GROUP BY event_type")
def msr8_across_options(s, d):
    cells = events(s, d).select("event_type", (F.col("user_id") % 7).alias("option"), money("value", "decimal(18,6)").alias("v"))
    out = measure.across_options(cells, ["event_type"], "option", "v", range(7))
    return out.select("event_type", *[F.round(f"o{o}", 4).cast("decimal(18,4)").alias(f"o{o}") for o in range(7)])


@query(f"SELECT workload, query, option, CAST(rank() OVER (PARTITION BY workload, query ORDER BY cost) AS INTEGER) AS rank, CAST(round(cost / min(cost) OVER (PARTITION BY workload, query), 4) AS DECIMAL(18,4)) AS ratio FROM ({MEASUREMENTS})")
def msr8_ratio_to_best(s, d):
    out = measure.ratio_to_best(measurements(s, d), ["workload", "query"], "option", "cost")
    return out.select("workload", "query", "option", "rank", F.round("ratio", 4).cast("decimal(18,4)").alias("ratio"))


# assignment

WEIGHTED = f"SELECT workload, query, option, cost * (1 + workload % 3) AS cost, mem FROM ({MEASUREMENTS})"


def problem(s, d, max_options: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Measurements, weights 1 + workload % 3 (0 for a weight that must count as 1), limits with a tight memory budget for some."""
    cells = measurements(s, d)
    weight = F.when(F.col("workload") % 3 == 0, 0).otherwise(1 + F.col("workload") % 3)
    weights = cells.select("workload", "query").distinct().withColumn("weight", weight)
    least = cells.groupBy("workload", "query").agg(F.min("mem").alias("low"), F.max("mem").alias("high")).groupBy("workload").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    budget = F.when(F.col("workload") % 4 == 3, 0).when(F.col("workload") % 2 == 0, F.col("high")).otherwise(F.floor((F.col("low") + F.col("high")) / 2))
    return cells, weights, least.select("workload", F.lit(max_options).alias("max_options"), budget.alias("max_mem"))


PAIRS = f"""
WITH c AS ({WEIGHTED}), o AS (SELECT DISTINCT workload, option FROM c), q AS (SELECT workload, count(DISTINCT query) AS nq FROM c GROUP BY 1),
subsets AS (SELECT a.workload, a.option AS x, b.option AS y FROM o a JOIN o b ON a.workload = b.workload AND a.option <= b.option),
best AS (SELECT s.workload, x, y, query, min({{'cost': cost, 'option': option}}) AS b FROM subsets s JOIN c ON c.workload = s.workload AND c.option IN (x, y) GROUP BY ALL),
totals AS (SELECT workload, x, y, sum(b.cost) AS objective, count(*) AS n FROM best GROUP BY ALL),
first AS (SELECT t.*, row_number() OVER (PARTITION BY t.workload ORDER BY round(objective, 3), x, y) AS k FROM totals t JOIN q ON t.workload = q.workload AND n = nq)
SELECT f.workload, query, b.option AS option, CAST(round(objective, 3) AS DECIMAL(18,3)) AS objective FROM first f JOIN best USING (workload, x, y) WHERE k = 1
"""


@query(PAIRS)
def asn1_cheapest(s, d):
    return assign.cheapest(*problem(s, d)).select("workload", "query", "option", F.round("objective", 3).cast("decimal(18,3)").alias("objective"))


BUDGET = f"""
WITH c AS ({WEIGHTED}), o AS (SELECT DISTINCT workload, option FROM c), q AS (SELECT DISTINCT workload, query FROM c),
nq AS (SELECT workload, count(*) AS n FROM q GROUP BY 1),
ranges AS (SELECT workload, query, min(mem) AS low, max(mem) AS high FROM c GROUP BY ALL),
budget AS (SELECT workload, CASE WHEN workload % 4 = 3 THEN 0 WHEN workload % 2 = 0 THEN sum(high) ELSE floor((sum(low) + sum(high)) / 2) END AS max_mem FROM ranges GROUP BY 1),
subsets AS (SELECT a.workload, a.option AS x, b.option AS y FROM o a JOIN o b ON a.workload = b.workload AND a.option <= b.option),
numbered AS (SELECT workload, query, row_number() OVER (PARTITION BY workload ORDER BY query) AS k FROM q),
cells AS (SELECT s.workload, x, y, k, m.query || '=' || c.option AS pick, cost, mem FROM subsets s JOIN c ON c.workload = s.workload AND c.option IN (x, y) JOIN numbered m ON m.workload = c.workload AND m.query = c.query),
ways AS (
  SELECT a.workload, concat_ws(',', a.pick, b.pick, e.pick, f.pick, g.pick) AS picks, a.cost + coalesce(b.cost, 0) + coalesce(e.cost, 0) + coalesce(f.cost, 0) + coalesce(g.cost, 0) AS cost, a.mem + coalesce(b.mem, 0) + coalesce(e.mem, 0) + coalesce(f.mem, 0) + coalesce(g.mem, 0) AS mem,
         1 + (b.k IS NOT NULL)::INT + (e.k IS NOT NULL)::INT + (f.k IS NOT NULL)::INT + (g.k IS NOT NULL)::INT AS n
  FROM cells a
  LEFT JOIN cells b ON b.workload = a.workload AND b.x = a.x AND b.y = a.y AND b.k = 2
  LEFT JOIN cells e ON e.workload = a.workload AND e.x = a.x AND e.y = a.y AND e.k = 3
  LEFT JOIN cells f ON f.workload = a.workload AND f.x = a.x AND f.y = a.y AND f.k = 4
  LEFT JOIN cells g ON g.workload = a.workload AND g.x = a.x AND g.y = a.y AND g.k = 5
  WHERE a.k = 1)
SELECT b.workload, CASE WHEN min(w.cost) IS NULL THEN 'infeasible' ELSE 'ok' END AS status, CAST(round(min(w.cost), 3) AS DECIMAL(18,3)) AS objective, arg_min(w.picks, w.cost) AS picks
FROM budget b JOIN nq USING (workload) LEFT JOIN ways w ON w.workload = b.workload AND w.mem <= b.max_mem AND w.n = nq.n GROUP BY b.workload
"""


@query(f"SELECT workload, option, count(*) AS n_queries FROM ({PAIRS}) GROUP BY ALL")
def asn1_selected(s, d):
    """The options that the cheapest assignment uses."""
    return assign.selected_options(assign.cheapest(*problem(s, d))).select("workload", "option", "n_queries")


@query(BUDGET)
def asn2_with_budget(s, d):
    out = assign.assignment(*problem(s, d))
    picks = F.sort_array(F.collect_list(F.when(F.col("query").isNotNull(), F.concat("query", F.lit("="), F.col("option").cast("string")))))
    return out.groupBy("workload", "status").agg(F.round(F.max("objective"), 3).cast("decimal(18,3)").alias("objective"), F.nullif(F.array_join(picks, ","), F.lit("")).alias("picks"))


@query(f"SELECT workload, CAST(round(sum(least_cost), 3) AS DECIMAL(18,3)) AS cost FROM (SELECT workload, query, min(CAST(cost AS DECIMAL(18,4))) AS least_cost FROM ({WEIGHTED}) GROUP BY ALL) GROUP BY workload")
def asn3_weights_below_one(s, d):
    cells, weights, _ = problem(s, d)
    return assign.greedy(cells, weights).groupBy("workload").agg(F.round(F.sum(money("cost", "decimal(18,4)")), 3).cast("decimal(18,3)").alias("cost"))


EVERYTHING = f"WITH c AS ({WEIGHTED}), q AS (SELECT workload, count(DISTINCT query) AS needed FROM c GROUP BY 1) SELECT c.workload, option, CAST(round(sum(CAST(cost AS DECIMAL(18,4))), 3) AS DECIMAL(18,3)) AS cost, CAST(sum(mem) AS BIGINT) AS mem FROM c JOIN q ON c.workload = q.workload GROUP BY c.workload, option HAVING count(*) = max(needed)"


@query(EVERYTHING)
def asn4_everything_on(s, d):
    cells, weights, _ = problem(s, d)
    return assign.everything_on(cells, weights).select("workload", "option", F.round(money("cost", "decimal(18,4)"), 3).cast("decimal(18,3)").alias("cost"), "mem")


@query(f"SELECT workload, CAST(min(cost) AS DECIMAL(18,3)) AS cost FROM ({EVERYTHING}) GROUP BY workload")
def asn5_best_single(s, d):
    cells, weights, _ = problem(s, d)
    return assign.best_single(cells, weights).select("workload", F.round(money("cost", "decimal(18,4)"), 3).cast("decimal(18,3)").alias("cost"))


ONE_OPTION = f"""
WITH c AS ({MEASUREMENTS}), ranges AS (SELECT workload, query, min(mem) AS low, max(mem) AS high FROM c GROUP BY ALL),
budget AS (SELECT workload, count(*) AS nq, CASE WHEN workload % 4 = 3 THEN 0 WHEN workload % 2 = 0 THEN sum(high) ELSE floor((sum(low) + sum(high)) / 2) END AS max_mem FROM ranges GROUP BY 1),
sums AS (SELECT workload, option, sum(mem) AS mem, count(*) AS n FROM c GROUP BY ALL)
SELECT b.workload, CASE WHEN count(s.option) > 0 THEN 'ok' ELSE 'infeasible' END AS status FROM budget b LEFT JOIN sums s ON s.workload = b.workload AND s.n = nq AND s.mem <= max_mem GROUP BY b.workload
"""


@query(ONE_OPTION)
def asn6_infeasible_rows(s, d):
    """One option for each workload: budgets of nothing, of half and of plenty."""
    return assign.assignment(*problem(s, d, 1)).select("workload", "status").distinct()


# comparison


@query("SELECT o_orderkey, CAST(NULL AS VARCHAR) AS only, 'o_totalprice' AS differing FROM orders WHERE o_orderkey % 97 = 0")
def dif1_by_key(s, d):
    changed = orders(s, d).withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 97 == 0, 1.0).otherwise(0.0001))
    out = compare.differences_by_key(orders(s, d), changed, ["o_orderkey"], tolerance=0.01)
    return out.select("o_orderkey", "only", F.array_join("differing", ",").alias("differing"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 5 THEN 'left' WHEN o_orderkey % 1000 = 7 THEN 'right' END AS only, CASE WHEN o_orderkey % 1000 = 3 THEN 'o_totalprice' ELSE '' END AS differing FROM orders WHERE o_orderkey % 1000 IN (3, 5, 7)")
def dif1_by_ranges(s, d):
    """One order in a thousand changed, one missing on either side: only their ranges are exchanged."""
    k = F.col("o_orderkey") % 1000
    changed = orders(s, d).where(k != 5).withColumn("o_totalprice", F.col("o_totalprice") + F.when(k == 3, 1.0).otherwise(0.0))
    out = matching.differences_by_ranges(orders(s, d).where(k != 7), changed, ["o_orderkey"])
    return out.select("o_orderkey", "only", F.array_join("differing", ",").alias("differing"))


#: Two pointers a group, as a recursion: the lower of both values has no partner, or both are one pair.
TWO_POINTERS = """
WITH RECURSIVE
a AS (SELECT l_partkey AS g, l_extendedprice AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice) AS k FROM lineitem WHERE l_returnflag = 'R'),
b AS (SELECT l_partkey AS g, l_extendedprice AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice) AS k FROM lineitem WHERE l_returnflag = 'A'),
s AS (
  SELECT g, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, CAST(NULL AS DOUBLE) AS lone, CAST(NULL AS INTEGER) AS side FROM (SELECT g FROM a UNION SELECT g FROM b)
  UNION ALL
  SELECT s.g,
         CASE WHEN a.v IS NOT NULL AND (b.v IS NULL OR a.v <= b.v + 0 OR abs(a.v - b.v) <= 4000) AND (b.v IS NULL OR abs(a.v - b.v) <= 4000 OR a.v < b.v) THEN i + 1 ELSE i END,
         CASE WHEN b.v IS NOT NULL AND (a.v IS NULL OR abs(a.v - b.v) <= 4000 OR b.v < a.v) THEN j + 1 ELSE j END,
         CASE WHEN abs(a.v - b.v) <= 4000 THEN NULL WHEN b.v IS NULL OR a.v < b.v THEN a.v ELSE b.v END,
         CASE WHEN abs(a.v - b.v) <= 4000 THEN NULL WHEN b.v IS NULL OR a.v < b.v THEN 1 ELSE -1 END
  FROM s LEFT JOIN a ON a.g = s.g AND a.k = i LEFT JOIN b ON b.g = s.g AND b.k = j WHERE a.v IS NOT NULL OR b.v IS NOT NULL)
SELECT g AS l_partkey, lone AS l_extendedprice, count(*) FILTER (WHERE side = 1) AS n_left, count(*) FILTER (WHERE side = -1) AS n_right FROM s WHERE side IS NOT NULL GROUP BY ALL
"""


@query(TWO_POINTERS)
def dif1_within_tolerance(s, d):
    """Returned against accepted lines of a part: prices within 4,000 of each other are one, each once."""
    side_of = lambda flag: where(lines(s, d), Cmp("l_returnflag", "=", flag)).select("l_partkey", "l_extendedprice")
    return matching.differences_within(side_of("R"), side_of("A"), "l_extendedprice", 4000.0)


SIDES = "SELECT l_partkey, l_suppkey, count(*) FILTER (WHERE l_quantity > 30) AS n_left, count(*) FILTER (WHERE l_quantity < 40) AS n_right FROM lineitem GROUP BY ALL"


@query(f"SELECT * FROM ({SIDES}) WHERE n_left <> n_right")
def dif1_as_multisets(s, d):
    """Lines of more than 30 against lines of less than 40: rows on either side only, and on both in unlike numbers."""
    side_of = lambda op, q: where(lines(s, d), Cmp("l_quantity", op, q)).select("l_partkey", "l_suppkey")
    return compare.differences(side_of(">", 30), side_of("<", 40))


IN_ORDER = """
WITH a AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position, o_orderkey FROM orders),
b AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position, o_orderkey FROM orders WHERE o_orderkey % 1000 <> 999)
SELECT position, CASE WHEN b.o_orderkey IS NULL THEN 'left' WHEN a.o_orderkey IS NULL THEN 'right' END AS only
FROM a FULL JOIN b USING (position) WHERE a.o_orderkey IS DISTINCT FROM b.o_orderkey
"""


@query(IN_ORDER)
def dif1_in_order(s, d):
    """The same orders by date, a few missing on one side: every later position differs."""
    keyed = orders(s, d).select("o_orderdate", "o_orderkey")
    out = compare.differences_in_order(keyed, keyed.filter("o_orderkey % 1000 <> 999"), ["o_orderdate", "o_orderkey"])
    return out.select("position", "only")


@query("""
SELECT c AS column_name, CASE WHEN declared IS NULL THEN measured ELSE declared END AS value, CASE WHEN declared IS NULL THEN 'profile' ELSE 'mapping' END AS source, declared IS NOT NULL AND declared <> measured AS conflict FROM (
  SELECT 'o_orderstatus' AS c, '1' AS declared, CAST(max(length(o_orderstatus)) AS VARCHAR) AS measured FROM orders
  UNION ALL SELECT 'o_orderpriority', NULL, CAST(max(length(o_orderpriority)) AS VARCHAR) FROM orders
  UNION ALL SELECT 'p_name', '4000', CAST(max(length(p_name)) AS VARCHAR) FROM part)
""")
def dif2_merge_facts(s, d):
    """Declared lengths of text columns (one right, one missing, one wrong) against measured ones."""
    measured = metadata.profile(orders(s, d), "orders").unionByName(metadata.profile(parts(s, d), "part")).filter("column_name in ('o_orderstatus', 'o_orderpriority', 'p_name')")
    fact = lambda value, source_, priority: measured.select("table_name", "column_name", F.lit("max_length").alias("fact"), value.cast("string").alias("value"), F.lit(source_).alias("source"), F.lit(priority).alias("priority"))
    declared = F.when(F.col("column_name") == "o_orderstatus", "1").when(F.col("column_name") == "p_name", "4000")
    return compare.merge_facts(fact(F.col("max_length"), "profile", 2).unionByName(fact(declared, "mapping", 1))).select("column_name", "value", "source", "conflict")


def study_forms(s, d) -> dict[str, tuple[DataFrame, DataFrame]]:
    """The 23 queries of the study on these tables: by the library, and as SQL text."""
    o, li, su, pa, ev = orders(s, d), lines(s, d), suppliers(s, d), parts(s, d), events(s, d)
    text = lambda sql, args=None: source.sql_params(s, sql, args or {}, o=o, l=li, s=su, p=pa, e=ev)
    li_cols, o_key = ["l_orderkey", "l_linenumber", "l_partkey"], Cmp("o_orderkey", "=", 25)
    contact = select.split_entities(su, contact=["s_suppkey", "s_name"], bank=["s_nationkey", "s_acctbal"])
    changed = source.extract_changes(o, li, ts("1998-01-01"), ts("1999-01-01"), changed="o_orderdate", key=("o_orderkey", "l_orderkey"), quantity="l_quantity", price="l_extendedprice", tax="l_tax")
    some_orders, pair = where(o, Cmp("o_orderkey", "<=", 200)).select("o_orderkey"), li.select("l_orderkey", "l_linenumber")
    nested = relation.flatten(relation.include_many(some_orders, pair, t.ORDER_LINES), "lines")
    many = relation.flatten(relation.include_many_to_many(pa.select("p_partkey"), li, su.select("s_suppkey"), t.PART_SUPPLIERS), "suppliers")
    kinds = metadata.column_types(s, {"orders": o}).filter("column_name = 'o_totalprice'").select("column_name", "data_type")
    keys = lambda op, v: where(su, Cmp("s_suppkey", op, v)).select("s_suppkey")
    user_days = event_lists(s, d)
    return {
        "A1": (expect_one(o, o_key), text("SELECT * FROM {o} WHERE o_orderkey = :k", {"k": 25})),
        "A2": (select.project(su, ("s_suppkey", "id"), ("s_name", "name")), text("SELECT s_suppkey AS id, s_name AS name FROM {s}")),
        "A3": (contact.select("contact.s_suppkey", "contact.s_name", "bank.s_nationkey", "bank.s_acctbal"), text("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM {s}")),
        "A4": (changed.select("o_orderkey", "l_linenumber", "l_partkey", "l_quantity"), text("SELECT o_orderkey, l_linenumber, l_partkey, l_quantity FROM {o} JOIN {l} ON o_orderkey = l_orderkey WHERE o_orderdate > TIMESTAMP_NTZ'1998-01-01' AND o_orderdate <= TIMESTAMP_NTZ'1999-01-01'")),
        "B1": (where(li, Cmp("l_orderkey", "=", 26)).select(*li_cols), text("SELECT l_orderkey, l_linenumber, l_partkey FROM {l} WHERE l_orderkey = :k", {"k": 26})),
        "B2": (where(li, Cmp("l_tax", "=", 0.05)).select(*li_cols), text("SELECT l_orderkey, l_linenumber, l_partkey FROM {l} WHERE l_tax = :t", {"t": 0.05})),
        "B3": (where(li, Cmp("l_shipdate", "between", (ts("1997-03-01"), ts("1997-03-12")))).select(*li_cols), text("SELECT l_orderkey, l_linenumber, l_partkey FROM {l} WHERE l_shipdate BETWEEN TIMESTAMP_NTZ'1997-03-01' AND TIMESTAMP_NTZ'1997-03-12'")),
        "B4": (where_in(o, "o_orderkey", [1, 2, 3, 700, 800]), text("SELECT * FROM {o} WHERE array_contains(:ids, o_orderkey)", {"ids": [1, 2, 3, 700, 800]})),
        "B5": (where(pa, Cmp("p_name", "contains", "o")).select("p_partkey", "p_name"), text("SELECT p_partkey, p_name FROM {p} WHERE p_name LIKE '%o%'")),
        "B6": (select.page(o, t.ORDERS, 1000, 50, "o_orderkey"), text("SELECT * FROM {o} ORDER BY o_orderkey LIMIT 50 OFFSET 1000")),
        "C1": (select.count_by(li, "l_tax"), text("SELECT l_tax, count(*) AS n FROM {l} GROUP BY l_tax ORDER BY n DESC")),
        "C2": (select.scalar(li, select.aggregate_column("max", "l_extendedprice", "top")), text("SELECT max(l_extendedprice) AS top FROM {l}")),
        "C3": (select.scalar(li, F.sum(money("l_quantity") * money("l_extendedprice")).alias("sales")), text("SELECT sum(CAST(l_quantity AS DECIMAL(12,2)) * CAST(l_extendedprice AS DECIMAL(12,2))) AS sales FROM {l}")),
        "D1": (nested, text("SELECT o_orderkey, l_orderkey, l_linenumber FROM {o} LEFT JOIN {l} ON o_orderkey = l_orderkey WHERE o_orderkey <= 200")),
        "D2": (many, text("SELECT p_partkey, s_suppkey FROM {p} LEFT JOIN (SELECT DISTINCT l_partkey, s_suppkey FROM {l} JOIN {s} ON l_suppkey = s_suppkey) ON p_partkey = l_partkey")),
        "D3": (relation.flat(o.select("o_orderkey"), pair, t.ORDER_LINES), text("SELECT o_orderkey, l_orderkey, l_linenumber FROM {o} LEFT JOIN {l} ON o_orderkey = l_orderkey")),
        "E1": (select.first_n(o.select("o_orderkey", "o_orderdate"), t.ORDERS, 1000, "o_orderdate"), text("SELECT o_orderkey, o_orderdate FROM {o} ORDER BY o_orderdate, o_orderkey LIMIT 1000")),
        "E2": (select.distinct_values(o, "o_orderpriority"), text("SELECT DISTINCT o_orderpriority FROM {o}")),
        "F1": (where(ev.withColumn("k", jsoncol.json_value("props", "$.k", "int")), Cmp("k", "=", 69)).select("event_id", "k"), text("SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {e} WHERE CAST(get_json_object(props, '$.k') AS INT) = 69")),
        "F2": (where(user_days, any_in(jsoncol.json_array("types"), "purchase")).select("user_id", "day"), text("SELECT DISTINCT user_id, to_date(ts) AS day FROM {e} WHERE event_type = 'purchase'")),
        "G1": (select.set_operation(keys("<", 5), keys("between", (5, 10)), "union"), text("SELECT s_suppkey FROM {s} WHERE s_suppkey < :a UNION SELECT s_suppkey FROM {s} WHERE s_suppkey BETWEEN :a AND :b", {"a": 5, "b": 10})),
        "G2": (select.set_operation(keys("<", 10), keys("between", (5, 15)), "intersect"), text("SELECT s_suppkey FROM {s} WHERE s_suppkey < 10 INTERSECT SELECT s_suppkey FROM {s} WHERE s_suppkey BETWEEN 5 AND 15")),
        "H1": (kinds, text("SELECT DISTINCT 'o_totalprice' AS column_name, typeof(o_totalprice) AS data_type FROM {o}")),
    }


STUDY_ROWS = {
    "A1": "orders WHERE o_orderkey = 25",
    "A2": "supplier",
    "A3": "supplier",
    "A4": "orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderdate <= TIMESTAMP '1999-01-01'",
    "B1": "lineitem WHERE l_orderkey = 26",
    "B2": "lineitem WHERE l_tax = 0.05",
    "B3": "lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-03-12'",
    "B4": "orders WHERE o_orderkey IN (1, 2, 3, 700, 800)",
    "B5": "part WHERE contains(p_name, 'o')",
    "B6": "(SELECT 1 FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 1000)",
    "C1": "(SELECT DISTINCT l_tax FROM lineitem)",
    "C2": "(SELECT max(l_extendedprice) FROM lineitem)",
    "C3": "(SELECT sum(l_quantity) FROM lineitem)",
    "D1": "orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey <= 200",
    "D2": "part LEFT JOIN (SELECT DISTINCT l_partkey, s_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) ON p_partkey = l_partkey",
    "D3": "orders LEFT JOIN lineitem ON o_orderkey = l_orderkey",
    "E1": "(SELECT 1 FROM orders LIMIT 1000)",
    "E2": "(SELECT DISTINCT o_orderpriority FROM orders)",
    "F1": "events WHERE CAST(json_extract(props, '$.k') AS INTEGER) = 69",
    "F2": "(SELECT DISTINCT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'purchase')",
    "G1": "supplier WHERE s_suppkey <= 10",
    "G2": "supplier WHERE s_suppkey BETWEEN 5 AND 9",
    "H1": "duckdb_columns() WHERE table_name = 'orders' AND column_name = 'o_totalprice'",
}


@query(" UNION ALL ".join(f"SELECT '{q}' AS q, count(*) AS n_left, count(*) AS n_right, CAST(0 AS BIGINT) AS n_differences FROM {rest}" for q, rest in STUDY_ROWS.items()))
def dif3_two_forms(s, d):
    """All queries of the study in both forms: as many rows as the tables say on either side, and none differs."""
    out = None
    for q, (a, b) in study_forms(s, d).items():
        n = compare.difference_counts(a, b).select(F.lit(q).alias("q"), "*")
        out = n if out is None else out.unionByName(n)
    return out
