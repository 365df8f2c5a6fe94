"""Joins."""

from pyspark.sql import functions as F

from ..operators import aggregate, joins
from ..plans.regional_panel import YEAR, ZONE
from ..plans.trade_panel import MEMBER, Tables, lines, members, order_year
from ..session import scratch_folder
from ..sources.sinks import write_keyed
from .registry import query, rounded

@query(
    """WITH o AS (SELECT c_nationkey AS nation, year(o_orderdate) AS y, sum(o_totalprice) AS ordered FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
      b AS (SELECT c_nationkey AS nation, year(o_orderdate) AS y, sum(l_extendedprice) AS bought FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
      s AS (SELECT s_nationkey AS nation, year(l_shipdate) AS y, sum(l_extendedprice) AS sold, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
      SELECT nation, CAST(y AS INTEGER) AS year, round(ordered, 2) AS ordered, round(bought, 2) AS bought, round(sold, 2) AS sold, n
      FROM o JOIN b USING (nation, y) JOIN s USING (nation, y)"""
)
def nway_key_join(t: Tables):
    """Measure tables from three sources on one composite key; the aggregates' partitioning serves the joins."""
    key = ["nation", YEAR]
    where = members(t).select(MEMBER, F.col(ZONE).alias("nation"))
    orders = t.orders.groupBy(F.col("o_custkey").alias(MEMBER), order_year().alias(YEAR)).agg(F.sum("o_totalprice").alias("v"))
    bought = lines(t).groupBy(MEMBER, YEAR).agg(F.sum("l_extendedprice").alias("v"))
    sold = t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").cast("int").alias(YEAR)).agg(
        F.sum("l_extendedprice").alias("v"), F.count(F.lit(1)).alias("n")
    )
    supplier = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    frames = [
        orders.join(where, MEMBER).groupBy(*key).agg(F.sum("v").alias("ordered")),
        bought.join(where, MEMBER).groupBy(*key).agg(F.sum("v").alias("bought")),
        sold.join(supplier, "l_suppkey").groupBy(*key).agg(F.sum("v").alias("sold"), F.sum("n").alias("n")),
    ]
    return rounded(joins.join_all(frames, key), 2)


@query(
    """SELECT c_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""
)
def renamed_key_join(t: Tables):
    """Join with differing key names, after collapsing orders to customer x year."""
    o = t.orders.groupBy("o_custkey", order_year().alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    joined = joins.join_renamed(o, t.customer.select("c_custkey", F.col("c_nationkey").alias("nation")), {"o_custkey": "c_custkey"})
    return rounded(joined.groupBy("nation", "year").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), 2)


@query(
    """SELECT s_nationkey, l_returnflag, round(sum(l_extendedprice), 2) AS total FROM lineitem
      JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""
)
def common_key_join(t: Tables):
    """Join on a key both sides name alike."""
    li = t.lineitem.groupBy(F.col("l_suppkey").alias("suppkey"), "l_returnflag").agg(F.sum("l_extendedprice").alias("total"))
    s = t.supplier.select(F.col("s_suppkey").alias("suppkey"), "s_nationkey")
    return rounded(li.join(s, "suppkey").groupBy("s_nationkey", "l_returnflag").agg(F.sum("total").alias("total")), 2)


@query(
    """SELECT o_orderkey, o_orderstatus, round(total, 2) AS total, n_lines FROM orders
      LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS total, count(*) AS n_lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"""
)
def left_enrich(t: Tables):
    """Left outer join: orders without lines keep NULL."""
    li = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"), F.count(F.lit(1)).alias("n_lines"))
    out = joins.enrich(t.orders.select("o_orderkey", "o_orderstatus"), li, {"o_orderkey": "l_orderkey"})
    return rounded(out, 2)


@query(
    """SELECT a.l_suppkey, a.q AS q_hist, b.q AS q_current FROM
      (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) a
      JOIN (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) b USING (l_suppkey)"""
)
def suffix_join(t: Tables):
    """Equal column names on both sides get suffixes."""
    q = lambda s: t.lineitem.filter(F.col("l_linestatus") == s).groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return joins.join_suffixed(q("F"), q("O"), ["l_suppkey"], ("_hist", "_current"))


@query(
    """SELECT c_custkey, c_nationkey, bal FROM customer JOIN
      (SELECT s_nationkey, round(avg(s_acctbal), 4) AS bal FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey"""
)
def zone_to_member(t: Tables):
    """A zone value carried down to its members."""
    zones = t.supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.round(F.avg("s_acctbal"), 4).alias("bal"))
    return joins.to_members(t.customer.select("c_custkey", "c_nationkey"), zones, ["c_nationkey"])


@query(
    """SELECT n_nationkey AS nation, n_name, segment, seg_total FROM nation JOIN (
        SELECT c_nationkey, c_mktsegment AS segment, round(sum(c_acctbal), 2) AS seg_total FROM customer GROUP BY 1, 2) ON n_nationkey = c_nationkey"""
)
def dedup_fanout_join(t: Tables):
    """Values repeated on every member reduced to one per (zone, sector) before the join to geography."""
    c = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    repeated = aggregate.attach_group(c, ["nation", "segment"], {"seg_total": F.round(F.sum("c_acctbal"), 2)})
    geo = t.nation.select(F.col("n_nationkey").alias("nation"), "n_name")
    return joins.fan_out(geo, repeated, ["nation", "segment"], ["seg_total"])


#: Buckets of the tables that ``keyed_tables_join`` lays out.
BUCKETS = 8


def keyed_measures(t: Tables) -> list:
    """Five measure tables on (customer, year), laid out by that key."""
    key = [MEMBER, YEAR]
    o = t.orders.select(F.col("o_custkey").alias(MEMBER), order_year().alias(YEAR), "o_totalprice", "o_orderstatus")
    rows = lines(t).select(*key, "l_extendedprice", "l_quantity", "l_discount")
    frames = {
        "ordered": o.groupBy(*key).agg(F.sum("o_totalprice").alias("ordered")),
        "open": o.groupBy(*key).agg(F.count_if(F.col("o_orderstatus") == "O").alias("n_open")),
        "value": rows.groupBy(*key).agg(F.sum("l_extendedprice").alias("value")),
        "quantity": rows.groupBy(*key).agg(F.sum("l_quantity").alias("quantity")),
        "discount": rows.groupBy(*key).agg(F.max("l_discount").alias("most_off")),
    }
    folder = scratch_folder(t.spark)
    name = folder.rsplit("-", 1)[1]
    return [write_keyed(df, f"panelweave_{k}_{name}", key, BUCKETS, f"{folder}/{k}") for k, df in frames.items()]


@query(
    """WITH o AS (SELECT o_custkey AS cust, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS ordered, count(*) FILTER (o_orderstatus = 'O') AS n_open FROM orders GROUP BY 1, 2),
      l AS (SELECT o_custkey AS cust, CAST(year(o_orderdate) AS INTEGER) AS year, sum(l_extendedprice) AS value, sum(l_quantity) AS quantity, max(l_discount) AS most_off
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
      SELECT cust, year, round(ordered, 2) AS ordered, n_open, round(value, 2) AS value, round(quantity, 2) AS quantity, round(most_off, 2) AS most_off FROM o JOIN l USING (cust, year)"""
)
def keyed_tables_join(t: Tables):
    """Five tables laid out by one key and joined on it without any shuffle."""
    return rounded(joins.join_all(keyed_measures(t), [MEMBER, YEAR]), 2)
