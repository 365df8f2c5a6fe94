"""Sources: drifting layouts, dimension lookup."""

from pyspark.sql import functions as F

from ..plans.trade_panel import Tables, order_year
from ..session import scratch_folder
from ..sources import readers, sinks
from .registry import query, rounded


@query(
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS status, count(*) AS n_orders,
      round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2"""
)
def stack_year_files(t: Tables):
    """Three yearly layouts (plain, upper-case names, renamed text column) brought to one and stacked."""
    columns = ["o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), order_year().alias("year")]
    # Date ranges reach the scans, so that each layout reads only its own row groups.
    at = lambda condition: t.orders.filter(condition).select(*columns)
    plain = at("o_orderdate < TIMESTAMP_NTZ '1997-01-01'")
    upper = at("o_orderdate >= TIMESTAMP_NTZ '1997-01-01' AND o_orderdate < TIMESTAMP_NTZ '1999-01-01'")
    upper = upper.toDF("O_ORDERKEY", "STATUS", "TOTAL", "YEAR")
    text = at("o_orderdate >= TIMESTAMP_NTZ '1999-01-01'").select("o_orderkey", "status", F.col("total").cast("string").alias("n.5"), "year")
    frames = [readers.harmonise(f, {"n.5": "total"}, ["total"], ["total"]) for f in (plain, upper, text)]
    out = readers.stack(frames).groupBy("year", "status").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("total").alias("total")
    )
    return rounded(out, 2)


@query(
    """SELECT c_custkey, n_name, r_name FROM customer
      LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""
)
def dimension_lookup(t: Tables):
    """Names looked up in dimension tables."""
    named = readers.with_dimension(t.customer, t.nation, {"c_nationkey": "n_nationkey"}, ["n_name", "n_regionkey"])
    return readers.with_dimension(named, t.region, {"n_regionkey": "r_regionkey"}, ["r_name"]).select("c_custkey", "n_name", "r_name")


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def csv_round_trip(t: Tables):
    """Orders written as delimited files and scanned again under a schema."""
    folder = scratch_folder(t.spark)
    sinks.write_csv(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"), folder)
    back = readers.read_csv(t.spark, folder, "o_orderkey long, status string, priority string, total double")
    return rounded(back.groupBy("status", "priority").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("total").alias("total")), 2)


_BY_YEAR = """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, c_mktsegment AS segment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""


def _by_year(t: Tables):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(order_year().alias("year"), F.col("c_mktsegment").alias("segment"))
    return joined.agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total"))


@query(_BY_YEAR)
def yearly_files(t: Tables):
    """One file per year with drifting headers, written and read back as one frame."""
    folder = scratch_folder(t.spark)
    sinks.write_panel(_by_year(t), f"{folder}/panel")
    panel = t.spark.read.parquet(f"{folder}/panel")
    years = [r["year"] for r in panel.select("year").distinct().collect()]
    for y in years:
        one = panel.filter(F.col("year") == y).select("segment", "n_orders", "total").coalesce(1)
        one = one.toDF("SEGMENT", "N_ORDERS", "TOTAL") if y % 3 == 0 else one.withColumnRenamed("total", "n.5") if y % 3 == 1 else one
        sinks.write_csv(one, f"{folder}/{y}")
    files = {y: f"{folder}/{y}/*.csv" for y in years}
    out = readers.read_yearly(t.spark, files, {"n.5": "total"}, ["n_orders", "total"])
    return rounded(out.select("year", "segment", F.col("n_orders").cast("long").alias("n_orders"), "total"), 2)


@query("SELECT o_orderstatus AS status, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def files_by_pattern(t: Tables):
    """Files of two layouts found by a name pattern: one job for all headers, one scan per layout."""
    folder = scratch_folder(t.spark)
    rows = t.orders.select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), "o_orderkey")
    sinks.write_csv(rows.filter("o_orderkey % 2 = 0"), folder)
    sinks.write_csv(rows.filter("o_orderkey % 2 <> 0").select("o_orderkey", "total", "status"), folder, mode="append")
    back = readers.read_matching(t.spark, folder, "part-*.csv")
    out = back.groupBy("status").agg(F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("total").cast("double")).alias("total"))
    return rounded(out, 2)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def after_preamble(t: Tables):
    """A table behind lines of text, with a footnote at its end."""
    folder = scratch_folder(t.spark)
    text = F.concat_ws(",", "n_nationkey", F.concat(F.lit('"'), "n_name", F.lit('"')), "n_regionkey").alias("value")
    lines = t.nation.select((F.col("n_nationkey") + 10).alias("at"), text)
    extra = t.spark.createDataFrame([(0, "Table of nations"), (1, "Names, as published"), (2, "n_nationkey,n_name,n_regionkey"), (10**6, "Note: none")], "at long, value string")
    lines.unionByName(extra).coalesce(1).sortWithinPartitions("at").select("value").write.text(folder)
    back = readers.read_after_preamble(t.spark, folder, 2, F.col("n_regionkey").try_cast("int").isNotNull())
    return back.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))
