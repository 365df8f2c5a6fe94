"""Aggregates."""

from pyspark.sql import functions as F

from ..functions import codes, missing
from ..operators import aggregate
from ..operators.panel import Panel
from ..plans.trade_panel import MEMBER, SUPER_SEGMENT, Tables, lines, order_year
from .registry import LINES, MEMBERS, query, rounded


@query(
    """SELECT l_suppkey, sum(l_quantity) AS q, round(coalesce(sum(CASE WHEN l_tax > 0.07 THEN l_extendedprice END), 0), 2) AS high,
        coalesce(sum(try_cast(l_returnflag AS DOUBLE)), 0) AS none FROM lineitem GROUP BY 1"""
)
def sum_list(t: Tables):
    """Sums that are zero, not NULL, for groups without values."""
    li = t.lineitem.select(
        "l_suppkey",
        F.col("l_quantity").alias("q"),
        F.when(F.col("l_tax") > 0.07, F.col("l_extendedprice")).alias("high"),
        missing.to_number("l_returnflag").alias("none"),
    )
    return rounded(aggregate.sum_list(li, ["l_suppkey"], ["q", "high", "none"]), 2)


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS l_extendedprice, sum(l_quantity) AS l_quantity,
        round(avg(l_discount), 9) AS l_discount, round(avg(l_tax), 9) AS l_tax FROM lineitem GROUP BY 1, 2"""
)
def mixed_rollup(t: Tables):
    """Sums of some measures and means of others in one pass."""
    out = aggregate.roll_up(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_quantity"], ["l_discount", "l_tax"])
    return rounded(out, 9, l_extendedprice=2)


@query(
    """WITH a AS (SELECT c_nationkey, c_mktsegment, sum(c_acctbal) AS total, avg(c_acctbal) AS mean FROM customer GROUP BY 1, 2)
      SELECT c_nationkey, CASE WHEN c_mktsegment IN ('AUTOMOBILE','MACHINERY') THEN 'AUTO-MACH'
        WHEN c_mktsegment IN ('BUILDING','FURNITURE') THEN 'BUILD-FURN' ELSE c_mktsegment END AS c_mktsegment,
        round(sum(total), 2) AS total, round(avg(mean), 8) AS mean FROM a GROUP BY 1, 2"""
)
def two_stage_rollup(t: Tables):
    """Second stage averages first-stage means."""
    c = t.customer.select("c_nationkey", "c_mktsegment", F.col("c_acctbal").alias("total"), F.col("c_acctbal").alias("mean"))
    recoded = {"c_mktsegment": codes.recode("c_mktsegment", SUPER_SEGMENT)}
    return rounded(aggregate.two_stage_roll_up(c, ["c_nationkey", "c_mktsegment"], recoded, ["total"], ["mean"]), 8, total=2)


@query(
    """SELECT p_type, round(avg(p_size), 6) AS p_size, round(avg(p_retailprice), 6) AS p_retailprice FROM part GROUP BY 1"""
)
def mean_all(t: Tables):
    """Mean of every non-key column."""
    return rounded(aggregate.mean_rest(t.part.select("p_type", "p_size", "p_retailprice"), ["p_type"]))


@query(
    """SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 6) AS price, round(median(l_quantity), 6) AS qty,
        round(median(nullif(l_tax, 0)), 6) AS tax FROM lineitem GROUP BY 1, 2"""
)
def group_median(t: Tables):
    """Exact medians of very large groups, found without gathering a group."""
    li = t.lineitem.select(
        "l_returnflag",
        "l_linestatus",
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("qty"),
        F.nullif("l_tax", F.lit(0.0)).alias("tax"),
    )
    return rounded(aggregate.median(li, ["l_returnflag", "l_linestatus"], ["price", "qty", "tax"]))


@query(
    """SELECT l_suppkey, round(sum(l_quantity * l_discount) / nullif(sum(l_quantity), 0), 9) AS exposure FROM lineitem GROUP BY 1"""
)
def weighted_mean(t: Tables):
    """Quantity-weighted discount."""
    return rounded(aggregate.weighted_mean(t.lineitem, ["l_suppkey"], "l_discount", "l_quantity", "exposure"), 9)


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_keys(t: Tables):
    return aggregate.distinct_keys(t.customer, "c_nationkey", "c_mktsegment")


@query(
    f"""WITH {LINES}, k AS (SELECT DISTINCT cust, year FROM lines), e AS (SELECT cust, count(*) AS t FROM k GROUP BY 1)
      SELECT count(*) AS n_entities, CAST(sum(t) AS BIGINT) AS n_obs, min(t) AS t_min, max(t) AS t_max,
        (SELECT count(DISTINCT year) FROM k) AS n_periods,
        min(t) = max(t) AND max(t) = (SELECT count(DISTINCT year) FROM k) AS balanced FROM e"""
)
def panel_dims(t: Tables):
    """Entities, periods, observations and balance of the customer panel."""
    keys = lines(t).select(MEMBER, "year").distinct()
    return Panel(keys, MEMBER).dimensions()
