"""Panels of the same shape as the regional ones, derived from order and line-item tables.

Customers stand for counties, nations for zones, market segments for sectors and order years for
periods. Line values give output, compensation and income, quantities give employment, distinct
suppliers give establishments, and line counts by quantity class give the size classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import codes
from ..operators import aggregate, metrics
from ..session import materialise
from .regional_panel import SECTOR, YEAR, ZONE, zone_metrics, zone_panel

# Quantity classes (closed intervals), and their upper bounds for concentration.
QUANTITY_CLASSES = {"n1_4": (1, 4), "n5_9": (5, 9), "n10_19": (10, 19), "n20_49": (20, 49), "n50": (50, 50)}
CLASS_UPPER = {c: b for c, (_, b) in QUANTITY_CLASSES.items()}
SUPER_SEGMENT = {"AUTOMOBILE": "AUTO-MACH", "MACHINERY": "AUTO-MACH", "BUILDING": "BUILD-FURN", "FURNITURE": "BUILD-FURN"}
MEMBER = "cust"


class Tables:
    """Lazy access to the tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def order_year() -> Column:
    return F.year("o_orderdate").cast("int")


def value_measures() -> list[Column]:
    """Aggregates over line items that play the part of the regional accounts."""
    price, net = F.col("l_extendedprice"), 1 - F.col("l_discount")
    return [
        F.sum(price).alias("GDP"),
        F.sum(price * net).alias("COMP"),
        F.sum(price * net * (1 + F.col("l_tax"))).alias("PERSONAL_INC"),
        F.sum("l_quantity").alias("EMPL"),
        F.count_distinct("l_suppkey").alias("est"),
        F.avg("l_discount").alias("union_memb"),
        F.avg("l_tax").alias("unempl_rate"),
        (F.sum(F.when(F.col("l_returnflag") == "R", price).otherwise(0.0)) / F.sum(price)).alias("import_exposure"),
        *metrics.class_counts("l_quantity", QUANTITY_CLASSES),
    ]


def lines(t: Tables) -> DataFrame:
    """Line items with the customer and year of their order."""
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias(MEMBER), order_year().alias(YEAR))
    return t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def member_panel(t: Tables, listed: bool = False) -> DataFrame:
    """Customer x year panel. Unused measures are pruned from the aggregate by the optimizer.

    ``listed`` adds the value of the lines at list prices and, for the same lines, at current ones.
    """
    rows, extra = lines(t), []
    if listed:
        parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
        rows = rows.join(parts, "l_partkey", "left")
        known = F.col("p_retailprice").isNotNull()
        extra = [
            F.sum(F.col("l_quantity") * F.col("p_retailprice")).alias("AT_LIST"),
            F.sum(F.when(known, F.col("l_extendedprice"))).alias("AT_CURRENT"),
        ]
    base = rows.groupBy(MEMBER, YEAR).agg(*value_measures(), *extra)
    return base.withColumns(
        {
            "LABOR_SHARE": metrics.labor_share(),
            "PAYROLL_SHARE": metrics.payroll_share(),
            **metrics.per_unit({"est_per_worker": ("est", "EMPL")}),
            "HHI_labor": metrics.herfindahl_binned("EMPL", CLASS_UPPER),
        }
    )


def members(t: Tables) -> DataFrame:
    """Crosswalk of customers to zones, with their sector."""
    return t.customer.select(
        F.col("c_custkey").alias(MEMBER), F.col("c_nationkey").alias(ZONE), F.col("c_mktsegment").alias(SECTOR)
    )


SUMS = ["GDP", "COMP", "PERSONAL_INC", "EMPL", "est", *QUANTITY_CLASSES]
MEANS = ["union_memb", "unempl_rate", "import_exposure", "capital_cost_index"]


def trade_zone_panel(t: Tables, merged: bool = False, capital: bool = False) -> DataFrame:
    """Nation x segment x year panel; ``merged`` also folds segments into super-segments.

    Lines collapse to one row per customer and year before they meet the crosswalk, so a customer
    with very many lines is a handful of rows by the time of the join. ``capital`` adds the capital
    cost index of the segment: current over list prices. Its sums come from the collapsed panel, which is
    written out for that, so the lines are read and joined once.
    """
    coarse = codes.recode(SECTOR, SUPER_SEGMENT if merged else {})
    base = member_panel(t, listed=capital).drop("LABOR_SHARE", "PAYROLL_SHARE", "est_per_worker", "HHI_labor")
    walk = members(t)
    if not capital:
        return zone_panel(base, walk, {MEMBER: MEMBER}, SUMS, MEANS[:3], coarse, CLASS_UPPER)
    totals = {"__current": F.sum("AT_CURRENT"), "__list": F.sum("AT_LIST")}
    located = aggregate.attach_group(materialise(base.join(walk, MEMBER)), [SECTOR, YEAR], totals, few=True)
    located = located.withColumn("capital_cost_index", F.col("__current") / F.col("__list"))
    rolled = aggregate.two_stage_roll_up(located, [YEAR, ZONE, SECTOR], {SECTOR: coarse}, SUMS, MEANS)
    return zone_metrics(rolled, CLASS_UPPER)
