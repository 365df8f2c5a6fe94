"""Connected components of a graph given as links, kept distributed throughout."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.session import materialise


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 .. n - 1, the smallest node that each reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def connected(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node that reaches a smaller one.

    ``links`` has two columns of node ids; loops, nulls, repeated and reversed links do no harm. Each round
    links all larger neighbours of a node, then all smaller ones, to the smallest (large star, small
    star). Minima are pre-aggregated; the joins have one row per node on one side, so that adaptive execution
    can split a hub's rows on the other. Rounds end when the links no longer change: then each node is
    linked to the smallest of its component only.
    """
    a, b = links.columns
    start = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, seen = materialise(start), None
    while True:
        found = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if found == seen or not found["n"]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = found
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
