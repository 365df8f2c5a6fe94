"""Projection, predicates, reshaping, scalar functions."""

from pyspark.sql import functions as F

from ..functions import codes, missing
from ..operators import joins, reshape
from ..operators.panel import Panel
from ..plans.regional_panel import SECTOR, YEAR, ZONE
from ..plans.trade_panel import MEMBER, QUANTITY_CLASSES, SUPER_SEGMENT, Tables, lines, members, order_year
from ..session import materialise
from .registry import LINES, query, rounded



def year_columns(dates, column: str) -> list[str]:
    """Every year from the first to the last date of a table, as column names (reads two values)."""
    low, high = dates.agg(F.year(F.min(column)), F.year(F.max(column))).first()
    return [] if low is None else [str(y) for y in range(low, high + 1)]


@query("SELECT l_orderkey AS order_id, l_partkey, l_suppkey, l_discount, l_returnflag FROM lineitem")
def select_by_name(t: Tables):
    """Columns by suffix, prefix and substring, then a rename."""
    out = reshape.select_where(
        t.lineitem, reshape.ends_with("key"), reshape.starts_with("l_disc"), reshape.contains("returnf")
    )
    return reshape.rename(out, {"l_orderkey": "order_id"})


@query(
    """SELECT p_partkey, substr(p_brand, 7) AS code FROM part
      WHERE (length(substr(p_brand, 7)) = 2 OR substr(substr(p_brand, 7), 3, 1) = '-') AND p_partkey BETWEEN 100 AND 999"""
)
def code_level_filter(t: Tables):
    """Sector-level rows of a code hierarchy, and numeric codes of a given depth."""
    coded = t.part.withColumn("code", F.substring("p_brand", 7, 10))
    return coded.filter(codes.is_sector_code("code") & codes.code_depth("p_partkey", 3)).select("p_partkey", "code")


@query(
    """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
      WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')
        AND o_totalprice >= 1000 AND o_totalprice <= 300000 AND o_custkey <> 0 AND o_orderdate IS NOT NULL"""
)
def membership_filters(t: Tables):
    """Equality, membership, negated membership, range and null predicates (all pushed to the scan)."""
    o = t.orders
    return o.filter(
        codes.values_in("o_orderstatus", ["F", "O"])
        & ~codes.values_in("o_orderpriority", ["1-URGENT", "5-LOW"])
        & F.col("o_totalprice").between(1000, 300000)
        & (F.col("o_custkey") != 0)
        & F.col("o_orderdate").isNotNull()
    ).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(
    """SELECT l_returnflag, count(*) AS n_kept, count(*) FILTER (l_tax = 0 AND l_discount = 0) AS n_nan,
        round(sum(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END), 4) AS total
      FROM lineitem WHERE NOT (l_discount = 0 AND l_tax <> 0) GROUP BY 1"""
)
def drop_infinite(t: Tables):
    """Rows whose ratio is infinite are dropped, undefined ones stay."""
    kept = missing.drop_infinite(t.lineitem.select("l_returnflag", missing.ratio_inf("l_tax", "l_discount").alias("r")))
    out = kept.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_kept"),
        F.count(F.when(F.isnan("r"), 1)).alias("n_nan"),
        F.sum(F.when(~F.isnan("r"), F.col("r"))).alias("total"),
    )
    return rounded(out, 4)


@query(
    """SELECT l_linestatus, count(*) AS n_rows, round(sum(l_tax / l_discount), 4) AS total
      FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0 GROUP BY 1"""
)
def complete_cases(t: Tables):
    """Rows without NULL or undefined values in any column."""
    li = t.lineitem.select("l_linestatus", F.nullif("l_tax", F.lit(0.0)).alias("tax"), missing.ratio("l_tax", "l_discount").alias("r"))
    out = missing.complete_cases(li).groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("r").alias("total"))
    return rounded(out, 4)


@query(
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
        round(l_extendedprice / nullif(l_quantity, 0), 9) AS unit_price FROM lineitem"""
)
def computed_columns(t: Tables):
    """Derived columns in the scan stage."""
    out = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        missing.ratio("l_extendedprice", "l_quantity").alias("unit_price"),
    )
    return rounded(out, 9, net=4)


@query(
    """SELECT CASE WHEN c_mktsegment IN ('AUTOMOBILE','MACHINERY') THEN 'AUTO-MACH'
        WHEN c_mktsegment IN ('BUILDING','FURNITURE') THEN 'BUILD-FURN' ELSE c_mktsegment END AS sector,
        count(*) AS n FROM customer GROUP BY 1"""
)
def recode_groups(t: Tables):
    """Labels replaced by coarser groups."""
    return t.customer.groupBy(codes.recode("c_mktsegment", SUPER_SEGMENT).alias("sector")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 3 THEN 0 ELSE l_quantity END AS q,
        CASE WHEN nullif(l_tax, 0) < 0.03 THEN 0 ELSE nullif(l_tax, 0) END AS tax FROM lineitem"""
)
def suppress_small(t: Tables):
    """Cells under a threshold become zero, NULL stays."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.nullif("l_tax", F.lit(0.0)).alias("tax"))
    return missing.suppress_small(missing.suppress_small(li, ["q"], 3), ["tax"], 0.03)


@query(
    """SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority,
        coalesce(try_cast(o_orderstatus AS DOUBLE), 0) AS status FROM orders"""
)
def fill_zero_cast(t: Tables):
    """Text columns to numbers; non-numbers become NULL, then zero."""
    o = t.orders.select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("priority"), F.col("o_orderstatus").alias("status"))
    return missing.fill_zero(missing.cast_columns(o, ["priority", "status"]), ["priority", "status"])


@query(
    """SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, 0) + coalesce(nullif(l_tax, 0), 0)
        + coalesce(nullif(l_discount, 0), 0), 4) AS total FROM lineitem"""
)
def row_sum_skipna(t: Tables):
    """Sum across columns of a row, skipping NULL."""
    li = t.lineitem.withColumns({"tx": F.nullif("l_tax", F.lit(0.0)), "dc": F.nullif("l_discount", F.lit(0.0))})
    return rounded(li.select("l_orderkey", "l_linenumber", missing.row_sum(["l_quantity", "tx", "dc"]).alias("total")), 4)


def _wide(t: Tables):
    """Customer rows with one column per order year; NULL for years in which a customer ordered nothing."""
    o = t.orders.select(F.col("o_custkey").alias(MEMBER), order_year().alias(YEAR), "o_totalprice")
    years = year_columns(t.orders, "o_orderdate")
    return o.groupBy(MEMBER).agg(*[F.sum(F.when(F.col(YEAR) == int(y), F.col("o_totalprice"))).alias(y) for y in years])


_WIDE_SQL = """cells AS (SELECT o_custkey AS cust, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
grid AS (SELECT DISTINCT cust, r.y FROM cells
  CROSS JOIN range((SELECT min(y) FROM cells), (SELECT max(y) + 1 FROM cells)) r(y))"""


@query(
    f"""WITH {_WIDE_SQL} SELECT cust, CAST(y AS INTEGER) AS year, round(v, 2) AS total
      FROM grid LEFT JOIN cells USING (cust, y)"""
)
def unpivot_years(t: Tables):
    """Year columns to rows; empty cells stay as NULL rows."""
    return rounded(reshape.years_to_long(_wide(t), [MEMBER], "total"), 2)


@query(
    """SELECT CAST(month(l_shipdate) AS INTEGER) AS sector_no, round(sum(l_extendedprice), 2) AS value_added
      FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1"""
)
def transpose_row(t: Tables):
    """One row of a wide table turned into (code, value) rows, as read from a use table."""
    month = F.month("l_shipdate")
    wide = t.lineitem.groupBy("l_returnflag").agg(
        *[F.sum(F.when(month == m, F.col("l_extendedprice"))).alias(f"X{m}") for m in range(1, 13)]
    )
    return rounded(reshape.row_to_long(wide, F.col("l_returnflag") == "A", "sector_no", "value_added"), 2)


def _stocks(t: Tables):
    """Part type x year at list and at current prices, as two wide tables with equal column names."""
    sold = t.lineitem.select("l_partkey", "l_quantity", "l_extendedprice", F.year("l_shipdate").alias(YEAR))
    priced = sold.join(t.part.select("p_partkey", "p_type", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    long = priced.groupBy("p_type", YEAR).agg(
        F.sum(F.col("l_quantity") * F.col("p_retailprice")).alias("hist"), F.sum("l_extendedprice").alias("curr")
    )
    long = materialise(long)  # types x years; both wide tables read it
    years = year_columns(t.lineitem, "l_shipdate")
    at = lambda c: [F.sum(F.when(F.col(YEAR) == int(y), F.col(c))).alias(y) for y in years]
    return long.groupBy("p_type").agg(*at("hist")), long.groupBy("p_type").agg(*at("curr")), years


_STOCK_SQL = """SELECT p_type, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity * p_retailprice) AS hist,
  sum(l_extendedprice) AS curr FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""


#: Every type in every year from the first to the last, as the wide tables have them.
_STOCK_GRID = f"""stocks AS ({_STOCK_SQL}),
grid AS (SELECT DISTINCT p_type, CAST(y AS INTEGER) AS year FROM stocks
  CROSS JOIN range((SELECT min(year) FROM stocks), (SELECT max(year) + 1 FROM stocks)) r(y)),
cells AS (SELECT p_type, year, curr / nullif(hist, 0) AS price_index FROM grid LEFT JOIN stocks USING (p_type, year))"""


@query(f"WITH {_STOCK_GRID} SELECT p_type, year, round(price_index, 6) AS price_index FROM cells")
def pairwise_ratio(t: Tables):
    """Year columns of one table over the same-named columns of another."""
    hist, curr, years = _stocks(t)
    both = joins.join_suffixed(hist, curr, ["p_type"], ("_hist", "_current"))
    ratios = reshape.pairwise_ratio(both, ["p_type"], years, "_current", "_hist")
    return rounded(reshape.years_to_long(ratios, ["p_type"], "price_index"))


_SPLIT_SQL = f"""WITH {LINES} SELECT c_nationkey AS CZ_ID, year,
  round(coalesce(sum(l_extendedprice) FILTER (c_mktsegment IN ('AUTOMOBILE','MACHINERY')), 0), 2) AS GDP_prog,
  round(coalesce(sum(l_extendedprice) FILTER (c_mktsegment NOT IN ('AUTOMOBILE','MACHINERY')), 0), 2) AS GDP_stag,
  round(coalesce(sum(l_quantity) FILTER (c_mktsegment IN ('AUTOMOBILE','MACHINERY')), 0), 2) AS EMPL_prog,
  round(coalesce(sum(l_quantity) FILTER (c_mktsegment NOT IN ('AUTOMOBILE','MACHINERY')), 0), 2) AS EMPL_stag
  FROM lines JOIN customer ON cust = c_custkey GROUP BY 1, 2"""


@query(_SPLIT_SQL)
def class_pivot(t: Tables):
    """Zone x year sums split into columns by class."""
    base = lines(t).groupBy(MEMBER, YEAR).agg(F.sum("l_extendedprice").alias("GDP"), F.sum("l_quantity").alias("EMPL"))
    classed = base.join(members(t), MEMBER).withColumn(
        "class", F.when(F.col(SECTOR).isin("AUTOMOBILE", "MACHINERY"), "prog").otherwise("stag")
    )
    return rounded(reshape.split_by_class(classed, [ZONE, YEAR], "class", ["prog", "stag"], ["GDP", "EMPL"]), 2)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def panel_key_check(t: Tables):
    """Duplicated panel keys."""
    return Panel(t.lineitem.select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber").duplicates()


@query(
    """SELECT c_custkey, substr(c_name, 1, 8) AS prefix, substr(c_name, 10, 5) AS geo, substr(c_name, 18, 1) AS last_digit,
        CAST(length(c_name) AS INTEGER) AS width, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS fips,
        lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS state, CAST(regexp_replace(substr(c_name, 9), '[-/#]', '') AS INTEGER) AS code,
        regexp_replace(c_name, '^Customer', '') AS bare FROM customer"""
)
def string_codes(t: Tables):
    """Fixed-width decoding, zero-padded assembly, stripping of padding and prefixes."""
    c = t.customer
    parts = codes.fixed_width("c_name", {"prefix": (1, 8), "geo": (10, 14), "last_digit": (18, 18)})
    fips = codes.county_fips("c_nationkey", F.col("c_custkey") % 1000)
    return c.select(
        "c_custkey",
        *[v.alias(k) for k, v in parts.items()],
        F.length("c_name").alias("width"),
        fips.alias("fips"),
        codes.state_of(fips).alias("state"),
        codes.strip_padding(codes.strip_prefix(F.substring("c_name", 9, 20), "#")).alias("code"),
        codes.strip_prefix("c_name", "Customer").alias("bare"),
    )


@query(
    """SELECT c_custkey, round(abs(c_acctbal), 2) AS size, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS log_bal,
        round(power(c_acctbal / 1000, 2), 10) AS sq, round(c_acctbal / nullif(c_nationkey, 0), 9) AS per_nation,
        try_cast(c_mktsegment AS DOUBLE) IS NULL AS text_only FROM customer"""
)
def numeric_funcs(t: Tables):
    """abs, guarded log, power, guarded division, casts that give NULL."""
    bal = F.col("c_acctbal")
    return t.customer.select(
        "c_custkey",
        F.round(F.abs(bal), 2).alias("size"),
        F.round(missing.log(bal), 6).alias("log_bal"),
        F.round(F.pow(bal / 1000, F.lit(2.0)), 10).alias("sq"),
        F.round(missing.ratio("c_acctbal", "c_nationkey"), 9).alias("per_nation"),
        missing.to_number("c_mktsegment").isNull().alias("text_only"),
    )
