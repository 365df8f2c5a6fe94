"""Table operators on small hand-made frames."""

import math

import numpy as np
import pandas as pd

import pytest
from pyspark.sql import functions as F

from panelweave.functions import codes, missing
from panelweave.operators import aggregate, joins, metrics, reshape
from panelweave.operators.panel import CALENDAR, Panel
from panelweave.sources import readers


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_text_numbers_and_zero_sums(spark):
    df = spark.createDataFrame([("a", "(D)"), ("a", "x"), ("b", "2.5"), ("b", None)], "g string, x string")
    df = missing.cast_columns(df, ["x"])
    out = df.groupBy("g").agg(missing.sum0("x").alias("s"), F.avg("x").alias("m"), F.median("x").alias("d"))
    assert rows(out, "g") == [("a", 0.0, None, None), ("b", 2.5, 2.5, 2.5)]


def test_ratio_with_zero_denominator(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, 2.0), (1.0, None)], "n double, d double")
    got = [r[0] for r in df.select(missing.ratio_inf("n", "d")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] is None and got[4] == 0.5 and got[5] is None
    kept = missing.drop_infinite(df.select(missing.ratio_inf("n", "d").alias("r")))
    assert kept.count() == 4
    assert missing.complete_cases(kept).count() == 1
    assert [r[0] for r in df.select(missing.ratio("n", "d")).collect()] == [None, None, None, None, 0.5, None]


def test_log_guard(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (math.e,), (None,)], "x double")
    got = [r[0] for r in df.select(missing.log("x")).collect()]
    assert got[:2] == [None, None] and abs(got[2] - 1) < 1e-12 and got[3] is None


def test_suppression_and_row_sum(spark):
    df = spark.createDataFrame([("a", 2.0, 3.0), ("b", None, 5.0), ("c", None, 1.0)], "k string, n1 double, n2 double")
    out = missing.suppress_small(df, ["n1", "n2"]).withColumn("t", missing.row_sum(["n1", "n2"]))
    assert rows(out, "k") == [("a", 0.0, 3.0, 3.0), ("b", None, 5.0, 5.0), ("c", None, 0.0, 0.0)]


def test_codes(spark):
    df = spark.createDataFrame([("31----", "LAUCN010010000000003", 1, 3), ("445///", "LAUCN480050000000006", 48, 5)], "naics string, id string, s int, c int")
    parts = codes.fixed_width("id", codes.SERIES_LAYOUT)
    out = df.select(
        codes.strip_padding("naics").alias("n"), codes.sector_of("naics").alias("sec"), parts["measure"].alias("m"), parts["geo"].alias("g"), codes.county_fips("s", "c").alias("f")
    )
    assert rows(out, "n") == [(31, "31-33", "03", "01001", "01003"), (445, "44-45", "06", "48005", "48005")]
    lev = spark.createDataFrame([("11",), ("31-33",), ("311",), ("3111",)], "c string")
    assert {r[0] for r in lev.filter(codes.is_sector_code("c")).collect()} == {"11", "31-33"}


def test_recode_default(spark):
    df = spark.createDataFrame([("42",), ("44-45",), ("51",), (None,)], "s string")
    got = [r[0] for r in df.select(codes.recode("s", codes.SUPER_SECTOR)).collect()]
    assert got == ["42-45", "42-45", "51", None]
    got = [r[0] for r in df.select(codes.recode("s", {"42": 1}, F.lit(0))).collect()]
    assert got == [1, 0, 0, 0]


def test_years_to_long_keeps_nulls_and_round_trips(spark):
    wide = spark.createDataFrame([("01001", "11", "1", "(D)", "3"), ("01003", "11", "4", "5", None)], "geo string, ind string, `2001` string, `2002` string, `2003` string")
    long = reshape.years_to_long(wide, ["geo", "ind"], "v")
    assert rows(long, "geo", "year") == [
        ("01001", "11", 2001, 1.0), ("01001", "11", 2002, None), ("01001", "11", 2003, 3.0),
        ("01003", "11", 2001, 4.0), ("01003", "11", 2002, 5.0), ("01003", "11", 2003, None),
    ]
    back = long.groupBy("geo", "ind").pivot("year", [2001, 2002, 2003]).agg(F.first("v"))
    assert rows(back, "geo") == [("01001", "11", 1.0, None, 3.0), ("01003", "11", 4.0, 5.0, None)]


def test_select_where(spark):
    df = spark.createDataFrame([(1, 2, 3)], "GeoFIPS int, n1 int, est int")
    assert reshape.select_where(df, reshape.starts_with("Geo"), reshape.ends_with("st")).columns == ["GeoFIPS", "est"]
    assert reshape.select_where(df, reshape.contains("n1"), negate=True).columns == ["GeoFIPS", "est"]


def test_row_to_long(spark):
    df = spark.createDataFrame([(206, 1.0, 2.0), (1, 9.0, 9.0)], "SECTORNUMBER int, X1 double, X2 double")
    out = reshape.row_to_long(df, F.col("SECTORNUMBER") == 206, "sector", "va")
    assert rows(out, "sector") == [(1, 1.0), (2, 2.0)]


def test_suffix_join_and_pairwise_ratio(spark):
    a = spark.createDataFrame([(1, 2.0, 4.0)], "k int, `2001` double, `2002` double")
    b = spark.createDataFrame([(1, 3.0, 0.0)], "k int, `2001` double, `2002` double")
    both = joins.join_suffixed(a, b, ["k"], ("_hist", "_current"))
    assert set(both.columns) == {"k", "2001_hist", "2002_hist", "2001_current", "2002_current"}
    assert rows(reshape.pairwise_ratio(both, ["k"], ["2001", "2002"], "_current", "_hist")) == [(1, 1.5, 0.0)]


def test_two_stage_is_mean_of_means(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0)], "sub string, x double")
    out = aggregate.two_stage_roll_up(df, ["sub"], {"sub": F.lit("all")}, means=["x"])
    assert rows(out) == [("all", 6.0)]


def test_weighted_mean_missing_rules(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 3.0), ("b", None, 1.0), ("c", 5.0, None), ("d", 2.0, 0.0)], "g string, v double, w double")
    assert rows(aggregate.weighted_mean(df, ["g"], "v", "w", "m"), "g") == [("a", 2.5), ("b", 0.0), ("c", 0.0), ("d", 0.0)]


def test_attach_group_matches_window_and_keeps_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0), (None, None)], "g string, x double")
    one = aggregate.attach_group(df, ["g"], {"t": F.sum("x")})
    two = aggregate.attach_group_window(df, ["g"], {"t": F.sum("x")})
    assert rows(one, "g", "x") == rows(two, "g", "x")
    three = aggregate.attach_group(df, ["g"], {"t": F.sum("x")}, few=True)
    assert rows(three, "g", "x") == rows(two, "g", "x")
    wide = joins.small_side(spark.range(10), max_rows=3)
    assert "broadcast" not in wide._jdf.queryExecution().analyzed().toString().lower() and wide.count() == 10
    shares = aggregate.share_of_total(df.dropna(), ["g"], {"s": "x"})
    assert abs(shares.agg(F.sum("s")).first()[0] - 1) < 1e-12


@pytest.mark.parametrize("accuracy", [50, 10000])
def test_quantiles_exact_with_hot_group(spark, accuracy):
    # One group holds most rows; the coarse sketch makes the brackets do real work.
    df = spark.range(20000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        ((F.col("id") * 7919) % 10007 / 3.0).alias("x"),
        F.when(F.col("id") % 3 == 0, (F.col("id") * 31) % 97).cast("double").alias("y"),
    )
    got = rows(aggregate.quantiles(df, ["g"], ["x", "y"], [0.25, 0.5, 0.9], accuracy), "g")
    want = rows(df.groupBy("g").agg(*[F.percentile(c, [0.25, 0.5, 0.9]) for c in ("x", "y")]), "g")
    for a, b in zip(got, want, strict=True):
        assert a[0] == b[0]
        for i in (1, 2):
            assert all(abs(p - q) < 1e-9 for p, q in zip(a[i], b[i], strict=True))


def test_median_of_empty_group_is_null(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", 2.0), ("b", float("nan"))], "g string, x double")
    assert rows(aggregate.median(df, ["g"], ["x"]), "g") == [("a", None), ("b", 1.5)]


GAP = [(1, 2001, 1.0), (1, 2002, 3.0), (1, 2004, 8.0), (2, 2002, 5.0)]


def test_lags_across_a_gap(spark):
    p = Panel(spark.createDataFrame(GAP, "id int, year int, v double"), "id")
    out = p.df.select("id", "year", p.row_lag("v").alias("r"), p.calendar_lag("v").alias("c"), p.calendar_lag("v", 2).alias("c2"), p.diff("v", CALENDAR).alias("d"))
    assert rows(out, "id", "year") == [
        (1, 2001, None, None, None, None), (1, 2002, 1.0, 1.0, None, 2.0), (1, 2004, 3.0, None, 3.0, None), (2, 2002, None, None, None, None)
    ]
    with pytest.raises(ValueError):
        p.lag("v", 1, "other")


def test_growth_and_ratio_changes(spark):
    p = Panel(spark.createDataFrame([(1, 1, 2.0, 4.0), (1, 2, 3.0, 0.0), (1, 3, 0.0, 5.0)], "id int, t int, a double, b double"), "id", "t")
    out = p.df.select("t", p.growth("b").alias("g"), p.ratio_diff("a", "b").alias("r"), p.log_diff("a").alias("l"))
    got = rows(out, "t")
    assert got[1][1] == -1.0 and got[2][1] is None and got[1][2] is None and got[2][3] is None
    assert abs(got[1][3] - math.log(1.5)) < 1e-12


def test_long_difference(spark):
    p = Panel(spark.createDataFrame(GAP + [(2, 2004, 6.0)], "id int, year int, v double"), "id")
    out = p.long_difference(2001, 2004, levels={"d": "v"}, growths={"g": "v"})
    assert rows(out, "id") == [(1, 7.0, 7.0), (2, None, None)]


def test_panel_key(spark):
    df = spark.createDataFrame(GAP, "id int, year int, v double")
    assert Panel(df, "id").check()
    with pytest.raises(ValueError):
        Panel(df.union(df.limit(1)), "id").check()
    dims = Panel(df, "id").dimensions().first().asDict()
    assert dims == {"n_entities": 2, "n_obs": 4, "t_min": 1, "t_max": 3, "n_periods": 3, "balanced": False}


def test_demeaned_sums_to_zero(spark):
    out = Panel(spark.createDataFrame(GAP, "id int, year int, v double"), "id").demean(["v"])
    assert all(abs(r[1]) < 1e-12 for r in rows(out.groupBy("id").agg(F.sum("v_w"))))


def test_herfindahl_uses_upper_bounds(spark):
    df = spark.createDataFrame([(2, 1, 10.0), (1, 0, 0.0)], "n1_4 int, n5_9 int, EMPL double")
    got = [r[0] for r in df.select(metrics.herfindahl_binned("EMPL", {"n1_4": 4, "n5_9": 9})).collect()]
    assert abs(got[0] - (2 * 0.16 + 0.81)) < 1e-12 and got[1] is None


def test_linear_trend_excludes_points_outside_limits(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(5)] + [(100.0, 0.0), (2.0, None)], "x double, y double")
    r = metrics.linear_trend(df, "x", "y", x_limits=(0, 10)).first()
    assert abs(r["slope"] - 2) < 1e-12 and abs(r["intercept"] - 1) < 1e-12 and r["n"] == 5 and r["sigma"] < 1e-6


def test_class_split_and_fan_out(spark):
    df = spark.createDataFrame([(1, "prog", 2.0), (1, "prog", 3.0), (2, "stag", 4.0)], "z int, k string, e double")
    assert rows(reshape.split_by_class(df, ["z"], "k", ["prog", "stag"], ["e"]), "z") == [(1, 5.0, 0.0), (2, 0.0, 4.0)]
    geo = spark.createDataFrame([(1, "p"), (1, "q")], "z int, poly string")
    assert joins.fan_out(geo, df, ["z"], ["e"]).count() == 2


def test_yearly_files_of_one_name(spark, tmp_path):
    for year, value in ((2002, 1), (2003, 2)):
        (tmp_path / f"{year} x").mkdir()
        (tmp_path / f"{year} x" / "co.txt").write_text(f'FIPS,"Name, long",V\n0{year},a,{value}\n')
    files = {y: str(tmp_path / f"{y} x" / "co.txt") for y in (2002, 2003)}
    got = readers.read_yearly(spark, files, numeric=["v"])
    assert sorted((r["year"], r["v"], r["name, long"]) for r in got.collect()) == [(2002, 1.0, "a"), (2003, 2.0, "a")]
    with pytest.raises(ValueError):
        readers.read_yearly(spark, {2002: files[2002], 2003: files[2002]})


def test_matching_files_by_their_own_headers(spark, tmp_path):
    (tmp_path / "m1.csv").write_text("X7,X8\n1,2\n")
    (tmp_path / "m2.csv").write_text("X8,X7,X9\n2,1,3\n")
    (tmp_path / "other.csv").write_text("X7\n9\n")
    got = readers.read_matching(spark, str(tmp_path), "m*.csv")
    rows = {r["source_file"]: (r["X7"], r["X8"], r["X9"]) for r in got.collect()}
    assert rows == {"m1.csv": ("1", "2", None), "m2.csv": ("1", "2", "3")}
    with pytest.raises(FileNotFoundError):
        readers.read_matching(spark, str(tmp_path), "none*.csv")


def test_infinite_changes_leave_the_table(spark):
    rows = [(z, "s", y, e) for z, y, e in [(1, 2000, 0.0), (1, 2001, 5.0), (2, 2000, 4.0), (2, 2001, 5.0), (3, 2001, 1.0)]]
    p = Panel(spark.createDataFrame(rows, "z int, s string, year int, est double"), ["z", "s"], "year")
    out = missing.drop_infinite(p.long_difference(2000, 2001, growths={"g": "est"}, logs={"l": "est"}, infinite=True))
    assert {r["z"]: r["g"] for r in out.collect()} == {2: 0.25, 3: None}


def test_quantile_bracket_that_misses_is_widened(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    frame = spark.createDataFrame(pd.DataFrame({"g": np.arange(4000) % 2, "x": x}))
    # So coarse a sketch that its first brackets may miss.
    got = {r["g"]: r["x"] for r in aggregate.quantiles(frame, ["g"], ["x"], [0.1, 0.5], accuracy=3).collect()}
    for g in (0, 1):
        assert np.allclose(got[g], np.quantile(x[g::2], [0.1, 0.5]))


def test_trend_band(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=30)
    y = 1 + 2 * x + rng.normal(size=30)
    line = metrics.linear_trend(spark.createDataFrame(pd.DataFrame({"g": 1, "x": x, "y": y})), "x", "y", ["g"])
    got = metrics.trend_band(line, (-1.0, 1.0), 3).orderBy("x").toPandas()
    slope, start = np.polyfit(x, y, 1)
    sigma = np.sqrt(((y - start - slope * x) ** 2).sum() / 28)
    at = np.array([-1.0, 0.0, 1.0])
    half = 2.048407 * sigma * np.sqrt(1 / 30 + (at - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())
    assert np.allclose(got.fit, start + slope * at) and np.allclose(got.upper - got.fit, half, atol=1e-5) and np.allclose(got.fit - got.lower, half, atol=1e-5)


def test_headers_of_many_files_take_as_many_jobs_as_those_of_few(spark, tmp_path):
    def write(folder, n):
        folder.mkdir()
        for i in range(n):
            names, row = ("a,b", f"{i},x") if i % 2 else ("B, A", f"y,{i}")
            (folder / f"f {i}.csv").write_text(f"{names}\n{row}\n" * 1)
        (folder / "empty.csv").write_text("")

    jobs = []
    for n in (100, 600):
        write(tmp_path / str(n), n)
        spark.sparkContext.setJobGroup(f"files{n}", "headers")
        got = readers.read_matching(spark, str(tmp_path / str(n)), "*.csv")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"files{n}")))
        assert {c.lower() for c in got.columns} == {"a", "b", "source_file"}
        assert got.count() == n
        found = readers.headers(spark, [f"{tmp_path}/{n}/f {i}.csv" for i in range(4)] + [f"{tmp_path}/{n}/empty.csv"])
        assert [v for _, v in sorted(found.items())] == [["B", "A"], ["a", "b"], ["B", "A"], ["a", "b"]]
    spark.sparkContext.setJobGroup("", "")
    # Listings included, which Spark runs as jobs from some paths on.
    assert jobs[0] == jobs[1] <= 8
