"""The whole chain from yearly files to the zone panel and an estimate, on small CSV files."""

import csv
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.models import gmm as gm, panel_models as pm
from panelweave.operators import metrics
from panelweave.operators.panel import Panel
from panelweave.plans import figures, regional_panel as rp, samples
from panelweave.sources import readers, sinks

YEARS = list(range(2002, 2020))
COUNTIES = ["01001", "01003", "02001", "02003"]
ZONES = {"01001": "1", "01003": "1", "02001": "2", "02003": "3"}
SECTORS = ["31-33", "42", "44-45"]
CLASSES = rp.CLASSES


def put(path, header, rows, before=()):
    with open(path, "w", newline="") as f:
        for line in before:
            f.write(line + "\n")
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)
    return str(path)


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    rng = np.random.default_rng(0)
    accounts = {}
    for m, base in {"COMP": 50, "PERSONAL_INC": 60, "GDP": 90, "RGDP": 85, "EMPL": 1000}.items():
        rows = [["00000", "31-33", *["9"] * 19]]
        for c in COUNTIES:
            for s in [*SECTORS, "311", "..."]:
                cells = [f"{base * (1 + rng.random()):.3f}" for _ in range(19)]
                if c == "01001" and s == "42":
                    cells[4] = "(D)"
                rows.append([c, s, *cells])
        accounts[m] = put(d / f"{m}.csv", ["GeoFIPS", "IndustryClassification", *map(str, range(2001, 2020))], rows)
    union = put(d / "union.csv", ["State Name", "%Mem64", *[f"%Mem{y - 2000:02d}" for y in YEARS]], [[n, 1, *[10 + i + k for k in range(18)]] for i, n in enumerate(["Alabama", "Alaska"])])
    states = put(d / "states.csv", ["state_name", "state_fips"], [["Alabama", "01"], ["Alaska", "02"]])
    un = [[f"LAUCN{c}00000000{m}", y, 4.0 + y % 5] for c in COUNTIES for y in YEARS for m in ("03", "06")]
    unemployment = put(d / "unempl.csv", ["series_id", "year", "value"], un)
    est = {}
    for y in YEARS:
        if y == 2014:
            continue
        names = ["fipstate", "fipscty", "naics", "emp", "est", *CLASSES]
        if y >= 2017:
            names[5] = "n.5"
        rows = []
        for c in COUNTIES:
            for n in ("311///", "312///", "421///", "445///", "3111//", "3121//", "------"):
                counts = [int(v) for v in rng.integers(0, 9, len(CLASSES))]
                if y >= 2017:
                    counts = ["N" if v < 3 else v for v in counts]
                rows.append([int(c[:2]), int(c[2:]), n, int(rng.integers(50, 90)), 40, *counts])
        est[y] = put(d / f"cbp{y % 100:02d}co.txt", [n.upper() for n in names] if y == 2015 else names, rows)
    os.makedirs(d / "trade")
    trade_years = {}
    for y in YEARS:
        u, f = f"NOMINAL_USE_{y}.csv", f"NOMINAL_FDAGG_{y}.csv"
        put(d / "trade" / u, ["SECTORNUMBER", "X1", "X2"], [[1, 0, 0], [206, 100 + y - 2000, 200]])
        put(d / "trade" / f, ["SECTORNUMBER", "X7", "X8"], [[1, 0, -10], [2, 0, -40]])
        trade_years |= {u: y, f: y}
    walk = put(d / "walk.csv", ["Sector Number", "2017 North American Industry Classification System (NAICS)"], [[1, "3111"], [2, "3121"], [3, "text"]])
    stock = lambda k: [[i + 1, "x", code, 5, 6, *[k * (10 + i) for _ in range(19)]] for i, code in enumerate(["   311", "   312", "   421", "   ABC"])]
    header = ["Line", "X2", "X3", "1999", "2000", *map(str, range(2001, 2020))]
    notes = [f"note {i}" for i in range(7)]
    zones = put(d / "zones.csv", ["FIPS", "Commuting Zone ID, 2000", "Commuting Zone Population 2000"], [[c, z, 5] for c, z in ZONES.items()])
    return rp.Inputs(
        accounts, union, states, unemployment, est, (str(d / "trade"), "NOMINAL_USE*"), (str(d / "trade"), "NOMINAL_FDAGG*"), trade_years,
        walk, put(d / "hist.csv", header, stock(1), notes), put(d / "curr.csv", header, stock(3), notes), zones,
    )


@pytest.fixture(scope="module")
def panel(spark, inputs):
    return rp.build(spark, inputs).cache()


def test_panel_shape(panel):
    assert Panel(panel, [rp.ZONE, rp.SECTOR]).check()
    # 3 zones x 2 sectors after merging 42 and 44-45, for the years that union and unemployment data cover.
    assert panel.count() == 3 * 2 * 18
    assert {r[0] for r in panel.select(rp.SECTOR).distinct().collect()} == {"31-33", "42-45"}


def test_missing_year_gives_zero_establishments(panel):
    got = panel.filter("year = 2014").agg(F.sum("est"), F.max("HHI_labor")).first()
    assert tuple(got) == (0.0, 0.0)


def test_suppressed_text_counts_are_numbers(spark, inputs):
    raw = rp.establishments(spark, inputs.establishments)
    assert raw.select("year").distinct().count() == 17
    late = raw.filter("year >= 2017").agg(*[F.min(c).alias(c) for c in CLASSES]).first()
    assert all(v is not None and v >= 0 for v in late)
    cells = rp.sector_establishments(raw)
    assert cells.filter(" OR ".join(f"({c} > 0 AND {c} < 3)" for c in CLASSES)).count() == 0
    assert cells.filter("est <> " + " + ".join(CLASSES)).count() == 0


def test_capital_cost_is_current_over_historical(spark, inputs, panel):
    cost = rp.capital_cost(spark, inputs)
    assert {r[0] for r in cost.select("capital_cost_index").distinct().collect()} == {3.0}
    assert {r[0] for r in cost.select("year").distinct().collect()} == set(range(2001, 2020))


def test_import_exposure_weights(spark, inputs):
    raw = rp.establishments(spark, inputs.establishments)
    got = rp.exposure(spark, inputs, rp.employment_by_code(raw)).filter("year = 2003 AND GeoFIPS = '01001'").first()
    emp = {r["naics"]: r["emp"] for r in raw.filter("year = 2003 AND GeoFIPS = '01001' AND naics > 999").collect()}
    want = (emp[3111] * 10 / 103 + emp[3121] * 40 / 200) / (emp[3111] + emp[3121])
    assert got["IndustryClassification"] == "31-33" and abs(got["import_exposure"] - want) < 1e-12


def test_non_numeric_account_cells_are_skipped(spark, inputs):
    a = rp.accounts(spark, inputs.accounts)
    row = a.filter("GeoFIPS = '01001' AND IndustryClassification = '42' AND year = 2005").first()
    assert row["COMP"] is None and row["GDP"] is None
    assert a.filter("GeoFIPS = '00000'").count() == 0
    assert set(a.columns) == {"GeoFIPS", "year", "IndustryClassification", *rp.ACCOUNTS}


def test_shares_sum_to_one(panel):
    s = panel.groupBy(rp.ZONE, rp.YEAR).agg(F.sum("EMPL_SHARE").alias("e"), F.sum("VA_SHARE").alias("v"))
    assert s.filter("abs(e - 1) > 1e-9 OR abs(v - 1) > 1e-9").count() == 0


def test_samples_and_fits_run_on_the_panel(spark, panel):
    coef = samples.industry_coefficients(panel, ["D_HHI_labor", "D_unempl_rate"])
    assert {r["Industry"] for r in coef.collect()} == {"31-33", "42-45"}
    assert set(coef.columns) == {"Industry", "term", "estimate", "std_error", "statistic", "p_value", "nobs"}
    empty = samples.sector_differences(panel, "44-45")
    assert empty.count() == 0 and "D_PSI" in empty.columns
    multi = samples.multi_equation_sample(panel)
    p = Panel(multi, rp.ZONE).check()
    assert pm.within(p, "LABOR_SHARE", ["HHI_labor", "union_memb"], "twoways").fit.nobs == 3 * 18
    fit = gm.gmm(p, "HHI_labor", ["EMPL_SHARE"], (3, 4), steps=1)
    assert np.isfinite(fit.fit.beta).all()
    two = samples.two_way_sample(panel.withColumn("LAND", F.lit(2.0)), land="LAND")
    assert two.filter("est_per_mile <> est / 2").count() == 0


def test_vote_share_and_figures(spark, panel):
    votes = spark.createDataFrame(
        [("1", 2012, "REPUBLICAN", 4, 10), ("1", 2012, "DEMOCRAT", 6, 10), ("1", 2016, "REPUBLICAN", 5, 10), ("2", 2012, "REPUBLICAN", 1, 0)],
        "CZ_ID string, year int, party string, candidatevotes int, totalvotes int",
    )
    out = figures.with_vote_share(panel, votes, {2012: 2002, 2016: 2017})
    got = {(r[0], r[1], r[2]) for r in out.filter("repub_share IS NOT NULL").select("CZ_ID", "year", "repub_share").collect()}
    assert got == {("1", 2002, 0.4), ("1", 2017, 0.5)}
    change = figures.change_table(out, 2002, 2017, "31-33")
    assert change.count() == 3 and "D_repub_share" in change.columns
    assert change.filter("CZ_ID = '1'").first()["D_repub_share"] == pytest.approx(0.1)
    member = spark.createDataFrame(list(ZONES.items()), "fips string, CZ_ID string")
    one = Panel(panel.filter("IndustryClassification = '31-33'"), rp.ZONE)
    mapped = metrics.change_map(member, one, [rp.ZONE], "HHI_labor", 2002, 2017, (-1e-9, 1e-9))
    assert mapped.count() == 4 and mapped.filter("delta IS NOT NULL").count() == 0


def test_sinks_round_trip(spark, panel, tmp_path):
    out = figures.difference_export(panel, {2007: 2, 2012: 3, 2017: 4}, 2002)
    sinks.write_csv(out, str(tmp_path / "csv"))
    back = readers.read_csv(spark, str(tmp_path / "csv"))
    assert back.count() == out.dropna().count() > 0 and set(back.columns) == set(out.columns)
    sinks.write_panel(panel, str(tmp_path / "parquet"))
    read = spark.read.parquet(str(tmp_path / "parquet")).filter("year = 2003")
    assert read.count() == 6
    assert "PartitionFilters: [isnotnull(year" in read._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_preamble_and_year_from_name(spark, inputs, tmp_path):
    assert readers.header_of(spark, inputs.historical_cost, 7)[:3] == ["Line", "X2", "X3"]
    use = readers.read_matching(spark, *inputs.value_added)
    years = {r[0] for r in use.select(readers.year_from_name("source_file")).distinct().collect()}
    assert years == set(YEARS)
    short = spark.createDataFrame([("cbp07co.txt",)], "f string").select(readers.year_from_name("f", r"(\d{2})", 2000)).first()[0]
    assert short == 2007
