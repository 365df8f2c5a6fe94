"""From yearly public statistics files to the zone x sector x year panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import codes, missing
from ..operators import aggregate, joins, metrics, reshape
from ..sources import readers

GEO, SECTOR, ZONE, YEAR = "GeoFIPS", "IndustryClassification", "CZ_ID", "year"
CLASSES = list(metrics.SIZE_CLASS_UPPER)
ACCOUNTS = ["COMP", "PERSONAL_INC", "GDP", "RGDP", "EMPL"]
SUMS = [*ACCOUNTS, "emp", "est", *CLASSES]
MEANS = ["union_memb", "unempl_rate", "import_exposure", "capital_cost_index"]


@dataclass
class Inputs:
    """Locations of the source tables. Spreadsheets are expected as CSV or Parquet exports."""

    accounts: Mapping[str, str]  # measure -> wide file, for every name in ACCOUNTS
    union: str
    states: str  # state name -> two-digit code: state_name, state_fips
    unemployment: str
    establishments: Mapping[int, str]  # year -> file
    value_added: tuple[str, str]  # folder, file name pattern
    imports: tuple[str, str]
    trade_years: Mapping[str, int]  # file name -> year, for both trade tables
    sector_crosswalk: str
    historical_cost: str
    current_cost: str
    zones: str
    value_added_row: int = 206
    import_column: str = "X8"
    preamble: int = 7


def accounts(spark: SparkSession, files: Mapping[str, str], national: str = "00000") -> DataFrame:
    """County accounts: sector rows of each wide file, long by year, joined on their common key."""
    frames = []
    for measure, path in files.items():
        wide = readers.read_csv(spark, path)
        wide = wide.filter(codes.is_sector_code(SECTOR) & (F.col(GEO) != national))
        frames.append(reshape.years_to_long(wide, [GEO, SECTOR], measure, first=2000))
    return joins.join_all(frames, [GEO, YEAR, SECTOR])


def union_density(spark: SparkSession, path: str, states: str) -> DataFrame:
    """Union membership by state code and year, from columns %Mem64 ... %Mem20."""
    wide = readers.read_table(spark, path)
    columns = [c for c in wide.columns if c.startswith("%Mem") and int(c[4:6]) < 60]
    text = wide.select(F.col("`State Name`").alias("state_name"), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    long = reshape.to_long(text, ["state_name"], columns, "label", "union_memb")
    long = long.withColumn(YEAR, (F.substring("label", 5, 2).cast("int") + 2000).cast("int"))
    named = readers.with_dimension(long, readers.read_table(spark, states), {"state_name": "state_name"}, ["state_fips"])
    return named.select("state_fips", YEAR, "union_memb")


def unemployment(spark: SparkSession, path: str, measure: str = "03") -> DataFrame:
    """County unemployment rate from fixed-width series ids."""
    raw = readers.read_table(spark, path)
    parts = codes.fixed_width("series_id", codes.SERIES_LAYOUT)
    return raw.filter(parts["measure"] == measure).select(
        parts["geo"].alias(GEO), F.col(YEAR).cast("int").alias(YEAR), missing.to_number("value").alias("unempl_rate")
    )


def establishments(spark: SparkSession, files: Mapping[int, str]) -> DataFrame:
    """All yearly establishment files with one layout."""
    raw = readers.read_yearly(spark, files, {"n.5": "n1_4", "n<5": "n1_4"}, ["emp", "est", *CLASSES])
    # Later years write "not a number" for suppressed cells; these count as zero.
    text_years = F.col(YEAR) >= 2017
    raw = raw.withColumns({c: F.when(text_years, F.coalesce(F.col(c), F.lit(0.0))).otherwise(F.col(c)) for c in CLASSES})
    return raw.select(
        codes.county_fips("fipstate", "fipscty").alias(GEO), codes.strip_padding("naics").alias("naics"), YEAR, "emp", "est", *CLASSES
    )


def employment_by_code(raw: DataFrame) -> DataFrame:
    """Employment of four-digit codes, the weights of import exposure."""
    return raw.filter(codes.code_depth("naics", 4)).select(GEO, F.col("naics").alias("code"), YEAR, "emp")


def sector_establishments(raw: DataFrame) -> DataFrame:
    """Three-digit cells, small ones suppressed, summed to sectors."""
    cells = missing.suppress_small(raw.filter(codes.code_depth("naics", 3)), ["est", *CLASSES])
    cells = cells.withColumn("est", missing.row_sum(CLASSES))
    return aggregate.sum_list(cells.withColumn(SECTOR, codes.sector_of("naics")), [SECTOR, GEO, YEAR], ["est", "emp", *CLASSES])


def exposure(spark: SparkSession, inputs: Inputs, employment: DataFrame) -> DataFrame:
    """Import exposure by county, year and sector."""
    va = readers.read_matching(spark, *inputs.value_added)
    va = va.withColumn(YEAR, readers.year_from_map("source_file", inputs.trade_years))
    va = reshape.row_to_long(va, F.col("SECTORNUMBER").cast("int") == inputs.value_added_row, "sector_no", "value_added", ids=[YEAR])
    im = readers.read_matching(spark, *inputs.imports)
    im = im.select(
        F.col("SECTORNUMBER").cast("int").alias("sector_no"),
        missing.to_number(inputs.import_column).alias("import"),
        readers.year_from_map("source_file", inputs.trade_years).alias(YEAR),
    )
    walk = readers.read_table(spark, inputs.sector_crosswalk)
    walk = walk.select(
        F.col("`Sector Number`").cast("int").alias("sector_no"),
        F.col("`2017 North American Industry Classification System (NAICS)`").try_cast("int").alias("code"),
    )
    out = metrics.import_exposure(va, im, walk, employment, GEO)
    return out.withColumnRenamed("sector", SECTOR)


def capital_cost(spark: SparkSession, inputs: Inputs) -> DataFrame:
    """Implicit capital price index by sector and year."""

    def stock(path: str) -> DataFrame:
        digits = F.substring("X3", 4, 3)
        raw = readers.read_after_preamble(spark, path, inputs.preamble, digits.try_cast("int").isNotNull())
        years = [c for c in raw.columns if c.isdigit() and not c.startswith("19") and not c.endswith("00")]
        return raw.select(digits.cast("int").alias("naics"), *[missing.to_number(f"`{y}`").alias(y) for y in years])

    hist, curr = stock(inputs.historical_cost), stock(inputs.current_cost)
    years = [c for c in hist.columns if c in curr.columns and c != "naics"]
    return metrics.price_index(hist, curr, "naics", years, codes.sector_of("naics"), SECTOR)


def zones(spark: SparkSession, path: str) -> DataFrame:
    raw = readers.read_table(spark, path)
    return raw.select(F.col("FIPS").alias(GEO), F.col("`Commuting Zone ID, 2000`").alias(ZONE))


def county_panel(spark: SparkSession, inputs: Inputs) -> DataFrame:
    """County x sector x year panel with everything attached, before the roll-up to zones."""
    base = accounts(spark, inputs.accounts)
    base = base.withColumn("state_fips", codes.state_of(GEO))
    base = base.join(union_density(spark, inputs.union, inputs.states), ["state_fips", YEAR])
    base = base.join(unemployment(spark, inputs.unemployment), [GEO, YEAR])
    raw = establishments(spark, inputs.establishments)
    base = joins.enrich(base, sector_establishments(raw), [GEO, YEAR, SECTOR])
    base = joins.enrich(base, exposure(spark, inputs, employment_by_code(raw)), [GEO, YEAR, SECTOR])
    return joins.enrich(base, capital_cost(spark, inputs), [YEAR, SECTOR])


def zone_metrics(panel: DataFrame, classes: Mapping[str, float] = metrics.SIZE_CLASS_UPPER) -> DataFrame:
    """Shares, labour shares, establishment density and concentration of a zone panel."""
    out = aggregate.share_of_total(panel, [ZONE, YEAR], {"EMPL_SHARE": "EMPL", "VA_SHARE": "GDP"}, bounded=True)
    return out.withColumns(
        {
            "PAYROLL_SHARE": metrics.payroll_share(),
            "LABOR_SHARE": metrics.labor_share(),
            **metrics.per_unit({"est_per_worker": ("est", "EMPL")}),
            "HHI_labor": metrics.herfindahl_binned("EMPL", classes),
        }
    )


def zone_panel(
    members: DataFrame,
    crosswalk: DataFrame,
    member: Mapping[str, str],
    sums: Sequence[str] = SUMS,
    means: Sequence[str] = MEANS,
    super_sector: Column | None = None,
    classes: Mapping[str, float] = metrics.SIZE_CLASS_UPPER,
) -> DataFrame:
    """Members to zones, sectors to super-sectors, then the derived measures."""
    coarse = codes.recode(SECTOR, codes.SUPER_SECTOR) if super_sector is None else super_sector
    rolled = metrics.zone_roll_up(members, crosswalk, member, [YEAR, ZONE, SECTOR], {SECTOR: coarse}, sums, means)
    return zone_metrics(rolled, classes)


def build(spark: SparkSession, inputs: Inputs) -> DataFrame:
    """The whole chain from files to the zone panel."""
    return zone_panel(county_panel(spark, inputs), zones(spark, inputs.zones), {GEO: GEO})
