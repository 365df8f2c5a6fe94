"""Code handling: recoding, fixed-width keys, geographic and industry codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .missing import col

# Two-digit industry codes that form one published sector.
SECTOR_OF_TWO_DIGITS = {
    "31": "31-33", "32": "31-33", "33": "31-33",
    "44": "44-45", "45": "44-45",
    "48": "48-49", "49": "48-49",
}

# Sectors merged into super-sectors for the zone panel.
SUPER_SECTOR = {
    "42": "42-45", "44-45": "42-45",
    "54": "54-56", "55": "54-56", "56": "54-56",
    "61": "61-62", "62": "61-62",
    "71": "71-81", "72": "71-81", "81": "71-81",
}


def recode(c: str | Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Replace values found in ``mapping``; others keep their value, or take ``default``."""
    source = col(c)
    groups: dict = {}
    for old, new in mapping.items():
        groups.setdefault(new, []).append(old)
    out = None
    for new, olds in groups.items():
        hit = source.isin(olds)
        out = F.when(hit, F.lit(new)) if out is None else out.when(hit, F.lit(new))
    rest = source if default is None else default
    return rest if out is None else out.otherwise(rest)


def sector_of(code: str | Column) -> Column:
    """Published sector of an industry code, from its first two characters."""
    return recode(F.substring(col(code).cast("string"), 1, 2), SECTOR_OF_TWO_DIGITS)


def is_sector_code(code: str | Column) -> Column:
    """Sector rows of a code hierarchy: two characters, or a range such as 31-33."""
    c = col(code)
    return (F.length(c) == 2) | (F.substring(c, 3, 1) == "-")


def code_depth(code: str | Column, digits: int) -> Column:
    """True where a numeric code has exactly ``digits`` digits."""
    return col(code).between(10 ** (digits - 1), 10**digits - 1)


def strip_padding(code: str | Column) -> Column:
    """Industry code written with trailing dashes or slashes, as a number."""
    return F.regexp_replace(col(code).cast("string"), "[-/]", "").try_cast("int")


def county_fips(state: str | Column, county: str | Column) -> Column:
    """Five-character county code: two digits of state, three of county."""
    return F.concat(
        F.lpad(col(state).cast("string"), 2, "0"), F.lpad(col(county).cast("string"), 3, "0")
    )


def state_of(fips: str | Column) -> Column:
    return F.substring(col(fips), 1, 2)


def fixed_width(c: str | Column, layout: Mapping[str, tuple[int, int]]) -> dict[str, Column]:
    """Columns cut from a fixed-width key; ``layout`` gives first and last position, from 1."""
    return {name: F.substring(col(c), a, b - a + 1) for name, (a, b) in layout.items()}


# Positions inside an unemployment series id.
SERIES_LAYOUT = {"measure": (19, 20), "seasonal": (3, 3), "geo": (6, 10)}


def strip_prefix(c: str | Column, prefix: str) -> Column:
    return F.regexp_replace(col(c), f"^{prefix}", "")


def values_in(c: str | Column, values: Sequence) -> Column:
    return col(c).isin(list(values))
