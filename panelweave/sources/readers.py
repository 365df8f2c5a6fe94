"""Readers for yearly statistics files.

Files of one logical table may differ between years (upper-case names, renamed columns, text in
number columns). Each distinct header becomes one scan over all files that share it, so the number of
scans is the number of layouts, not the number of files.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from fnmatch import fnmatchcase
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import codes, missing
from .sheets import read_sheet


def read_csv(spark: SparkSession, path, schema: T.StructType | str | None = None, sep: str = ",") -> DataFrame:
    """Delimited file with a header line. Without a schema every column is read as text."""
    reader = spark.read.option("header", True).option("sep", sep)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A lookup table kept as a spreadsheet (its first sheet), CSV or Parquet."""
    if str(path).endswith(".xlsx"):
        return read_sheet(spark, path)
    return spark.read.parquet(path) if str(path).endswith(".parquet") else read_csv(spark, path)


def header_of(spark: SparkSession, path: str, skip: int = 0, sep: str = ",") -> list[str]:
    """Column names in the first line after ``skip`` lines (reads only the head of one file).

    The line is parsed as CSV, so a quoted name may hold the separator; empty names become X1, X2, ...
    """
    lines = spark.read.text(path).take(skip + 1)
    return _names(lines[skip]["value"], sep)


def _names(line: str, sep: str) -> list[str]:
    names = [p.strip() for p in next(csv.reader([line], delimiter=sep, skipinitialspace=True), [])]
    return [n if n else f"X{i + 1}" for i, n in enumerate(names)]


def read_after_preamble(
    spark: SparkSession, path: str, skip: int, keep: Column, sep: str = ","
) -> DataFrame:
    """File whose header follows ``skip`` lines of text.

    All lines are parsed as text under that header; ``keep`` tells data rows from preamble, header
    and footnotes, so no line positions are needed once the file is split between tasks.
    """
    names = header_of(spark, path, skip, sep)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.option("sep", sep).schema(schema).csv(path).filter(keep)


def headers(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> dict[str, list[str]]:
    """Column names of many files by path, in one job; files without a line are left out.

    The first record of a file lies in its first block, which one task reads in order, so the aggregate keeps
    one line per file and nothing else is moved.
    """
    lines = spark.read.text(list(paths)).filter("_metadata.file_block_start = 0")
    first = lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.first("value").alias("value")).collect()
    found = {r["path"]: _names(r["value"], sep) for r in first}
    # Spark may report a path with one or three slashes after the scheme, and with escapes.
    plain = {_plain_path(p): names for p, names in found.items()}
    out = {}
    for path in paths:
        names = plain.get(_plain_path(path)) or plain.get(quote(_plain_path(path)))
        if names is not None:
            out[path] = names
    return out


def _by_layout(spark: SparkSession, paths: Iterable[str], sep: str) -> Iterator[tuple[list[str], DataFrame]]:
    """One scan, all columns as text, for the files of each distinct header, with their paths."""
    layouts: dict[tuple[str, ...], list[str]] = {}
    for path, names in headers(spark, list(paths), sep).items():
        layouts.setdefault(tuple(names), []).append(path)
    for names, group in layouts.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        raw = spark.read.option("header", True).option("sep", sep).option("enforceSchema", True).schema(schema).csv(group)
        yield group, raw


def read_matching(spark: SparkSession, folder: str, pattern: str, sep: str = ",") -> DataFrame:
    """All files of a folder whose names match a glob, as text, with the file name in ``source_file``.

    Columns are matched by the names in each file's own header; a column some files lack is NULL there.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").collect()
    paths = sorted(r["path"] for r in found)
    if not paths:
        raise FileNotFoundError(f"no file in {folder} matches {pattern}")
    # Listing, headers, then one scan per layout: the number of jobs does not depend on the number of files.
    return stack(raw.select("*", F.col("_metadata.file_name").alias("source_file")) for _, raw in _by_layout(spark, paths, sep))


def year_from_name(file_name: str | Column, pattern: str = r"(\d{4})", base: int = 0) -> Column:
    """Year taken from a file name; ``base`` completes two-digit years."""
    return (F.regexp_extract(missing.col(file_name), pattern, 1).try_cast("int") + F.lit(base)).cast("int")


def year_from_map(file_name: str | Column, years: Mapping[str, int]) -> Column:
    """Year by an explicit (file name, year) map; unknown files give NULL."""
    return codes.recode(file_name, dict(years), F.lit(None).cast("int")).cast("int")


def harmonise(
    df: DataFrame,
    renames: Mapping[str, str] | None = None,
    numeric: Iterable[str] = (),
    zero: Iterable[str] = (),
) -> DataFrame:
    """Bring one layout to the common one: lower-case names, renames, text to number, NULL to 0."""
    out = df.toDF(*[c.lower() for c in df.columns])
    if renames:
        out = out.withColumnsRenamed({k.lower(): v for k, v in renames.items() if k.lower() in out.columns})
    out = missing.cast_columns(out, [c for c in numeric if c in out.columns])
    zero = [c for c in zero if c in out.columns]
    return missing.fill_zero(out, zero) if zero else out


def stack(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of all frames under the union of their columns, matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_yearly(
    spark: SparkSession,
    files: Mapping[int, str],
    renames: Mapping[str, str] | None = None,
    numeric: Iterable[str] = (),
    zero: Iterable[str] = (),
    sep: str = ",",
) -> DataFrame:
    """One file per year, layouts drifting, as one frame with a ``year`` column.

    Years go by the full path, so files of one name in different folders stay apart.
    """
    # Paths as Spark reports them for each row, from one listing; a pattern has the files it matches.
    listed = [r["path"] for r in spark.read.format("binaryFile").load(list(dict.fromkeys(files.values()))).select("path").collect()]
    years: dict[str, int] = {}
    for year, path in sorted(files.items()):
        pattern = _qualified(spark, path)
        seen = [p for p in listed if fnmatchcase(_plain_path(p), pattern) or _plain_path(p) == pattern]
        if len(seen) != 1 or seen[0] in years:
            raise ValueError(f"year {year}: {path} must be one file that no other year has")
        years[seen[0]] = year
    frames = []
    for group, raw in _by_layout(spark, years, sep):
        # Spark may report a path with one or three slashes after the scheme, and with escapes.
        here = {spelling: years[p] for p in group for spelling in (_plain_path(p), quote(_plain_path(p)))}
        place = F.regexp_replace("_metadata.file_path", "^file:/+", "/")
        year = F.coalesce(year_from_map(place, here), F.raise_error(F.concat(F.lit("no year for "), place)).cast("int"))
        frames.append(harmonise(raw.withColumn("year", year), renames, numeric, zero))
    return stack(frames)


def _plain_path(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme and folder, as a listing has it; no file is looked at."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = made.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return _plain_path(system.makeQualified(made).toString())


def with_dimension(df: DataFrame, dimension: DataFrame, on: Mapping[str, str], take: Iterable[str]) -> DataFrame:
    """Look up attributes of a code or name in a dimension table; unmatched rows keep NULL."""
    dim = dimension.select(*[F.col(d).alias(f"__{d}") for d in on.values()], *take)
    cond = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{d}") for c, d in on.items()])
    return df.join(dim, cond, "left").drop(*[f"__{d}" for d in on.values()])
