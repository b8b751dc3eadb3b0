"""Census tables, one file per region, with the region in the file's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voltmes.functions.numbers import parse_ptbr
from voltmes.operators.ordering import join_facts

# Names in the files.
YEAR_HEADER = "Ano da pesquisa"
POPULATION_HEADER = "População(pessoas)"
CENSUS_YEAR = 2022

# The file, or the folder a distributed writer leaves under that name; hyphens inside the region stay.
_NAME = r"(?i)(censo[^/]*\.csv)(?:/[^/]*)?$"
_REGION = r"(?i)^censo.* - (.+)\.csv$"
_REGION_UNSPACED = r"(?i)-([^-]+)\.csv$"


def census_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the files named ``censo….csv``, with file name, region and a sort key that is file order."""
    lines = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).text(folder)
    name = F.regexp_extract(F.url_decode("_metadata.file_path"), _NAME, 1)
    spaced = F.regexp_extract(name, _REGION, 1)
    region = F.when(spaced != "", spaced).otherwise(F.regexp_extract(name, _REGION_UNSPACED, 1))
    return lines.select(
        name.alias("file"),
        F.trim(region).alias("regiao"),
        F.struct(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        ).alias("at"),
        F.split(F.regexp_replace("value", "[\r﻿]", ""), ";", -1).alias("cells"),
    ).where(F.col("file") != "")


def _is_header() -> Column:
    return F.array_contains("cells", YEAR_HEADER) | F.array_contains("cells", POPULATION_HEADER)


def census_headers(lines: DataFrame) -> DataFrame:
    """Per file, where year and population stand; 0 for a column that the file lacks."""
    return lines.groupBy("file", "regiao").agg(
        F.max(F.array_position("cells", F.lit(YEAR_HEADER))).alias("year_at"),
        F.max(F.array_position("cells", F.lit(POPULATION_HEADER))).alias("population_at"),
    )


def census_rows(lines: DataFrame) -> DataFrame:
    """Year and population of every data line of the files that have both columns."""
    usable = census_headers(lines).where((F.col("year_at") > 0) & (F.col("population_at") > 0))
    data = join_facts(lines.where(~_is_header()), usable.drop("regiao"), ["file"])
    return data.select(
        "regiao", "at",
        F.get("cells", (F.col("year_at") - 1).cast("int")).try_cast("int").alias("ano"),
        parse_ptbr(F.get("cells", (F.col("population_at") - 1).cast("int"))).alias("populacao"),
    )


def skipped_files(lines: DataFrame) -> DataFrame:
    """Files left out because a required column is missing."""
    return census_headers(lines).where((F.col("year_at") == 0) | (F.col("population_at") == 0)).select("file")


def population_by_region(rows: DataFrame, year: int = CENSUS_YEAR) -> DataFrame:
    """The wanted year's first population, else the last known one in file order."""
    known = F.col("populacao").isNotNull()
    this_year = F.col("ano") == year
    picked = rows.groupBy("regiao").agg(
        F.max(F.coalesce(this_year, F.lit(False))).alias("_has_year"),
        F.min_by("populacao", F.when(known & this_year, F.col("at"))).alias("_wanted"),
        F.max_by("populacao", F.when(known, F.col("at"))).alias("_last"),
    )
    return picked.select(
        "regiao", F.when(F.col("_has_year"), F.col("_wanted")).otherwise(F.col("_last")).cast("long").alias("populacao")
    ).where(F.col("populacao").isNotNull())
