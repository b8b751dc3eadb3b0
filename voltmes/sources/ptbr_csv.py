"""Semicolon CSV with Brazilian numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from voltmes.functions.numbers import format_ptbr, nan_to_null, parse_ptbr

# Encodings in the order in which they are tried, and Spark's names for them.
ENCODINGS = ("utf-8", "latin1", "cp1252")
SPARK_NAMES = {"latin1": "iso-8859-1", "latin-1": "iso-8859-1"}


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists, in order of preference."""
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(", ".join(paths))


def read_text_columns(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, sep: str = ";", encoding: str = "utf-8"
) -> DataFrame:
    """All columns as text. Naming the columns saves the pass that reads the header."""
    reader = spark.read.option("sep", sep).option("header", True).option("encoding", SPARK_NAMES.get(encoding, encoding))
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def read_ptbr_csv(
    spark: SparkSession, path: str, numeric: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Text columns with the named ones parsed as Brazilian numbers."""
    df = read_text_columns(spark, path, columns)
    return df.withColumns({c: parse_ptbr(F.col(c)) for c in numeric})


def read_any_encoding(
    spark: SparkSession, path: str, encoding: str | None = None, sep: str = ","
) -> DataFrame | None:
    """Reads as the given encoding, else the first that decodes all text; None if the path is missing.

    Undecodable bytes show up as U+FFFD. Latin-1 decodes any byte, so nothing is tried after it.
    """
    if not path_exists(spark, path):
        return None
    for name in [encoding] if encoding else ENCODINGS:
        if encoding or not has_broken_text(spark, path, name):
            return read_text_columns(spark, path, sep=sep, encoding=name)
    return None


def has_broken_text(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether any line has bytes that the encoding cannot decode; stops at the first such line."""
    lines = spark.read.option("encoding", SPARK_NAMES.get(encoding, encoding)).option("sep", "\x01").schema("line string").csv(path)
    return not lines.where(F.col("line").contains("�")).limit(1).isEmpty()


def write_ptbr_csv(df: DataFrame, path: str, index: Sequence[str] = ()) -> str:
    """Semicolon CSV with decimal commas; ``index`` columns come first.

    Every task writes its own part file below ``path``.
    """
    ordered = [*index, *[c for c in df.columns if c not in index]]
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))}
    shown = df.select(*[format_ptbr(F.col(c)).alias(c) if c in floats else F.col(c) for c in ordered])
    shown.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)
    return path


def write_prepared(df: DataFrame, path: str, by: str = "regiao") -> str:
    """Columnar copy of a prepared table, one folder per region so that a region's rows are read alone."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)
    return path


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in every floating column: Spark ranks NaN above all numbers."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats})
