"""Folder of station files: metadata lines, a blank line, a header, then one row per month.

The header may name other columns in each file, so a cell gets its name from the header of its own file. Files are read
through Spark's file reader, whole, so any path that Spark can open will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voltmes.functions.numbers import parse_ptbr, to_number

# Names in the files and the columns they become.
DATE_HEADER = "Data Medicao"
MEASURES = {
    "NUMERO DE DIAS COM PRECIP. PLUV, MENSAL (AUT)(número)": "dias_chuva",
    "PRECIPITACAO TOTAL, MENSAL (AUT)(mm)": "precip_mm",
    "PRESSAO ATMOSFERICA, MEDIA MENSAL (AUT)(mB)": "pressao_mb",
    "TEMPERATURA MEDIA, MENSAL (AUT)(°C)": "temp_c",
    "VENTO, VELOCIDADE MAXIMA MENSAL (AUT)(m/s)": "vento_max",
    "VENTO, VELOCIDADE MEDIA MENSAL (AUT)(m/s)": "vento_med",
}
METADATA = {
    "Nome": "nome",
    "Codigo Estacao": "codigo",
    "Latitude": "latitude",
    "Longitude": "longitude",
    "Altitude": "altitude",
    "Situacao": "situacao",
    "Data Inicial": "data_inicial",
    "Data Final": "data_final",
    "Periodicidade da Medicao": "periodicidade",
}
MISSING = "null"

_DATA_LINE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2};"
_METADATA_LINE = r"^([^;:]+): *(.*)$"


def station_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: its lines, station code, column names by position (null without a header) and whether it is corrupt.

    A file is read whole by one task, so its header and its rows stay together and nothing is joined or shuffled; small
    files share tasks. Station files are small (a row per month); one beyond 2 GB fails the job. A file that isn't valid
    UTF-8 is read as Latin-1. One with a zero byte is corrupt and has no lines. Spark's reader passes over files of no bytes.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    utf8, content = F.col("content").cast("string"), F.col("content")
    corrupt = F.locate("\0", F.decode(content, "ISO-8859-1")) > 0
    text = F.when(corrupt, F.lit(None)).when(F.is_valid_utf8(utf8), F.regexp_replace(utf8, "^\ufeff", "")).otherwise(F.decode(content, "ISO-8859-1"))
    files = raw.select(F.col("path").alias("file"), corrupt.alias("corrupt"), F.split(text, "\r\n|\n|\r").alias("lines"))
    files = files.withColumn("lines", F.coalesce(F.transform("lines", lambda x: F.rtrim(x)), F.array().cast("array<string>")))
    header = F.get(F.filter("lines", _is_header), F.lit(0))
    return files.withColumns({"names": _cells(header), "codigo": _fact("lines", "Codigo Estacao")})


def _is_header(line: Column) -> Column:
    return line.startswith(DATE_HEADER + ";")


def _fact(lines: str, key: str) -> Column:
    """The value of the first metadata line with that key."""
    found = F.filter(lines, lambda x: ~x.contains(";") & (F.trim(F.regexp_extract(x, _METADATA_LINE, 1)) == key))
    return F.trim(F.regexp_extract(F.get(found, F.lit(0)), _METADATA_LINE, 2))


def station_dimension(files: DataFrame) -> DataFrame:
    """One row per file with its metadata; the station's key is ``codigo``, names repeat. Files without any are left out."""
    texts = files.select("file", *[_fact("lines", key).alias(name) for key, name in METADATA.items()])
    return texts.where(F.coalesce(*METADATA.values()).isNotNull()).withColumns({
        **{c: to_number(F.col(c)) for c in ("latitude", "longitude", "altitude")},
        **{c: F.try_to_date(c, "yyyy-MM-dd") for c in ("data_inicial", "data_final")},
    })


def _cells(line: Column) -> Column:
    """Cells of a line whose last separator ends the row."""
    return F.split(F.regexp_replace(line, ";$", ""), ";", -1)


def station_cells(files: DataFrame) -> DataFrame:
    """Data rows as cell arrays next to the column names and station code of their file; what lacks either is in ``quarantine``."""
    whole = files.where("names is not null and codigo is not null")
    data = whole.select("file", "codigo", "names", F.explode(F.filter("lines", lambda x: x.rlike(_DATA_LINE))).alias("line"))
    return data.select("file", _cells(F.col("line")).alias("cells"), "names", "codigo")


def quarantine(files: DataFrame) -> DataFrame:
    """(file, codigo, reason, line_no, line) of everything that is left out of the months or read in part only.

    Reasons: ``corrupt`` and, without a data line, ``no header`` and ``no code`` for whole files (line null); for data lines
    ``no header``, ``no code``, ``date`` (no such day; the month stays, undated) and ``surplus`` (values beyond the last
    column); ``line`` for any other text below the header.
    """
    header_at = F.array_position(F.transform("lines", _is_header), True)
    judged = files.select("file", "codigo", "corrupt", "names", header_at.alias("header_at"),
                          F.exists("lines", lambda x: x.rlike(_DATA_LINE)).alias("has_data"), F.posexplode_outer("lines").alias("at", "line"))
    data, whole = F.col("line").rlike(_DATA_LINE), ~F.col("has_data") & (F.col("at") == 0)
    below = (F.col("at") >= F.col("header_at")) & (F.col("line") != "")
    judged = judged.withColumn("cells", F.when(data, _cells(F.col("line"))))
    reason = (
        F.when(F.col("corrupt"), "corrupt")
        .when(F.col("names").isNull(), F.when(data | whole, "no header"))
        .when(F.col("codigo").isNull(), F.when(data | whole, "no code"))
        .when(data & (F.size(_surplus()) > 0), "surplus")
        .when(data & F.try_to_date(F.get("cells", F.lit(0)), "yyyy-MM-dd").isNull(), "date")
        .when(~data & below, "line"))
    line = F.when(data | below & (F.col("header_at") > 0), F.col("line"))
    return judged.select("file", "codigo", reason.alias("reason"), (F.col("at") + 1).alias("line_no"), line.alias("line")).where("reason is not null")


def station_months(cells: DataFrame) -> DataFrame:
    """One row per station and month; a measure that the file's header lacks is null."""
    def cell(name: str) -> Column:
        at = F.array_position("names", F.lit(name))
        text = F.when(at > 0, F.get("cells", (at - 1).cast("int")))
        return F.when(text != MISSING, text)

    return cells.select(
        "codigo",
        F.try_to_date(cell(DATE_HEADER), "yyyy-MM-dd").alias("data"),
        *[parse_ptbr(cell(name)).alias(column) for name, column in MEASURES.items()],
    ).withColumn("mes_ano", F.date_format("data", "yyyy-MM"))


def _surplus() -> Column:
    beyond = F.slice("cells", F.size("names") + 1, F.greatest(F.size("cells") - F.size("names"), F.lit(0)))
    return F.filter(beyond, lambda c: (c != MISSING) & (F.trim(c) != ""))


def surplus_cells(cells: DataFrame) -> DataFrame:
    """Quarantine: rows with a value beyond the last column of their header."""
    return cells.select("file", "codigo", F.get("cells", F.lit(0)).alias("data"), _surplus().alias("surplus")).where(
        F.size("surplus") > 0)


def write_station_files(rows: DataFrame, folder: str) -> str:
    """Station-shaped text files from ``(codigo, line_no, line)`` rows, one file per station."""
    (
        rows.repartition("codigo").sortWithinPartitions("codigo", "line_no")
        .select("codigo", "line").write.mode("overwrite").partitionBy("codigo").text(folder)
    )
    return folder
