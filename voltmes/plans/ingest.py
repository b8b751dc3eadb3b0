"""Files: written from the supplied tables into the shared scratch folder, then read as a user would."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voltmes.functions.advice import recommend
from voltmes.functions.numbers import format_ptbr
from voltmes.operators.ordering import top_rows
from voltmes.operators.outliers import winsorize
from voltmes.plans import panel as p
from voltmes.plans.panel import MEASURES, PANEL_SQL
from voltmes.plans.registry import query, r, rounded, rs
from voltmes.plans.relational import LAG_SQL, SAMPLE_ROWS, WET_REGIONS, lagged_panel
from voltmes.session import scratch_path
from voltmes.sources import census, ptbr_csv, stations


@query("scan_ptbr_csv", f"""{PANEL_SQL}
SELECT mes_ano, regiao, estacao, {rs('consumo dias_chuva precip_mm pressao_mb temp_c vento_max vento_med')} FROM panel""")
def scan_ptbr_csv(spark, folder):
    kept = ["mes_ano", "regiao", "estacao", *p.NUMBERS]
    path = ptbr_csv.write_ptbr_csv(p.build_panel(spark, folder).select(*kept), scratch_path(spark, "panel.csv"))
    return rounded(ptbr_csv.read_ptbr_csv(spark, path, p.NUMBERS, kept))


@query("scan_string", """
SELECT CAST(o_orderkey AS VARCHAR) AS conta, o_orderstatus AS situacao,
  CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) || ',0'
    ELSE replace(CAST(o_totalprice AS VARCHAR), '.', ',') END AS valor FROM orders""")
def scan_string(spark, folder):
    orders = p.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("conta"), F.col("o_orderstatus").alias("situacao"), F.col("o_totalprice").alias("valor"))
    path = ptbr_csv.write_ptbr_csv(orders, scratch_path(spark, "contas.csv"))
    return ptbr_csv.read_text_columns(spark, path, ["conta", "situacao", "valor"])


@query("write_ptbr", """
WITH s AS (SELECT o_custkey AS medidor, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) * 1000 AS consumo,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e9 AS parte FROM orders GROUP BY 1)
SELECT medidor, consumo, parte FROM s""")
def write_ptbr(spark, folder):
    """Numbers beyond 1e7 and below 1e-3 come back from the file unchanged."""
    total = p.exact_sum(F.col("o_totalprice"), 2)
    sums = p.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("medidor")).agg(
        (total / F.lit(1e9)).alias("parte"), (total * 1000).alias("consumo"))
    path = ptbr_csv.write_ptbr_csv(sums, scratch_path(spark, "somas.csv"), index=["medidor"])
    back = ptbr_csv.read_ptbr_csv(spark, path, ["parte", "consumo"], ["medidor", "parte", "consumo"])
    return back.withColumn("medidor", F.col("medidor").cast("long"))


@query("scan_encoding", """
SELECT CAST(o_orderkey AS VARCHAR) AS conta, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Verão' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'Outono'
  WHEN month(o_orderdate) IN (6, 7, 8) THEN 'Inverno' ELSE 'Primavera' END AS estacao FROM orders""")
def scan_encoding(spark, folder):
    """A Latin-1 file is not read as UTF-8."""
    texts = p.table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("conta"), p.season_of(F.month("o_orderdate")).alias("estacao"))
    path = scratch_path(spark, "latin1.csv")
    texts.write.option("encoding", "ISO-8859-1").option("header", True).csv(path)
    return ptbr_csv.read_any_encoding(spark, path)


PREPARED = "consumo_clean consumo_wins lag1 lag12 dias_chuva precip_mm pressao_mb temp_c vento_max vento_med"


@query("prepared_sink", f"""{LAG_SQL}, b AS (SELECT quantile_cont(consumo, 0.005) AS low, quantile_cont(consumo, 0.995) AS high FROM lagged),
t AS (SELECT lagged.*, consumo AS consumo_clean, least(greatest(consumo, low), high) AS consumo_wins FROM lagged, b)
SELECT mes_ano, regiao, ano, mes, {rs(PREPARED)}, {r('roll3', 4)} FROM t
WHERE consumo IS NOT NULL AND lag1 IS NOT NULL AND lag12 IS NOT NULL AND roll3 IS NOT NULL""")
def prepared_sink(spark, folder):
    """The modelling table with the target as parsed and winsorized over all rows, stored by region and read back whole."""
    rows = lagged_panel(spark, folder).withColumn("consumo_clean", F.col("consumo"))
    rows = winsorize(rows, "consumo_clean", "consumo_wins", rows).na.drop(subset=["consumo_wins", "lag1", "lag12", "roll3"])
    path = ptbr_csv.write_prepared(rows.select("mes_ano", "regiao", "ano", "mes", *PREPARED.split(), "roll3"), scratch_path(spark, "prepared"))
    return rounded(spark.read.parquet(path).select("mes_ano", "regiao", "ano", "mes", *PREPARED.split(), "roll3"), roll3=4)


@query("recommend_sink", PANEL_SQL + f""", adv AS (
SELECT *, concat_ws('; ', CASE WHEN vento_med >= 6 THEN 'Eólica' END,
    CASE WHEN precip_mm >= 200 AND lower(regiao) IN ('africa', 'asia') THEN 'Hidrelétrica / Pequenas Centrais Hidrelétricas (PCH)' END,
    CASE WHEN precip_mm < 100 AND temp_c >= 22 THEN 'Solar fotovoltaica' END) AS rec FROM panel ORDER BY mes_ano, regiao LIMIT 200)
SELECT mes_ano, regiao, {rs('consumo temp_c precip_mm vento_med', 4)}, CASE WHEN rec = '' THEN 'Solar fotovoltaica (padrão)' ELSE rec END AS recomendacao FROM adv""")
def recommend_sink(spark, folder):
    """The first rows of the panel with consumption and advice, written with decimal commas and read back."""
    advice = recommend(F.col("regiao"), F.col("precip_mm"), F.col("temp_c"), F.col("vento_med"), WET_REGIONS)
    numbers = ["consumo", "temp_c", "precip_mm", "vento_med"]
    rows = p.panel(spark, folder).select("mes_ano", "regiao", *numbers, advice.alias("recomendacao"))
    path = ptbr_csv.write_ptbr_csv(top_rows(rows, ["mes_ano", "regiao"], SAMPLE_ROWS), scratch_path(spark, "recommend"))
    return rounded(ptbr_csv.read_ptbr_csv(spark, path, numbers, rows.columns), 4)


# Station files: one station per state, named after it.

def uf_months(spark: SparkSession, folder: str) -> DataFrame:
    return p.weather_by_region(p.located_station_months(spark, folder), by=("mes_ano", "uf"))


def _shown(c: str) -> Column:
    return F.coalesce(format_ptbr(F.col(c)), F.lit(stations.MISSING))


def station_file_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the station files; the stations of one region have no rain-day column."""
    months = uf_months(spark, folder).join(p.uf_region(spark, folder).select("uf", "regiao"), "uf")
    day = F.last_day(F.to_date(F.concat("mes_ano", F.lit("-01"))))
    short = F.col("regiao") == "ASIA"
    cells = [_shown(c) for c in MEASURES]
    row = F.concat_ws(";", day, F.when(~short, cells[0]), *cells[1:])
    data = months.select(F.col("uf").alias("codigo"), day.cast("string").alias("line_no"), F.concat(row, F.lit(";")).alias("line"))

    names = list(stations.MEASURES)
    full = ";".join([stations.DATE_HEADER, *names]) + ";"
    less = ";".join([stations.DATE_HEADER, *names[1:]]) + ";"
    spans = months.groupBy("uf", "regiao").agg(F.min(day).alias("first"), F.max(day).alias("last"))
    values = [
        F.concat(F.lit("ESTACAO "), "regiao"), F.col("uf"), F.lit("-14.46944443"), F.lit("-48.48583333"), F.lit("663.53"),
        F.lit("Operante"), F.col("first").cast("string"), F.col("last").cast("string"), F.lit("Mensal"),
    ]
    top = [F.concat(F.lit(f"{key}: "), value) for key, value in zip(stations.METADATA, values)]
    top += [F.lit(""), F.when(short, less).otherwise(full)]
    head = spans.select(F.col("uf").alias("codigo"), F.posexplode(F.array(*top)).alias("at", "line"))
    return head.select("codigo", F.format_string("%02d", "at").alias("line_no"), "line").unionByName(data)


def station_file_cells(spark: SparkSession, folder: str) -> DataFrame:
    path = stations.write_station_files(station_file_lines(spark, folder), scratch_path(spark, "stations"))
    return stations.station_lines(spark, path)


STATION_FILE_SQL = PANEL_SQL + """, ufm AS (
  SELECT mes_ano, lst.uf, any_value(regiao) AS regiao, coalesce(CAST(sum(CAST(dias_chuva AS DECIMAL(28,9))) AS DOUBLE), 0) AS dias_chuva,
    coalesce(CAST(sum(CAST(precip_mm AS DECIMAL(28,9))) AS DOUBLE), 0) AS precip_mm,
    """ + ", ".join(f"CAST(sum(CAST({c} AS DECIMAL(28,9))) AS DOUBLE) / count({c}) AS {c}" for c in MEASURES[2:]) + """
  FROM lst WHERE lst.uf IS NOT NULL GROUP BY ALL)
"""


@query("station_union", f"""{STATION_FILE_SQL}
SELECT uf AS codigo, mes_ano, last_day(CAST(mes_ano || '-01' AS DATE)) AS data,
  CASE WHEN regiao <> 'ASIA' THEN dias_chuva END AS dias_chuva, {rs('precip_mm pressao_mb temp_c vento_max vento_med', 11)} FROM ufm""")
def station_union(spark, folder):
    return rounded(stations.station_months(stations.station_cells(station_file_cells(spark, folder))), 11)


@query("station_dim", f"""{STATION_FILE_SQL}
SELECT uf AS codigo, 'ESTACAO ' || regiao AS nome, -14.46944443::DOUBLE AS latitude, -48.48583333::DOUBLE AS longitude, 663.53::DOUBLE AS altitude,
  'Operante' AS situacao, last_day(CAST(min(mes_ano) || '-01' AS DATE)) AS data_inicial, last_day(CAST(max(mes_ano) || '-01' AS DATE)) AS data_final,
  'Mensal' AS periodicidade FROM ufm GROUP BY uf, regiao""")
def station_dim(spark, folder):
    return stations.station_dimension(station_file_cells(spark, folder)).drop("file")


@query("station_header", f"""{STATION_FILE_SQL}
SELECT DISTINCT uf AS codigo, CAST(CASE WHEN regiao = 'ASIA' THEN 6 ELSE 7 END AS INTEGER) AS n_columns FROM ufm""")
def station_header(spark, folder):
    cells = stations.station_cells(station_file_cells(spark, folder))
    return cells.select("codigo", F.size("names").alias("n_columns")).distinct()


def _with_surplus(lines: DataFrame) -> DataFrame:
    """Short data lines get one value more than their header names where it blows."""
    wind = F.replace(F.element_at(F.split(F.regexp_replace("line", ";$", ""), ";"), -1), F.lit(","), F.lit("."))
    extra = F.when(wind.try_cast("double") > 4, "9,9;").otherwise(f"{stations.MISSING};")
    short = F.col("line").rlike("^[0-9]{4}-") & (F.size(F.split("line", ";")) == 7)
    return lines.withColumn("line", F.when(short, F.concat("line", extra)).otherwise(F.col("line")))


@query("station_surplus", f"""{STATION_FILE_SQL}
SELECT uf AS codigo, CAST(last_day(CAST(mes_ano || '-01' AS DATE)) AS VARCHAR) AS data, CAST(1 AS INTEGER) AS n_surplus FROM ufm
WHERE regiao = 'ASIA' AND vento_med > 4""")
def station_surplus(spark, folder):
    """Rows that carry one value more than their header names go to quarantine."""
    marked = _with_surplus(station_file_lines(spark, folder))
    path = stations.write_station_files(marked, scratch_path(spark, "stations"))
    surplus = stations.surplus_cells(stations.station_cells(stations.station_lines(spark, path)))
    return surplus.select("codigo", "data", F.size("surplus").alias("n_surplus"))


@query("station_quarantine", f"""{STATION_FILE_SQL}
SELECT uf AS codigo, reason, count(*) AS n FROM (
  SELECT uf, CASE WHEN regiao = 'EUROPE' THEN 'no header' WHEN regiao = 'ASIA' AND vento_med > 4 THEN 'surplus'
    WHEN regiao = 'AMERICA' AND substr(mes_ano, 6) = '02' THEN 'date' END AS reason FROM ufm
  UNION ALL SELECT DISTINCT uf, 'line' FROM ufm WHERE regiao = 'AFRICA') WHERE reason IS NOT NULL GROUP BY 1, 2""")
def station_quarantine(spark, folder):
    """Files without a header, days that don't exist, surplus values and stray lines, counted by station and reason."""
    region = p.uf_region(spark, folder).select(F.col("uf").alias("codigo"), "regiao")
    lines = _with_surplus(station_file_lines(spark, folder)).join(region, "codigo")
    kept = lines.where((F.col("regiao") != "EUROPE") | ~F.col("line").startswith(stations.DATE_HEADER))
    february = (F.col("regiao") == "AMERICA") & F.col("line").rlike("^[0-9]{4}-02-")
    kept = kept.withColumn("line", F.when(february, F.overlay("line", F.lit("31"), F.lit(9), F.lit(2))).otherwise(F.col("line")))
    stray = lines.where("regiao = 'AFRICA' and line_no = '00'").withColumns({"line_no": F.lit("9999"), "line": F.lit("fim do arquivo")})
    path = stations.write_station_files(kept.unionByName(stray).drop("regiao"), scratch_path(spark, "stations"))
    return stations.quarantine(stations.station_lines(spark, path)).groupBy("codigo", "reason").agg(F.count("*").alias("n"))


# Census files: active meters per region and year.

def census_folder(spark: SparkSession, folder: str) -> str:
    """One file per region; one lacks the population column, one the year 1998, one has a gap in it."""
    everyone = p.bills(spark, folder, segment=None).withColumn("ano", F.substring("mes_ano", 1, 4))
    counts = everyone.groupBy("regiao", "ano").agg(F.count_distinct("medidor").alias("populacao"))
    counts = counts.where((F.col("regiao") != "ASIA") | (F.col("ano") != "1998"))
    people = F.when((F.col("regiao") == "AMERICA") & (F.col("ano") == "2001"), "-").otherwise(
        F.replace(F.format_number("populacao", 0), F.lit(","), F.lit(".")))
    rows = counts.select("regiao", "ano", F.concat_ws(";", "ano", people).alias("line"))
    header = F.when(F.col("regiao") == "EUROPE", f"{census.YEAR_HEADER};Domicílios").otherwise(
        f"{census.YEAR_HEADER};{census.POPULATION_HEADER}")
    heads = p.uf_region(spark, folder).select("regiao").distinct().select("regiao", F.lit("").alias("ano"), header.alias("line"))
    name = F.concat(F.lit("Censo 2022 - Crescimento Populacional - "), "regiao", F.lit(".csv"))
    path = scratch_path(spark, "census")
    (
        heads.unionByName(rows).withColumn("nome", name).repartition("nome").sortWithinPartitions("nome", "ano")
        .select("nome", "line").write.partitionBy("nome").text(path)
    )
    return path


CENSUS_SQL = """
WITH c AS (
  SELECT r_name AS regiao, CAST(year(o_orderdate) AS INTEGER) AS ano, count(DISTINCT c_custkey) AS populacao
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE NOT (r_name = 'ASIA' AND year(o_orderdate) = 1998) AND r_name <> 'EUROPE' GROUP BY 1, 2),
k AS (SELECT regiao, ano, CASE WHEN regiao = 'AMERICA' AND ano = 2001 THEN NULL ELSE populacao END AS populacao FROM c)
"""


@query("census_scan", CENSUS_SQL + "SELECT regiao, ano, CAST(populacao AS DOUBLE) AS populacao FROM k")
def census_scan(spark, folder):
    rows = census.census_rows(census.census_lines(spark, census_folder(spark, folder)))
    return rows.select("regiao", "ano", "populacao")


@query("census_region", CENSUS_SQL + """
SELECT regiao, coalesce(max(populacao) FILTER (WHERE ano = 1998), arg_max(populacao, ano) FILTER (WHERE populacao IS NOT NULL)) AS populacao FROM k GROUP BY 1""")
def census_region(spark, folder):
    return census.population_by_region(census.census_rows(census.census_lines(spark, census_folder(spark, folder))), year=1998)


@query("census_skipped", "SELECT 'Censo 2022 - Crescimento Populacional - ' || r_name || '.csv' AS file FROM region WHERE r_name = 'EUROPE'")
def census_skipped(spark, folder):
    return census.skipped_files(census.census_lines(spark, census_folder(spark, folder)))
