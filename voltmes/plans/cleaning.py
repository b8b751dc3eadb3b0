"""Number text, filters on it, and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voltmes.functions import numbers as nb
from voltmes.operators import outliers
from voltmes.operators.describe import auto_numeric
from voltmes.plans import panel as p
from voltmes.plans.panel import PANEL_SQL
from voltmes.plans.registry import query, r, rounded
from voltmes.session import stored


def ptbr_text(number: Column) -> Column:
    """Two-digit amount as Brazilian text with thousands points."""
    return F.translate(F.format_number(number, 2), ",.", ".,")


def raw_amounts(spark, folder) -> DataFrame:
    """Order amounts as raw text with the faults of a hand-kept file.

    Thousands points, a letter, a lost unit digit, blanks, an absurd magnitude, or nothing at all.
    """
    orders = p.table(spark, folder, "orders")
    text = ptbr_text(F.col("o_totalprice"))
    kind = F.col("o_orderpriority")
    broken = (
        F.when(kind == "1-URGENT", F.concat(text, F.lit(" ")))
        .when(kind == "2-HIGH", F.concat(F.lit("R"), text))
        .when(kind == "3-MEDIUM", F.concat(F.lit("9999999"), F.replace(text, F.lit("."), F.lit(""))))
        .when(kind == "4-NOT SPECIFIED", F.regexp_replace(text, r"^[0-9.]+", ""))
        .otherwise(text)
    )
    raw = F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(broken)
    return orders.select(F.col("o_orderkey").alias("conta"), raw.alias("texto"))


RAW_SQL = """
WITH fmt AS (
  SELECT o_orderkey AS conta, o_orderstatus, o_orderpriority,
    translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS t FROM orders),
raw AS (
  SELECT conta, CASE WHEN o_orderstatus = 'P' THEN NULL
    WHEN o_orderpriority = '1-URGENT' THEN t || ' '
    WHEN o_orderpriority = '2-HIGH' THEN 'R' || t
    WHEN o_orderpriority = '3-MEDIUM' THEN '9999999' || replace(t, '.', '')
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN regexp_replace(t, '^[0-9.]+', '')
    ELSE t END AS texto FROM fmt),
parsed AS (
  SELECT conta, texto, TRY_CAST(replace(replace(texto, '.', ''), ',', '.') AS DOUBLE) AS loose FROM raw),
audited AS (
  SELECT *, CASE WHEN abs(loose) <= 1e12 THEN loose END AS strict,
    coalesce(regexp_matches(texto, '[[:alpha:]]') OR length(regexp_replace(texto, '[^0-9]', '', 'g')) > 12, false) AS weird FROM parsed)
"""


def audited(spark, folder) -> DataFrame:
    text = F.col("texto")
    return raw_amounts(spark, folder).withColumns({
        "loose": nb.parse_ptbr(text), "strict": nb.parse_ptbr_strict(text), "weird": nb.is_suspicious(text)})


@query("ptbr_parse", f"{RAW_SQL} SELECT conta, texto, {r('loose', 2, 'valor')} FROM audited")
def ptbr_parse(spark, folder):
    parsed = nb.ptbr_column(raw_amounts(spark, folder), "texto")
    return rounded(raw_amounts(spark, folder).select("conta", "texto", parsed.alias("valor")), 2)


@query("ptbr_parse_strict", f"{RAW_SQL} SELECT conta, {r('strict', 2, 'valor')} FROM audited")
def ptbr_parse_strict(spark, folder):
    return rounded(audited(spark, folder).select("conta", F.col("strict").alias("valor")), 2)


@query("ptbr_numeric_kept", "SELECT o_orderkey AS conta, o_totalprice AS valor FROM orders")
def ptbr_numeric_kept(spark, folder):
    """A column that is numeric already is not cleaned a second time."""
    orders = p.table(spark, folder, "orders")
    return orders.select(F.col("o_orderkey").alias("conta"), nb.ptbr_column(orders, "o_totalprice").alias("valor"))


@query("coerce", """
SELECT o_orderkey AS conta, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS prioridade,
  TRY_CAST(split_part(o_orderpriority, '-', 2) AS DOUBLE) AS nome FROM orders""")
def coerce(spark, folder):
    part = F.split("o_orderpriority", "-")
    return p.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("conta"), nb.to_number(part[0]).alias("prioridade"), nb.to_number(part[1]).alias("nome"))


@query("weird_text", f"{RAW_SQL} SELECT conta, weird FROM audited")
def weird_text(spark, folder):
    return audited(spark, folder).select("conta", "weird")


@query("guard_magnitude", f"{RAW_SQL} SELECT conta, {r('CASE WHEN abs(loose) <= 1e12 THEN loose END', 2, 'valor')} FROM audited")
def guard_magnitude(spark, folder):
    return rounded(audited(spark, folder).select("conta", nb.guard_magnitude(F.col("loose")).alias("valor")), 2)


@query("cleaner_diff", f"{RAW_SQL} SELECT conta, texto FROM audited WHERE loose IS NOT NULL AND strict IS NULL")
def cleaner_diff(spark, folder):
    return audited(spark, folder).where(F.col("loose").isNotNull() & F.col("strict").isNull()).select("conta", "texto")


@query("clean_counts", f"""{RAW_SQL}
SELECT count(*) FILTER (WHERE weird) AS n_weird, count(*) FILTER (WHERE loose IS NULL) AS n_unparsed,
  count(*) FILTER (WHERE abs(loose) > 1e12) AS n_too_large, count(loose) AS kept_loose, count(strict) AS kept_strict,
  count(loose) - count(strict) AS n_dropped FROM audited""")
def clean_counts(spark, folder):
    return outliers.parse_audit(audited(spark, folder), "texto", "loose", "strict")


@query("drop_bad_target", f"{RAW_SQL} SELECT conta, {r('strict', 2, 'valor')} FROM audited WHERE strict IS NOT NULL")
def drop_bad_target(spark, folder):
    kept = audited(spark, folder).where(F.col("strict").isNotNull())
    return rounded(kept.select("conta", F.col("strict").alias("valor")), 2)


@query("auto_numeric", """
SELECT o_orderkey AS conta, o_orderstatus AS situacao, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS prioridade,
  o_totalprice AS valor FROM orders""")
def to_numeric(spark, folder):
    """Every text column with a number in it becomes numeric; the status letters stay text."""
    texts = p.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("conta"), F.col("o_orderstatus").alias("situacao"),
        F.split("o_orderpriority", "-")[0].alias("prioridade"), ptbr_text(F.col("o_totalprice")).alias("valor"))
    return auto_numeric(texts)


CLIP_SQL = """
bounds AS (SELECT quantile_cont(o_totalprice, 0.005) AS lo, quantile_cont(o_totalprice, 0.995) AS hi FROM orders {where})
SELECT o_orderkey AS conta, """ + r("CASE WHEN o_totalprice < lo THEN lo WHEN o_totalprice > hi THEN hi ELSE o_totalprice END", 4, "valor") + """
FROM orders, bounds"""


def _amounts(spark, folder) -> DataFrame:
    orders = p.table(spark, folder, "orders")
    return orders.select(F.col("o_orderkey").alias("conta"), F.col("o_totalprice").alias("consumo"), "o_orderdate")


@query("winsorize", "WITH " + CLIP_SQL.format(where=""))
def winsorize(spark, folder):
    """Bounds from all rows: there is no test period here."""
    rows = _amounts(spark, folder)
    return rounded(outliers.winsorize(rows, "consumo", "valor", train=rows).select("conta", "valor"), 4)


@query("winsorize_train", "WITH " + CLIP_SQL.format(where="WHERE o_orderdate < DATE '2000-01-01'"))
def winsorize_train(spark, folder):
    """Bounds from the rows before the test period, so that nothing leaks from it."""
    rows = _amounts(spark, folder)
    train = rows.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("date"))
    return rounded(outliers.winsorize(rows, "consumo", "valor", train=train).select("conta", "valor"), 4)


@query("fill_median", f"""{PANEL_SQL}
SELECT mes_ano, regiao, {r('coalesce(pressao_mb, (SELECT quantile_cont(pressao_mb, 0.5) FROM panel))', 6, 'pressao_mb')} FROM panel""")
def fill_median(spark, folder):
    panel = p.panel(spark, folder)
    return rounded(outliers.fill_median(panel, ["pressao_mb"]).select("mes_ano", "regiao", "pressao_mb"))


@query("fill_median_stations", f"""{PANEL_SQL}
SELECT codigo, mes_ano, {r('coalesce(pressao_mb, (SELECT quantile_cont(pressao_mb, 0.5) FROM st))', 9, 'pressao_mb')} FROM st""")
def fill_median_stations(spark, folder):
    filled = outliers.fill_median(stored(p.station_months(spark, folder)), ["pressao_mb"])
    return rounded(filled.select("codigo", "mes_ano", "pressao_mb"), 9)
