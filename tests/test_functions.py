import datetime
import math

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from voltmes.functions import numbers as nb
from voltmes.functions.advice import DEFAULT, HYDRO, SOLAR, WIND, recommend
from voltmes.functions.dates import first_day, month_of, season_of, year_of
from voltmes.operators.describe import auto_numeric, column_kinds, columns_with


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_ptbr_parse(spark):
    cases = {
        "320237,3": 320237.3, "35513319,999999996": 35513319.999999996, "1.234.567,8": 1234567.8, ",2": 0.2, "5": 5.0,
        "abc": None, "": None, "1d": None, "1f": None, "null": None, "NaN": None, "-3,5": -3.5, " 7 ": 7.0, None: None,
        "1e3": 1000.0, "1,2,3": None,
    }
    got = one(spark, [(k,) for k in cases], "t string", nb.parse_ptbr(F.col("t")))
    assert [g[0] for g in got] == list(cases.values())


def test_strict_parse_removes_blanks_and_absurd_numbers(spark):
    rows = [("1 234,5",), ("1 0",), ("9999999999999",), ("1000000000000",), ("x",)]
    got = one(spark, rows, "t string", nb.parse_ptbr_strict(F.col("t")))
    assert [g[0] for g in got] == [1234.5, 10.0, None, 1e12, None]


def test_numeric_column_is_not_cleaned_twice(spark):
    df = spark.createDataFrame([(320237.3, "320237,3")], "n double, t string")
    assert df.select(nb.ptbr_column(df, "n"), nb.ptbr_column(df, "t")).first()[:] == (320237.3, 320237.3)


def test_suspicious_text(spark):
    rows = [("1.234,5",), ("12a",), ("é",), ("1234567890123",), ("123456789012",), (None,), ("",)]
    got = one(spark, rows, "t string", nb.is_suspicious(F.col("t")))
    assert [g[0] for g in got] == [False, True, True, True, False, False, False]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, min_value=-1e18, max_value=1e18), min_size=20, max_size=40))
def test_written_number_reads_back(spark, numbers):
    numbers = [n for n in numbers if n == 0 or abs(n) > 1e-18]
    got = one(spark, [(n,) for n in numbers] or [(0.0,)], "n double", "n", nb.parse_ptbr(nb.format_ptbr(F.col("n"))))
    assert all(a == b for a, b in got)


def test_written_form(spark):
    rows = [(1e-4,), (-1.25e-7,), (1e20,), (-1.5e22,), (12345678.9,), (1e7,), (0.0,), (0.001,)]
    got = one(spark, rows, "n double", nb.format_ptbr(F.col("n")))
    assert [g[0] for g in got] == [
        "0,0001", "-0,000000125", "1" + "0" * 20 + ",0", "-15" + "0" * 21 + ",0", "12345678,9", "10000000,0", "0,0", "0,001"]
    rows = [(1104.0,), (35513319.999999996,), (1.5e9,), (math.nan,), (None,)]
    got = one(spark, rows, "n double", nb.format_ptbr(F.col("n")))
    assert [g[0] for g in got] == ["1104,0", "35513319,99999999", "1500000000,0", None, None] or got[1][0].startswith("35513319,99")


def test_dates_and_seasons(spark):
    rows = [("2004-01",), ("2004-13",), ("abc",), (None,)]
    got = one(spark, rows, "t string", year_of(F.col("t")), month_of(F.col("t")), first_day(F.col("t")))
    assert got == [(2004, 1, datetime.date(2004, 1, 1)), (2004, 13, None), (None, None, None), (None, None, None)]
    got = one(spark, [(m,) for m in range(1, 13)], "m int", season_of(F.col("m")))
    assert [g[0] for g in got] == ["Verão"] * 2 + ["Outono"] * 3 + ["Inverno"] * 3 + ["Primavera"] * 3 + ["Verão"]


def test_recommendation(spark):
    nan = math.nan
    rows = [
        ("Norte", 200.0, 25.0, 6.0, f"{WIND}; {HYDRO}"), ("Sul", 250.0, 25.0, 1.0, DEFAULT), ("Sul", 99.0, 22.0, 1.0, SOLAR),
        ("Sul", 99.0, 22.0, 7.0, f"{WIND}; {SOLAR}"), ("Sul", 99.0, nan, nan, DEFAULT), ("NORDESTE", nan, 30.0, None, DEFAULT),
        (None, 300.0, 10.0, 0.0, DEFAULT), ("nordeste", 200.0, 10.0, 0.0, HYDRO), ("Sul", None, 30.0, 0.0, DEFAULT),
    ]
    got = one(spark, [r[:4] for r in rows], "r string, p double, t double, v double", recommend(*map(F.col, "rptv")))
    assert [g[0] for g in got] == [r[4] for r in rows]


def test_column_selection(spark):
    df = spark.createDataFrame([("2004-01", "Sul", "1,5", "x", 3)], "mes string, regiao string, temp_a string, vento string, ano int")
    assert columns_with(df, ["temp", "vento"]) == ["temp_a", "vento"]
    assert column_kinds(df) == {"numeric": [], "categorical": ["regiao", "temp_a", "vento"]}
    numeric = auto_numeric(df)
    assert numeric.schema["temp_a"].dataType.simpleString() == "double"
    assert numeric.schema["vento"].dataType.simpleString() == "string"


def test_fine_amounts_add_up(spark):
    bills = spark.range(1000).selectExpr("'2020-01' AS mes_ano", "'SUL' AS regiao", "0.004D AS consumo")
    from voltmes.operators.joins import consumption_by_region

    assert [r.consumo for r in consumption_by_region(bills, by=("mes_ano", "regiao"), value="consumo").collect()] == [4.0]


def test_an_outlier_does_not_coarsen_the_bins(spark):
    from voltmes.operators.histogram import automatic_bins

    rows = spark.range(2000).selectExpr("id / 1000D AS x").unionAll(spark.sql("SELECT 1e6D AS x"))
    assert automatic_bins(rows, "x") > 10_000


def test_binned_densities_equal_the_direct_sums(spark):
    from voltmes.operators.histogram import densities, histogram, histograms

    rng = np.random.default_rng(3)
    columns = {
        "even": rng.uniform(-5, 5, 1500), "ties": rng.integers(0, 4, 1500).astype(float), "large": 1e7 + 1e6 * rng.standard_normal(1500),
        "apart": np.where(np.arange(1500) < 1499, rng.standard_normal(1500), 1e3), "one": np.full(1500, 2.0)}
    rows = spark.createDataFrame(pd.DataFrame(columns)).unionByName(spark.createDataFrame([(None,) * 5], ", ".join(f"{c} double" for c in columns)))
    found = {}
    for r in densities(rows, list(columns)).collect():
        found.setdefault(r.feature, {})[r.point] = (r.x, r.density)
    assert sorted(found) == ["apart", "even", "large", "ties"]
    for name, points in found.items():
        values = columns[name]
        h = values.std(ddof=1) * len(values) ** -0.2
        assert sorted(points) == list(range(200))
        for i, x in enumerate(np.linspace(values.min(), values.max(), 200)):
            direct = np.exp(-((x - values) / h) ** 2 / 2).sum() / (len(values) * h * np.sqrt(2 * np.pi))
            assert abs(points[i][0] - x) <= 1e-9 * max(1, abs(x)) and abs(points[i][1] - direct) * h <= 1e-9
    assert densities(rows.where("false"), ["even"]).count() == 0
    assert histograms(rows.where("false"), ["even"]).count() == 0
    several = sorted(tuple(r)[1:] for r in histograms(rows, ["even", "large", "one"]).where("feature = 'large'").collect())
    assert several == sorted(map(tuple, histogram(rows, "large").collect()))
