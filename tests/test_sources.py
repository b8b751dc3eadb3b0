import datetime

import pytest
from pyspark.sql import functions as F

from voltmes.session import scratch_path
from voltmes.sources import census, ptbr_csv, stations

NAMES = list(stations.MEASURES)
FULL = ";".join([stations.DATE_HEADER, *NAMES]) + ";"
SHORT = ";".join([stations.DATE_HEADER, *NAMES[1:]]) + ";"


def station_file(folder, code, name, header, rows, state="Operante"):
    top = [
        f"Nome: {name}", f"Codigo Estacao: {code}", "Latitude: -14.46944443", "Longitude: -48.48583333", "Altitude: 663.53",
        f"Situacao: {state}", "Data Inicial: 2004-01-01", "Data Final: 2018-06-20", "Periodicidade da Medicao: Mensal", "", header]
    (folder / f"dados_{code}_M_2004-01-01_2018-06-20.csv").write_text("\n".join(top + rows) + "\n", encoding="utf-8")


@pytest.fixture
def station_folder(tmp_path):
    station_file(tmp_path, "A004", "NIQUELANDIA", FULL, [
        "2004-01-31;null;null;null;null;null;null;", "2004-02-29;3;,2;950,1;25,25;6,5;1,5;"], state="Desativada")
    station_file(tmp_path, "A605", "NITEROI", FULL, ["2004-01-31;31;1.295;759,7;35,5;20,3;7,7;"])
    station_file(tmp_path, "A627", "NITEROI", FULL, ["2018-07-31;0;0;1024,8;5,6;0;0;"])
    station_file(tmp_path, "B808", "CACHOEIRINHA", SHORT, [
        "2025-02-28;null;null;null;null;null;null;", "2025-03-31;10,5;1000;20,5;5;1,5;9,9;", "2025-04-30;1;2;3;4;5;"])
    return str(tmp_path)


def test_station_rows_take_their_names_from_their_own_header(spark, station_folder):
    cells = stations.station_cells(stations.station_lines(spark, station_folder))
    months = {(r.codigo, str(r.data)): r for r in stations.station_months(cells).collect()}
    assert len(months) == 7
    row = months["A004", "2004-02-29"]
    assert (row.dias_chuva, row.precip_mm, row.pressao_mb, row.temp_c, row.vento_max, row.vento_med) == (3, 0.2, 950.1, 25.25, 6.5, 1.5)
    assert months["A004", "2004-01-31"].precip_mm is None and row.mes_ano == "2004-02"
    short = months["B808", "2025-03-31"]
    assert (short.dias_chuva, short.precip_mm, short.pressao_mb, short.vento_med) == (None, 10.5, 1000, 1.5)
    assert months["A605", "2004-01-31"].precip_mm == 1295


def test_surplus_values_go_to_quarantine(spark, station_folder):
    cells = stations.station_cells(stations.station_lines(spark, station_folder))
    assert [(r.codigo, r.data, r.surplus) for r in stations.surplus_cells(cells).collect()] == [("B808", "2025-03-31", ["9,9"])]


def test_station_dimension_is_keyed_by_code(spark, station_folder):
    found = {r.codigo: r for r in stations.station_dimension(stations.station_lines(spark, station_folder)).collect()}
    assert sorted(found) == ["A004", "A605", "A627", "B808"]
    assert found["A605"].nome == found["A627"].nome == "NITEROI"
    row = found["A004"]
    assert (row.latitude, row.altitude, row.situacao, row.data_final) == (-14.46944443, 663.53, "Desativada", datetime.date(2018, 6, 20))


def test_station_files_are_read_in_one_scan(spark, station_folder):
    files = stations.station_lines(spark, station_folder)
    for found in (stations.station_months(stations.station_cells(files)), stations.station_dimension(files), stations.quarantine(files)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan and plan.count("FileScan") == 1


def test_what_cannot_be_read_is_counted(spark, tmp_path):
    station_file(tmp_path, "A1", "BELÉM", FULL, ["2004-01-31;1;2;3;4;5;6;", "2004-02-31;1;2;3;4;5;6;", "", "fim", "2004-03-31;1;2;3;4;5;6;7;"])
    station_file(tmp_path, "A2", "X", "", ["2004-01-31;1;2;3;4;5;6;", "2004-02-29;1;2;3;4;5;6;"])
    (tmp_path / "latin.csv").write_bytes(f"Nome: BELÉM\r\nCodigo Estacao: A3\r\n\r\n{FULL}\r\n2004-01-31;1;2;3;4;5;6;\r\n".encode("latin1"))
    (tmp_path / "bom.csv").write_text(f"\ufeffNome: Y\nCodigo Estacao: A4\n\n{FULL}\n2004-01-31;1;2;3;4;5;6;\n", encoding="utf-8")
    (tmp_path / "codeless.csv").write_text(f"{FULL}\n2004-01-31;1;2;3;4;5;6;\n")
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "zeros.csv").write_bytes(b"PK\x00\x01;;")
    (tmp_path / "notes.csv").write_text("some notes\nwithout numbers\n")
    (tmp_path / "bare.csv").write_text(f"Codigo Estacao: A5\n{FULL}\n")
    files = stations.station_lines(spark, str(tmp_path))
    found = sorted((r.file.split("/")[-1].split("_")[1 if "dados" in r.file else 0], r.codigo or "", r.reason, r.line_no or 0, r.line or "") for r in stations.quarantine(files).collect())
    good = "1;2;3;4;5;6;"
    assert found == [
        ("A1", "A1", "date", 13, f"2004-02-31;{good}"), ("A1", "A1", "line", 15, "fim"), ("A1", "A1", "surplus", 16, f"2004-03-31;{good}7;"),
        ("A2", "A2", "no header", 12, f"2004-01-31;{good}"), ("A2", "A2", "no header", 13, f"2004-02-29;{good}"), ("codeless.csv", "", "no code", 2, f"2004-01-31;{good}"),
        ("notes.csv", "", "no header", 1, ""), ("zeros.csv", "", "corrupt", 0, "")]
    months = [(r.codigo, str(r.data)) for r in stations.station_months(stations.station_cells(files)).collect()]
    assert sorted(months) == [("A1", "2004-01-31"), ("A1", "2004-03-31"), ("A1", "None"), ("A3", "2004-01-31"), ("A4", "2004-01-31")]
    names = {r.codigo: r.nome for r in stations.station_dimension(files).collect()}
    assert names == {"A1": "BELÉM", "A2": "X", "A3": "BELÉM", "A4": "Y", "A5": None}


def census_file(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_census(spark, tmp_path):
    head = "Ano da pesquisa;População(pessoas)"
    name = "Censo 2022 - Crescimento Populacional - {}.csv"
    census_file(tmp_path, name.format("Norte"), [head, "2010;15.864.454", "2022;17.354.884", "2021;1"])
    census_file(tmp_path, name.format("Centro-Oeste"), [head, "2010;14.058.094", "1991;9.412.242", "1980;-"])
    census_file(tmp_path, name.format("Sul"), [head, "2010;27.386.891", "2022;-", "2000;5"])
    census_file(tmp_path, name.format("Sudeste"), ["Ano da pesquisa;Domicílios", "2022;84.840.113"])
    census_file(tmp_path, "CENSO-Nordeste.CSV", ["x;População(pessoas);Ano da pesquisa", "0;54.657.621;2022"])
    census_file(tmp_path, "POP2022_Brasil.csv", [head, "2022;1"])
    lines = census.census_lines(spark, str(tmp_path))
    picked = {r.regiao: r.populacao for r in census.population_by_region(census.census_rows(lines)).collect()}
    # 2022 first; without it the last known in file order; a year that is there without a value gives no region.
    assert picked == {"Norte": 17354884, "Centro-Oeste": 9412242, "Nordeste": 54657621}
    assert [r.file for r in census.skipped_files(lines).collect()] == [name.format("Sudeste")]


def test_encodings(spark, tmp_path):
    text = "regiao;estacao\nSul;Verão\n"
    for encoding in ("utf-8", "latin1"):
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes(text.encode(encoding))
        row = ptbr_csv.read_any_encoding(spark, str(path), sep=";").first()
        assert row.estacao == "Verão"
    assert ptbr_csv.read_any_encoding(spark, str(tmp_path / "missing.csv")) is None
    assert ptbr_csv.read_any_encoding(spark, str(tmp_path / "latin1.csv"), "utf-8", ";").first().estacao != "Verão"


def test_first_existing(spark, tmp_path):
    (tmp_path / "b").mkdir()
    assert ptbr_csv.first_existing(spark, [str(tmp_path / "a"), str(tmp_path / "b")]) == str(tmp_path / "b")
    with pytest.raises(FileNotFoundError):
        ptbr_csv.first_existing(spark, [str(tmp_path / "a")])


def test_written_csv_puts_the_index_first(spark):
    df = spark.createDataFrame([(1.5, "x"), (None, "y")], "n double, feature string")
    path = ptbr_csv.write_ptbr_csv(df, scratch_path(spark, "written"), index=["feature"])
    raw = spark.read.text(path).where(F.col("value") != "feature;n")
    assert sorted(r.value for r in raw.collect()) == ["x;1,5", "y;"]
    back = ptbr_csv.read_ptbr_csv(spark, path, ["n"])
    assert back.columns == ["feature", "n"] and {(r.feature, r.n) for r in back.collect()} == {("x", 1.5), ("y", None)}


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1)], "a double, b int")
    assert ptbr_csv.without_nan(df).first()[:] == (None, 1)
