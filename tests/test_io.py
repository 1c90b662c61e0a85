import json

import pytest
from pyspark.sql import functions as F

from actlake.operators.extract import extract
from actlake.plans.fixtures import BULLETIN
from actlake.sources import readers, writers
from actlake.streaming import ingest


def acts(spark):
    return extract(spark.createDataFrame([("108-26.pdf", 1, BULLETIN)], "arquivo string, page_no int, text string")).drop("posicao")


def test_envelope_round_trip(spark, tmp_path):
    books = spark.createDataFrame([("108", "10/06/2026", "LX", "108-26.pdf", 1)], "bs_numero string, bs_data string, bs_ano string, arquivo string, paginas int")
    writers.envelope(acts(spark), books, "2026-01-01T00:00:00", str(tmp_path / "e"))
    back, files = readers.envelope(spark, str(tmp_path / "e"))
    assert back.count() == 3 and files.first().bs_ano == "LX" and back.where("numero = '16'").first().funcoes[0].cargo == "Chefe"
    writers.script(acts(spark), books, "x", str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s"), wholetext=True).first().value.startswith("window.DADOS = {")


def test_table_export(spark, tmp_path):
    writers.table_export(acts(spark), str(tmp_path / "c"))
    rows = spark.read.csv(str(tmp_path / "c"), sep=";", header=True, quote='"', escape='"')
    assert len(rows.columns) == 22 and rows.count() == 3 and writers.relations_sheet(acts(spark)).count() == 3


def test_sheet_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('a,b,c,d,e,f,g,h,i,j,k,l,m\nPortaria,7,2024,,,"diz ""x"", y",,,,,"p,q",r,"[{""id"":""1"",""tipoRelacao"":""Revoga"",""atoDestino"":""Portaria nº 1""}]"\n', encoding="utf-8")
    (row,) = readers.sheet(spark, str(path), today="2026-01-01").collect()
    assert (row.numero, row.ementa, row.tags, row.orgaoEmissor, row.dataAssinatura, row.relacoes[0].tipoRelacao) == ("7", 'diz "x", y', ["p", "q"], "Reitoria", "2026-01-01", "Revoga")
    writers.sheet(readers.sheet(spark, str(path), today="2026-01-01"), str(tmp_path / "out"))
    assert readers.sheet(spark, str(tmp_path / "out")).first().ementa == 'diz "x", y'
    (tmp_path / "l.json").write_text(json.dumps([{"id": "z", "tipoAto": "Edital"}]))
    assert readers.sheet(spark, str(tmp_path / "l.json")).first().id == "z"
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        readers.portal_array(spark, str(tmp_path / "bad.json"))


def test_statements(spark):
    rows = spark.createDataFrame([(i, "o'x\ny" if i else None) for i in range(5)], "id int, t string").coalesce(1)
    made = [r.value for r in writers.insert_statements(rows, "atos", ["id"], 2, ["id"]).collect()]
    assert len(made) == 3 and sum(m.count("'o''x y'") for m in made) == 4 and any("NULL" in m for m in made) and all("ON DUPLICATE KEY" in m for m in made)


def test_links_and_pending(spark):
    html = """<a href="//h/x.pdf"><a HREF='/x.pdf'><a href="x.pdf"><a href="http://o/x.pdf"><a href="/x.pdf"><a href="y.doc">"""
    found = readers.links(spark.createDataFrame([(1, html)], "page_id int, html string"), base="https://b/i/", host="https://b")
    assert [r.url for r in found.orderBy("ordem").collect()] == ["https://h/x.pdf", "https://b/x.pdf", "https://b/i/x.pdf", "http://o/x.pdf"]


def test_manifest_and_pending(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"1-26.pdf": "https://h/a b.pdf", "2-26.pdf": "https://h/2.pdf"}))
    manifest = readers.url_manifest(spark, str(tmp_path / "m.json"))
    found = readers.pending(manifest, spark.createDataFrame([("2-26.pdf",)], "arquivo string")).collect()
    assert [(r.arquivo, r.url) for r in found] == [("1-26.pdf", "https://h/a%20b.pdf")]


def test_places_follow_the_order(spark):
    rows = readers.in_order(spark.range(50).repartition(4).selectExpr("id", "-id AS by"), "by").orderBy("_idx").collect()
    assert [r.id for r in rows] == list(range(49, -1, -1))


def test_dump_of_a_year_clears_it_first(spark, tmp_path):
    acts = spark.createDataFrame([("1-26-a", "x"), ("2-26-b", None)], "id string, t string")
    children = spark.createDataFrame([("1-26-a", "7")], "ato_id string, siape string")
    writers.dump({"atos": (acts, ["id"], 100), "ato_siapes": (children, ["ato_id"], 50)}, str(tmp_path / "d"), "26")
    read = lambda part: "\n".join(r.value for r in spark.read.text(str(tmp_path / "d" / part)).collect())
    assert read("atos/0-clear") == "DELETE FROM `atos` WHERE `id` REGEXP '^[0-9]+-26[^0-9]';"
    assert "`ato_id` REGEXP" in read("ato_siapes/0-clear") and "('1-26-a','7')" in read("ato_siapes/1-rows")
    assert "('1-26-a','x')" in read("atos/1-rows") and "('2-26-b',NULL)" in read("atos/1-rows")


def test_tables_by_year_replace_only_their_years(spark, tmp_path):
    path = str(tmp_path / "t")
    load = lambda rows: writers.year_tables(spark.createDataFrame(rows, "id string, v int"), path, F.split_part("id", F.lit("-"), F.lit(2)))
    load([("1-25", 1), ("1-26", 1)])
    load([("2-26", 2)])
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [("1-25", 1), ("2-26", 2)]


def test_page_of_holders_escapes(spark, tmp_path):
    holders = spark.createDataFrame([("B & C", "Chefe", "Ana <x>", "1", None), ("A", "Chefe", "Zé", "2", "2026-01-01")], "unidade string, cargo string, nome string, siape string, desde string")
    writers.holders_page(holders, str(tmp_path / "h"))
    page = [r.value for r in spark.read.text(str(tmp_path / "h")).collect()]
    assert page == ["<tr><td>A</td><td>Chefe</td><td>Zé</td><td>2</td><td>2026-01-01</td></tr>", "<tr><td>B &amp; C</td><td>Chefe</td><td>Ana &lt;x&gt;</td><td>1</td><td></td></tr>"]


def test_fallback_sources(spark, tmp_path):
    assert readers.load_acts(spark, lambda s: readers.portal_array(s, str(tmp_path / "missing"))).count() == 3


def test_stream_upserts_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id": "1", "numero": "1"}\n{"id": "2", "numero": "2"}\n')
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert ingest.current(spark, str(tmp_path / "t")) is None
    run()
    (tmp_path / "in/b.json").write_text('{"id": "2", "numero": "9"}\n')
    run()
    run()
    assert sorted((r.id, r.numero) for r in ingest.current(spark, str(tmp_path / "t")).collect()) == [("1", "1"), ("2", "9")]
