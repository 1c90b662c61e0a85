import pytest
from pyspark.sql import functions as F

from actlake.operators import convert, extract, listing, resolve, store
from actlake.plans import queries as Q
from actlake.plans.fixtures import ACTS, BULLETIN, RELATIONS, ROLES

OUTCOMES = {
    "r1": "ambiguo", "r2": "a2", "r3": "a4", "r4": "ambiguo", "r5": "a5", "r6": "a6", "r7": "a6", "r8": "nao_encontrado", "r9": "a7", "r10": "nao_encontrado",
    "r11": "externo", "r12": "a8", "r13": "a1", "r14": "sem_parse", "r15": "nao_encontrado", "r16": "nao_encontrado",
}


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_citations_resolve_and_status_follows(spark):
    acts, relations = spark.sql(ACTS), spark.sql(RELATIONS)
    found = resolve.resolve_citations(acts, relations)
    assert {r.rel_id: r.ato_destino_id or r.desfecho for r in found.collect()} == OUTCOMES
    linked = resolve.linked_relations(relations, found)
    status = resolve.validity(acts, linked)
    marks = dict(rows(status, "id", "status"))
    assert [k for k, v in marks.items() if v == "Revogado"] == ["a1", "a4", "a6", "a7"] and [k for k, v in marks.items() if v == "Alterado"] == ["a2", "a5", "a8"]
    again = resolve.linked_relations(linked, resolve.resolve_citations(acts, linked))
    assert rows(again, *sorted(again.columns)) == rows(linked, *sorted(linked.columns))  # idempotent
    assert rows(resolve.resolve_citations(acts, relations, self_links=False).where("rel_id = 'r13'"), "desfecho") == [("nao_encontrado",)]


def test_batch_rules_differ_where_documented(spark):
    acts = spark.sql(ACTS).select("id", F.col("tipo").alias("tipoAto"), F.col("sigla").alias("orgaoEmissor"), "numero", F.col("data_ato").cast("string").alias("dataAssinatura"))
    relations = spark.sql(RELATIONS).select("rel_id", F.col("ato_id").alias("id"), "tipo_relacao", F.col("ato_destino_texto").alias("destino"))
    found = rows(convert.match_in_batch(acts, relations), "rel_id", "alvo")
    assert ("r6", "a6") not in found  # an abbreviation is never linked here
    assert ("r13", "a1") not in found and ("r8", "a7") in found  # no self-links; digits alone count


def test_holders(spark):
    roles = spark.sql(ROLES).withColumn("nome", F.lit(""))
    acts = roles.select(F.col("ato_id").alias("id"), F.col("data").cast("date").alias("data_ato"))
    people = spark.createDataFrame([("b2", "222222", "Ana")], "ato_id string, siape string, nome string")
    now = listing.current_holders(roles.drop("data"), acts, people)
    assert rows(now, "unidade", "siape") == [("Curso D", "444444"), ("Departamento A", "222222"), ("Setor E", "666666")]
    assert rows(now.where("siape = '222222'"), "nome") == [("Ana",)]
    static = listing.current_holders_static(roles.drop("data"), acts)
    assert rows(static, "unidade", "siape") == [("Curso C", "444444"), ("Curso D", "444444"), ("Setor E", "666666")]


def test_page_limits():
    p = lambda **k: listing.ListParams(**k)
    assert (p(por_pagina=0).size, p(por_pagina="999").size, p(por_pagina="abc").size, p().size) == (1, 200, 1, 50)
    assert (p(pagina=0).number, p(pagina="3x").number) == (1, 3) and p(ordenar="drop").sort == "data_ato" and not p(dir="up").ascending


def portal(spark):
    pages = spark.createDataFrame([("108-26.pdf", 1, BULLETIN), ("109-26.pdf", 1, None)], "arquivo string, page_no int, text string")
    acts = extract.extract(pages).withColumn("_idx", F.col("posicao"))
    return convert.portal_records(acts, extract.bulletins(pages))


def test_bulletin_to_tables(spark):
    records = portal(spark).cache()
    acts = store.acts_table(records)
    assert rows(acts, "id") == [("108-26-determina-o-de-servi-o-ges-16-2025",), ("108-26-portaria-ato-1004-2026",), ("108-26-portaria-proplan-17-2025",)]
    assert rows(store.registrations_table(records), "siape", "nome") == [("1642620", "Maria da Silva Frühauf"), ("2364493", "João Sant'Anna")]
    assert store.relations_table(records).count() == 3 and store.roles_table(records).count() == 2 and store.tags_table(records).count() > 3
    assert rows(store.bulletins_table(records), "id", "numero", "ano") == [(2026108, 108, 2026)]
    bodies = store.bodies_table(records)
    assert store.missing_registrations(bodies, store.registrations_table(records)).count() == 0
    assert rows(store.missing_registrations(bodies, store.registrations_table(records).limit(0)), "siape") == [("1642620",), ("2364493",)]
    relations = store.relations_table(records).withColumn("ato_destino_id", F.lit(None).cast("string"))
    page = listing.list_page(acts, listing.ListParams(nome="fruhauf", busca="1"), bodies, store.registrations_table(records), relations)
    assert [r.numero for r in page.collect()] == ["16"]
    found = listing.require(listing.card("108-26-portaria-ato-1004-2026", acts, store.registrations_table(records), relations, store.tags_table(records)))
    assert len(found["relacoes"]) == 2 and found["pessoas"] is None
    with pytest.raises(KeyError):
        listing.require(listing.card("no", acts, store.registrations_table(records), relations, store.tags_table(records)))
    with pytest.raises(ValueError):
        listing.card("", acts, relations, relations, relations)


def test_loading_twice_changes_nothing(spark):
    old = spark.createDataFrame([("1-26-a", 1), ("2-25-b", 2)], "id string, v int")
    new = spark.createDataFrame([("1-26-a", 9), ("3-26-c", 3)], "id string, v int")
    once = store.upsert(old, new, ["id"])
    assert rows(once, "id", "v") == rows(store.upsert(once, new, ["id"]), "id", "v") == [("1-26-a", 9), ("2-25-b", 2), ("3-26-c", 3)]
    year = store.overwrite_year(once, new.where("v = 3"))
    assert rows(year, "id", "v") == rows(store.overwrite_year(year, new.where("v = 3")), "id", "v") == [("2-25-b", 2), ("3-26-c", 3)]


def test_keys_dodge_natural_suffixes(spark):
    acts = spark.createDataFrame([(0, "x.pdf", "P", "", "1", "2"), (1, "x.pdf", "P", "", "1", "2"), (2, "x.pdf", "P", "", "1", "2-2")], "_idx int, arquivo string, tipo string, sigla string, numero string, ano string")
    ids = [r.id for r in convert.stable_keys(acts).orderBy("_idx").collect()]
    assert ids[0] == "x-p-ato-1-2" and ids[2] == "x-p-ato-1-2-2" and len(set(ids)) == 3


def test_keys_are_numbered_alike_in_any_slices(spark):
    acts = spark.sql("SELECT id * 3 AS _idx, 'x.pdf' AS arquivo, 'P' AS tipo, '' AS sigla, CAST(id % 2 AS STRING) AS numero, '26' AS ano FROM range(40)").repartition(5)
    ids = [[r.id for r in convert.stable_keys(acts, slice_size=n).orderBy("_idx").collect()] for n in (7, convert.SLICE)]
    assert ids[0] == ids[1] == [f"x-p-ato-{k % 2}-26" + (f"-{k // 2 + 1}" if k > 1 else "") for k in range(40)]


def test_static_and_sheet_searches_differ(spark):
    schema = "_idx int, numero string, ementa string, processoSei string, orgaoEmissor string, conteudoResumido string, tags array<string>, textoBusca string, siapes array<string>"
    r = spark.createDataFrame([(0, "1", "Altera", None, "PROEX", "x", ["verde"], "corpo 123456", ["7"])], schema)
    find = lambda sheet, **k: listing.static_filtered(r, listing.ListParams(**k), sheet).count()
    assert (find(False, busca="verde"), find(True, busca="VERDE")) == (0, 1)
    assert find(False, siape="123-456") == 1 and find(False, nome="proex") == 1


def test_import_keeps_the_first_of_each_key(spark):
    old = spark.createDataFrame([("Portaria", "1", 2026, 0)], "tipoAto string, numero string, ano int, ordem int")
    new = spark.createDataFrame([("Portaria", "2", 2026, 2), ("Portaria", "2", 2026, 1), ("Portaria", "1", 2026, 0), (None, "2", 2026, 4), (None, "2", 2026, 3)], old.schema)
    assert sorted(r.ordem for r in store.import_new(old, new).collect()) == [1, 3]


def test_citing_acts_may_not_count_themselves(spark):
    acts = spark.sql("SELECT * FROM VALUES ('a1', 'Portaria', 'X', '10', DATE'2020-01-01'), ('a2', 'Portaria', 'Y', '10', DATE'2019-01-01'), ('a3', 'Portaria', 'Y', '10', DATE'2021-01-01') AS t(id, tipo, sigla, numero, data_ato)")
    cited = [("r1", "a1", "Portaria nº 10"), ("r2", "a1", "Portaria X nº 10"), ("r3", "a2", "Portaria nº 10"), ("r4", "a3", "Portaria Y nº 10")]
    relations = spark.createDataFrame(cited, "rel_id string, ato_id string, ato_destino_texto string")
    found = {self_links: {r.rel_id: (r.desfecho, r.ato_destino_id) for r in resolve.resolve_citations(acts, relations, self_links).collect()} for self_links in (True, False)}
    assert found[True] == {"r1": ("ambiguo", None), "r2": ("ok", "a1"), "r3": ("ok", "a2"), "r4": ("ambiguo", None)}
    assert found[False] == {"r1": ("ok", "a2"), "r2": ("ok", "a2"), "r3": ("nao_encontrado", None), "r4": ("ok", "a2")}


def test_bulletins_are_cut_into_segments_once(spark):
    found = Q.queries()["bulletin_records"](spark, "/root/testdata/sf0.001")
    assert not [f for f in found.inputFiles() if "orders" in f]


def test_elements_of_an_array_do_not_make_it_again(spark):
    given = spark.createDataFrame([(1, "b a"), (2, ""), (3, None)], "id int, t string")
    made = given.select("id", F.when(F.col("t") != "", F.transform(F.split("t", " "), lambda w: F.struct(F.nullif(w, F.lit("a")).alias("w")))).alias("x"))
    found = convert.elements(made, "x", "id")
    assert rows(found.select("id", "_at", "_one.*"), "id", "_at", "w") == [(1, 0, "b"), (1, 1, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "Generate" in plan
    for query in ("bulletin_citations", "bulletin_people", "bulletin_roles"):
        plan = Q.queries()[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter ((size(" not in plan and "size(transform(" not in plan


def test_relations_are_answered_in_place_each_by_itself(spark):
    relations = spark.createDataFrame([("x", "a1", "Portaria nº 26"), ("x", "a1", "Portaria nº 26"), ("y", "zz", "Portaria nº 26"), ("z", "a1", None), ("w", "a1", "Portaria MEC nº 77")], "rel_id string, ato_id string, ato_destino_texto string")
    found = resolve.answered(spark.sql(ACTS), relations)
    assert sorted(map(str, (tuple(r) for r in found.select("rel_id", "desfecho", "ato_destino_id", "alvo_tipo", "alvo_numeros").collect()))) == sorted(map(str, [
        *[("x", "ok", "a2", "Portaria", ["26"])] * 2, ("y", None, None, None, None), ("z", None, None, None, None), ("w", "externo", None, None, None)]))


def test_what_a_query_of_bulletins_does_not_show_is_not_read(spark):
    found = Q._bulletin_records(spark, "/root/testdata/sf0.001", "data_ato")
    assert found.select("id", "dataAssinatura", "linkBoletim").count() == found.select("id").distinct().count() > 0
    assert not {"relacoes", "funcoes", "trecho"} & set(spark.read.parquet(*{f.rsplit("/", 1)[0] for f in found.inputFiles()}).columns)
    with pytest.raises(Exception, match="relacoes was not read"):
        found.select("relacoes").collect()
