import json
import random

import pytest
from pyspark.sql import functions as F

from actlake.functions import text as T
from actlake.operators import listing, loads, resolve, store
from actlake.operators.paging import PagedList
from actlake.operators.postings import TextIndex
from actlake.sources import schemas as S
from actlake.sources.versions import VersionedStore, VersionTaken

TABLES = ["atos", "ato_corpo", "boletins", "ato_relacoes", "ato_siapes", "ato_funcoes", "ato_tags"]


@pytest.fixture
def tables(spark, tmp_path):
    return VersionedStore(spark, str(tmp_path / "store"))


def record(k, cites=(), **more):
    made = {
        "id": f"1-26-a{k}", "tipoAto": "Portaria", "numero": str(k), "ano": 2026, "dataAssinatura": f"2026-01-{k % 28 + 1:02d}", "orgaoEmissor": "PROEX", "ementa": f"Ato {k}", "arquivo": "1-26.pdf",
        "relacoes": [{"id": str(i), "tipoRelacao": kind, "atoDestino": text} for i, (kind, text) in enumerate(cites)], "tags": ["t"], "siapes": [str(1000000 + k)],
        "pessoas": [{"nome": "Ana", "siape": str(1000000 + k)}], "funcoes": [{"acao": "designar", "cargo": "Chefe", "unidade": "U", "unidade_chave": "u"}], "textoBusca": f"corpo {k}",
    }
    return made | more


def records(spark, rows):
    return spark.read.schema(S.PORTAL).json(spark.createDataFrame([(json.dumps(r),) for r in rows], "v string").rdd.map(lambda r: r.v))


def shown(tables):
    return {name: sorted(map(repr, (r.asDict() for r in tables.read(name).select(sorted(tables.read(name).columns)).collect()))) for name in TABLES}


def whole(acts, relations):
    """Status and links of everything, resolved at once."""
    linked = resolve.linked_relations(relations.drop("ato_destino_id", "externo"), resolve.resolve_citations(acts, relations))
    status = resolve.validity(acts, linked)
    return {r.id: r.status for r in status.collect()}, {r.rel_id: (r.ato_destino_id, r.externo) for r in linked.collect()}


def test_a_load_is_seen_whole_or_not_at_all(spark, tables, monkeypatch):
    first = [record(1), record(2, [("Revoga", "Portaria nº 1")])]
    assert loads.load(tables, records(spark, first), ("f", 0)) == 1
    before = shown(tables)
    second = [record(3, [("Revoga", "Portaria nº 2"), ("Altera", "Portaria MEC nº 1")]), record(2, ementa="Novo")]
    plain, made = VersionedStore.stage, []

    def dies(self, name, frame, partition_by=None):
        if name == "ato_siapes":
            raise OSError("the load is killed between two tables")
        made.append(name)
        return plain(self, name, frame, partition_by)

    monkeypatch.setattr(VersionedStore, "stage", dies)
    with pytest.raises(OSError):
        loads.load(tables, records(spark, second), ("f", 1))
    monkeypatch.undo()
    assert {"ato_relacoes", "atos", "ato_corpo"} <= set(made) and shown(tables) == before and tables.versions() == [1]
    assert loads.load(tables, records(spark, second), ("f", 1)) == 2
    after = shown(tables)
    assert loads.load(tables, records(spark, second), ("f", 1)) == 2 and loads.load(tables, records(spark, first), ("f", 0)) == 2  # batches seen
    loads.load(tables, records(spark, second))
    assert shown(tables) == after and tables.version() == 3  # the same records again change no row
    assert {r.id: (r.status, r.ementa) for r in tables.read("atos").collect()} == {
        "1-26-a1": ("Ativo", "Ato 1"), "1-26-a2": ("Revogado", "Novo"), "1-26-a3": ("Ativo", "Ato 3")}
    assert sorted(map(repr, tables.at(1).read("ato_tags").collect())) == sorted(map(repr, [r for r in tables.read("ato_tags").collect() if r.ato_id != "1-26-a3"]))
    gone = tables.vacuum(keep=1)
    assert gone > 7 and shown(tables) == after and tables.versions() == [3]


def test_two_loads_cannot_take_one_version(spark, tables):
    rows = spark.range(3)
    tables.commit({"t": rows})
    late = tables.at(1)  # has not seen what follows
    tables.commit({"t": spark.range(5)})
    with pytest.raises(VersionTaken):
        late.commit({"t": spark.range(9)})
    assert tables.read("t").count() == 5 and tables.read("u") is None
    tables.commit(appended={"t": rows, "u": rows})
    assert tables.read("t").count() == 8 and tables.parts("t") == 2 and tables.read("t", first=1).count() == 3


def test_streamed_loads_equal_one_load(spark, tables, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps(record(k, [("Altera", f"Portaria nº {k + 1}")])) for k in range(4)))
    loads.stream_loads(tables, str(source), str(tmp_path / "c")).awaitTermination()
    (source / "b.json").write_text("\n".join(json.dumps(r) for r in [record(2, [("Revoga", "Portaria nº 0")]), {"id": None, "numero": "9"}]))
    loads.stream_loads(tables, str(source), str(tmp_path / "c")).awaitTermination()
    assert tables.version() == 2
    once = VersionedStore(spark, str(tmp_path / "once"))
    loads.load(once, records(spark, [record(k, [("Altera", f"Portaria nº {k + 1}")]) for k in (0, 1, 3)] + [record(2, [("Revoga", "Portaria nº 0")])]))
    assert shown(tables) == shown(once)


def test_later_loads_equal_a_full_run(spark, tables):
    rng = random.Random(5)
    kinds, issuers = ["Portaria", "Resolução"], ["", "CUV", "PROEX"]
    acts, relations = {}, {}
    schema = "id string, tipo string, sigla string, numero string, data_ato date, status string"
    for step in range(4):
        ids = [f"a{k}" for k in (range(30) if not step else rng.sample(range(45), 8))]
        new = {i: (i, rng.choice(kinds), rng.choice(issuers), str(rng.randrange(12)), rng.choice([None, "2024-01-01", "2025-01-01", "2026-01-01"]), "Ativo") for i in ids}
        own = {}
        for i in ids:
            for n in range(rng.randrange(4)):
                text = rng.choice([None, "", "Lei 8112", "Portaria MEC nº 3", *(f"{k} {s} nº {z}{rng.randrange(12)}".replace("  ", " ") for k in kinds for s in issuers for z in ("", "0"))])
                own[f"{i}|{step}|{n}"] = (f"{i}|{step}|{n}", i, rng.choice(["Revoga", "Altera", "Cita"]), text)
        relations = {k: v for k, v in relations.items() if v[1] not in new} | own
        acts |= new
        frame = lambda rows: spark.createDataFrame(rows, schema.replace("date", "string")).withColumn("data_ato", F.col("data_ato").cast("date"))
        cited = lambda rows: spark.createDataFrame(rows, "rel_id string, ato_id string, tipo_relacao string, ato_destino_texto string")
        tables.commit((loads.later_load if step else loads.first_load)(tables, frame(list(new.values())), cited(list(own.values()))))
        status, links = whole(frame(list(acts.values())), cited(list(relations.values())))
        assert {r.id: r.status for r in tables.read("atos").collect()} == status
        assert {r.rel_id: (r.ato_destino_id, r.externo) for r in tables.read("ato_relacoes").collect()} == links
    assert set(status.values()) == {"Ativo", "Alterado", "Revogado"}


def test_postings_equal_reading_the_texts(spark, tables):
    rng = random.Random(6)
    words = ["Ação", "acao", "ACOMPANHA", "é", "portaria", "Portarias", "x_1", "12ab", "naïve", "-", "日本語"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(8)))) for k in range(60)] + [(100, None), (101, ""), (None, "portaria"), (102, "portaria " * 30_000)]
    first = spark.createDataFrame(rows, "id long, texto string")
    index = TextIndex(tables)
    index.build(first, [F.col("texto")])
    queries = ["acao", "portaria acomp", "+port* nai", "日本語", "12a x_1", "nada", "Ação AÇÃO açao", " ".join(f"{c}qq" for c in "abcdefgh") + " portaria" * 70]

    def check(now):
        for q in queries:
            wanted = {r.id for r in now.where(T.has_prefixes(F.col("texto"), T.query_tokens(q))).where("id IS NOT NULL").collect()}
            assert {r.id for r in index.search(q).where("id IS NOT NULL").collect()} == wanted, q

    check(first)
    assert index.search("a é") is None
    changed = spark.createDataFrame([(3, "nada"), (100, "acao portaria acompanha"), (7, None), (500, "naïve portarias")], "id long, texto string")
    index.update(changed, [F.col("texto")], batch=("f", 1))
    assert index.update(changed, [F.col("texto")], batch=("f", 1)) == 2
    now = store.upsert(first, changed, ["id"])
    check(now)
    index.update(changed.where("id = 3").withColumn("texto", F.lit("acao")), [F.col("texto")])
    now = store.upsert(now, changed.where("id = 3").withColumn("texto", F.lit("acao")), ["id"])
    check(now)
    index.compact()
    assert tables.parts("postings") == 1
    check(now)
    acts = now.where("id IS NOT NULL").select("id", F.col("id").cast("string").alias("numero"), F.col("texto").alias("ementa"), F.lit("").alias("conteudo_resumido"))
    for q in ("10", "portaria", "é"):
        plain, indexed = (listing.filtered(acts, listing.ListParams(busca=q), now, now, now, texts=x) for x in (None, index))
        assert sorted(r.id for r in plain.collect()) == sorted(r.id for r in indexed.collect())


def test_a_prefix_reads_its_range(spark, tables):
    index = TextIndex(tables)
    index.build(spark.range(2000).selectExpr("id", "concat('w', id % 500, ' comum') AS t"), [F.col("t")])
    plan = index.search("w12")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "StringStartsWith(token,w12)" in plan


def test_pages_equal_slices_of_the_sorted_list(spark, tables):
    rng = random.Random(7)
    rows = [(k, rng.choice([None, "b", "B", "á", "a", "z z", "Z"])) for k in range(300)]
    frame = spark.createDataFrame(rows, "_idx long, nome string")
    key = {None: 0, "a": 1, "á": 2, "b": 3, "B": 4, "Z": 5, "z z": 6}
    for up in (True, False):
        wanted = [k for k, n in sorted(rows, key=lambda r: (key[r[1]] if up else -key[r[1]], r[0]))]
        pages = PagedList(tables, listing.sheet_order(frame, "nome", up))
        pages.build(frame, ranges=8)
        assert pages.total() == 300
        for number, size in ((1, 7), (20, 7), (43, 7), (44, 7), (2, 200), (3, 150), (1, 1000)):
            assert [r._idx for r in pages.page(number, size).collect()] == wanted[(number - 1) * size : number * size]
        assert [r._idx for r in pages.places().orderBy("lugar").collect()] == wanted
        assert all(len(pages.ranges_of(i * 5, 5)[0]) <= 2 for i in range(60))
    pages.build(frame.limit(0))
    assert pages.total() == 0 and pages.page(1, 5).count() == 0


def test_a_larger_load_makes_more_ranges_of_postings(spark, tables, monkeypatch):
    monkeypatch.setattr("actlake.operators.postings.RANGE_CHARS", 4000, raising=False)
    monkeypatch.setattr("actlake.operators.postings.RANGE_ROWS", 400, raising=False)
    index, rows = TextIndex(tables), spark.range(2000).selectExpr("id", "concat('w', id % 500, ' comum') AS t")
    index.build(rows, [F.col("t")])
    assert len(tables.read("postings").inputFiles()) > 4
    index.update(rows.where("id < 3"), [F.lit("outro")])
    index.compact()
    now = tables.read("postings")
    assert len(now.inputFiles()) > 4 and now.count() == 2 * 1997 + 3
