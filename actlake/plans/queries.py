"""Queries by name with the SQL that states each result; see the README for what each one covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlake.functions import text as T
from actlake.functions import vocabulary as V
from actlake.operators import convert, extract, listing, loads, resolve, store
from actlake.operators.paging import PagedList
from actlake.operators.postings import TextIndex
from actlake.plans.fixtures import (
    ACTS, BULLETIN, EVENT_ROLES, ITEM_RELATIONS, ORDER_ACTS, ORDER_PARTS, PARTS_AS_PAGES, RELATIONS, ROLES, SCALARS, duck, of_tables, sql, table,
)
from actlake.sources import readers, writers
from actlake.sources.versions import VersionedStore, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}
_CASES: dict[str, tuple[Query, str | None]] = {}
P = listing.ListParams


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _FOUND[f.__name__] = (f, oracle)
        return f

    return keep


def stated(result: str | None = None) -> Callable[[Query], Query]:
    """For a case over a few invented rows: no registered query, but a test holds it against the SQL."""

    def keep(f: Query) -> Query:
        _CASES[f.__name__] = (f, result)
        return f

    return keep


def cases() -> dict[str, tuple[Query, str | None]]:
    return dict(_CASES)


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: o for k, (_, o) in _FOUND.items() if o}


def _acts(spark: SparkSession, d: str) -> DataFrame:
    return of_tables(spark, d, ORDER_ACTS, "orders")


def _relations(spark: SparkSession, d: str) -> DataFrame:
    return of_tables(spark, d, ITEM_RELATIONS, "lineitem")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return of_tables(spark, d, EVENT_ROLES, "events")


_TABLES = f"acts AS ({duck(ORDER_ACTS)}), relations AS ({duck(ITEM_RELATIONS)})"
_FOLD = "strip_accents(lower({}))"


def _texts(c: str) -> str:
    return f"regexp_split_to_array({_FOLD.format(c)}, '[^\\p{{L}}\\p{{N}}_]+')"


# --- lists ----------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_TABLES}, page AS (SELECT * FROM acts WHERE status = 'Revogado' ORDER BY data_ato DESC NULLS LAST, id LIMIT 50 OFFSET 50)
SELECT id, tipo, numero, CAST(CAST(data_ato AS DATE) AS VARCHAR) AS data_ato, status, coalesce((SELECT string_agg(DISTINCT tipo_relacao, ',' ORDER BY tipo_relacao) FROM relations WHERE ato_id = page.id), '') AS rel_tipos,
  (SELECT count(*) FROM relations WHERE ato_destino_id = page.id) AS ref_count FROM page""")
def list_page(spark, d):
    relations = _relations(spark, d)
    page = listing.list_page(_acts(spark, d), P(status="Revogado", pagina=2), relations, relations, relations)
    return page.select("id", "tipo", "numero", F.col("data_ato").cast("string").alias("data_ato"), "status", F.array_join("relTipos", ",").alias("rel_tipos"), F.col("refCount").alias("ref_count"))


@query(f"""WITH {_TABLES} SELECT count(*) AS total, 1 AS pagina, 200 AS por_pagina, CAST(ceil(count(*) / 200.0) AS INTEGER) AS paginas FROM acts
WHERE lower(tipo) = '1-urgent' AND ano = 1996 AND processo_sei IS NOT NULL""")
def page_counts(spark, d):
    p = P(tipo="1-Urgent ", ano="1996", com_sei="1", por_pagina=999, pagina=0)
    none = _relations(spark, d)
    return listing.page_counts(listing.filtered(_acts(spark, d), p, none, none, none), p)


@query(f"""WITH {_TABLES} SELECT id, status, row_number() OVER (ORDER BY CASE status WHEN 'Ativo' THEN 1 WHEN 'Alterado' THEN 2 ELSE 3 END, id) AS n FROM acts
QUALIFY n <= 200""")
def list_sort_status(spark, d):
    page = listing.sorted_page(_acts(spark, d), P(ordenar="status", dir="ASC", por_pagina=200))
    return page.select("id", "status", F.row_number().over(listing.Window.orderBy(listing.status_rank(F.col("status")), "id")).cast("long").alias("n"))


@query(f"WITH {_TABLES} SELECT id, CAST(data_ato AS VARCHAR) AS data_ato FROM acts ORDER BY acts.data_ato NULLS FIRST, id LIMIT 7 OFFSET 14")
def list_sort_date(spark, d):
    return listing.sorted_page(_acts(spark, d), P(ordenar="nada", dir="asc", por_pagina="7", pagina="3")).select("id", F.col("data_ato").cast("string").alias("data_ato"))


@query(f"WITH {_TABLES} SELECT id, CAST(data_ato AS VARCHAR) AS data_ato, row_number() OVER (ORDER BY acts.data_ato DESC NULLS LAST, id) - 14600 AS n FROM acts ORDER BY acts.data_ato DESC NULLS LAST, id LIMIT 50 OFFSET 14600")
def deep_page(spark, d):
    pages = PagedList(VersionedStore(spark, shared_folder(spark)), [F.col("data_ato").desc_nulls_last(), F.asc("id")])
    pages.build(_acts(spark, d).select("id", "data_ato"), ranges=64)
    page = pages.page(293, 50)
    return page.select("id", F.col("data_ato").cast("string").alias("data_ato"), F.row_number().over(listing.Window.orderBy(*pages.order)).cast("long").alias("n"))


#: Names with capitals, accents and missing values; the comparing engine sorts by letters, then accents, then small before capital.
_SHEET = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, 'e', 'é') ELSE p_name END AS ementa FROM part"""
_SHEET_KEYS = "strip_accents(lower(ementa)) {0}, lower(ementa) {0}, (ementa = upper(ementa)) {0}, id"


def _sheet(spark: SparkSession, d: str, ascending: bool) -> DataFrame:
    rows = of_tables(spark, d, _SHEET, "part")
    pages = PagedList(VersionedStore(spark, shared_folder(spark)), listing.sheet_order(rows, "ementa", ascending, "id"))
    pages.build(rows, ranges=16)
    return pages.places().select("id", "ementa", "lugar")


@query(f"SELECT id, ementa, row_number() OVER (ORDER BY ementa IS NOT NULL, {_SHEET_KEYS.format('ASC')}) AS lugar FROM ({_SHEET}) AS x")
def sheet_sort_up(spark, d):
    return _sheet(spark, d, True)


@query(f"SELECT id, ementa, row_number() OVER (ORDER BY ementa IS NULL, {_SHEET_KEYS.format('DESC')}) AS lugar FROM ({_SHEET}) AS x")
def sheet_sort_down(spark, d):
    return _sheet(spark, d, False)


@query(f"""WITH {_TABLES} SELECT id FROM acts WHERE EXISTS (SELECT 1 FROM relations r WHERE r.ato_id = acts.id AND tipo_relacao = 'Revoga')
OR EXISTS (SELECT 1 FROM relations r WHERE r.ato_destino_id = acts.id AND tipo_relacao = 'Revoga')""")
def list_with_relations(spark, d):
    return listing.with_relations(_acts(spark, d), _relations(spark, d).where("tipo_relacao = 'Revoga'")).select("id")


@query(f"WITH {_TABLES} SELECT ato_id AS id, string_agg(DISTINCT tipo_relacao, ',' ORDER BY tipo_relacao) AS tipos FROM relations GROUP BY ato_id")
def list_relation_kinds(spark, d):
    return listing.relation_kinds(_relations(spark, d)).select("id", F.array_join("relTipos", ",").alias("tipos"))


@query(f"WITH {_TABLES} SELECT ato_destino_id AS id, count(*) AS ref_count FROM relations WHERE ato_destino_id IS NOT NULL GROUP BY 1")
def reference_counts(spark, d):
    return listing.reference_counts(_relations(spark, d)).withColumnRenamed("refCount", "ref_count")


@query(f"""WITH {_TABLES} SELECT count(*) AS total, count(*) FILTER (status = 'Ativo') AS vigentes, count(*) FILTER (status = 'Revogado') AS revogados,
  count(*) FILTER (status = 'Alterado') AS alterados, count(DISTINCT sigla) AS orgaos, count(processo_sei) AS "comSei",
  (SELECT count(*) FROM nation) AS boletins, CAST(round(100.0 * count(*) FILTER (status = 'Ativo') / count(*)) AS INTEGER) AS percentual FROM acts""")
def stats(spark, d):
    found = listing.stats(_acts(spark, d), table(spark, d, "nation"))
    return found.withColumn("percentual", listing.percent(F.col("vigentes"), F.col("total")))


@query(f"""WITH {_TABLES} SELECT count(*) AS total, count(*) FILTER (status = 'Ativo') AS vigentes, count(*) FILTER (status = 'Revogado') AS revogados,
  count(*) FILTER (status = 'Alterado') AS alterados, count(DISTINCT sigla) AS orgaos, count(processo_sei) AS "comSei", count(DISTINCT numero) AS boletins FROM acts""")
def stats_static(spark, d):
    rows = _acts(spark, d).select("status", F.col("sigla").alias("orgaoEmissor"), F.col("processo_sei").alias("processoSei"), F.col("numero").alias("arquivo"))
    return listing.static_stats(rows)


@query(f"""WITH {_TABLES}, v AS (SELECT DISTINCT 'tipos' AS lista, tipo AS valor, NULL AS ano FROM acts UNION SELECT 'orgaos', sigla, NULL FROM acts WHERE sigla <> ''
  UNION SELECT 'anos', CAST(ano AS VARCHAR), ano FROM acts WHERE ano IS NOT NULL)
SELECT lista, valor, row_number() OVER (PARTITION BY lista ORDER BY -ano, valor) AS ordem FROM v""")
def facets(spark, d):
    return listing.facets(_acts(spark, d))


@query(f"WITH {_TABLES} SELECT ano AS valor, count(*) AS n FROM acts GROUP BY ano")
def histogram(spark, d):
    return listing.histogram(_acts(spark, d), "ano")


# --- searches -------------------------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id FROM documents WHERE strip_accents(lower(source)) LIKE '%and +thon*%' OR
(len(list_filter({_texts('text')}, lambda w: starts_with(w, 'and'))) > 0 AND len(list_filter({_texts('text')}, lambda w: starts_with(w, 'thon'))) > 0)""")
def search_boolean_prefix(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(listing.search([F.col("source")], [F.col("text")], "and +thon*")).select("doc_id")


def _document_index(spark: SparkSession, d: str) -> TextIndex:
    """Postings of all documents in three loads: two parts of them, of which one comes with other texts first and is loaded anew."""
    docs, text = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), [F.col("text")]
    index = TextIndex(VersionedStore(spark, shared_folder(spark)))
    first = docs.where("id % 3 != 0").withColumn("text", F.when(F.col("id") % 3 == 1, F.concat("text", F.lit(" andante thonante queauante"))).otherwise(F.col("text")))
    index.build(first, text)
    index.update(docs.where("id % 3 = 0"), text)
    index.update(docs.where("id % 3 = 1"), text)
    return index


@query(f"""SELECT doc_id FROM documents WHERE strip_accents(lower(source)) LIKE '%and +thon*%' OR
(len(list_filter({_texts('text')}, lambda w: starts_with(w, 'and'))) > 0 AND len(list_filter({_texts('text')}, lambda w: starts_with(w, 'thon'))) > 0)""")
def search_by_postings(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    return listing.indexed_search(docs, [F.col("source")], "and +thon*", _document_index(spark, d)).select(F.col("id").alias("doc_id"))


@query(f"SELECT doc_id AS id FROM documents WHERE len(list_filter({_texts('text')}, lambda w: starts_with(w, 'queau'))) > 0")
def name_by_postings(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return listing.filtered(docs, P(nome="Quéau"), docs, docs, docs, names=_document_index(spark, d))


@query(f"SELECT t.token, count(*) AS documentos FROM (SELECT doc_id, unnest(list_distinct({_texts('text')})) AS token FROM documents) AS t WHERE token <> '' GROUP BY 1")
def posting_counts(spark, d):
    index = _document_index(spark, d)
    index.compact()
    return index.store.read("postings").groupBy("token").agg(F.count(F.lit(1)).alias("documentos"))


@query("SELECT p_partkey FROM part WHERE lower(p_brand) LIKE '%b_a%1%'")
def search_like(spark, d):
    return table(spark, d, "part").where(listing.search([F.col("p_brand")], [F.col("p_name")], "b_a%1") & listing.like(F.col("p_brand"), "b_a%1")).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE contains(lower('7  ' || text || '  ' || coalesce(source, '')), 'thon the')")
def search_static(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit("7").alias("numero"), F.col("text").alias("ementa"), F.lit(None).cast("string").alias("processoSei"), F.col("source").alias("conteudoResumido"))
    return listing.static_filtered(docs, P(busca="THON the")).select("doc_id")


@query(f"SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM documents WHERE len(list_filter({_texts('text')}, lambda w: starts_with(w, 'queau'))) > 0)")
def name_semi(spark, d):
    docs = table(spark, d, "documents")
    acts, bodies = docs.select(F.col("doc_id").alias("id")), docs.select(F.col("doc_id").alias("ato_id"), F.col("text").alias("texto"))
    return listing.filtered(acts, P(nome="Quéau"), bodies, bodies, bodies)


@query(f"WITH {_TABLES} SELECT id FROM acts WHERE id IN (SELECT l_orderkey FROM lineitem WHERE contains(CAST(l_suppkey AS VARCHAR), '9'))")
def id_contains_semi(spark, d):
    registrations = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ato_id"), F.col("l_suppkey").cast("string").alias("siape"))
    return listing.filtered(_acts(spark, d), P(siape="n. 9"), registrations, registrations, registrations).select("id")


@query("SELECT doc_id FROM documents WHERE strip_accents(lower(split_part(text, ' ', 1))) = 'la'")
def facet_accent_insensitive(spark, d):
    return table(spark, d, "documents").where(listing.same_text(F.get(F.split("text", " "), F.lit(0)), "LÁ  ")).select("doc_id")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_brand || ' nº ' || CAST(p_size AS VARCHAR) || '/' || CAST(p_partkey AS VARCHAR)), '#1') OR contains(lower(p_name), '#1') OR contains(lower(p_type), '#1') ORDER BY p_partkey LIMIT 80")
def sidebar_search(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("tipoAto"), F.col("p_size").alias("numero"), F.col("p_partkey").alias("ano"), F.col("p_name").alias("ementa"), F.col("p_type").alias("orgaoEmissor"), F.col("p_partkey").alias("_idx"))
    return listing.sidebar_search(rows, "#1").select("p_partkey")


# --- holders --------------------------------------------------------------------------------------------------------------------

_HOLDERS = """, last AS (SELECT *, rank() OVER (PARTITION BY unidade_chave, cargo ORDER BY data_ato DESC) AS r FROM roles WHERE data_ato IS NOT NULL),
posts AS (SELECT * FROM last WHERE r = 1 AND acao = 'designar' QUALIFY row_number() OVER (PARTITION BY unidade_chave, lower(cargo) ORDER BY unidade, cargo, ato_id DESC, siape) = 1),
people AS (SELECT * FROM posts QUALIFY row_number() OVER (PARTITION BY siape ORDER BY data_ato DESC, unidade, cargo, ato_id) = 1)
SELECT cargo, unidade, siape, CAST(data_ato AS VARCHAR) AS desde, ato_id FROM people"""
_STATIC_HOLDERS = """, last AS (SELECT * FROM roles WHERE data_ato IS NOT NULL QUALIFY row_number() OVER (PARTITION BY unidade_chave, lower(cargo) ORDER BY data_ato DESC, ato_id DESC) = 1)
SELECT cargo, unidade, siape, CAST(data_ato AS VARCHAR) AS desde, ato_id FROM last WHERE acao = 'designar'"""
_FIXED_ROLES = f"WITH roles AS (SELECT ato_id, CAST(data AS DATE) AS data_ato, acao, cargo, unidade, unidade_chave, siape FROM ({ROLES}) AS x)"
_SHOWN = ["cargo", "unidade", "siape", "CAST(desde AS STRING) AS desde", "ato_id"]


def _holders(roles: DataFrame, static: bool) -> DataFrame:
    acts = roles.select(F.col("ato_id").alias("id"), "data_ato").distinct()
    if static:
        return listing.current_holders_static(roles.drop("data_ato"), acts).selectExpr(*_SHOWN)
    return listing.current_holders(roles.drop("data_ato"), acts, roles.select("ato_id", "siape", "nome")).selectExpr(*_SHOWN)


def _fixed_roles(spark: SparkSession) -> DataFrame:
    return sql(spark, ROLES).withColumns({"data_ato": F.col("data").cast("date"), "nome": F.lit(None).cast("string")}).drop("data")


@query(f"WITH roles AS ({duck(EVENT_ROLES)}){_HOLDERS}")
def current_holders(spark, d):
    return _holders(_events(spark, d), False)


@query(f"WITH roles AS ({duck(EVENT_ROLES)}){_STATIC_HOLDERS}")
def current_holders_static(spark, d):
    return _holders(_events(spark, d), True)


@stated(_FIXED_ROLES + _HOLDERS)
def current_holders_fixture(spark, d):
    return _holders(_fixed_roles(spark), False)


@stated(_FIXED_ROLES + _STATIC_HOLDERS)
def current_holders_static_fixture(spark, d):
    return _holders(_fixed_roles(spark), True)


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def latest_per_person(spark, d):
    return listing.latest_per_person(table(spark, d, "events"), "user_id", "ts", ["event_id"]).select("user_id", "event_id")


@stated(f"{_FIXED_ROLES}{_HOLDERS} WHERE contains(lower(cargo), 'chefe') AND contains(lower(unidade || ' ' || cargo || ' ' || siape), '222')")
def holder_search(spark, d):
    return listing.holder_search(_holders(_fixed_roles(spark), False).withColumn("nome", F.lit("")), "Chefe", " 222 ").drop("nome")


@stated(f"SELECT DISTINCT cargo AS familia FROM ({ROLES}) AS x")
def office_families(spark, d):
    return listing.office_families(_fixed_roles(spark))


# --- citations and validity -----------------------------------------------------------------------------------------------------

_KIND = " ".join(f"WHEN starts_with(p, '{w}') THEN '{k}'" for w, k in V.CITED_KINDS.items())
_LENGTH = " ".join(f"WHEN starts_with(p, '{w}') THEN {len(w)}" for w in V.CITED_KINDS)
_RESOLVED = f"""WITH acts AS ({ACTS}), relations AS ({RELATIONS}),
parsed AS (SELECT rel_id, ato_id, tipo_relacao, regexp_matches(ato_destino_texto, '(?i)\\b({V.EXTERNAL})\\b') AS ext,
  regexp_matches(ato_destino_texto, '^(.+?)\\s+n[ºo°]\\s*(.+)$') AS ok, lower(trim(regexp_extract(ato_destino_texto, '^(.+?)\\s+n[ºo°]\\s*(.+)$', 1))) AS p,
  trim(regexp_extract(ato_destino_texto, '^(.+?)\\s+n[ºo°]\\s*(.+)$', 2)) AS numero FROM relations),
cited AS (SELECT *, CASE {_KIND} END AS kind, replace(upper(trim(substr(p, (CASE {_LENGTH} END) + 1), ' /.,')), '/UFF', '') AS sig, replace(numero, '.', '') AS nd FROM parsed),
variants AS (SELECT DISTINCT rel_id, c.ato_id, kind, sig, unnest([numero, nd, CASE WHEN ltrim(nd, '0') = '' THEN nd ELSE ltrim(nd, '0') END]) AS n FROM cited c WHERE ok AND NOT ext AND kind IS NOT NULL),
cand AS (SELECT DISTINCT v.rel_id, a.id, v.sig <> '' AND replace(upper(a.sigla), '/UFF', '') = v.sig AS same FROM variants v JOIN acts o ON o.id = v.ato_id
  JOIN acts a ON a.tipo = v.kind AND a.numero = v.n WHERE o.data_ato IS NULL OR a.data_ato IS NULL OR a.data_ato <= o.data_ato),
best AS (SELECT rel_id, count(*) AS n, max(id) AS sole, count(*) FILTER (same) AS ns, max(id) FILTER (same) AS one FROM cand GROUP BY rel_id),
resolved AS (SELECT c.rel_id, c.ato_id, c.tipo_relacao, CASE WHEN ext THEN 'externo' WHEN NOT ok OR kind IS NULL THEN 'sem_parse' WHEN n IS NULL THEN 'nao_encontrado'
  WHEN n = 1 OR ns = 1 THEN 'ok' ELSE 'ambiguo' END AS desfecho, CASE WHEN n = 1 THEN sole WHEN ns = 1 THEN one END AS ato_destino_id FROM cited c LEFT JOIN best b ON b.rel_id = c.rel_id)"""
_VALIDITY = """, found AS (SELECT r.ato_destino_id AS id, count(*) FILTER (r.tipo_relacao = 'Revoga') AS n FROM {relations} r JOIN acts o ON o.id = r.ato_id JOIN acts a ON a.id = r.ato_destino_id
  WHERE r.tipo_relacao IN ('Revoga', 'Altera') AND (o.data_ato IS NULL OR a.data_ato IS NULL OR o.data_ato >= a.data_ato) GROUP BY 1)
SELECT acts.id, CASE WHEN n > 0 THEN 'Revogado' WHEN n = 0 THEN 'Alterado' ELSE 'Ativo' END AS status FROM acts LEFT JOIN found ON found.id = acts.id"""


def _resolved(spark: SparkSession) -> DataFrame:
    return resolve.resolve_citations(sql(spark, ACTS), sql(spark, RELATIONS))


@stated(f"{_RESOLVED} SELECT rel_id, desfecho, ato_destino_id FROM resolved")
def resolve_citations(spark, d):
    return _resolved(spark)


@stated(f"{_RESOLVED} SELECT desfecho, count(*) AS n FROM resolved GROUP BY 1")
def resolve_outcomes(spark, d):
    return resolve.outcome_counts(_resolved(spark))


@stated(_RESOLVED + _VALIDITY.format(relations="resolved"))
def validity_fixture(spark, d):
    return resolve.validity(sql(spark, ACTS), resolve.linked_relations(sql(spark, RELATIONS), _resolved(spark)))


@query("""SELECT CASE WHEN n = 1 OR ns = 1 THEN 'ok' ELSE 'ambiguo' END AS desfecho, count(*) AS n FROM (
  SELECT l_partkey, l_suppkey, count(*) AS n, count(*) FILTER (p_brand = 'Brand#' || CAST(l_suppkey % 5 + 1 AS VARCHAR) || '1') AS ns
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) AS l JOIN part ON p_partkey % 500 = l_partkey % 500 GROUP BY 1, 2) AS x GROUP BY 1""")
def resolve_parts(spark, d):
    acts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("Portaria").alias("tipo"), F.col("p_brand").alias("sigla"), (F.col("p_partkey") % 500).cast("string").alias("numero"), F.lit(None).cast("date").alias("data_ato"))
    cited = F.concat(F.lit("Portaria Brand#"), (F.col("l_suppkey") % 5 + 1).cast("string"), F.lit("1 nº "), (F.col("l_partkey") % 500).cast("string"))
    pairs = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    relations = pairs.select((F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("rel_id"), F.col("l_partkey").alias("ato_id"), cited.alias("ato_destino_texto"))
    return resolve.outcome_counts(resolve.resolve_citations(acts, relations))


#: Parts as dated acts and line items as their citations, which kinds, issuers and numbers make resolvable, ambiguous, external or unreadable.
_PART_ACTS = """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'Portaria' WHEN 1 THEN 'Resolução' ELSE 'Decisão' END AS tipo, upper(p_type) AS sigla,
  CAST(p_partkey % 500 AS {text}) AS numero, CASE WHEN p_partkey % 7 > 0 THEN CAST(date '2000-01-01' + CAST(p_partkey * 37 % 900 AS INT) AS DATE) END AS data_ato, 'Ativo' AS status FROM part"""
_PART_CITATIONS = """SELECT DISTINCT l_partkey * 1000000 + l_suppkey AS rel_id, l_partkey AS ato_id, CASE l_suppkey % 3 WHEN 0 THEN 'Revoga' WHEN 1 THEN 'Altera' ELSE 'Cita' END AS tipo_relacao,
  CASE l_suppkey % 11 WHEN 0 THEN 'Portaria MEC nº 7' WHEN 1 THEN 'Lei 8112' ELSE CASE l_suppkey % 3 WHEN 0 THEN 'Portaria' WHEN 1 THEN 'Resolução' ELSE 'Decisão' END
  || CASE WHEN l_partkey % 2 = 0 THEN ' SMALL' ELSE '' END || ' nº 0' || CAST((l_partkey * 31 + l_suppkey * 17) % 500 AS {text}) END AS ato_destino_texto FROM lineitem"""
_PARTS_RESOLVED = _RESOLVED.replace(f"acts AS ({ACTS})", f"acts AS ({duck(_PART_ACTS)})").replace(f"relations AS ({RELATIONS})", f"relations AS ({duck(_PART_CITATIONS)})")


def _parts_in_loads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    acts, cited = of_tables(spark, d, _PART_ACTS, "part"), of_tables(spark, d, _PART_CITATIONS, "lineitem")
    return loads.resolved_in_loads(spark, acts, cited, "CASE WHEN id % 10 < 7 THEN 0 WHEN id % 10 < 9 THEN 1 ELSE 2 END", 3)


@query(f"{_PARTS_RESOLVED} SELECT rel_id, ato_id, tipo_relacao, desfecho = 'externo' AS externo, ato_destino_id FROM resolved")
def links_after_loads(spark, d):
    return _parts_in_loads(spark, d)[1].select("rel_id", "ato_id", "tipo_relacao", "externo", "ato_destino_id")


@query(_PARTS_RESOLVED + _VALIDITY.format(relations="resolved"))
def validity_after_loads(spark, d):
    return _parts_in_loads(spark, d)[0].select("id", "status")


@query(f"WITH {_TABLES}" + _VALIDITY.format(relations="relations"))
def validity_status(spark, d):
    return resolve.validity(_acts(spark, d), _relations(spark, d))


@query(f"""WITH {_TABLES}, e AS (SELECT ato_destino_id AS id, count(*) FILTER (tipo_relacao = 'Revoga') AS r, count(*) FILTER (tipo_relacao = 'Altera') AS n,
  arg_min(ato_id, rel_id) FILTER (tipo_relacao = 'Revoga') AS por FROM relations WHERE ato_destino_id IS NOT NULL GROUP BY 1)
SELECT acts.id, CASE WHEN r > 0 THEN 'revogado' WHEN n > 0 THEN 'alterado' WHEN status = 'Revogado' THEN 'revogado' ELSE 'vigente' END AS veredito,
  CASE WHEN r > 0 THEN por END AS causa, coalesce(n, 0) AS n_altera FROM acts LEFT JOIN e ON e.id = acts.id""")
def verdict(spark, d):
    return resolve.verdict(_acts(spark, d), _relations(spark, d).where("ato_destino_id IS NOT NULL").withColumn("ordem", F.col("rel_id")))


@query(f"""WITH {_TABLES}, t AS (SELECT ato_id, tipo_relacao, arg_min(ato_destino_id, rel_id * 1000000 + ato_destino_id) AS a, arg_max(ato_destino_id, rel_id * 1000000 + ato_destino_id) AS z FROM relations WHERE ato_destino_id IS NOT NULL GROUP BY 1, 2)
SELECT r.rel_id, t.a AS primeiro, t.z AS ultimo FROM relations r LEFT JOIN t ON t.ato_id = r.ato_id AND t.tipo_relacao = r.tipo_relacao""")
def first_last_link(spark, d):
    relations = _relations(spark, d)
    links = relations.where("ato_destino_id IS NOT NULL").select("ato_id", "tipo_relacao", F.col("ato_destino_id").alias("alvo"), (F.col("rel_id") * 1_000_000 + F.col("ato_destino_id")).alias("ordem"))
    plain = relations.select("rel_id", "ato_id", "tipo_relacao")
    first = resolve.first_link(plain, links).withColumnRenamed("ato_destino_id", "primeiro")
    return resolve.first_link(first, links, last=True).select("rel_id", "primeiro", F.col("ato_destino_id").alias("ultimo"))


_BATCH_KIND = " ".join(f"WHEN contains(lower(ato_destino_texto), '{w}') THEN '{k}'" for k, w in V.BATCH_WORDS.items())
_BATCH = f"""WITH acts AS ({ACTS}), cited AS (SELECT rel_id, ato_id, tipo_relacao, lower(ato_destino_texto) AS low, CASE {_BATCH_KIND} END AS kind,
  unnest(list_distinct(list_transform(regexp_extract_all(ato_destino_texto, '\\d[\\d.]*'), lambda x: regexp_replace(x, '\\D', '', 'g')))) AS nd FROM ({RELATIONS}) AS x),
links AS (SELECT DISTINCT c.rel_id, c.ato_id AS id, c.tipo_relacao, a.id AS alvo FROM cited c JOIN acts o ON o.id = c.ato_id
  JOIN acts a ON a.tipo = c.kind AND regexp_replace(a.numero, '\\D', '', 'g') = c.nd
  WHERE length(c.nd) >= 2 AND a.id <> c.ato_id AND coalesce(CAST(o.data_ato AS VARCHAR), '') >= coalesce(CAST(a.data_ato AS VARCHAR), '')
  AND CASE WHEN a.sigla IN ('Reitoria', 'UFF', '') THEN length(c.nd) >= 3 ELSE contains(c.low, lower(a.sigla)) END)"""


def _batch(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    acts = sql(spark, ACTS).select("id", F.col("tipo").alias("tipoAto"), F.col("sigla").alias("orgaoEmissor"), "numero", F.coalesce(F.col("data_ato").cast("string"), F.lit("")).alias("dataAssinatura"), F.lit(2026).alias("ano"), F.substring("id", 2, 2).cast("int").alias("_idx"))
    relations = sql(spark, RELATIONS).select("rel_id", F.col("ato_id").alias("id"), "tipo_relacao", F.col("ato_destino_texto").alias("destino"))
    return acts, convert.match_in_batch(acts, relations)


@stated(f"{_BATCH} SELECT rel_id, id, tipo_relacao, alvo FROM links")
def match_in_batch(spark, d):
    return _batch(spark)[1]


@stated(f"""{_BATCH} SELECT acts.id, CASE WHEN max(CASE WHEN tipo_relacao = 'Revoga' THEN 2 WHEN tipo_relacao = 'Altera' THEN 1 ELSE 0 END) = 2 THEN 'Revogado'
WHEN max(CASE WHEN tipo_relacao = 'Altera' THEN 1 ELSE 0 END) = 1 THEN 'Alterado' ELSE 'Ativo' END AS status FROM acts LEFT JOIN links ON links.alvo = acts.id GROUP BY acts.id""")
def batch_status(spark, d):
    acts, links = _batch(spark)
    return convert.batch_status(acts, links)


@stated(f"""{_BATCH} SELECT DISTINCT alvo, tipo_relacao AS relacao, links.id AS "porId", a.tipo || ' ' || a.sigla || ' nº ' || a.numero || '/2026' AS "porLabel" FROM links JOIN acts a ON a.id = links.id""")
def reverse_index(spark, d):
    acts, links = _batch(spark)
    return convert.reverse_index(links, acts)


_FIT = f"""WITH acts AS (SELECT *, row_number() OVER (ORDER BY id) AS ordem FROM ({ACTS}) AS y), asked AS (SELECT DISTINCT ato_destino_texto AS texto FROM ({RELATIONS}) AS x),
n AS (SELECT texto, unnest(list_distinct(list_transform(regexp_extract_all(texto, '\\d[\\d.]*'), lambda x: regexp_replace(x, '\\D', '', 'g')))) AS nd FROM asked)
SELECT texto, arg_min(id, ordem) AS id FROM n JOIN acts ON regexp_replace(numero, '\\D', '', 'g') = nd
WHERE (sigla NOT IN ('', 'Reitoria') AND contains(lower(texto), regexp_split_to_array(lower(sigla), '[ /]')[1])) OR (contains(lower(texto), split_part(lower(tipo), ' ', 1)) AND length(nd) >= 3) GROUP BY texto"""


@stated(_FIT)
def first_fit(spark, d):
    acts = sql(spark, ACTS).select("id", F.col("tipo").alias("tipoAto"), F.col("sigla").alias("orgaoEmissor"), "numero", F.col("id").alias("ordem"))
    return resolve.first_fit(sql(spark, RELATIONS).select(F.col("ato_destino_texto").alias("texto")), acts)


# --- derivations ----------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', ' ', 'g')) AS limpo FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("limpo"))


@query("SELECT doc_id, strip_accents(lower(text)) AS dobrado FROM documents")
def fold_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("dobrado"))


@query("SELECT p_partkey, CASE WHEN s = '' THEN 'ato' ELSE s END AS chave FROM (SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part) AS x")
def slug(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slug(F.concat("p_name", F.lit(" "), "p_brand")).alias("chave"))


_MONTH = " ".join(f"WHEN '{k}' THEN '{v:02d}'" for k, v in V.MONTHS.items())
_DATE = "'(?i)^\\s*(\\d{1,2})\\s+de\\s+(\\p{L}+)\\s+de\\s+(\\d{4})\\s*$'"


@stated(f"""SELECT data, coalesce(regexp_extract(data, {_DATE}, 3) || '-' || (CASE lower(regexp_extract(data, {_DATE}, 2)) {_MONTH} END) || '-' || lpad(regexp_extract(data, {_DATE}, 1), 2, '0'), '') AS iso FROM ({SCALARS}) AS x""")
def long_date(spark, d):
    return sql(spark, SCALARS).select("data", T.long_date_of(F.col("data")).alias("iso"))


@stated(f"""SELECT processo, CASE WHEN length(n) >= 17 THEN substr(n, 1, 5) || '.' || substr(n, 6, 6) || '/' || substr(n, 12, 4) || '-' || substr(n, 16, 2) ELSE trim(processo) END AS numero
FROM (SELECT processo, regexp_replace(processo, '\\D', '', 'g') AS n FROM ({SCALARS}) AS x) AS y""")
def process_number(spark, d):
    return sql(spark, SCALARS).select("processo", T.process_number(F.col("processo")).alias("numero"))


@stated(f"""SELECT arquivo, TRY_CAST(nullif(regexp_extract(arquivo, '(\\d+)-(\\d{{4}}|\\d{{2}})', 1), '') AS INTEGER) AS numero,
CASE length(y) WHEN 4 THEN CAST(y AS INTEGER) WHEN 2 THEN 2000 + CAST(y AS INTEGER) ELSE 0 END AS ano FROM (SELECT arquivo, regexp_extract(arquivo, '(\\d+)-(\\d{{4}}|\\d{{2}})', 2) AS y FROM ({SCALARS}) AS x) AS z""")
def file_name_year(spark, d):
    return sql(spark, SCALARS).select("arquivo", T.file_number_year(F.col("arquivo")).alias("f")).select("arquivo", "f.*")


@stated("SELECT * FROM (VALUES ('DAP/UFF', 'DAP'), ('CONJUNTA PROPLAN/DCF', 'PROPLAN/DCF'), ('- DAP/UFF', 'DAP'), ('DO FFE / ISNF', 'FFE/ISNF')) AS t(orgao, sigla)")
def issuer_code(spark, d):
    return sql(spark, SCALARS).select("orgao", T.issuer_code(F.col("orgao")).alias("sigla"))


@query("SELECT user_id, string_agg(v, ',' ORDER BY v) AS ids FROM (SELECT DISTINCT doc_id AS user_id, unnest(regexp_extract_all(text, '\\d{6,7}')) AS v FROM documents) AS x GROUP BY 1")
def id_extract(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("user_id"), T.registrations(F.col("text"), r"(\d{6,7})").alias("v"))
    return docs.where(F.size("v") > 0).select("user_id", F.array_join("v", ",").alias("ids"))


@query("""WITH known AS (SELECT event_id AS ato_id, CAST(user_id AS VARCHAR) AS siape FROM events WHERE event_id % 3 = 0)
SELECT ato_id, siape FROM (SELECT event_id AS ato_id, CAST(user_id + 100000 AS VARCHAR) AS siape FROM events) AS x WHERE (ato_id, siape) NOT IN (SELECT ato_id, CAST(CAST(siape AS BIGINT) + 100000 AS VARCHAR) FROM known)""")
def repair_missing_ids(spark, d):
    events = table(spark, d, "events")
    number = (F.col("user_id") + 100000).cast("string")
    bodies = events.select(F.col("event_id").alias("ato_id"), F.concat(F.lit("servidor, matrícula SIAPE nº "), number, F.lit(".")).alias("texto"))
    known = events.where("event_id % 3 = 0").select(F.col("event_id").alias("ato_id"), number.alias("siape"))
    return store.missing_registrations(bodies, known)


@query("""SELECT p_partkey, b || CASE WHEN n > 1 THEN '-' || CAST(n AS VARCHAR) ELSE '' END AS id FROM (
  SELECT p_partkey, b, row_number() OVER (PARTITION BY b ORDER BY p_partkey) AS n FROM (
    SELECT p_partkey, '7-26-' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '-ato-' || CAST(p_size AS VARCHAR) || '-2026' AS b FROM part) AS x) AS y""")
def stable_keys(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.lit("7-26.PDF").alias("arquivo"), F.col("p_name").alias("tipo"), F.lit("").alias("sigla"), F.col("p_size").cast("string").alias("numero"), F.lit(2026).alias("ano"), F.col("p_partkey").alias("_idx"))
    return convert.stable_keys(rows).select("p_partkey", "id")


@query("""SELECT p_partkey, array_to_string(list_distinct_ordered, ',') AS marcadores FROM (SELECT p_partkey, [x FOR x, i IN l IF x <> '' AND list_position(l, x) = i][1:6] AS list_distinct_ordered FROM (
  SELECT p_partkey, list_concat(list_concat([p_brand], regexp_split_to_array(p_name, '[/ ]')), ['Outro']) AS l FROM part) AS x) AS y""")
def tags_array(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(T.tags(F.col("p_brand"), F.col("p_name"), F.col("p_type")), ",").alias("marcadores"))


@query("""SELECT l_orderkey, coalesce(string_agg(CAST(l_partkey AS VARCHAR), '; ' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) FILTER (l_returnflag IN ('R')), '') AS revoga,
coalesce(string_agg(CAST(l_partkey AS VARCHAR), '; ' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) FILTER (l_returnflag = 'A'), '') AS altera FROM lineitem GROUP BY 1""")
def relation_pivot(spark, d):
    item = F.struct("l_linenumber", F.expr("CASE l_returnflag WHEN 'R' THEN 'REVOGA' WHEN 'A' THEN 'ALTERA' ELSE 'CITA' END").alias("relacao"), F.col("l_partkey").cast("string").alias("ato_citado"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("r"))
    return rows.select("l_orderkey", *[extract.relation_pivot(F.col("r"), V.RELATION_GROUPS[k]).alias(k) for k in ("revoga", "altera")])


@query("""SELECT p_partkey, CAST(string_agg(v, ',' ORDER BY v) AS VARCHAR) AS variantes FROM (SELECT DISTINCT p_partkey, unnest([n, replace(n, '.', ''), CASE WHEN ltrim(replace(n, '.', ''), '0') = '' THEN replace(n, '.', '') ELSE ltrim(replace(n, '.', ''), '0') END]) AS v
FROM (SELECT p_partkey, '0' || CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey AS VARCHAR) AS n FROM part) AS x) AS y GROUP BY 1""")
def number_variants(spark, d):
    number = F.concat(F.lit("0"), F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(T.number_variants(number)), ",").alias("variantes"))


@query("SELECT doc_id, left(lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', ' ', 'g'))), 7000) AS corpo FROM documents")
def search_body(spark, d):
    return table(spark, d, "documents").select("doc_id", T.search_body(F.col("text")).alias("corpo"))


@query("""SELECT page_id, url, CAST(min(i) - 1 AS INTEGER) AS ordem FROM (SELECT page_id, i, CASE WHEN starts_with(h, '//') THEN 'https:' || h WHEN starts_with(h, '/') THEN 'https://h' || h WHEN starts_with(h, 'http') THEN h ELSE 'https://b/' || h END AS url
FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1)) AS h, generate_subscripts(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1), 1) AS i FROM pages) AS x) AS y GROUP BY 1, 2""")
def href_extract(spark, d):
    return readers.links(table(spark, d, "pages"), base="https://b", host="https://h", suffix="")


@query("SELECT page_id AS arquivo, url FROM pages WHERE page_id % 3 <> 0")
def pending_downloads(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("arquivo"), "url")
    return readers.pending(pages, pages.where("arquivo % 3 = 0"))


# --- loading --------------------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders""")
def upsert(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return store.upsert(orders.where("o_orderkey % 3 != 0"), orders.where("o_orderkey % 2 = 0 OR o_orderkey % 3 = 0").withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END")), ["o_orderkey"])


@query("""SELECT l_orderkey AS ato_id, l_linenumber AS n FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT DISTINCT l_orderkey, 0 FROM lineitem WHERE l_orderkey % 4 = 0""")
def replace_children(spark, d):
    old = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ato_id"), F.col("l_linenumber").alias("n"))
    new = old.where("ato_id % 4 = 0").withColumn("n", F.lit(0))
    return store.replace_children(old, new, new, unique=["ato_id", "n"])


_IDS = "SELECT CAST(o_custkey % 90 AS {text}) || '-' || CAST(year(o_orderdate) AS {text}) || '-' || CAST(o_orderkey AS {text}) AS id, o_totalprice FROM orders"


@query(f"SELECT regexp_extract(id, '^\\d+-(\\d{{4}})', 1) AS sufixo FROM ({duck(_IDS)}) AS x GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def batch_suffix(spark, d):
    return store.batch_suffix(of_tables(spark, d, _IDS, "orders"))


@query(f"WITH x AS ({duck(_IDS)}) SELECT id, o_totalprice FROM x WHERE id NOT LIKE '%-1995-%' UNION ALL SELECT id, -1 FROM x WHERE id LIKE '%-1995-%' AND o_totalprice > 100000")
def overwrite_year(spark, d):
    rows = of_tables(spark, d, _IDS, "orders")
    return store.overwrite_year(rows, rows.where("id LIKE '%-1995-%' AND o_totalprice > 100000").withColumn("o_totalprice", F.lit(-1.0)))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_keep_first(spark, d):
    return convert.keep_first(table(spark, d, "documents"), ["text"], "doc_id").select("doc_id", "source")


@query("SELECT min(p_partkey) AS p_partkey FROM part WHERE p_partkey % 2 = 1 AND (p_name, p_size) NOT IN (SELECT p_name, p_size FROM part WHERE p_partkey % 2 = 0) GROUP BY p_name, p_size")
def import_new(spark, d):
    part = table(spark, d, "part")
    return store.import_new(part.where("p_partkey % 2 = 0"), part.where("p_partkey % 2 = 1"), ("p_name", "p_size"), "p_partkey").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def delete_ids(spark, d):
    return store.delete_ids(table(spark, d, "part"), table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey").select("p_partkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'Revogado' ELSE o_orderstatus END AS status FROM orders")
def set_status(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return store.set_status(orders, table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "Revogado", "o_orderkey")


@query("SELECT l_orderkey AS ato_id, CAST(l_suppkey AS VARCHAR) AS siape, CAST(arg_max(l_linenumber, l_linenumber) FILTER (l_linenumber > 2) AS VARCHAR) AS nome FROM lineitem GROUP BY 1, 2")
def registrations_table(spark, d):
    item = F.struct(F.when(F.col("l_linenumber") > 2, F.col("l_linenumber").cast("string")).alias("nome"), F.col("l_suppkey").cast("string").alias("siape"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("p")))).alias("x"))
    return store.registrations_table(rows.select("id", F.transform("x", lambda x: x["p"]["siape"]).alias("siapes"), F.transform("x", lambda x: x["p"]).alias("pessoas")))


@query("""SELECT count(*) AS linhas, true AS cabem FROM part""")
def insert_statements(spark, d):
    made = writers.insert_statements(table(spark, d, "part").select("p_partkey", "p_name"), "atos", ["p_partkey"], 200, ["p_partkey"])
    # how many statements there are depends on the ranges of keys; none has more than 200 rows
    rows = F.size(F.split("value", "\n")) - 1
    return made.agg(F.sum(rows).alias("linhas"), (F.max(rows) <= 200).alias("cabem"))


_FORMS = """SELECT CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderkey AS {text}) END AS numero, o_orderpriority AS "orgaoEmissor", CASE WHEN o_orderkey % 8 > 0 THEN repeat(o_orderpriority, 20) ELSE '' END AS ementa,
' a, ' || o_orderstatus || ' ,, b' AS tags, CASE WHEN o_orderkey % 2 = 0 THEN '  ' ELSE ' ' || CAST(o_custkey AS {text}) END AS "processoSei", CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus ELSE '' END AS "conteudoResumido" FROM orders"""


@query(f"""WITH x AS ({duck(_FORMS)}) SELECT numero, 'a,' || trim(split_part(tags, ',', 2)) || ',b' AS tags, nullif(trim("processoSei"), '') AS "processoSei", coalesce(nullif("conteudoResumido", ''), left(ementa, 150) || '...') AS "conteudoResumido"
FROM x WHERE numero IS NOT NULL AND ementa <> ''""")
def form_records(spark, d):
    rows = extract.form_defaults(of_tables(spark, d, _FORMS.replace('"', "`"), "orders"))
    return rows.select("numero", F.array_join("tags", ",").alias("tags"), "processoSei", "conteudoResumido")


@query(f"""WITH relations AS ({duck(ITEM_RELATIONS)}) SELECT ato_destino_id, CASE tipo_relacao WHEN 'Revoga' THEN 'Revogado por' WHEN 'Altera' THEN 'Alterado por' ELSE 'Referenciado por' END AS rotulo, count(*) AS vezes
FROM relations WHERE ato_destino_id IS NOT NULL GROUP BY 1, 2""")
def inverse_labels(spark, d):
    seen = _relations(spark, d).where("ato_destino_id IS NOT NULL")
    return seen.groupBy("ato_destino_id", T.inverse_relation(F.col("tipo_relacao")).alias("rotulo")).agg(F.count(F.lit(1)).alias("vezes"))


# --- reading acts ---------------------------------------------------------------------------------------------------------------


def _extracted(spark: SparkSession) -> DataFrame:
    pages = spark.createDataFrame([("108-26.pdf", 1, BULLETIN)], "arquivo string, page_no int, text string")
    return extract.extract(pages, "https://example.org/p/", "https://example.org/d/")


@stated()
def extract_acts(spark, d):
    return _extracted(spark)


@stated()
def portal_records(spark, d):
    acts = _extracted(spark).withColumn("_idx", F.col("posicao"))
    books = spark.createDataFrame([("108-26.pdf", "10/06/2026")], "arquivo string, bs_data string")
    return convert.portal_records(acts, books)


@stated("SELECT * FROM (VALUES ('1004', '2026-06-10', 'Altera', 'FULANO DE TAL DOS SANTOS', '3442574', 'II', '12'), ('16', '2025-03-02', '', '', '', 'II', '12'), ('17', '2025-03-03', '', 'PORTARIA PROPLAN/UFF Nº 17, DE 3 DE MARÇO DE 2025', '', '', '')) AS t(numero, data_ato, tipo_acao, signatario, sei_documento, secao, pagina)")
def segment_acts(spark, d):
    return _extracted(spark).select("numero", "data_ato", "tipo_acao", "signatario", "sei_documento", "secao", "pagina")


@stated("""SELECT * FROM (VALUES ('1004', 'ALTERA', 'Portaria PROEX nº 65.784', ''), ('1004', 'REVOGA', 'Resolução CUV nº 104', 'BS 102 de 01/09/2025'), ('17', 'CITA', 'Portaria nº 12.', '')) AS t(numero, relacao, ato_citado, bs_origem)""")
def citations(spark, d):
    return _extracted(spark).select("numero", F.inline("relacoes")).select("numero", "relacao", "ato_citado", "bs_origem")


@stated("SELECT * FROM (VALUES ('16', 'Maria da Silva Frühauf', '1642620'), ('17', 'João Sant''Anna', '2364493')) AS t(numero, nome, siape)")
def people(spark, d):
    return _extracted(spark).select("numero", F.inline("pessoas"))


@stated("""SELECT * FROM (VALUES ('16', 'designar', 'Chefe', 'Departamento de Física', 'departamento de fisica', '1642620'), ('17', 'dispensar', 'Coordenador', 'Curso de Graduação em Química', 'curso de graduacao em quimica', '2364493')) AS t(numero, acao, cargo, unidade, unidade_chave, siape)""")
def roles(spark, d):
    return _extracted(spark).select("numero", F.inline("funcoes")).drop("nome")


@stated("SELECT * FROM (VALUES ('16', 'Designa Maria da Silva Frühauf, Professora.', true), ('17', '', false), ('1004', '', false)) AS t(numero, ementa_resumo, ementa_inferida)")
def inferred_summary(spark, d):
    return _extracted(spark).select("numero", "ementa_resumo", "ementa_inferida")


@stated("SELECT CAST(3 AS BIGINT) AS atos, CAST(3 AS BIGINT) AS relacoes, CAST(1 AS BIGINT) AS com_processo")
def run_summary(spark, d):
    return extract.run_summary(_extracted(spark))


@stated("SELECT * FROM (VALUES ('Portaria', '12', 2024, '2024-05-03', 'GAB', 'Revoga a Portaria PROEX nº 33.')) AS t(\"tipoAto\", numero, ano, \"dataAssinatura\", \"orgaoEmissor\", ementa)")
def parse_loose(spark, d):
    texts = spark.createDataFrame([("PORTARIA GAB/UFF Nº 12, DE 3 DE MAIO DE 2024. Revoga a Portaria PROEX nº 33. O REITOR resolve",)], "texto string")
    return extract.parse_loose(texts).select("tipoAto", "numero", "ano", "dataAssinatura", "orgaoEmissor", "ementa")


@query("SELECT doc_id FROM documents WHERE length(trim(left(text, 11))) < 12 AND trim(text) <> '' AND doc_id % 2 = 0")
def without_summary(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.left("text", F.lit(11)).alias("ementa"), (F.col("doc_id") % 2 == 1).alias("ementa_inferida"), F.col("text").alias("corpo_busca"))
    return extract.without_summary(rows).select("doc_id")


# --- reading thousands of acts: bulletins written from the orders ----------------------------------------------------------------


def _bulletin_segments(spark: SparkSession, d: str) -> DataFrame:
    return extract.segments(extract.bulletins(spark.sql(PARTS_AS_PAGES, parts=of_tables(spark, d, ORDER_PARTS, "orders"))))


def _bulletin_acts(spark: SparkSession, d: str) -> DataFrame:
    return extract.act_records(_bulletin_segments(spark, d), "https://example.org/p/", "https://example.org/d/")


#: What an act's key, bulletin and address are made of.
_KEYED = ["arquivo", "bs_data", "tipo", "sigla", "numero", "ano"]


def _bulletin_records(spark: SparkSession, d: str, *read: str) -> DataFrame:
    """Portal records of the orders' acts; of their columns only those made from ``_KEYED`` and the columns ``read`` can be used."""
    acts = _bulletin_acts(spark, d)
    # keys, bulletins and addresses look at the acts again, so texts are read once, for these columns, and what was read is kept
    _, kept = VersionedStore(spark, shared_folder(spark)).stage("atos_lidos", acts.select(*_KEYED, *read))
    unread = {f.name: F.raise_error(F.lit(f"{f.name} was not read")).cast(f.dataType) for f in acts.schema if f.name not in kept.columns}
    acts = kept.withColumns(unread | {"_idx": F.col("numero").cast("long")})
    books = acts.select("arquivo", "bs_data").distinct()
    urls = books.where("arquivo LIKE '%-1995.pdf'").select("arquivo", F.concat(F.lit("https://example.org/b/"), "arquivo").alias("url"))
    return convert.portal_records(acts, books, urls, "https://example.org/")


_PARTS = f"WITH parts AS ({duck(ORDER_PARTS)})"
_DATE_OF_PARTS = "ano || '-' || mes || '-' || lpad(dia, 2, '0')"
_SAID = """CASE forma WHEN 0 THEN '' WHEN 1 THEN 'Designa ' ELSE 'Dispensa ' END || CASE WHEN forma > 0 THEN replace(replace(nome, 'Sant''Anna', 'Sant''anna'), 'Pedro D''Ávila', 'PEDRO d''Ávila') ELSE '' END
|| CASE forma WHEN 0 THEN '' WHEN 1 THEN ', Professora.' ELSE '.' END"""
_FORMAL = "CASE forma WHEN 0 THEN 'Altera a Portaria PROAD nº ' || citado || ' e dá outras providências.' ELSE '' END"


@query(f"""{_PARTS} SELECT numero, arquivo, livro AS bs_numero, '10/06/' || ano AS bs_data, 'II' AS secao, '12' AS pagina, 'PORTARIA' AS tipo, orgao || '/UFF' AS orgao, orgao AS sigla, {_DATE_OF_PARTS} AS data_ato,
'Portaria ' || orgao || ' nº ' || numero || '/' || ano AS identificador, CASE forma WHEN 0 THEN 'Altera' ELSE '' END AS tipo_acao, {_FORMAL} AS ementa, {_SAID} AS ementa_resumo, forma > 0 AS ementa_inferida,
'FULANO DE TAL DOS SANTOS' AS signatario, processo AS processo_sei_principal, documento AS sei_documento, 'https://example.org/p/' || processo AS link_sei_processo, 'https://example.org/d/' || documento AS link_sei_documento,
CASE forma WHEN 0 THEN 'Portaria PROAD nº ' || citado ELSE '' END AS altera, CASE forma WHEN 0 THEN 'Resolução CUV nº ' || citado ELSE '' END AS revoga, CASE forma WHEN 2 THEN 'Portaria nº ' || citado ELSE '' END AS cita FROM parts""")
def bulletin_acts(spark, d):
    shown = "numero arquivo bs_numero bs_data secao pagina tipo orgao sigla data_ato identificador tipo_acao ementa ementa_resumo ementa_inferida signatario processo_sei_principal sei_documento link_sei_processo link_sei_documento altera revoga cita"
    return _bulletin_acts(spark, d).select(*shown.split())


@query(f"""{_PARTS} SELECT numero, 'ALTERA' AS relacao, 'Portaria PROAD nº ' || citado AS ato_citado, '' AS bs_origem FROM parts WHERE forma = 0 UNION ALL
SELECT numero, 'REVOGA', 'Resolução CUV nº ' || citado, 'BS 102 de 01/09/2025' FROM parts WHERE forma = 0 UNION ALL SELECT numero, 'CITA', 'Portaria nº ' || citado, '' FROM parts WHERE forma = 2""")
def bulletin_citations(spark, d):
    return convert.elements(_bulletin_acts(spark, d), "relacoes", "numero").select("numero", "_one.*").select("numero", "relacao", "ato_citado", "bs_origem")


@query(f"{_PARTS} SELECT numero, nome, siape FROM parts WHERE forma > 0")
def bulletin_people(spark, d):
    return convert.elements(_bulletin_acts(spark, d), "pessoas", "numero").select("numero", "_one.*")


_PARTS_AS_ROLES = """SELECT numero, CASE forma WHEN 1 THEN 'designar' ELSE 'dispensar' END AS acao, CASE forma WHEN 1 THEN 'Chefe' ELSE 'Coordenador' END AS cargo,
CASE forma WHEN 1 THEN 'Departamento de ' ELSE 'Curso de Graduação em ' END || area AS unidade, CASE forma WHEN 1 THEN 'departamento de ' ELSE 'curso de graduacao em ' END || area_chave AS unidade_chave, nome, siape FROM parts WHERE forma > 0"""


@query(f"{_PARTS} {_PARTS_AS_ROLES}")
def bulletin_roles(spark, d):
    return convert.elements(_bulletin_acts(spark, d), "funcoes", "numero").select("numero", "_one.*")


@query(f"""{_PARTS} SELECT livro || '-' || ano || '-portaria-' || lower(orgao) || '-' || numero || '-' || ano AS id, 'Portaria' AS "tipoAto", numero, CAST(ano AS INTEGER) AS ano, {_DATE_OF_PARTS} AS "dataAssinatura", orgao AS "orgaoEmissor",
CASE forma WHEN 0 THEN {_FORMAL} ELSE {_SAID} END AS ementa, forma > 0 AS "ementaInferida", CASE forma WHEN 0 THEN {_FORMAL} ELSE {_SAID} END AS "conteudoResumido", processo AS "processoSei", documento AS "seiDocumento", 'BS nº ' || livro || '/' || ano AS "boletimNumero",
CASE ano WHEN '1995' THEN 'https://example.org/b/' || arquivo ELSE 'https://example.org/' END AS "linkBoletim", 'Extraído de ' || arquivo || '. Assinante: FULANO DE TAL DOS SANTOS.' AS "notasInternas",
CASE forma WHEN 0 THEN 'Altera=Portaria PROAD nº ' || citado || '; Revoga=Resolução CUV nº ' || citado WHEN 2 THEN 'Complementa=Portaria nº ' || citado ELSE '' END AS relacoes FROM parts""")
def bulletin_records(spark, d):
    relations = F.array_join(F.transform("relacoes", lambda r: F.concat_ws("=", r["tipoRelacao"], r["atoDestino"])), "; ").alias("relacoes")
    shown = "id tipoAto numero ano dataAssinatura orgaoEmissor ementa ementaInferida conteudoResumido processoSei seiDocumento boletimNumero linkBoletim notasInternas"
    read = "bs_numero data_ato ementa ementa_resumo signatario processo_sei_principal sei_documento relacoes"
    return _bulletin_records(spark, d, *read.split()).select(*shown.split(), relations)


@query(f"""{_PARTS}, roles AS (SELECT r.*, CAST({_DATE_OF_PARTS.replace("ano", "p.ano")} AS DATE) AS data_ato, p.livro || '-' || p.ano || '-portaria-' || lower(p.orgao) || '-' || p.numero || '-' || p.ano AS ato_id
FROM ({_PARTS_AS_ROLES}) AS r JOIN parts p ON p.numero = r.numero){_HOLDERS.replace("SELECT cargo, unidade, siape", "SELECT cargo, unidade, nome, siape")}""")
def named_holders(spark, d):
    records = _bulletin_records(spark, d, "data_ato", "siapes", "pessoas", "funcoes")
    # the events lose their names, which come back from the acts' registrations
    roles = store.roles_table(records).withColumn("nome", F.lit(""))
    return listing.current_holders(roles, store.acts_table(records), store.registrations_table(records)).selectExpr("cargo", "unidade", "nome", "siape", "CAST(desde AS STRING) AS desde", "ato_id")


@query(f"""{_PARTS} SELECT CAST(livro AS INTEGER) + CAST(ano AS INTEGER) * 1000 AS boletim_id, count(*) AS atos FROM parts GROUP BY 1""")
def acts_of_bulletins(spark, d):
    records = _bulletin_records(spark, d)
    return store.with_bulletin(store.acts_table(records), store.bulletins_table(records)).groupBy("boletim_id").agg(F.count(F.lit(1)).alias("atos"))


@query(f"""{_PARTS} SELECT count(*) AS atos, CAST(sum(CASE forma WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END) AS BIGINT) AS relacoes, count(*) AS com_processo FROM parts""")
def bulletin_summary(spark, d):
    return extract.run_summary(_bulletin_acts(spark, d))


@query(f"""{_PARTS} SELECT k, 'Portaria' AS "tipoAto", numero, CAST(ano AS INTEGER) AS ano, {_DATE_OF_PARTS} AS "dataAssinatura", orgao AS "orgaoEmissor", 'Revoga a Portaria PROEX nº ' || citado || '.' AS ementa FROM parts""")
def pasted_acts(spark, d):
    written = "concat('PORTARIA ', orgao, '/UFF Nº ', numero, ', DE ', dia, ' DE ', mes_escrito, ' DE ', ano, '. Revoga a Portaria PROEX nº ', citado, '. O REITOR resolve')"
    texts = of_tables(spark, d, ORDER_PARTS, "orders").selectExpr("k", f"{written} AS texto")
    return extract.parse_loose(texts).select("k", "tipoAto", "numero", "ano", "dataAssinatura", "orgaoEmissor", "ementa")


_ITEMS = """SELECT CAST(o_orderkey AS {text}) AS numero, o_orderkey AS _idx, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS "ementa", 'Portaria' AS "tipoAto", CAST(o_custkey AS {text}) AS "processoSei", o_orderstatus AS "conteudoResumido",
substr(o_orderpriority, 3) AS "orgaoEmissor", year(o_orderdate) AS ano, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS {text}) END AS "dataAssinatura", lower(o_orderpriority) || ' siape ' || CAST(1000000 + o_custkey AS {text}) AS "textoBusca" FROM orders"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    rows = of_tables(spark, d, _ITEMS.replace('"', "`"), "orders")
    return rows.withColumns({"siapes": F.array(F.col("processoSei")), "tags": F.array("orgaoEmissor"), "signatario": F.col("conteudoResumido"), "status": F.lit("Ativo")})


@query(f"""WITH x AS ({duck(_ITEMS)}) SELECT numero FROM x WHERE contains("textoBusca", 'urgent') OR contains(lower(coalesce(ementa, '')), 'urgent') OR contains(lower("orgaoEmissor"), 'urgent')""")
def static_name(spark, d):
    return listing.static_filtered(_items(spark, d), P(nome=" Urgent ")).select("numero")


@query(f"""WITH x AS ({duck(_ITEMS)}) SELECT numero FROM x WHERE contains("processoSei", '12') OR contains("textoBusca", '12')""")
def static_registration(spark, d):
    return listing.static_filtered(_items(spark, d), P(siape="1-2")).select("numero")


@query(f"""WITH x AS ({duck(_ITEMS)}) SELECT numero FROM x WHERE contains(numero, 'low') OR contains(lower(coalesce(ementa, '')), 'low') OR contains("processoSei", 'low') OR contains(lower("orgaoEmissor"), 'low') OR contains(lower("conteudoResumido"), 'low')""")
def sheet_search(spark, d):
    return listing.static_filtered(_items(spark, d), P(busca="LOW"), sheet=True).select("numero")


@query(f"""WITH x AS ({duck(_ITEMS)}) SELECT numero FROM x ORDER BY coalesce("dataAssinatura", '') DESC, _idx LIMIT 50 OFFSET 50""")
def static_sorted_page(spark, d):
    return listing.static_page(_items(spark, d), P(ordenar="data_ato", dir="desc", pagina="2")).select("numero")


_CARD = "7"


@query(f"""WITH acts AS ({duck(ORDER_ACTS)}), relations AS ({duck(ITEM_RELATIONS)})
SELECT id, tipo, numero, (SELECT string_agg(tipo_relacao || '>' || coalesce(CAST(ato_destino_id AS VARCHAR), ''), ';' ORDER BY rel_id) FROM relations WHERE ato_id = {_CARD}) AS relacoes,
(SELECT string_agg(r.tipo_relacao || '<' || trim(a.tipo || ' ' || a.sigla || ' nº ' || a.numero || '/' || a.ano), ';' ORDER BY r.rel_id) FROM relations r JOIN acts a ON a.id = r.ato_id WHERE r.ato_destino_id = {_CARD}) AS referencias,
'1,2' AS siapes, 'a,b' AS tags FROM acts WHERE id = {_CARD}""")
def act_card(spark, d):
    acts, relations = _acts(spark, d), _relations(spark, d).withColumns({"ato_destino_texto": F.lit(""), "detalhes": F.lit("")})
    people = acts.select(F.col("id").alias("ato_id"), F.explode(F.array(F.lit("2"), F.lit("1"))).alias("siape")).withColumn("nome", F.when(F.col("siape") == "1", "Ana"))
    tags = acts.select(F.col("id").alias("ato_id"), F.explode(F.array(F.lit("b"), F.lit("a"))).alias("tag"))
    found = listing.card(_CARD, acts, people, relations, tags)
    out = F.array_join(F.transform("relacoes", lambda r: F.concat(r["tipoRelacao"], F.lit(">"), F.coalesce(r["atoDestinoId"].cast("string"), F.lit("")))), ";")
    back = F.array_join(F.transform("referenciadoPor", lambda r: F.concat(r["relacao"], F.lit("<"), r["porLabel"])), ";")
    return found.select("id", "tipo", "numero", F.when(out != "", out).alias("relacoes"), F.when(back != "", back).alias("referencias"), F.array_join("siapes", ",").alias("siapes"), F.array_join("tags", ",").alias("tags"))
