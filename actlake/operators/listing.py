"""The query side: filtered, sorted, paged lists, record cards, statistics, facets and current holders of offices."""

from __future__ import annotations

import dataclasses
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actlake.functions import text as T
from actlake.functions import vocabulary as V
from actlake.operators.postings import TextIndex

SORTS = {"data_ato", "ano", "tipo", "sigla", "numero", "status"}
PAGE, LARGEST_PAGE = 50, 200


def _number(value: object, default: int) -> int:
    """What a request's parameter counts as: leading digits, else 0; the default if missing."""
    if value is None:
        return default
    m = re.match(r"\s*[+-]?\d+", str(value))
    return int(m[0]) if m else 0


@dataclasses.dataclass(frozen=True)
class ListParams:
    """A request for a list; blank values and 'todos' filter nothing."""

    busca: str = ""
    tipo: str = ""
    orgao: str = ""
    status: str = ""
    ano: str = ""
    nome: str = ""
    siape: str = ""
    com_sei: str | bool = ""
    com_relacoes: str | bool = ""
    ordenar: str = "data_ato"
    dir: str = "desc"
    por_pagina: object = None
    pagina: object = None

    @property
    def size(self) -> int:
        return min(max(_number(self.por_pagina, PAGE), 1), LARGEST_PAGE)

    @property
    def number(self) -> int:
        return max(_number(self.pagina, 1), 1)

    @property
    def sort(self) -> str:
        return self.ordenar if self.ordenar in SORTS else "data_ato"

    @property
    def ascending(self) -> bool:
        return self.dir.lower() == "asc"


def _on(flag: str | bool) -> bool:
    return flag not in ("", "0", False, None)


def _asked(value: str) -> bool:
    return value.strip() not in ("", "todos")


def like(c: Column, query: str) -> Column:
    """The query anywhere in the value, whatever the case and accents; % and _ stay wildcards."""
    return F.like(T.fold(c), F.concat(F.lit("%"), T.fold(F.lit(query)), F.lit("%")))


def same_text(c: Column, value: str) -> Column:
    """Equal whatever the case, accents and trailing blanks, in any script."""
    return F.collate(c, "UNICODE_CI_AI_RTRIM") == F.collate(F.lit(value), "UNICODE_CI_AI_RTRIM")


def search(numbers: list[Column], texts: list[Column], query: str) -> Column:
    """The query in a number, or all its words (three characters or more) as beginnings of words of the texts."""
    query = query.strip()
    hit = F.lit(False)
    for c in numbers:
        hit = hit | F.coalesce(like(c, query), F.lit(False))
    tokens = T.query_tokens(query)
    return hit | T.has_prefixes(F.concat_ws(" ", *texts), tokens) if tokens else hit


def indexed_search(rows: DataFrame, numbers: list[Column], query: str, index: TextIndex) -> DataFrame:
    """``search`` with the words looked up in a posting table of the rows' texts."""
    found = index.search(query)
    hit = reduce(lambda a, b: a | b, [F.coalesce(like(c, query.strip()), F.lit(False)) for c in numbers], F.lit(False))
    if found is None:
        return rows.where(hit)
    return rows.join(found.select("id", F.lit(True).alias("_said")), "id", "left").where(hit | F.coalesce("_said", F.lit(False))).drop("_said")


def filtered(acts: DataFrame, params: ListParams, bodies: DataFrame, registrations: DataFrame, relations: DataFrame, texts: TextIndex | None = None, names: TextIndex | None = None) -> DataFrame:
    """Acts that all given filters hold for. Filters on child tables are semi-joins; either-way relations one existence join.

    ``texts`` and ``names``: posting tables of the summaries and of the bodies; without one the texts are read.
    """
    rows = acts
    if params.busca.strip():
        numbers = [F.col(c) for c in ("numero", "identificador", "processo_sei") if c in acts.columns]
        if texts is not None:
            rows = indexed_search(rows, numbers, params.busca, texts)
        else:
            rows = rows.where(search(numbers, [F.col("ementa"), F.col("conteudo_resumido")], params.busca))
    for column, value in (("tipo", params.tipo), ("sigla", params.orgao), ("status", params.status)):
        if _asked(value):
            rows = rows.where(same_text(F.col(column), value.strip()))
    if _asked(params.ano):
        rows = rows.where(F.col("ano") == _number(params.ano, 0))
    if name := params.nome.strip():
        tokens = T.query_tokens(name)
        if tokens and names is not None:
            said = names.search(name)
        else:
            said = bodies.where(T.has_prefixes(F.col("texto"), tokens) if tokens else like(F.col("texto"), name)).select(F.col("ato_id").alias("id"))
        rows = rows.join(said, "id", "left_semi")
    if digits := re.sub(r"\D", "", params.siape):
        rows = rows.join(registrations.where(F.contains("siape", F.lit(digits))).select(F.col("ato_id").alias("id")), "id", "left_semi")
    if _on(params.com_sei):
        rows = rows.where(F.coalesce("processo_sei", F.lit("")) != "")
    if _on(params.com_relacoes):
        rows = with_relations(rows, relations)
    return rows


def with_relations(acts: DataFrame, relations: DataFrame) -> DataFrame:
    """Acts that cite or are cited."""
    ends = relations.select(F.col("ato_id").alias("id")).unionByName(relations.select(F.col("ato_destino_id").alias("id"))).where("id IS NOT NULL")
    return acts.join(ends, "id", "left_semi")


def status_rank(c: Column, order: list[str] = V.STATUSES) -> Column:
    """Place in the list of statuses, which is what sorting by status means."""
    return F.array_position(F.array(*map(F.lit, order)), c)


def sorted_page(rows: DataFrame, params: ListParams, tie: str = "id") -> DataFrame:
    """One page in the asked order, equal values by id; Spark takes the top rows without sorting the rest."""
    key = status_rank(F.col("status")) if params.sort == "status" else F.col(params.sort)
    order = key.asc_nulls_first() if params.ascending else key.desc_nulls_last()
    return rows.orderBy(order, F.asc(tie)).offset((params.number - 1) * params.size).limit(params.size)


def sheet_order(rows: DataFrame, column: str, ascending: bool = True, place: str = "_idx") -> list[Column]:
    """Order of the spreadsheet by a column: text as a reader expects it, missing values first going up and last going down, equal ones
    as they were (by ``place``)."""
    key = F.collate(F.col(column), "UNICODE") if rows.schema[column].dataType.typeName() == "string" else F.col(column)
    return [key.asc_nulls_first() if ascending else key.desc_nulls_last(), F.asc(place)]


def relation_kinds(relations: DataFrame) -> DataFrame:
    """(id, relTipos): sorted distinct kinds of an act's relations."""
    return relations.groupBy(F.col("ato_id").alias("id")).agg(F.array_sort(F.collect_set("tipo_relacao")).alias("relTipos"))


def reference_counts(relations: DataFrame) -> DataFrame:
    return relations.where("ato_destino_id IS NOT NULL").groupBy(F.col("ato_destino_id").alias("id")).agg(F.count(F.lit(1)).alias("refCount"))


def list_page(acts: DataFrame, params: ListParams, bodies: DataFrame, registrations: DataFrame, relations: DataFrame) -> DataFrame:
    """A page of acts with the kinds of their relations and how often they are cited, counted for the page's acts only."""
    page = sorted_page(filtered(acts, params, bodies, registrations, relations), params)
    ids = F.broadcast(page.select("id"))  # LARGEST_PAGE rows at most
    kinds = relation_kinds(relations.join(ids.withColumnRenamed("id", "ato_id"), "ato_id", "left_semi"))
    counts = reference_counts(relations.join(ids.withColumnRenamed("id", "ato_destino_id"), "ato_destino_id", "left_semi"))
    rows = page.join(kinds, "id", "left").join(counts, "id", "left")
    rows = rows.withColumns({"relTipos": F.coalesce("relTipos", F.array().cast("array<string>")), "refCount": F.coalesce("refCount", F.lit(0))})
    return sorted_page(rows, dataclasses.replace(params, pagina=1))


def page_counts(rows: DataFrame, params: ListParams) -> DataFrame:
    """(total, pagina, por_pagina, paginas) of a filtered list; no pages when it is empty."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return total.select("total", F.lit(params.number).alias("pagina"), F.lit(params.size).alias("por_pagina"), F.ceil(F.col("total") / params.size).cast("int").alias("paginas"))


# --- static modes ---------------------------------------------------------------------------------------------------------------


def static_filtered(records: DataFrame, params: ListParams, sheet: bool = False) -> DataFrame:
    """The same request over portal records, by the rules of the pages that have no server: plain substrings.

    ``sheet``: the spreadsheet's rules, which search tags and issuer too and look for names in the signer's note.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    rows, query = records, params.busca.lower() if sheet else params.busca.lower().strip()
    if query:
        fields = ["numero", "ementa", "processoSei", "orgaoEmissor", "conteudoResumido"] if sheet else ["numero", "ementa", "processoSei", "conteudoResumido"]
        if sheet:
            hit = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.contains(F.lower(t), F.lit(query)))
            for f in fields:
                hit = hit | F.contains(low(f), F.lit(query))
        else:
            blank = lambda c: F.coalesce(F.col(c), F.lit(""))
            identifier = blank("identificador") if "identificador" in records.columns else F.lit("")
            hit = F.contains(F.lower(F.concat_ws(" ", blank("numero"), identifier, *map(blank, fields[1:]))), F.lit(query))
        rows = rows.where(hit)
    for column, value in (("tipoAto", params.tipo), ("orgaoEmissor", params.orgao), ("status", params.status)):
        if _asked(value):
            rows = rows.where(F.col(column) == value)
    if _asked(params.ano):
        rows = rows.where(F.col("ano").cast("string") == params.ano)
    if name := params.nome.lower().strip():
        hit = F.contains(F.coalesce("textoBusca", F.lit("")), F.lit(name))
        for f in ["ementa", "orgaoEmissor"] + (["signatario"] if sheet and "signatario" in records.columns else []):
            hit = hit | F.contains(low(f), F.lit(name))
        rows = rows.where(hit)
    if digits := re.sub(r"\D", "", params.siape):
        listed = F.exists(F.coalesce("siapes", F.array().cast("array<string>")), lambda s: F.contains(s, F.lit(digits)))
        rows = rows.where(listed | F.contains(F.coalesce("textoBusca", F.lit("")), F.lit(digits)))
    if _on(params.com_sei):
        rows = rows.where(F.coalesce("processoSei", F.lit("")) != "")
    if _on(params.com_relacoes):
        rows = rows.where((F.size("relacoes") > 0) | (F.size("referenciadoPor") > 0))
    return rows


def static_page(rows: DataFrame, params: ListParams, order: str = "_idx") -> DataFrame:
    """A page by the static rules: missing values sort as empty text, equal ones stay in input order, a size of 0 is the default."""
    columns = {"data_ato": "dataAssinatura", "ano": "ano", "tipo": "tipoAto", "sigla": "orgaoEmissor", "numero": "numero", "status": "status"}
    key = F.col(columns[params.sort])
    key = key if params.sort == "ano" else F.coalesce(key, F.lit(""))
    size = params.size if _number(params.por_pagina, PAGE) else PAGE
    return rows.orderBy(key.asc() if params.ascending else key.desc(), F.asc(order)).offset((params.number - 1) * size).limit(size)


def static_stats(records: DataFrame) -> DataFrame:
    """Statistics of portal records: empty issuers and files count as one more."""
    count = lambda s: F.count_if(F.col("status") == s)
    return records.agg(
        F.count(F.lit(1)).alias("total"), count("Ativo").alias("vigentes"), count("Revogado").alias("revogados"), count("Alterado").alias("alterados"),
        F.count_distinct(F.coalesce("orgaoEmissor", F.lit(""))).alias("orgaos"), F.count_if(F.coalesce("processoSei", F.lit("")) != "").alias("comSei"),
        F.count_distinct(F.coalesce("arquivo", F.lit(""))).alias("boletins"),
    )


def sidebar_search(records: DataFrame, query: str, most: int = 80) -> DataFrame:
    """The first acts whose label, summary or issuer has the query."""
    label = F.concat("tipoAto", F.lit(" nº "), "numero", F.lit("/"), F.col("ano").cast("string"))
    hit = F.lit(False)
    for c in (label, F.col("ementa"), F.col("orgaoEmissor")):
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query.lower()))
    return records.where(hit).orderBy("_idx").limit(most)


# --- cards, statistics, facets --------------------------------------------------------------------------------------------------


def card(act_id: str, acts: DataFrame, registrations: DataFrame, relations: DataFrame, tags: DataFrame) -> DataFrame:
    """One act with its people (unnamed ones last), tags, relations and the acts that refer to it, as one plan.

    Raises ValueError for a blank id. A missing act is an empty frame; ``require`` turns that into KeyError.
    """
    if not act_id:
        raise ValueError("id ausente")
    one = acts.where(F.col("id") == act_id)
    own = lambda df: df.where(F.col("ato_id") == act_id)
    people = own(registrations).groupBy("ato_id").agg(F.array_sort(F.collect_list(F.struct(F.col("nome").isNull().alias("_n"), F.coalesce("nome", F.lit("")).alias("_s"), "siape", "nome"))).alias("p"))
    people = people.select(F.col("ato_id").alias("id"), F.transform("p", lambda x: F.struct(x["nome"].alias("nome"), x["siape"].alias("siape"))).alias("pessoas"))
    labels = own(tags).groupBy(F.col("ato_id").alias("id")).agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    out = own(relations).groupBy(F.col("ato_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rel_id", F.col("tipo_relacao").alias("tipoRelacao"), F.col("ato_destino_texto").alias("atoDestino"), F.col("ato_destino_id").alias("atoDestinoId"), "detalhes"))).alias("relacoes"))
    label = F.trim(F.concat(F.coalesce("tipo", F.lit("")), F.lit(" "), F.coalesce("sigla", F.lit("")), F.lit(" nº "), F.coalesce("numero", F.lit("")), F.lit("/"), F.coalesce(F.col("ano").cast("string"), F.lit(""))))
    back = relations.where(F.col("ato_destino_id") == act_id).join(acts.select(F.col("id").alias("ato_id"), label.alias("porLabel")), "ato_id")
    back = back.groupBy(F.col("ato_destino_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rel_id", F.col("tipo_relacao").alias("relacao"), F.col("ato_id").alias("porId"), "porLabel", "detalhes"))).alias("referenciadoPor"))
    for part in (people, labels, out, back):
        one = one.join(part, "id", "left")
    return one.withColumn("siapes", F.transform("pessoas", lambda p: p["siape"]))


def require(found: DataFrame) -> dict:
    """The row of a point lookup; KeyError if there is none."""
    row = found.limit(1).collect()
    if not row:
        raise KeyError("ato não encontrado")
    return row[0].asDict(recursive=True)


def stats(acts: DataFrame, books: DataFrame) -> DataFrame:
    """Counts by status, of issuers, of acts with a process, and of bulletins: one pass over each table."""
    count = lambda s: F.count_if(F.col("status") == s)
    of_acts = acts.agg(
        F.count(F.lit(1)).alias("total"), count("Ativo").alias("vigentes"), count("Revogado").alias("revogados"), count("Alterado").alias("alterados"),
        F.count_distinct("sigla").alias("orgaos"), F.count_if(F.coalesce("processo_sei", F.lit("")) != "").alias("comSei"),
    )
    of_books = books.agg(F.count(F.lit(1)).alias("boletins"))
    # both sides are one row
    return of_acts.withColumn("_k", F.lit(1)).join(F.broadcast(of_books.withColumn("_k", F.lit(1))), "_k").drop("_k")


def percent(part: Column, whole: Column) -> Column:
    """Whole percentage, 0 of nothing."""
    return F.when(whole == 0, 0).otherwise(F.floor(part * 100 / whole + 0.5)).cast("int")


def facets(acts: DataFrame) -> DataFrame:
    """(lista, valor, ordem) of the menus: kinds and issuers in order, years from the latest; one shuffle for all three."""
    values = F.array(*[F.struct(F.lit(n).alias("lista"), F.col(c).cast("string").alias("valor")) for n, c in (("tipos", "tipo"), ("orgaos", "sigla"), ("anos", "ano"))])
    found = acts.select(F.inline(values)).where("valor IS NOT NULL AND NOT (lista = 'orgaos' AND valor = '')").distinct()
    year = F.when(F.col("lista") == "anos", -F.col("valor").try_cast("int"))
    return found.withColumn("ordem", F.row_number().over(Window.partitionBy("lista").orderBy(year, "valor")))


def histogram(acts: DataFrame, column: str) -> DataFrame:
    return acts.groupBy(F.col(column).alias("valor")).agg(F.count(F.lit(1)).alias("n"))


# --- holders of offices ---------------------------------------------------------------------------------------------------------


def last_events(events: DataFrame, position: list[str], date: str) -> DataFrame:
    """Events on the latest date of their position; rows without a date don't count."""
    dated = events.where(F.col(date).isNotNull())
    return dated.withColumn("_r", F.rank().over(Window.partitionBy(*position).orderBy(F.desc(date)))).where("_r = 1").drop("_r")


def current_holders(roles: DataFrame, acts: DataFrame, registrations: DataFrame) -> DataFrame:
    """(cargo, unidade, unidade_chave, nome, siape, desde, ato_id): who was appointed on the latest date of each unit's office.

    An appointment wins over a dismissal of the same date; a later dismissal leaves the office vacant. One person holds one
    office, the latest. Each pass is a window that Spark limits before the shuffle. By unit, then office.
    """
    dated = roles.join(acts.select(F.col("id").alias("ato_id"), F.col("data_ato").alias("desde")), "ato_id")
    named = last_events(dated, ["unidade_chave", "cargo"], "desde").where("acao = 'designar'")
    people = registrations.select("ato_id", "siape", F.col("nome").alias("_nome")).dropDuplicates(["ato_id", "siape"])
    named = named.join(people, ["ato_id", "siape"], "left").withColumn("nome", F.coalesce(T.filled(F.col("nome")), F.col("_nome")))
    first = Window.partitionBy("unidade_chave", F.lower("cargo")).orderBy("unidade", "cargo", F.desc("ato_id"), "siape")
    posts = named.withColumn("_p", F.row_number().over(first)).where("_p = 1")
    return latest_per_person(posts, "siape", "desde", ["unidade", "cargo", "ato_id"]).select("cargo", "unidade", "unidade_chave", "nome", "siape", "desde", "ato_id").orderBy("unidade", "cargo", "ato_id")


def latest_per_person(posts: DataFrame, person: str, date: str, ties: list[str]) -> DataFrame:
    """The latest post of each person; posts without a person all stay."""
    name = F.coalesce(F.col(person).cast("string"), F.lit(""))
    key = [name, F.when(name == "", F.struct(*ties))]
    return posts.withColumn("_w", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(date), *ties))).where("_w = 1").drop("_w")


def current_holders_static(roles: DataFrame, acts: DataFrame) -> DataFrame:
    """Holders by the static rule: the event of the latest date and largest act id counts, and must be an appointment."""
    dated = roles.join(acts.select(F.col("id").alias("ato_id"), F.col("data_ato").alias("desde")), "ato_id").where("unidade_chave != '' AND desde IS NOT NULL")
    last = dated.groupBy("unidade_chave", F.lower("cargo").alias("_c")).agg(F.max_by(F.struct("acao", "cargo", "unidade", "nome", "siape", "desde", "ato_id"), F.struct("desde", "ato_id", F.col("acao"))).alias("e"))
    return last.where("e.acao = 'designar'").select("e.cargo", "e.unidade", "unidade_chave", "e.nome", "e.siape", "e.desde", "e.ato_id")


def holder_search(holders: DataFrame, family: str = "", query: str = "") -> DataFrame:
    """Holders of a family of offices whose unit, office, name or number has the query."""
    blob = F.lower(F.concat_ws(" ", "unidade", "cargo", "nome", "siape"))
    return holders.where(F.contains(F.lower("cargo"), F.lit(family.lower())) & F.contains(blob, F.lit(query.lower().strip())))


def office_families(holders: DataFrame) -> DataFrame:
    return holders.select(F.regexp_replace("cargo", r"^(Vice-|Sub)", "").alias("familia")).select(F.initcap("familia").alias("familia")).distinct().orderBy("familia")
