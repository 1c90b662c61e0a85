"""Bulletin pages to act records: segmentation, then one projection of derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlake.functions import reading as R
from actlake.functions import text as T
from actlake.functions import vocabulary as V


def bulletins(pages: DataFrame) -> DataFrame:
    """(arquivo, texto, paginas, bs_numero, bs_data, bs_ano) from pages (arquivo, page_no, text).

    Pages of one bulletin meet in one row; a bulletin is a document of bounded size.
    """
    clean = pages.select("arquivo", "page_no", T.page_text(F.coalesce("text", F.lit(""))).alias("text"))
    whole = clean.groupBy("arquivo").agg(F.sort_array(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    texts = F.transform("p", lambda x: x["text"])
    cover = T.bulletin_metadata(F.array_join(F.slice(texts, 1, 3), "\n"))
    return whole.select("arquivo", F.concat(F.array_join(texts, "\n"), F.lit("\n")).alias("texto"), F.size("p").alias("paginas"), cover.alias("m")).select("arquivo", "texto", "paginas", "m.*")


def segments(books: DataFrame) -> DataFrame:
    """A row for each title of a bulletin; bulletins without any title have none."""
    rows = books.withColumn("s", F.explode(R.segments(F.col("texto"))))
    return rows.drop("texto").select("*", "s.*").drop("s")


def act_records(segs: DataFrame, process_base: str = "", document_base: str = "") -> DataFrame:
    """Act records, without titles that only a table of contents lists. The bases are addresses that codes are appended to."""
    kept = segs.where(T.looks_like_act(F.col("trecho")))
    first = kept.select(
        "*",
        T.clean(F.col("tipo")).alias("_tipo"),
        T.trimmed_issuer(F.col("orgao")).alias("_orgao"),
        T.clean(F.col("numero")).alias("_numero"),
        T.body(F.col("trecho")).alias("corpo"),
        T.summary(F.regexp_replace("resto", V.RUNNING_HEAD, " ")).alias("ementa"),
        T.process_numbers(F.col("trecho")).alias("processos_sei"),
        T.document_code(F.col("trecho")).alias("sei_documento"),
    ).withColumns({"sigla": T.issuer_code(F.col("_orgao")), "_limpo": T.clean(F.col("corpo"))})
    read = first.withColumns(
        {
            "relacoes": R.citations(T.clean(F.col("ementa")), F.col("_limpo"), F.col("sigla"), F.col("_numero"), cleaned=True),
            "resumo": F.when(F.length(F.trim("ementa")) < 12, T.inferred_summary(F.col("_limpo"), cleaned=True)),
            "pessoas": R.people(F.col("trecho")),
            "funcoes": F.when(F.col("trecho").rlike(r"(?iu)(?=[cf])(?:fun[çc]|cargo)"), T.role_events(R.role_mentions(F.col("trecho")))).otherwise(F.array().cast(R.ROLE)),
        }
    )
    main = T.first_or_blank(F.col("processos_sei"))
    pivots = [relation_pivot(F.col("relacoes"), labels).alias(name) for name, labels in V.RELATION_GROUPS.items()]
    return read.select(
        "arquivo", "bs_numero", "bs_data", T.section(F.col("contexto")).alias("secao"), T.page(F.col("contexto")).alias("pagina"), "posicao",
        F.col("_tipo").alias("tipo"), F.col("_orgao").alias("orgao"), "sigla", F.col("_numero").alias("numero"), "ano",
        T.long_date(F.col("dia"), F.col("mes"), F.col("ano")).alias("data_ato"),
        T.identifier(F.col("_tipo"), F.col("sigla"), F.col("_numero"), F.col("ano")).alias("identificador"),
        T.nature(F.col("ementa")).alias("tipo_acao"), "ementa",
        F.coalesce("resumo.ementa_resumo", F.lit("")).alias("ementa_resumo"), F.coalesce("resumo.ementa_inferida", F.lit(False)).alias("ementa_inferida"),
        T.signer(F.col("trecho")).alias("signatario"), "processos_sei", main.alias("processo_sei_principal"), "sei_documento",
        T.link(process_base, main).alias("link_sei_processo"), T.link(document_base, F.col("sei_documento")).alias("link_sei_documento"),
        "relacoes", *pivots, T.registrations(F.col("trecho")).alias("siapes"), "pessoas", "funcoes", T.search_body(F.col("_limpo"), cleaned=True).alias("corpo_busca"),
    )


def relation_pivot(relations, labels: list[str]):
    """Cited acts of the given relations, joined by '; '."""
    chosen = F.filter(relations, lambda r: r["relacao"].isin(labels))
    return F.array_join(F.transform(chosen, lambda r: r["ato_citado"]), "; ")


def extract(pages: DataFrame, process_base: str = "", document_base: str = "") -> DataFrame:
    return act_records(segments(bulletins(pages)), process_base, document_base)


def without_summary(acts: DataFrame) -> DataFrame:
    """Acts left for another way of summing up: no formal summary, none inferred, and a text to work on."""
    short = F.length(F.trim(F.coalesce("ementa", F.lit("")))) < 12
    return acts.where(short & ~F.coalesce("ementa_inferida", F.lit(False)) & (F.trim(F.coalesce("corpo_busca", F.lit(""))) != ""))


def run_summary(acts: DataFrame) -> DataFrame:
    """(atos, relacoes, com_processo) of an extraction."""
    return acts.agg(
        F.count(F.lit(1)).alias("atos"), F.coalesce(F.sum(F.size("relacoes")), F.lit(0)).alias("relacoes"), F.count_if(F.col("processo_sei_principal") != "").alias("com_processo")
    )


def parse_loose(texts: DataFrame, text_col: str = "texto", this_year: int = 2026) -> DataFrame:
    """Records of pasted texts, by looser rules than bulletins: columns added to ``texts``."""
    t = F.trim(F.regexp_replace(text_col, r"\s+", " "))
    # Kinds in the order they are looked for.
    kinds = {
        "Determinação de Serviço": "determina[çc][ãa]o de servi[çc]o", "Instrução Normativa": "instru[çc][ãa]o normativa",
        "Norma de Serviço": "norma de servi[çc]o", "Resolução": "resolu[çc][ãa]o", "Portaria": "portaria", "Decisão": "decis[ãa]o",
        "Edital": "edital", "Comunicado": "comunicado",
    }
    kind = F.coalesce(*[F.when(t.rlike(f"(?iu){p}"), k) for k, p in kinds.items()], F.lit("Outro"))
    issuer = T.filled(F.regexp_extract(t, r"(?iu)(?:servi[çc]o|resolu[çc][ãa]o|portaria|normativa|decis[ãa]o)\s+([A-ZÀ-Ú][A-ZÀ-Ú0-9/().]{1,30}(?:/" + V.ACRONYM + r")?)\s*n[ºo°.]", 1))
    written = r"(?iu)de\s+(\d{1,2})\s+de\s+([a-zà-ú]+)\s+de\s+(\d{4})"
    date = T.long_date(*(F.regexp_extract(t, written, i) for i in (1, 2, 3)))
    year = F.coalesce(*[T.filled(F.regexp_extract(t, p, g)) for p, g in ((written, 3), (r"/(\d{4})\b", 1), (r"\b(20\d{2})\b", 1))]).cast("int")
    number = r"(?iu)n[ºo°\.]*\s*([\d.]+(?:\s?[A-Z]{1,4})?)"
    after = F.coalesce(F.when(t.rlike(written), F.get(F.split(t, written, 2), F.lit(1))), F.when(t.rlike(number), F.get(F.split(t, number, 2), F.lit(1))), t)
    ends = r"(?iu)" + V.SUMMARY_ENDS.replace(r"\bA\s+DIRETORA\b", r"\bA\s+DIRETORA").replace(r"\bO\s+DIRETOR\b", r"\bO\s+DIRETOR")
    formal = F.left(F.trim(F.regexp_replace(F.get(F.split(after, ends, 2), F.lit(0)), r"^[\s.,:–-]+", "")), F.lit(400))
    summary = F.coalesce(F.when(after.rlike(ends), T.filled(formal)), F.trim(F.left(after, F.lit(220))))
    cited = (
        r"(?iu)(altera|revoga|torna sem efeito|substitui|retifica|republica|complementa|regulamenta)[^.;]{0,60}?"
        r"(portaria|resolu[çc][ãa]o|determina[çc][ãa]o de servi[çc]o|dts|instru[çc][ãa]o normativa|decis[ãa]o)\s+([A-ZÀ-Ú0-9/().]{0,25})?\s*n[ºo°\.]*\s*([\d.]+)"
    )
    groups = F.arrays_zip(*[F.regexp_extract_all(t, F.lit(cited), F.lit(i)).alias(f"g{i}") for i in (1, 2, 3, 4)])
    verb = lambda r: F.lower(r["g1"])
    relations = F.transform(
        F.slice(groups, 1, 12),
        lambda r: F.struct(
            F.when(verb(r).isin("revoga", "torna sem efeito"), "Revoga")
            .when(verb(r).isin("substitui", "retifica", "republica", "altera"), "Altera")
            .when(verb(r) == "regulamenta", "Regulamenta")
            .otherwise("Complementa")
            .alias("tipoRelacao"),
            F.concat_ws(" ", F.regexp_replace(r["g2"], "(?i)dts", "DTS"), T.filled(F.trim(r["g3"])), F.concat(F.lit("nº "), r["g4"])).alias("atoDestino"),
        ),
    )
    shown = F.coalesce(F.trim(F.regexp_replace(issuer, rf"(?i)/{V.ACRONYM}$", "")), F.lit("Reitoria"))
    action = F.regexp_extract(summary, r"(?iu)^(Altera|Revoga|Designa|Designar|Disp[õo]e|Aprova|Institui|Nomeia|Exonera|Concede|Cria|Estabelece|Prorroga|Retifica|Torna)", 1)
    return texts.select(
        "*", kind.alias("tipoAto"), F.trim(F.regexp_extract(t, number, 1)).alias("numero"), F.coalesce(year, F.lit(this_year)).alias("ano"),
        date.alias("dataAssinatura"), shown.alias("orgaoEmissor"), summary.alias("ementa"),
        F.when(t.rlike(V.PROCESS), T.process_number(F.regexp_extract(t, V.PROCESS, 0))).alias("processoSei"), relations.alias("relacoes"),
        F.slice(F.array_distinct(F.filter(F.concat(F.array(action), F.split(shown, "[/ ]"), F.array(kind)), lambda x: x != "")), 1, 6).alias("tags"),
        F.coalesce(T.filled(summary), F.lit(f"Ato administrativo da {V.ACRONYM}.")).alias("conteudoResumido"),
    )


def form_defaults(rows: DataFrame) -> DataFrame:
    """Records typed into a form (numero, orgaoEmissor, ementa, tags as one text, ...): the required ones, with defaults filled in."""
    need = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("numero", "orgaoEmissor", "ementa")]
    split = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    return rows.where(need[0] & need[1] & need[2]).withColumns(
        {
            "tags": split,
            "processoSei": T.filled(F.trim("processoSei")),
            "conteudoResumido": F.coalesce(T.filled(F.col("conteudoResumido")), F.concat(F.left("ementa", F.lit(150)), F.lit("..."))),
        }
    )
