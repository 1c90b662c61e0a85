"""Citations resolved across all acts, and the validity status that follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actlake.functions import text as T


def resolve_citations(acts: DataFrame, relations: DataFrame, self_links: bool = True) -> DataFrame:
    """(rel_id, desfecho, ato_destino_id) of each relation (rel_id, ato_id, ato_destino_texto) with a text.

    ``acts``: id, tipo, sigla, numero, data_ato. A citation of an external agency is 'externo', one that doesn't read as an act is
    'sem_parse'. Otherwise candidates are acts of its kind whose number is one of its variants, not newer than the citing act
    (undated ones pass): none is 'nao_encontrado', one is 'ok'; of several exactly one must be of the cited issuer, else 'ambiguo'.
    Acts and distinct citations of a kind and number are put in one order by date, in which running counts tell each citation
    how many acts it may mean and which; nothing is made for a pair of a citation and an act.
    """
    found = answered(acts, relations.select("rel_id", "ato_id", "ato_destino_texto"), self_links).where("desfecho IS NOT NULL")
    return found.select("rel_id", "ato_id", "desfecho", "ato_destino_id").dropDuplicates(["rel_id", "ato_id"]).drop("ato_id")


def answered(acts: DataFrame, relations: DataFrame, self_links: bool = True) -> DataFrame:
    """``relations`` with desfecho and ato_destino_id as ``resolve_citations`` tells them, and the kind and numbers that each may mean.

    Relations without a text or of an unknown act have nulls there. Each text is read once and resolved once for each date of
    citing acts, not for each relation. The kind and numbers (alvo_tipo, alvo_numeros) are null for external citations and unreadable ones.
    """
    acts = acts.select("id", "tipo", "numero", "data_ato", T.without_institution(F.col("sigla")).alias("_sigla"))
    own = [F.struct("tipo", "numero", F.col("_sigla").alias("sigla")).alias("_own")]
    origin = acts.select(F.col("id").alias("ato_id"), F.col("data_ato").alias("_origem"), F.lit(True).alias("_known"), *([] if self_links else own))
    cited = relations.withColumn("_texto", F.coalesce("ato_destino_texto", F.lit(""))).join(origin, "ato_id", "left")
    asks = cited.where("_known AND _texto != ''").select("_texto", "_origem").distinct()
    text = F.col("_texto")
    read = asks.select("_texto").distinct().select("_texto", T.is_external(text).alias("_externo"), T.citation_target(text).alias("_alvo"))
    read = read.withColumn("_numeros", F.when(~F.col("_externo") & F.col("_alvo").isNotNull(), T.number_variants(F.col("_alvo.numero"))))
    read = read.select("_texto", "_externo", F.col("_alvo").isNull().alias("_sem_parse"), F.col("_alvo.tipo").alias("tipo"), T.without_institution(F.col("_alvo.sigla")).alias("_sigla"), "_numeros")
    named = asks.join(read, "_texto").withColumn("numero", F.explode_outer("_numeros"))
    found = _possible_acts(acts, named.where("numero IS NOT NULL").select("tipo", "numero", "_sigla", "_origem").distinct())
    match = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in ("tipo", "numero", "_sigla", "_origem")]
    met = named.alias("c").join(found.alias("f"), match, "left")
    # an act has one number, so no two variants of a citation meet the same act
    best = met.groupBy("c._texto", "c._origem").agg(
        F.first("_externo").alias("_externo"), F.first("_sem_parse").alias("_sem_parse"), F.first("c.tipo").alias("_tipo"), F.first("c._sigla").alias("_sigla"), F.first("_numeros").alias("_numeros"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.coalesce(F.sum("n_same"), F.lit(0)).alias("n_same"), F.min("same_low").alias("same_low"), F.max("same_high").alias("same_high"),
    )
    each = cited.alias("r").join(best.alias("b"), (F.col("r._texto") == F.col("b._texto")) & F.col("r._origem").eqNullSafe(F.col("b._origem")) & F.col("r._known"), "left")
    n, n_same = F.col("n"), F.col("n_same")
    if not self_links:
        itself = F.coalesce((F.col("_own.tipo") == F.col("_tipo")) & F.array_contains("_numeros", F.col("_own.numero")), F.lit(False))
        n, n_same = n - itself.cast("int"), n_same - (itself & F.coalesce((F.col("b._sigla") != "") & (F.col("_own.sigla") == F.col("b._sigla")), F.lit(False))).cast("int")
    # one act is left: the largest id, but for a citing act that doesn't count itself
    one = lambda low, high: F.col(high) if self_links else F.when(F.col(high) == F.col("ato_id"), F.col(low)).otherwise(F.col(high))
    target = F.when(n == 1, one("low", "high")).when(n_same == 1, one("same_low", "same_high"))
    outcome = (
        F.when(F.col("_externo"), "externo")
        .when(F.col("_sem_parse"), "sem_parse")
        .when(n == 0, "nao_encontrado")
        .when(target.isNotNull(), "ok")
        .when(n.isNotNull(), "ambiguo")
    )
    aim = [F.when(F.col("_numeros").isNotNull(), F.col("_tipo")).alias("alvo_tipo"), F.col("_numeros").alias("alvo_numeros")]
    return each.select(*[F.col(f"r.{c}") for c in relations.columns], outcome.alias("desfecho"), target.alias("ato_destino_id"), *aim)


def _possible_acts(acts: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (tipo, numero, _sigla, _origem) with the number and the least and largest id of the acts that each may mean, and
    of those of its issuer.

    Acts without a date come first, citations without one last; of one date acts come first. Acts are counted by date and issuer
    before they are shuffled, so even a kind and number that very many acts have makes few rows here.
    """
    known = acts.groupBy("tipo", "numero", "_sigla", F.col("data_ato").alias("_d")).agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("i"), F.max("id").alias("j"))
    known = known.withColumns({"_part": F.col("_d").isNotNull().cast("int"), "_ask": F.lit(0)})
    asked = asked.withColumnRenamed("_origem", "_d").withColumns({"_part": F.when(F.col("_d").isNull(), 2).otherwise(1), "_ask": F.lit(1)})
    rows = known.unionByName(asked, allowMissingColumns=True)
    so_far = lambda *by: Window.partitionBy(*by).orderBy("_part", "_d", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every, same = so_far("tipo", "numero"), so_far("tipo", "numero", "_sigla")
    issued = F.col("_sigla") != ""
    rows = rows.select(
        "tipo", "numero", "_sigla", F.col("_d").alias("_origem"), "_ask", F.coalesce(F.sum("c").over(every), F.lit(0)).alias("n"), F.min("i").over(every).alias("low"), F.max("j").over(every).alias("high"),
        F.when(issued, F.sum("c").over(same)).alias("n_same"), F.when(issued, F.min("i").over(same)).alias("same_low"), F.when(issued, F.max("j").over(same)).alias("same_high"),
    )
    return rows.where("_ask = 1").drop("_ask").withColumn("n_same", F.coalesce("n_same", F.lit(0)))


def outcome_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("desfecho").agg(F.count(F.lit(1)).alias("n"))


def linked_relations(relations: DataFrame, resolved: DataFrame) -> DataFrame:
    """``relations`` with links and the external mark set anew; earlier links don't survive."""
    plain = relations.drop("ato_destino_id", "externo")
    return plain.join(resolved, "rel_id", "left").withColumn("externo", F.coalesce(F.col("desfecho") == "externo", F.lit(False))).drop("desfecho")


def edges(relations: DataFrame) -> DataFrame:
    """(ato_id, ato_destino_id, tipo_relacao) of the linked relations that revoke or alter."""
    return relations.where(F.col("tipo_relacao").isin("Revoga", "Altera") & F.col("ato_destino_id").isNotNull()).select("ato_id", "ato_destino_id", "tipo_relacao")


def validity(acts: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, status) of every act from its in-edges (ato_id, ato_destino_id, tipo_relacao) of acts no older than itself.

    Any that revokes makes it revoked, else any that alters altered; all others are active, whatever they were.
    """
    found = edges(relations).join(acts.select(F.col("id").alias("ato_id"), F.col("data_ato").alias("_o")), "ato_id")
    found = found.join(acts.select(F.col("id").alias("ato_destino_id"), F.col("data_ato").alias("_a")), "ato_destino_id")
    found = found.where(F.col("_o").isNull() | F.col("_a").isNull() | (F.col("_o") >= F.col("_a")))
    found = found.groupBy(F.col("ato_destino_id").alias("id")).agg(F.count_if(F.col("tipo_relacao") == "Revoga").alias("n"))
    status = F.when(F.col("n") > 0, "Revogado").when(F.col("n") == 0, "Alterado").otherwise("Ativo")
    return acts.select("id").join(found, "id", "left").select("id", status.alias("status"))


def with_status(acts: DataFrame, status: DataFrame) -> DataFrame:
    return acts.drop("status").join(status, "id", "left").withColumn("status", F.coalesce("status", F.lit("Ativo")))


def first_link(relations: DataFrame, links: DataFrame, last: bool = False) -> DataFrame:
    """``relations`` (ato_id, tipo_relacao) with the target of the first (or last) link of that act and kind, by ``ordem``.

    All relations of one act and kind share that target, as static data keeps no more; ``links``: ato_id, tipo_relacao, alvo, ordem.
    """
    pick = F.max_by if last else F.min_by
    target = links.groupBy("ato_id", "tipo_relacao").agg(pick("alvo", "ordem").alias("ato_destino_id"))
    return relations.join(target, ["ato_id", "tipo_relacao"], "left")


def verdict(acts: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, veredito, causa, n_altera): revoked with the first act that revokes (by ``ordem``), else altered, else as stored."""
    found = edges.groupBy(F.col("ato_destino_id").alias("id")).agg(
        F.min_by("ato_id", F.when(F.col("tipo_relacao") == "Revoga", F.col("ordem"))).alias("_by"), F.count_if(F.col("tipo_relacao") == "Revoga").alias("_r"), F.count_if(F.col("tipo_relacao") == "Altera").alias("n_altera")
    )
    rows = acts.select("id", "status").join(found, "id", "left")
    word = F.when(F.col("_r") > 0, "revogado").when(F.col("n_altera") > 0, "alterado").when(F.col("status") == "Revogado", "revogado").otherwise("vigente")
    return rows.select("id", word.alias("veredito"), F.when(F.col("_r") > 0, F.col("_by")).alias("causa"), F.coalesce("n_altera", F.lit(0)).alias("n_altera"))


def first_fit(labels: DataFrame, acts: DataFrame) -> DataFrame:
    """(texto, id): the first act by ``ordem`` that a label names by number and issuer or kind.

    The number makes this an equi-join; without one in common a pair can't fit.
    """
    low = F.lower("texto")
    numbers = F.array_distinct(F.transform(F.regexp_extract_all("texto", F.lit(r"\d[\d.]*"), F.lit(0)), lambda x: F.regexp_replace(x, r"\D", "")))
    asked = labels.select("texto").distinct().withColumn("_nd", F.explode(numbers)).where("_nd != ''")
    code = F.get(F.split(F.lower(F.coalesce("orgaoEmissor", F.lit(""))), "[ /]"), F.lit(0))
    known = acts.select("id", "ordem", F.regexp_replace("numero", r"\D", "").alias("_nd"), code.alias("_code"), F.get(F.split(F.lower("tipoAto"), " "), F.lit(0)).alias("_word"))
    named = (F.col("_code") != "") & ~F.col("_code").isin("reitoria", T.V.ACRONYM.lower()) & F.contains(low, F.col("_code"))
    pairs = asked.join(known, "_nd").where(named | (F.contains(low, F.col("_word")) & (F.length("_nd") >= 3)))
    return pairs.groupBy("texto").agg(F.min_by("id", "ordem").alias("id"))
