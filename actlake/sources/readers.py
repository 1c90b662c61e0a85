"""Where bulletins and records come from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlake.functions import text as T
from actlake.sources import schemas as S


def bulletin_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(arquivo, content) of the PDF files in a folder, or of the files named."""
    reader = spark.read.format("binaryFile")
    rows = reader.option("pathGlobFilter", "*.pdf").load(path) if isinstance(path, str) else reader.load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("arquivo"), "content")


def pages(files: DataFrame, decode: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(arquivo, page_no, text) of PDF files. ``decode`` gives a file's page texts; PyMuPDF does where it is installed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = decode or _pdf_pages
        for b in batches:
            rows = [(name, i + 1, text) for name, content in zip(b["arquivo"], b["content"], strict=True) for i, text in enumerate(read(content))]
            yield pd.DataFrame(rows, columns=["arquivo", "page_no", "text"])

    return files.mapInPandas(run, "arquivo string, page_no int, text string")


def _pdf_pages(content: bytes) -> list[str]:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        return [p.get_text() for p in doc]


def envelope(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(acts with their place ``_idx``, bulletins) of a JSON file that is an envelope or a bare list of acts."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    whole = F.from_json("v", f"struct<boletins:array<{S.struct(S.BULLETIN)}>,atos:array<{S.struct(S.ACT)}>>")
    acts = F.when(F.startswith("v", F.lit("[")), F.from_json("v", f"array<{S.struct(S.ACT)}>")).otherwise(whole["atos"])
    rows = text.select(F.posexplode(acts).alias("_idx", "a")).select("_idx", "a.*")
    return rows, text.select(F.inline(whole["boletins"]))


def portal_array(spark: SparkSession, path: str) -> DataFrame:
    """Portal records of a JSON array, with their place ``_idx``; ValueError if the file is no array."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    if text.where(~F.startswith("v", F.lit("["))).limit(1).count():
        raise ValueError(f"{path}: not a JSON array")
    rows = text.select(F.posexplode(F.from_json("v", f"array<{S.struct(S.PORTAL)}>")).alias("_idx", "a"))
    return rows.select("_idx", "a.*")


def url_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(arquivo, url) of a JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("arquivo", "url"))


def links(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", base: str = "", host: str = "", suffix: str = r"\.pdf") -> DataFrame:
    """(id, ordem, url) of the links that end in ``suffix``: made absolute, each once a page, in order of appearance."""
    pattern = rf"""(?i)href=["']([^"']+{suffix})["']"""
    found = pages.select(F.col(id_col), F.posexplode(F.regexp_extract_all(html_col, F.lit(pattern), F.lit(1))).alias("ordem", "h"))
    h = F.col("h")
    url = (
        F.when(F.startswith(h, F.lit("//")), F.concat(F.lit("https:"), h))
        .when(F.startswith(h, F.lit("/")), F.concat(F.lit(host), h))
        .when(F.startswith(h, F.lit("http")), h)
        .otherwise(F.concat(F.lit(base.rstrip("/") + "/"), h))
    )
    return found.groupBy(id_col, url.alias("url")).agg(F.min("ordem").alias("ordem"))


def pending(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Entries of a manifest (arquivo, url) whose file isn't there yet, with an address that is safe to ask for."""
    return manifest.join(present.select("arquivo").distinct(), "arquivo", "left_anti").withColumn("url", T.safe_url(F.col("url")))


def sheet(spark: SparkSession, path: str, this_year: int = 2026, today: str | None = None) -> DataFrame:
    """Records of a spreadsheet export, as CSV with a heading or as a JSON array, with defaults for what is missing."""
    lead = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if not lead:
        raise ValueError(f"{path}: nothing to import")
    if lead[0].value.lstrip("﻿ \t").startswith("["):
        return portal_array(spark, path)
    rows = spark.read.schema(S.SHEET).csv(path, header=True, quote='"', escape='"', multiLine=True, enforceSchema=True, ignoreTrailingWhiteSpace=True)
    text = lambda c, other: F.coalesce(T.filled(F.col(c)), other if not isinstance(other, str) else F.lit(other))
    date = F.lit(today) if today else F.date_format(F.current_date(), "yyyy-MM-dd")
    number = F.col("ano").try_cast("int")
    return rows.withColumn("_idx", F.monotonically_increasing_id()).select(
        "_idx", F.concat(F.lit("imported-"), F.col("_idx").cast("string")).alias("id"), text("tipoAto", "Portaria").alias("tipoAto"), text("numero", "").alias("numero"),
        F.when(F.coalesce(number, F.lit(0)) != 0, number).otherwise(this_year).alias("ano"), text("dataAssinatura", date).alias("dataAssinatura"),
        text("orgaoEmissor", "Reitoria").alias("orgaoEmissor"), text("ementa", "").alias("ementa"), T.filled(F.col("processoSei")).alias("processoSei"),
        text("status", "Ativo").alias("status"), "boletimNumero", "linkBoletim", F.coalesce(F.split(T.filled(F.col("tags")), ","), F.array().cast("array<string>")).alias("tags"),
        text("conteudoResumido", "").alias("conteudoResumido"), F.coalesce(F.from_json("relacoes", S.SHEET_RELATION), F.array().cast(S.SHEET_RELATION)).alias("relacoes"),
    )


def sample_acts(spark: SparkSession) -> DataFrame:
    """A few invented portal records, the last resort of ``load_acts``."""
    rows = [
        ("ex-1", "Portaria", "100", 2024, "2024-03-01", "PROEX", "Institui comissão.", "Ativo"),
        ("ex-2", "Portaria", "101", 2024, "2024-05-02", "PROEX", "Altera a Portaria PROEX nº 100.", "Ativo"),
        ("ex-3", "Resolução", "7", 2023, "2023-09-09", "CEPEX", "Aprova regimento.", "Revogado"),
    ]
    return spark.createDataFrame(rows, "id string, tipoAto string, numero string, ano int, dataAssinatura string, orgaoEmissor string, ementa string, status string")


def load_acts(spark: SparkSession, *sources: Callable[[SparkSession], DataFrame]) -> DataFrame:
    """The first source that can be read and has a row, else the sample. A source is a function of the session."""
    for source in sources:
        try:
            rows = source(spark)
            if rows.take(1):
                return rows
        except Exception as e:  # any way a source can be unreachable
            spark.sparkContext._jvm.System.err.println(f"source skipped: {type(e).__name__}")
    return sample_acts(spark)


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with a place ``_idx`` that follows the given columns, for what depends on input order."""
    ranged = rows.orderBy(*by)
    return ranged.withColumn("_idx", F.monotonically_increasing_id())
