"""Where records go: tables as files, and the formats that pages and spreadsheets read. Writers write a folder of part files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlake.functions import vocabulary as V

BOM = "﻿"


def table_export(acts: DataFrame, path: str) -> None:
    """Act records as CSV with ';' and the headings of the table, quoted where needed."""
    rows = acts.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(h) for c, h in V.TABLE_COLUMNS.items()])
    rows.write.mode("overwrite").csv(path, sep=";", header=True, quote='"', escape='"', emptyValue="")


def relations_sheet(acts: DataFrame) -> DataFrame:
    """One row for each relation of an act, the second sheet of the workbook."""
    return acts.select("identificador", "arquivo", F.inline("relacoes"))


def envelope_text(acts: DataFrame, books: DataFrame, made_at: str) -> DataFrame:
    """(value): the envelope of a load as one JSON text. For loads of bounded size; larger ones are written as tables."""
    rows = acts.agg(F.collect_list(F.struct(*acts.columns)).alias("atos"), F.count(F.lit(1)).alias("total"))
    files = books.agg(F.collect_list(F.struct(*books.columns)).alias("boletins"))
    both = rows.withColumn("_k", F.lit(1)).join(F.broadcast(files.withColumn("_k", F.lit(1))), "_k")
    return both.select(F.to_json(F.struct(F.lit(made_at).alias("gerado_em"), "boletins", "total", "atos")).alias("value"))


def envelope(acts: DataFrame, books: DataFrame, made_at: str, path: str) -> None:
    envelope_text(acts, books, made_at).write.mode("overwrite").text(path)


def script(acts: DataFrame, books: DataFrame, made_at: str, path: str, name: str = "window.DADOS") -> None:
    """The envelope as a script that a page can load from a disk."""
    envelope_text(acts, books, made_at).select(F.concat(F.lit(f"{name} = "), "value", F.lit(";"))).write.mode("overwrite").text(path)


def portal_array_text(records: DataFrame) -> DataFrame:
    """(value): portal records as one JSON array in input order, for loads of bounded size."""
    columns = [c for c in records.columns if c != "_idx"]
    rows = records.agg(F.array_sort(F.collect_list(F.struct("_idx", F.to_json(F.struct(*columns)).alias("j")))).alias("r"))
    return rows.select(F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["j"]), ",\n"), F.lit("]")).alias("value"))


def portal_array(records: DataFrame, path: str) -> None:
    portal_array_text(records).write.mode("overwrite").text(path)


def sheet_rows(records: DataFrame) -> DataFrame:
    """A filtered list as the spreadsheet exports it: 13 columns, tags joined, relations as JSON."""
    values = ["tipoAto", "numero", F.col("ano").cast("string"), "dataAssinatura", "orgaoEmissor", "ementa", "processoSei", "status", "boletimNumero", "linkBoletim", F.array_join("tags", ","), "conteudoResumido", F.to_json("relacoes")]
    return records.select(*[F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit("")).alias(h) for v, h in zip(values, V.SHEET_COLUMNS, strict=True)])


def sheet(records: DataFrame, path: str) -> None:
    rows = sheet_rows(records)
    rows = rows.withColumnRenamed(rows.columns[0], BOM + rows.columns[0])
    rows.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', emptyValue="")


def quoted(c: Column) -> Column:
    """A value in SQL: NULL for null and '', quotes and backslashes escaped, line breaks as blanks."""
    s = F.regexp_replace(F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), r"[\r\n]+", " ")
    return F.when(F.coalesce(c.cast("string"), F.lit("")) == "", "NULL").otherwise(F.concat(F.lit("'"), s, F.lit("'")))


def insert_statements(rows: DataFrame, table: str, key: list[str], batch: int = 200, update: list[str] | None = None) -> DataFrame:
    """(value): INSERT statements of at most ``batch`` rows each, in the order of ``key``; with ``update``, an upsert by these keys."""
    columns = rows.columns
    tuple_ = F.concat(F.lit("("), F.concat_ws(",", *[quoted(F.col(c)) for c in columns]), F.lit(")"))
    made = rows.select(tuple_.alias("t"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
    ordered = made.repartitionByRange(*[F.col(f"_k{i}") for i in range(len(key))]).sortWithinPartitions(*[f"_k{i}" for i in range(len(key))])
    at = ordered.withColumn("_n", F.monotonically_increasing_id())  # the partition in the upper bits, the place in the lower
    groups = at.groupBy(F.shiftright("_n", 33).alias("p"), F.floor(F.col("_n") % (1 << 33) / batch).alias("b")).agg(F.array_sort(F.collect_list(F.struct("_n", "t"))).alias("r"))
    names = ",".join(f"`{c}`" for c in columns)
    tail = " ON DUPLICATE KEY UPDATE " + ",".join(f"`{c}`=VALUES(`{c}`)" for c in columns if c not in update) if update else ""
    return groups.select(F.concat(F.lit(f"INSERT INTO `{table}` ({names}) VALUES\n"), F.array_join(F.transform("r", lambda x: x["t"]), ",\n"), F.lit(f"{tail};")).alias("value"))


def dump(tables: dict[str, tuple[DataFrame, list[str], int]], path: str, suffix: str | None = None) -> None:
    """A compressed SQL dump, a folder for each table (frame, key, batch): all rows anew, or only one year's, which go first."""
    for name, (rows, key, batch) in tables.items():
        column = "id" if name in ("atos", "boletins") else "ato_id"
        clear = f"DELETE FROM `{name}`" + (f" WHERE `{column}` REGEXP '^[0-9]+-{suffix}[^0-9]'" if suffix else "") + ";"
        first = rows.sparkSession.createDataFrame([(clear,)], "value string")
        first.coalesce(1).write.mode("overwrite").text(f"{path}/{name}/0-clear", compression="gzip")
        insert_statements(rows, name, key, batch).write.mode("overwrite").text(f"{path}/{name}/1-rows", compression="gzip")


def tables(frames: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet below ``path``; the files of a table are replaced when all of it is written."""
    for name, rows in frames.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def year_tables(rows: DataFrame, path: str, year: Column) -> None:
    """A table partitioned by year; a load replaces the years it has and leaves the others."""
    rows.withColumn("_ano", year).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_ano").parquet(path)


def holders_page(holders: DataFrame, path: str, title: str = "") -> None:
    """Office holders as the rows of an HTML table, values escaped."""
    escape = lambda c: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], F.coalesce(c.cast("string"), F.lit("")))
    cells = [F.concat(F.lit("<td>"), escape(F.col(c)), F.lit("</td>")) for c in ("unidade", "cargo", "nome", "siape", "desde")]
    holders.orderBy("unidade").select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value")).write.mode("overwrite").text(path)

