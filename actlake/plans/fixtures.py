"""Small invented inputs as SQL VALUES, which Spark and the comparing engine read alike, and the driver tables as act tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def values(rows: list[tuple], columns: str) -> str:
    def one(v: object) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"


ACTS = f"""SELECT id, tipo, sigla, numero, CAST(data AS DATE) AS data_ato FROM ({values([
    ("a1", "Portaria", "Reitoria", "1004", "2026-06-10"), ("a2", "Portaria", "Reitoria", "26", "2017-04-18"), ("a3", "Portaria", "", "026", "2018-01-01"),
    ("a4", "Resolução", "CUV", "104", "2019-05-05"), ("a5", "Resolução", "CEPEX", "104", "2019-05-05"), ("a6", "Determinação de Serviço", "GES/INF", "16", "2025-08-22"),
    ("a7", "Portaria", "Reitoria", "65.784", "2019-11-29"), ("a8", "Portaria", "PROGEPE", "77", None), ("a9", "Portaria", "Reitoria", "2000", "2026-07-01"),
], "id, tipo, sigla, numero, data")}) AS x"""
RELATIONS = values([
    ("r1", "a1", "Revoga", "Portaria nº 026"), ("r2", "a1", "Altera", "Portaria nº 26"), ("r3", "a1", "Revoga", "Resolução CUV nº 104"), ("r4", "a1", "Revoga", "Resolução nº 104"),
    ("r5", "a1", "Altera", "Resolução CEPEX/UFF nº 104"), ("r6", "a1", "Revoga", "DTS GES/INF nº 16"), ("r7", "a1", "Altera", "DTS XYZ nº 16"), ("r8", "a1", "Revoga", "Portaria nº 65784"),
    ("r9", "a1", "Revoga", "Portaria nº 65.784"), ("r10", "a1", "Altera", "Portaria nº 2000"), ("r11", "a1", "Revoga", "Portaria MEC nº 77"), ("r12", "a1", "Altera", "Portaria PROGEPE nº 77"),
    ("r13", "a1", "Revoga", "Portaria nº 1004"), ("r14", "a1", "Complementa", "Lei 8112"), ("r15", "a1", "Complementa", "Portaria nº 12/2026"), ("r16", "a1", "Revoga", "instrução de serviço DAP nº 3"),
], "rel_id, ato_id, tipo_relacao, ato_destino_texto")
ROLES = values([
    ("b1", "2024-01-10", "designar", "Chefe", "Departamento A", "departamento a", "111111"), ("b2", "2025-02-01", "designar", "Chefe", "Departamento A", "departamento a", "222222"),
    ("b3", "2025-02-01", "dispensar", "Chefe", "Departamento A", "departamento a", "111111"), ("b4", "2023-03-03", "designar", "Diretor", "Instituto B", "instituto b", "333333"),
    ("b5", "2024-04-04", "dispensar", "Diretor", "Instituto B", "instituto b", "333333"), ("b6", "2024-05-05", "designar", "Coordenador", "Curso C", "curso c", "444444"),
    ("b7", "2025-06-06", "designar", "Coordenador", "Curso D", "curso d", "444444"), ("b8", "2024-07-07", "designar", "Chefe", "Setor E", "setor e", "555555"),
    ("b9", "2024-07-07", "designar", "Chefe", "Setor E", "setor e", "666666"), ("c1", None, "designar", "Chefe", "Setor F", "setor f", "777777"),
], "ato_id, data, acao, cargo, unidade, unidade_chave, siape")
SCALARS = values([
    ("10 de JUNHO de 2026", "56-26.pdf", "23069 166342/2026 40", "RESOLUÇÃO", "DAP/UFF"), ("1 de marco de 2020", "007-2015.pdf", "23069.166342/2026-40", "", "CONJUNTA PROPLAN/DCF"),
    ("3 de foo de 2020", "108-25_RETIFICADO.pdf", " 23069-1 ", "Norma de  Serviço!", "- DAP/UFF"), ("31 de dezembro de 1999", "semnumero.pdf", "230691663422026409", "a--b", "DO FFE / ISNF"),
], "data, arquivo, processo, titulo, orgao")

BULLETIN = """UNIVERSIDADE FEDERAL FLUMINENSE – BOLETIM DE SERVIÇO ANO LX N° 108 10/06/2026 SEÇÃO II PÁG. 012
PORTARIA Nº 1004, DE 10 DE JUNHO DE 2026
Altera a Portaria PROEX nº 65.784 e dá outras providências.
O REITOR DA UNIVERSIDADE, no uso de suas atribuições, tendo em vista o processo 23069.166342/2026-40,
RESOLVE: Art. 1º Revogar a Resolução CUV nº 104, publicada no BS nº 102, de 01/09/2025.
FULANO DE TAL DOS SANTOS
REITOR
(3442574)
DETERMINAÇÃO DE SERVIÇO - GES/UFF N.º 16, de 2 de marco de 2025
Considerando o disposto, resolve: Art. 1º Designar, a pedido, MARIA DA SILVA FRÜHAUF, Professora, matrícula SIAPE nº 1642620, para a função de Chefe do Departamento de Física, código FG-1, a partir de 01/03/2025.
PORTARIA PROPLAN/UFF Nº 17, DE 3 DE MARÇO DE 2025
resolve: dispensar JOÃO SANT'ANNA, SIAPE 2364493, da função de Coordenador do Curso de Graduação em Química, conforme a Portaria nº 12.
"""


def sql(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Orders stand for acts, line items for relations; the same projection serves both engines.
ORDER_ACTS = """SELECT o_orderkey AS id, o_orderpriority AS tipo, substr(o_orderpriority, 1, 1) AS sigla, CAST(o_custkey AS {text}) AS numero,
  CAST(year(o_orderdate) AS INT) AS ano, CAST(o_orderdate AS DATE) AS data_ato, o_orderpriority AS ementa, '' AS conteudo_resumido,
  CASE o_orderstatus WHEN 'O' THEN 'Ativo' WHEN 'P' THEN 'Alterado' ELSE 'Revogado' END AS status,
  CASE WHEN o_totalprice > 200000 THEN CAST(o_custkey AS {text}) END AS processo_sei FROM orders"""
ITEM_RELATIONS = """SELECT l_orderkey * 10 + l_linenumber AS rel_id, l_orderkey AS ato_id,
  CASE l_returnflag WHEN 'R' THEN 'Revoga' WHEN 'A' THEN 'Altera' ELSE 'Complementa' END AS tipo_relacao,
  CASE WHEN l_linenumber < 4 THEN l_partkey END AS ato_destino_id FROM lineitem"""
EVENT_ROLES = """SELECT event_id AS ato_id, CAST(ts AS DATE) AS data_ato, CASE WHEN event_type = 'error' THEN 'dispensar' ELSE 'designar' END AS acao,
  event_type AS cargo, CAST(user_id % 50 AS {text}) AS unidade, CAST(user_id % 50 AS {text}) AS unidade_chave, CAST(user_id AS {text}) AS siape,
  CAST(NULL AS {text}) AS nome FROM events"""


def of_tables(spark: SparkSession, sf_dir: str, query: str, *names: str) -> DataFrame:
    """One of the projections above over the driver's tables."""
    for n in names:
        query = query.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(query.replace("{text}", "STRING"), **{n: table(spark, sf_dir, n) for n in names})


def duck(query: str) -> str:
    return query.replace("{text}", "VARCHAR")


#: Parts of an act for each order; bulletins are written from them, so that what is read back can be stated from the parts.
ORDER_PARTS = """SELECT o_orderkey AS k, CAST(o_custkey % 400 + 1 AS {text}) AS livro, CAST(year(o_orderdate) AS {text}) AS ano,
  CAST(o_custkey % 400 + 1 AS {text}) || '-' || CAST(year(o_orderdate) AS {text}) || '.pdf' AS arquivo, CAST(day(o_orderdate) AS {text}) AS dia,
  lpad(CAST(month(o_orderdate) AS {text}), 2, '0') AS mes,
  CASE month(o_orderdate) WHEN 1 THEN 'JANEIRO' WHEN 2 THEN 'FEVEREIRO' WHEN 3 THEN 'MARÇO' WHEN 4 THEN 'ABRIL' WHEN 5 THEN 'MAIO' WHEN 6 THEN 'JUNHO'
    WHEN 7 THEN 'JULHO' WHEN 8 THEN 'AGOSTO' WHEN 9 THEN 'SETEMBRO' WHEN 10 THEN 'OUTUBRO' WHEN 11 THEN 'NOVEMBRO' ELSE 'DEZEMBRO' END AS mes_escrito,
  CASE o_orderkey % 4 WHEN 0 THEN 'PROEX' WHEN 1 THEN 'GES' WHEN 2 THEN 'PROGEPE' ELSE 'SDC' END AS orgao, CAST(o_orderkey AS {text}) AS numero,
  '23069.' || lpad(CAST(o_orderkey % 1000000 AS {text}), 6, '0') || '/' || CAST(year(o_orderdate) AS {text}) || '-' || lpad(CAST(o_orderkey % 100 AS {text}), 2, '0') AS processo,
  CAST(1000000 + o_custkey AS {text}) AS siape, CAST(2000000 + o_orderkey AS {text}) AS documento, CAST(o_custkey % 5000 + 1 AS {text}) AS citado, o_orderkey % 3 AS forma,
  CASE o_custkey % 4 WHEN 0 THEN 'MARIA DA SILVA FRÜHAUF' WHEN 1 THEN 'JOÃO SANT''ANNA' WHEN 2 THEN 'ANA LÚCIA DOS REIS' ELSE 'PEDRO d''ÁVILA NETO' END AS pessoa,
  CASE o_custkey % 4 WHEN 0 THEN 'Maria da Silva Frühauf' WHEN 1 THEN 'João Sant''Anna' WHEN 2 THEN 'Ana Lúcia dos Reis' ELSE 'Pedro D''Ávila Neto' END AS nome,
  CASE o_orderkey % 5 WHEN 0 THEN 'Física' WHEN 1 THEN 'Química' WHEN 2 THEN 'Letras' WHEN 3 THEN 'Ciência da Computação' ELSE 'Obras' END AS area,
  CASE o_orderkey % 5 WHEN 0 THEN 'fisica' WHEN 1 THEN 'quimica' WHEN 2 THEN 'letras' WHEN 3 THEN 'ciencia da computacao' ELSE 'obras' END AS area_chave FROM orders"""
PARTS_AS_PAGES = """SELECT arquivo, CAST(k AS INT) AS page_no, 'UNIVERSIDADE FEDERAL FLUMINENSE – BOLETIM DE SERVIÇO ANO LX N° ' || livro || ' 10/06/' || ano || ' SEÇÃO II PÁG. 012' || chr(10)
  || 'PORTARIA ' || orgao || '/UFF Nº ' || numero || ', DE ' || dia || ' DE ' || mes_escrito || ' DE ' || ano || chr(10)
  || CASE forma WHEN 0 THEN 'Altera a Portaria PROAD nº ' || citado || ' e dá outras providências.' || chr(10) || 'O REITOR, tendo em vista o processo ' || processo || ',' || chr(10)
      || 'RESOLVE: Art. 1º Revogar a Resolução CUV nº ' || citado || ', publicada no BS nº 102, de 01/09/2025.'
    WHEN 1 THEN 'Considerando o que consta do processo ' || processo || ',' || chr(10) || 'RESOLVE: Art. 1º Designar, a pedido, ' || pessoa || ', Professora, matrícula SIAPE nº ' || siape
      || ', para a função de Chefe do Departamento de ' || area || ', código FG-1, a partir de 01/03/2025.'
    ELSE 'Considerando o que consta do processo ' || processo || ',' || chr(10) || 'RESOLVE: dispensar ' || pessoa || ', SIAPE ' || siape || ', da função de Coordenador do Curso de Graduação em ' || area
      || ', conforme a Portaria nº ' || citado || ', a contar desta data.' END
  || chr(10) || 'FULANO DE TAL DOS SANTOS' || chr(10) || 'REITOR' || chr(10) || '(' || documento || ')' || chr(10) AS text FROM {parts}"""
