import random
import re

from pyspark.sql import functions as F

from actlake.functions import reading as R
from actlake.functions import text as T
from actlake.functions import vocabulary as V


def read(spark, text, f):
    """Rows of an array that ``f`` makes of a text."""
    return [r.asDict() for r in one(spark, text, f)]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


def test_scalars(spark):
    for v, r in {"10 de JUNHO de 2026": "2026-06-10", "1 de marco de 2020": "2020-03-01", "3 de foo de 2020": ""}.items():
        assert one(spark, v, T.long_date_of) == r
    for v, r in {"56-26.pdf": (56, 2026), "007-2015.pdf": (7, 2015), "108-25_RETIFICADO.pdf": (108, 2025), "x": (None, 0)}.items():
        assert tuple(one(spark, v, T.file_number_year)) == r
    assert one(spark, "23069 166342/2026 40", T.process_number) == "23069.166342/2026-40"
    assert one(spark, "RESOLUÇÃO", T.slug) == "resolu-o" and one(spark, "", T.slug) == "ato" and one(spark, None, T.slug) == "ato"
    assert one(spark, "26.001", T.number_variants) == ["26.001", "26001"] and one(spark, "026", T.number_variants) == ["026", "26"]
    assert one(spark, "2026-02-31", T.valid_date) is None and str(one(spark, "2026-02-01", T.valid_date)) == "2026-02-01"
    assert one(spark, "abc", T.year_or_default) == 2026


def test_ordinals_in_titles(spark):
    for mark in ("Nº", "N°", "N.º", "Nº.", "No"):
        assert len(read(spark, f"PORTARIA {mark} 54.919 de 11 de novembro de 2015\nresolve", R.segments)) == 1
    assert read(spark, "a portaria nº 8858, de 1 de maio de 2020", R.segments) == [] and read(spark, None, R.segments) == []


def test_issuers(spark):
    for v, r in {"- DAP/UFF": "DAP", "CONJUNTA PROPLAN/DCF": "PROPLAN/DCF", "DO FFE / ISNF": "FFE/ISNF", None: ""}.items():
        assert one(spark, v, T.issuer_code) == r
    for v, r in {"I.S.N.F.": "ISNF", "DE PESSOAL": "PORTARIA DE PESSOAL", "COMISSÃO ELEITORAL LOCAL": "COMISSÃO ELEITORAL LOCAL", "GES (INF)": "GES/INF"}.items():
        assert one(spark, v, T.display_issuer) == r


def test_identifier_and_summary(spark):
    row = spark.createDataFrame([("ORDEM DE SERVIÇO", "GES", "16", "2025")], "a string, b string, c string, d string")
    assert row.select(T.identifier(*map(F.col, "abcd")).alias("r")).first().r == "OS GES nº 16/2025"
    assert one(spark, ". Ementa: Altera a norma.\nRESOLVE: x", T.summary) == "Altera a norma."
    assert one(spark, "Designar servidores", T.nature) == "Designa"
    shown = one(spark, "", lambda c: T.shown_summary(c, F.lit("Designa X.")))
    assert tuple(shown) == ("Designa X.", True, "Designa X.")


def test_names_keep_letters_and_apostrophes(spark):
    text = "Designar ANA FRÜHAUF SANT'ANNA, Professora, SIAPE 1642620."
    assert read(spark, text, R.people) == [{"nome": "Ana Frühauf Sant'Anna", "siape": "1642620"}]
    assert read(spark, "Lotar LIma Dal'Magro, Mat. SIAPE 123456", R.people) == [{"nome": "Lima Dal'Magro", "siape": "123456"}]


def test_professions_are_no_names(spark):
    for profession in ("MÉDICA", "Nutricionista", "CONTADOR", "ASSISTENTE SOCIAL", "REITORA", "Professores de Letras"):
        assert read(spark, f"designar {profession} MARIA DA SILVA, SIAPE 1234567", R.people)[0]["nome"] == "Maria da Silva"
    # words of the list count whole: a surname may begin with one
    assert read(spark, "REITORADO CLARA LETRASSON, SIAPE 1234567", R.people)[0]["nome"] == "Reitorado Clara Letrasson"
    assert read(spark, "SIAPE 1234567, e o SIAPE 7654321, SIAPE 1234567", R.people) == [{"nome": "", "siape": "1234567"}, {"nome": "", "siape": "7654321"}]
    assert read(spark, None, R.people) == []


def role_events(spark, text):
    rows = spark.createDataFrame([(text,)], "v string").select(T.role_events(R.role_mentions(F.col("v"))).alias("r"))
    return [e.asDict() for e in rows.first().r]


def test_roles(spark):
    text = "resolve: exonerar JOÃO SILVA, SIAPE 1234567, da função de Vice-Diretor do Instituto de Química - IQ, a partir de hoje"
    assert role_events(spark, text) == [
        {"acao": "dispensar", "cargo": "Vice-Diretor", "unidade": "Instituto de Química - IQ", "unidade_chave": "instituto de quimica", "nome": "João Silva", "siape": "1234567"}
    ]
    assert role_events(spark, "designar ANA LIMA, SIAPE 1234567, como substituta eventual, para a função de Chefe do Setor X,") == []
    assert role_events(spark, "designar ANA LIMA, SIAPE 1234567, para a função de Chefe do referido Setor, e mais") == []
    twice = "designar ANA LIMA, SIAPE 1234567, para a função de Chefe do Setor de Obras, e a ANA LIMA, SIAPE 1234567, para o cargo de Chefe do SETOR DE OBRAS."
    assert len(role_events(spark, twice)) == 1 and role_events(spark, None) == []
    # without a verb the preposition decides
    assert role_events(spark, "ANA LIMA, SIAPE 1234567, da função de Coordenadora do Curso de Letras.")[0]["acao"] == "dispensar"


def test_inferred_summaries(spark):
    for body, said in {
        "O REITOR resolve: I - exonerar, a pedido, a partir de 04/08/2025, JOÃO DA SILVA do cargo X; publique-se": "Exonera João da Silva do cargo X.",
        "RESOLVE: Art. 1º Tornar sem efeito a Portaria nº 12. Art. 2º": "Torna sem efeito a Portaria nº 12.",
        "dispor sobre a COMISSÃO DE OBRAS E REFORMAS , nos termos da lei": "Dispõe sobre sobre a Comissão de Obras e Reformas.",
        "resolve: nada": "", "": "", "resolve: designar": "",
    }.items():
        found = one(spark, body, T.inferred_summary)
        assert tuple(found) == (said, said != "")
    assert tuple(one(spark, None, T.inferred_summary)) == ("", False)


def cited(spark, *values):
    rows = spark.createDataFrame([values], "a string, b string, c string, d string")
    return [(r.relacao, r.ato_citado, r.bs_origem, r.trecho) for r in rows.select(R.citations(*map(F.col, "abcd")).alias("r")).first().r]


def test_citations_take_the_nearest_verb(spark):
    found = cited(spark, "", "Conforme o exposto, revoga a Resolução CUV nº 026 e altera a Portaria nº 10.", "", "")
    assert [r[:2] for r in found] == [("REVOGA", "Resolução CUV nº 026"), ("ALTERA", "Portaria nº 10.")]
    assert cited(spark, None, None, None, None) == [] and cited(spark, "", "a Portaria nº 10 dorme", "", "") == []
    # a citation of the act itself, and one made twice
    assert [r[1] for r in cited(spark, "Revoga a Portaria CUV nº 1.0", "revoga a Portaria nº 5 e revoga a portaria  nº 5", "CUV", "10")] == ["Portaria nº 5"]
    assert [r[1] for r in cited(spark, "Revoga a Portaria GES nº 1.0", "revoga a Portaria nº 5 e revoga a portaria  nº 5", "CUV", "10")] == ["Portaria GES nº 1.0", "Portaria nº 5"]
    assert [r[2] for r in cited(spark, "", "revoga a Portaria nº 7, publicada no BS nº 102, de 01/09/2025", "", "")] == ["BS 102 de 01/09/2025"]


def test_windows_are_slices_of_the_text(spark):
    draw = random.Random(5)
    words = ["EDITAL N1DE 1 DE x DE 2020", "PORTARIA Nº 10, DE 1 DE MAIO DE 2020", "DTS n1", "portaria CUV nº 12", "SIAPE123456", "mat. SIAPE nº 1234567", "ção", "x" * 50, "\n", " "]
    texts = ["".join(draw.choice(words) + draw.choice(["", " "]) for _ in range(draw.choice([0, 1, 9, 150]))) for _ in range(60)]
    for pattern, before, after in ((R._TITLE, 400, 1200), (R._CITED, 75, 90), (R._REGISTRATION, 170, 0)):
        got = spark.createDataFrame(list(enumerate(texts)), "i int, v string").select("i", R.around(F.col("v"), pattern, before, after).alias("r")).collect()
        for i, rows in got:
            marks = [m.span() for m in re.finditer(pattern.replace("(?U)", ""), texts[i])]
            ends = [a for a, _ in marks[1:]] + [len(texts[i])]
            plain = [(texts[i][a:b], texts[i][max(0, a - before) : a], texts[i][b : b + after], texts[i][b:e]) for (a, b), e in zip(marks, ends)]  # noqa: B905
            assert [tuple(r) for r in rows] == plain


def test_a_unit_is_cited_without_what_follows(spark):
    for v, r in {
        "Setor de de Obras desta Universidade Federal": "Setor de Obras", "1ª Divisão  (DGF": "1a Divisão", "(Curso de Letras) –": "Curso de Letras", "Escola da UFF, x": "Escola", "": "", None: None,
    }.items():
        assert one(spark, v, T.unit_as_cited) == r


def test_a_long_act_is_read_whole(spark):
    text = "".join(f"designar ANA LIMA, SIAPE {1000000 + i}, para a função de Chefe do Setor {i}; " for i in range(1500))
    assert len(read(spark, text, R.people)) == 1500 and len(role_events(spark, text)) == 1500


def test_search_words(spark):
    assert T.query_tokens('+"de resolu"') == ["resolu"]
    assert one(spark, "Uma RESOLUÇÃO nova", lambda c: T.has_prefixes(c, ["resolu", "nov"])) is True
    assert one(spark, None, lambda c: T.has_prefixes(c, ["a"])) is False


def test_addresses(spark):
    assert one(spark, "https://h/60-22 RETIFICADO.pdf?a=b c", T.safe_url) == "https://h/60-22%20RETIFICADO.pdf?a=b%20c"


def test_pieces_of_a_text_also_around_the_mark_that_cuts_it(spark):
    texts = ["", "SIAPE 123456", "a SIAPE 123456b SIAPE nº 1234567", "none", "\x01 x SIAPE 123456\x01", "$0 \\ SIAPE 123456 $1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.pieces_of(F.col("t"), R._REGISTRATION).alias("p")).collect()
    for t, found in rows:
        assert "".join(found) == t and len(found) % 2 == 1
        assert [p.lstrip()[:5] for p in found[1::2]] == ["SIAPE"] * t.count("SIAPE")


def test_patterns_look_at_one_character_before_they_try_words(spark):
    texts = ["x \u0131i \u017fiape 123456 SIAPE 123456", "PORTARIA Nº 1, DE 1 DE MAIO DE 2020 a Portaria n\u00ba 5 e a IN nº 7 B", "da função de Chefe da Seção X, A DIRETORA Art. 1 resolve; a II - b", "designa MATR\u0130CULA SIAPE 1234567"]
    for flags, pattern in (("(?U)", V.TITLE), ("(?U)", V.CITED), ("(?U)", V.REGISTRATION), ("(?iU)", V.ROLE), ("", V.SUMMARY_ENDS), ("(?iuU)", V.OBJECT_END)):
        look = re.search(r"\(\?i:\(\?=\[[^]]+\]\)\)|\(\?=\[[^]]+\]\)", pattern)
        assert look and look.start() <= 4
        hits = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
        plain = flags + pattern.replace(look.group(), "", 1)
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select(hits(flags + pattern), hits(plain)).collect()
        assert all(a == b for a, b in rows) and any(a for a, _ in rows)


def test_windows_reach_over_any_number_of_matches(spark):
    # a window of 1,200 characters holds some 40 matches here, one of 400 some 13
    text = " ".join(f"PORTARIA Nº {i}, de 1 de maio de 2020{'.' * (i % 3)}" for i in range(60))
    at = [m.span() for m in re.finditer(r"PORTARIA Nº \d+, de 1 de maio de 2020", text)]
    found = read(spark, text, lambda c: R.around(c, R._TITLE, 400, 1200))
    assert [(w["antes"], w["depois"]) for w in found] == [(text[max(a - 400, 0) : a], text[b : b + 1200]) for a, b in at]
    # pieces that are too few for the first step, and enough for the second
    sparse = "".join(f"{'x' * 300} PORTARIA Nº {i}, de 1 de maio de 2020" for i in range(8))
    at = [m.span() for m in re.finditer(r"PORTARIA Nº \d+, de 1 de maio de 2020", sparse)]
    assert [w["depois"] for w in read(spark, sparse, lambda c: R.around(c, R._TITLE, 400, 1200))] == [sparse[b : b + 1200] for a, b in at]


def test_an_accented_pattern_finds_what_the_plain_one_finds_in_folded_text(spark):
    texts = ["DESIGNAR e díspensar", "exônera", "desıgn", "DİSPENSA", "", "dèstituição design", "nada"]
    hit = lambda c, p: F.regexp_extract(c, f"(?s)^.*({p})", 1)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(hit(T.fold(F.col("t")), V.ROLE_VERBS), T.fold(hit(F.lower("t"), T.accented(V.ROLE_VERBS)))).collect()
    assert all(a == b for a, b in rows) and [a for a, _ in rows][:2] == ["dispens", "exoner"]


def test_pages_of_plain_characters_are_cleaned_like_others(spark):
    assert [one(spark, t, T.page_text) for t in ("D' Ávila\u200b\u00a0e\u0301 x", "D' Ávila\u00a0é x", "a\x01b\r\n", "x’ y", "", None)] == ["D'Ávila é x", "D'Ávila é x", "ab\r\n", "x’y", "", None]
