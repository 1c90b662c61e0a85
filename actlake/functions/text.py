"""Derivations from the text of acts, as column expressions that stay in generated code."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from actlake.functions import vocabulary as V

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: What separates the words of a search.
BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"
EDGES = r"^[\s/.,\-()]+|[\s/.,\-()]+$"


def lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed table, null where the key is missing."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def fold(c: Column) -> Column:
    """Lower case without the accents of Western European letters."""
    return F.translate(F.lower(c), _ACCENTED, _PLAIN)


def fold_plain(s: str) -> str:
    """``fold`` of a plain string."""
    return s.lower().translate(str.maketrans(_ACCENTED, _PLAIN))


def accented(pattern: str) -> str:
    """A pattern over folded text as one over the same text in lower case, accents and all."""
    return "".join(f"[{x}{''.join(a for a, b in zip(_ACCENTED, _PLAIN, strict=True) if b == x)}]" if x in _PLAIN else x for x in pattern)


def filled(c: Column) -> Column:
    """The value, or null where it is empty."""
    return F.when(c != "", c)


def clean(c: Column) -> Column:
    """No control characters, single blanks, line breaks as blanks, trimmed."""
    c = F.regexp_replace(c, r"[\x00-\x1F&&[^\t\n\r]]", "")
    c = F.regexp_replace(c, r"(?=[ \t])(?: [ \t]|\t)[ \t]*", " ")
    # of white space, only these are left
    return F.trim(F.regexp_replace(c, r"[ \r]*+\n[ \r\n]*", " "))


@F.pandas_udf(StringType())
def composed(s: pd.Series) -> pd.Series:
    """Unicode NFC; Spark has no function for it."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def page_text(c: Column) -> Column:
    """Text of a page as everything else expects it: composed, without invisible characters, apostrophes joined to names."""
    # texts of these characters alone are composed and hold nothing invisible; only others are sent to Python
    other = composed(F.when(~c.rlike("^[\\t\\n\\r -\\u00AC\\u00AE-\\u02FF\\u2010-\\u2027]*+$"), c))
    c = F.when(other.isNull(), c).otherwise(F.regexp_replace(other, r"[\x00-\x08\x0B\x0C\x0E-\x1F­​-‍⁠﻿]", ""))
    joined = lambda t: F.regexp_replace(t, r"[ \t](?<=[A-Za-zÀ-ÿ]['’].)[ \t]*(?=[A-Za-zÀ-ÿ])", "")
    return once(F.replace(c, F.lit(" "), F.lit(" ")), lambda t: F.when(F.contains(t, F.lit("'")) | F.contains(t, F.lit("’")), joined(t)).otherwise(t))


def until(c: Column, pattern: str) -> Column:
    """What stands before a pattern's first match, or the whole text."""
    return F.regexp_replace(c, rf"(?:{pattern})(?s:.*)", "")


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "ato").otherwise(s)


def long_date(day: Column, month: Column, year: Column) -> Column:
    """ISO date of a written date; '' for an unknown month. The day's range isn't checked."""
    number = lookup({k: f"{v:02d}" for k, v in V.MONTHS.items()}, F.lower(F.trim(month)))
    return F.coalesce(F.concat(F.lpad(year, 4, "0"), F.lit("-"), number, F.lit("-"), F.lpad(day, 2, "0")), F.lit(""))


def long_date_of(text: Column) -> Column:
    """``long_date`` of a text like '10 de junho de 2026'; '' if it isn't one."""
    pattern = r"^\s*(\d{1,2})\s+[Dd][Ee]\s+(\p{L}+)\s+[Dd][Ee]\s+(\d{4})\s*$"
    return long_date(*(F.regexp_extract(text, pattern, i) for i in (1, 2, 3)))


def process_number(c: Column) -> Column:
    """Process number in its standard form, or the trimmed text where it has too few digits."""
    d = F.regexp_replace(c, r"\D", "")
    parts = [F.substring(d, *x) for x in ((1, 5), (6, 6), (12, 4), (16, 2))]
    return F.when(F.length(d) >= 17, F.concat(parts[0], F.lit("."), parts[1], F.lit("/"), parts[2], F.lit("-"), parts[3])).otherwise(F.trim(c))


def process_numbers(text: Column) -> Column:
    """All process numbers of a text, the first of equal ones."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(V.PROCESS), F.lit(0)), process_number))


def first_or_blank(values: Column) -> Column:
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def document_code(text: Column) -> Column:
    """Code of the signed document: after its label, else the first one in brackets, else ''."""
    found = filled(F.regexp_extract(text, V.DOCUMENT, 1))
    return F.coalesce(found, F.regexp_extract(text, V.DOCUMENT_IN_BRACKETS, 1))


def link(base: str, code: Column) -> Column:
    """Address of a process or document below the given base; '' without a code."""
    return F.when(F.coalesce(code, F.lit("")) == "", "").otherwise(F.concat(F.lit(base), code))


def bulletin_metadata(cover: Column) -> Column:
    """(bs_numero, bs_data, bs_ano) of the text of a bulletin's first three pages; '' for what is missing."""
    return F.struct(
        F.regexp_extract(cover, r"N[.\s]*[°ºo]?\s*(\d{1,4})", 1).alias("bs_numero"),
        F.regexp_extract(cover, r"\b(\d{2}/\d{2}/\d{4})\b", 1).alias("bs_data"),
        F.regexp_extract(cover, r"ANO\s+([IVXLCDM]+)", 1).alias("bs_ano"),
    )


def section(context: Column) -> Column:
    return F.regexp_extract(context, V.SECTION, 1)


def page(context: Column) -> Column:
    return F.regexp_extract(context, V.SECTION, 2)


def body(segment: Column) -> Column:
    """Segment without running heads and separator rows."""
    rows = lambda s: F.when(F.contains(s, F.lit("#")), F.regexp_replace(s, r"#\s*#\s*#\s*#\s*#\s*#", " ")).otherwise(s)
    return once(F.regexp_replace(segment, V.RUNNING_HEAD, " "), rows)


def trimmed_issuer(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(clean(F.coalesce(c, F.lit(""))), r"\s+", " "), EDGES, "")


def issuer_code(c: Column) -> Column:
    """Issuer code of a title: no institution, no leading connectors or 'conjunta', no blanks around slashes."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[–—]", "-"), r"\s+", " "))
    s = F.regexp_replace(s, rf"(?i)/?\s*\b{V.ACRONYM}\b", "")
    s = F.regexp_replace(s, r"(?i)^(?:[\s/.,\-()]*(?:CONJUNTA\b|(?:do|da|de|dos|das)\b))+\s*", "")
    return F.regexp_replace(F.regexp_replace(s, r"\s*/\s*", "/"), EDGES, "")


def display_issuer(c: Column) -> Column:
    """Issuer as shown: its tokens that look like acronyms, or the text itself where none does."""
    s = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("."), F.lit("")), r"^[ /.,\-–]+|[ /.,\-–]+$", "")
    split = F.split(F.replace(F.regexp_replace(s, r"\s*\(\s*", "/"), F.lit(")"), F.lit(" ")), r"[\s/\-–]+")
    tokens = F.transform(split, lambda t: F.regexp_replace(t, r"^[ .,()\-–]+|[ .,()\-–]+$", ""))
    letters = lambda t: F.length(F.regexp_replace(t, "[^A-Za-zÀ-Ú0-9]", ""))
    fit = F.array_distinct(F.filter(tokens, lambda t: (t != "") & ~fold(t).isin(V.NO_ISSUER) & (t == F.upper(t)) & letters(t).between(2, 8)))
    return (
        F.when(s.isin("", "Reitoria", V.ACRONYM), s)
        .otherwise(F.coalesce(lookup(V.ISSUER_ALIASES, fold(s)), F.when(F.size(fit) > 0, F.array_join(fit, "/")), s))
    )


def issuer_or_default(shown: Column, kind: Column) -> Column:
    return F.coalesce(filled(shown), F.when(kind == "PORTARIA", "Reitoria").otherwise(V.ACRONYM))


def identifier(kind: Column, issuer: Column, number: Column, year: Column) -> Column:
    """'DTS GES nº 16/2025': the kind's abbreviation or its title case, the issuer if any, number and year."""
    return F.concat_ws(" ", F.coalesce(lookup(V.ABBREVIATIONS, kind), F.initcap(kind)), filled(issuer), F.concat(F.lit("nº "), number, F.lit("/"), year))


def summary(rest: Column) -> Column:
    """Formal summary: what follows the title up to the earliest cut mark, without what leaks in from page heads."""
    s = clean(until(rest, V.SUMMARY_ENDS))
    s = clean(reduce(lambda c, noise: F.regexp_replace(c, noise, ""), V.SUMMARY_NOISE, s))
    lead = r"^[\s.,;:–\- ]+"
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, lead, ""), r"(?i)^ementa\s*:?\s*", ""), lead, "")
    return F.left(clean(s), F.lit(600))


def nature(formal: Column) -> Column:
    return F.initcap(F.regexp_extract(formal, V.NATURE, 1))


def registrations(text: Column, pattern: str = V.REGISTRATION) -> Column:
    """Sorted distinct registration numbers."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))


def search_body(c: Column, cleaned: bool = False) -> Column:
    return F.left(F.lower(c if cleaned else clean(c)), F.lit(7000))


def signer(segment: Column) -> Column:
    """The line in capitals above the first line that names an office and has such a line above it; '' without one."""
    office = r"(?iu)(?=[cdprsv])(REITOR|DIRETOR|COORDENADOR|CHEFE|PRESIDENTE|SUPERINTEND|PR[ÓO]-REITOR|VICE|SECRET|DECAN)"
    # most lines have small letters and are left out by the first test
    capitals = lambda a: ~a.rlike("[a-z]") & (F.upper(a) == a) & (F.length(F.regexp_replace(a, "[^A-Za-zÀ-Ú]", "")) >= 6)

    def above(lines: Column) -> Column:
        over = lambda i: F.get(lines, i - 1)
        return F.filter(F.transform(lines, lambda b, i: F.when((i > 0) & capitals(over(i)) & b.rlike(office), over(i))), lambda a: a.isNotNull())

    lines = F.filter(F.transform(F.split(F.replace(segment, F.lit("\r\n"), F.lit("\n")), "\n"), F.trim), lambda x: x != "")
    return F.coalesce(clean(F.get(once(lines, above), F.lit(0))), F.lit(""))


def looks_like_act(segment: Column) -> Column:
    """False for titles that only a table of contents lists."""
    return (F.length(segment) > 700) | segment.rlike("RESOLVE|[Rr]esolve") | F.lower(segment).rlike(r"resolve|art\.|art |considerando")


def tags(action: Column, issuer: Column, kind: Column) -> Column:
    """At most six: the action, the issuer's parts, the kind's label."""
    label = F.coalesce(lookup(V.KINDS, kind), F.lit("Outro"))
    parts = F.concat(F.array(F.coalesce(action, F.lit(""))), F.transform(F.split(F.coalesce(issuer, F.lit("")), "[/ ]"), F.trim), F.array(label))
    return F.slice(F.array_distinct(F.filter(parts, lambda t: t != "")), 1, 6)


def shown_summary(formal: Column, inferred: Column) -> Column:
    """(ementa, ementaInferida, conteudoResumido): the formal summary, else the inferred one, else a note."""
    formal, inferred = (F.trim(F.coalesce(c, F.lit(""))) for c in (formal, inferred))
    shown = F.coalesce(filled(formal), filled(inferred), F.lit(V.NO_SUMMARY))
    return F.struct(
        shown.alias("ementa"),
        ((inferred != "") & (formal == "")).alias("ementaInferida"),
        F.when(F.startswith(shown, F.lit("(")), V.PLAIN_SUMMARY).otherwise(shown).alias("conteudoResumido"),
    )


def year_or_default(c: Column, default: int = 2026) -> Column:
    return F.when(c.rlike(r"^\d+$"), c.try_cast("int")).otherwise(F.lit(default))


def publication_label(number: Column, date: Column, default: str = "2026") -> Column:
    year = F.when(F.contains(date, F.lit("/")), F.element_at(F.split(date, "/"), -1)).otherwise(default)
    return F.concat(F.lit("BS nº "), F.coalesce(number, F.lit("")), F.lit("/"), F.coalesce(year, F.lit(default)))


def valid_date(c: Column) -> Column:
    """Date of a text that is one in ISO form, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def file_number_year(name: Column, act_year: Column | None = None) -> Column:
    """(numero, ano) of a bulletin's file name; two-digit years are 20xx; without one the act's year, or 0."""
    pattern = r"(\d+)-(\d{4}|\d{2})"
    number, year = F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)
    own = F.when(F.length(year) == 4, year.try_cast("int")).when(F.length(year) == 2, year.try_cast("int") + 2000)
    other = F.coalesce(act_year, F.lit(0)) if act_year is not None else F.lit(0)
    return F.struct(number.try_cast("int").alias("numero"), F.coalesce(own, other).alias("ano"))


def number_variants(number: Column) -> Column:
    """The number as it is, without dots, and without dots and leading zeros."""
    base = F.trim(number)
    no_dots = F.replace(base, F.lit("."), F.lit(""))
    no_zeros = F.regexp_replace(no_dots, "^0+", "")
    return F.array_distinct(F.array(base, no_dots, F.when(no_zeros == "", no_dots).otherwise(no_zeros)))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def citation_target(text: Column) -> Column:
    """(tipo, sigla, numero) of a citation, null where it doesn't read as one."""
    part = lambda k: F.trim(F.regexp_extract(text, r"^(.+?)\s+n[ºo°]\s*(.+)$", k))

    def target(prefix: Column, word: Column) -> Column:
        issuer = F.upper(F.regexp_replace(F.substring(prefix, F.length(word) + 1, F.length(prefix)), "^[ /.,]+|[ /.,]+$", ""))
        return F.when(word != "", F.struct(lookup(V.CITED_KINDS, word).alias("tipo"), issuer.alias("sigla"), part(2).alias("numero")))

    first = lambda prefix: F.regexp_extract(prefix, f"^({'|'.join(V.CITED_KINDS)})", 1)
    return once(F.lower(part(1)), lambda prefix: once(first(prefix), lambda word: target(prefix, word)))


def is_external(text: Column) -> Column:
    return text.rlike(rf"(?iuU)\b({V.EXTERNAL})\b")


def without_institution(c: Column) -> Column:
    """Issuer in capitals without the institution's suffix, for comparing."""
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?i)/{V.ACRONYM}", ""))


def relation_kind(label: Column) -> Column:
    return F.coalesce(lookup(V.RELATIONS, label), F.lit(V.OTHER_RELATION))


def inverse_relation(kind: Column, other: str = "Referenciado por") -> Column:
    """Label of an edge seen from its target."""
    return F.coalesce(lookup({"Revoga": "Revogado por", "Altera": "Alterado por"}, kind), F.lit(other))


def office(c: Column) -> Column:
    """Family of an office, with 'Vice-' or 'Sub' kept."""
    low = fold(c)
    rest = F.regexp_replace(low, r"^(vice|sub)[-\s]?", "")
    base = (
        F.when(F.contains(rest, F.lit("reitor")), F.when(F.contains(low, F.lit("pro")), "Pró-Reitor").otherwise("Reitor"))
        .when(F.contains(rest, F.lit("superintend")), "Superintendente")
        .when(F.contains(rest, F.lit("coordena")), "Coordenador")
        .when(F.contains(rest, F.lit("chef")), "Chefe")
        .when(F.contains(rest, F.lit("dire")), "Diretor")
        .when(F.contains(rest, F.lit("geren")), "Gerente")
        .when(F.contains(rest, F.lit("decan")), "Decano")
        .otherwise(F.initcap(c))
    )
    return F.when(F.startswith(low, F.lit("sub")), F.concat(F.lit("Sub"), F.lower(base))).when(F.startswith(low, F.lit("vice")), F.concat(F.lit("Vice-"), base)).otherwise(base)


def unit_key(c: Column) -> Column:
    """Key under which differing spellings of a unit meet."""
    f = F.regexp_replace(fold(c), r"[\-–]\s*[a-z]{2,6}$", "")
    f = F.regexp_replace(f, r"\([a-z0-9/]{2,8}\)", "")
    f = F.regexp_replace(f, r"\bpos\s*-?\s*graduacao\b", "posgraduacao")
    return F.trim(F.regexp_replace(f, "[^a-z0-9]+", " "))


def unit_as_cited(c: Column) -> Column:
    """A unit's name as an act's text gives it: plain characters, without what runs on after it, words doubled by the page's layout once."""
    edge = r" /.,\-–·"
    plain = reduce(lambda s, pair: F.replace(s, F.lit(pair[0]), F.lit(pair[1])), V.COMPATIBLE.items(), c)
    name = _stripped(F.regexp_replace(plain, r"(?U)\s+", " "), edge + "()")
    whole = reduce(lambda s, end: F.regexp_replace(s, f"(?U){end}", ""), V.UNIT_ENDS, name)
    return _stripped(F.regexp_replace(whole, r"(?iU)\b(\w+)(\s+\1\b)+", "$1"), edge)


def unit_label(c: Column) -> Column:
    """A unit's name in title case: connectors small but at the start, short acronyms as they are."""
    acronym = lambda p: (p == F.upper(p)) & (p != F.lower(p)) & (F.length(p) <= 6) & ~p.rlike("[À-Ú]")

    def word(w: Column, i: Column) -> Column:
        case = lambda p: F.when((i > 0) & fold(p).isin(V.UNIT_SMALL), F.lower(p)).when(acronym(p), p).otherwise(capital(p))
        return F.array_join(F.transform(F.split(w, "-"), case), "-")

    return F.array_join(F.transform(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), word), " ")


def capital(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substring(word, F.lit(2), F.length(word))))


def role_events(mentions: Column) -> Column:
    """Offices given or taken (acao, cargo, unidade, unidade_chave, nome, siape), each once, from mentions as they are written.

    A unit that names none ("o departamento", "a referida seção") doesn't count; a name that is a part of the unit's is none.
    """
    plain = lambda m: fold(m["unidade"])
    vague = r"\b(?:referid|mesm|respectiv|citad|aludid|supracitad|present|seguinte|propri)"
    usable = F.filter(mentions, lambda m: (F.length(plain(m)) >= 4) & ~plain(m).isin(V.BARE_UNITS) & ~plain(m).rlike(vague))
    events = F.transform(
        usable,
        lambda m: F.struct(
            m["acao"].alias("acao"), office(m["cargo"]).alias("cargo"), unit_label(m["unidade"]).alias("unidade"), unit_key(m["unidade"]).alias("unidade_chave"),
            F.when(F.contains(plain(m), fold(m["nome"])), "").otherwise(m["nome"]).alias("nome"), m["siape"].alias("siape"),
        ),
    )
    key = lambda e: F.struct(e["acao"], F.lower(e["cargo"]), e["unidade_chave"], e["siape"])
    return once(events, lambda all_of: F.filter(all_of, lambda e, i: ~F.exists(F.slice(all_of, F.lit(1), i), lambda x: key(x) == key(e))))


def _stripped(c: Column, of: str) -> Column:
    return F.regexp_replace(c, f"^[{of}]+|[{of}]+$", "")


def inferred_summary(body: Column, cleaned: bool = False) -> Column:
    """(ementa_resumo, ementa_inferida): for acts without a formal summary, one in the act's own words. ``cleaned``: the body is.

    The operative part's verb in the third person and its object, without enumerators, leading clauses and what follows it.
    """
    word = r"(?=r)\bresolvem?\b"

    def operative(text: Column) -> Column:
        after = F.regexp_extract(text, rf"(?siuU){word}\s*:?\s*(.*)$", 1)
        return once(after, lambda p: F.when(p != "", p).when(text.rlike(f"(?iuU){word}"), "").otherwise(text))

    whole = F.coalesce(body, F.lit(""))
    part = once(whole if cleaned else clean(whole), operative)
    part = F.regexp_replace(F.regexp_replace(part, f"^(?iuU)(?:{V.ENUMERATOR}){{0,4}}", ""), r"^[ \-–.)]+", "")
    verbs = lambda p: F.coalesce(*[F.when(p.rlike(rf"^(?iuU){v}\b"), F.struct(F.lit(form).alias("form"), F.regexp_replace(p, rf"^(?iuU){v}\b", "").alias("rest"))) for v, form in V.SUMMARY_VERBS.items()])

    def thing(rest: Column) -> Column:
        thing = until(F.regexp_replace(rest, f"^(?iuU)(?:{V.CLAUSE}){{0,3}}", ""), f"(?iuU){V.OBJECT_END}")
        return F.regexp_replace(_stripped(thing, r" ,;.:\-–"), r"(?U)\s+", " ")

    def phrase(run: Column) -> Column:
        small = lambda w, i: (i > 0) & fold(w).isin([*V.PHRASE_SMALL])
        words = F.split(F.regexp_replace(run, r"\s+", " "), " ")  # a split by more than one character compiles its pattern for each row
        return F.array_join(F.transform(words, lambda w, i: F.when(small(w, i), F.lower(w)).otherwise(capital(w))), " ")

    def cased(t: Column) -> Column:
        runs = F.split(F.regexp_replace(t, V.CAPITALS, "\x01$0\x01"), "\x01", -1)  # a clean text has no such character
        return F.array_join(F.transform(runs, lambda run, i: F.when(i % 2 == 1, phrase(run)).otherwise(run)), "")

    def said(form: Column, t: Column) -> Column:
        line = _stripped(F.regexp_replace(F.concat(form, F.lit(" "), cased(t)), r"\s+([,;.])", "$1"), r" ,;:\-–")
        return F.concat(F.regexp_replace(F.left(clean(line), F.lit(280)), r"[ ,;:\-–]+$", ""), F.lit("."))

    made = once(once(part, verbs), lambda v: once(thing(v["rest"]), lambda t: F.when(F.length(t) >= 2, said(v["form"], t))))
    return once(made, lambda m: F.struct(F.coalesce(m, F.lit("")).alias("ementa_resumo"), m.isNotNull().alias("ementa_inferida")))


def query_tokens(query: str) -> list[str]:
    """Words of a search of three characters or more, without search operators."""
    import re

    found = (re.sub(r'[+\-><()~*"@]', "", t) for t in query.split())
    return [t for t in found if len(t) >= 3]


def has_prefixes(text: Column, tokens: list[str]) -> Column:
    """Every token begins some word of the text, whatever the case and accents."""
    words = F.split(fold(F.coalesce(text, F.lit(""))), BETWEEN_WORDS)
    begins = lambda ws, t: F.exists(ws, lambda w: F.startswith(w, fold(F.lit(t))))
    return once(words, lambda ws: reduce(lambda a, b: a & b, [begins(ws, t) for t in tokens]))


def safe_url(url: Column) -> Column:
    """Address with the unsafe characters of its path and query escaped; what is escaped already stays."""
    escaped = F.url_encode(url)
    for plain in "/:?=&%#-_.~+,;@!$'()*":
        escaped = F.replace(escaped, F.lit(f"%{ord(plain):02X}"), F.lit(plain))
    return F.replace(F.replace(escaped, F.lit("+"), F.lit("%20")), F.lit("%2B"), F.lit("+"))
