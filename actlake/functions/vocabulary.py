"""Fixed values that results are compared by: word lists, lookup tables and patterns of official bulletins."""

# The issuing institution, its process number prefix and its short name in issuer codes.
INSTITUTION = "UNIVERSIDADE FEDERAL FLUMINENSE"
ACRONYM = "UFF"
PROCESS = r"23069[.\s]\d{6}[/\s]\d{4}[-\s]\d{2}"

# Months of written dates.
MONTHS = {
    "janeiro": 1, "fevereiro": 2, "março": 3, "marco": 3, "abril": 4, "maio": 5, "junho": 6, "julho": 7, "agosto": 8,
    "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12,
}

# Kinds of acts as titles print them, with the label and the abbreviation that stand for each.
KINDS = {
    "PORTARIA": "Portaria",
    "RESOLUÇÃO": "Resolução",
    "DETERMINAÇÃO DE SERVIÇO": "Determinação de Serviço",
    "INSTRUÇÃO NORMATIVA": "Instrução Normativa",
    "NORMA DE SERVIÇO": "Norma de Serviço",
    "ORDEM DE SERVIÇO": "Ordem de Serviço",
    "DECISÃO": "Decisão",
    "DELIBERAÇÃO": "Deliberação",
    "COMUNICADO": "Comunicado",
    "EDITAL": "Edital",
    "RESUMO DE DESPACHOS E DECISÕES": "Resumo de Despachos",
    "RESUMO DE DESPACHOS": "Resumo de Despachos",
}
ABBREVIATIONS = {
    "DETERMINAÇÃO DE SERVIÇO": "DTS",
    "RESUMO DE DESPACHOS E DECISÕES": "RDD",
    "RESUMO DE DESPACHOS": "RDD",
    "INSTRUÇÃO NORMATIVA": "IN",
    "NORMA DE SERVIÇO": "NS",
    "ORDEM DE SERVIÇO": "OS",
}

# How extracted relations map to the four stored kinds; anything else is the last.
RELATIONS = {
    "ALTERA": "Altera", "RETIFICA": "Altera", "REPUBLICA": "Altera", "PRORROGA": "Altera", "REVOGA": "Revoga",
    "TORNA SEM EFEITO": "Revoga", "ANULA": "Revoga", "SUBSTITUI": "Revoga", "CITA": "Complementa",
}
OTHER_RELATION = "Complementa"
RELATION_GROUPS = {
    "altera": ["ALTERA"],
    "revoga": ["REVOGA", "TORNA SEM EFEITO", "ANULA"],
    "substitui": ["SUBSTITUI", "RETIFICA", "REPUBLICA"],
    "cita": ["CITA"],
}

# Prefixes of cited acts in the order they are tried, without a word boundary.
CITED_KINDS = {
    "determinação de serviço": "Determinação de Serviço",
    "instrução normativa": "Instrução Normativa",
    "norma de serviço": "Norma de Serviço",
    "ordem de serviço": "Ordem de Serviço",
    "deliberação": "Deliberação",
    "comunicado": "Comunicado",
    "resolução": "Resolução",
    "portaria": "Portaria",
    "decisão": "Decisão",
    "edital": "Edital",
    "dts": "Determinação de Serviço",
    "in": "Instrução Normativa",
    "ns": "Norma de Serviço",
    "os": "Ordem de Serviço",
}
# Agencies whose acts are never in the store.
EXTERNAL = "MEC|SGP|SEDGG|SEGES|MGI|MPOG|MPDG|MP/SLTI|SLTI|DOU|CGU|AGU|TCU|STF|STJ|CNE|CES|CAPES|CNPq|INEP|FNDE|PNUD|CONFEA|CONSUNI"
# Words by which the in-batch matcher tells the cited kind, in order.
BATCH_WORDS = {
    "Portaria": "portaria", "Resolução": "resolu", "Decisão": "decis", "Determinação de Serviço": "determina",
    "Instrução Normativa": "instru", "Norma de Serviço": "norma", "Edital": "edital", "Comunicado": "comunicado",
}

STATUSES = ["Ativo", "Alterado", "Revogado"]

# Patterns of titles, codes and cut marks. Where several words may begin one, it first looks at the next character, which
# most places of a text fail.
ORDINAL = r"[.ºo°]{0,3}"
_KINDS = "|".join(sorted(KINDS, key=len, reverse=True))
TITLE = (
    rf"(?=[CDEINOPR])({_KINDS})\s+([A-ZÀ-Ú0-9/().\- ]{{0,40}}?)?\s*N{ORDINAL}\s*([\d\.]+(?:\s*[A-Z]{{1,4}})?)\s*,?\s*"
    r"[Dd][Ee]\s+(\d{1,2})\s+[Dd][Ee]\s+([A-Za-zçÇãÃéíóúâêôõ]+)\s+[Dd][Ee]\s+(\d{4})"
)
DOCUMENT = rf"SEI\s*n{ORDINAL}\s*(\d{{6,8}})"
DOCUMENT_IN_BRACKETS = r"\((\d{6,8})\)"
REGISTRATION = rf"(?i)(?=[ms])(?:\b(?:matr[íi]cula|mat)\.?\s*)?(?:SIAPE)[:\s]*n?{ORDINAL}\s*(\d{{6,7}})"
REGISTRATION_IN_BODY = r"(?iu)(?:SIAPE|Matr[íi]cula\s+SIAPE)[:\s]*n?[ºo°]?\.?\s*(\d{6,7})"
SECTION = r"(?iu)SEÇÃO\s+([IVX]+)\s+(?:PÁG|P)\.?\s*0?(\d+)"
RUNNING_HEAD = rf"[{INSTITUTION[0]}{INSTITUTION[0].lower()}](?iu){INSTITUTION[1:]}.{{0,5}}BOLETIM DE SERVIÇO"
NATURE = (
    r"(?iu)^\s*(Altera|Revoga|Substitui|Retifica|Republica|Designa|Designar|Dispõe|Prorroga|Torna|Aprova|Cria|Institui|Estabelece|"
    r"Nomeia|Exonera|Dispensa|Concede|Autoriza|Delega|Constitui|Homologa|Cancela|Suspende|Anula)"
)
SUMMARY_ENDS = (
    r"(?=[ROAC])(?:\bRESOLVE\b|\bRESOLVEM\b|\bO\s+REITOR\b|\bA\s+REITORA\b|\bO\s+CONSELHO\b|\bO\s+COORDENADOR|\bA\s+COORDENADOR|\bO\s+CHEFE\b|"
    r"\bA\s+DIRETORA\b|\bO\s+DIRETOR\b|\bO\s+PR[ÓO]-REITOR|\bConsiderando\b|\bArt\.?\s*1)"
)
SUMMARY_NOISE = [
    r"(?iu)ANO\s+[IVXLCDM]+\s*[–—-]?\s*N[.°º\s]*\d+",
    r"(?iu)SE[ÇC][ÃA]O\s+[IVX]+\s*P[ÁA]?G?[.\s]*\d+",
    r"(?iu)P[ÁA]G[.\s]*\d+",
    r"\d{2}/\d{2}/\d{4}",
    r"(?iu)MINIST[ÉE]RIO\s+DA\s+EDUCA[ÇC][ÃA]O",
    r"(?iu)UNIVERSIDADE\s+FEDERAL\s+FLUMINENSE",
    r"(?iu)BOLETIM\s+DE\s+SERVI[ÇC]O",
    r"#(?:\s*#)+",
]
CITED = (
    r"(?=[DdEeIiıİNnOoPpRr])(?=.[DdEeNnOoRrTt][CcDdIiıİLlRrSsſTt])([Pp](?i:ortaria)|[Rr](?i:esolução)|[Dd](?i:eterminação de Serviço|TS|ecisão|eliberação)|[Nn](?i:orma de Serviço)|[Iiıİ](?i:nstrução Normativa)|"
    r"[Ee](?i:dital)|[Oo](?i:rdem de Serviço))"
    rf"\s+([A-ZÀ-Ú0-9/().]{{1,25}}(?:\s[A-ZÀ-Ú0-9/().]{{1,15}}){{0,3}})?\s*n{ORDINAL}\s*(\d[\d\.]*(?:\s*[A-Z]{{1,4}})?)"
)
CITED_BULLETIN = rf"(?i)BS\s*n{ORDINAL}\s*(\d+)\s*,?\s*de\s*(\d{{2}}/\d{{2}}/\d{{4}})"
# Verbs before a citation, each with the relation it means.
RELATION_VERBS = {
    "REVOGA": r"revog",
    "TORNA SEM EFEITO": r"torna(?:r|m)?\s+sem\s+efeito",
    "SUBSTITUI": r"substitu",
    "RETIFICA": r"retific",
    "REPUBLICA": r"republic",
    "ANULA": r"\banul",
    "PRORROGA": r"prorrog",
    "ALTERA": r"alter(?:a|ar|ação|açao)",
    "CITA": r"conforme|nos\s+termos|com\s+base|com\s+fundamento|previst|de\s+que\s+trata|estabelecid|delegad",
}
CITED_LABELS = {
    "Dts": "DTS", "Rdd": "RDD", "In": "IN", "Ns": "NS", "Os": "OS", "Uff": "UFF", "Cuv": "CUV", "Cepex": "CEPEX", "Cepx": "CEPEx",
}

# Words that are no issuer code, and issuers known by a description.
NO_ISSUER = (
    "conjunta de da do das dos e a o em uff retificado pessoal notificacao retificacao selecao monitoria ciencia comissao eleitoral "
    "local tutor eliminacao documentos progressao remocao nomeacao designacao exoneracao aposentadoria concessao processo seletivo "
    "simplificado conselho programa gestao geral nacional permanente especial executiva executivo interna interno setorial integrada "
    "integrado avaliacao planejamento desenvolvimento ensino pesquisa extensao"
).split()
ISSUER_ALIASES = {"de ciencia de eliminacao de documentos": "CPAD", "de pessoal": "PORTARIA DE PESSOAL"}
NO_SUMMARY = "(sem ementa formal no boletim)"
PLAIN_SUMMARY = f"Ato administrativo publicado no Boletim de Serviço da {ACRONYM}."

# The table export's columns and their headings.
TABLE_COLUMNS = {
    "identificador": "Identificador", "tipo": "Tipo", "sigla": "Órgão/Sigla", "numero": "Número", "ano": "Ano",
    "data_ato": "Data do ato", "tipo_acao": "Natureza", "ementa": "Ementa", "signatario": "Assinante", "altera": "Altera",
    "revoga": "Revoga / Torna sem efeito", "substitui": "Substitui / Retifica / Republica", "cita": "Cita / Fundamenta-se em",
    "processo_sei_principal": "Processo SEI", "sei_documento": "Doc. SEI", "link_sei_processo": "Link SEI (processo)",
    "link_sei_documento": "Link SEI (documento)", "bs_numero": "Boletim nº", "bs_data": "Data do Boletim", "secao": "Seção",
    "pagina": "Página", "arquivo": "Arquivo",
}
SHEET_COLUMNS = [
    "Tipo de Ato", "Número", "Ano", "Data de Assinatura", "Órgão Emissor", "Ementa", "Processo SEI", "Status", "Boletim Número",
    "Link Boletim", "Marcadores", "Explicação Simples", "Relações (Formato JSON)",
]

# Words, without accents, that are offices, professions, verbs, fields of study or table headings and not names.
NOT_NAMES = set((
    "professor professora reitor reitora diretor diretora coordenador coordenadora coord chefe presidente secretario secretaria "
    "tecnico analista assistente magisterio superior matricula codigo cargo ocupante servidor servidora substituto substituta "
    "membro membros comissao subcomissao universidade federal fluminense ministerio educacao departamento divisao coordenacao "
    "reitoria central documento paragrafo considerando quadro permanente senhor senhora gabinete vice decano superintendente lotar "
    "designar dispensar exonerar nomear conceder autorizar instituir revogar alterar prorrogar tornar retificar republicar "
    "considerar resolver delegar aprovar homologar redistribuido professores professoras docente docentes diretores coordenadores "
    "coordenadoras chefes presidentes secretarios tecnicos analistas assistentes servidores substitutos assuntos educacionais "
    "educacional gerais administrativos administrativa academicos academica financeiros institucional institucionais setor nucleo "
    "gerencia assessoria pessoal ensino pesquisa extensao graduacao licenca afastamento concessao capacitacao auxiliar auxiliares "
    "enfermeiro enfermeira enfermagem medico medica odontologo odontologa dentista cirurgiao psicologo psicologa nutricionista "
    "farmaceutico farmaceutica bioquimico fisioterapeuta fonoaudiologo biologo biomedico veterinario zootecnista engenheiro "
    "engenheira arquiteto arquiteta quimico geologo estatistico economista contador contadora administrador administradora "
    "administrativo bibliotecario bibliotecaria documentalista arquivista museologo jornalista publicitario tradutor tradutora "
    "revisor revisora programador programadora operador operadora motorista telefonista recepcionista almoxarife vigilante porteiro "
    "copeiro cozinheiro cozinheira servente jardineiro eletricista mecanico soldador torneiro marceneiro desenhista fotografo "
    "diagramador instrumentador produtor produtora cultural social sociologo historiador pedagogo pedagoga artifice contabilidade "
    "laboratorio laboratorista sociologia antropologia geografia historia filosofia psicologia pedagogia letras linguistica "
    "comunicacao jornalismo economia administracao direito arquitetura engenharia matematica fisica quimica biologia geologia "
    "computacao informatica ciencia ciencias politica politicas sociais humanas naturais exatas biologicas medicina odontologia "
    "farmacia nutricao fisioterapia fonoaudiologia veterinaria cirurgia clinica pediatria ginecologia obstetricia cardiologia "
    "neurologia ortopedia radiologia anestesiologia dermatologia oftalmologia urologia patologia psiquiatria geriatria "
    "traumatologia bucomaxilofacial bucomaxilofaciais buco maxilo facial geral nome mat"
).split())
NAME_CONNECTORS = {"de", "da", "do", "das", "dos", "e"}

# Names of units that name none, small words in units' names, and what follows a unit's name in a text.
BARE_UNITS = "curso departamento programa instituto faculdade escola divisao secao setor nucleo coordenacao coordenadoria diretoria gerencia reitoria unidade polo colegiado".split()
UNIT_SMALL = "de da do das dos e em na no nas nos a o ao aos com para por sob sem entre sobre".split()
UNIT_ENDS = [r"(?i)\s+d[aoe]st?[ae]?\s+Universidade.*$", rf"(?i)\s+d[ao]\s+{ACRONYM}\b.*$", r"\s*\([^)]*$"]

# Verbs of the operative part, in the order they are tried, with the form that a summary starts with.
SUMMARY_VERBS = {
    r"tornar\s+sem\s+efeito": "Torna sem efeito", r"tornar\s+p[úu]blico": "Torna público", "designar": "Designa", "nomear": "Nomeia",
    "exonerar": "Exonera", "dispensar": "Dispensa", "constituir": "Constitui", "instituir": "Institui", "conceder": "Concede",
    "autorizar": "Autoriza", "prorrogar": "Prorroga", "alterar": "Altera", "revogar": "Revoga", "aprovar": "Aprova",
    "homologar": "Homologa", "retificar": "Retifica", "republicar": "Republica", "delegar": "Delega", "criar": "Cria",
    "estabelecer": "Estabelece", "remover": "Remove", "redistribuir": "Redistribui", "lotar": "Lota", "cancelar": "Cancela",
    "suspender": "Suspende", "determinar": "Determina", "fixar": "Fixa", "declarar": "Declara", "convalidar": "Convalida",
    "reconduzir": "Reconduz", "destituir": "Destitui", "substituir": "Substitui", "conceituar": "Conceitua", "ratificar": "Ratifica",
    "dispor": "Dispõe sobre", "interromper": "Interrompe", "aposentar": "Aposenta", "aplicar": "Aplica", "atribuir": "Atribui",
    "extinguir": "Extingue", "atualizar": "Atualiza", "publicar": "Publica", "readaptar": "Readapta", "incluir": "Inclui",
    "excluir": "Exclui", "abonar": "Abona", "conferir": "Confere", "transferir": "Transfere", "anular": "Anula", "validar": "Valida",
}
# Enumerators before the verb, clauses before its object, what ends the object, and runs of capitals in it.
ENUMERATOR = (
    r"\s*(?:art\.?\s*\d+[ºo°.\-]*\s*[-–]?\s*|[ivx]{1,4}\s*[-–.)]\s*|\d+\s*[-–.)]\s*|[a-z]\s*[-)]\s*|§\s*\d*[ºo°]?\s*|"
    r"par[áa]grafo\s+\S+\s*[-–.:]?\s*)"
)
CLAUSE = (
    r"\s*,?\s*(?:consoante\b[^,]*|conforme\b[^,]*|nos termos\b[^,]*|tendo em vista\b[^,]*|de acordo com\b[^,]*|com base n[oa]\b[^,]*|"
    r"a pedido|a partir d[eo]\b[^,]*|a contar d[eo]\b[^,]*|com efeitos?\b[^,]*|pelo per[íi]odo\b[^,]*|no per[íi]odo\b[^,]*|"
    r"retroativ[oa]\b[^,]*|em car[áa]ter\b[^,]*|por \d+[^,]*)\s*,\s*"
)
OBJECT_END = (
    r"(?=[;.,\sacefimnprst])(?:;|\.(?=\s|$)|\bII+\s*[-–]|\bIV\s*[-–]|,?\s*\bmatr[íi]cula\b|,?\s*\bsiape\b|,?\s*\bc[óo]digo\b|\ba partir\b|\bcom valid|"
    r"\bpelo per[íi]odo\b|\bno per[íi]odo\b|\btendo em vista\b|\bem virtude\b|\bnos termos\b|\bem substitui|\bpublique-se\b|"
    r"\bregistre-se\b|\bfica\b)"
)
CAPITALS = r"[A-ZÀ-Þ][A-ZÀ-Þ0-9'’\-]*(?:\s+[A-ZÀ-Þ][A-ZÀ-Þ0-9'’\-]*)+"
PHRASE_SMALL = "de da do das dos e a o as os em no na nos nas para por com sem ao aos à às que sob sobre entre".split()

# Words of a person's name (in capitals, or with a capital first), what joins them, and the two kinds of runs, the first tried first.
LETTER, CAPITAL = "A-Za-zÀ-ÖØ-öø-ÿ", "A-ZÀ-ÖØ-Þ"
NAME_TAIL = rf"[{LETTER}]*(?:['’][{LETTER}]+)*"
NAME_JOIN = rf"(?:de|da|do|das|dos|e|d['’][{LETTER}]*)"
NAME_WORDS = [rf"[{CAPITAL}]{{2,}}{NAME_TAIL}", rf"[{CAPITAL}]{NAME_TAIL}"]
NAMES = [rf"{w}(?:\s+(?:{NAME_JOIN}|{w})){{1,6}}" for w in NAME_WORDS]

# The wording by which acts appoint to and dismiss from an office of a unit (groups: preposition, office, unit).
OFFICE = (
    r"(?:Vice[-\s]?|Sub[-\s]?)?(?:Chefes?|Coordenador[ae]?(?:es)?|Diretor[ae]?(?:es)?|Superintendentes?|Gerentes?|Decan[oa]s?|"
    r"Pr[óo][-\s]?Reitor[ae]?(?:es)?|Reitor[ae]?(?:es)?)"
)
ROLE = (
    r"(?=[adop])(d[ao]s?|para\s+(?:as?|os?)|pel[ao]|a|as|o|os)\s+(?:exerc[íi]cio\s+d[ao]\s+)?(?:fun[çc](?:[ãa]o|[õo]es)|cargo)\s+"
    r"(?:(?:gratificad|comissionad)[ao]s?\s+|de\s+confian[çc]a\s+|em\s+comiss[ãa]o\s+)?de\s+(?:dire[çc][ãa]o\s+de\s+)?"
    rf"({OFFICE})\s+(?:d[oae]s?|d')\s+([A-ZÀ-Úa-zà-ú(][^;:.]{{2,90}}?)"
    r"(?=\s*(?:,|;|\.|:|\bc[óo]digo\b|\bc[óo]d\b|\bs[íi]mbolo\b|\bFG[- ]?\d|\bCD[- ]?\d|\bFCC\b|\bFUC\b|\bn[.ºo°]|\ba partir\b|"
    rf"\bpelo per|\bno per[íi]odo\b|\bcom valid|\bem substitui|\bda Universidade\b|/{ACRONYM}|\bem virtude\b|\bdurante\b|$))"
)
ACTING = r"(?-i:(?=[EeIiıİPpRrSsſ]))(?:substitut|eventual|pro\s*tempore|respond|interin|exerc[íi]cio eventual)"
ROLE_VERBS = "(?=[de])(?:design|dispens|exoner|destitu)"
LEAVING = ["do", "da", "dos", "das"]

# How far an act's text is looked at around a citation, before a registration number, and before an office.
CITED_BEFORE, CITED_AFTER, EXCERPT_AFTER = 75, 90, 30
NAME_BEFORE = 170
PERSON_BEFORE, VERB_BEFORE, ACTING_BEFORE = 220, 300, 50
SUMMARY_AFTER, HEAD_BEFORE, HEAD_AFTER = 1200, 400, 200
# Characters of units' names that stand for plain ones.
COMPATIBLE = {"ª": "a", "º": "o", "¹": "1", "²": "2", "³": "3", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "…": "..."}
