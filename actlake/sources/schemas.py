"""Explicit schemas: nothing is inferred, fields that a file lacks are null."""

from __future__ import annotations

PERSON = "struct<nome:string,siape:string>"
ROLE = "struct<acao:string,cargo:string,unidade:string,unidade_chave:string,nome:string,siape:string>"
ACT = (
    "arquivo string, bs_numero string, bs_data string, secao string, pagina string, tipo string, orgao string, sigla string, numero string, ano string, "
    "data_ato string, identificador string, tipo_acao string, ementa string, ementa_resumo string, ementa_inferida boolean, signatario string, "
    "processos_sei array<string>, processo_sei_principal string, sei_documento string, link_sei_processo string, link_sei_documento string, "
    "relacoes array<struct<relacao:string,ato_citado:string,bs_origem:string,trecho:string>>, altera string, revoga string, substitui string, cita string, "
    f"siapes array<string>, pessoas array<{PERSON}>, funcoes array<{ROLE}>, corpo_busca string"
)
BULLETIN = "bs_numero string, bs_data string, bs_ano string, arquivo string, paginas int"
PORTAL = (
    "id string, tipoAto string, numero string, ano int, dataAssinatura string, orgaoEmissor string, ementa string, ementaInferida boolean, processoSei string, "
    "seiDocumento string, linkSeiProcesso string, linkSeiDocumento string, "
    "relacoes array<struct<id:string,tipoRelacao:string,atoDestino:string,detalhes:string>>, tags array<string>, siapes array<string>, "
    f"pessoas array<{PERSON}>, funcoes array<{ROLE}>, textoBusca string, conteudoResumido string, status string, boletimNumero string, linkBoletim string, "
    "secao string, pagina string, arquivo string, notasInternas string, dataCriacao string, "
    "referenciadoPor array<struct<relacao:string,porId:string,porLabel:string,detalhes:string>>"
)
SHEET = "tipoAto string, numero string, ano string, dataAssinatura string, orgaoEmissor string, ementa string, processoSei string, status string, boletimNumero string, linkBoletim string, tags string, conteudoResumido string, relacoes string"
SHEET_RELATION = "array<struct<id:string,tipoRelacao:string,atoDestino:string,detalhes:string>>"


def struct(fields: str) -> str:
    """A DDL column list as a struct type."""
    import re

    return f"struct<{re.sub(r'(^|, )(\w+) ', r'\1\2:', fields)}>"
