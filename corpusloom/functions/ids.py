"""Keys and identities of documents, chunks and queries, as Column expressions (FN-18..27, FN-36, FN-37, FN-40).

All of them give null for null input unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.split`` knows it, for Java's regular expressions.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same characters, for trims by a set of characters.
WS_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Document types as they are written out.
DOC_TYPES = {
    "PORTARIA": "Portaria",
    "PORTARIA CONJUNTA": "Portaria Conjunta",
    "INSTRUÇÃO NORMATIVA": "Instrução Normativa",
    "INSTRUCAO NORMATIVA": "Instrução Normativa",
    "LEI": "Lei",
    "LEI COMPLEMENTAR": "Lei Complementar",
    "DECRETO": "Decreto",
    "DECRETO - LEI": "Decreto-Lei",
    "DECRETO-LEI": "Decreto-Lei",
    "MEDIDA PROVISÓRIA": "Medida Provisória",
    "RESOLUÇÃO": "Resolução",
    "RESOLUCAO": "Resolução",
    "CONSTITUIÇÃO FEDERAL": "Constituição Federal",
    "ORDEM TÉCNICA": "Ordem técnica",
    "ORIENTAÇÃO NORMATIVA": "Orientação normativa",
    "MANUAL ELETRÔNICO": "Manual Eletrônico",
}
#: Codes of the register's document types.
TYPE_CODES = {
    "AVISO": 20, "BCA": 17, "BMA": 24, "BOLETIM EXTERNO": 44, "COMUNICADO": 38, "CONSTITUIÇÃO FEDERAL": 39, "DCA": 3, "DECRETO": 18, "DECRETO - LEI": 25,
    "FCA": 4, "ICA": 5, "IMA": 31, "INSTRUÇÃO NORMATIVA": 43, "LEI": 22, "LEI COMPLEMENTAR": 41, "MANUAL - OUTROS": 40, "MANUAL ELETRÔNICO": 21, "MCA": 6,
    "MEDIDA PROVISÓRIA": 42, "NOPREP": 30, "NORMAS DO COMPREP": 29, "NOTA": 33, "NPA": 36, "NSCA": 1, "OCA": 7, "ORDEM TÉCNICA": 34, "ORIENTAÇÃO NORMATIVA": 35,
    "PCA": 8, "PORTARIA": 19, "PORTARIA CONJUNTA": 37, "PTA": 28, "RCA": 16, "RESOLUÇÃO": 32, "RICA": 14, "RIMA": 45, "RMA": 26, "ROCA": 15, "TCA": 9,
}


def doc_type_name(c: Column) -> Column:
    """A document type as it is written out, others in capitals (FN-23); null for an empty one."""
    upper = F.nullif(F.upper(squeeze(c)), F.lit(""))
    known = F.create_map(*(F.lit(x) for pair in DOC_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, upper), upper)


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends (Python's ``" ".join(s.split())``)."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def content_hash(content: Column) -> Column:
    """SHA-256 of the lower-cased content with its white space squeezed (FN-18)."""
    return F.sha2(squeeze(F.lower(content)), 256)


def split_version_year(number: Column) -> tuple[Column, Column]:
    """Number without a final ``/YYYY``, and that year or null (FN-19)."""
    pattern = r"^(?s)(.*)/([0-9]{4})$"
    trimmed = squeeze(number)
    year = F.nullif(F.regexp_extract(trimmed, pattern, 2), F.lit(""))
    return F.when(year.isNotNull(), F.regexp_extract(trimmed, pattern, 1)).otherwise(trimmed), year


def canonical_id(doc_type: Column, number: Column) -> Column:
    """``type_number`` without punctuation and without the type as a prefix of the number; null if a side is empty (FN-19)."""
    kind = F.regexp_replace(F.lower(doc_type), "[^a-z0-9]", "")
    prefix, compact = F.regexp_replace(F.upper(doc_type), " ", ""), F.regexp_replace(F.upper(number), " ", "")
    rest = F.when(compact.startswith(prefix) & (F.length(number) > F.length(prefix)), F.substr(number, F.length(prefix) + 1)).otherwise(number)
    digits = F.trim(F.regexp_replace(F.lower(rest), "[^0-9a-z./-]", ""), F.lit("-./"))
    return F.when((kind != "") & (digits != ""), F.concat_ws("_", kind, digits))


def document_id(doc_type: Column, number: Column, version_year: Column, fallback: Column) -> Column:
    """``canonical/year``, else ``canonical``, else the fallback."""
    cid = canonical_id(doc_type, number)
    return F.coalesce(F.concat(cid, F.lit("/"), version_year), cid, fallback)


def uuid_of(text: Column) -> Column:
    """MD5 of a text in UUID form."""
    return F.regexp_replace(F.md5(text.cast("binary")), r"(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


def chunk_id(regulation_id: Column, text: Column) -> Column:
    """UUID of the chunk's key and the first 100 characters of its text (FN-36)."""
    return uuid_of(F.concat_ws("|", regulation_id, F.substring(text, 1, 100)))


def base_document(regulation_id: Column) -> Column:
    """Document of a chunk key: what precedes ``-chunk-`` and ``-art`` (FN-37)."""
    return F.split_part(F.split_part(regulation_id, F.lit("-chunk-"), F.lit(1)), F.lit("-art"), F.lit(1))


def _type_first(raw: Column, pattern: str) -> Column:
    kind, rest = F.regexp_extract(raw, pattern, 1), F.regexp_extract(raw, pattern, 2)
    return F.when(rest != "", F.concat(F.regexp_replace(F.lower(kind), "[^a-z0-9]", ""), F.lit("_"), rest)).otherwise(raw)


def golden_id(raw: Column) -> Column:
    """An expected id as the index writes it, without a version: ``ICA-96-1/2020-art563`` as ``ica_96-1-art563`` (FN-20)."""
    return F.regexp_replace(_type_first(raw, r"^(?s)([A-Za-z]+(?:\s+[A-Za-z]+)*)-(.+)$"), r"/[0-9]{4}(?=$|-art)", "")


def audit_id(raw: Column) -> Column:
    """The same for audits, which know types with digits and dots, and drop years anywhere (FN-21)."""
    return F.regexp_replace(_type_first(raw, r"^(?s)([A-Za-z][A-Za-z0-9.]*)[-_](.+)$"), r"/[0-9]{4}", "")


def file_safe(c: Column) -> Column:
    """At most 100 characters, unsafe ones as underscores (FN-27)."""
    return F.substring(F.regexp_replace(c, "[^a-zA-Z0-9._-]", "_"), 1, 100)


def csv_set(c: Column) -> Column:
    """Trimmed, non-empty members of a comma-separated list (FN-40)."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def urn_parts(urn: Column) -> dict[str, Column]:
    """Authority, type, date and number of a legal URN with at least six parts (FN-25)."""
    p = F.split(urn, ":")
    enough = F.size(p) >= 6
    last = F.get(p, F.lit(5))
    return {
        "urn_authority": F.when(enough, F.get(p, F.lit(3))),
        "urn_type": F.when(enough, F.get(p, F.lit(4))),
        "urn_date": F.when(enough, F.split_part(last, F.lit(";"), F.lit(1))),
        "urn_number": F.when(enough, F.nullif(F.split_part(last, F.lit(";"), F.lit(2)), F.lit(""))),
    }


def title_parts(title: Column) -> tuple[Column, Column]:
    """Type and number of a title (FN-22): ``TYPE [Nº] NUMBER`` at its start, else the longest known type it starts with and what
    follows, else nulls."""
    text = squeeze(title)
    pattern = r"^([A-ZÇÃa-zçã][A-Za-zÇÃçã\s-]*?)\s+(?:Nº\s+)?([0-9][0-9./-]*[\p{L}\p{N}_/]*[0-9]+)"
    kind, number = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    upper, known, rest = F.upper(text), None, None
    for name in sorted(TYPE_CODES, key=len, reverse=True):
        tail = F.regexp_replace(F.substr(text, F.lit(len(name) + 1)), r"^\s*/*\s*|\s+$", "")
        known = F.when(upper.startswith(name), name) if known is None else known.when(upper.startswith(name), name)
        rest = F.when(upper.startswith(name), tail) if rest is None else rest.when(upper.startswith(name), tail)
    return F.when(kind != "", doc_type_name(kind)).otherwise(doc_type_name(known)), F.when(kind != "", number).otherwise(F.nullif(rest, F.lit("")))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty (Python's chained ``or``)."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))
