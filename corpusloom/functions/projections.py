"""Texts and records made of a document's fields (PRJ-01..04, PRJ-07..13, FN-24, FN-26, FN-34, FN-35, FN-39, FN-44, FN-48, FLT-10, FLT-17), as Column
expressions. Empty texts count as missing, as do nulls; broken metadata counts as having no fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.dates import MONTHS
from corpusloom.functions.ids import TYPE_CODES, WS, first_filled, squeeze

#: Plural labels of document types, folders by a part of the type, words of a question that name a filter, and phrases that ask for
#: an order.
TYPE_LABELS = {
    "Lei": "Leis", "Lei Complementar": "Leis Complementares", "Decreto": "Decretos", "Decreto-Lei": "Decretos-Lei", "Medida Provisória": "Medidas Provisórias",
    "Portaria": "Portarias", "Portaria Conjunta": "Portarias Conjuntas", "Resolução": "Resoluções", "Instrução Normativa": "Instruções Normativas",
    "Constituição Federal": "Constituição Federal", "Ordem técnica": "Ordens Técnicas", "Orientação normativa": "Orientações Normativas", "Manual Eletrônico": "Manuais Eletrônicos",
}
FOLDERS = {
    "lei": "leis", "lei.complementar": "leis", "lei.ordinaria": "leis", "decreto": "leis", "decreto.lei": "leis", "ica": "ica", "instrucao": "ica",
    "rbac": "rbac", "regulamento": "rbac", "portaria": "portarias", "resolucao": "resolucoes", "resolução": "resolucoes",
}
FILTER_WORDS = {
    "ICA": "type=ICA", "MCA": "type=MCA", "DCA": "type=DCA", "RCA": "type=RCA", "PCA": "type=PCA", "NSCA": "type=NSCA", "RICA": "type=RICA", "FCA": "type=FCA",
    "DECEA": "authority=DECEA", "ANAC": "authority=ANAC", "COMAER": "authority=COMAER", "FAB": "authority=FAB", "DCTA": "authority=DCTA", "DIRSA": "authority=DIRSA",
}
SORT_PHRASES = [
    (r"(?i)\bmais\s+recente", "sort_by_date_desc"),
    (r"(?i)\b(?:nov[ao]s?|atual|atualizad[ao]s?)\b", "sort_by_date_desc"),
    (r"(?i)\b(?:antig[ao]s?|primeir[ao]s?)\b", "sort_by_date_asc"),
    (r"(?i)\b(?:em\s+vigor|vigentes?)\b", "filter_active"),
]
#: Fields of the metadata that hold a publication date, in order.
PUBLICATION_FIELDS = ("date", "publication_date", "date_published", "ato_publicacao", "portaria_aprovacao")


def meta(name: str, column: str = "metadata") -> Column:
    """A text field of the metadata; null where that is broken."""
    return F.try_variant_get(F.try_parse_json(column), f"$.{name}", "string")


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def article(df: DataFrame, text: str = "content") -> DataFrame:
    """The record that is chunked and indexed: fields of the row, else of its metadata (PRJ-01)."""
    col = F.col
    kind = first_filled(col("doc_type"), meta("type"), meta("doc_type"))
    return df.select(
        col("doc_id").alias("regulation_id"),
        F.coalesce(first_filled(col("title"), meta("title")), F.lit("")).alias("title"),
        col(text).alias("text"),
        first_filled(col("effective_date"), meta("date"), meta("date_published")).alias("effective_date"),
        col("expiry_date"),
        F.coalesce(first_filled(col("status"), meta("status")), F.lit("active")).alias("status"),
        col("version_year"),
        (F.coalesce(col("is_latest"), F.lit(0)) != 0).alias("is_latest"),
        col("canonical_id"),
        F.struct(
            first_filled(col("title"), meta("title")).alias("title"),
            first_filled(col("url"), meta("source_url")).alias("url"),
            first_filled(col("urn"), meta("urn")).alias("urn"),
            F.coalesce(kind, F.lit("")).alias("type"),
            first_filled(col("number"), meta("number")).alias("number"),
            first_filled(col("authority"), meta("authority")).alias("authority"),
            meta("description").alias("description"),
            col("source"),
            F.lit("document").alias("chunk_type"),
        ).alias("metadata"),
    )


def publication_date(column: str = "metadata") -> Column:
    """The first filled field of the metadata that holds a publication date (PRJ-03)."""
    return first_filled(*(meta(f, column) for f in PUBLICATION_FIELDS))


def temporal_override(stated: Column, extracted: Column, expiry: Column, revoked_on: Column) -> tuple[Column, Column]:
    """Status and expiry: a stated status wins over the extracted one, a date of revocation fills a missing expiry (PRJ-04)."""
    return F.coalesce(filled(stated), extracted), F.coalesce(filled(expiry), filled(revoked_on))


def flattened(hits: DataFrame, payload: str = "payload") -> DataFrame:
    """Hits with the fields of their payload beside their own, which win where names clash (PRJ-02)."""
    own = [c for c in hits.columns if c != payload]
    return hits.select(*own, *(F.col(f"{payload}.{f}").alias(f) for f in hits.schema[payload].dataType.names if f not in own))


def trace_documents(hits: DataFrame) -> DataFrame:
    """The few fields of a hit that a trace keeps, empty where missing (PRJ-07)."""
    names = ("regulation_id", "title", "doc_type", "number", "authority")
    return hits.select("query_id", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names), F.coalesce("score", F.lit(0.0)).alias("score"))


def type_label(kind: Column) -> Column:
    """A type as it is shown, itself by default (PRJ-09)."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in TYPE_LABELS.items() for x in p)), kind), kind)


def byte_size(n: Column) -> Column:
    """``12.3 KB`` in steps of 1,024, ``N/A`` for null and 0 (PRJ-10)."""
    out = None
    for i, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        text = F.concat(F.format_string("%.1f", F.bround(n / float(1024**i), 1)), F.lit(f" {unit}"))
        out = F.when(n < 1024 ** (i + 1), text) if out is None else out.when(n < 1024 ** (i + 1), text)
    return F.when(n.isNull() | (n == 0), "N/A").otherwise(out.otherwise(F.concat(F.format_string("%.1f", n / float(1024**5)), F.lit(" PB"))))


def word_list(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Words between white space; 0 for null (FN-44)."""
    return F.coalesce(F.size(word_list(c)), F.lit(0)) if c is not None else F.lit(0)


def truncate_words(c: Column, n: int) -> Column:
    """At most ``n`` words, joined by single spaces only if some were cut (FN-44)."""
    words = word_list(c)
    return F.when(F.size(words) <= n, c).otherwise(F.array_join(F.slice(words, 1, n), " "))


def context_block(kind: Column, number: Column, title: Column, authority: Column, text: Column, position: Column, chars: int = 0) -> Column:
    """A document as a model reads it: label, title, authority, then the text, cut to ``chars`` if that is over 0."""
    kind, number, title, authority, text = (F.coalesce(c, F.lit("")) for c in (kind, number, title, authority, text))
    label = F.when(kind != "", F.trim(F.concat(kind, F.lit(" "), number))).otherwise(F.concat(F.lit("Doc "), position.cast("string")))
    body = F.substring(text, 1, chars) if chars > 0 else text
    return F.concat_ws("\n", F.concat(F.lit("["), label, F.lit("]")), F.concat(F.lit("Título: "), filled(title)), F.concat(F.lit("Órgão: "), filled(authority)), body)


def contexts(hits: DataFrame, chars: int = 0) -> DataFrame:
    """``(query_id, context)``: the blocks of a query's hits in the order of ``rank`` (PRJ-11). A query has as many as its top k."""
    block = context_block(*(F.col(c) for c in ("doc_type", "number", "title", "authority", "text", "rank")), chars)
    lists = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    return lists.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n---\n").alias("context"))


def prompt(query: Column, context: Column, history: Column) -> Column:
    """History lines (``array<struct<role, content>>``), documents and question, a blank line between (PRJ-12)."""
    past = F.transform(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"]))
    return F.concat_ws("\n\n", past, F.concat(F.lit("DOCS:\n"), filled(context)), F.concat(F.lit("Q: "), query))


def evaluator_text(title: Column, kind: Column, number: Column, authority: Column, body: Column, words: int = 480) -> Column:
    """``title | type — nº number — authority``, then the body, cut to a number of words (PRJ-13)."""
    ids = F.concat_ws(" — ", filled(kind), F.concat(F.lit("nº "), filled(number)), filled(authority))
    prefix = F.concat_ws(" | ", filled(title), filled(ids))
    body = F.coalesce(body, F.lit(""))
    return truncate_words(F.when(prefix != "", F.concat(prefix, F.lit("\n"), body)).otherwise(body), words)


def search_text(query: Column, history: Column, last: int = 3) -> Column:
    """The last user messages before the question itself (FN-48)."""
    asked = F.transform(F.filter(history, lambda m: m["role"] == "user"), lambda m: m["content"])
    recent = F.slice(asked, F.greatest(F.lit(1), F.size(asked) - last + 1), last)
    return F.concat_ws(" ", F.coalesce(recent, F.array().cast("array<string>")), query)


def free_text_date(c: Column) -> Column:
    """``dd/mm/yyyy`` of a text: the first numeric date as it is, else the first spelled out (FN-35)."""
    numeric = F.regexp_extract(c, r"\b(\d{1,2}/\d{1,2}/\d{4})\b", 1)
    pattern = rf"(?iu)\b(\d{{1,2}})\s+de\s+({'|'.join(MONTHS)})\s+de\s+(\d{{4}})\b"
    month = F.try_element_at(F.create_map(*(F.lit(x) for m, n in MONTHS.items() for x in (m, f"{n:02d}"))), F.lower(F.regexp_extract(c, pattern, 2)))
    spelled = F.concat_ws("/", F.lpad(F.regexp_extract(c, pattern, 1), 2, "0"), month, F.regexp_extract(c, pattern, 3))
    return F.coalesce(filled(numeric), F.when(month.isNotNull(), spelled))


def add_days(day: Column, n: Column | int) -> Column:
    """ISO text in and out, null if it is no date (FN-34)."""
    return F.date_format(F.date_add(F.try_to_date(day, "yyyy-MM-dd"), n), "yyyy-MM-dd")


def slug(number: Column, kind: Column) -> Column:
    """``ICA96-1`` as ``ICA-96-1`` (FN-26): a dash after the type if a digit follows; spaces as dashes."""
    rest = F.substr(number, F.length(kind) + 1)
    return F.translate(F.when(rest.rlike(r"^\d"), F.concat(kind, F.lit("-"), rest)).otherwise(number), " ", "-")


def type_code(name: Column) -> Column:
    """The register's code of a type: its own, else that of the first type of which one is a prefix of the other (FN-24)."""
    key = F.upper(F.trim(name))
    exact = F.try_element_at(F.create_map(*(F.lit(x) for p in TYPE_CODES.items() for x in p)), key)
    near = None
    for kind, code in TYPE_CODES.items():
        fits = F.lit(kind).startswith(key) | key.startswith(kind)
        near = F.when(fits, code) if near is None else near.when(fits, code)
    return F.coalesce(exact, near)


def folder(kind: Column) -> Column:
    """The folder of a type: the first of ``FOLDERS`` that the type contains, else ``outros`` (FN-39)."""
    lower, out = F.lower(F.coalesce(kind, F.lit(""))), None
    for part, name in FOLDERS.items():
        out = F.when(lower.contains(part), name) if out is None else out.when(lower.contains(part), name)
    return out.otherwise("outros")


def intents(query: Column) -> tuple[Column, Column]:
    """Filters that words in capitals name, and sorts that phrases ask for, in order (FLT-17)."""
    words = F.regexp_extract_all(query, F.lit(r"\b([A-Z]{3,})\b"), F.lit(1))
    known = F.create_map(*(F.lit(x) for p in FILTER_WORDS.items() for x in p))
    sorts = F.array_compact(F.array(*(F.when(query.rlike(p), label) for p, label in SORT_PHRASES)))
    return F.array_compact(F.transform(words, lambda w: F.try_element_at(known, w))), sorts


def long_enough(c: Column, least: int = 50) -> Column:
    """Whether a text has at least so many characters between its outer blanks (FLT-10); null has none."""
    return F.coalesce(F.length(F.regexp_replace(c, f"^{WS}+|{WS}+$", "")) >= least, F.lit(False))


def keyword_filter(index: DataFrame, kinds: list[str], keywords: list[str], kind: str = "doc_type", title: str = "title") -> DataFrame:
    """Rows of some types, whatever their case, whose title has any of the keywords; no keywords ask for nothing (SRC-26)."""
    out = index.filter(F.upper(F.col(kind)).isin([k.upper() for k in kinds]))
    if not keywords:
        return out
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.lower(F.col(title)).contains(k.lower())
    return out.filter(hit)


def page_text(native: Column, recognised: Column, least: int = 50) -> Column:
    """A page's own text if it has over ``least`` characters, else what was recognised (SRC-15)."""
    return F.when(F.length(squeeze(native)) > least, native).otherwise(F.coalesce(recognised, native, F.lit("")))


def joined_pages(pages: DataFrame) -> DataFrame:
    """``(doc_id, text)``: a document's pages in order, each under its separator (SRC-15). A document is one file, so its pages are few."""
    lists = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    parts = F.transform("p", lambda x: F.concat(F.lit("--- PÁGINA "), x["page"].cast("string"), F.lit(" ---\n"), x["text"]))
    return lists.select("doc_id", F.array_join(parts, "\n\n").alias("text"))
