"""Dates of validity in the text of a regulation (FN-28..35), as Column expressions. Null text gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names, and the phrases that introduce dates of effect or revocation.
MONTHS = {"janeiro": 1, "fevereiro": 2, "março": 3, "marco": 3, "abril": 4, "maio": 5, "junho": 6, "julho": 7, "agosto": 8, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12}
NUMERIC = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
SPELLED = rf"\d{{1,2}}[ºª°]?\s+de\s+(?:{'|'.join(MONTHS)})\s+de\s+\d{{4}}"
ANY = f"(?:{NUMERIC}|{SPELLED})"
EFFECTIVE = [
    rf"(?iu)entra(?:rá)?\s+em\s+vigor\s+(?:em|na data de|a partir de)?\s*({ANY})",
    rf"(?iu)vigência\s+a\s+partir\s+de\s+({ANY})",
    rf"(?iu)produzirá\s+efeitos?\s+(?:a\s+partir\s+de)?\s*({ANY})",
    rf"(?iu)passa\s+a\s+vigorar\s+(?:em|na data de)?\s*({ANY})",
]
ON_PUBLICATION = r"(?iu)(?:após|da|na\s+data\s+de)\s+(?:sua\s+)?publicação"
REVOKED = [
    r"(?iu)revogad[ao]\s+(?:pela?|por)\b",
    r"(?iu)(?:esta|a\s+presente)\s+\S+\s+.*?\brevogad[ao]",
    r"(?iu)perde(?:rá)?\s+(?:sua\s+)?vigência",
    r"(?iu)deixa(?:rá)?\s+de\s+vigorar",
]


def parse_date(c: Column) -> Column:
    """ISO text of a date: ISO itself, spelled out in Portuguese, or day first (FN-31); null if it is none.

    A second number over 12 can be no month, so the month is first then. Years of two digits are those within 50 years of the
    current one.
    """
    part = lambda p, i: F.regexp_extract(c, p, i)
    spelled = rf"(?iu)(\d{{1,2}})[ºª°]?\s+de\s+({'|'.join(MONTHS)})\s+de\s+(\d{{4}})"
    month = F.try_element_at(F.create_map(*(F.lit(x) for p in MONTHS.items() for x in p)), F.lower(part(spelled, 2)))
    numeric = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})"
    year = part(numeric, 3)
    now = F.year(F.current_date())
    near = year.try_cast("int") + F.floor(now / 100) * 100
    near = F.when(near >= now + 50, near - 100).when(near < now - 50, near + 100).otherwise(near)
    full = F.when(F.length(year) == 2, near.cast("string")).otherwise(year)
    second = part(numeric, 2).try_cast("int") > 12
    day, number = (F.when(second, part(numeric, i)).otherwise(part(numeric, j)) for i, j in ((2, 1), (1, 2)))
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.coalesce(
        F.regexp_extract(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c), r"^(.*)$", 1),
        F.date_format(F.try_to_date(F.concat_ws("-", F.nullif(part(spelled, 3), F.lit("")), pad(month), pad(part(spelled, 1))), "yyyy-MM-dd"), "yyyy-MM-dd"),
        F.date_format(F.try_to_date(F.concat_ws("-", full, pad(number), pad(day)), "yyyy-MM-dd"), "yyyy-MM-dd"),
    )


def effective_date(text: Column, published: Column) -> Column:
    """The date of effect that a text states, else the publication date if it refers to that (FN-28)."""
    stated = [parse_date(F.nullif(F.regexp_extract(text, p, 1), F.lit(""))) for p in EFFECTIVE]
    return F.coalesce(*stated, F.when(text.rlike(ON_PUBLICATION), published))


def is_revoked(text: Column) -> Column:
    """Whether a text says that it is revoked itself (FN-29)."""
    return F.coalesce(F.reduce(F.array(*(text.rlike(p) for p in REVOKED)), F.lit(False), lambda a, b: a | b), F.lit(False))


def expiry_date(text: Column) -> Column:
    """A numeric date in the 100 characters after the first words of revocation (FN-30); dates further on or after later words
    don't count."""

    def after(p: str) -> Column:
        # everything after the first occurrence
        rest = F.regexp_extract(text, rf"(?iu){p.removeprefix('(?iu)')}(?s:(.*))$", 1)
        return parse_date(F.nullif(F.regexp_extract(F.substring(rest, 1, 100), NUMERIC, 0), F.lit("")))

    return F.coalesce(*(after(p) for p in REVOKED))


def all_dates(text: Column) -> Column:
    """All numeric dates of a text, as ISO (FN-32)."""
    return F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(NUMERIC), F.lit(0)), parse_date))


def amended_act(text: Column) -> Column:
    """``lei-123`` for a text that amends a law, decree or resolution (FN-33)."""
    pattern = r"(?iu)(?:altera|modifica|dá\s+nova\s+redação)\b.{0,80}?\b(lei|decreto|resolução)\s+(?:n[º°o.]*\s*)?([0-9][0-9.]*)"
    return F.when(text.rlike(pattern), F.concat_ws("-", F.lower(F.regexp_extract(text, pattern, 1)), F.regexp_replace(F.regexp_extract(text, pattern, 2), r"\.", "")))
