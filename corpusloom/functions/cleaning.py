"""Cleaning of extracted text (FN-01..13): a fixed order of steps, all but one of them Column expressions.

NFKC has no expression in Spark, so it is an Arrow UDF that only rows with characters beyond ASCII pass through.
A null text stays null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Lines that web portals put into documents, and page headers, in Java's regular expressions.
PORTAL_LINES = [
    r"(?imud)^\s*\[Detalhes\s+da\s+Norma\]\s*$",
    r"(?imud)^[^\n]*Este\s+texto\s+não\s+substitui\s+o\s+original\s+publicado\s+no\s+Diário\s+Oficial[^\n]*$",
    r"(?md)^\s*Terminal\s*-\s*Sophia\s+Biblioteca\s+Web\s*$",
    r"(?md)^\s*Terminal\s+de\s+consulta\s+web\s*$",
    r"(?md)^\s*Deseja\s+instalar\s+o\s+aplicativo\?\s*$",
    r"(?md)^\s*Desenvolvido\s+por\s+Soluções\s+Sophia\s*$",
    r"(?md)^\s*Selecionar\s+Favoritar\s+Link\s+do\s+t[ií]tulo\s*$",
    r"(?md)^\s*Inclus[ãa]o\s+da\s+autoridade\s+no\s+perfil\s+de\s+interesse\s*$",
    r"(?md)^\s*Controle\s+de\s+acesso\s*$",
    r"(?md)^\s*Você\s+não\s+tem\s+acesso\s+a\s+este\s+arquivo\.\s*$",
    r"\{\{\s*detalheLegislacaoCtrl\.[^}]+\}\}",
    r"(?md)^\s*Sim\s+Não\s*$",
    r"(?md)^\s*Ver\s+perfil\s+de\s+interesse\s+Fechar\s*$",
]
REPEATED_HEADERS = [
    r"(?imud)^\s*MINISTÉRIO\s+DA\s+DEFESA\s*$",
    r"(?imud)^\s*COMANDO\s+DA\s+AERONÁUTICA\s*$",
    r"(?imud)^\s*DEPARTAMENTO\s+DE\s+CONTROLE\s+DO\s+ESPAÇO\s+AÉREO\s*$",
    r"(?imud)^\s*AGÊNCIA\s+NACIONAL\s+DE\s+AVIAÇÃO\s+CIVIL\s*$",
    r"(?md)^\s*ICA\s+\d+[-–]\d+/\d{4}\s*$",
    r"(?imud)^\s*RBAC\s+n[°º]?\s*\d+\s+EMD\s+\d+\s*$",
]
TOC_LINES, SEPARATORS = r"(?md)^.*\.{5,}\s*\d+\s*$", r"(?md)^\s*[_\-=]{5,}\s*$"
#: For each of ``PORTAL_LINES`` that knows one case only a word that a text with a match has.
PORTAL_WORDS = [None, None, "Terminal", "Terminal", "Deseja", "Desenvolvido", "Favoritar", "Inclus", "Controle", "Você", "detalheLegislacaoCtrl", "Sim", "Fechar"]
VOWELS = "aeiouáéíóúàâêôãõ"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Compatibility normal form (FN-01)."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), _nfkc(c)).otherwise(c)


def strip_controls(c: Column) -> Column:
    """ETX becomes a space, other control characters but line ends and tabs go (FN-02)."""
    return F.regexp_replace(F.translate(c, "\x03", " "), r"[\p{C}&&[^\n\r\t]]", "")


def garbled_word(w: Column) -> Column:
    """Whether a word of letters has hardly any vowels, or far more of them three letters back (FN-04).

    ``translate`` counts them: it drops the vowels, or the letters that become vowels when shifted.
    """
    letters, n = F.lower(w), F.length(w)
    shifted = "".join(LETTERS[(LETTERS.index(v) + 3) % 26] for v in VOWELS if v in LETTERS) + "".join(v for v in VOWELS if v not in LETTERS)
    vowels = n - F.length(F.translate(letters, VOWELS, ""))
    decoded = n - F.length(F.translate(letters, shifted, ""))
    return (n >= 5) & ((vowels < n * 0.10) | ((decoded - vowels > n * 0.12) & (decoded > n * 0.35)))


def drop_garbled_lines(c: Column) -> Column:
    """Lines of which at least two and at least half of the longer words are garbled go (FN-05)."""

    def keep(line: Column) -> Column:
        words = F.regexp_extract_all(line, F.lit(r"[a-zA-ZÀ-ÿ]{5,}"), F.lit(0))
        bad = F.size(F.filter(words, garbled_word))
        return ~((bad >= 2) & (bad * 2 >= F.size(words)))

    return F.array_join(F.filter(F.split(c, "\n", -1), keep), "\n")


def drop_page_numbers(c: Column) -> Column:
    """Lines ``N/M`` with 1 <= N <= M and M >= 2 go (FN-07). Texts and lines that can't be such are told cheaply first."""

    def keep(line: Column) -> Column:
        part = lambda i: F.regexp_extract(line, r"^\s*(\d{1,3})\s*/\s*(\d{1,3})\s*$", i).try_cast("int")
        page = F.coalesce((part(1) >= 1) & (part(1) <= part(2)) & (part(2) >= 2), F.lit(False))
        return F.when(line.contains("/") & (F.length(F.trim(line)) < 40), ~page).otherwise(F.lit(True))

    return F.when(c.rlike(r"(?m)^\s*\d{1,3}\s*/\s*\d{1,3}\s*$"), F.array_join(F.filter(F.split(c, "\n", -1), keep), "\n")).otherwise(c)


def join_hyphens(c: Column) -> Column:
    """Words broken at a line's end are joined if they go on in lower case (FN-11)."""
    return F.regexp_replace(c, r"(?U)-\s*\n\s*(?<=\w{3}-\s{1,200})(?=[a-záéíóúàâêôãõçü]\w{2})", "")


def squeeze_layout(c: Column) -> Column:
    """At most one blank line, single spaces, no white space at line or text ends (FN-12)."""
    spaced = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    return F.regexp_replace(F.regexp_replace(spaced, r"(?U)(?md)[^\S\n]+$", ""), r"(?U)^\s+|\s+$", "")


def straight_quotes(c: Column) -> Column:
    """Typographic quotes as plain ones (FN-10)."""
    return F.translate(c, "“”‘’", "\"\"''")


def drop_repeated(c: Column, pattern: str) -> Column:
    """Matches of a header pattern go if there are several (FN-06)."""
    return F.when(F.regexp_count(c, F.lit(pattern)) > 1, F.regexp_replace(c, pattern, "")).otherwise(c)


def guarded(word: str | None, step: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A step for texts that have a word; a search for it is far cheaper than for the pattern."""
    return step if word is None else lambda c: F.when(c.contains(word), step(c)).otherwise(c)


def _dropping(pattern: str) -> Callable[[Column], Column]:
    return lambda c: F.regexp_replace(c, pattern, "")


def _dropping_repeated(pattern: str) -> Callable[[Column], Column]:
    return lambda c: drop_repeated(c, pattern)


def clean(df: DataFrame, content: str = "content", out: str = "clean") -> DataFrame:
    """``df`` with the cleaned content, and the characters and percentage removed (FN-13).

    Each step is a column of its own in the plan, so no step's expression is evaluated twice.
    """
    work = df.withColumn("_t", nfkc(F.col(content)))
    steps = [
        strip_controls,
        *(guarded(w, _dropping(p)) for w, p in zip(PORTAL_WORDS, PORTAL_LINES)),
        drop_garbled_lines,
        *map(_dropping_repeated, REPEATED_HEADERS),
        drop_page_numbers,
        lambda c: F.when(c.contains("....."), F.regexp_replace(c, TOC_LINES, "")).otherwise(c),
        _dropping(SEPARATORS),
        straight_quotes,
        join_hyphens,
        squeeze_layout,
    ]
    for step in steps:
        # an alias that the optimizer won't inline where it is used twice
        work = work.withColumn("_t", F.element_at(F.transform(F.array("_t"), step), 1))
    before, after = F.length(content), F.length("_t")
    return work.withColumns(
        {
            out: F.col("_t"),
            "chars_removed": (before - after).cast("bigint"),
            "reduction_pct": F.coalesce((before - after) * 100.0 / F.nullif(before, F.lit(0)), F.lit(0.0)),
        }
    ).drop("_t")
