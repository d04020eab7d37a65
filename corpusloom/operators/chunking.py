"""Chunking of regulations for the vector index (CHK-01..08): segments packed into chunks of limited word count.

The packers run in Arrow batches on whole texts, the word windows in plain SQL. Documents without text keep one chunk with
it as it is. ``chunk_index`` counts from 0; a document of one chunk keeps its own id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WORDS, WINDOW_OVERLAP, PREAMBLE, SHORT = 270, 50, 500, 50
#: Document types that are chunked by article.
ARTICLE_TYPES = ["ica", "mca", "pca", "nsca", "dca", "tca", "fca", "oca", "rca", "roca", "rica", "rima", "rma", "npa", "bca", "bma", "ima", "circea", "decea", "rbac"]
#: Where articles, sentences, paragraphs and items of legal texts begin.
_article = re.compile(r"(?:^|\n)\s*Art\.?\s*(\d+)[°º]?[\s\-.]*", re.I | re.M)
_article_ahead = re.compile(r"(?=\bArt\s*\.?\s*\d)")
_sentence_gap = re.compile(r"(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÀÂÊÔÃÕÇ])")
_paragraph_ahead = re.compile(r"(?=\n\s*(?:§\s*\d+|Parágrafo))", re.I)
_item_ahead = re.compile(r"(?=\n\s*[IVXLC]+\s*[\-–])")


def by_article(doc_type: Column) -> Column:
    """Whether a type's documents are chunked by article (CHK-01)."""
    return F.coalesce(doc_type.rlike(rf"(?i)\b(?:{'|'.join(sorted(ARTICLE_TYPES, key=len, reverse=True))})\b"), F.lit(False))


def windows(words: list[str], size: int, overlap: int) -> list[str]:
    """Windows of ``size`` words that step by ``size - overlap``; the last may hold nothing but overlap (CHK-04)."""
    step = size - overlap if 0 < overlap < size else size
    starts = [0]
    while starts[-1] + size <= len(words) and (starts[-1] + step < len(words)):
        starts.append(starts[-1] + step)
    return [" ".join(words[s : s + size]) for s in starts if s < len(words)]


def filled(parts: Iterator[str] | list[str]) -> list[str]:
    return [p for p in (x.strip() for x in parts) if p]


def segments_of(text: str) -> list[str]:
    """Paragraphs, else more than ten lines, else articles, else sentences (CHK-03)."""
    for parts, least in ((text.split("\n\n"), 2), (text.split("\n"), 11), (_article_ahead.split(text), 2)):
        if len(found := filled(parts)) >= least:
            return found
    return filled(_sentence_gap.split(text))


def packed(parts: list[str], limit: int, overlap: int, carry: bool, label: str = "") -> list[str]:
    """Parts joined up to ``limit`` words. A larger part is cut into windows. With ``carry``, a chunk begins with the last
    of several parts before it. With ``label``, chunks after the first, and cut ones, that don't begin with it get it as title."""
    out: list[str] = []
    group: list[str] = []
    held = 0

    def titled(text: str, always: bool) -> str:
        return f"{label} (continuação)\n{text}" if label and always and not text.startswith(label) else text

    def flush(always: bool = True) -> None:
        if group:
            out.append(titled("\n".join(group), always))

    for part in parts:
        n = len(part.split())
        if n > limit:
            flush()
            group, held = [], 0
            out += [titled(w, True) for w in windows(part.split(), limit, overlap)]
        elif group and held + n > limit:
            flush()
            group = [group[-1], part] if carry and overlap > 0 and len(group) > 1 else [part]
            held = sum(len(p.split()) for p in group)
        else:
            group.append(part)
            held += n
    flush(bool(out))
    return out


def segment_chunks(text: str, limit: int = MAX_WORDS, overlap: int = WINDOW_OVERLAP) -> list[tuple[str, str | None, str]]:
    """``(id suffix, article, text)`` of a text chunked by its segments (CHK-02)."""
    if len(text.split()) <= limit:
        return [("", None, text)]
    return [(f"-chunk-{i}", None, c) for i, c in enumerate(packed(segments_of(text), limit, overlap, carry=True))]


def article_chunks(text: str, limit: int = MAX_WORDS, overlap: int = WINDOW_OVERLAP, keep_preamble: bool = False) -> list[tuple[str, str | None, str]]:
    """Chunks of a text by its articles (CHK-05..07). What precedes the first article goes into the first chunk if it is short;
    a longer one is lost unless ``keep_preamble``."""
    if len(text.strip()) < SHORT:
        return [("", None, text)]
    marks = list(_article.finditer(text))
    if not marks:
        if len(text.split()) <= limit:
            return [("", None, text)]
        parts = filled(re.split(r"\n\n+", text))
        parts = parts if len(parts) > 1 else filled(text.split("\n"))
        return [(f"-chunk-{i}", None, c) for i, c in enumerate(packed(parts, limit, overlap, carry=False))]
    preamble = text[: marks[0].start()].strip()
    out: list[tuple[str, str | None, str]] = []
    for mark, end in zip(marks, [*(m.start() for m in marks[1:]), len(text)]):
        number, body = mark[1], text[mark.start() : end].strip()
        if len(body.split()) <= limit:
            out.append((f"-art{number}", number, body))
            continue
        for ahead in (_paragraph_ahead, _item_ahead):
            if len(parts := filled(ahead.split(body))) > 1:
                pieces = packed(parts, limit, overlap, carry=False, label=f"Art. {number}")
                break
        else:
            pieces = windows(body.split(), limit, overlap)
        out += [(f"-art{number}-{i}", number, p) for i, p in enumerate(pieces)]
    if preamble and len(preamble) < PREAMBLE:
        out[0] = (*out[0][:2], f"{preamble}\n\n{out[0][2]}")
    elif preamble and keep_preamble:
        out.insert(0, ("-preamble", None, preamble))
    return out


CHUNK = "regulation_id string, doc_id string, chunk_index int, article_number string, chunk_type string, text string"


def chunk_documents(df: DataFrame, doc_type: str = "doc_type", content: str = "content", limit: int = MAX_WORDS, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """One row per chunk of every document, by the chunker of its type."""
    rows = df.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col(content), F.lit("")).alias("text"), by_article(F.col(doc_type)).alias("articles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, articles in zip(*(c.to_pylist() for c in b.columns)):
                for i, (suffix, number, chunk) in enumerate((article_chunks if articles else segment_chunks)(text, limit, overlap)):
                    kind = ("article_part" if suffix.count("-") > 1 else "article") if number else "segment"
                    out.append((f"{doc}{suffix}", doc, i, number, kind, chunk))
            types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names=["regulation_id", "doc_id", "chunk_index", "article_number", "chunk_type", "text"])

    return rows.mapInArrow(run, CHUNK)


def word_windows(df: DataFrame, key: str, text: str, size: int = MAX_WORDS, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """The word windows of every text, without leaving the JVM: ``(key, chunk_index, n_words, chunk)``."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    step = size - overlap
    n = F.size("_w")
    # a window starts wherever a full one before it leaves words or overlap
    count = F.when(n < size, 1).otherwise(F.floor((n - size) / step) + 1 + F.when((F.floor((n - size) / step) + 1) * step < n, 1).otherwise(0))
    rows = df.select(F.col(key), words.alias("_w")).filter(F.size("_w") > 0)
    # the windows are cut out before they become rows, so no row carries the whole text
    piece = lambda i: F.slice("_w", i * step + 1, size)
    cut = F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: F.struct(i.alias("chunk_index"), F.size(piece(i)).alias("n_words"), F.array_join(piece(i), " ").alias("chunk")))
    return rows.select(key, F.explode(cut).alias("_p")).select(key, "_p.*")


def numbered_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sections under numbered headings (CHK-08): ``(key, section, number, body)``; what precedes the first is left out.

    Runs within the row and in time linear in the text: it is cut before each heading.
    """
    heading = r"[^\S\n]*(\d+(?:\.\d+)*)\.?[^\S\n]+[A-ZÁÉÍÓÚÀÂÊÔÃÕÇ]"
    pieces = F.split(F.col(text), rf"(?md)(?=^{heading})")
    last = F.size(pieces) - 1
    # the line end before a heading belongs to neither section
    whole = F.transform(pieces, lambda x, i: F.struct(F.regexp_extract(x, f"^{heading}", 1).alias("number"), F.when(i < last, F.regexp_replace(x, r"\n\z", "")).otherwise(x).alias("body")))
    found = F.filter(whole, lambda x: x["number"] != "")
    return df.select(key, F.posexplode(found).alias("section", "s")).select(key, "section", "s.number", "s.body")
