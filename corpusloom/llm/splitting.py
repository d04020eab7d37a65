"""Splitting oversized texts at natural boundaries, by dynamic programming over boundary positions.

A text of more than ``max_words`` words becomes pieces of at most that many, each of which repeats the last ``overlap``
words of the piece before. Among all such cuts the one of least cost is taken, where a cut costs by the boundary it is
made at (before an article or heading, between paragraphs, lines, sentences, clauses or just words) and a piece by the
square of its deviation from equal sizes.

Words are maximal runs of characters other than space, tab, newline, carriage return and form feed, so a word is never
cut; with no natural boundary within reach, any gap between words is one. Defined results for odd input: null and blank
texts give no piece; a text within the limit is one piece, unchanged; repeated rows are split alike, each on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^ \t\n\r\f]+"
_words = re.compile(WORD).finditer
#: Penalties of a cut, natural boundaries first.
HEADING, PARAGRAPH, SENTENCE_LINE, LINE, SENTENCE, CLAUSE, GAP = 0.0, 0.05, 0.1, 0.35, 0.15, 0.6, 1.0
_heading = re.compile(r"(?:art(?:igo|icle|ículo)?\b\.?\s*\d|cap[íi]tulo\b|chapter\b|se[çc][ãa]o\b|section\b|sección\b|t[íi]tulo\b|anexo\b|§|par[áa]grafo\b|\d+(?:\.\d+)*\.?\s|[ivxlc]+\s*[-–]\s)", re.I)
_sentence_end = tuple(".!?…")
_clause_end = tuple(",;:")
#: Words that end in a full stop without ending a sentence.
ABBREVIATIONS = frozenset("art. arts. inc. fl. fls. ex. p. pág. aprox. sr. sra. dr. dra. nº. no. etc. vs. cap. al. núm. mr. mrs. fig. ss.".split())


def boundary_costs(text: str, spans: list[tuple[int, int]]) -> dict[int, float]:
    """Cost of cutting before word ``i``, for the natural boundaries."""
    out: dict[int, float] = {}
    for i in range(1, len(spans)):
        end, start = spans[i - 1][1], spans[i][0]
        last = text[end - 1]
        if start - end == 1 and text[end] == " ":
            if last in _sentence_end:
                if text[start].islower() or text[spans[i - 1][0] : end].lower() in ABBREVIATIONS:
                    continue
                # numbered articles of texts that are run together start after a sentence
                out[i] = HEADING if _heading.match(text, start) and text[start].isupper() else SENTENCE
            elif last in _clause_end:
                out[i] = CLAUSE
            continue
        gap = text[end:start]
        lines = gap.count("\n")
        if lines == 0 and "\f" not in gap and "\r" not in gap:
            if last in _sentence_end:
                out[i] = SENTENCE
        elif _heading.match(text, start):
            out[i] = HEADING
        elif lines > 1 or "\f" in gap:
            out[i] = PARAGRAPH
        else:
            out[i] = SENTENCE_LINE if last in _sentence_end or last in ":;" else LINE
    return out


def best_cuts(n: int, natural: dict[int, float], max_words: int, overlap: int) -> list[tuple[int, float]]:
    """Cuts ``(word index, cost of the boundary)`` of a text of ``n`` words, ending with ``(n, 0)``.

    Piece k covers the words from its predecessor's cut less ``overlap`` to its own cut. The candidates are the natural
    boundaries; where two of them are over half the reach apart, the gaps between words join them, so a solution exists.
    """
    reach = max_words - overlap
    if n <= max_words:
        return [(n, 0.0)]
    candidates, at = [0], 0
    for b in [*sorted(natural), n]:
        if b <= overlap:  # the first piece is longer than what the second repeats of it
            continue
        if b - at > max(1, reach // 2):
            candidates.extend(range(max(at, overlap) + 1, b))
        if b < n:
            candidates.append(b)
        at = b
    candidates.append(n)
    pieces = max(2, -(-(n - overlap) // reach))
    ideal = (n - overlap) / pieces + overlap
    # where a piece from a candidate starts; the first has no overlap before it
    origin = [0, *(c - overlap for c in candidates[1:])]
    best, back = [0.0] * len(candidates), [0] * len(candidates)

    def value(i: int, j: int) -> float:
        size = candidates[j] - origin[i]
        d = (size - ideal) / ideal
        # beyond the limit the cost rises so steeply that only pieces within it are chosen; it stays convex
        return best[i] + d * d if size <= max_words else best[i] + d * d + 1e6 * (size - max_words)

    # The cost of a piece is convex in its size, so a later origin, once better, stays better for all later ends:
    # the queue has each origin with the first end that it is best for.
    queue, head, last = [(0, 1)], 0, len(candidates) - 1
    for j in range(1, last + 1):
        while head + 1 < len(queue) and queue[head + 1][1] <= j:
            head += 1
        i = queue[head][0]
        best[j], back[j] = value(i, j) + (natural.get(candidates[j], GAP) if j < last else 0.0), i
        while len(queue) > head:
            k, since = queue[-1]
            since = max(since, j + 1)
            if since > last or value(j, since) > value(k, since):
                break
            queue.pop()
        if len(queue) == head:
            queue.append((j, j + 1))
        elif j < last and value(j, last) <= value(queue[-1][0], last):
            low, high, k = max(queue[-1][1], j + 1), last, queue[-1][0]
            while high - low > 1:
                middle = (low + high) // 2
                if value(j, middle) <= value(k, middle):
                    high = middle
                else:
                    low = middle
            queue.append((j, high))
    cuts, j = [], last
    while j > 0:
        cuts.append((candidates[j], natural.get(candidates[j], GAP) if j < last else 0.0))
        j = back[j]
    return cuts[::-1]


def split_text(text: str, max_words: int, overlap: int) -> list[tuple[int, int, int, int, float]]:
    """Pieces as ``(start, fresh, end, words, cost)``: the piece is ``text[start:end]``, of which ``text[fresh:end]`` is
    new. The fresh parts of all pieces together are the text from its first word to its end."""
    spans = [m.span() for m in _words(text)]
    if not spans:
        return []
    n, out, before = len(spans), [], 0
    for cut, cost in best_cuts(n, boundary_costs(text, spans) if n > max_words else {}, max_words, overlap):
        first = max(0, before - overlap) if before else 0
        end = len(text) if cut == n else spans[cut][0]
        out.append((spans[first][0], spans[before][0], end, cut - first, cost))
        before = cut
    return out


PIECES = "piece_no int, n_pieces int, char_start int, char_fresh int, char_end int, n_words int, cut_cost double"


def split_documents(df: DataFrame, max_words: int = 400, overlap: int = 40, content: str = "content", keys: tuple[str, ...] = ("doc_id",), with_text: bool = True) -> DataFrame:
    """One row per piece: ``keys``, ``piece_no`` from 1, ``n_pieces``, character offsets, and the piece's ``text``.

    Texts within the limit never leave the JVM; the dynamic programming runs on whole oversized texts, row by row.
    """
    if not 0 <= overlap < max_words:
        raise ValueError("overlap must be less than max_words")
    size = F.regexp_count(content, F.lit(WORD))
    sized = df.select(*keys, F.col(content).alias("_text"), size.alias("_words")).filter("_words > 0")
    text = [F.col("_text").alias("text")] if with_text else []
    whole = sized.filter(F.col("_words") <= max_words).select(
        *keys, F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("char_start"), F.lit(0).alias("char_fresh"),
        F.length("_text").alias("char_end"), F.col("_words").cast("int").alias("n_words"), F.lit(0.0).alias("cut_cost"), *text,
    )
    large = sized.filter(F.col("_words") > max_words).select(*keys, "_text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + f", {PIECES}" + ", text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, columns, texts = [], [[] for _ in range(7 + with_text)], b.column(len(keys)).to_pylist()
            for r, t in enumerate(texts):
                pieces = split_text(t, max_words, overlap)
                for k, (start, fresh, end, words, cost) in enumerate(pieces, 1):
                    rows.append(r)
                    for column, v in zip(columns, (k, len(pieces), start, fresh, end, words, cost, *([t[start:end]] if with_text else []))):
                        column.append(v)
            index = pa.array(rows, pa.int32())
            types = [pa.int32()] * 6 + [pa.float64()] + [pa.string()] * with_text
            names = [*keys, *(x.split()[0] for x in PIECES.split(", ")), *(["text"] if with_text else [])]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(index) for i in range(len(keys))), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return whole.unionByName(large.mapInArrow(run, schema))


def oversized(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys of the texts that had to be split."""
    return pieces.filter("n_pieces > 1").select(key).distinct()
