"""Repair of text from scanned pages: furniture, words broken at line ends, misrecognised characters.

Three passes over whole texts, each pre-aggregating in its partition:

1. counts of all words; those above a fixed share of all words are the frequent vocabulary, bounded by 1 / share;
2. counts of skip-gram pairs of frequent words, from which vectors are trained (negative sampling, trainers on parts of
   the pair table, as many as its size asks for, whose parameters are averaged); and counts of line templates next to page
   breaks;
3. with vocabulary, vectors and furniture templates as broadcasts of that bounded size, each text by itself. The vector of a
   rare word is the mean of the context vectors around it; its neighbours are the frequent words that fit there better than
   words do on average. A neighbour that plausible glyph edits turn into the rare word is what was printed; without one the
   word stands as it is. Words that are rather words of their own (frequent ones, and short ones, which may be parts of
   broken words) are misread only if the skip-gram likelihood of the place speaks for the neighbour. Furniture is
   removed, broken words are joined and lines are reflowed into paragraphs.

Defined results for odd input: null texts give no rows; blank texts have no noise; repeated rows are treated each on its
own; an empty table has no vocabulary and gives no rows; a word that no frequent word explains stays as it is; a word with no
known word around is misread only if it has signs or digits that no word has.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import materialize

#: Least share of all words, and least count, of a frequent word; so there are at most 1 / VOCABULARY_SHARE of them.
VOCABULARY_SHARE, MIN_COUNT = 1e-5, 3
#: A frequent word this many times rarer than one that explains it by a glyph edit is doubtful: the context decides.
RATIO = 40
WINDOW, DIMENSIONS, NEGATIVES, ROUNDS, STEPS = 4, 24, 4, 3, 4
#: Distinct pairs of a trainer, and of one step of it.
TRAINER_PAIRS, CHUNK = 250_000, 1_000_000
#: Bins and bound of the histogram of products of vectors; random pairs that it is compared with.
BINS, GREATEST, RANDOM_PAIRS = 64, 8.0, 500_000
#: Glyph confusions of optical character recognition, as read -> as printed.
GLYPHS = {
    "0": ["o"], "1": ["i", "l"], "!": ["i", "l"], "|": ["l", "i"], "2": ["z"], "3": ["e"], "4": ["a"], "5": ["s"], "6": ["b", "ó"],
    "7": ["t"], "8": ["b"], "9": ["g"], "@": ["a"], "$": ["s"], "€": ["e"], "†": ["t"], "c": ["e"], "rn": ["m"], "ri": ["n"],
    "ii": ["u"], "cl": ["d"], "li": ["h"], "vv": ["w"], "\\/": ["v"], "á~": ["ã"], "a~": ["ã"], "ó~": ["õ"], "o~": ["õ"],
    "ç,": ["ç"], "c,": ["ç"], "í": ["i"], "ì": ["í"], "ﬁ": ["fi"], "ﬂ": ["fl"],
}
#: Most glyphs misread in one word; words of letters only that are shorter than ``SHORT`` may be parts of broken ones.
MAX_EDITS, SHORT = 3, 4
HYPHENS = "-‐­¬"
EDGES = ".,;:()[]{}\"'“”‘’«»?!…*"
#: Parts after a hyphen that belong to the written word: enclitic pronouns.
ENCLITICS = frozenset("se lhe lhes me te nos vos o a os as lo la los las no na".split())
_token = str.split
_plain = re.compile(r"[^\W\d_]+(?:[-‐][^\W\d_]+)*").fullmatch
_code = re.compile(r"[A-Z]{1,5}[-.]?\d+[A-Z]?").fullmatch
_roman = re.compile(r"[ivxlcdm]+").fullmatch
_number = r"(?:[0-9lIiOo|]{0,3}[0-9lI|][0-9lIiOo|]{0,3}|[ivxlc]{1,8})"
FOLIO = re.compile(
    rf"(?P<before>[\W_]*+(?:(?:p[áa]g(?:ina|s)?|fls?|folhas?|page|p)\b\.?\s*(?:n[ºo°.]+\s*)?)?[\W_]*+)(?P<n>{_number})(?P<of>\s*(?:/|\||de|of)\s*(?P<m>{_number}))?(?P<after>\s*[\])•\-–—|·*]*)\s*", re.I
)
#: A cell of a table that holds only a decimal number, as next to which a bare number is a cell too.
#: The register label of a document in a template.
_label = re.compile(r"\b[a-z]+ #-#(?:/#)?(?: |$)")
#: Lines that are always on one page.
PAGE = 6
CELL = re.compile(r"[\d.]*\d,\d+|\d+\.\d+")


def core(token: str) -> str:
    """A token without punctuation around it, lower-cased, any hyphen as the plain one."""
    return token.strip(EDGES).lower().replace("‐", "-")


# ---- pass 1: vocabulary


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                raw.update(_token(t))
            if len(raw) > 500_000:
                yield emit(raw)
                raw = Counter()
        yield emit(raw)

    def emit(raw: Counter) -> pa.RecordBatch:
        counts: Counter[str] = Counter()
        for t, n in raw.items():
            w = core(t)
            if w and len(w) < 40 and _plain(w):
                counts[w] += n
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return docs.select("content").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> dict[str, int]:
    """The frequent vocabulary, most frequent first."""
    total = counts.agg(F.sum("n").alias("t"))
    rows = counts.join(F.broadcast(total)).filter((F.col("n") >= MIN_COUNT) & (F.col("n") >= F.col("t") * VOCABULARY_SHARE)).select("word", "n").collect()
    return {r["word"]: r["n"] for r in sorted(rows, key=lambda r: (-r["n"], r["word"]))}


# ---- glyph edits


def prefixes_of(words) -> frozenset[str]:
    """All beginnings of words, so that a search stops where no word goes on."""
    return frozenset(w[:i] for w in words for i in range(len(w) + 1))


def glyph_candidates(word: str, known, prefixes: frozenset[str] | None = None) -> list[str]:
    """Known words that up to ``MAX_EDITS`` misread glyphs turn into ``word``."""
    prefixes = prefixes_of(known) if prefixes is None else prefixes
    found: dict[str, int] = {}

    def walk(i: int, made: str, edits: int) -> None:
        if made not in prefixes:
            return
        if i == len(word):
            if edits and made in known:
                found[made] = min(edits, found.get(made, 9))
            return
        walk(i + 1, made + word[i], edits)
        if edits < MAX_EDITS:
            for size in (1, 2):
                for printed in GLYPHS.get(word[i : i + size], ()) if i + size <= len(word) else ():
                    walk(i + size, made + printed, edits + 1)

    walk(0, "", 0)
    least = min(found.values(), default=0)
    return [w for w, e in found.items() if e == least]


# ---- pass 2: skip-gram pairs, line templates


def is_folio(line: str) -> re.Match | None:
    """A line that has the form of a folio, whatever stands around it."""
    s = line.strip()
    # a folio ends in its number, or in signs after it
    return FOLIO.fullmatch(s) if s and (s[-1] in "0123456789lIiOo|vVxXcC" or not s[-1].isalnum()) else None


def table_places(lines: list[str], solid: list[int]) -> set[int]:
    """Places in ``solid`` that belong to a table: decimal cells, and what is repeated right below itself."""
    texts = [lines[i].strip() for i in solid]
    out = {k for k, t in enumerate(texts) if CELL.fullmatch(t)}
    if out:
        often = Counter(texts)
        out |= {k for k, t in enumerate(texts) if often[t] > 1 and (k + 1 < len(texts) and texts[k + 1] == t or k and texts[k - 1] == t) and out.intersection(range(k - 8, k + 9))}
    return out


def folio_lines(lines: list[str]) -> set[int]:
    """Indices of the lines that hold only a page number; numbers in tables aren't."""
    out, solid = set(), [i for i, line in enumerate(lines) if line.strip()]
    table = table_places(lines, solid)
    for k, i in enumerate(solid):
        m = is_folio(lines[i])
        if not m:
            continue
        text = lines[i].strip()
        decorated = bool(m["before"].strip()) or bool(m["after"].strip()) or (m["of"] and " " in m["of"])
        if not decorated:
            if table.intersection(range(k - 2, k + 3)):
                continue
            if not any(c.isdigit() for c in text) and not (_roman(text) or text == "l"):
                continue
        elif m["before"].strip() in ("(", "§") or (m["after"].strip() == ")" and "(" not in text):
            continue  # an item of a list
        if m["before"].strip() in ("-", "–", "•", "*") and not m["after"].strip():
            continue
        if m["m"] and m["n"].isdigit() and m["m"].isdigit() and int(m["n"]) > int(m["m"]):
            continue
        out.add(i)
    return out


class Reader:
    """Line templates and corrections with the vocabulary known so far."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.prefixes = prefixes_of(vocabulary)
        self.cache: dict[str, list[str]] = {}

    def candidates(self, word: str) -> list[str]:
        hit = self.cache.get(word)
        if hit is None:
            hit = glyph_candidates(word, self.vocabulary, self.prefixes)
            if len(self.cache) < 300_000:
                self.cache[word] = hit
        return hit

    def template(self, line: str) -> str:
        """A line with digits as ``#``, misread words as printed and unknown words as ``*``."""
        out = []
        for t in line.split():
            w = core(t)
            if not any(c.isalpha() for c in w):
                out.append(re.sub(r"\d+", "#", t))
            elif w in self.vocabulary:
                out.append(w)
            elif self.candidates(w):
                out.append(max(self.candidates(w), key=self.vocabulary.get))
            else:
                out.append("*" if not any(c.isdigit() for c in w) else re.sub(r"\d+", "#", w))
        return " ".join(out)


def page_neighbours(lines: list[str], folios: set[int]) -> set[int]:
    """Lines at a page's edge: those next to a folio or a form feed, within two lines that aren't blank."""
    solid = [i for i, line in enumerate(lines) if line.strip()]
    edge = set()
    for k, i in enumerate(solid):
        if i in folios:
            edge.update(solid[max(0, k - 2) : k] + solid[k + 1 : k + 3])
        if "\f" in lines[i]:
            edge.update(solid[max(0, k - 2) : k + 2])
    table = table_places(lines, solid)
    if table:
        edge -= {i for k, i in enumerate(solid) if table.intersection(range(k - 1, k + 2))}
    return edge - folios


def on_pages(places: list[int]) -> int:
    """On how many pages sorted line numbers lie: those few lines apart are on one."""
    return 1 + sum(b - a > PAGE for a, b in zip(places, places[1:])) if places else 0


def looks_like_header(line: str) -> bool:
    s = line.strip()
    return len(s) > 3 and s[-1] not in ".;,:" and s[-1] not in HYPHENS and any(c.isalpha() for c in s) and not s[0].islower()


class Codes(dict):
    """Codes of raw tokens by the vocabulary, -1 for others; kept as they are met."""

    def __init__(self, index: dict[str, int]):
        super().__init__()
        self.index = index

    def __missing__(self, token: str) -> int:
        code = self.index.get(core(token), -1)
        if len(self) < 500_000:
            self[token] = code
        return code


def pair_keys(codes: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unordered skip-gram pairs of a sequence of codes as ``smaller * size + greater``, sorted, with their counts."""
    a = np.array(codes, np.int64)
    found = []
    for d in range(1, WINDOW + 1):
        x, y = a[:-d], a[d:]
        ok = (x >= 0) & (y >= 0)
        x, y = x[ok], y[ok]
        found.append(np.minimum(x, y) * size + np.maximum(x, y))
    keys = np.concatenate(found)
    keys.sort()
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if keys.size else np.zeros(0, np.int64)
    return keys[starts], np.diff(np.r_[starts, keys.size])


def pair_and_template_counts(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """``(a, b, template, n, m)``: unordered skip-gram pairs with their count ``n``; templates at page edges with the documents
    ``n`` that have them there and ``m`` that have them there repeatedly."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, size = shared.value, len(shared.value)
        code_of = Codes({w: i for i, w in enumerate(words)}).__getitem__
        reader, seen, repeated = Reader(words), Counter(), Counter()
        codes: list[int] = []
        for b in batches:
            for t in b.column(0).to_pylist():
                codes.extend(map(code_of, _token(t)))
                codes.extend([-1] * WINDOW)
                if len(codes) > 2_000_000:
                    yield pairs(codes, size)
                    codes.clear()
                lines = t.split("\n")
                folios = folio_lines(lines)
                if folios or "\f" in t:
                    own: dict[str, list[int]] = defaultdict(list)
                    for i in sorted(page_neighbours(lines, folios)):
                        if looks_like_header(lines[i]):
                            own[reader.template(lines[i])].append(i)
                    seen.update(own.keys())
                    repeated.update(k for k, places in own.items() if on_pages(places) > 1)
        yield pairs(codes, size)
        nothing = pa.nulls(len(seen), pa.int32())
        yield batch(nothing, nothing, pa.array(list(seen), pa.string()), list(seen.values()), [repeated[k] for k in seen])

    def pairs(codes: list[int], size: int) -> pa.RecordBatch:
        keys, counts = pair_keys(codes, max(1, size))
        return batch(keys // max(1, size), keys % max(1, size), pa.nulls(keys.size, pa.string()), counts, np.zeros(keys.size, np.int64))

    def batch(a, b, template, n, m) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), template, pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=["a", "b", "template", "n", "m"])

    rows = docs.select("content").mapInArrow(run, "a int, b int, template string, n bigint, m bigint")
    return rows.groupBy("a", "b", "template").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


# ---- vectors


@dataclass
class Vectors:
    """Word and context vectors, in the order of the vocabulary, and what their products say.

    ``llr`` is the log-likelihood ratio of a product under pairs of the texts against random pairs, by bins; ``mean`` and
    ``spread`` are mean and covariance of the word vectors by frequency.
    """

    words: np.ndarray
    contexts: np.ndarray
    llr: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def nearness(self, word: int, around: list[int]) -> float:
        """By how many standard deviations of frequent words a word fits the vector of a place, the mean of the contexts."""
        place = self.contexts[around].mean(axis=0)
        deviation = float(place @ self.spread @ place)
        return float((self.words[word] - self.mean) @ place) / deviation**0.5 if deviation > 1e-12 else 0.0

    def evidence(self, word: int, around: list[int]) -> float:
        """Log-likelihood ratio of the words around with and without this one."""
        return float(self.llr[bins(self.contexts[around] @ self.words[word])].sum())


def bins(x: np.ndarray) -> np.ndarray:
    return np.clip((x + GREATEST) * (BINS / (2 * GREATEST)), 0, BINS - 1).astype(np.int64)


def train_step(a: np.ndarray, b: np.ndarray, n: np.ndarray, words: np.ndarray, contexts: np.ndarray, noise: np.ndarray, seed: int, rate: float) -> None:
    """One pass of skip-gram with negative sampling over weighted pairs, in place."""
    rng = np.random.default_rng(seed)
    weight = np.cumsum(n.astype(np.float64) ** 0.75)
    draws = np.searchsorted(weight, rng.random(max(50_000, 2 * a.size)) * weight[-1])
    cumulative = np.cumsum(noise)
    for at in range(0, draws.size, 4096):
        d = np.minimum(draws[at : at + 4096], a.size - 1)
        i, j = a[d], b[d]
        negative = np.searchsorted(cumulative, rng.random((d.size, NEGATIVES)) * cumulative[-1])
        j = np.concatenate([j[:, None], np.minimum(negative, noise.size - 1)], axis=1)
        v, u = words[i], contexts[j]
        g = 1 / (1 + np.exp(-np.clip(np.einsum("nd,nkd->nk", v, u), -8, 8)))
        g[:, 0] -= 1
        step_v, step_u = np.einsum("nk,nkd->nd", g, u), g[:, :, None] * v[:, None, :]
        # updates of one row in a batch are averaged beyond a few, so frequent words don't overshoot
        for table, rows, step in ((words, i, step_v), (contexts, j.ravel(), step_u.reshape(-1, v.shape[1]))):
            order = np.argsort(rows, kind="stable")
            rows = rows[order]
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            total, often = np.add.reduceat(step[order], starts), np.diff(np.r_[starts, rows.size])
            table[rows[starts]] -= rate * total * np.minimum(1, STEPS / often)[:, None]


def train_vectors(pairs: DataFrame, vocabulary: dict[str, int]) -> Vectors:
    """Word and context vectors: in each round the trainers start from the same parameters; a word's results are averaged by the
    pairs that each trainer had of it."""
    spark, size = pairs.sparkSession, len(vocabulary)
    rng = np.random.default_rng(7)
    words, contexts = (rng.random((size, DIMENSIONS)) - 0.5) / DIMENSIONS * 4, np.zeros((size, DIMENSIONS))
    frequency = np.array(list(vocabulary.values()), np.float64)
    noise = frequency**0.75
    own = pairs.filter("a IS NOT NULL").select("a", "b", "n")
    trainers = -(-own.count() // TRAINER_PAIRS) if size else 0
    if not trainers:
        return Vectors(words * 0, contexts, np.zeros(BINS), np.zeros(DIMENSIONS), np.zeros((DIMENSIONS, DIMENSIONS)))
    # in an order of its own, so that every run draws alike
    parts = materialize(own.repartition(trainers, "a", "b").sortWithinPartitions(F.xxhash64("a", "b"), "a", "b"), "trainers")
    names = [f"v{i}" for i in range(DIMENSIONS)]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Chunks of bounded size, each pair both ways."""
        held, rows = [], 0
        for t in batches:
            held.append(t)
            rows += t.num_rows
            if rows >= CHUNK:
                yield both(held)
                held, rows = [], 0
        if rows:
            yield both(held)

    def both(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, n = (np.concatenate([t.column(i).to_numpy() for t in held]) for i in range(3))
        return np.r_[a, b], np.r_[b, a], np.r_[n, n]

    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast((words, contexts, noise))

        def run(batches: Iterator[pa.RecordBatch], r: int = r, shared=shared) -> Iterator[pa.RecordBatch]:
            w, c, p = shared.value[0].copy(), shared.value[1].copy(), shared.value[2]
            pairs_of = np.zeros(len(p))
            for a, b, n in tables(batches):
                train_step(a, b, n, w, c, p, seed=int(a[0]) * 31 + int(b[0]) + r, rate=0.25 / (1 + r))
                pairs_of += np.bincount(a, weights=n, minlength=len(p))
            seen = np.flatnonzero(pairs_of)
            for kind, table in ((0, w), (1, c)):
                columns = [np.full(seen.size, kind, np.int32), seen.astype(np.int32), pairs_of[seen], *(table[seen] * pairs_of[seen, None]).T]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["kind", "id", "n", *names])

        rows = parts.mapInArrow(run, "kind int, id int, n double, " + ", ".join(f"{x} double" for x in names))
        # two rows a word, which the vocabulary's bound limits
        found = rows.groupBy("kind", "id").agg(*(F.sum(x).alias(x) for x in ("n", *names))).toArrow()
        kind, place, n = (found[x].to_numpy() for x in ("kind", "id", "n"))
        values = np.stack([found[x].to_numpy() for x in names], axis=1) / n[:, None]
        words, contexts = words.copy(), contexts.copy()
        words[place[kind == 0]], contexts[place[kind == 1]] = values[kind == 0], values[kind == 1]
        shared.unpersist()

    shared = spark.sparkContext.broadcast((words, contexts))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, c = shared.value
        total = np.zeros(BINS)
        for a, b, n in tables(batches):
            total += np.bincount(bins(np.einsum("nd,nd->n", w[a], c[b])), weights=n, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS, dtype=np.int32)), pa.array(total)], names=["bin", "n"])

    seen = np.zeros(BINS)
    for row in parts.mapInArrow(products, "bin int, n double").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        seen[row["bin"]] = row["n"]
    share = np.cumsum(frequency) / frequency.sum()
    i, j = (np.minimum(np.searchsorted(share, rng.random(RANDOM_PAIRS)), size - 1) for _ in range(2))
    chance = np.bincount(bins(np.einsum("nd,nd->n", words[i], contexts[j])), minlength=BINS)
    llr = np.log((seen + 1) / (seen.sum() + BINS)) - np.log((chance + 1) / (chance.sum() + BINS))
    part = frequency / frequency.sum()
    mean = part @ words
    return Vectors(words, contexts, llr, mean, ((words - mean) * part[:, None]).T @ (words - mean))


# ---- pass 3: noise of a text


def doubtful_words(vocabulary: dict[str, int]) -> frozenset[str]:
    """Frequent words that may be misreadings of far more frequent ones."""
    prefixes = prefixes_of(vocabulary)
    return frozenset(w for w, n in vocabulary.items() if any(vocabulary[c] >= RATIO * n for c in glyph_candidates(w, vocabulary, prefixes)))


class Repairer(Reader):
    """Everything that is known of the corpus, applied to one text at a time."""

    def __init__(self, vocabulary: dict[str, int], vectors: Vectors, templates: set[str], doubtful: frozenset[str]):
        super().__init__(vocabulary)
        self.index = {w: i for i, w in enumerate(vocabulary)}
        self.vectors, self.templates, self.doubtful = vectors, templates, doubtful
        # what templates have in common stands for those too rare to be learned: heads of unit names, ends of footers
        heads, ends = Counter(), Counter()
        for t in templates:
            tokens = _label.sub("", t).split()
            if len(tokens) > 2:
                heads[tokens[0]] += tokens[0].isalpha() and len(tokens[0]) > 3
                ends[" ".join(tokens[-2:])] += tokens[-1] == "#" and tokens[-2].isalpha() and len(tokens[-2]) > 3
        self.heads, self.ends = {h for h, n in heads.items() if n > 1}, {e for e, n in ends.items() if n > 1}
        self.candidates_of: dict[str, list[str]] = {}
        #: tokens that are known not to be misread; first words of known templates
        self.fine: set[str] = set()
        self.starts = {t.split()[0] for t in templates} | self.heads

    def suspects(self, tokens: list[str]) -> list[int]:
        """Places of tokens that glyph edits may explain; one pass over a set for lines of known tokens."""
        if self.fine.issuperset(tokens):
            return []
        out = []
        for k, t in enumerate(tokens):
            if t not in self.fine:
                if self.options(t):
                    out.append(k)
                elif len(self.fine) < 500_000:
                    self.fine.add(t)
        return out

    def good(self, word: str) -> bool:
        return word in self.vocabulary and word not in self.doubtful

    def options(self, token: str) -> list[str]:
        """Printed words that glyph edits turn into a token; none if it is a good word itself."""
        hit = self.candidates_of.get(token)
        if hit is None:
            w = core(token)
            hit = []
            if w and not self.good(w) and any(c.isalpha() for c in w) and not _code(token.strip(EDGES)) and not (_roman(w) and len(w) < 8) and not w[0] == "-":
                # a letter with punctuation is a label
                forms = [w] if len(w) > 1 or w == token.lower() else []
                stripped = token.rstrip(".,;:)?…\"'").lower()
                if stripped.endswith("!") and len(stripped) > 1:
                    forms.append(stripped.lstrip(EDGES))
                for f in forms:
                    letters, digits = sum(c.isalpha() for c in f), sum(c.isdigit() for c in f)
                    if digits > letters and len(f) > 3 or (len(f) == 2 and digits):
                        continue
                    hit = [c for c in self.candidates(f) if c not in self.doubtful]
                    if hit:
                        break
                if hit and "-" in w and all(self.good(p) for p in w.split("-")):
                    hit = []
            if len(self.candidates_of) < 300_000:
                self.candidates_of[token] = hit
        return hit

    def around(self, tokens: list[str], k: int, size: int = 1) -> list[int]:
        """Frequent words around the tokens from ``k`` on, those of a word broken in ``size`` parts."""
        near = tokens[max(0, k - WINDOW) : k] + tokens[k + size : k + size + WINDOW]
        return [self.index[c] for c in map(core, near) if c in self.index]

    def linked(self, token: str, around: list[int]) -> str | None:
        """The printed form of a token, or None if it isn't misread: of its neighbours in the vector space of the place the nearest
        that glyph edits explain."""
        options, w = self.options(token), core(token)
        if not options:
            return None
        if not around:
            return None if w.isalpha() else max(options, key=self.vocabulary.get)
        near, _, best = max((self.vectors.nearness(self.index[c], around), self.vocabulary[c], c) for c in options)
        if near <= 0:
            return None
        own = w in self.vocabulary or (w.isalpha() and len(w) < SHORT)
        return None if own and self.vectors.evidence(self.index[best], around) <= 0 else best

    def correct(self, tokens: list[str], k: int) -> str | None:
        """The printed form of the token at ``k``, or None if it isn't misread."""
        return self.linked(tokens[k], self.around(tokens, k)) if self.options(tokens[k]) else None

    def is_header(self, line: str, template: str) -> bool:
        """A known template, or one put together from parts of known ones."""
        if template in self.templates:
            return True
        rest = _label.sub("", template)
        rest = re.sub(r"( - #| / \S+)+$", "", rest).strip(" -/")
        if rest in ("", "#") or rest in self.templates or " ".join(rest.split()[-2:]) in self.ends:
            return True
        tokens = rest.split()
        if len(tokens) > 2 and {" ".join([*tokens[:-1], "*"]), " ".join(["*", *tokens[1:]])} & self.templates:
            return True  # a name that is known elsewhere
        if tokens[0] not in self.heads or len(tokens) > 8:
            return False
        # unit names are written in title case or capitals, unlike running text that begins with the same word
        return all(w[0].isupper() or not w[0].isalpha() for w in re.sub(r"\W+", " ", line).split() if len(w) > 3 and not w[0].isdigit())

    def may_start(self, line: str) -> bool:
        """Whether a line's first word begins a known template, or is a name that stands for any."""
        first = core(line.split(None, 1)[0])
        return first in self.starts or first not in self.vocabulary

    def furniture(self, lines: list[str]) -> tuple[set[int], set[int]]:
        """Indices of headers (or footers) and of page numbers."""
        folios = folio_lines(lines)
        edge = page_neighbours(lines, folios)
        suspects = {i: self.template(line) for i, line in enumerate(lines) if looks_like_header(line) and (i in edge or self.may_start(line))}
        places: dict[str, list[int]] = defaultdict(list)
        for i in sorted(edge):
            if i in suspects:
                places[suspects[i]].append(i)
        headers = {i for i, t in suspects.items() if self.is_header(lines[i], t) or (i in edge and _specific(t) and on_pages(places[t]) > 1)}
        return headers, folios

    def joined(self, left: str, right: str) -> str | None:
        """The word that a break at a line's end divides, or None if it is written with a hyphen."""
        mark, a, b = left[-1], core(left[:-1]).lstrip(HYPHENS), core(right)
        if not a or not b or not a[-1].isalpha() or not b[0].isalpha() or a.isdigit():
            return None
        whole, compound = a + b, f"{a}-{b}"
        n_whole, n_compound = self.vocabulary.get(whole, 0), self.vocabulary.get(compound, 0)
        if n_compound > n_whole:
            return None
        if n_whole or self.options(whole):
            return whole
        if self.options(compound) or right[0].isupper() and not left[:-1].isupper():
            return None
        if mark == "-" and (b in ENCLITICS or (a in self.vocabulary and b in self.vocabulary and self.vocabulary[a] > 20 and self.vocabulary[b] > 20)):
            return None
        return whole

    def noise(self, text: str) -> list[tuple[int, str]]:
        """``(line_no, kind)`` of all noisy lines, numbered from 1."""
        lines = text.split("\n")
        headers, folios = self.furniture(lines)
        out = [(i + 1, "header") for i in headers] + [(i + 1, "page_number") for i in folios]
        body = [i for i in range(len(lines)) if i not in headers and i not in folios and lines[i].strip()]
        rows = [_token(lines[i]) for i in body]
        flat = [t for r in rows for t in r]
        at = 0  # of a line's first token among all
        carried = None  # first token of a line, if it is the second half of a broken word
        for k, i in enumerate(body):
            tokens = rows[k]
            first = 0
            if carried is not None:
                first = 1
            carried = None
            last = len(tokens)
            end = tokens[-1]
            misread = False
            if len(end) > 1 and end[-1] in HYPHENS and k + 1 < len(body):
                following = rows[k + 1][0]
                whole = self.joined(end, following)
                if whole:
                    out.append((i + 1, "hyphen"))
                    carried, last = following, last - 1
                    printed = None if self.good(whole) else self.linked(whole, self.around(flat, at + last, 2))
                    if printed:
                        side = self._misread_side(core(end[:-1]), core(following), printed)
                        misread = side != 1
                        if side:
                            out.append((body[k + 1] + 1, "misread"))
                else:
                    last -= 1
            if not misread:
                misread = any(self.correct(flat, at + first + j) for j in self.suspects(tokens[first:last] if first or last < len(tokens) else tokens))
            if misread:
                out.append((i + 1, "misread"))
            at += len(tokens)
        return sorted(set(out))

    def _misread_side(self, a: str, b: str, printed: str) -> int:
        """Which half of a broken word is misread: 0 the first, 1 the second, 2 both."""
        first, second = not printed.startswith(a), not printed.endswith(b)
        return 2 if first and second else 1 if second else 0

    def repair(self, text: str) -> str:
        """The text as continuous paragraphs, without furniture, broken or misread words."""
        lines = text.split("\n")
        headers, folios = self.furniture(lines)
        paragraphs: list[list[str]] = [[]]
        pending_blank, removed = False, False
        for i, line in enumerate(lines):
            if i in headers or i in folios:
                removed = True
                continue
            tokens = _token(line)
            if not tokens:
                pending_blank = not removed and bool(paragraphs[-1])
                continue
            own = paragraphs[-1]
            starts = re.match(r"(?:art\.|cap[íi]tulo\b|§|\d+(?:\.\d+)+\s|[ivxlc]+\s-\s)", line.strip(), re.I)
            if (pending_blank or starts) and own and not (own[-1][-1] in HYPHENS and len(own[-1]) > 1):
                paragraphs.append([])
                own = paragraphs[-1]
            pending_blank = removed = False
            if own and len(own[-1]) > 1 and own[-1][-1] in HYPHENS:
                if self.joined(own[-1], tokens[0]):
                    own[-1] = own[-1][:-1] + tokens[0]
                else:
                    own[-1] = own[-1][:-1] + "-" + tokens[0]
                tokens = tokens[1:]
            own.extend(tokens)
        flat, out, at = [t for p in paragraphs for t in p], [], 0
        for p in paragraphs:
            misread = {k: w for k in self.suspects(p) if (w := self.correct(flat, at + k))}
            at += len(p)
            if p:
                out.append(" ".join(self._printed(t, misread[k]) if k in misread else t for k, t in enumerate(p)))
        return "\n\n".join(out)

    def _printed(self, t: str, word: str) -> str:
        """A printed word in the shape of the token it was read as."""
        inner = t.strip(EDGES)
        at = t.find(inner)
        shape = word.upper() if inner.isupper() and len(inner) > 1 else word.capitalize() if inner[:1].isupper() else word
        tail = t[at + len(inner) :]
        if glyph_candidates(core(t) + "!", {word}):
            tail = tail.replace("!", "", 1)
        return t[:at] + shape + tail


def _specific(template: str) -> bool:
    return any(len(t) > 2 and t.isalpha() for t in template.split())


def header_templates(counts: DataFrame) -> set[str]:
    """Templates of running headers and footers: at page edges repeatedly in a fair part of the documents that have them there.

    Lines of the website stand at the edge of the text, once. A template must be in three documents or one in 100,000
    of all mentions, which bounds the set.
    """
    rows = counts.filter("template IS NOT NULL AND m >= 2 AND m >= 0.12 * n")
    total = counts.filter("template IS NOT NULL").agg(F.sum("n").alias("t"))
    found = rows.join(F.broadcast(total)).filter("n >= 3 AND n >= t * 1e-5").select("template").collect()
    return {r["template"] for r in found if _specific(r["template"])}


def learn(docs: DataFrame) -> tuple[dict[str, int], Vectors, set[str], frozenset[str]]:
    """Passes 1 and 2 over ``docs`` (with ``content``): what a ``Repairer`` needs."""
    vocabulary = frequent_words(materialize(word_counts(docs), "words"))
    counts = materialize(pair_and_template_counts(docs, vocabulary), "pairs")
    return vocabulary, train_vectors(counts, vocabulary), header_templates(counts), doubtful_words(vocabulary)


def _texts(df: DataFrame, key: str, content: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(content).alias("content")).filter(F.col("content").isNotNull())


def scan_noise(df: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """``(key, line_no, noise_kind)`` of every noisy line."""
    docs = _texts(df, key, content)
    shared = df.sparkSession.sparkContext.broadcast(learn(docs.select("content")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(*shared.value)
        for b in batches:
            rows, numbers, kinds = [], [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                for n, kind in repairer.noise(t):
                    rows.append(r)
                    numbers.append(n)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(numbers, pa.int32()), pa.array(kinds, pa.string())], names=["key", "line_no", "noise_kind"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, line_no int, noise_kind string").withColumnRenamed("key", key)


def repaired(df: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """``(key, repaired)``: every text as continuous paragraphs."""
    docs = _texts(df, key, content)
    shared = df.sparkSession.sparkContext.broadcast(learn(docs.select("content")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([repairer.repair(t) for t in b.column(1).to_pylist()], pa.string())], names=["key", "repaired"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, repaired string").withColumnRenamed("key", key)
