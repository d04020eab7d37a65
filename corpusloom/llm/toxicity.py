"""Abusive, hateful and sexual passages, as maximum-scoring segments of token log-odds.

A token's score is its log-odds of being in a toxic passage, under a Dirichlet prior that has the base rate of the corpus
as its mean. The linear-time scan of Ruzzo and Tompa finds all maximal segments of a text; their scores follow an extreme
value distribution under the token frequencies of the corpus (Karlin and Altschul), which makes the best one of a text a
probability that neutral text of its length would score as high.

The model is fitted on at most ``MAX_LABELLED`` labelled texts (those with the least hash of their id): first from whole
texts, then from the segments found in positive ones. It then gathers the significant segments of *all* texts, and all
tokens' counts, and is fitted again. Obfuscated spellings (leet, masked letters, spaced or repeated letters, invisible
characters) are resolved against the words of the labelled texts and the given terms.

Defined results for odd input: null and empty texts score 0; null labels count for nothing; of an annotator's labels of a
text the last counts, annotators vote, and a tie leaves the text out; labels of texts that don't exist are ignored; with no
positive label there is no model and every score is 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import materialize

#: Bound on the labelled texts the driver fits on.
MAX_LABELLED = 20_000
#: Pseudo-counts of the prior; what every token costs; bounds of a token's score.
PRIOR, DRIFT, LOW, HIGH = 4.0, 0.35, -3.0, 7.0
#: Least score of a segment of a positive text, and of any text, that counts as toxic while fitting.
SEED_SCORE, CERTAIN = 5.0, 1e-4
SLACK = 0.5
#: Rounds of fitting on the segments of all texts.
CORPUS_ROUNDS = 2
#: Tokens of the longest run that labels are counted of, and the weight of a shorter run's estimate, in texts.
CONTEXT, SHRINK = 4, 3.0
#: Steps a unit of rate * score - ln n in the histograms of a pass, and bounds of it.
STEPS, LEAST_X, GREATEST_X = 32, -24.0, 64.0
#: Least share of all tokens in toxic segments that a token must have to be kept; bounds the model by its inverse.
TOKEN_SHARE = 1e-6
#: Letters that digits and signs stand for.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "€": "e", "|": "l"})
_invisible = re.compile("[​-‏⁠-⁤﻿­̀-ͯ]")
_spaced = re.compile(r"(?<![^\W_])(?:[^\W_]([ .\-_*]))(?:[^\W_]\1){2,}[^\W_](?![^\W_])|(?<![^\W_])(?:[^\W_][.\-_*]){2,}[^\W_](?![^\W_])")
_repeat = re.compile(r"(\w)\1{2,}")
_parts = re.compile(r"[^\W_]+").findall
EDGES = ".,;:()[]{}\"'“”‘’«»?¿¡…!–—"


GRAIN = 2.0**-20
#: The token between two sentences, and its score.
BREAK, BREAK_SCORE = "\u00b6", -2.5
_ends = (".", "!", "?", "…", ";", ":", ".)", "!)")


def clean(text: str) -> str:
    """Lower case without accents, invisible characters and spaced-out letters."""
    if not text.isascii():
        text = _invisible.sub("", unicodedata.normalize("NFKD", text))
    return _spaced.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), text.lower())


def chunk_tokens(chunk: str, lexicon: "Lexicon") -> tuple[str, ...]:
    """Tokens of what stands between two blanks of a clean text."""
    if chunk == BREAK:
        return (BREAK,)
    return (*lexicon.resolve(chunk), BREAK) if chunk.endswith(_ends) else lexicon.resolve(chunk)


def tokens_of(text: str, lexicon: "Lexicon") -> list[str]:
    """Tokens of a text, obfuscated ones as the word they stand for."""
    return [t for c in clean(text).replace("\n", f" {BREAK} ").split() for t in chunk_tokens(c, lexicon)]


@dataclass
class Lexicon:
    """Words that an obfuscated token may stand for."""

    words: frozenset[str] = frozenset()
    by_length: dict[int, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for w in sorted(self.words):
            if len(w) > 3:
                self.by_length.setdefault(len(w), []).append(w)

    def resolve(self, chunk: str) -> tuple[str, ...]:
        word = chunk.strip(EDGES)
        if word.isalpha():
            return (self.shrunk(word),)
        if any(c.isalpha() for c in word):
            if len(word) < 30:
                for form in (word, chunk.lstrip(EDGES).rstrip(".,;:)?…\"'")):
                    plain = form.translate(LEET)
                    if plain.isalpha() and (plain := self.shrunk(plain)) in self.words:
                        return (plain,)
                if (w := self.masked(word)) is not None:
                    return (w,)
            return tuple(self.shrunk(p) if p.isalpha() else "#" for p in _parts(word))
        return ("#",) if any(c.isdigit() for c in word) else ()

    def shrunk(self, word: str) -> str:
        if word in self.words or not _repeat.search(word):
            return word
        for keep in (r"\1", r"\1\1"):
            if (w := _repeat.sub(keep, word)) in self.words:
                return w
        return _repeat.sub(r"\1", word)

    def masked(self, word: str) -> str | None:
        """The word of which signs hide one or two letters, if there is just one."""
        signs = [i for i, c in enumerate(word) if not c.isalnum()]
        if not 1 <= len(signs) <= 2 or len(word) < 4 or len(signs) * 3 > len(word) or any(word[i] == "-" or word[i] == "/" for i in signs):
            return None
        found = [w for w in self.by_length.get(len(word), ()) if all(a == b or not a.isalnum() for a, b in zip(word.translate(LEET) if any(c.isdigit() for c in word) else word, w))]
        return found[0] if len(found) == 1 else None


class Reader:
    """Texts as arrays of token codes. What stands between two blanks is resolved once, then looked up."""

    #: Chunks held before the tables are begun anew.
    FULL = 1_000_000

    def __init__(self, model: "Model"):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.tokens: list[str] = []
        self.codes: dict[str, int] = {}
        self.score, self.hash = np.zeros(1024), np.zeros(1024, np.uint64)
        self.parts: list[int] = []
        self.begin, self.size, self.letter = [], [], bytearray()
        reader = self

        class Chunks(dict):
            def __missing__(self, chunk: str) -> int:
                self[chunk] = number = len(self)
                reader.add(chunk)
                return number

        self.chunks = Chunks()
        self.code(BREAK)  # 0

    def code(self, token: str) -> int:
        k = self.codes.get(token)
        if k is None:
            k = self.codes[token] = len(self.tokens)
            self.tokens.append(token)
            if k == self.score.size:
                self.score = np.concatenate([self.score, np.zeros(k)])
                self.hash = np.concatenate([self.hash, np.zeros(k, np.uint64)])
            self.score[k] = self.model.scores.get(token, self.model.unknown)
            self.hash[k] = xxhash.xxh64_intdigest(token)
        return k

    def add(self, chunk: str) -> None:
        plain = clean(chunk)
        own = [self.code(t) for c in plain.split() for t in chunk_tokens(c, self.model.lexicon)]
        self.begin.append(len(self.parts))
        self.size.append(len(own))
        self.letter.append(sum(c.isalnum() for c in plain) == 1)
        self.parts += own

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all tokens of some texts, and where each text ends."""
        look = self.chunks.__getitem__
        lists = [list(map(look, t.replace("\n", f" {BREAK} ").split())) for t in texts]
        chunks = np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))
        ends = np.cumsum([len(x) for x in lists], dtype=np.int64)
        begin, size, letter, parts = np.array(self.begin, np.int64), np.array(self.size, np.int64), np.frombuffer(bytes(self.letter), np.uint8), np.array(self.parts, np.int64)
        # four single letters in a row are a word written with blanks between its letters
        run = letter[chunks] if chunks.size else np.zeros(0, np.uint8)
        spaced = np.flatnonzero(run[3:] & run[2:-1] & run[1:-2] & run[:-3]) if run.size > 3 else ()
        slow = sorted(set(np.searchsorted(ends, spaced, side="right").tolist())) if len(spaced) else []
        n = size[chunks] if chunks.size else np.zeros(0, np.int64)
        before = np.cumsum(n) - n
        codes = parts[np.repeat(begin[chunks] - before, n) + np.arange(n.sum())] if n.size and n.sum() else np.zeros(0, np.int64)
        text_ends = np.r_[0, np.cumsum(n)][ends] if n.size else np.zeros(len(texts), np.int64)
        if slow:
            pieces, at = [], 0
            for k, e in enumerate(text_ends.tolist()):
                pieces.append(codes[at:e])
                at = e
            for k in slow:
                pieces[k] = np.array([self.code(t) for t in tokens_of(texts[k], self.model.lexicon)], np.int64)
            codes, text_ends = np.concatenate(pieces), np.cumsum([x.size for x in pieces], dtype=np.int64)
        return codes, text_ends


def runs_at(places: np.ndarray, codes: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the runs of 2 to ``CONTEXT`` tokens that end at some places; what is before a text is the token between sentences."""
    begin = np.r_[0, ends][np.searchsorted(ends, places, side="right")]
    key, out = hashes[codes[places]] if places.size else np.zeros(0, np.uint64), []
    for k in range(1, CONTEXT):
        before = np.where(places - k >= begin, codes[np.maximum(places - k, 0)], 0) if places.size else places
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[before]
        out.append(key)
    return out


def score_of(reader: Reader, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Scores of tokens: the log-odds of each, at most those of the longest run ending there that the model knows."""
    scores, m = reader.score[codes], reader.model
    hot = np.flatnonzero(scores > 0)
    if hot.size and m.runs.size:
        most = np.full(hot.size, np.inf)
        for key in runs_at(hot, codes, ends, reader.hash):
            at = np.minimum(np.searchsorted(m.runs, key), m.runs.size - 1)
            known = m.runs[at] == key
            most[known] = m.most[at[known]]
        scores[hot] = np.minimum(scores[hot], most)
    return np.round(scores / GRAIN) * GRAIN


def batches_of(texts: list[str], most: int = 8_000_000) -> Iterator[list[str]]:
    """The texts in order, in lists of bounded length."""
    held, length = [], 0
    for t in texts:
        held.append(t)
        length += len(t)
        if length > most:
            yield held
            held, length = [], 0
    if held:
        yield held


def rises(scores: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the greatest sum of scores of a run that ends there within its group (a number that never falls), and the
    prefix sums before each token, lowered so that no run reaches into another group. Scores are multiples of ``GRAIN``, so that
    sums are exact, whatever the other texts."""
    through = np.cumsum(scores)
    before = through - scores
    lower = groups * np.ceil(through.max() - through.min() + np.abs(scores).max() + 1.0) if scores.size else through
    before = before - lower
    return through - lower - np.minimum.accumulate(before), before


def best_of(scores: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The greatest segment score of each text, 0 if there is none."""
    size = np.diff(np.r_[0, ends])
    out = np.zeros(ends.size)
    if scores.size:
        run, _ = rises(scores, np.repeat(np.arange(ends.size), size))
        solid = np.flatnonzero(size)
        out[solid] = np.maximum(0.0, np.maximum.reduceat(run, (ends - size)[solid]))
    return out


def sentence_segments(codes: np.ndarray, ends: np.ndarray, scores: np.ndarray, stop: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The best segment of each sentence that scores at least ``least``: texts, starts, ends and scores. ``stop`` is the code of the
    token between sentences."""
    nothing = np.zeros(0, np.int64)
    if not codes.size:
        return nothing, nothing, nothing, np.zeros(0)
    size = np.diff(np.r_[0, ends])
    text = np.repeat(np.arange(ends.size), size)
    cut = codes == stop
    own = np.where(cut, -1.0, scores)
    # both a new text and the token between sentences begin a group
    group = np.cumsum(np.r_[0, np.diff(text) > 0] | cut | np.r_[False, cut[:-1]])
    run, before = rises(own, group)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    best = np.maximum.reduceat(run, starts)
    found = np.flatnonzero(best >= max(least, 1e-9))
    stops = np.r_[starts[1:], codes.size]
    segment = []
    for k in found.tolist():
        a, z = starts[k], stops[k]
        e = a + int(np.argmax(run[a:z]))
        segment.append((e - int(np.argmin(before[a : e + 1][::-1])), e + 1))
    pairs = np.array(segment, np.int64).reshape(-1, 2)
    return text[starts[found]], pairs[:, 0], pairs[:, 1], best[found]


def spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in all segments, and the segment of each."""
    n = ends - starts
    which = np.repeat(np.arange(n.size), n)
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum()), which


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)``, in linear time (Ruzzo and Tompa)."""
    found: list[list] = []  # start, end, sum before, sum through
    total = 0.0
    for k, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        entry = [k, k + 1, total, total + s]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= entry[2]:
                j -= 1
            if j < 0 or found[j][3] >= entry[3]:
                found.append(entry)
                break
            entry = [found[j][0], entry[1], found[j][2], entry[3]]
            del found[j:]
    return [(a, b, through - before) for a, b, before, through in found]


@dataclass
class Model:
    lexicon: Lexicon
    scores: dict[str, float]
    rate: float = 1.0  # lambda of the extreme value distribution
    log_k: float = 0.0
    unknown: float = -DRIFT
    threshold: float = 1e-3
    #: hashes of runs of tokens, sorted, and the most that their last token may score
    runs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: votes on the labelled texts, at most ``MAX_LABELLED``
    labels: dict = field(default_factory=dict)

    def p_value(self, score: float, n: int) -> float:
        """Probability that the best segment of ``n`` neutral tokens scores as high."""
        if score <= 0 or n == 0:
            return 1.0
        return -math.expm1(-math.exp(min(50.0, self.log_k + math.log(n) - self.rate * score)))


def log_odds(positive: np.ndarray, every: np.ndarray, n_positive: float, n_every: float) -> np.ndarray:
    """Log-odds of tokens in toxic passages against all others, the prior's mean being the base rate."""
    base = n_positive / max(n_every, 1.0)
    y = np.minimum(positive, every)
    odds = (y + PRIOR * base) / (every - y + PRIOR * (1 - base))
    return np.clip(np.log(odds * (1 - base) / base), LOW, HIGH) - DRIFT


def calibrate_rate(model: Model, scores: np.ndarray, background: np.ndarray) -> None:
    """Lambda from the scores of the background's tokens."""
    total = background.sum()
    if not total:
        return
    s, p = scores, background / total
    low, high = 1e-3, 20.0
    if (s > 0).any() and (p * s).sum() < 0:
        for _ in range(60):
            middle = (low + high) / 2
            if (p * np.exp(np.minimum(middle * s, 500))).sum() > 1:
                high = middle
            else:
                low = middle
        model.rate = low


def steps_of(model: Model, scores: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The histogram steps of scores in texts of ``n`` tokens."""
    return np.floor(STEPS * np.clip(model.rate * scores - np.log(n), LEAST_X, GREATEST_X)).astype(np.int64)


def calibrate_k(model: Model, bests: dict[int, tuple[int, int]]) -> None:
    """K from ``step: (texts with their best score there, texts without a positive score, which would be below it)``, of all
    texts, most of which are neutral: the median of the product-limit estimate, or the quantile next to it that was seen."""
    left = sum(a + b for a, b in bests.values())
    if left < 20:
        return
    below = 1.0
    for step in sorted(bests, reverse=True):
        seen, censored = bests[step]
        share = 1 - seen / left
        if seen and share > 0:
            below *= share
            # below is the distribution function of a Gumbel variable at the lower end of the step
            model.log_k = step / STEPS + math.log(-math.log(below))
        left -= seen + censored
        if below <= 0.5 or left <= 0:
            break


def votes(labels: DataFrame) -> DataFrame:
    """``(doc_id, toxic)``: the last label of each annotator, by majority; ties are left out."""
    last = labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id", "annotator").agg(F.max(F.struct("labelled_at", "label"))["label"].alias("label"))
    share = last.groupBy("doc_id").agg(F.avg((F.col("label") != "clean").cast("double")).alias("share"))
    return share.filter("share <> 0.5").select("doc_id", (F.col("share") > 0.5).alias("toxic"))


@dataclass
class Labelled:
    """The labelled texts as token codes."""

    reader: Reader
    codes: np.ndarray
    ends: np.ndarray
    toxic: np.ndarray

    @property
    def tokens(self) -> list[str]:
        return self.reader.tokens

    def counts(self, places: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.codes if places is None else self.codes[places], minlength=len(self.tokens)).astype(float)

    def support(self, places: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """In how many texts each token is, at some places."""
        unique = np.unique(texts * len(self.tokens) + self.codes[places])
        return np.bincount(unique % len(self.tokens), minlength=len(self.tokens)).astype(float)


def read_labelled(texts: list[tuple[str, bool]], terms: list[str]) -> Labelled:
    """The labelled texts, obfuscated words resolved against the words of all of them and the terms."""
    first = Reader(Model(Lexicon(), {}))
    for part in batches_of([t for t, _ in texts]):
        first.read(part)
    lexicon = Lexicon(frozenset(w for w in first.tokens if w.isalpha() and len(w) > 2) | {p for t in terms for p in _parts(clean(t))})
    reader = Reader(Model(lexicon, {}))
    codes, ends, at = [], [], 0
    for part in batches_of([t for t, _ in texts]):
        c, e = reader.read(part)
        codes.append(c)
        ends.append(e + at)
        at += c.size
    return Labelled(reader, np.concatenate([*codes, np.zeros(0, np.int64)]), np.concatenate([*ends, np.zeros(0, np.int64)]), np.array([toxic for _, toxic in texts], bool))


def weigh_labels(model: Model, data: Labelled) -> None:
    """Correct the scores by the labels of the texts whose segments have the token: log-odds of being in segments of toxic
    rather than of clean texts. Tokens are estimated by themselves and as the last of runs of up to ``CONTEXT``, the estimate of
    the shorter run being the mean of the Dirichlet prior of the longer: a word that insults people may be harmless of others,
    and scores by the longest run if that is rather in clean texts."""
    reader = data.reader
    reader.model = model
    scores = np.array([model.scores.get(t, model.unknown) for t in data.tokens])
    reader.score[: scores.size] = scores
    most: dict[int, float] = {}
    for _ in range(3):
        text, a, e, _s = sentence_segments(data.codes, data.ends, score_of(reader, data.codes, data.ends), 0, SEED_SCORE / 2)
        places, which = spread(a, e)
        hot = reader.score[data.codes[places]] > 0
        places, texts = places[hot], text[which[hot]]
        share = np.full(places.size, 0.5)
        for k, key in enumerate([data.codes[places], *runs_at(places, data.codes, data.ends, reader.hash)]):
            # texts, not occurrences, are counted
            unique, place, which = np.unique(key, return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([which, texts]), axis=1)
            toxic, harmless = (np.bincount(pairs[0][data.toxic[pairs[1]] == x], minlength=unique.size)[which] for x in (True, False))
            weight = SHRINK if k else 1.0
            share = (toxic + weight * share) / (toxic + harmless + weight)
            odds = np.log(share / (1 - share))
            if k:
                most.update(zip(unique.tolist(), np.where(odds < 0, odds, np.inf)[place].tolist()))
            else:
                down = np.where(harmless > 0, np.minimum(0.0, odds - 1), 0.0)[place]
                drop = unique, down
        reader.score[drop[0]] = np.maximum(np.minimum(LOW - DRIFT, reader.score[drop[0]]), reader.score[drop[0]] + drop[1])
        model.runs = np.array(sorted(most), np.uint64)
        model.most = np.array([most[int(h)] for h in model.runs])
    model.scores = dict(zip(data.tokens, reader.score[: len(data.tokens)].tolist()))


def seed_model(data: Labelled, terms: list[str]) -> Model | None:
    """A model from labelled texts alone, in three rounds: whole texts, then the segments found in positive ones."""
    if not data.toxic.any():
        return None
    text = np.repeat(np.arange(data.ends.size), np.diff(np.r_[0, data.ends]))
    # texts are counted, so that a passage repeated in one weighs no more
    every = data.support(np.arange(data.codes.size), text)
    total = every.sum()
    bad = np.flatnonzero(data.toxic[text])
    positive = data.support(bad, text[bad])
    if not positive.sum():
        return None
    scores = log_odds(positive, every, positive.sum(), total)
    scores[0] = BREAK_SCORE
    seeds = np.array(sorted(data.reader.codes[p] for t in set(terms) for p in set(_parts(clean(t))) if p in data.reader.codes), np.int64)
    for _ in range(3):
        of, a, e, s = sentence_segments(data.codes, data.ends, scores[data.codes], 0, SEED_SCORE / 2)
        keep = data.toxic[of]
        of, a, e, s = of[keep], a[keep], e[keep], s[keep]
        # the best of each text
        order = np.lexsort((a, -s, of))
        order = order[np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])] if order.size else order
        places, which = spread(a[order], e[order])
        support = data.support(places, of[order][which])
        # what only one text has may be there by a wrong label
        positive = np.where(support > 1, support, 0.3 * support)
        positive[seeds] = np.minimum(every[seeds], positive[seeds] + 1)
        n = positive.sum()
        if not n:
            return None
        scores = log_odds(positive, every, n, total)
        scores[0] = BREAK_SCORE
    model = Model(data.reader.model.lexicon, dict(zip(data.tokens, scores.tolist())))
    weigh_labels(model, data)
    calibrate_rate(model, data.reader.score[: scores.size], every - np.minimum(positive, every))
    return model


def corpus_counts(texts: DataFrame, model: Model) -> DataFrame:
    """``(token, step, n, toxic)`` over all texts: with a null step the counts of all tokens; with a step the counts of tokens
    in segments of that step that score at least ``SEED_SCORE``; with a null token, the texts whose best score is in the step
    (``n``), and those without a positive score (``toxic``), whose step is an upper bound."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader, n, toxic, texts_at = Reader(m), np.zeros(0, np.int64), Counter(), Counter()
        for b in batches:
            for part in batches_of(b.column(0).to_pylist()):
                codes, ends = reader.read(part)
                scores, size = score_of(reader, codes, ends), np.diff(np.r_[0, ends])
                own = np.bincount(codes, minlength=len(reader.tokens))
                own[: n.size] += n
                n = own
                best, solid = best_of(scores, ends), size > 0
                texts_at.update(zip(steps_of(m, best[solid], size[solid]).tolist(), (best[solid] > 0).tolist()))
                # no sentence scores more than its text
                some = np.flatnonzero(best >= SEED_SCORE)
                within, _ = spread((ends - size)[some], ends[some])
                of, a, e, s = sentence_segments(codes[within], np.cumsum(size[some]), scores[within], 0, SEED_SCORE)
                places, which = spread(a, e)
                toxic.update(zip(codes[within[places]].tolist(), steps_of(m, s, size[some[of]])[which].tolist()))
            if len(reader.chunks) > Reader.FULL or len(toxic) > 400_000:
                yield emit(reader, n, toxic, texts_at)
                reader, n, toxic, texts_at = Reader(m), np.zeros(0, np.int64), Counter(), Counter()
        yield emit(reader, n, toxic, texts_at)

    def emit(reader: Reader, n: np.ndarray, toxic: Counter, texts_at: Counter) -> pa.RecordBatch:
        steps = sorted({k for k, _ in texts_at})
        seen = np.flatnonzero(n)
        token = [*(reader.tokens[k] for k in seen), *(reader.tokens[k] for k, _ in toxic), *[None] * len(steps)]
        step = [*[None] * seen.size, *(k for _, k in toxic), *steps]
        count = [*n[seen].tolist(), *[0] * len(toxic), *(texts_at[k, True] for k in steps)]
        bad = [*[0] * seen.size, *toxic.values(), *(texts_at[k, False] for k in steps)]
        return pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.array(step, pa.int32()), pa.array(count, pa.int64()), pa.array(bad, pa.int64())], names=["token", "step", "n", "toxic"])

    return texts.mapInArrow(run, "token string, step int, n bigint, toxic bigint").groupBy("token", "step").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def best_steps(counts: DataFrame) -> dict[int, tuple[int, int]]:
    """The histogram of best scores in ``corpus_counts``: as many rows at most as there are steps."""
    return {r["step"]: (r["n"], r["toxic"]) for r in counts.filter("token IS NULL").collect()}


def fit(documents: DataFrame, labels: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> Model | None:
    """The model of a corpus; K and the threshold come from the scores, see ``score_documents``."""
    labelled = votes(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    sample = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).filter("text is not null").join(F.broadcast(labelled), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    words = [r[0] for r in terms.select("term").filter("term is not null").distinct().orderBy("term").collect()]
    data = read_labelled([(r["text"], r["toxic"]) for r in sample], words)
    model = seed_model(data, words)
    if model is None:
        return None
    model.labels = {r["doc_id"]: r["toxic"] for r in sample}
    whole = documents.select(F.col(text).alias("text")).filter("text is not null")
    for k in range(CORPUS_ROUNDS):
        steps = materialize(corpus_counts(whole, model), f"tokens{k}")
        calibrate_k(model, best_steps(steps))
        # a segment is certain from the step on at which its p-value is below CERTAIN
        certain = math.ceil(STEPS * (model.log_k - math.log(-math.log1p(-CERTAIN))))
        counts = steps.filter("token IS NOT NULL").groupBy("token").agg(F.sum(F.when(F.col("step").isNull(), F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("step") >= certain, F.col("toxic")).otherwise(0)).alias("toxic"))
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        if not total[1]:
            break  # no certain segment: the model stays as it is
        # a token that is never toxic scores by its count alone; those that common are few by definition
        kept = counts.filter((F.col("toxic") >= 1) & (F.col("toxic") >= total[1] * TOKEN_SHARE) | (F.col("n") >= total[0] * TOKEN_SHARE * 10)).toArrow()
        every, positive = (kept[c].to_numpy().astype(float) for c in ("n", "toxic"))
        codes = np.array([data.reader.code(t) for t in kept["token"].to_pylist()], np.int64)
        scores = np.full(len(data.tokens), -DRIFT)
        scores[codes] = log_odds(positive, every, total[1], total[0])
        scores[0] = BREAK_SCORE
        background = np.zeros(scores.size)
        background[codes] = every - np.minimum(positive, every)
        model = Model(model.lexicon, {data.tokens[c]: float(scores[c]) for c in np.union1d(codes, [0])}, labels=model.labels)
        weigh_labels(model, data)
        calibrate_rate(model, data.reader.score[: scores.size], background)
    return model


def best_threshold(ranked: list[tuple[float, bool]]) -> float:
    """The probability below which texts are called toxic: the least whose F1 on the labelled texts is within
    ``SLACK`` standard errors of the best; midway (in logs) to the next text."""
    order = sorted(ranked)
    wanted, hits, points = sum(t for _, t in order), 0, []
    for k, (p, toxic) in enumerate(order):
        hits += toxic
        if k + 1 == len(order) or order[k + 1][0] > p:
            following = order[k + 1][0] if k + 1 < len(order) else 1.0
            points.append((2 * hits / (k + 1 + wanted), math.sqrt(max(p, 1e-12) * max(following, 1e-12))))
    best = max((f for f, _ in points), default=0.0)
    slack = SLACK * math.sqrt(best * (1 - best) / max(1, wanted))
    return min((at for f, at in points if f >= best - slack), default=1e-3)


SCORED = "score double, n_tokens int, passages array<struct<score: double, passage: string>>"


def raw_scores(documents: DataFrame, model: Model | None, key: str, text: str) -> DataFrame:
    """``(key, source, score, n_tokens, passages)`` of every row: the best segment's score, and all maximal segments of those that
    score at least ``SEED_SCORE / 2``."""
    rows = documents.select(F.col(key).alias("key"), "source", F.col(text).alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = Reader(m or Model(Lexicon(), {}))
        for b in batches:
            best, size, found = [np.zeros(0)], [np.zeros(0, np.int64)], []
            for part in batches_of([t or "" for t in b.column(2).to_pylist()]) if m else ():
                codes, ends = reader.read(part)
                scores, n = score_of(reader, codes, ends), np.diff(np.r_[0, ends])
                top = best_of(scores, ends)
                for k, e in enumerate(ends.tolist()):
                    found.append(passages(reader, codes[e - n[k] : e], scores[e - n[k] : e]) if top[k] >= SEED_SCORE / 2 else [])
                best.append(top)
                size.append(n)
                if len(reader.chunks) > Reader.FULL:
                    reader.clear()
            if not m:
                best, size, found = [np.zeros(b.num_rows)], [np.zeros(b.num_rows, np.int64)], [[]] * b.num_rows
            kind = pa.list_(pa.struct([("score", pa.float64()), ("passage", pa.string())]))
            columns = [pa.array(np.concatenate(best)), pa.array(np.concatenate(size), pa.int32()), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["key", "source", "score", "n_tokens", "passages"])

    def passages(reader: Reader, codes: np.ndarray, scores: np.ndarray) -> list[dict]:
        return [{"score": s, "passage": " ".join(reader.tokens[c] for c in codes[a:e])} for a, e, s in segments(scores.tolist()) if s >= SEED_SCORE / 2]

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, source string, {SCORED}")


def score_documents(documents: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, source, toxicity, p_value, n_passages, passage, passages, toxic)`` of every row; ``toxicity`` is -log10 of the p-value, at
    most 50, ``passages`` are the tokens of all significant segments and ``passage`` those of the best.

    Texts are read once: the scores are written, K comes from the histogram of all of them, the threshold from the labels."""
    raw = materialize(raw_scores(documents, model, key, text), "scores")
    if model is not None:
        x = F.floor(STEPS * F.least(F.lit(GREATEST_X), F.greatest(F.lit(LEAST_X), F.lit(model.rate) * F.col("score") - F.log(F.col("n_tokens")))))
        places = raw.filter("n_tokens > 0").groupBy(x.cast("int").alias("step")).agg(F.count_if(F.col("score") > 0).alias("n"), F.count_if(F.col("score") <= 0).alias("toxic"))
        calibrate_k(model, {r["step"]: (r["n"], r["toxic"]) for r in places.collect()})
        own = raw.join(F.broadcast(documents.sparkSession.createDataFrame(list(model.labels.items()), f"key {raw.schema['key'].dataType.simpleString()}, label boolean")), "key") if model.labels else None
        if own is not None:
            seen = {r["key"]: (model.p_value(r["score"], r["n_tokens"]), r["label"]) for r in own.select("key", "score", "n_tokens", "label").collect()}
            model.threshold = best_threshold(list(seen.values()))
    m = model or Model(Lexicon(), {})

    def p_value(score: Column) -> Column:
        x = F.least(F.lit(50.0), F.lit(m.log_k) + F.log(F.col("n_tokens")) - F.lit(m.rate) * score)
        return F.when((score <= 0) | (F.col("n_tokens") == 0), F.lit(1.0)).otherwise(-F.expm1(-F.exp(x)))

    scored = raw.withColumn("p_value", p_value(F.col("score")))
    significant = F.filter("passages", lambda x: p_value(x["score"]) <= F.lit(m.threshold))
    best = F.array_max(F.transform("passages", lambda x: F.struct(x["score"].alias("score"), x["passage"].alias("passage"))))["passage"]
    return scored.select(
        F.col("key").alias(key),
        "source",
        F.least(F.lit(50.0), F.greatest(F.lit(0.0), -F.log10(F.greatest("p_value", F.lit(1e-50))))).alias("toxicity"),
        "p_value",
        F.size(significant).alias("n_passages"),
        F.when(F.size(significant) > 0, best).alias("passage"),
        F.transform(significant, lambda x: x["passage"]).alias("passages"),
        (F.col("p_value") <= F.lit(m.threshold)).alias("toxic"),
    )


def source_rates(scored: DataFrame) -> DataFrame:
    """Documents, toxic documents and their share per source (null sources are a group)."""
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("toxic").alias("n_toxic")).withColumn("rate", F.col("n_toxic") / F.col("n_docs"))
