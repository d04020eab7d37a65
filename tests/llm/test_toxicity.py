import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import toxicity as T


def brute_segments(scores):
    """Ruzzo and Tompa by their definition: the greatest contiguous sum, then both sides of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            # of equal sums the shortest is maximal: a maximal segment has no part that scores as much
            if total > best or (total == best and at and j + 1 - i < at[1] - at[0]):
                best, at = total, (i, j + 1)
    if at is None:
        return []
    a, b = at
    return brute_segments(scores[:a]) + [(a, b, best)] + [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-3.0, -1.5, -0.25, 0.5, 1.25, 4.125]), max_size=14))
def test_segments_are_the_maximal_ones(scores):
    found, wanted = T.segments(scores), brute_segments(scores)
    assert found == wanted


@pytest.mark.parametrize(
    "text, tokens",
    [("c.r.e.t.i.n.o", ["cretino"]), ("I N Ú T I L!", ["inutil", "¶"]), ("d3líc14", ["delicia"]), ("babaaaaca", ["babaca"]), ("creti#o", ["cretino"]), ("burr0", ["burro"]), ("VMB61", ["vmb", "#"]) , ("raça in​ferior", ["raca", "inferior"]), ("", [])],
)
def test_obfuscated_words(text, tokens):
    lexicon = T.Lexicon(frozenset("cretino inutil delicia babaca burro raca inferior".split()))
    got = T.tokens_of(text, lexicon)
    assert got == tokens or (text == "VMB61" and "burro" not in got)


def corpus(n, seed):
    rng = random.Random(seed)
    neutral = ["o piloto deve revisar o plano de voo", "a torre informa a pista em uso", "o setor de carga mantém o registro", "matar a velocidade antes da cabeceira", "uma praga de cupins na madeira do hangar"]
    toxic = ["você é um cretino imundo e devia calar a boca", "essa praga de gente devia sumir do país", "seus babacas imundos calem a boca", "gente dessa raça devia sumir daqui"]
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.12
        parts = [rng.choice(neutral) for _ in range(rng.randint(2, 8))]
        if bad:
            s = rng.choice(toxic)
            parts.insert(rng.randint(0, len(parts)), s.replace("cretino", "cret1no") if rng.random() < 0.3 else s)
        rows.append((i, ". ".join(parts) + ".", rng.choice(["s", "s", "u", None])))
        if rng.random() < 0.6:
            labels += [(i, a, "abuse" if bad else "clean", None) for a in ("x", "y")]
    return rows, labels, toxic


def test_held_out_accuracy(spark):
    rows, labels, toxic = corpus(700, 1)
    rows += rows[:10] + [(9001, None, "s"), (9002, "", "s"), (9003, "palavra " * 30_000, "s")]
    labels += [(1, "x", None, None), (77777, "x", "hate", None), (None, "x", "hate", None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS toxic", "'p' AS passage")
    lab = spark.createDataFrame(labels, "doc_id bigint, annotator string, label string, labelled_at timestamp")
    terms = spark.createDataFrame([("cretino",), ("praga",), (None,)], "term string")
    scored = T.score_documents(d, T.fit(d, lab, terms)).collect()
    assert len(scored) == len(rows)
    seen = {x[0] for x in labels}
    wanted = {i for i, t, _ in rows if t and any(x.split()[-1] in t and x.split()[0] in t and x[-12:] in t for x in toxic)} - seen
    found = {r.doc_id for r in scored if r.toxic} - seen
    assert len(found & wanted) >= 0.85 * len(wanted) and len(found & wanted) >= 0.85 * len(found)
    assert {(r.toxicity, r.toxic) for r in scored if r.doc_id in (9001, 9002)} == {(0.0, False)}
    rates = {r.source: r.n_docs for r in T.source_rates(T.score_documents(d, None)).collect()}
    assert sum(rates.values()) == len(rows)


def test_no_positive_label_and_empty_tables(spark):
    rows, labels, _ = corpus(20, 2)
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    none = spark.createDataFrame([], "doc_id bigint, annotator string, label string, labelled_at timestamp")
    terms = spark.createDataFrame([], "term string")
    assert T.fit(d, none, terms) is None
    assert T.score_documents(d, None).filter("toxic OR toxicity > 0").count() == 0
    assert T.score_documents(d.limit(0), None).count() == 0


def test_votes(spark):
    from datetime import datetime as t

    rows = [(1, "a", "clean", t(2024, 1, 1)), (1, "a", "hate", t(2024, 1, 2)), (2, "a", "hate", t(2024, 1, 1)), (2, "b", "clean", t(2024, 1, 1)), (3, "a", "clean", None), (4, "a", None, t(2024, 1, 1))]
    lab = spark.createDataFrame(rows, "doc_id bigint, annotator string, label string, labelled_at timestamp")
    assert {tuple(r) for r in T.votes(lab).collect()} == {(1, True), (3, False)}


def test_k_from_a_histogram_with_censored_texts():
    rng = random.Random(5)
    model = T.Model(T.Lexicon(), {}, rate=1.0)
    for log_k, least in ((-3.0, 0.0), (-3.0, 3.0), (-1.0, 2.0)):
        bests = {}
        for i in range(20_000):
            n = rng.choice([20, 60, 200])
            score = log_k + math.log(n) - math.log(-math.log(rng.random()))
            at = bests.setdefault(int(T.steps_of(model, np.array([score if score > least else least]), np.array([n]))[0]), [0, 0])
            # a score of at most ``least`` is only known to be no higher
            at[score <= least] += 1
        T.calibrate_k(model, {k: tuple(v) for k, v in bests.items()})
        assert abs(model.log_k - log_k) < 0.1


def test_k_is_that_of_all_texts(spark):
    rows, labels, _ = corpus(600, 4)
    toxic = {i for i, _, label, _ in labels if label == "abuse"}
    clean = sorted({x[0] for x in labels} - toxic)
    # toxic texts are most of the labelled ones
    labels = [x for x in labels if x[0] in toxic or x[0] in clean[:30]]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    lab = spark.createDataFrame(labels, "doc_id bigint, annotator string, label string, labelled_at timestamp")
    m = T.fit(d, lab, spark.createDataFrame([("cretino",)], "term string"))
    scored = T.score_documents(d, m).collect()
    bests, reader = {}, T.Reader(m)
    for _, text, _ in rows:
        codes, ends = reader.read([text])
        score = T.best_of(T.score_of(reader, codes, ends), ends)
        at = bests.setdefault(int(T.steps_of(m, score, ends)[0]), [0, 0])
        at[int(score[0] <= 0)] += 1
    wanted = T.Model(m.lexicon, m.scores, m.rate)
    T.calibrate_k(wanted, bests)
    assert wanted.log_k == m.log_k
    # the threshold follows the labels, not a fixed p-value
    found = {r.doc_id for r in scored if r.toxic and r.doc_id in toxic}
    assert len(found) >= 0.9 * len(toxic)
    for r in scored:
        assert len(r.passages) == r.n_passages and (r.passage in r.passages if r.n_passages else r.passage is None)
        assert math.isclose(r.p_value, m.p_value(*next((float(T.best_of(T.score_of(reader, c, e), e)[0]), int(e[0])) for c, e in [reader.read([rows[r.doc_id][1]])])), rel_tol=1e-9, abs_tol=1e-12)


TEXTS = ["I N Ú T I L é você!", "a b c d", "c.r.e.t.i.n.o\nd3líc14 babaaaaca", "", " \n ", "raça in\u200bferior; VMB61 ´x", "a b\nc d e f g h cretino", "x " * 5, "¶ só isto."]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(TEXTS) | st.text(alphabet="ab é.,!\n01$\u200b´-", max_size=30), max_size=6))
def test_reader_agrees_with_the_plain_tokeniser(texts):
    lexicon = T.Lexicon(frozenset("cretino inutil delicia babaca burro raca inferior".split()))
    reader = T.Reader(T.Model(lexicon, {"cretino": 4.0}))
    for _ in range(2):
        codes, ends = reader.read(texts)
        at = 0
        for t, e in zip(texts, ends.tolist()):
            assert [reader.tokens[c] for c in codes[at:e]] == T.tokens_of(t, lexicon)
            at = e
    assert reader.score[reader.code("cretino")] == 4.0 and reader.score[reader.code("ab")] == -T.DRIFT


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([-3.0, -1.5, -0.25, 0.5, 1.25, 4.125, None]), max_size=10), max_size=5))
def test_array_scans_agree_with_the_segments(texts):
    flat = [x for t in texts for x in t]
    codes = np.array([0 if x is None else 1 for x in flat], np.int64)
    scores = np.array([T.BREAK_SCORE if x is None else x for x in flat])
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    plain = [[T.BREAK_SCORE if x is None else x for x in t] for t in texts]
    assert np.allclose(T.best_of(scores, ends), [max((s for *_, s in T.segments(t)), default=0.0) for t in plain])
    found = {(int(k), int(a), int(e)): s for k, a, e, s in zip(*T.sentence_segments(codes, ends, scores, 0, 1.0))}
    wanted, at = [], 0
    for k, t in enumerate(texts):
        sentence = []
        for x in [*t, None]:
            if x is None:
                best = max((s for *_, s in T.segments(sentence)), default=0.0)
                wanted += [(k, best)] * (best >= 1.0)
                sentence = []
            else:
                sentence.append(x)
    assert sorted((k, round(s, 9)) for (k, _, _), s in found.items()) == sorted((k, round(s, 9)) for k, s in wanted)
    assert all(math.isclose(scores[a:e].sum(), s) and 0 not in codes[a:e] for (_, a, e), s in found.items())


def test_a_harmless_run_scores_by_itself():
    texts = [("esses homens sao uma praga", True), ("as torres sao uma praga", True)] * 6 + [("os cupins sao uma praga", False)] * 8 + [("o piloto revisa o plano", False)] * 60
    data = T.read_labelled(texts, ["praga"])
    model = T.seed_model(data, ["praga"])
    reader = T.Reader(model)
    best = lambda t: float(T.best_of(T.score_of(reader, *reader.read([t])), reader.read([t])[1])[0])
    assert best("esses homens sao uma praga") > 3 > 1 > best("os cupins sao uma praga")


def test_corpus_counts_against_a_plain_count(spark):
    from collections import Counter

    rows, _, _ = corpus(120, 6)
    texts = [t for _, t, _ in rows] + ["", "só isto"]
    model = T.Model(T.Lexicon(frozenset(["cretino"])), {"cretino": 6.0, "imundo": 3.0, "praga": 2.5, "gente": 3.5, T.BREAK: T.BREAK_SCORE}, rate=0.5)
    got = T.corpus_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), model).collect()
    plain = Counter(w for t in texts for w in T.tokens_of(t, model.lexicon))
    assert {r.token: r.n for r in got if r.token and r.step is None} == plain
    assert sum(r.n + r.toxic for r in got if r.token is None) == len([t for t in texts if t])
    reader, wanted = T.Reader(model), Counter()
    for t in texts:
        codes, ends = reader.read([t])
        for _, a, e, s in zip(*T.sentence_segments(codes, ends, T.score_of(reader, codes, ends), 0, T.SEED_SCORE)):
            wanted.update((reader.tokens[c], int(T.steps_of(model, np.array([s]), ends)[0])) for c in codes[a:e])
    found = {(r.token, r.step): r.toxic for r in got if r.token and r.step is not None}
    assert wanted and found == wanted
