import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpusloom.llm import leakage
from corpusloom.llm.leakage import decode, encode, leaks, words


def grams(text, n=13):
    w = words(text or "")
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items):
    index = [(i, grams(p)) for i, p in items]
    return {(d, i) for d, t in docs for own in [grams(t)] for i, g in index if d is not None and own & g}


@given(st.lists(st.integers(0, 2**34), max_size=60))
def test_codes_round_trip(values):
    a = np.array(sorted(values), np.int64)
    assert decode(encode(a)).tolist() == a.tolist()


def test_words():
    assert words("O Número ﬁnal—é ½, “AÇÃO” de 12.5º!") == ["o", "numero", "final", "e", "1", "2", "acao", "de", "12", "5o"]
    assert words("straße Straße") == ["strasse", "strasse"] and words("") == []


def sample(seed):
    rng = random.Random(seed)
    vocabulary = [f"palavra{i}" for i in range(60)] + ["de", "a", "o", "é"] * 8
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([5, 12, 13, 14, 40])))) for i in range(25)] + [(99, None), (98, "")]
    docs = []
    for d in range(150):
        body = text(rng.randint(0, 120))
        if rng.random() < 0.6:
            p = words(rng.choice(items[:25])[1])
            s = rng.randint(0, max(0, len(p) - 12))
            part = p[s : s + rng.choice([11, 12, 13, 14, 30])]
            at = rng.randint(0, len(body))
            body[at:at] = [x.upper() if rng.random() < 0.5 else x for x in part]
        docs.append((d, " ".join(body)))
    return docs + docs[:5] + [(500, None), (501, ""), (None, docs[0][1]), (502, docs[1][1])], items


def test_phrases_against_brute_force(spark, monkeypatch):
    docs, items = sample(1)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' AS term", "1 AS block").repartition(3)
    i = spark.createDataFrame(items, "item_id bigint, passage string")
    found = leaks(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.match_kind == "phrase"} == brute(docs, items)
    assert len({(r.doc_id, r.item_id) for r in found}) == len(found)
    assert {(r.doc_id, r.item_id) for r in leaks(d, i, slack=0).collect() if r.match_kind == "phrase"} == brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in leaks(d, i, slack=None).collect()} == brute(docs, items)
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0


def test_proximity(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    broken = " ".join(f"w{i}" + (" xx" if i % 6 == 5 else "") for i in range(20))
    far = " ".join(f"w{i} " + "y " * 9 for i in range(20))
    d = spark.createDataFrame([(1, broken), (2, far), (3, passage)], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, passage)], "item_id bigint, passage string")
    assert {(r.doc_id, r.match_kind) for r in leaks(d, i).collect()} == {(1, "proximity"), (3, "phrase")}


def near_words(doc, passage, length=13, slack=3):
    """Most words of a window of the passage near one start, over all starts."""
    d, p = words(doc or ""), words(passage or "")
    width, best = min(2 * length, len(p)), 0
    for start in range(-len(p) - slack, len(d) + slack) if len(p) >= length else ():
        hit = [w in d[max(0, start + k - slack) : max(0, start + k + slack + 1)] for k, w in enumerate(p)]
        best = max(best, *(sum(hit[s : s + width]) for s in range(len(p) - width + 1)))
    return best


def test_proximity_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"palavra{i}" for i in range(300)] + ["de", "a", "o", "é"] * 20
    items = [(i, " ".join([rng.choice(vocabulary) for _ in range(n - 1)] + [f"raro{i}"])) for i, n in enumerate([13, 14, 20, 26, 27, 40] * 3)]
    docs = []
    for d in range(120):
        p = words(rng.choice(items)[1])
        # any words changed, left out or put in, the rarest ones among them
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(p))
            p[at : at + rng.randint(0, 1)] = [f"novo{rng.randint(0, 9)}"] * rng.randint(0, 1)
            p = p or ["a"]
        if rng.random() < 0.5:
            p = [w for w in p if not w.startswith("raro")]
        docs.append((d, " ".join([*rng.choices(vocabulary, k=rng.randint(0, 20)), *p, *rng.choices(vocabulary, k=rng.randint(0, 20))])))
    wanted = {(d, i): n for d, t in docs for i, p in items if (n := near_words(t, p)) >= 13}
    phrases = brute(docs, items)
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2), spark.createDataFrame(items, "item_id bigint, passage string")
    found = {(r.doc_id, r.item_id): r for r in leaks(d, i).collect()}
    assert found.keys() == wanted.keys() and len(wanted) > len(phrases) + 20
    assert {k: r.n_words for k, r in found.items() if r.match_kind == "proximity"} == {k: n for k, n in wanted.items() if k not in phrases}


def test_proximity_without_the_rarest_word(spark):
    passage = [f"w{i}" for i in range(20)]
    docs = [(1, " ".join([*passage[:10], "outra", *passage[11:]]))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    # neither run has 13 words, and w10 occurs nowhere
    for slack in (0, 3):
        assert [tuple(r) for r in leaks(d, spark.createDataFrame([(7, " ".join(passage))], "item_id bigint, passage string"), slack=slack).collect()] == [(1, 7, "proximity", 19)]


def test_several_blocks(spark):
    rows = [(d, " ".join(f"t{(d * 7 + k) % 50}" for k in range(30))) for d in range(40)]
    before = leakage.BLOCK_TOKENS
    passage = rows[11][1]
    d, i = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), spark.createDataFrame([(1, passage)], "item_id bigint, passage string")
    assert {(r.doc_id, r.item_id) for r in leaks(d, i, slack=0).collect() if r.match_kind == "phrase"} == brute(rows, [(1, passage)])
    assert leakage.BLOCK_TOKENS == before


def test_blocks_of_one_partition(spark):
    docs, items = sample(4)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    i = spark.createDataFrame(items, "item_id bigint, passage string")
    index = leakage.build_index(d, block_tokens=100).persist()
    texts = [n for n in (len(words(t or "")) for x, t in docs if x is not None) if n]
    # a block ends with the text that brings it to 100 tokens
    assert index.select("block").distinct().count() > sum(texts) // 250 > 10
    assert index.filter("term IS NULL").agg({"n": "sum"}).first()[0] == len(texts)
    found = {tuple(r) for r in leakage.find_leaks(index, i).collect()}
    assert {(r[0], r[1]) for r in found if r[2] == "phrase"} == brute(docs, items)
    assert found == {tuple(r) for r in leakage.find_leaks(leakage.build_index(d), i).collect()}
    index.unpersist()


def test_data(spark, data):
    d, i = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "eval_items"))
    wanted = brute([tuple(r) for r in d.select("doc_id", "text").collect()], [tuple(r) for r in i.select("item_id", "passage").collect()])
    assert {(r.doc_id, r.item_id) for r in leaks(d, i, slack=0).collect() if r.match_kind == "phrase"} == wanted


def test_a_passage_longer_than_the_gap_meets_several_documents(spark):
    rng = random.Random(9)
    passage = [f"p{rng.randint(0, 10**6)}" for _ in range(leakage.GAP + 200)]
    # both documents stand in the block as the passage has them: the gap between them is that between the parts
    first, second = passage[:60], passage[60 + leakage.GAP : 60 + leakage.GAP + 80]
    d = spark.createDataFrame([(1, " ".join(first)), (2, " ".join(second)), (3, "nada " * 30)], "doc_id bigint, text string").coalesce(1)
    i = spark.createDataFrame([(7, " ".join(passage))], "item_id bigint, passage string")
    assert {(r.doc_id, r.match_kind, r.n_words) for r in leaks(d, i).collect()} == {(1, "phrase", 60), (2, "phrase", 80)}


def test_items_in_blocks(spark, monkeypatch):
    docs, items = sample(4)
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    whole = {tuple(r) for r in leaks(d, i).collect()}
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 6)
    assert {tuple(r) for r in leaks(d, i).collect()} == whole


def test_windows_stay_within_the_gap(spark):
    index = spark.createDataFrame([], leakage.INDEX)
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, passage string")
    with pytest.raises(ValueError):
        leakage.find_leaks(index, items, length=leakage.GAP // 2)


def test_runs():
    assert leakage.runs_of(np.array([1, 1, 0, 1, 1, 1], bool), 2) == [(1, 2), (5, 3)] and leakage.runs_of(np.zeros(4, bool), 1) == [] and leakage.runs_of(np.zeros(0, bool), 1) == []


@given(st.text(alphabet="ab é\u00a0\u00a8´ﬁß_-.1½\n\u0301\u2028", max_size=40))
def test_chunks_have_the_words_of_the_text(text):
    codes = leakage.Codes()
    for _ in range(2):
        assert [codes.terms[c] for c in codes.read(text)] == words(text)
