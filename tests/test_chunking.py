import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.operators import chunking as C


def words(n, w="p"):
    return " ".join(f"{w}{i}" for i in range(n))


@pytest.mark.parametrize("n, sizes", [(0, []), (269, [269]), (270, [270, 50]), (540, [270, 270, 100]), (600, [270, 270, 160])])
def test_windows(spark, n, sizes):
    got = [len(w.split()) for w in C.windows(words(n).split(), 270, 50)]
    assert got == sizes
    rows = C.word_windows(spark.createDataFrame([(1, words(n)), (2, None)], "k int, t string"), "k", "t").orderBy("chunk_index").collect()
    assert [r.n_words for r in rows] == sizes and all(r.chunk == w for r, w in zip(rows, C.windows(words(n).split(), 270, 50)))


def test_segments():
    assert C.segments_of("a\n\nb\n\n c ") == ["a", "b", "c"]
    assert len(C.segments_of("\n".join("linha" for _ in range(11)))) == 11
    assert C.segments_of("Art. 1 um Art. 2 dois") == ["Art. 1 um", "Art. 2 dois"]
    assert C.segments_of("Um. Dois! três? Quatro") == ["Um.", "Dois! três?", "Quatro"]


def test_segment_chunks():
    assert C.segment_chunks(words(270)) == [("", None, words(270))]
    text = "\n\n".join(words(100, w) for w in "abc")
    got = C.segment_chunks(text, 200)
    # the second chunk repeats the last of the two segments before it, and may exceed the limit
    assert [g[0] for g in got] == ["-chunk-0", "-chunk-1"] and got[1][2].startswith("b0") and len(got[1][2].split()) == 200
    big = C.segment_chunks(words(50) + "\n\n" + words(300, "x"), 200)
    assert [len(g[2].split()) for g in big] == [50, 200, 150]


def test_article_chunks():
    text = "PORTARIA\n\nArt. 1º um dois\nArt. 2º " + "\n§ 1º " + words(30) + "\n§ 2º " + words(30)
    got = C.article_chunks(text, 40)
    assert [g[0] for g in got] == ["-art1", "-art2-0", "-art2-1"]
    assert got[0][2].startswith("PORTARIA\n\nArt. 1º") and got[2][2].startswith("Art. 2 (continuação)\n§ 2º")
    assert C.article_chunks("x" * 600 + "\nArt. 1 " + words(20))[0][2].startswith("Art. 1")
    assert C.article_chunks("x" * 600 + "\nArt. 1 " + words(20), keep_preamble=True)[0][:2] == ("-preamble", None)
    assert C.article_chunks("curto") == [("", None, "curto")]
    assert [len(g[2].split()) for g in C.article_chunks(words(90) + "\n\n" + words(90), 100)] == [90, 90]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=20), st.integers(10, 50))
def test_no_word_is_lost(sizes, limit):
    text = "\n\n".join(words(n, f"s{i}x") for i, n in enumerate(sizes))
    got = [w for _, _, t in C.segment_chunks(text, limit, 0) for w in t.split()]
    assert got == text.split()


def test_documents(spark):
    rows = [("a", "Instrução ICA 1", "Art. 1 " + words(60)), ("b", "lei", words(600)), ("c", None, None), ("d", "lei", "")]
    out = C.chunk_documents(spark.createDataFrame(rows, "doc_id string, doc_type string, content string").selectExpr("*", "1 AS text")).collect()
    assert [(r.regulation_id, r.chunk_type) for r in out if r.doc_id == "a"] == [("a-art1", "article")]
    assert len([r for r in out if r.doc_id == "b"]) == 3 and [r.text for r in out if r.doc_id in "cd"] == ["", ""]
    assert C.chunk_documents(spark.createDataFrame([], "doc_id string, doc_type string, content string")).count() == 0


def test_sections(spark):
    text = "prefácio\n1 Objetivo\nlinha\n2.1 Âmbito\n3 minúscula\n10. Fim"
    rows = C.numbered_sections(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t").collect()
    assert [(r.section, r.number, r.body) for r in rows] == [(0, "1", "1 Objetivo\nlinha"), (1, "2.1", "2.1 Âmbito\n3 minúscula"), (2, "10", "10. Fim")]
    assert re.match("1", rows[0].number)
