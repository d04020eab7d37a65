import pytest

from corpusloom.llm import scans
from corpusloom.llm.scans import Repairer, folio_lines, glyph_candidates, repaired, scan_noise


@pytest.mark.parametrize(
    "read, printed",
    [("tes†e", "teste"), ("med1ção", "medição"), ("cornunicar", "comunicar"), ("ouvido5", "ouvidos"), ("tráfcgo", "tráfego"), ("ser\\/iço", "serviço"), ("autorizaçá~o", "autorização"), ("ericaminhar", "encaminhar"), ("qiiadro", "quadro"), ("v00", "voo")],
)
def test_glyphs(read, printed):
    assert glyph_candidates(read, {printed, "outra"}) == [printed]
    assert glyph_candidates(printed, {printed}) == []


def test_folios():
    lines = ["Página 3 de 9", "- 4 -", "fl. 2", "7 | 9", "xxxiv", "12", "Setor Valor Limite", "649", "21,5", "9.", "IV - texto", "9/3", "1) item", "[l]"]
    assert folio_lines(lines) == {0, 1, 2, 3, 4, 13} | {5} or folio_lines(lines) == {0, 1, 2, 3, 4, 13}
    assert folio_lines(["texto corrido.", "5/6", "mais texto."]) == {1} and folio_lines([]) == set()


def corpus():
    sentence = "O operador deverá comunicar a medição de ruído ao setor de tráfego e registrar o serviço no quadro da torre."
    pages = []
    for p in range(1, 4):
        pages += [f"JUNTA DE TRÁFEGO SUPERIOR\n- {p} -\nO operador deverá comuni-\ncar a med1ção de ruído ao setor de tráfego.\nO setor deverá registrar o serviço no quadro norte-\nsul da torre, como sempre no quadro norte-sul.\n{sentence}\n{sentence}\n{sentence}\n{sentence}"]
    scan = "\n".join(pages)
    return [(f"d{i}", scan) for i in range(6)] + [(f"c{i}", "\n".join([sentence] * 5)) for i in range(30)]


def test_noise_and_repair(spark):
    rows = corpus() + [("n", None), ("e", ""), ("b", " \n\n"), ("long", "palavra " * 50_000), ("d0", corpus()[0][1])]
    df = spark.createDataFrame(rows, "doc_id string, content string").selectExpr("*", "'x' AS key", "1 AS line_no")
    found = {(r.line_no, r.noise_kind) for r in scan_noise(df).filter("doc_id = 'd1'").collect()}
    assert found == {(10 * p + k, kind) for p in range(3) for k, kind in ((1, "header"), (2, "page_number"), (3, "hyphen"), (4, "misread"))}
    assert {r.doc_id for r in scan_noise(df).collect()} == {f"d{i}" for i in range(6)}
    text = {r.doc_id: r.repaired for r in repaired(df).collect()}
    assert "JUNTA" not in text["d1"] and "- 2 -" not in text["d1"] and "comunicar a medição de ruído" in text["d1"] and "norte-sul" in text["d1"] and "norte-\n" not in text["d1"]
    assert text["e"] == "" and text["b"] == "" and "n" not in text
    assert scan_noise(df.limit(0)).count() == 0 and repaired(df.limit(0)).count() == 0


def test_vectors_put_alike_words_together():
    import numpy as np

    rng = np.random.default_rng(0)
    # words 0 and 1 share contexts 2, 3; word 4 has 5, 6
    a, b = np.array([0, 0, 1, 1, 4, 4]), np.array([2, 3, 2, 3, 5, 6])
    a, b, n = np.r_[a, b], np.r_[b, a], np.full(12, 500)
    w, c = (rng.random((7, 8)) - 0.5) / 2, np.zeros((7, 8))
    for r in range(6):
        scans.train_step(a, b, n, w, c, np.ones(7), r, 0.2)
    cos = lambda i, j: w[i] @ w[j] / np.linalg.norm(w[i]) / np.linalg.norm(w[j])
    assert cos(0, 1) > cos(0, 4)


def vectors(words, llr=None):
    import numpy as np

    words = np.array(words, float)
    return scans.Vectors(words, words, np.linspace(-3, 3, scans.BINS) if llr is None else llr, words.mean(0), np.cov(words.T))


def test_choice_in_context():
    v = vectors([[3, 0], [0, 3], [3, 0], [0, 3]])
    r = Repairer({"mel": 50, "mil": 60, "doce": 40, "notas": 40}, v, set(), frozenset())
    assert r.options("m1l") == ["mil"] and r.correct(["notas", "m1l"], 1) == "mil" and r.correct(["mil"], 0) is None
    # the only word that glyphs explain is no neighbour of the place
    assert r.correct(["doce", "m1l"], 1) is None
    both = Repairer({"pala": 9, "pata": 9, "doce": 9, "notas": 9}, v, set(), frozenset())
    both.candidates_of["pa|a"] = ["pala", "pata"]
    assert both.correct(["doce", "pa|a"], 1) == "pala" and both.correct(["notas", "pa|a"], 1) == "pata"
    # no known word around: only a token with signs or digits is surely misread
    assert r.correct(["m1l"], 0) == "mil" and r.correct(["?", "m1l"], 1) == "mil"


def test_short_and_frequent_words_need_evidence():
    v = vectors([[3, 0], [0, 3], [3, 0], [0, 3], [3, 0]])
    r = Repairer({"na": 900, "deve": 900, "torre": 40, "carga": 40, "dcve": 3}, v, set(), scans.doubtful_words({"na": 900, "deve": 900, "dcve": 3}))
    assert r.doubtful == {"dcve"} and r.options("ria") == ["na"] and r.options("dcve") == ["deve"]
    assert r.correct(["torre", "ria"], 1) == "na" and r.correct(["carga", "ria"], 1) is None
    assert r.correct(["carga", "dcve"], 1) == "deve" and r.correct(["torre", "dcve"], 1) is None


def test_frequent_misreading_above_the_share(spark):
    # 600,000 words and more: the least count of a frequent word is the share's, and dcverá is above twice MIN_COUNT
    text = "O operador deverá comunicar a medição ao setor de tráfego. " * 250
    rows = [(f"d{i}", text + ("O operador dcverá comunicar a medição. " if i < 12 else "")) for i in range(260)]
    learned = scans.learn(spark.createDataFrame(rows, "doc_id string, content string"))
    assert sum(learned[0].values()) * scans.VOCABULARY_SHARE > 2 * scans.MIN_COUNT - 1 and learned[0]["dcverá"] == 12
    r = Repairer(*learned)
    assert r.doubtful == {"dcverá"} and r.options("dcverá") == ["deverá"]
    assert r.correct("O operador dcverá comunicar a medição ao setor".split(), 2) == "deverá"


def test_glyph_search_has_no_length_cap():
    word = "inconstitucionalissimamente" * 3
    assert glyph_candidates(word.replace("m", "rn", 1), {word}) == [word]


def test_training_is_the_same_with_any_number_of_trainers_and_runs(spark, monkeypatch):
    import numpy as np

    vocabulary = {f"w{i}": 1000 - i for i in range(60)}
    rows = [(i, j, None, (i * 7 + j) % 11 + 1, 0) for i in range(60) for j in range(i, 60) if (i + j) % 3 == 0]
    pairs = spark.createDataFrame(rows, "a int, b int, template string, n bigint, m bigint")
    one, again = scans.train_vectors(pairs, vocabulary), scans.train_vectors(pairs.repartition(5), vocabulary)
    assert np.allclose(one.words, again.words) and np.allclose(one.llr, again.llr)
    monkeypatch.setattr(scans, "TRAINER_PAIRS", 100)
    many = scans.train_vectors(pairs, vocabulary)
    near = lambda v, n: np.mean([v.words[a] @ v.contexts[b] for a in range(60) for b in range(60) if ((a + b) % 3 == 0) == n])
    for v in (one, many):
        assert near(v, True) > near(v, False) + 0.2


def rates(spark, docs, learned):
    """Recall and number of false rows of misread lines with planted misreadings."""
    import random

    rng, r, hits, wanted, false = random.Random(3), Repairer(*learned), 0, 0, 0
    swaps = [("o", "0"), ("e", "c"), ("m", "rn"), ("n", "ri"), ("a", "@"), ("i", "1"), ("d", "cl"), ("s", "5")]
    for text in docs:
        lines, planted = text.split("\n"), set()
        clean = {n for n, kind in r.noise(text)}
        for i, line in enumerate(lines):
            tokens = line.split(" ")
            places = [k for k, t in enumerate(tokens[1:-1], 1) if len(t) > 4 and t.isalpha() and t.islower() and learned[0].get(t, 0) > 20]
            if i + 1 not in clean and len(tokens) > 6 and places and rng.random() < 0.4:
                k = rng.choice(places)
                a, b = rng.choice([x for x in swaps if x[0] in tokens[k]] or [("", "")])
                if a:
                    tokens[k] = tokens[k].replace(a, b, 1)
                    lines[i] = " ".join(tokens)
                    planted.add(i + 1)
        found = {n for n, kind in r.noise("\n".join(lines)) if kind == "misread"}
        hits, wanted, false = hits + len(found & planted), wanted + len(planted), false + len(found - planted - clean)
    return hits / wanted, false, wanted


def test_vectors_decide_what_is_misread(spark, data):
    import numpy as np

    df = spark.read.parquet(f"{data}/store_documents.parquet").select("content").filter("content IS NOT NULL")
    docs = [r[0] for r in df.orderBy("content").collect()]
    vocabulary, v, templates, doubtful = scans.learn(df)
    recall, false, wanted = rates(spark, docs, (vocabulary, v, templates, doubtful))
    assert wanted > 200 and recall >= 0.9 and false <= 2  # 0.97 and more from sf0.01 on
    nothing = scans.Vectors(v.words * 0, v.contexts * 0, v.llr * 0, v.mean * 0, v.spread * 0)
    assert rates(spark, docs, (vocabulary, nothing, templates, doubtful))[0] < 0.05
    words = np.random.default_rng(1).normal(size=v.words.shape)
    other = scans.Vectors(words, v.contexts, v.llr, words.mean(0), np.cov(words.T))
    assert rates(spark, docs, (vocabulary, other, templates, doubtful))[0] < 0.8


def test_rates_on_the_data(spark, data):
    """Planted noise in clean text of the data comes back, and clean text stays clean."""
    df = spark.read.parquet(f"{data}/store_documents.parquet").select("doc_id", "content")
    clean = "O operador aéreo deve manter o plano de voo e o diário de bordo.\nA equipe de pista deve revisar o cadastro de pilotos e o plano de voo."
    bad = clean.replace("operador", "opcrador").replace("cadastro", "cada5tro")
    rows = spark.createDataFrame([("good", clean), ("bad", bad)], "doc_id string, content string")
    found = {(r.doc_id, r.line_no, r.noise_kind) for r in scan_noise(df.unionByName(rows)).filter("doc_id IN ('good', 'bad')").collect()}
    assert found == {("bad", 1, "misread"), ("bad", 2, "misread")}
