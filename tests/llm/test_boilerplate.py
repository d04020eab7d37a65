import random
import re
from collections import defaultdict

from corpusloom.llm import boilerplate
from corpusloom.llm.boilerplate import repeated_lines, without_lines


def brute(rows):
    docs, lines = defaultdict(set), defaultdict(set)
    for doc, source, text in rows:
        if doc is None or source is None or text is None:
            continue
        docs[source].add(doc)
        for line in text.split("\n"):
            n = re.sub("[0-9]+", "#", " ".join(line.lower().split()))
            if sum(c.isalpha() for c in n) >= 15:
                lines[source, n].add(doc)
    return {(s, n) for (s, n), d in lines.items() if len(d) >= 5 and len(d) >= 0.1 * len(docs[s])}


def sample(n, seed):
    rng = random.Random(seed)
    words = "piloto torre pista norma aviso carga combustível registro seção anexo".split()
    site = {s: [f"Clique aqui para relatar um erro {s}", f"Publicado pela  equipe {s} em 12/03/{2000}", "Avalie este texto de 1 a 5 estrelas"] for s in "abc"}
    out = []
    for i in range(n):
        s = rng.choice("aaaabc")
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(0, 12))]
        for k, line in enumerate(site[s]):
            if rng.random() < (0.5, 0.11, 0.09)[k]:
                lines.insert(rng.randint(0, len(lines)), line.replace("2000", str(rng.randint(1990, 2020))).upper() if rng.random() < 0.3 else line)
        out.append((f"d{i}", s, "\n".join(lines)))
    return out


def test_against_brute_force(spark, monkeypatch):
    rows = sample(900, 1)
    rows += rows[:30] + [(None, "a", "x" * 30), ("n", None, "x" * 30), ("m", "b", None), ("e", "b", ""), ("long", "c", "\n".join(["Linha muito repetida no mesmo texto"] * 3000))]
    df = spark.createDataFrame(rows, "doc_id string, source string, content string").repartition(5)
    wanted = brute(rows)
    assert len(wanted) >= 4
    assert {(r.source, r.line_text) for r in repeated_lines(df).collect()} == wanted
    clean = without_lines(df.selectExpr("*", "1 AS clean_content"), repeated_lines(df)).collect()
    assert len(clean) == len(rows)
    for r in clean:
        if r.content is None or r.source is None:
            assert r.clean_content == r.content
            continue
        kept = [x for x in r.content.split("\n") if (r.source, re.sub("[0-9]+", "#", " ".join(x.lower().split()))) not in wanted]
        assert r.clean_content == "\n".join(kept)


def test_small_blocks_lose_nothing(spark, monkeypatch):
    rows = sample(400, 2)
    df = spark.createDataFrame(rows, "doc_id string, source string, content string").repartition(40)
    assert {(r.source, r.line_text) for r in repeated_lines(df).collect()} == brute(rows)


def test_documents_repeated_across_partitions(spark):
    # 10 of 100 documents have the line; the others are delivered six times more, in other partitions
    rows = [(f"d{i:03}", "a", ("Linha do portal em dez de cem\n" if i < 10 else "") + f"texto próprio do documento {'abcdefghij'[i % 10] * (i // 10 + 1)}") for i in range(100)]
    df = spark.createDataFrame(rows[:10] + rows[10:] * 7, "doc_id string, source string, content string").repartition(6, "content").unionByName(spark.createDataFrame(rows[10:], "doc_id string, source string, content string"))
    assert {(r.source, r.line_text) for r in repeated_lines(df).collect()} == brute(rows) == {("a", "linha do portal em dez de cem")}
    local = boilerplate.local_templates(df.toDF("doc", "source", "content"), 0.1, 15).filter("leaf IS NULL").collect()
    # every document is counted in one block, once
    assert sum(r.n for r in local) == 100


def test_small_sources_stay_off_the_driver(spark):
    rows = [(f"d{i}", f"s{i % 60}", "\n".join(["Linha comum da fonte inteira", *(f"{'abcdefgh'[k]}{'xyz' * (i + 1)} só deste texto" for k in range(8))])) for i in range(480)]
    df = spark.createDataFrame(rows, "doc string, source string, content string")
    local = boilerplate.local_templates(df, 0.1, 15, block=50)
    found = {tuple(r) for r in boilerplate.global_templates(local, 0.1, 5).collect()}
    assert local.filter("template IS NOT NULL").count() > 3000
    assert found == {(f"s{k}", "linha comum da fonte inteira") for k in range(60)}
    assert {(r.source, r.line_text) for r in repeated_lines(df.withColumnRenamed("doc", "doc_id")).collect()} == found


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id string, source string, content string")
    assert repeated_lines(df).count() == 0
    assert without_lines(df, repeated_lines(df)).count() == 0


def test_data(spark, data):
    df = spark.read.parquet(f"{data}/store_documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "source", "content").collect()]
    assert {(r.source, r.line_text) for r in repeated_lines(df).collect()} == brute(rows)


def test_templates_generalise():
    t = boilerplate.TemplateTree()
    for k, name in enumerate(("ana", "rui", "eva")):
        t.file("s", f"última conferência feita por {name} em #/#/#", [k, 7])
    assert [[(" ".join(e[0]), e[1]) for e in entries] for entries in t.leaves.values()] == [[(f"última conferência feita por {boilerplate.WILD} em #/#/#", {0, 1, 2, 7})]]


def test_groups_of_sources(spark, monkeypatch):
    rows = sample(500, 5) + [("n", None, "x" * 30 + "\n" + "y" * 20)]
    df = spark.createDataFrame(rows, "doc_id string, source string, content string").repartition(3)
    wanted = brute(rows)
    whole = {(r.doc_id, r.clean_content) for r in without_lines(df, repeated_lines(df)).collect()}
    monkeypatch.setattr(boilerplate, "MOST_LINES", 1)
    lines = repeated_lines(df)
    assert {(r.source, r.line_text) for r in lines.collect()} == wanted and len({s for s, _ in wanted}) > 1
    assert {(r.doc_id, r.clean_content) for r in without_lines(df, lines).collect()} == whole


def test_blocks_by_size(spark, monkeypatch):
    rows = [(f"d{i}", "a", f"Linha repetida do portal\n{'texto próprio ' * 20}{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc string, source string, content string").coalesce(1)
    assert boilerplate.local_templates(df, 0.1, 15, block=7).filter("leaf IS NULL").count() > 60 // 7
