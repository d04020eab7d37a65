from pyspark.sql import functions as F

from corpusloom.functions import answers as A
from corpusloom.operators import evaluation as E
from corpusloom.operators import audit, feedback


def test_json_in_noise():
    assert A.first_json('```json\n[{"a": "]"}] fim') == '[{"a": "]"}]' and A.first_json('x {"q": {"b": "\\"}"}} y {') == '{"q": {"b": "\\"}"}}'
    assert A.first_json("nada") is None and A.first_json(None) is None and A.first_json("{quebrado") is None


def test_rewritten_queries(spark):
    answer = '{"queries": [{"text": " um ", "filters": [{"field": "status", "value": "x"}, {"field": "nao", "value": 1}, {"field": "status", "value": ""}, {"field": "metadata.type", "value": "ICA", "operator": "??"}]}, {"text": "UM2"}, {"text": "um2"}, {"t": 1}, {"text": "fora"}]}'
    rows = [("1", "p", answer), ("2", "pergunta", "quebrado"), ("3", "p3", '{"text": "so um", "sorts": [{"field": "d", "order": "up"}, {"field": "e"}], "filters": [{"field": "metadata.type", "value": "ICA"}, {"field": "metadata.type", "value": "XYZ"}]}'), ("4", "q4", None)]
    got = A.rewritten_queries(spark.createDataFrame(rows, "query_id string, question string, answer string"))
    out = {(r.query_id, r.query_idx): r for r in got.collect()}
    assert {(k, r.text, r.facet) for k, r in out.items()} == {(("1", 0), "UM2", "general"), (("2", 0), "pergunta", "original"), (("3", 0), "so um", "general"), (("4", 0), "q4", "original")}
    assert [(s.field, s.order) for s in out["3", 0].sorts] == [("e", "desc")]
    known = A.known_values_only(got, spark.createDataFrame([("type", "ICA")], "field string, value string"))
    assert [f.value for f in known.filter("query_id = '3'").first().filters] == ["ICA"]


def test_rendered_sources(spark):
    rows = [("q", i, f"r{i}", "x" * 40) for i in range(1, 6)] + [("z", 1, None, None)]
    out = {r.query_id: r.sources for r in A.rendered_sources(spark.createDataFrame(rows, "query_id string, rank int, regulation_id string, text string"), 120).collect()}
    assert out["q"].count("[Source") == 2 and out["q"].endswith("[... 3 more sources truncated ...]") and out["z"] == "[Source 1] ?\n"


def test_retrieval_metrics(spark):
    exp = spark.createDataFrame([("1", 1, "A", "relevant"), ("1", 2, "B", "moderate"), ("2", 1, "a", "relevant"), ("2", 2, "b", "moderate"), ("3", 1, "NOT_IN_DB", "irrelevant"), ("4", 1, "x", "relevant")], "query_id string, seq int, id string, relevance string")
    hits = spark.createDataFrame([("1", 1, "B"), ("1", 2, "A"), ("2", 1, "a-art1"), ("2", 2, "a-art2"), ("2", 3, "b")], "query_id string, rank int, id string")
    g = E.graded_hits(hits, exp, 5)
    assert {r.query_id: r.gains for r in g.collect()} == {"1": [1.0, 2.0], "2": [2.0, 0.0, 1.0], "4": []}
    m = {r.query_id: r for r in E.query_metrics(g, 5).collect()}
    assert m["1"].reciprocal_rank == 0.5 and m["1"].recall == 1.0 and 0 < m["1"].ndcg < 1 and (m["4"].hit, m["4"].ndcg) == (0, 0.0)
    perfect = spark.createDataFrame([("1", 1, "A"), ("1", 2, "B")], "query_id string, rank int, id string")
    assert E.query_metrics(E.graded_hits(perfect, exp, 5), 5).filter("query_id = '1'").first().ndcg == 1.0
    s = E.summary(E.query_metrics(g, 5)).first()
    assert s.n_queries == 3 and abs(s.hit_rate - 2 / 3) < 1e-9 and E.summary(E.query_metrics(g.limit(0), 5)).first().hit_rate == 0.0


def test_answer_metrics(spark):
    rows = [("Não encontrei nada.", []), ("Conforme ICA 96-1 e [ICA 100-40-art10].", ["ICA 100-40-art10"]), ("Possivelmente ICA 63-10.", ["x"]), (None, None), ("", [])]
    df = spark.createDataFrame(rows, "response string, sources array<string>")
    r = E.response_metrics(df).first()
    assert (r.n_responses, r.empty_rate, r.citation_rate, r.hedging_rate, r.grounding_rate) == (5, 0.6, 0.4, 0.2, 0.5)
    v = lambda t: spark.createDataFrame([(t,)], "t string").select(E.verdict(F.col("t")).alias("v")).first().v
    assert [v('```json\n{"score": 4}\n```'), v('{"score": 6}'), v('{"score": true}'), v("nada"), v('{"score": "3"}'), v(None)] == [4, None, None, None, None, None]
    med = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 7), ("b", 7), ("c", None)], "k string, v int")
    assert {tuple(r) for r in E.upper_median_by(med, ["k"], "v").collect()} == {("a", 3), ("b", 7)}


def test_feedback(spark):
    schema = "event_id bigint, session_id string, message_id string, kind string, thumbs string, star_category string, star_value int, comment string, created_at timestamp"
    ev = [(1, "s", "m", "star", None, "clarity", 4, None, None), (2, "s", "m", "star", None, "clarity", 2, None, None), (3, "s", "m", "star", None, "accuracy", 5, None, None), (4, "s", "m", "star", None, "accuracy", None, None, None),
          (5, "s", "m", "comment", None, None, None, "bom", None), (6, "s", "m", "comment", None, None, None, "", None), (7, "s", "m", "thumbs", "up", None, None, None, None), (8, "s", "n", "thumbs", "maybe", None, None, None, None), (9, "s", "n", "star", None, "clarity", 9, None, None), (10, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(ev, schema)
    assert df.filter(~feedback.valid_event()).count() == 3
    r = feedback.current_feedback(df.filter(feedback.valid_event())).collect()
    assert len(r) == 1 and (r[0].rating_clarity, r[0].rating_accuracy, r[0].last_comment, r[0].last_thumbs, r[0].last_event_id) == (2, None, "bom", "up", 7)


def test_chat(spark):
    rows = [("s", 1, "assistant", "olá"), ("s", 2, "user", " \n"), ("s", 3, "user", "primeira\npergunta " + "longa " * 20), ("s", 4, "assistant", "r"), ("t", 1, "user", "curta")]
    df = spark.createDataFrame(rows, "session_id string, turn int, role string, content string")
    titles = {r.session_id: r.title for r in feedback.chat_title(df).collect()}
    assert titles["t"] == "curta" and titles["s"].startswith("primeira pergunta longa") and titles["s"].endswith("longa...") and len(titles["s"]) <= 53
    assert {(r.session_id, r.turn): r.question for r in feedback.previous_question(df).collect()}["s", 4].startswith("primeira")
    whole = {(r.session_id, r.turn, r.question) for r in feedback.previous_question(df).collect()}
    assert {(r.session_id, r.turn, r.question) for r in feedback.previous_question(df, block=1).collect()} == whole
    assert feedback.last_turns(df, 2).count() == 3
    nested = spark.createDataFrame([("s", [("user", "t1", "m1", {"clarity": 3}), ("assistant", None, "m2", {"overall": 1})])], "session_id string, messages array<struct<role:string,timestamp:string,message_id:string,ratings:map<string,int>>>")
    flat = feedback.unnest_history(nested)
    assert flat.count() == 2 and [tuple(r)[:5] for r in feedback.star_events(flat).collect()] == [("s", "m1", "star", "clarity", 3)]


def test_trace(spark):
    t = spark.createDataFrame([("q1", [("s1", [("r1", 0.9), ("r2", 0.8)]), ("s2", [])], [("r1", 70.0), ("r1", 90.0)], ["r2"]), ("q2", [], [], [])],
                              "query_id string, sub_queries array<struct<text:string,documents array<struct<regulation_id:string,score:double>>>>, evaluations array<struct<regulation_id:string,relevance:double>>, generator array<string>".replace("documents array", "documents:array"))
    rows = {tuple(r) for r in audit.explode_trace(t).collect()}
    assert rows == {("q1", 0, "s1", 0, "r1", 0.9, 90.0, False), ("q1", 0, "s1", 1, "r2", 0.8, None, True), ("q1", 1, "s2", None, None, None, None, False), ("q2", None, None, None, None, None, None, False)}
