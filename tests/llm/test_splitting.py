import re

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import splitting
from corpusloom.llm.splitting import GAP, best_cuts, oversized, split_documents, split_text


def brute_cost(n, natural, limit, overlap):
    reach, candidates, at = limit - overlap, [0], 0
    for b in [*sorted(natural), n]:
        if b <= overlap:
            continue
        if b - at > max(1, reach // 2):
            candidates.extend(range(max(at, overlap) + 1, b))
        if b < n:
            candidates.append(b)
        at = b
    candidates.append(n)
    pieces = max(2, -(-(n - overlap) // reach))
    ideal = (n - overlap) / pieces + overlap
    best = [0.0] + [1e18] * (len(candidates) - 1)
    for j in range(1, len(candidates)):
        for i in range(j):
            size = candidates[j] - (candidates[i] - overlap if i else 0)
            if size <= limit:
                best[j] = min(best[j], best[i] + ((size - ideal) / ideal) ** 2)
        best[j] += natural.get(candidates[j], GAP) if j < len(candidates) - 1 else 0
    return best[-1]


def cost(cuts, n, limit, overlap):
    pieces = max(2, -(-(n - overlap) // (limit - overlap)))
    ideal, total, before = (n - overlap) / pieces + overlap, 0.0, 0
    for c, k in cuts:
        size = c - (before - overlap if before else 0)
        assert size <= limit
        total, before = total + ((size - ideal) / ideal) ** 2 + k, c
    return total


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_cuts_are_optimal(data):
    limit = data.draw(st.integers(3, 30))
    overlap = data.draw(st.integers(0, limit - 1))
    n = data.draw(st.integers(limit + 1, 120))
    natural = data.draw(st.dictionaries(st.integers(1, n - 1), st.sampled_from([0.0, 0.05, 0.15, 0.35, 0.6])))
    cuts = best_cuts(n, natural, limit, overlap)
    assert abs(cost(cuts, n, limit, overlap) - brute_cost(n, natural, limit, overlap)) < 1e-9


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab. \n\tÉ;", max_size=400), st.integers(2, 12), st.integers(0, 5))
def test_round_trip(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    pieces = split_text(text, limit, overlap)
    words = re.findall(splitting.WORD, text)
    assert "".join(text[f:e] for _, f, e, _, _ in pieces) == (text[text.index(words[0]) :] if words else "")
    for k, (start, fresh, end, n, _) in enumerate(pieces):
        own = re.findall(splitting.WORD, text[start:end])
        assert len(own) == n <= limit
        if k:
            assert re.findall(splitting.WORD, text[start:fresh]) == own[:overlap] and len(own) > overlap


def test_natural_boundaries_win():
    text = "\n\n".join(f"Art. {i}º " + "palavra " * 17 + "fim." for i in range(1, 9))
    pieces = split_text(text, 45, 5)
    assert all(text[f:].startswith("Art.") for _, f, _, _, _ in pieces)
    assert len(split_text("x " * 1000, 400, 40)) == 3


def test_documents(spark):
    long = "palavra " * 450
    rows = [("a", long, 1), ("a", long, 1), ("b", "curto", 2), ("c", "", 3), ("d", None, 4), ("e", " \n\t ", 5), ("f", "y" * 100_000, 6), (None, long, 7)]
    df = spark.createDataFrame(rows, "doc_id string, content string, piece_no int")
    out = split_documents(df, 400, 40)
    assert {r.doc_id for r in oversized(out).collect()} == {"a", None}
    assert sorted((r.doc_id or "", r.piece_no, r.n_pieces) for r in out.collect()) == sorted([("a", 1, 2), ("a", 2, 2)] * 2 + [("", 1, 2), ("", 2, 2), ("b", 1, 1), ("f", 1, 1)])
    assert split_documents(df.limit(0)).count() == 0


def test_whole_texts_of_the_data(spark, data):
    df = spark.read.parquet(f"{data}/store_documents.parquet")
    found = {r.doc_id for r in oversized(split_documents(df, 400, 40, with_text=False)).collect()}
    assert found == {r.doc_id for r in df.select("doc_id", "content").collect() if len(re.findall(r"[^ \t\n\r\f]+", r.content)) > 400}
