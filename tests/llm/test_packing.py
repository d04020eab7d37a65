import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import packing
from corpusloom.llm.packing import containers, pack, plan_containers


def best_fit_decreasing(histogram, capacity):
    """Number of containers when items are placed one by one, longest first, each in the fullest container that it fits."""
    free = []
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        fitting = [f for f in free if f >= length]
        if fitting:
            free.remove(min(fitting))
            free.append(min(fitting) - length)
        else:
            free.append(capacity - length)
    return len(free)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 60), min_size=1))
def test_plan_places_every_rank_once(histogram):
    segments, opened = plan_containers(histogram, 20)
    ranks, filled = defaultdict(list), Counter()
    for length, first, last, container, each in segments:
        for r in range(first, last + 1):
            ranks[length].append(r)
            filled[container + (r - first) // each] += length
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    assert set(filled) == set(range(opened)) and max(filled.values()) <= 20
    assert opened == best_fit_decreasing(histogram, 20)


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([1, 5, 10, 10, 10, 33, 70, 250])))) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (2002, "  \n"), (2003, "a, b."), (5, "x x x"), (5, "x x x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS length", "'k' AS key", "2 AS rank")
    out = pack(df, 100).collect()
    parts = defaultdict(list)
    for r in out:
        parts[r.doc_id, r.part_no].append(r.length)
    assert sum(r.length for r in out) == sum(len(t.split()) for _, t in rows[:1500]) + 4 + 6  # "a, b." has four tokens
    per = Counter()
    for r in out:
        per[r.container_id] += r.length
    assert max(per.values()) <= 100 and set(per) == set(range(len(per)))
    assert len(per) <= 1.02 * -(-sum(per.values()) // 100) + 1
    assert all(r.n_parts == 1 for r in out if r.n_tokens <= 100) and all(r.n_parts == -(-r.n_tokens // 100) for r in out)
    assert containers(pack(df, 100), 100).agg({"unused": "min"}).first()[0] >= 0
    assert pack(df.limit(0), 100).count() == 0


def test_hot_length_in_slices(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    df = spark.range(0, 1000).selectExpr("id AS doc_id", "'a b c' AS text")
    per = Counter(r.container_id for r in pack(df, 10).collect())
    assert sum(per.values()) == 1000 and max(per.values()) == 3 and len(per) == 334
