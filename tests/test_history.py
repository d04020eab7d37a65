import random
from datetime import date, datetime

from pyspark.sql import functions as F

from corpusloom.operators.history import HistoryStore, build_chains, daily_changes, history_rows, state_history
from corpusloom.runtime import scratch_path

SCHEMA = "snapshot_id bigint, snapshot_date date, ingested_at timestamp, canonical_id string, version_year string, is_latest int, effective_date string, status string, bucket string, key string"


def brute(rows):
    """Periods by the definition, row by row."""
    best = {}
    for i, day, at, key, year, latest, eff, status, *_ in rows:
        k = (key or "").strip().lower()
        if not k or latest != 1 or day is None:
            continue
        rank = (year is not None, year or "", at is not None, at or datetime.min, i)
        if (k, day) not in best or rank > best[k, day][0]:
            best[k, day] = (rank, (year, eff, status))
    out = set()
    for k in {k for k, _ in best}:
        days, runs = sorted(d for kk, d in best if kk == k), []
        for d in days:
            if not runs or runs[-1][1] != best[k, d][1]:
                runs.append((d, best[k, d][1]))
        for (d, s), nxt in zip(runs, [*(d for d, _ in runs[1:]), date(9999, 12, 31)]):
            out.add((k, d.isoformat(), nxt.isoformat(), *s))
    return out


def rows_of(store):
    return {(r.canonical_id, r.valid_from, r.valid_to, r.version_year, r.effective_date, r.status) for r in history_rows(store).collect()}


def sample(n, seed):
    rng = random.Random(seed)
    keys = ["a_1", " A_1", "b_2", None, " ", "hot", "hot", "hot"]
    return [
        (i, rng.choice([date(2024, 1, d) for d in range(1, 12)] + [None]), rng.choice([datetime(2024, 2, 1, h) for h in range(20)] + [None]), rng.choice(keys),
         rng.choice(["2020", "2021", None]), rng.choice([1, 1, 1, 0, None]), rng.choice(["2020-01-01", "2021-01-01", None]), rng.choice(["active", "revoked", None]), "x", "y")
        for i in range(n)
    ]


def test_periods_against_brute_force(spark):
    rows = sample(300, 1)
    df = spark.createDataFrame(rows + rows[:40], SCHEMA)  # repeated rows, extra columns with clashing names
    assert rows_of(HistoryStore(spark, scratch_path(spark, "h"), 4).apply(df)) == brute(rows)


def test_batches_in_any_order_give_the_same_history(spark):
    rows = sample(200, 2)
    random.Random(3).shuffle(rows)
    store = HistoryStore(spark, scratch_path(spark, "h"), 3)
    for part in (rows[:120], rows[120:150], [], rows[150:]):
        store.apply(spark.createDataFrame(part, SCHEMA))
    assert rows_of(store) == brute(rows)
    assert rows_of(state_history(spark.createDataFrame(rows, SCHEMA), scratch_path(spark, "h"), late_days=0, buckets=2)) == brute(rows)


def one_per_key(n):
    return [(i, date(2024, 1, 1), datetime(2024, 1, 1), f"k{i}", "2020", 1, "e", "active", "", "") for i in range(n)]


def test_a_batch_writes_the_rows_of_its_keys_only(spark):
    store = HistoryStore(spark, scratch_path(spark, "h"), 16).apply(spark.createDataFrame(one_per_key(900), SCHEMA))
    before = store.manifest()
    late = [(1000 + i, date(2023, 12, 1), datetime(2024, 3, 1), f"k{i * 7}", "2020", 1, "e", "draft", "", "") for i in range(34)]
    store.apply(spark.createDataFrame(late, SCHEMA))
    after = store.manifest()
    assert after["generations"][:-1] == before["generations"] and after["version"] == before["version"] + 1
    written = spark.read.parquet(f"{store.path}/history-{after['generations'][-1]}")
    assert {r[0] for r in written.select("key").collect()} == {f"k{i * 7}" for i in range(34)} and written.count() == 68
    assert spark.read.parquet(f"{store.path}/log-{after['generations'][-1]}").count() == 34
    assert {r[1:3] for r in rows_of(store) if r[0] == "k7"} == {("2023-12-01", "2024-01-01"), ("2024-01-01", "9999-12-31")}
    assert len(rows_of(store)) == 934


def test_two_writers_at_once_lose_nothing(spark):
    rows = sample(240, 7)
    parts = [spark.createDataFrame(x, SCHEMA) for x in (rows[:80], rows[80:160], rows[160:])]
    for first in (True, False):
        path = scratch_path(spark, "h")
        store, other = HistoryStore(spark, path, 2), HistoryStore(spark, path, 2)
        todo = [*parts]
        if not first:
            store.apply(todo.pop(0))
        publish, done = store._publish, []

        def late(manifest, publish=publish, done=done, other=other, todo=todo):
            if not done:
                done.append(True)
                other.apply(todo[1])
            publish(manifest)

        store._publish = late
        store.apply(todo[0])
        for x in todo[2:]:
            store.apply(x)
        assert rows_of(store) == rows_of(other) == brute(rows)
        assert len(store.manifest()["generations"]) == 3


def test_compaction_and_vacuum(spark):
    rows = sample(200, 8)
    store = HistoryStore(spark, scratch_path(spark, "h"), 3)
    for k in range(0, 200, 50):
        store.apply(spark.createDataFrame(rows[k : k + 50], SCHEMA))
    store.compact().vacuum()
    assert len(store.manifest()["generations"]) == 1 and rows_of(store) == brute(rows)
    assert len([n for n in store._names() if not n.startswith(".")]) == 3
    late = [(999, date(2023, 1, 1), datetime(2024, 3, 1), "hot", "2020", 1, "e", "draft", "", "")]
    assert rows_of(store.apply(spark.createDataFrame(late, SCHEMA))) == brute(rows + late)


def test_buckets_and_tasks_follow_the_size(spark, monkeypatch):
    from corpusloom.operators import history as module

    monkeypatch.setattr(module, "FILE_ROWS", 40)
    monkeypatch.setattr(module, "MOST_BUCKETS", 5)
    store = HistoryStore(spark, scratch_path(spark, "h")).apply(spark.createDataFrame(one_per_key(400), SCHEMA))
    assert store.manifest()["buckets"] == 5 and len(rows_of(store)) == 400
    files = spark.read.parquet(f"{store.path}/log-{store.manifest()['generations'][0]}").inputFiles()
    assert len(files) > 5


def test_a_reader_sees_the_old_state_until_the_switch(spark):
    store = HistoryStore(spark, scratch_path(spark, "h"), 2).apply(spark.createDataFrame(sample(50, 4), SCHEMA))
    old = store.history()
    n = old.count()
    store.apply(spark.createDataFrame(sample(50, 5), SCHEMA))
    assert old.count() == n


def test_empty_table(spark):
    assert rows_of(state_history(spark.createDataFrame([], SCHEMA), scratch_path(spark, "h"))) == set()
    assert build_chains(daily_changes(spark.createDataFrame([], SCHEMA))).count() == 0
