import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark import constants as C
from tidemark.operators import cases, risk, set_join
from tidemark.plans.weekly_run import in_window

BASE = "employee STRING, week INT, origin STRING, base_score INT, base_class STRING, base_rationale STRING"
STORED = BASE + ", stored BOOLEAN, stored_streak INT, in_history BOOLEAN"


def label(score):
    return "Silent Exit" if score >= 8 else "At Risk" if score >= 6 else "Watch" if score >= 4 else "Healthy"


def fold(spark, steps, schema=BASE, **options):
    return risk.fold_scores(spark.createDataFrame(steps, schema), **options)


@pytest.mark.parametrize("score", range(0, 11))
def test_classes(spark, score):
    frame = spark.range(1).select(risk.classify(F.lit(score)).alias("c"), risk.badge(risk.classify(F.lit(score))).alias("b"))
    assert frame.first() == (label(score), f"[{label(score).upper()}]")


def test_worked_history(spark):
    steps = [("a", i + 1, "model", s, label(s), "r") for i, s in enumerate([6, 6, 5, 2, 2, 2, 2, 5])]
    got = fold(spark, steps).orderBy("week").collect()
    assert [r.score for r in got] == [6, 6, 6, 3, 3, 3, 2, 5]
    assert [r.healthy_streak for r in got] == [0, 0, 0, 1, 2, 4, 7, 0]
    assert [r.week for r in got if r.bonus] == [3, 4, 5, 6]
    assert got[2].rationale == "r [Recurrence adjustment applied: score increased from 5 to 6.]"
    true = fold(spark, steps, streak_mode="true_count").orderBy("week").collect()
    assert [r.healthy_streak for r in true] == [0, 0, 0, 1, 2, 3, 4, 0]
    assert [r.week for r in true if r.bonus] == [3, 4, 5, 6, 7]


# Stored history (score, class, streak) -> bonus and streak seen by the next week.
HISTORIES = [
    ([(6, "At Risk", 0), (7, "At Risk", 0)], True, 0),
    ([(6, "At Risk", 0), (7, "At Risk", 0), (2, "Healthy", 1), (2, "Healthy", 2), (2, "Healthy", 3), (2, "Healthy", 4)], False, 7),
    ([(6, "At Risk", 0)], False, 0),
    ([], False, 0),
    ([(2, "Healthy", 3), (6, "At Risk", 0)], False, 0),
    ([(6, " at risk ", 0), (7, "WATCH", 0), (1, "healthy", 0)], True, 1),
    ([(6, "At Risk", 0), (7, "Unclear", 0)], False, 0),
]


@pytest.mark.parametrize("history, bonus, streak", HISTORIES)
def test_stored_histories(spark, history, bonus, streak):
    steps = [("a", i + 1, "model", s, c, "r", True, k, True) for i, (s, c, k) in enumerate(history)]
    steps.append(("a", len(history) + 1, "model", 5, "Watch", "r", False, None, None))
    new = fold(spark, steps, STORED).filter(~F.col("stored")).first()
    assert (new.bonus, new.prior_streak) == (bonus, streak)
    kept = fold(spark, steps, STORED).filter("stored").orderBy("week").collect()
    assert [(r.score, r.classification, r.healthy_streak) for r in kept] == history


def test_history_outside_the_window_does_not_count(spark):
    steps = [("a", w, "model", 7, "At Risk", "r", True, 0, w > 1) for w in (1, 2)]
    steps.append(("a", 3, "model", 5, "Watch", "r", False, None, None))
    assert not fold(spark, steps, STORED).filter(~F.col("stored")).first().bonus


def test_cap_fallback_and_label_conflict(spark):
    steps = [("a", 1, "model", 10, "Silent Exit", "r"), ("a", 2, "case", 9, "Silent Exit", "r"),
             ("a", 3, "model", 10, "Silent Exit", "r"), ("a", 4, "default", 2, "Healthy", "r"), ("b", 1, "model", 9, "Healthy", "r")]
    got = {(r.employee, r.week): r for r in fold(spark, steps).collect()}
    assert got["a", 3].score == 10 and got["a", 3].bonus
    assert (got["a", 4].bonus, got["a", 4].healthy_streak) == (False, 0)
    assert got["b", 1].label_conflict and got["b", 1].classification == "Healthy"


def week_loop(steps):
    """One employee, week by week, walking back over the history each time."""
    history, out = [], []
    for score, cls, origin in steps:
        streak = 0
        for c, stored in reversed(history):
            if c.strip().upper() != "HEALTHY":
                break
            streak = max(streak + 1, stored)
        elevated = sum(c.strip().upper() in ("WATCH", "AT RISK", "SILENT EXIT") for c, _ in history)
        bonus = origin == "model" and streak < 4 and elevated >= 2
        if bonus:
            score = min(score + 1, 10)
            cls = label(score)
        new = streak + 1 if origin == "model" and cls.strip().upper() == "HEALTHY" else 0
        history.append((cls, new))
        out.append((score, cls, new))
    return out


def test_random_histories(spark):
    rnd = random.Random(3)
    people = {}
    for p in range(300):
        scores = [rnd.choice([1, 2, 2, 3, 3, 4, 6, 9, 10]) for _ in range(rnd.randint(1, 14))]
        people[f"p{p}"] = [
            (s, label(s) if rnd.random() < 0.8 else rnd.choice(["Healthy", "healthy ", "At Risk", "odd"]),
             rnd.choice(["model", "model", "model", "case"])) for s in scores
        ]
    steps = [(p, i + 1, o, s, c, "r") for p, h in people.items() for i, (s, c, o) in enumerate(h)]
    got = {}
    for r in fold(spark, steps).orderBy("week").collect():
        got.setdefault(r.employee, []).append((r.score, r.classification, r.healthy_streak))
    assert got == {p: week_loop(h) for p, h in people.items()}


def test_parsed_answers(spark):
    texts = [
        ('{"score": "5", "classification": "Watch", "rationale": "x"}', (True, 5, "Watch")),
        ('```json\n{"score": 7, "classification": "At Risk"}\n```', (True, 7, "At Risk")),
        ('{"classification": "Watch"}', (True, 1, "Watch")), ('{"score": "high"}', (False, None, "")),
        ("not json", (False, None, None)), ("", (False, None, None)), ('Here: {"score": 5}', (False, None, None)),
        ("[1, 2]", (False, None, None)), ('{"score": 5', (False, None, None)),
        ('{"score": 5} done', (False, None, None)), ('{"score": 5}, {"score": 6}', (False, None, None)),
        ("{'score': 5}", (False, None, None)), ("null", (False, None, None)), ("{}", (True, 1, "")),
        ('{"score": {"a": 1}}', (False, None, None)), ('{"score": 5, "more": [1]}', (True, 5, "")),
    ]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i INT, t STRING")
    got = {r.i: r.answer for r in risk.with_risk_answer(frame, "t").collect()}
    for i, (text, (ok, score, cls)) in enumerate(texts):
        assert (got[i] is not None) == ok, text
        if ok:
            assert (got[i].score, got[i].classification) == (score, cls)


def test_base_scores_and_failures(spark):
    schema = "employee STRING, week INT, risk_text STRING, case_similarity DOUBLE, case_score INT, case_classification STRING, case_rationale STRING"
    frame = spark.createDataFrame(
        [("a", 1, '{"score": 3, "classification": "Healthy", "rationale": "ok"}', 1.0, 8, "Silent Exit", "old"),
         ("b", 1, None, 2 / 3, 8, "Silent Exit", "old"), ("c", 1, "x", None, None, None, None)], schema)
    got = {r.employee: r for r in risk.base_scores(frame).collect()}
    assert (got["a"].origin, got["a"].base_score) == ("model", 3)
    assert (got["b"].origin, got["b"].base_score) == ("case", 8)
    assert got["b"].base_rationale.endswith("66% signal similarity based on historical behavioral patterns. Reference Rationale: old")
    assert (got["c"].origin, got["c"].base_score, got["c"].base_class) == ("default", 4, "Watch")
    assert got["c"].base_rationale == C.DEFAULT_RATIONALE
    failed = spark.createDataFrame([(3, None, None, None, None)], "week INT, score INT, classification STRING, rationale STRING, healthy_streak INT")
    assert risk.default_scores(failed).first()[1:] == (4, "Watch", "Scoring unavailable due to error in week 3.", 0)


def test_history_window(spark):
    as_of = dt.datetime(2024, 3, 25)
    days = [(i, as_of - dt.timedelta(days=i)) for i in (0, 83, 84, 85)]
    frame = spark.createDataFrame(days, "i INT, t TIMESTAMP")
    assert rows(frame.filter(in_window(F.col("t"), as_of)), "i") == [(0,), (83,), (84,)]
    assert rows(frame.filter(in_window(F.col("t"), as_of, 7)), "i") == [(0,)]


def test_nearest_case_against_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = C.SIGNAL_VOCABULARY
    queries = [(i, rnd.sample(vocabulary, rnd.randint(0, 5))) for i in range(80)]
    pool = [(f"e{rnd.randint(0, 9)}", i, rnd.sample(vocabulary + ("x", "y"), rnd.randint(0, 5)), i) for i in range(60)]

    def best(names):
        ranked = []
        for who, week, other, score in pool:
            union = set(names) | set(other)
            sim = len(set(names) & set(other)) / len(union) if union else 1.0
            if sim >= 0.5:
                ranked.append(((-sim, who, week), (sim, score)))
        return min(ranked)[1] if ranked else (None, None)

    q = spark.createDataFrame(queries, "id INT, names ARRAY<STRING>")
    p = spark.createDataFrame(pool, "employee STRING, week INT, names ARRAY<STRING>, score INT")
    searches = [cases.Search("all_", F.lit(True), ("score",)), cases.Search("odd_", F.col("score") % 2 == 1, ("score",))]
    found = cases.nearest_cases(q, p, searches).collect()
    assert {r.id: (r.all_similarity, r.all_score) for r in found} == {i: best(n) for i, n in queries}
    pool[:] = [r for r in pool if r[3] % 2 == 1]
    assert {r.id: (r.odd_similarity, r.odd_score) for r in found} == {i: best(n) for i, n in queries}
    none = cases.nearest_cases(q, p.limit(0), searches)
    assert none.filter("all_score IS NOT NULL").count() == 0 and none.count() == 80


@pytest.mark.parametrize("floor, limit", [(0.25, 0), (0.25, 10**6), (0.5, 10**6), (0.7, 0), (1.0, 10**6)])
def test_nearest_case_over_any_vocabulary(spark, floor, limit, monkeypatch):
    monkeypatch.setattr(set_join, "MAX_BROADCAST", limit)
    rnd = random.Random(7)
    vocabulary = [f"name{i}" for i in range(3000)]
    weights = [1 / (1 + i) for i in range(3000)]
    base = [rnd.choices(vocabulary, weights, k=rnd.randint(0, 40)) for _ in range(40)]

    def near(names):
        return [n for n in names if rnd.random() > 0.15] + rnd.choices(vocabulary, weights, k=rnd.randint(0, 3))

    queries = [(i, near(rnd.choice(base))) for i in range(120)] + [(900, []), (901, None), (902, base[3] * 3)]
    pool = [(f"e{rnd.randint(0, 9)}", i, near(rnd.choice(base)), i) for i in range(150)]
    pool += [("e5", 500 + i, base[3], i) for i in range(40)] + [("e1", 600, [], 1), ("e0", 601, None, 2), (None, 602, ["q", None], 3)]

    def best(names, odd):
        ranked = []
        for who, week, other, score in pool:
            if odd and score % 2 == 0:
                continue
            a, b = set(names or ()) - {None}, set(other or ()) - {None}
            sim = len(a & b) / len(a | b) if a | b else 1.0
            if sim >= floor:
                ranked.append(((-sim, who or "", week), (sim, score)))
        return min(ranked)[1] if ranked else (None, None)

    q = spark.createDataFrame(queries, "id INT, names ARRAY<STRING>")
    p = spark.createDataFrame(pool, "employee STRING, week INT, names ARRAY<STRING>, score INT")
    searches = [cases.Search("all_", F.lit(True), ("score",)), cases.Search("odd_", F.col("score") % 2 == 1, ("score",))]
    found = {r.id: r for r in cases.nearest_cases(q, p, searches, vocabulary=None, floor=floor).collect()}
    assert len(found) == len(queries)
    for i, names in queries:
        assert (found[i].all_similarity, found[i].all_score) == best(names, False)
        assert (found[i].odd_similarity, found[i].odd_score) == best(names, True)
    none = cases.nearest_cases(q, p.limit(0), searches, vocabulary=vocabulary, floor=floor)
    assert none.filter("all_score IS NOT NULL").count() == 0 and none.count() == len(queries)
    with pytest.raises(ValueError):
        cases.nearest_cases(q, p, searches, vocabulary=None, floor=0.0)


def test_only_pairs_that_are_alike_are_kept(spark, tmp_path, monkeypatch):
    """Sets that share a rare name and little else are counted out; nothing of theirs is stored or sent."""
    shared = [f"common{i}" for i in range(20)]
    queries = [(i, [f"rare{i % 3}", *shared[:8], *[f"q{i}-{k}" for k in range(30)]]) for i in range(20)]
    pool = [("e", i, [f"rare{i % 3}", *shared[8:16], *[f"p{i}-{k}" for k in range(30)]], i) for i in range(200)]
    pool.append(("e", 900, queries[4][1][:-3], 900))
    q = spark.createDataFrame(queries, "id INT, names ARRAY<STRING>")
    p = spark.createDataFrame(pool, "employee STRING, week INT, names ARRAY<STRING>, score INT")
    monkeypatch.setattr(set_join, "scratch_dir", lambda _, label: str(tmp_path / label))
    found = {r.id: r.all_score for r in cases.nearest_cases(q, p, [cases.Search("all_", F.lit(True), ("score",))], vocabulary=None).collect()}
    assert found == {i: 900 if i == 4 else None for i in range(20)}
    pairs = [f for f in map(spark.read.parquet, map(str, tmp_path.iterdir())) if {"l", "r"} <= set(f.columns)]
    assert [f.count() for f in pairs] == [1]


def test_pairs_kept_do_not_grow_with_the_pool(spark, tmp_path, monkeypatch):
    """A task keeps the nearest sets it has seen for any question, in one part of the query sets or in many."""
    monkeypatch.setattr(set_join, "_LEAST_BROADCAST", 40, raising=False)
    asked = [[f"q{i}-{k}" for k in range(20)] for i in range(10)] + [[]]
    pool = [("e", 1000 * i + k, names + [f"p{i}-{k}-{j}" for j in range(k // 25)], k) for i, names in enumerate(asked) for k in range(25, 325)]
    q = spark.createDataFrame(list(enumerate(asked)), "id INT, names ARRAY<STRING>")
    p = spark.createDataFrame(pool, "employee STRING, week INT, names ARRAY<STRING>, score INT").coalesce(1)
    searches = [cases.Search("all_", F.lit(True), ("score",)), cases.Search("far_", F.col("score") >= 200, ("score",)), cases.Search("no_", F.lit(False), ("score",))]
    for limit in (10**6, 40):
        monkeypatch.setattr(set_join, "MAX_BROADCAST", limit)
        monkeypatch.setattr(set_join, "scratch_dir", lambda _, label: str(tmp_path / f"{limit}" / label))
        found = cases.nearest_cases(q, p, searches, vocabulary=None).collect()
        assert {r.id: (r.all_score, r.far_score, r.no_score) for r in found} == {i: (25, 200, None) if i < 10 else (None, None, None) for i in range(11)}
        assert {r.all_similarity for r in found if r.id < 10} == {20 / 21} and {r.far_similarity for r in found if r.id < 10} == {20 / 28}
        pairs = [f for f in map(spark.read.parquet, map(str, (tmp_path / f"{limit}").iterdir())) if {"l", "r"} <= set(f.columns)]
        assert [f.count() for f in pairs] == [10 * 50]


@pytest.mark.parametrize("mode, weeks", [("stored", 30_000), ("true_count", 3_000)])
def test_many_weeks_of_one_employee(spark, mode, weeks):
    rnd = random.Random(11)
    steps = []
    for week in range(1, weeks + 1):
        score = rnd.choice([1, 2, 3, 3, 5, 7, 9]) if week % 1000 < 800 else 2
        steps.append(("a", week, rnd.choice(["model", "model", "case"]), score, label(score), "r", rnd.random() < 0.2, rnd.randint(0, 3), rnd.random() < 0.9))
    elevated = streak = run = 0
    want = []
    for _, week, origin, score, name, _, stored, stored_streak, seen in steps:
        new = not stored and origin == "model"
        bonus = new and streak < C.HEALTHY_WEEKS_TO_CLEAR and elevated >= C.ELEVATED_WEEKS_FOR_BONUS
        score, name = (min(score + 1, 10), label(min(score + 1, 10))) if bonus else (score, name)
        healthy = name == "Healthy"
        own = stored_streak if stored else streak + 1 if new and healthy else 0
        want.append((week, score, name, own, bonus, elevated, streak))
        if seen:
            elevated += name != "Healthy" and name in ("At Risk", "Silent Exit", "Watch") and name.upper() in C.ELEVATED_CLASSES
            grown = run + 1 if mode == "true_count" else max(streak, own + run, run + 1)
            streak, run = (min(grown, risk.MAX_STREAK), run + 1) if healthy else (0, 0)
    frame = spark.createDataFrame(steps, STORED)
    got = risk.fold_scores(frame, streak_mode=mode).orderBy("week").select(
        "week", "score", "classification", "healthy_streak", "bonus", "prior_elevated", "prior_streak").collect()
    assert [tuple(r) for r in got] == want


def test_pools(spark):
    frame = spark.createDataFrame(
        [("model", "text"), ("case", None), ("default", ""), ("model", "x " + C.SAFE_BRIEFING)], "origin STRING, briefing STRING")
    assert frame.filter(cases.case_search().eligible).count() == 2
    assert rows(frame.filter(cases.briefing_search().eligible), "briefing") == [("text",)]
