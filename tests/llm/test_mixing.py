import math
import random
from collections import Counter

from kindred.llm import mixing

from .conftest import DOCS, sentence, untouched, with_clashes


def docs(rng, counts):
    rows, i = [], 0
    for source, n in counts.items():
        for _ in range(n):
            rows.append((i, sentence(rng, rng.randint(1, 40)), "en", source, 0))
            i += 1
    return rows


def test_entropy_target_and_repetition_limit():
    tokens = {"a": 1_000_000, "b": 10_000, "c": 100}
    x, w = mixing.solve(tokens, 1_010_100, 0.9, 1e9)
    assert abs(mixing.entropy(w) - 0.9 * math.log(3)) < 1e-9 and 0 < x < 1
    x2, w2 = mixing.solve(tokens, 1_010_100, 0.9, 4.0)
    assert x2 > x and max(1_010_100 * w2[s] / tokens[s] for s in tokens) <= 4.0 + 1e-6
    assert mixing.solve(tokens, 1_010_100, 0.0, 4.0)[0] == 1.0
    assert mixing.solve({"a": 5}, 10, 0.9, 4.0)[1] == {"a": 1.0}
    assert mixing.solve({"a": 0}, 10, 0.9, 4.0) == (1.0, {})


def test_budgets_are_met_by_prefixes(spark):
    rows = docs(random.Random(1), {"big": 400, "mid": 100, "small": 20})
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.plan(df, target_entropy=0.95, block_tokens=200).collect()
    n = {r[0]: len(r[1].split()) for r in rows}
    tokens = {s: sum(n[r[0]] for r in rows if r[3] == s) for s in ("big", "mid", "small")}
    total = sum(tokens.values())
    _, w = mixing.solve(tokens, total, 0.95, mixing.MAX_EPOCHS)
    for s in tokens:
        mine = sorted((r for r in got if r["source"] == s), key=lambda r: r["start"])
        at = 0
        for r in mine:  # the stream has no gap and no overlap, and documents repeat only after a whole epoch
            assert r["start"] == at and r["n_tokens"] == n[r["doc_id"]]
            at += r["n_tokens"]
        budget = math.floor(total * w[s])
        assert budget <= at < budget + 41
        for e in {r["epoch"] for r in mine}:
            ids = [r["doc_id"] for r in mine if r["epoch"] == e]
            assert len(ids) == len(set(ids))
            assert e == max(r["epoch"] for r in mine) or len(ids) == sum(r[3] == s for r in rows)
    first = [r["doc_id"] for r in sorted((r for r in got if r["source"] == "small" and r["epoch"] == 0), key=lambda r: r["start"])]
    assert first != sorted(first)


def test_mix_repeats_rows_as_planned(spark):
    rows = docs(random.Random(2), {"big": 200, "small": 10}) + [(1000, "x y z", "en", "small", 0), (1000, "x y z", "en", "small", 0)]
    df = spark.createDataFrame(rows, DOCS)
    taken = mixing.plan(df, target_entropy=0.99, block_tokens=100).groupBy("doc_id").count()
    mixed = mixing.mix(df, target_entropy=0.99, block_tokens=100)
    assert mixed.columns == df.columns
    assert {r[0]: r[1] for r in taken.collect()} == {r[0]: r[1] for r in mixed.groupBy("doc_id").count().collect()}


def test_hard_rows(spark, hard_docs, clashing):
    rows = hard_docs + [(None, "x y", None, "s", 0)] * 3 + [(77, "p q r", "en", "t", 0)] * 5
    df = with_clashes(spark.createDataFrame(rows, DOCS), clashing)
    plan = mixing.plan(df).collect()
    assert {r["source"] for r in plan} <= {"", "s", "t", "u"} and len(plan) > 0
    mixed = mixing.mix(df)
    found = mixed.collect()
    assert mixed.columns == df.columns and untouched(found, clashing)
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in plan)


def test_alike_rows_are_rows_of_their_own(spark):
    """Copies stand one after the other, each counted, and a budget may end between them."""
    rows = [(1, "a b c", "en", "s", 0)] * 7 + [(2, "d e", "en", "s", 0)] * 2 + [(3, None, "en", "s", 0)] * 2 + [(None, "f g", "en", "s", 0)] * 2
    df = spark.createDataFrame(rows, DOCS)
    for budget in (1, 13, 29, 30, 62):
        got = sorted(mixing.plan(df, budget_tokens=budget).collect(), key=lambda r: (r["start"], r["start"] + r["n_tokens"]))
        ends = [r["start"] + r["n_tokens"] for r in got]
        assert [r["start"] for r in got] == [0, *ends[:-1]] and all(r["start"] < budget for r in got) and ends[-1] >= budget
        assert Counter(r["doc_id"] for r in mixing.mix(df, budget_tokens=budget).collect()) == Counter(r["doc_id"] for r in got)
        copies = Counter((r["doc_id"], r["copy"], r["epoch"]) for r in got)
        assert set(copies.values()) == {1}


def test_exponent_from_a_table_of_sources(spark, monkeypatch):
    rng = random.Random(8)
    tokens = {f"s{i}": int(10 ** rng.uniform(0, 6)) for i in range(300)}
    total = sum(tokens.values())
    sums = spark.createDataFrame(list(tokens.items()), "source string, tokens long")
    for budget, entropy, epochs in ((total, 0.8, 1e9), (total, 0.9, 3.0), (total, 0.0, 4.0), (5 * total, 0.9, 4.0)):
        x, weights = mixing.solve(tokens, budget, entropy, epochs)
        y, norm = mixing.solve_table(sums, total, budget, entropy, epochs)
        assert abs(x - y) < 1e-9 and all(abs((n / total) ** y / norm - weights[s]) < 1e-9 for s, n in tokens.items())
    df = spark.createDataFrame(docs(rng, {"a": 60, "b": 10, "c": 3}), DOCS)
    held = sorted(map(tuple, mixing.plan(df, block_tokens=100).collect()))
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    assert sorted(map(tuple, mixing.plan(df, block_tokens=100).collect())) == held


def test_empty_tables(spark):
    assert mixing.plan(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.plan(spark.createDataFrame([(1, None, None, "s", 0)], DOCS)).count() == 0
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
