import numpy as np
from pyspark.sql import functions as F

from kindred.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_recall_scores_and_order(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)], SCHEMA)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, sample=1000).collect()
    exact = brute(ids, x.astype(float), 20)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert abs(r["score"] - float(x[r["query_id"]].astype(float) @ x[r["vec_id"]].astype(float))) < 1e-12
    assert found.keys() == exact.keys() and all(len(v) == 20 for v in found.values())
    assert np.mean([len(set(found[q]) & set(exact[q])) / 20 for q in exact]) >= 0.9


def test_all_is_exact_when_every_leaf_is_seen(spark):
    """Copies, ties and small cells: with all leaves searched the result is that of brute force."""
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (600, 6)).astype(np.float32)
    x[(x == 0).all(axis=1)] = 1
    x[300:420] = x[7]
    ids = rng.permutation(600)
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)], SCHEMA)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, share=1000.0, sample=200, leaf=8, trees=4).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == brute(ids, x.astype(float), 20)


def test_hard_rows(spark, clashing):
    rows = [
        (0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [0.0, 0.0], 0), (3, None, 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0), (6, [None, 1.0], 0),
        (7, [1.0, 2.0, 3.0], 0), (None, [1.0, 1.0], 0), (8, [1.0, 0.0], None), (8, [1.0, 0.0], None), (20, [], 0), (40, [-1.0, 0.0], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in [*clashing, "id", "v", "tree", "cell", "rank"]})
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(v) for q, v in got.items()} == {0: [(1, 8, 1.0), (2, 1, 0.5), (3, 40, -1.0)], 40: [(1, 1, -0.5), (2, 0, -1.0), (3, 8, -1.0)]}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(spark.createDataFrame(rows[:1], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_ids_hide_no_others(spark):
    """Rows of one id with one vector, and with near vectors: the other ids stay candidates."""
    rows = [(0, [1.0, 0.0], 0), *[(1, [0.9, 0.0], 0)] * 30, *((i, [0.9, 0.0], 0) for i in (2, 3)), *((4, [0.8, i / 100], 0) for i in range(30)), (5, [0.1, 0.0], 0), (6, [0.2, 0.0], 0)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, k=5).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3, 4, 6]


def test_every_query_has_k_neighbours_where_there_are_so_many(spark):
    """Forty rows of most ids: against brute force with the best row of each id, all leaves seen; and k ids in any case."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1600, 8)).astype(np.float32)
    ids = np.arange(1600) // 40
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)], SCHEMA)
    best = {}
    s = x.astype(float) @ x.astype(float).T
    for q in (0, 20):
        mine = s[ids == q].max(axis=0)
        score = {int(i): float(mine[ids == i].max()) for i in set(ids.tolist()) - {q}}
        best[q] = sorted(score, key=lambda i: (-score[i], i))
    for share, k in ((1000.0, 10), (0.05, 30), (0.05, 39), (0.05, 60)):
        found = {}
        for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=k, share=share).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert all(len(set(v)) == min(k, 39) for v in found.values()) and found.keys() == best.keys()
        if share > 1:
            assert found == {q: v[:k] for q, v in best.items()}


def test_best_of_a_cell_is_kept_while_rows_go_by(monkeypatch):
    """However often a task lets go of what it has gathered, it ends with the best of all rows."""
    rng = np.random.default_rng(5)
    x, ids, leaf = rng.integers(-3, 4, (500, 5)).astype(np.float32), rng.integers(0, 300, 500), rng.integers(0, 6, 500).astype(np.int32)
    q = rng.integers(-3, 4, (40, 5)).astype(np.float32)
    wants = [np.sort(rng.choice(6, rng.integers(1, 6), replace=False)).astype(np.int32) for _ in range(40)]
    expected = {}
    for i in range(40):
        seen = np.isin(leaf, wants[i]) & (ids != i)
        best = {}
        for j in np.flatnonzero(seen):
            best[int(ids[j])] = max(best.get(int(ids[j]), -1e9), float(q[i].astype(float) @ x[j].astype(float)))
        expected[i] = sorted(best, key=lambda o: (-best[o], o))[:7]
    for limit in (1, 50, 1_000_000):
        monkeypatch.setattr(ann, "GATHERED", limit)
        cell = ann.Cell([(i, q[i].tobytes(), wants[i].tobytes()) for i in range(40)], np.float32, 7)
        for at in range(0, 500, 64):
            cell.see(ids[at : at + 64].astype(np.int64), x[at : at + 64].astype(float), leaf[at : at + 64])
        found = {}
        for r in cell.result().to_pylist():
            found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert {i: found.get(i, []) for i in range(40)} == expected
