import random
from collections import Counter, defaultdict

import pandas as pd

from kindred.llm import packing

from .conftest import DOCS, sentence, with_clashes


def test_search_goes_on_to_the_tightest_compatible_bin():
    bins = packing.Bins(10)
    assert [bins.place(6, "a", None), bins.place(7, "b", "x"), bins.place(8, "c", None)] == [0, 1, 2]
    assert bins.place(2, "d", None) == 2  # tightest
    assert bins.place(3, "b", None) == 0  # bin 1 is tighter, but has a source b
    assert bins.place(3, "e", "x") == 3  # bin 1 has cluster x, bin 0 has one token left
    assert bins.place(3, None, None) == 1


def check(rows, out, capacity, per_source=packing.PER_SOURCE):
    """Every token of every document once, no bin over capacity, no conflict in a bin."""
    held = defaultdict(list)
    for r in out:
        held[r["bin"]].append(r)
    text = {r[0]: " ".join((r[1] or "").split()) for r in rows}
    for parts in held.values():
        assert sum(p["n_tokens"] for p in parts) == parts[0]["bin_tokens"] <= capacity
        assert sorted(p["slot"] for p in parts) == list(range(len(parts)))
        texts = [text[p["doc_id"]] for p in parts if text.get(p["doc_id"]) is not None]
        assert len(texts) == len(set(texts))
        assert max(Counter(p["source"] for p in parts).values()) <= per_source


def test_pack_keeps_all_tokens_without_conflicts(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, rng.choice([3, 20, 60, 150])), "en", f"s{i % 12}", 0) for i in range(500)]
    rows += [(1000 + i, "same text in many", "en", f"s{i % 12}", 0) for i in range(60)]
    out = packing.pack(spark.createDataFrame(rows, DOCS), capacity=64, shard_rows=100).collect()
    check(rows, out, 64)
    pieces = defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append((r["first_token"], r["n_tokens"]))
    for i, t, *_ in rows:
        at = 0
        for first, n in sorted(pieces[i]):
            assert first == at
            at += n
        assert at == len(t.split())


def test_sources_share_bins_up_to_the_limit(spark):
    rows = [(i, f"word{i} and more", "en", "hot" if i % 2 else f"s{i}", 0) for i in range(200)]
    for limit in (1, 2, 5):
        out = packing.pack(spark.createDataFrame(rows, DOCS), capacity=30, per_source=limit).collect()
        check(rows, out, 30, limit)
        assert len({r["bin"] for r in out}) == max(20, 100 // limit)


def test_repeated_rows_are_dealt_over_shards(spark):
    rows = [(1, "same words", "en", "s", 0)] * 700 + [(None, "others here", "en", "t", 0)] * 300
    out = packing.pack(spark.createDataFrame(rows, DOCS), capacity=8, shard_rows=128).collect()
    assert sum(r["n_tokens"] for r in out) == 2000 and len(out) == 1000
    sizes = Counter(r["bin"].split("-")[0] for r in out)
    assert max(sizes.values()) < 500
    check([], out, 8)


def test_shard_matches_plain_best_fit():
    """Without conflicts a shard is packed as plain best-fit decreasing does it."""
    rng = random.Random(6)
    sizes = [rng.randint(1, 50) for _ in range(300)]
    frame = pd.DataFrame({"doc_id": range(300), "piece": 0, "first_token": 0, "n_tokens": sizes, "source": None, "cluster": [str(i) for i in range(300)]})
    out = packing.pack_shard(frame, 100)
    left, used = [], 0
    for s in sorted(sizes, reverse=True):
        fit = min((x for x in left if x >= s), default=None)
        if fit is None:
            used += 1
            left.append(100 - s)
        else:
            left[left.index(fit)] -= s
    assert out["b"].nunique() == used


def test_shard_against_a_plain_loop():
    """Under conflicts each piece goes to the fullest bin that has room and no conflict."""
    rng = random.Random(9)
    for trial in range(20):
        n, limit = rng.randint(1, 120), rng.randint(1, 3)
        frame = pd.DataFrame({
            "doc_id": range(n), "piece": 0, "first_token": 0, "n_tokens": [rng.randint(0, 40) for _ in range(n)],
            "source": [f"s{rng.randint(0, 3)}" for _ in range(n)], "cluster": [f"c{rng.randint(0, n // 3)}" for _ in range(n)],
        })
        out = packing.pack_shard(frame, 60, limit)
        bins = []  # each: what is left, sources, clusters, documents
        for r in sorted(frame.itertuples(), key=lambda r: (-r.n_tokens, r.doc_id)):
            fit = [b for b in bins if b[0] >= r.n_tokens and b[1][r.source] < limit and r.cluster not in b[2]]
            at = min(fit, key=lambda b: (b[0], bins.index(b)), default=None)
            if at is None:
                bins.append(at := [60, Counter(), set(), set()])
            at[0] -= r.n_tokens
            at[1][r.source] += 1
            at[2].add(r.cluster)
            at[3].add(r.doc_id)
        assert sorted(map(sorted, (b[3] for b in bins))) == sorted(sorted(g) for g in out.groupby("b")["doc_id"].apply(list)), trial


def test_hard_rows(spark, hard_docs, clashing):
    df = with_clashes(spark.createDataFrame(hard_docs, DOCS), clashing)
    out = packing.pack(df).collect()
    assert sum(r["n_tokens"] for r in out) == sum(len((r[1] or "").split()) for r in hard_docs)
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
    given = spark.createDataFrame([(1, "a", "s", None), (2, "b", None, "c"), (3, "c", "t", "c")], "doc_id long, text string, source string, cluster string")
    bins = {r["doc_id"]: r["bin"] for r in packing.pack(given).collect()}
    assert bins[2] != bins[3]
