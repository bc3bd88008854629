import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kindred.config import Blocking, Learning, Params
from kindred.functions import bulk, similarity
from kindred.functions.text import normalize_records
from kindred.operators import blocking, diagnostics, evaluation, features, sampling, scoring, training, translit
from kindred.plans import catalog

RAW = "entity_id string, business_name string, business_address string, country string, src string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = before + 1 if x == y else max(row[j + 1], row[j])
            before = keep
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def windows(a, b):
    if not a or not b:
        return float(a == b)
    slide = lambda s, w: max(ratio(s, w[max(0, i) : i + len(s)]) for i in range(1 - len(s), len(w)))
    return max(slide(a, b), slide(b, a)) if len(a) == len(b) else slide(*sorted((a, b), key=len))


def words(rng, n, letters="abc"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, n)))


def test_kernel_against_plain_recurrence():
    rng = random.Random(1)
    a = ["".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 130]))) for _ in range(200)]
    b = ["".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 7, 64, 65, 129, 200]))) for _ in range(200)]
    assert bulk.common(a, b).tolist() == [lcs(x, y) for x, y in zip(a, b, strict=True)]
    assert bulk.common([], []).tolist() == []
    p, q = [words(rng, 4) for _ in range(300)], [words(rng, 5) for _ in range(300)]
    assert np.allclose(bulk.partials(p, q), [windows(x, y) for x, y in zip(p, q, strict=True)])
    assert np.allclose(bulk.ratios(["limited", "2204", "131", "405"], ["limitteed", "204", "31", "406"]), [0.875, 0.857143, 0.8, 0.666667], atol=1e-6)


def test_set_ratio_rules():
    got = similarity.set_ratios(["a b", "a b", "", "a b c", "x", "a"], ["b a", "a b c", "a", "a d", "y z", ""])
    assert got[0] == got[1] == 1.0 and got[2] == got[5] == got[4] == 0.0
    assert got[3] == max(ratio("a b c", "a d"), ratio("a", "a b c"), ratio("a", "a d"))


def records(spark):
    rows = [
        ("S1-1", "Best Gymkhana Pvt Ltd", "234/2, 1 Kothapet, Hyderabad", "India", "S1"), ("S2-1", "Best Gymkhana", "234 Kothapet Hyderabad", "India", "S2"),
        ("S3-1", "bestgymkhana.com", "", "India", "S3"), ("S1-2", "Other Name", "5 Long Street", "US", "S1"), ("S2-2", "Best Gymkhana", "234 Kothapet", "US", "S2"), ("S2-3", "", "", "", "S2"),
    ]
    return normalize_records(spark.createDataFrame(rows, RAW)).persist()


def test_keys_of_a_record(spark):
    rows = blocking.record_keys(records(spark).where("entity_id = 'S1-1'")).collect()
    kinds = Counter(r["key"].split("|")[1].split(":")[0] for r in rows)
    assert kinds == {"n": 2, "p": 1, "f": 1, "k": 2, "c": 1, "a": 6, "aa": 3, "w": 1}
    assert {r["key"] for r in rows if "|aa:" in r["key"]} == {"in|aa:1:2", "in|aa:1:234", "in|aa:2:234"}
    assert all((r["family"] == "name") == (r["key"].split("|")[1][0] in "npfkc" and not r["key"].startswith("in|aa")) for r in rows if not r["key"].startswith("in|a"))


def test_candidates_are_scoped_by_country_and_capped(spark):
    pairs = {(r["s1_id"], r["cand_id"]): r for r in blocking.candidates(records(spark)).collect()}
    assert pairs.keys() == {("S1-1", "S2-1"), ("S1-1", "S3-1")}
    many = [("S1-1", "Common Rare", "", "x", "S1")] + [(f"S2-{i}", "Common" + (" Rare" if i < 3 else ""), "", "x", "S2") for i in range(30)]
    df = normalize_records(spark.createDataFrame(many, RAW))
    got = blocking.candidates(df, Blocking(max_block=10)).collect()
    assert sorted(r["cand_id"] for r in got) == ["S2-0", "S2-1", "S2-2"]
    top = blocking.candidates(df, Blocking(top_name=2, top_addr=1, top_total=1)).collect()
    assert sorted(r["cand_id"] for r in top) == ["S2-0", "S2-1"]


def test_features_of_known_pairs(spark):
    rec = records(spark)
    pairs = blocking.candidates(rec)
    got = {r["cand_id"]: r for r in features.pair_features(pairs, features.enrich(rec)).collect()}
    one, site = got["S2-1"], got["S3-1"]
    assert one["name_tsr"] == one["name_sort"] == one["name_ratio"] == one["name_partial"] == one["tok_align"] == 1.0 and one["num_conflict"] == 0
    assert math.isclose(one["num_c1"], 1 / 3) and one["num_c2"] == 1.0 and one["num_reldiff"] == 0.0 and one["num_digitsim"] == 1.0
    assert site["domain"] == 1 and site["dom_contain"] == 1.0 and site["dom_init"] == 0.0 and site["addr_missing"] == 1 and site["num_c1"] == -1 and site["num_reldiff"] == 1
    df = {t: sum(t in r["n_tokens"] for r in rec.collect()) for t in ("best", "gymkhana")}
    assert all(math.isclose(r["idf"], math.log(7) - math.log(1 + df[r["token"]])) for r in features.idf(features.token_frequency(rec), 6).where("token in ('best', 'gymkhana')").collect())
    assert math.isclose(one["name_freq1"], math.log(4)) or math.isclose(one["name_freq1"], math.log(5))


def test_competition_fixture(spark):
    rows = [("A", "S2", "x", 0.9), ("B", "S2", "x", 0.8), ("C", "S2", "x", 0.3), ("A", "S2", "y", 0.6)]
    got = {(r["s1_id"], r["cand_id"]): r for r in scoring.competition(spark.createDataFrame(rows, "s1_id string, src string, cand_id string, p1 double")).collect()}
    order = [("A", "x"), ("B", "x"), ("C", "x"), ("A", "y")]
    assert [got[k]["c_other"] for k in order] == [0.8, 0.9, 0.9, 0.0] and [got[k]["c_n"] for k in order] == [3, 3, 3, 1]
    assert [got[k]["s1_rank"] for k in order] == [1, 1, 1, 2] and [got[k]["s1_n50"] for k in order] == [2, 1, 0, 2]
    assert [round(got[k]["s1_gap"], 9) for k in order] == [0.0, 0.0, 0.0, -0.3]


def test_decide_fixture(spark):
    rows = [("A", "S2", "x", 0.9), ("B", "S2", "x", 0.8), ("A", "S2", "y", 0.6), ("A", "S3", "x3", 0.95), ("B", "S3", "z", 0.56), ("C", "S3", "q", 0.5)]
    df = spark.createDataFrame(rows, "s1_id string, src string, cand_id string, score double")
    kept = scoring.decide(df, Params(MATCH_THRESHOLD=0.55, RELATIVE_MARGIN=0.30))
    ids = spark.createDataFrame([("A",), ("B",), ("C",)], "s1_id string")
    assert {r[0]: r[1] for r in scoring.match_lists(ids, kept).collect()} == {"A": "x3,x", "B": "z", "C": ""}
    assert {r[0]: r[1] for r in scoring.candidate_lists(ids, df).collect()} == {"A": "x,y,x3", "B": "x,z", "C": "q"}


def test_f05_fixture(spark):
    cases = [(set(), set(), 1), ({"a"}, set(), 0), (set(), {"a"}, 0), ({"b"}, {"a"}, 0), ({"a", "b"}, {"a"}, 0.555556), ({"a"}, {"a", "b"}, 0.833333), ({"a"}, {"a"}, 1)]
    ids = spark.createDataFrame([(str(i),) for i in range(len(cases))], "s1_id string")
    edges = lambda k: spark.createDataFrame([(str(i), x) for i, c in enumerate(cases) for x in c[k]], "s1_id string, cand_id string")
    got = evaluation.per_entity(ids, edges(0), edges(1))
    assert {r["s1_id"]: round(r["f05"], 6) for r in got.collect()} == {str(i): c[2] for i, c in enumerate(cases)}
    whole = evaluation.macro(got).first()
    assert math.isclose(whole["macro_f05"], sum(c[2] for c in cases) / 7, abs_tol=1e-6) and whole["singletons"] == 2 and whole["singleton_accuracy"] == 0.5


def test_sampling_against_zlib(spark):
    ids = [f"S1-{i}" for i in range(200)] + ["abc"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r[0]: (r[1], r[2]) for r in df.select("id", sampling.hash_sample(F.col("id"), 20), sampling.fold(F.col("id"))).collect()}
    assert got == {i: (zlib.crc32(f"{i}#sample".encode()) % 20 == 0, zlib.crc32(i.encode()) >> 11 & 1) for i in ids}
    kept = sampling.weighted_subsample(df, F.col("id") == "abc", F.col("id"), 10).collect()
    assert {r["id"]: r["weight"] for r in kept} == {i: 10.0 for i in ids if zlib.crc32(i.encode()) % 10 == 0} | {"abc": 1.0}
    groups = sampling.examples_per_group(df.withColumn("g", F.length("id")), "g", F.col("id"), 2)
    assert Counter(r["g"] for r in groups.collect()) == {4: 2, 5: 2, 6: 2, 3: 1}


def test_validation_finds_every_fault(spark):
    known = spark.createDataFrame([("S1-1", "S1"), ("S1-2", "S1"), ("S2-1", "S2"), ("S3-1", "S3")], "entity_id string, src string")
    rows = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", "S3-1,"), ("X", "S2-1"), ("S1-9", "S2-7")], "s1_id string, ids string")
    got = {r["check"]: r["violations"] for r in evaluation.validate(rows, known, rows.where("s1_id <> 'X'")).collect()}
    assert got == {"duplicate_s1_rows": 1, "empty_elements": 1, "missing_s1": 1, "unknown_s1": 2, "malformed_s1": 1, "repeated_in_row": 1, "unknown_match": 1, "two_owners": 1, "missing_candidate_rows": 1, "unknown_candidate_rows": 1, "not_candidates": 1}
    good = spark.createDataFrame([("S1-1", "S2-1,S3-1"), ("S1-2", "")], "s1_id string, ids string")
    assert {r["violations"] for r in evaluation.validate(good, known, good).collect()} == {0}
    assert tuple(evaluation.summary(good).first()) == (2, 2, 1)


def test_miss_causes(spark):
    rec = records(spark)
    pairs = spark.createDataFrame([("S1-1", "S2-2"), ("S1-1", "S2-1"), ("S1-2", "S2-3")], "s1_id string, cand_id string")
    got = {r["cand_id"]: r["cause"] for r in diagnostics.miss_causes(pairs, rec).collect()}
    assert got == {"S2-2": "no key: country differs", "S2-1": "cut by top-K cap", "S2-3": "no key: country differs"}
    tight = diagnostics.miss_causes(pairs, rec, Blocking(max_block=0))
    assert {r["cand_id"]: r["cause"] for r in tight.collect()}["S2-1"] == "keys only in oversized blocks"


def test_missed_pairs_move_without_their_keys(spark):
    """Pairs meet the keys of their records in groups: no key list goes with each pair, and only records' keys move."""
    rec = records(spark)
    pairs = spark.createDataFrame([("S1-1", "S2-2", "a"), ("S1-1", "S2-1", "b"), ("S1-2", "S2-3", "a")], "s1_id string, cand_id string, chunk string")
    df = diagnostics.miss_causes(pairs, rec)
    assert sorted(df.collect()) == sorted(diagnostics.miss_causes(pairs.drop("chunk"), rec).collect()) and df.count() == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "array_intersect" not in plan and "keys1" not in plan


def test_causes_of_parts_are_those_of_the_whole(spark, monkeypatch, tmp_path):
    """45 records with one text length for each third of them, in two countries."""
    rows = [(i, f"Alpha beta {i:02d}. road{' x' * (i // 15)}\nlane {i:02d}", "en" if i % 2 else "fr", "s", 0) for i in range(45)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    told = sorted(catalog.miss_cause(spark, str(tmp_path)).collect())
    catalog._kept.pop((spark.sparkContext.applicationId, str(tmp_path), "miss causes"))
    monkeypatch.setattr(catalog, "CAUSES", 60)
    assert sorted(catalog.miss_cause(spark, str(tmp_path)).collect()) == told and len(told) > 10


def test_features_are_made_where_pairs_meet_their_records(spark):
    """No pair leaves its group with both its records, to come back to Python for its similarities."""
    rec = records(spark)
    plan = features.pair_features(blocking.candidates(rec), features.enrich(rec))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "rec1" not in plan and "MapInArrow" in plan


def test_dictionary_keeps_sure_words(spark):
    counts = spark.createDataFrame([("x", "y", 3), ("x", "z", 1), ("w", "v", 1), ("t", "a", 2), ("t", "b", 2)], "x string, y string, c long")
    assert {tuple(r) for r in translit.learn(counts).collect()} == {("x", "y")}


def test_coordinate_ascent_finds_the_best_of_a_separable_grid():
    grid = {"MATCH_THRESHOLD": [0.1, 0.5, 0.9], "W_NAME": [0.2, 0.6]}
    best, value = training.coordinate_ascent(grid, Params(), lambda p: -abs(p.MATCH_THRESHOLD - 0.5) - abs(p.W_NAME - 0.6))
    assert (best.MATCH_THRESHOLD, best.W_NAME) == (0.5, 0.6) and value == 0


@pytest.fixture(scope="module")
def scored_pairs(spark):
    rng = random.Random(0)
    rows = []
    for s, c in itertools.product(range(60), range(4)):
        label = c == s % 4
        base = [rng.random() * 0.4 + 0.5 * label for _ in features.FEATURES]
        rows.append((f"S1-{s}", "S2", f"S2-{s}-{c}", label, *base))
    return spark.createDataFrame(rows, "s1_id string, src string, cand_id string, label boolean, " + ", ".join(f"{f} double" for f in features.FEATURES)).persist()


def test_stacked_models(spark, scored_pairs, tmp_path):
    cfg = Learning(trees=4, rate=0.5, depth=2)
    oof = training.out_of_fold(scored_pairs, cfg).collect()
    assert len(oof) == 240
    right = np.mean([r["score"] for r in oof if r["label"]]) - np.mean([r["score"] for r in oof if not r["label"]])
    assert right > 0.5
    model = training.fit(scored_pairs, cfg)
    before = {r["cand_id"]: r["score"] for r in training.ml_scores(scored_pairs, model, cfg).collect()}
    model.save(str(tmp_path / "model"))
    after = {r["cand_id"]: r["score"] for r in training.ml_scores(scored_pairs, training.Model.load(str(tmp_path / "model")), cfg).collect()}
    assert before == after and len(before) == 240
    pruned = training.ml_scores(scored_pairs, model, Learning(prune=0.5)).where("p1 < 0.5").agg(F.max("score")).first()[0]
    assert pruned in (None, 0.0)


def test_rule_score_cases(spark):
    zero = {f: 0.0 for f in features.FEATURES}
    rows = {
        "plain": zero | {"name_sort": 1.0, "name_idf_jacc": 1.0, "addr_idf_jacc": 1.0, "addr_sort": 1.0}, "translit": zero | {"translit": 1.0, "name_skel": 1.0},
        "domain": zero | {"domain": 1.0, "name_partial": 0.8}, "missing": zero | {"addr_missing": 1.0, "name_sort": 1.0, "name_idf_jacc": 0.9}, "weak missing": zero | {"addr_missing": 1.0, "name_sort": 0.9},
        "specific": zero | {"addr_idf_cont": 1.0, "addr_shared_idf": 50.0, "addr_idf_jacc": 0.5}, "conflict": zero | {"num_conflict": 1.0},
    }
    df = spark.createDataFrame([(k, *v.values()) for k, v in rows.items()], "k string, " + ", ".join(f"{f} double" for f in features.FEATURES))
    got = {r[0]: round(r[1], 6) for r in df.select("k", scoring.rule_score()).collect()}
    assert got == {"plain": 1.0, "translit": 0.25, "domain": 0.2, "missing": 0.95, "weak missing": 0.0, "specific": 0.7025, "conflict": 0.0}


def test_edges_and_recall(spark):
    lists = spark.createDataFrame([("a", "x,,y,x"), ("b", "")], "s1_id string, ids string")
    truth = evaluation.edges(lists, "s1_id", "ids")
    assert {tuple(r) for r in truth.collect()} == {("a", "x"), ("a", "y")}
    found = evaluation.blocking_recall(truth, spark.createDataFrame([("a", "x"), ("b", "x")], "s1_id string, cand_id string")).first()
    assert tuple(found) == (2, 1, 0.5)
    assert defaultdict(int, evaluation.blocking_recall(truth.limit(0), truth).first().asDict())["recall"] == 0


def test_blocking_keeps_the_same_pairs_without_shuffling_pairs(spark, monkeypatch):
    """Many records with equal names, so that ranks tie at every cut; a country with a bar; groups and sums of a few rows."""
    rows = [(f"{s}-{i}", s, f"acme {i % 5} trading {i % 3}", f"{i % 7} main road block {i % 4}", c) for c in ("us", "a|b") for s in ("S1", "S2", "S3") for i in range(40 if c == "us" else 12, 90 if c == "us" else 30)]
    keys = blocking.record_keys(normalize_records(spark.createDataFrame(rows, "entity_id string, src string, business_name string, business_address string, country string")))
    monkeypatch.setattr(blocking, "CHUNK", 7)
    monkeypatch.setattr(blocking, "SUMMED", 50)
    for cfg in (Blocking(), Blocking(max_block=20, top_name=3, top_addr=2, top_total=4), Blocking(top_name=0, top_addr=1, top_total=0)):
        got, told = (sorted((r["s1_id"], r["src"], r["cand_id"], round(r["block_name"], 9), round(r["block_addr"], 9), round(r["block_score"], 9)) for r in df.collect())
                     for df in (blocking.best_pairs(keys, cfg), blocking.top_union(blocking.scored_pairs(keys, cfg), cfg)))
        assert got == told and got
    plan = blocking.best_pairs(keys)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(s1_id" not in plan


def test_blocking_moves_numbers_and_gives_ids_of_any_form(spark):
    """Ids that are their source and a number, and ids that are nearly so; lists of a key leave for the groups as numbers."""
    forms = ["{s}-7", "{s}-07", "{s}--3", "{s}- 5", "{s}-99999999999", "{s}-", "S9-7", "x", "{s}-7 ", "{s}-+2", "{s}-1e3", "{s}-12"]
    rows = [(f.format(s=s), s, f"acme trading {i % 2}", "1 main road", "us") for s in ("S1", "S2", "S3") for i, f in enumerate(forms)]
    keys = blocking.record_keys(normalize_records(spark.createDataFrame(rows, "entity_id string, src string, business_name string, business_address string, country string")))
    cfg = Blocking(max_block=20, top_name=3, top_addr=2, top_total=4)
    told = sorted(tuple(r)[:3] for r in blocking.top_union(blocking.scored_pairs(keys, cfg), cfg).select("s1_id", "src", "cand_id").collect())
    pairs = blocking.best_pairs(keys, cfg, common=blocking.common_keys(keys, cfg), placed=True)
    assert sorted((r["s1_id"], r["src"], r["cand_id"]) for r in pairs.collect()) == told and len({r[2] for r in told}) > 3
    assert sorted((r["s1_id"], r["src"], r["cand_id"]) for r in blocking.best_pairs(keys, cfg, blocking.usable_keys(keys, cfg)).collect()) == told
    plan = blocking.best_pairs(keys, cfg)._jdf.queryExecution().executedPlan().toString()
    dealt = next(line for line in plan.split("\n") if "hashpartitioning(chunk" in line)
    assert dealt and "c_nums" in plan and plan.count("hashpartitioning(key") <= 2 * plan.count("REPARTITION_BY_COL")


def test_placed_pairs_and_whole_records_move_once(spark):
    """Pairs with their group need no shuffle by entity, a part's records no other part's, and enriching moves no whole record twice."""
    rec = records(spark)
    keys = blocking.record_keys(rec)
    enriched = features.enrich(rec)
    placed = blocking.best_pairs(keys, placed=True)
    told = sorted(tuple(r) for r in features.pair_features(placed.drop("chunk"), enriched).collect())
    parts = [features.pair_features(placed.where(F.pmod(F.xxhash64("chunk"), F.lit(2)) == k), enriched) for k in range(2)]
    assert sorted(tuple(r) for p in parts for r in p.collect()) == told and told
    plan = enriched._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line and ("n_compact" in line or "a_text" in line) and "entity_id" in line for line in plan.split("\n"))
    sent = features.with_records(placed, enriched)._jdf.queryExecution().executedPlan().toString()
    assert not any("MapInArrow" in line and "n_set" in line.split("own", 1)[0] for line in sent.split("\n"))


def test_folds_keep_their_steps_where_they_are_told(spark, monkeypatch, tmp_path):
    """Steps that are kept as files leave a plan of files alone, and nothing is persisted."""
    monkeypatch.setattr(training, "_fit", lambda *_: None)
    monkeypatch.setattr(training, "_apply", lambda model, df, name: df.withColumn(name, F.lit(0.5)))
    df = spark.createDataFrame([(f"S1-{i}", "S2", f"S2-{i}", i % 2 == 0) for i in range(40)], "s1_id string, src string, cand_id string, label boolean")
    paths = []

    def keep(step):
        paths.append(f"{tmp_path}/{len(paths)}")
        step.write.parquet(paths[-1])
        return spark.read.parquet(paths[-1])

    out = training.out_of_fold(df, keep=keep)
    told = training.out_of_fold(df)
    assert "InMemoryTableScan" not in out._jdf.queryExecution().executedPlan().toString() and len(paths) == 3
    columns = ["s1_id", "src", "cand_id", "label", "p1", "score"]
    assert sorted(out.select(columns).collect()) == sorted(told.select(columns).collect()) and out.count() == 40


def test_pairs_meet_their_records_without_a_shuffle_of_both(spark):
    """Each pair with each record of its ids, repeated ids included; columns that are not carried are null."""
    rec = records(spark)
    rec = features.enrich(rec).unionByName(features.enrich(rec).where("entity_id = 'S2-1'"))
    pairs = blocking.candidates(records(spark))
    got = features.with_records(pairs, rec, ["n_core", "n_idf", "a_numbers"])
    rows = sorted((r["s1_id"], r["cand_id"], r["n_core1"], r["n_core2"], tuple(r["a_numbers2"]), r["n_skel1"], round(r["block_score"], 6)) for r in got.collect())
    by_id = {r["entity_id"]: r for r in rec.collect()}
    told = sorted(
        (p["s1_id"], p["cand_id"], by_id[p["s1_id"]]["n_core"], by_id[p["cand_id"]]["n_core"], tuple(by_id[p["cand_id"]]["a_numbers"]), None, round(p["block_score"], 6))
        for p in pairs.collect() for _ in range(2 if p["cand_id"] == "S2-1" else 1)
    )
    assert rows == told and len(rows) == 3
    assert all(set(r["n_idf1"]) == set(by_id[r["s1_id"]]["n_tokens"]) for r in got.collect())
    plan = features.with_records(pairs, rec)._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.split("\n") if "Exchange" in line and "hashpartitioning" in line and "n_core1" in line]
    assert "MapInArrow" in plan and not wide


def test_like_pairs_are_compared_once(monkeypatch):
    rows = [("a b", "a c", "ab", "ac", "b", "c", "x 1", "x 2", ["a", "b"], ["a", "c"], ["1"], ["2"]), ("q", None, "q", "", "q", "", "", "", ["q"], [], [], [])]
    columns = [pd.Series(c) for c in zip(*[rows[i] for i in (0, 1, 0, 0, 1)], strict=True)]
    told = similarity._pair(*columns)
    compared = similarity._compared
    sizes = []
    monkeypatch.setattr(similarity, "_compared", lambda *cs: sizes.append(len(cs[0])) or compared(*cs))
    assert similarity._pair(*columns).equals(told) and sizes == [2]
    assert told.iloc[[0, 1, 0, 0, 1]].reset_index(drop=True).equals(compared(*columns))


def test_a_threshold_on_similarities_compares_pairs_once(spark):
    """A predicate on what is made of the similarities does not make them once more for itself."""
    strings, lists = [f"s{i}" for i in range(8)], [f"l{i}" for i in range(4)]
    pairs = spark.range(5).select(*(F.concat(F.lit("acme "), F.col("id") % (i + 2)).alias(c) for i, c in enumerate(strings)), *(F.array(F.col("id").cast("string")).alias(c) for c in lists))
    told = pairs.withColumn("f", similarity.pair_similarity(*strings, *lists)).select("f.*").withColumn("score", F.col("name_sort") + F.greatest("name_ratio", "addr_sort"))
    kept = told.where("score >= 1.9")
    assert kept._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(r["score"] for r in kept.collect()) == sorted(r["score"] for r in told.collect() if r["score"] >= 1.9) != []
