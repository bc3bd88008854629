"""Every query that has SQL returns what the SQL returns."""

import duckdb
import pytest

import __spark_entry__ as entry
from kindred.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(v):
    if v is None:
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    mine = sorted(tuple(canonical(r[c]) for c in sorted(df.columns)) for r in df.collect())
    told = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == sorted(df.columns)
    assert mine == sorted(tuple(canonical(r[names.index(c)]) for c in sorted(names)) for r in told.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registered_queries_keep_keys_up_to_the_operators_cap(spark, tmp_path):
    """150 records of S2 and of S3 share their name keys, and one of S1 has the same text as two of them."""
    rows = [(i, "Alpha beta gamma. " + ("same" if i < 3 else f"other {i}"), "en", "s", 0) for i in range(450)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("q_key_cap", "q_blocking_recall"):
        df = entry.queries()[name](spark, str(tmp_path))
        mine = sorted(tuple(canonical(r[c]) for c in sorted(df.columns)) for r in df.collect())
        told = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in told.description]
        assert mine == sorted(tuple(canonical(r[names.index(c)]) for c in sorted(names)) for r in told.fetchall())
    assert max(r["size"] for r in entry.queries()["q_key_cap"](spark, str(tmp_path)).collect()) == 150


def test_missed_pairs_do_not_hang_on_the_order_of_summing(spark, monkeypatch):
    """A sum that is 2, but for its last bit."""
    found = spark.createDataFrame([("S1-1", "S2-1", 1.9999999999999998), ("S1-2", "S2-2", 1.9999)], "s1_id string, cand_id string, block_score double")
    monkeypatch.setattr(catalog, "candidates", lambda spark, sf_dir: found)
    monkeypatch.setattr(catalog, "truth", lambda spark, sf_dir: found.select("s1_id", "cand_id"))
    assert found.where("block_score >= 2").count() == 0
    assert [tuple(r) for r in catalog.missed_pairs(spark, SF).collect()] == [("S1-2", "S2-2")]


def test_candidate_lists_of_a_run_need_no_features(spark, monkeypatch):
    catalog.forget()
    monkeypatch.setattr(catalog.linkage.features, "pair_features", lambda *_: pytest.fail("features were asked for"))
    assert catalog.run_candidates(spark, SF).count() > 0
    catalog.forget()
