import hashlib
import re
from collections import defaultdict

from kindred.llm import exact

from .conftest import DOCS, untouched, with_clashes


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        free = True
        for i in sorted(ids, key=lambda v: (v is None, v)):
            kept = i == keep and free
            free = free and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_against_brute_force(spark, hard_docs):
    df = spark.createDataFrame(hard_docs, DOCS)
    assert rows_of(exact.exact_classes(df)) == sorted(brute(hard_docs), key=str)


def test_clashing_identifiers_are_found(spark, hard_docs):
    """With identifiers of four bits nearly all chunks clash, and the classes stay right."""
    rows = hard_docs + [(100 + i, f"text number {i % 40}", "en", "s", 1) for i in range(80)]
    df = spark.createDataFrame(rows, DOCS)
    assert rows_of(exact.exact_classes(df, id_digits=1)) == sorted(brute(rows), key=str)


def test_chunks_are_the_text_and_resync(spark, hard_docs):
    long = hard_docs[8][1]
    df = spark.createDataFrame([(long,), ("inserted " + long,), ("",)], "t string").select(exact.chunks(exact.normalized(df_col("t"))).alias("cs"))
    a, b, none = (r["cs"] for r in df.collect())
    assert "".join(a) == long and "".join(b) == "inserted " + long and none == []
    assert len(set(a) & set(b)) > 0.8 * len(a)
    assert max(map(len, a)) <= exact.CHUNK_MAX


def df_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_dedup_keeps_one_row_and_all_columns(spark, hard_docs, clashing):
    rows = hard_docs + [(2, "a b  c d", "en", None, 7), (50, "only", "en", "s", 4), (50, "other", "en", "s", 5), (51, "other", "en", "s", 5)]
    df = with_clashes(spark.createDataFrame(rows, DOCS), clashing)
    out = exact.exact_dedup(df)
    assert out.columns == df.columns
    found = out.collect()
    assert sorted((r["doc_id"] for r in found), key=str) == sorted((b[0] for b in brute(rows) if b[3]), key=str) and untouched(found, clashing)


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert exact.exact_classes(df).count() == 0 and exact.exact_dedup(df).count() == 0
