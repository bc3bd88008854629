import random
import re
import zlib
from collections import Counter

import corpus_pipeline
from kindred.llm import langid, minhash, mixing, packing, queries

from .conftest import DOCS, untouched, with_clashes
from .test_minhash import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "best_fit_packing"]
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], SF).persist())
    rows = [s.collect() for s in steps]
    assert all(s.columns == docs.columns for s in steps[:-1])
    told = {r["doc_id"] for r in rows[1]}
    assert told <= {r["doc_id"] for r in rows[0]} and len(told) >= 0.97 * len(rows[0])
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in rows[1]:
        first[norm(r["text"])] = min(first.get(norm(r["text"]), r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(first.values())
    classes = minhash.near_classes(steps[2]).collect()
    assert sorted(r["doc_id"] for r in rows[3]) == sorted({r["class_id"] for r in classes})
    assert {r["doc_id"] for r in rows[4]} <= {r["doc_id"] for r in rows[3]}
    packed = Counter()
    for r in rows[5]:
        packed[r["doc_id"]] += r["n_tokens"]
    copies = Counter(r["doc_id"] for r in rows[4])
    texts = {r["doc_id"]: r["text"] for r in rows[4]}
    assert packed == Counter({i: n * len(texts[i].split()) for i, n in copies.items()})


def test_run_is_the_stages(spark, tmp_path):
    """On hard rows each stage does what a plain loop does, and the run gives what the stages give."""
    rng = random.Random(21)
    english, german = "the of and to in that is was for with as on be at by this from".split(), "der die und den von zu das mit sich des auf ist im dem nicht".split()
    text = lambda ws, n: " ".join(rng.choice(ws) for _ in range(n))
    rows = [(i, text(english if i % 2 else german, rng.randint(30, 90)), "en" if i % 2 else "de", f"s{i % 3}", 0) for i in range(40)]
    base = rows[1][1].split()
    near = [(100 + k, " ".join([*base[:k], "other", *base[k + 1 :]]), "en", "s9", 0) for k in (3, 4)]
    rows += near + [(50, rows[0][1].replace(" ", "\n"), None, None, None), (51, None, "en", "s", 0), (52, "", None, "s", 0), (53, "12 !!", "en", "s", 0), (None, rows[2][1], "de", "s", 0)]
    rows += [(None, text(english, 50), None, None, None), (60, rows[3][1], "en", "s", 0), (60, rows[3][1], "en", "s", 0), (61, text(english, 5000), "en", "s1", 0), (61, text(german, 60), "de", "s1", 0), rows[5], rows[5]]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    docs = with_clashes(spark.createDataFrame(rows, DOCS), ["langid", "row", "id", "kept", "a.b"])
    names = docs.columns
    held = lambda r: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0
    # language ID: the classifier by itself, learned from the other rows
    told = corpus_pipeline.language_id(spark, docs, folder)
    model = langid.Classifier(langid.learn(spark.createDataFrame([r for r in rows if not held(r)], DOCS).select("text", "lang")))
    stays = [r for r in rows if not model.predict(r[1])[2]]
    got = told.collect()
    assert told.columns == names and untouched(got, ["langid", "row", "id", "kept", "a.b"]) and key(got) == key(stays)
    # exact dedup: one row of each normalised text, with its smallest id
    exact = corpus_pipeline.exact_dedup(spark, told, folder)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in stays:
        at = norm(r[1])
        if at not in first or (r[0] is not None and (first[at] is None or r[0] < first[at])):
            first[at] = r[0]
    assert exact.columns == names and sorted(((r["doc_id"], norm(r["text"])) for r in exact.collect()), key=str) == sorted(((i, t) for t, i in first.items()), key=str)
    # near dedup: one row of each component of similar texts
    single = corpus_pipeline.near_dedup(spark, exact, folder)
    left = [(r["doc_id"], r["text"]) for r in exact.collect()]
    expected = sorted((min((left[i][0] for i in members if left[i][0] is not None), default=None) for members in brute(left).values()), key=str)
    assert single.columns == names and sorted((r["doc_id"] for r in single.collect()), key=str) == expected and len(expected) < len(left)
    # mixing: the tokens of each source reach its budget and stop there
    mixed = corpus_pipeline.mix_sources(spark, single, folder)
    tokens = Counter()
    for r in single.collect():
        tokens[r["source"] or ""] += len(r["text"].split())
    _, weights = mixing.solve(dict(tokens), sum(tokens.values()), mixing.TARGET_ENTROPY, mixing.MAX_EPOCHS)
    taken, longest = Counter(), Counter()
    rows_mixed = mixed.collect()
    for r in rows_mixed:
        taken[r["source"] or ""] += len(r["text"].split())
        longest[r["source"] or ""] = max(longest[r["source"] or ""], len(r["text"].split()))
    assert mixed.columns == names and untouched(rows_mixed, ["langid", "row", "a.b"])
    for source, weight in weights.items():
        assert int(sum(tokens.values()) * weight) <= taken[source] < int(sum(tokens.values()) * weight) + longest[source] + 1
    # packing: every token once, no bin over capacity, no text and no source too often in a bin
    packed = corpus_pipeline.pack(spark, mixed, folder).collect()
    assert sum(r["n_tokens"] for r in packed) == sum(len(r["text"].split()) for r in rows_mixed)
    bins = {}
    for r in packed:
        bins.setdefault(r["bin"], []).append(r)
    assert all(sum(r["n_tokens"] for r in b) == b[0]["bin_tokens"] <= packing.CAPACITY and max(Counter(r["source"] for r in b).values()) <= packing.PER_SOURCE for b in bins.values())
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["n_tokens"]) for r in whole) == Counter((r["doc_id"], r["piece"], r["n_tokens"]) for r in packed)


def key(rows):
    return sorted(((r[0], r[1]) for r in rows), key=str)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_its_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_conversation_probe(spark):
    row = queries.op10_chat(spark, SF).where("conv_id = -7").first()
    import hashlib

    said = "</s>[INST] ok [/INST]"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(said) and row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_languages_are_learned_only_from_the_other_rows(spark):
    got = queries.op6_langid(spark, SF).collect()
    assert {r["held_out"] for r in got} == {True, False} and {r["lang_pred"] for r in got} <= {"en", "de", "fr", "es", "und"}
    assert langid.MARGIN > 0
