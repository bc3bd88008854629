import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from kindred.llm import langid, quality

from .conftest import DOCS, sentence, untouched, with_clashes


def corpus(n):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        t = sentence(rng, 60) + "."
        rows.append((i, t if good else " | ".join(t.split()), "en", "s", 0))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(600)
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fitted = quality.fit(docs, marks.where(langid.bucket(F.col("doc_id"), 3) != 1))
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, *fitted).collect()}
    held = [(got[i], y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(s >= 0.5) == (y == 1) for s, y in held]) > 0.95 and all(0 <= s <= 1 for s, _ in held)


def test_context_sums_against_a_loop():
    texts = ["a b a c", "", None, "x x x y!!", "b a"]
    rows, first = quality.tokens(texts)
    total = np.zeros((1 << quality.ROW_BITS, quality.DIMS + 1))
    quality.context_sums(rows, first, total)
    place, sign = quality.index_vectors()
    index = np.zeros((1 << quality.ROW_BITS, quality.DIMS))
    np.add.at(index, (np.repeat(np.arange(len(place)), quality.NONZERO), place.reshape(-1)), sign.reshape(-1))
    expected = np.zeros_like(total)
    for i in range(len(texts)):
        ts = rows[first[i] : first[i + 1]]
        for a, r in enumerate(ts):
            expected[r, -1] += 1
            for b, o in enumerate(ts):
                if a != b and abs(a - b) <= quality.WINDOW:
                    expected[r, :-1] += index[o]
    assert np.allclose(total, expected)
    assert len(set(rows[first[3] : first[4]].tolist())) == 4  # x, repeat, y, !!


def test_gathering_in_steps_gives_the_same_sums(spark):
    rows, _ = corpus(300)
    docs = spark.createDataFrame(rows, DOCS).repartition(9)
    whole = quality.word_vectors(docs)
    before = quality.FAN_IN
    quality.FAN_IN = 2
    try:
        assert np.allclose(quality.word_vectors(docs), whole)
    finally:
        quality.FAN_IN = before


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 65))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.train(x[:2000], y[:2000])
    s, y = net.scores(x[2000:]), y[2000:]  # rows that training has not seen
    for lo in (0.1, 0.4, 0.7):
        some = (s >= lo) & (s < lo + 0.2)
        assert abs(s[some].mean() - y[some].mean()) < 0.12


def test_few_labels_teach(spark):
    """Three labels of both kinds are enough for scores that tell texts apart, and several texts of one id give the same fit each time."""
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(["good plain words here", "bad bad !!! $$$ ###", "good plain text here", "### !!! bad $$$"])] + [(0, "other text", "en", "s", 0)], DOCS)
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    vectors, net = quality.fit(docs, labels)
    scores = {r["doc_id"]: r["quality_score"] for r in quality.score(docs.where("text <> 'other text'"), vectors, net).collect()}
    assert scores[2] > scores[3] and len(set(scores.values())) > 2
    assert np.array_equal(quality.fit(docs.repartition(5), labels)[1].w1, net.w1)


def test_hard_rows(spark, hard_docs, clashing):
    docs = with_clashes(spark.createDataFrame(hard_docs, DOCS), [*clashing, "y", "x"])
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (None, 1), (6, None), (99, 0)], "doc_id long, quality int")
    fitted = quality.fit(docs, labels)
    out = quality.score(docs, *fitted).collect()
    assert len(out) == len(hard_docs) and all(0 <= r["quality_score_"] <= 1 for r in out) and untouched(out, [*clashing, "y", "x"])
    none = quality.fit(docs.limit(0), labels)
    assert quality.score(docs.limit(0), *none).count() == 0
