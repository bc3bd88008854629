import random
import re
from collections import Counter

import numpy as np
import pytest

from kindred.llm import minhash, shingles

from .conftest import DOCS, sentence, untouched, with_clashes


def bag(text):
    ws = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    if len(ws) < 5:
        return Counter([tuple(ws)] if ws else [])
    return Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def family(rng, n, edits):
    base = sentence(rng, 200).split()
    out = []
    for _ in range(n):
        ws = list(base)
        for _ in range(rng.randint(0, edits)):
            ws[rng.randrange(len(ws))] = sentence(rng, 1)
        out.append(" ".join(ws))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [sentence(rng, rng.randint(1, 120)) for _ in range(60)]
    for edits in (2, 5, 9, 12):
        texts += family(rng, 25, edits)
    texts += ["the " * 300, "the " * 280, "The, the. " * 150, "", " ", None, "one two", "One  two!", texts[0].upper()]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)]


def components(rows):
    bags = [bag(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


@pytest.mark.parametrize("block", [minhash.BLOCK_WEIGHT, 500])
def test_against_brute_force(spark, corpus, block):
    found = minhash.near_classes(spark.createDataFrame(corpus, DOCS), block=block).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == components(corpus)
    sizes = Counter(r["class_id"] for r in found)
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in found)


def test_signatures_are_unbiased_for_weighted_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        n = 120
        h = rng.integers(0, 2**63, n).astype(np.uint64)
        a = rng.integers(1, 40, n)
        b = np.where(rng.random(n) < 0.7, a, rng.integers(1, 40, n))
        s = minhash.signatures(np.repeat([0, 1], n), np.concatenate([h, h]), np.concatenate([a, b]), 2, 192)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


def test_bags_are_those_of_the_words():
    texts = ["a b c d e f", "a b c d e f a b c d e f", "Ünï-cødé, 漢字 x9 y z q", "", None, "one", "x " * 50]
    h, first = shingles.word_hashes(texts)
    text, s, count = shingles.bags(h, first)
    for i, t in enumerate(texts):
        expected = bag(t)
        assert sorted(count[text == i].tolist()) == sorted(expected.values())
    big = ["w%d " % i * 3 for i in range(2000)] * 800  # more than one working array
    h2, f2 = shingles.word_hashes(big)
    assert len(f2) == len(big) + 1 and (np.diff(f2) == 3).all() and (h2[:3] == h2[0]).all()


def brute(rows):
    """For each row its class: the id, the size, and whether it is the row that stays (of equal rows, any)."""
    bags = [bag(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= 0.8:
                root[find(i)] = find(j)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(find(i), []).append(i)
    return classes


def against_brute(rows, found):
    """The classes' ids, sizes and members, and one row kept of each class, with its smallest id."""
    classes = brute(rows)
    smallest = lambda ids: min((x for x in ids if x is not None), default=None)
    expected = sorted(((rows[i][0], smallest(rows[j][0] for j in members), len(members)) for members in classes.values() for i in members), key=str)
    assert sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in found), key=str) == expected
    kept = sorted((r["doc_id"] for r in found if r["kept"]), key=str)
    assert kept == sorted((smallest(rows[j][0] for j in members) for members in classes.values()), key=str)


def test_hard_rows(spark, hard_docs, clashing):
    df = with_clashes(spark.createDataFrame(hard_docs, DOCS), clashing)
    against_brute(hard_docs, minhash.near_classes(df).collect())
    out = minhash.near_dedup(df)
    found = out.collect()
    assert out.columns == df.columns and sorted(r["doc_id"] for r in found) == [1, 3, 6, 9, 10] and untouched(found, clashing)


@pytest.mark.parametrize("more", [[], [(900, "Z z z z z", "en", "s", 0)] * 2])
def test_ids_with_several_texts_and_none(spark, corpus, more):
    """Ids that repeat with other texts, rows without ids, and an unrelated repeated row: no text is lost or merged."""
    rng = random.Random(11)
    a, b = sentence(rng, 120), sentence(rng, 120)
    near = lambda t: t.replace(t.split()[50], "other", 1)
    rows = [(5, a), (5, b), (7, b), (9, "Z z z z z"), (8, near(a)), (None, near(near(b))), (None, "only here"), (None, "Only HERE"), (None, sentence(rng, 60)), (6, b), (5, a)]
    rows = [(i, t, "en", "s", 0) for i, t in rows] + more + [(200 + i % 7, t, "en", "s", 0) for i, (_, t, *_) in enumerate(corpus[60:110])]
    df = spark.createDataFrame(rows, DOCS)
    against_brute(rows, minhash.near_classes(df).collect())
    left = minhash.near_dedup(df).collect()
    classes = brute(rows)
    at = {}
    for root, members in classes.items():
        for i in members:
            at[rows[i][0], rows[i][1]] = root
    assert sorted(at[r["doc_id"], r["text"]] for r in left) == sorted(classes)


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert minhash.near_classes(df).count() == 0 and minhash.near_dedup(df).count() == 0
