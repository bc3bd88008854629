import random
import zlib

from pyspark.sql import functions as F

from kindred.llm import langid

from .conftest import DOCS, untouched, with_clashes

WORDS = {"en": "the of and to in that is was for with as on be at by this from".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht".split()}


def corpus(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(5, 60))), lang, "s", 0) for i in range(n) for lang in [rng.choice(["en", "de"])]]


def test_held_out_accuracy_and_split(spark):
    rows = corpus(400, 1)
    df = spark.createDataFrame(rows, DOCS)
    assert {r[0]: r[1] for r in df.select("doc_id", langid.bucket(F.col("doc_id"), 5)).collect()} == {r[0]: zlib.crc32(str(r[0]).encode()) % 5 for r in rows}
    model = langid.learn(df.where(langid.bucket(F.col("doc_id"), 5) != 0).select("text", "lang"))
    found = langid.classify(df, model).where(langid.bucket(F.col("doc_id"), 5) == 0).select("lang", "langid.*").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_prediction_needs_the_text_alone():
    rng = random.Random(3)
    model = langid.Classifier({lang: " ".join(rng.choice(ws) for _ in range(3000)).encode() for lang, ws in WORDS.items()})
    a = model.predict("der sich auf für den nicht das")
    assert a[0] == "de" and a == model.predict("der sich auf für den nicht das") and not a[2]
    assert model.predict(None) == model.predict("12 !! 34") == model.predict("") == ("und", 0.0, True)
    twins = langid.Classifier({"a": b"the of and to in that is " * 50, "b": b"the of and to in that is " * 50})
    assert twins.predict("that is the") == ("a", 0.0, True)  # no margin: rejected, ties to the first
    assert model.predict("der und die " * 200_000)[0] == "de"
    assert langid.Classifier({}).predict("text")[0] == "und"
    assert langid.Classifier({"en": b"the"}).predict("anything")[:2] == ("en", 1.0)


def test_long_blocks_are_compressed_without_the_primer():
    """Only a short block needs it: bytes that the compressors are given are few more than the text's."""
    rng = random.Random(5)
    model = langid.Classifier({lang: " ".join(rng.choice(ws) for _ in range(3000)).encode() for lang, ws in WORDS.items()})
    given = []

    class Counted:
        def __init__(self, c):
            self.c = c

        def compress(self, b):
            given.append(len(b))
            return self.c.compress(b)

    model.models = [(Counted(c), *rest) for c, *rest in model.models]
    long, short = " ".join(rng.choice(WORDS["de"]) for _ in range(5_000)), "der sich auf"
    assert model.predict(long)[0] == "de"
    assert sum(given) <= 2 * (len(langid.letters(long)) + langid.PRIMER_BYTES)
    given.clear()
    assert model.predict(short)[0] == "de" and sum(given) == 2 * (len(short) + langid.PRIMER_BYTES)


def test_dictionaries_are_bounded_and_ignore_copies(spark):
    rows = corpus(200, 2) + [(1000 + i, "copy copy copy", "en", "s", 0) for i in range(2000)]
    model = langid.learn(spark.createDataFrame(rows, DOCS).select("text", "lang"), 1_000, 100)
    assert all(len(d) <= 1_000 for d in model.values()) and model["en"].count(b"copy copy copy") <= 1


def test_languages_of_copies_reach_the_promised_number_of_texts(spark):
    texts = [(f"{lang} word {chr(97 + i // 26)}{chr(97 + i % 26)}", lang) for lang in ("aa", "bb") for i in range(300)]
    rows = spark.createDataFrame(texts, "text string, lang string").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(100)))).drop("n")
    once = langid.learn(spark.createDataFrame(texts, "text string, lang string"), 640, 80)  # 16 texts each
    assert langid.learn(rows, 640, 80) == once and {x: d.count(b"word") for x, d in once.items()} == {"aa": 16, "bb": 16}


def test_pieces_come_from_whole_texts(spark):
    """One-shot brute force: the pieces of smallest hash of all texts, whatever their place and number of copies."""
    rng = random.Random(7)
    rows = [(" ".join(rng.choice(WORDS[lang]) + str(i) for i in range(rng.randint(1, 400))), lang) for _ in range(30) for lang in WORDS]
    df = spark.createDataFrame(rows * 3 + [("copy of one text only", "en")] * 3000, "text string, lang string")
    pieces = spark.createDataFrame([(t[i : i + 50], lang) for t, lang in rows + [("copy of one text only", "en")] for i in range(0, len(t), 50)], "p string, lang string")
    expected = {}
    for r in pieces.select("lang", F.xxhash64("p", F.lit("langid")).alias("h"), "p").distinct().collect():
        expected.setdefault(r["lang"], []).append((r["h"], r["p"]))
    model = langid.learn(df, 1_000, 50)
    assert model == {lang: b" ".join(langid.letters(p) for _, p in sorted(sorted(hs)[:40], reverse=True))[-1_000:] for lang, hs in expected.items()}


def test_hard_rows(spark, hard_docs, clashing):
    df = spark.createDataFrame(hard_docs, DOCS)
    model = langid.learn(df.select("text", "lang"))
    extra = langid.classify(with_clashes(df, clashing), model)
    assert untouched(extra.collect(), clashing)
    found = extra.select("doc_id", "langid_.*").collect()
    assert len(found) == len(hard_docs) and all((r["lang_pred"] == "und") == (r["doc_id"] in (None, 3, 4, 5, 9) and r["score"] == 0.0 and r["rejected"] and r["lang_pred"] == "und") for r in found)
    assert langid.learn(spark.createDataFrame([], DOCS).select("text", "lang")) == {}
    assert langid.classify(spark.createDataFrame([], DOCS), model).count() == 0
