import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int, letters: str = "aeioubcdfglmnprst") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(n))


@pytest.fixture
def hard_docs():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    rng = random.Random(3)
    long = sentence(rng, 40_000)
    return [
        (1, "a b  c\td", "en", "s", 7), (2, "a b c d", "en", None, 7), (2, "a b c d", "en", None, 7), (3, None, None, None, None), (4, "", "en", "s", 0),
        (5, " \n ", "de", "s", 3), (None, "a b c d", "en", "s", 7), (None, None, None, None, None), (6, long, "en", "t", len(long)),
        (7, long.replace(" ", "\n"), "en", "t", len(long)), (8, long + " x", "en", "t", len(long) + 2), (9, "1234 !! 5", "fr", "u", 9), (10, "é ü 漢字 🙂", "fr", "u", 8),
    ]


@pytest.fixture
def clashing():
    """Columns that the operators use inside or add, as further columns of the input."""
    return """kept i n c block epoch text_sha256 __id __sha __th __row __rows __each __times __e langid part band node shard piece copy copies hits path2
        main_text quality_score row key id sha t1 t2 head leader k1 k2 h times rows start class_id cs norm recipe lang_pred score a.b""".split()


def with_clashes(df, names):
    """``df`` with these further columns, each of which holds its own name and the row's doc_id."""
    from pyspark.sql import functions as F

    return df.select("*", *(F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c in names))


def untouched(rows, names):
    """Whether all further columns hold what ``with_clashes`` put there."""
    return all(r[c] == f"{c}{'null' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in names)
