"""Language identification by compression.

Each language has a zstandard dictionary: raw text of that language.  Text is
lower-cased, and what is no letter becomes one space.  A text is cut into blocks, each
block is compressed with every dictionary.  A short block by itself would be stored as it
stands, so it is compressed behind a short primer of the language, and what it adds to the
primer's size counts.  The language that makes the whole text smallest is the answer.
Where the runner-up comes within a margin, the answer is marked as rejected.

A dictionary is made of pieces of texts: whole texts are cut into pieces of a fixed
length, and the pieces of smallest hash are taken, so that a long text gives as many as
its length asks and copies give none twice.

Cases: a text that is null or has no letter is ``und`` with score 0, and rejected.  Rows
without a language or a text teach nothing.  With no row to learn from every text is
``und``.  Ties go to the language that sorts first.  A very long text is compressed block
by block, all of it.  Other columns are kept, whatever their names; repeated rows give one
row each; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import free_name, small_batches

#: Bytes of all dictionaries and of one of them, at most, and characters of a piece of text in it.
ALL_BYTES, DICT_BYTES, PIECE_CHARS = 64_000_000, 64_000, 2_000
#: Bytes of a text that are compressed at once, bytes of the primer, and bytes of a block from which it needs none.
BLOCK_BYTES, PRIMER_BYTES, UNPRIMED_BYTES = 4_096, 500, 1_024
#: A text is rejected if the runner-up's size is less than this part larger.
MARGIN = 0.005
#: Languages, more than there are; a table with more is an error, for its column holds no languages.
MAX_LANGUAGES = 10_000
LEVEL = 12

_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")


def bucket(doc_id: Column, n: int) -> Column:
    """CRC-32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def learn(rows: DataFrame, dict_bytes: int = DICT_BYTES, piece_chars: int = PIECE_CHARS) -> dict[str, bytes]:
    """A dictionary for each language of ``rows`` (text, lang).

    The sample is bounded: of each language's different pieces of ``piece_chars``
    characters, the ``2 * dict_bytes / piece_chars`` of smallest hash.  A first pass over
    hashes alone finds the largest hash that is wanted, so that only wanted pieces move.
    """
    known = rows.where("text is not null and lang is not null and length(text) > 0")
    pieces = known.select(
        F.col("lang").cast("string").alias("lang"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(rf"(?s).{{1,{piece_chars}}}"), F.lit(0))).alias("piece")
    ).withColumn("h", F.xxhash64("piece", F.lit("langid")))
    many = max(1, 2 * dict_bytes // piece_chars)
    ranked = pieces.select("lang", "h").distinct().withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(f"r <= {many}")
    limits = ranked.groupBy("lang").agg(F.max("h").alias("most")).limit(MAX_LANGUAGES + 1).collect()
    if len(limits) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not limits:
        return {}
    wanted = rows.sparkSession.createDataFrame([(r["lang"], r["most"]) for r in limits], "lang string, most long")
    few = pieces.join(F.broadcast(wanted), "lang").where("h <= most").select("lang", "h", "piece").distinct()  # MAX_LANGUAGES rows at most
    heads: dict[str, list[tuple[int, str]]] = {}
    for r in few.toLocalIterator():  # ``many`` pieces a language
        heads.setdefault(r["lang"], []).append((r["h"], r["piece"]))
    room = min(dict_bytes, ALL_BYTES // len(heads))
    return {lang: b" ".join(letters(x) for _, x in sorted(hs, reverse=True))[-room:] for lang, hs in sorted(heads.items())}


def letters(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


class Classifier:
    """Compressors for all languages; made once in each worker."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.languages = sorted(dictionaries)
        self.models = []
        for x in self.languages:
            primer, rest = dictionaries[x][:PRIMER_BYTES], dictionaries[x][PRIMER_BYTES:]
            c = self._compressor(rest or primer, LEVEL)
            self.models.append((c, primer, len(c.compress(primer))))

    @staticmethod
    def _compressor(raw: bytes, level: int) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def sizes(self, text: str) -> list[int]:
        raw = letters(text)
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        added = lambda c, primer, alone, b: len(c.compress(b)) if len(b) >= UNPRIMED_BYTES else len(c.compress(primer + b)) - alone
        return [max(1, sum(added(*model, b) for b in blocks)) for model in self.models]

    def predict(self, text: str | None, margin: float = MARGIN) -> tuple[str, float, bool]:
        """The language, how much larger the runner-up is (0 to 1), and whether the margin is too narrow."""
        if text is None or not self.languages or not _LETTER.search(text):
            return "und", 0.0, True
        sizes = self.sizes(text)
        best = int(np.argmin(sizes))
        rest = [s for i, s in enumerate(sizes) if i != best]
        if not rest:
            return self.languages[best], 1.0, False
        lead = (min(rest) - sizes[best]) / min(rest)
        return self.languages[best], lead, lead < margin


SCHEMA = "lang_pred string, score double, rejected boolean"


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, into: str = "langid") -> DataFrame:
    """``docs`` with a struct ``into`` of ``lang_pred, score, rejected``, from ``text`` alone.

    Where ``docs`` has a column of that name, it stays and the struct's name gets underscores.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # ALL_BYTES at most

    @F.pandas_udf(SCHEMA)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Classifier(shared.value)
        for texts in batches:
            yield pd.DataFrame([model.predict(t, margin) for t in texts], columns=["lang_pred", "score", "rejected"])

    return docs.select("*", udf(F.col("text").cast("string")).alias(free_name(into, docs.columns)))
