"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is normalised, cut at content-defined places, and each chunk gets an
identifier from its content.  Chunks are deduplicated over the whole corpus, which
verifies the identifiers: one that stands for two contents is found there.  A
document then is the ordered list of its identifiers (its recipe), and equal
documents are found by comparing recipes; the text moves once, as chunks.

Cases: a null text counts as empty, and all empty texts are equal.  Rows repeated with
one ``doc_id`` and equal texts give one row each, of which one at most is kept (which of
them is not defined).  A null ``doc_id`` never wins over another; a group of nulls alone
keeps one row, with a null ``keep_id``.  There are no other ties.  Very long texts are
chunked as all others and move as chunks.  Other columns of the input are ignored by
``exact_classes`` and kept by ``exact_dedup``, whatever their names.  An empty table
gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread, whole_row

#: Chunks have this many characters at least (but for a text's last), and at most.
CHUNK_MIN, CHUNK_MAX = 512, 4096
#: A chunk ends where these three characters stand.
ANCHOR = r"[dgknrtz][ ,.\n][a-hà-ï]"
#: Hexadecimal digits of an identifier.
ID_DIGITS = 32


def normalized(text: Column) -> Column:
    """White space runs (space, \\t to \\r) as one space; runs that are one space already stay."""
    return F.regexp_replace(
        F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "
    )


def chunks(norm: Column) -> Column:
    """The content-defined chunks of a text, in order; together they are the text."""
    pattern = rf"(?s).{{{CHUNK_MIN},{CHUNK_MAX - 3}}}?{ANCHOR}|.{{1,{CHUNK_MAX}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def identifier(chunk: Column, digits: int) -> Column:
    return F.substring(F.sha2(chunk, 256), 1, digits)


def exact_classes(docs: DataFrame, id_digits: int = ID_DIGITS) -> DataFrame:
    """``doc_id, text_sha256, keep_id, group_size, copy, kept``: one row per row of ``docs``."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalized(F.col("text")).alias("norm"))
    cut = base.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm")).alias("cs"))
    # The only movement of text: distinct contents under each identifier.
    contents = cut.select(F.explode("cs").alias("c")).select(identifier(F.col("c"), id_digits).alias("i"), "c").distinct()
    clashing = materialize(contents.groupBy("i").count().where("count > 1").select("i"))
    recipes = cut.select(
        "doc_id", "text_sha256",
        F.array_join(F.transform("cs", lambda c: identifier(c, id_digits)), "").alias("recipe"),
    )
    if not clashing.isEmpty():
        recipes = _resolved(cut, clashing, id_digits)
    rows = recipes.groupBy("recipe", "doc_id", "text_sha256").agg(F.count("*").alias("n"))
    classes = rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    found = rows.join(spread(classes), "recipe").select(
        "doc_id", "text_sha256", "keep_id", "group_size", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")
    )
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))


def _resolved(cut: DataFrame, clashing: DataFrame, id_digits: int) -> DataFrame:
    """Recipes where some identifiers stand for several contents: a clashing chunk stands for itself."""
    rowed = cut.withColumn("r", F.struct(F.monotonically_increasing_id().alias("at"), "doc_id", "text_sha256"))
    each = rowed.select("r", F.posexplode_outer("cs").alias("pos", "c")).withColumn("i", identifier(F.col("c"), id_digits))
    marked = each.join(clashing.withColumn("clash", F.lit(True)), "i", "left")
    entry = F.when(F.col("clash"), F.concat(F.lit("="), F.length("c").cast("string"), F.lit(":"), F.col("c"))).otherwise(F.col("i"))
    listed = marked.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("pos", entry.alias("e")))).alias("es"))
    return listed.select("r.doc_id", "r.text_sha256", F.array_join(F.transform("es", lambda x: x["e"]), "").alias("recipe"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts, the one with the smallest ``doc_id``."""
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")).alias("id")
    marks = exact_classes(docs)
    kept = materialize(marks.where("kept or copy > 1").select(key, F.col("text_sha256").alias("sha"), "kept", "copy"))
    keyed = docs.select(whole_row(), key, F.sha2(normalized(F.col("text")), 256).alias("sha"))
    # the small side is hashed, so that the texts are dealt once and never sorted
    stays = keyed.join(kept.where("kept").select("id", "sha").hint("shuffle_hash"), ["id", "sha"], "left_semi")
    again = kept.where("copy > 1").select("id", "sha").distinct()
    if not again.isEmpty():  # rows repeated with their id: one of them stays, and all others need no second look
        once = stays.join(again, ["id", "sha"], "left_anti")
        stays = once.unionByName(stays.join(again, ["id", "sha"], "left_semi").dropDuplicates(["id", "sha"]))
    return stays.select("row.*")
