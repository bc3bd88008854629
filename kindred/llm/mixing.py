"""Mixing sources to target weights.

A source's share of the corpus' tokens is raised to an exponent and renormalised; an
exponent of 1 keeps the natural mixture, 0 makes all sources equal.  The exponent is
found by bisection: the largest whose mixture has the target entropy, raised again
where a source would be repeated more often than the limit allows.  The weights then
become token budgets, and each budget a prefix of a permutation of the source's
documents: blocks of documents are permuted anew in every epoch, documents keep a
hashed order within their block, and the prefix ends with the document that begins
before the budget does.

Alike rows (one doc_id, source and text) are counted first, and travel as one row with
their number.  Where the sources are too many to hold, the exponent is found by jobs over
the table of sources, each of which tries several exponents.

Cases: a null text has no tokens; documents without tokens take no room, and stand in
one epoch as long as their place begins before the budget's end.  Null sources are one
source, named the empty string.  A null doc_id is placed by its text.  Repeated rows are
rows of their own, one after the other.  Ties in the hashed order go to the smaller
doc_id, then to the shorter text, then to the text of smaller hash.  A very long text is
one document of its block, and may run over the budget's end.  A table without tokens
gives no rows.  Other columns pass through ``mix`` untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, whole_row, word_count

#: Entropy of the mixture, as a part of that of equal weights.
TARGET_ENTROPY = 0.97
#: Most epochs of one source.
MAX_EPOCHS = 4.0
#: Tokens in a block of the permutation, about.
BLOCK_TOKENS = 100_000
#: Sources that the driver may hold; the exponent for more is found by jobs over their table.
MAX_SOURCES = 100_000
STEPS = 60
#: Exponents that one such job tries, and jobs of one search: together they halve as often as ``STEPS``.
WAYS, JOBS = 15, 15


def weights_at(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    total = sum(tokens.values())
    powered = {s: math.pow(n / total, exponent) for s, n in sorted(tokens.items()) if n > 0}
    norm = math.fsum(powered.values())
    return {s: p / norm for s, p in powered.items()}


def entropy(weights: dict[str, float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def _bisect(fits, lo: float = 0.0, hi: float = 1.0) -> float:
    """The end of [lo, hi] up to which ``fits`` holds, as far as it holds at ``lo``."""
    if fits(hi):
        return hi
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if fits(mid) else (lo, mid)
    return lo


def solve(tokens: dict[str, int], budget: int, target_entropy: float, max_epochs: float) -> tuple[float, dict[str, float]]:
    """The exponent and the weights.  If even natural shares repeat too often, natural shares."""
    tokens = {s: n for s, n in tokens.items() if n > 0}
    if not tokens:
        return 1.0, {}
    goal = target_entropy * math.log(len(tokens))
    exponent = _bisect(lambda x: entropy(weights_at(tokens, x)) >= goal)

    def repeats(x: float) -> bool:
        return any(budget * w > max_epochs * tokens[s] for s, w in weights_at(tokens, x).items())

    if repeats(exponent):
        lo, hi = exponent, 1.0
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if repeats(mid) else (lo, mid)
        exponent = hi
    return exponent, weights_at(tokens, exponent)


def solve_table(sums: DataFrame, total: int, budget: int, target_entropy: float, max_epochs: float) -> tuple[float, float]:
    """``solve`` over a table ``source, tokens`` of any size: the exponent, and the norm of the powered shares."""
    share = F.col("tokens") / F.lit(float(total))

    def measured(exponents: list[float]) -> list[tuple[float, bool, float]]:
        """For each exponent the entropy, whether a source repeats too often, and the norm."""
        wanted = []
        for i, x in enumerate(exponents):
            power = F.pow(share, F.lit(x))
            wanted += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log(share)).alias(f"l{i}"), F.max(F.pow(share, F.lit(x - 1))).alias(f"m{i}")]
        got = sums.agg(*wanted).first()
        return [
            (math.log(got[f"z{i}"]) - x * got[f"l{i}"] / got[f"z{i}"], budget * got[f"m{i}"] > max_epochs * total * got[f"z{i}"], got[f"z{i}"])
            for i, x in enumerate(exponents)
        ]

    def last(fits, lo: float, hi: float) -> tuple[float, float]:
        """The interval around the end of ``fits``, which holds at ``lo`` and not at ``hi``."""
        for _ in range(JOBS):
            tried = [lo + (hi - lo) * k / (WAYS + 1) for k in range(1, WAYS + 1)]
            good = [fits(x) for x in measured(tried)]
            first = good.index(False) if False in good else WAYS
            lo, hi = (tried[first - 1] if first else lo), (tried[first] if first < WAYS else hi)
        return lo, hi

    goal = target_entropy * math.log(sums.count())
    exponent = 1.0 if measured([1.0])[0][0] >= goal else last(lambda x: x[0] >= goal, 0.0, 1.0)[0]
    if measured([exponent])[0][1]:
        exponent = 1.0 if exponent == 1.0 or measured([1.0])[0][1] else last(lambda x: x[1], exponent, 1.0)[1]
    return exponent, measured([exponent])[0][2]


def _hashed(*parts) -> Column:
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, 16)


def _shares(sums: DataFrame, budget_tokens: int | None, target_entropy: float, max_epochs: float, block_tokens: int) -> DataFrame | None:
    """``source, tokens, budget, blocks`` of the sources with tokens; null if there are none."""
    spark = sums.sparkSession
    found = sums.where("tokens > 0").limit(MAX_SOURCES + 1).collect()
    if not found:
        return None
    if len(found) <= MAX_SOURCES:
        tokens = {r["source"]: int(r["tokens"]) for r in found}
        total = sum(tokens.values())
        budget = total if budget_tokens is None else budget_tokens
        _, weights = solve(tokens, budget, target_entropy, max_epochs)
        return F.broadcast(spark.createDataFrame(
            [(s, tokens[s], math.floor(budget * w), -(-tokens[s] // block_tokens)) for s, w in weights.items()],
            "source string, tokens long, budget long, blocks long",
        ))  # MAX_SOURCES rows at most
    sums = materialize(sums.where("tokens > 0").select("source", "tokens"))
    total = int(sums.agg(F.sum("tokens")).first()[0])
    budget = total if budget_tokens is None else budget_tokens
    exponent, norm = solve_table(sums, total, budget, target_entropy, max_epochs)
    weight = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent)) / F.lit(norm)
    return sums.select("source", "tokens", F.floor(F.lit(float(budget)) * weight).alias("budget"), F.ceil(F.col("tokens") / F.lit(block_tokens)).alias("blocks"))


def plan(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, source, n_tokens, copy, epoch, block, start``: the documents each budget takes.

    ``copy`` numbers rows with one doc_id and source; ``start`` is the place of the
    document's first token in its source's stream over all epochs.  Options are those of
    ``_placed``.
    """
    found = _placed(docs, **options)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, source string, n_tokens long, copy long, epoch long, block long, start long")
    each = found.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken") - 1)))
    return each.select(
        "doc_id", "source", "n_tokens", (F.col("earlier") + F.col("c") + 1).alias("copy"), "epoch", "block", (F.col("first") + F.col("c") * F.col("n_tokens")).alias("start")
    )


def _placed(
    docs: DataFrame, budget_tokens: int | None = None, target_entropy: float = TARGET_ENTROPY,
    max_epochs: float = MAX_EPOCHS, block_tokens: int = BLOCK_TOKENS, seed: str = "mix",
) -> DataFrame | None:
    """A row for each epoch of each group of alike rows, of which some are taken; null without tokens.

    ``copies`` is the number of alike rows, ``taken`` how many of them the budget takes
    in this epoch, ``first`` where the first of them begins, and ``earlier`` how many
    rows with this doc_id come before in the block.  ``budget_tokens`` is the size of the
    mixture (null: that of the corpus).
    """
    # the texts are read once, for their lengths and hashes
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        word_count(F.col("text")).alias("n_tokens"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.md5(F.concat_ws(":", F.lit(seed), name)).alias("h"),
    )
    alike = materialize(rows.groupBy("doc_id", "source", "n_tokens", "th", "h").agg(F.count("*").alias("copies")))
    sums = alike.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    shares = _shares(sums, budget_tokens, target_entropy, max_epochs, block_tokens)
    if shares is None:
        return None
    # blocks: a hash of the id deals a source's documents into as many as its tokens need
    spot = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    dealt = alike.join(shares, "source").withColumn("block", spot % F.col("blocks")).withColumn("size", F.col("n_tokens") * F.col("copies"))
    sizes = dealt.groupBy("source", "block").agg(F.sum("size").alias("size"), F.first("tokens").alias("tokens"), F.first("budget").alias("budget"))
    # where a block begins, in two levels: the sums of ranges of the hashed order, then the blocks of a range
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("greatest(budget - 1, 0) div tokens")))
    order = _hashed(F.lit(seed), F.col("epoch"), F.col("block"))
    turns = sizes.withColumn("epoch", epochs).withColumn("order", order).withColumn("range", F.substring("order", 1, 3))
    ranges = turns.groupBy("source", "epoch", "range").agg(F.sum("size").alias("whole"))
    ranges = ranges.withColumn("below", F.sum("whole").over(W.partitionBy("source", "epoch").orderBy("range")) - F.col("whole")).drop("whole")
    within = F.sum("size").over(W.partitionBy("source", "epoch", "range").orderBy("order", "block")) - F.col("size")
    offsets = (
        turns.withColumn("within", within).join(ranges, ["source", "epoch", "range"])
        .withColumn("base", F.col("epoch") * F.col("tokens") + F.col("below") + F.col("within"))
        .where("base < budget").select("source", "block", "epoch", "base")
    )
    # a document's place in its block is the same in every epoch: one sort of a block, of bounded size
    inside = W.partitionBy("source", "block").orderBy("h", "doc_id", "n_tokens", "th")
    ranked = (
        dealt.withColumn("rank", F.row_number().over(inside))
        .withColumn("before", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("earlier", F.sum("copies").over(W.partitionBy("source", "block", "doc_id").orderBy("rank")) - F.col("copies"))
    )
    first = F.col("base") + F.col("before")
    fit = F.when(F.col("n_tokens") == 0, F.col("copies")).otherwise(F.least("copies", F.ceil((F.col("budget") - F.col("first")) / F.greatest("n_tokens", F.lit(1)))))
    return (
        ranked.join(offsets, ["source", "block"]).withColumn("first", first).where("first < budget")
        .select("doc_id", "source", "n_tokens", "th", "copies", "epoch", "block", "first", "earlier", fit.cast("long").alias("taken"))
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it, in no order."""
    found = _placed(docs, **options)
    if found is None:
        return docs.limit(0)
    keys = [F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src")]
    times = materialize(found.select(*keys, "th", "copies", "taken").groupBy("id", "src", "th").agg(F.max("copies").alias("copies"), F.sum("taken").alias("times")))
    names = ["id", "src", "th"]
    rowed = docs.select(whole_row(), *keys, F.xxhash64(F.col("text").cast("string")).alias("th"))
    # the small side is hashed, so that the texts are dealt once and never sorted
    joined = rowed.join(times.hint("shuffle_hash"), names).withColumn("more", F.expr("times % copies"))
    even = joined.where("more = 0").select("row", F.expr("times div copies").alias("each"))
    if not times.where("times % copies > 0").isEmpty():
        # of r alike rows that are taken t times in all, the first t mod r are taken once more than the others
        alike = W.partitionBy(*names).orderBy("times")
        odd = joined.where("more > 0").withColumn("at", F.row_number().over(alike))
        even = even.unionByName(odd.select("row", F.expr("times div copies + if(at <= more, 1, 0)").alias("each")))
    return even.where("each > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "each"))).select("row.*")
