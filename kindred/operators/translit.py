"""Learning a dictionary of Indic tokens from true pairs whose names have equally many tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import has_indic, script_tokens

MIN_COUNT, MIN_SHARE = 2, 0.6


def alignment_counts(pairs: DataFrame) -> DataFrame:
    """``x, y, c`` from pairs (other_name, s1_name): how often Indic token x stands where y does."""
    both = pairs.where(has_indic(F.col("other_name"))).select(script_tokens(F.col("other_name")).alias("xs"), script_tokens(F.col("s1_name")).alias("ys"))
    both = both.where("size(xs) = size(ys)").select(F.explode(F.arrays_zip("xs", "ys")).alias("z"))
    both = both.where(has_indic(F.col("z.xs")) & ~has_indic(F.col("z.ys")))
    return both.groupBy(F.col("z.xs").alias("x"), F.lower("z.ys").alias("y")).agg(F.count("*").alias("c"))


def learn(counts: DataFrame, min_count: int = MIN_COUNT, min_share: float = MIN_SHARE) -> DataFrame:
    """``token, english``: the commonest y of each x, seen often enough and with enough of x's share; ties by y."""
    best = F.row_number().over(W.partitionBy("x").orderBy(F.desc("c"), "y"))
    total = F.sum("c").over(W.partitionBy("x"))
    ranked = counts.withColumns({"rank": best, "total": total})
    return ranked.where((F.col("rank") == 1) & (F.col("c") >= min_count) & (F.col("c") / F.col("total") >= min_share)).select(F.col("x").alias("token"), F.col("y").alias("english"))
