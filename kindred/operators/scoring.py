"""Scores of candidate pairs, competition between them, and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Params

COMPETITION = ["p1", "s1_max", "s1_gap", "s1_rank", "s1_n50", "c_other", "c_gap", "c_n"]


def name_score() -> Column:
    fuzzy = F.greatest("name_sort", "name_ratio")
    fuzzy = F.when(F.col("translit") == 1, F.greatest(fuzzy, "name_skel")).otherwise(fuzzy)
    fuzzy = F.when(F.col("domain") == 1, F.greatest(fuzzy, "name_partial")).otherwise(fuzzy)
    overlap = F.when(F.col("translit") == 1, F.greatest("name_idf_jacc", "name_skel")).otherwise(F.col("name_idf_jacc"))
    return 0.5 * fuzzy + 0.5 * overlap


def address_score(p: Params) -> Column:
    raw = 0.5 * F.col("addr_idf_jacc") + 0.5 * F.col("addr_sort")
    raw = raw + p.NUM_BONUS * (F.col("num_shared_idf") > 0).cast("int") - p.NUM_PENALTY * F.col("num_conflict")
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def rule_score(p: Params = Params()) -> Column:
    """The weighted blend of name and address, and its two special paths."""
    name, addr = name_score(), address_score(p)
    w = F.when(F.col("translit") == 1, p.W_NAME_TRANSLIT).otherwise(p.W_NAME)
    blend = w * name + (1 - w) * addr
    specific = (F.col("addr_idf_cont") >= p.ADDR_ONLY_CONT) & (F.col("addr_shared_idf") >= p.ADDR_ONLY_IDF)
    lifted = F.when(specific, F.greatest(blend, p.MATCH_THRESHOLD + 0.01 * addr)).otherwise(blend)
    return F.when(F.col("addr_missing") == 1, F.when(name >= p.NAME_ONLY_THRESHOLD, name).otherwise(0.0)).otherwise(lifted)


def s1_competition(df: DataFrame, p1: str = "p1") -> DataFrame:
    """How a pair stands among the pairs of its S1 entity, over all sources."""
    group = W.partitionBy("s1_id")
    return df.withColumns({
        "s1_max": F.max(p1).over(group), "s1_n50": F.sum((F.col(p1) > 0.5).cast("int")).over(group),
        "s1_rank": F.row_number().over(group.orderBy(F.desc(p1), "src", "cand_id")),
    }).withColumn("s1_gap", F.col(p1) - F.col("s1_max"))


def record_competition(df: DataFrame, p1: str = "p1") -> DataFrame:
    """How a pair stands among the S1 entities that claim its record."""
    group = W.partitionBy("src", "cand_id")
    order = group.orderBy(F.desc(p1), "s1_id")
    df = df.withColumns({
        "__rank": F.row_number().over(order), "__next": F.lead(p1).over(order), "__best": F.first(p1).over(order), "c_n": F.count("*").over(group),
    })
    df = df.withColumn("c_other", F.when(F.col("__rank") == 1, F.coalesce("__next", F.lit(0.0))).otherwise(F.col("__best")))
    return df.withColumn("c_gap", F.col(p1) - F.col("c_other")).drop("__rank", "__next", "__best")


def competition(df: DataFrame, p1: str = "p1") -> DataFrame:
    """The eight competition columns; claims are windowed twice, by entity and by record."""
    return record_competition(s1_competition(df, p1), p1)


def one_owner(df: DataFrame, score: str = "score") -> DataFrame:
    """Of the pairs of each record, the best; ties go to the smaller S1 id."""
    rank = F.row_number().over(W.partitionBy("src", "cand_id").orderBy(F.desc(score), "s1_id"))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def within_margin(df: DataFrame, margin: float, score: str = "score") -> DataFrame:
    """Pairs that are no further than the margin from the best of their S1 entity."""
    best = F.max(score).over(W.partitionBy("s1_id"))
    return df.withColumn("__best", best).where(F.col(score) >= F.col("__best") - margin).drop("__best")


def decide(df: DataFrame, p: Params = Params(), score: str = "score") -> DataFrame:
    """Threshold, one owner for each record, margin within each entity."""
    return within_margin(one_owner(df.where(F.col(score) >= p.MATCH_THRESHOLD), score), p.RELATIVE_MARGIN, score)


def match_lists(s1_ids: DataFrame, kept: DataFrame) -> DataFrame:
    """``s1_id, matched_ids``: every S1 id, its matches by descending score and joined by commas."""
    best_first = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "src", "cand_id")))
    lists = kept.groupBy("s1_id").agg(F.array_join(F.transform(best_first, lambda x: x["cand_id"]), ",").alias("matched_ids"))
    return s1_ids.join(lists, "s1_id", "left").select("s1_id", F.coalesce("matched_ids", F.lit("")).alias("matched_ids"))


def candidate_lists(s1_ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """``s1_id, candidate_ids``: every S1 id, its candidates by source and id and joined by commas."""
    ordered = F.sort_array(F.collect_list(F.struct("src", "cand_id")))
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.transform(ordered, lambda x: x["cand_id"]), ",").alias("candidate_ids"))
    return s1_ids.join(lists, "s1_id", "left").select("s1_id", F.coalesce("candidate_ids", F.lit("")).alias("candidate_ids"))
