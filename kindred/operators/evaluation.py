"""Quality of matches against the truth, and validity of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(lists: DataFrame, id_: str, ids: str) -> DataFrame:
    """``s1_id, cand_id`` from comma lists: empty elements dropped, each pair once."""
    return lists.select(F.col(id_).alias("s1_id"), F.explode(F.split(ids, ",")).alias("cand_id")).where("cand_id <> ''").distinct()


def f05(tp: Column, predicted: Column, true: Column) -> Column:
    """F0.5 of one entity; predicting nothing where nothing is true is right."""
    p, r = tp / predicted, tp / true
    return F.when((predicted == 0) & (true == 0), 1.0).when((predicted == 0) | (true == 0) | (tp == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def per_entity(s1_ids: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``s1_id, tp, n_pred, n_true, f05`` for every S1 id; predicted and truth are edges (s1_id, cand_id)."""
    sides = predicted.select("s1_id", "cand_id", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.select("s1_id", "cand_id", F.lit(0).alias("p"), F.lit(1).alias("t")))
    both = sides.groupBy("s1_id", "cand_id").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    sums = both.groupBy("s1_id").agg(F.sum(F.col("p") * F.col("t")).alias("tp"), F.sum("p").alias("n_pred"), F.sum("t").alias("n_true"))
    whole = s1_ids.select("s1_id").join(sums, "s1_id", "left").na.fill(0, ["tp", "n_pred", "n_true"])
    return whole.withColumn("f05", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def macro(entities: DataFrame) -> DataFrame:
    """One row: mean F0.5, mean precision and recall where defined, accuracy on entities without matches."""
    return entities.agg(
        F.avg("f05").alias("macro_f05"), F.avg(F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred"))).alias("mean_precision"),
        F.avg(F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true"))).alias("mean_recall"),
        F.avg(F.when(F.col("n_true") == 0, (F.col("n_pred") == 0).cast("int"))).alias("singleton_accuracy"), F.count_if(F.col("n_true") == 0).alias("singletons"),
    )


def blocking_recall(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: true pairs, how many of them are candidates, and their share."""
    hit = truth.join(candidates.select("s1_id", "cand_id", F.lit(1).alias("hit")).distinct(), ["s1_id", "cand_id"], "left")
    sums = hit.agg(F.count("*").alias("true_pairs"), F.count("hit").alias("found"))
    return sums.withColumn("recall", F.col("found") / F.greatest("true_pairs", F.lit(1)))


def missed_pairs(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    return truth.join(candidates.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs with a column ``label``: whether they are true."""
    marked = pairs.join(truth.select("s1_id", "cand_id", F.lit(True).alias("label")), ["s1_id", "cand_id"], "left")
    return marked.withColumn("label", F.coalesce("label", F.lit(False)))


ID = {"S1": r"^S1-\d+$", "other": r"^S[23]-\d+$"}


def validate(results: DataFrame, known: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``check, violations``: what is wrong with a result table (s1_id, ids).

    ``known`` has every ``entity_id`` and ``src``; ``candidates`` is another table
    (s1_id, ids), which must have exactly the S1 ids too, and of which all matches must be part.
    """
    s1 = known.where("src = 'S1'").select(F.col("entity_id").alias("s1_id"))
    others = known.where("src <> 'S1'").select(F.col("entity_id").alias("cand_id"))
    parts = results.select("s1_id", F.split("ids", ",").alias("list")).where("list <> array('')")
    each = parts.select("s1_id", F.explode("list").alias("cand_id")).where("cand_id <> ''")
    once = each.distinct()
    checks = {
        "duplicate_s1_rows": results.groupBy("s1_id").count().where("count > 1"),
        "empty_elements": parts.where(F.array_contains("list", "")),
        "missing_s1": s1.join(results, "s1_id", "left_anti"),
        "unknown_s1": results.select("s1_id").distinct().join(s1, "s1_id", "left_anti"),
        "malformed_s1": results.where(~F.col("s1_id").rlike(ID["S1"])),
        "repeated_in_row": each.groupBy("s1_id", "cand_id").count().where("count > 1").select("s1_id").distinct(),
        "unknown_match": once.join(others, "cand_id", "left_anti"),
        "two_owners": once.groupBy("cand_id").count().where("count > 1"),
    }
    if candidates is not None:
        checks["missing_candidate_rows"] = s1.join(candidates, "s1_id", "left_anti")
        checks["unknown_candidate_rows"] = candidates.select("s1_id").distinct().join(s1, "s1_id", "left_anti")
        checks["not_candidates"] = once.join(edges(candidates, "s1_id", "ids"), ["s1_id", "cand_id"], "left_anti")
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def summary(results: DataFrame) -> DataFrame:
    """One row: rows, matched ids and rows without a match of a result table (s1_id, ids)."""
    n = F.size(F.filter(F.split("ids", ","), lambda x: x != ""))
    return results.agg(F.count("*").alias("rows"), F.sum(n).alias("matched"), F.count_if(n == 0).alias("empty_rows"))
