"""The linkage pipeline end to end: records in, matches out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DECISION_GRID, RULE_GRID, Blocking, Learning, Params
from ..functions.text import normalize_records
from ..operators import blocking, diagnostics, evaluation, features, sampling, scoring, training, translit
from ..sources import tsv
from ..streaming import linkage as streaming


@dataclass
class Linkage:
    """What one run over normalised records computes; each step is lazy."""

    records: DataFrame
    blocking: Blocking = field(default_factory=Blocking)
    params: Params = field(default_factory=Params)
    learning: Learning = field(default_factory=Learning)
    model: training.Model | None = None
    sample: int = 0

    def s1_ids(self) -> DataFrame:
        ids = self.records.where("src = 'S1'").select(F.col("entity_id").alias("s1_id"))
        return ids.where(sampling.hash_sample(F.col("s1_id"), self.sample))

    def candidates(self) -> DataFrame:
        """Candidates of the (sampled) S1 entities; key sizes come from the other side, and so do not hang on the sample."""
        seen = self.records.where((F.col("src") != "S1") | sampling.hash_sample(F.col("entity_id"), self.sample))
        return blocking.candidates(seen, self.blocking)

    def features(self, pairs: DataFrame) -> DataFrame:
        """Features; statistics are those of all records, sampled or not."""
        return features.pair_features(pairs, features.enrich(self.records))

    def scored(self, feats: DataFrame) -> DataFrame:
        if self.model is None:
            return feats.withColumn("score", scoring.rule_score(self.params))
        return training.ml_scores(feats, self.model, self.learning)

    def decided(self, feats: DataFrame) -> DataFrame:
        return scoring.decide(self.scored(feats), self.params)


def true_names(raw: DataFrame, truth: DataFrame, modulus: int = 20) -> DataFrame:
    """``s1_id, cand_id, s1_name, other_name`` of true pairs of S1 entities outside the evaluation sample."""
    s1 = raw.where("src = 'S1'").select(F.col("entity_id").alias("s1_id"), F.col("business_name").alias("s1_name"))
    s1 = s1.where(~sampling.hash_sample(F.col("s1_id"), modulus))
    others = raw.where("src <> 'S1'").select(F.col("entity_id").alias("cand_id"), F.col("business_name").alias("other_name"))
    return truth.join(s1, "s1_id").join(others, "cand_id").select("s1_id", "cand_id", "s1_name", "other_name")


def learn_dictionary(raw: DataFrame, truth: DataFrame, modulus: int = 20) -> DataFrame:
    """A dictionary from true pairs of S1 entities outside the evaluation sample."""
    return translit.learn(translit.alignment_counts(true_names(raw, truth, modulus)))


def run(
    spark: SparkSession, data_dir: str, output_dir: str, split: str = "train", matcher: str = "rules", evaluate: bool = False,
    sample: int = 0, blocking_only: bool = False, collect: bool = False, cfg: Blocking = Blocking(), stream: bool = False, files: int = 8, lists_only: bool = False,
) -> dict:
    """One run; writes candidate_pairs.tsv, matching_results.tsv and, of samples and collected sets, the features.

    With ``stream``, S1 goes by in micro-batches of ``files`` files of its records, and of each only the pairs that can still
    match are kept; results are the same.  With ``lists_only`` the run ends when candidate_pairs.tsv is written.
    """
    if split == "test":
        sample, blocking_only, evaluate, collect = 0, False, False, False
    if collect:
        matcher, evaluate = "ml", True
    dictionary = tsv.load_dictionary(spark, f"{output_dir}/translit_dict.json")
    records = tsv.load_records(spark, data_dir, split, output_dir, dictionary)
    link = Linkage(records, cfg, tsv.load_params(spark, f"{output_dir}/best_params_{matcher}.json"), sample=sample)
    link.model = training.Model.load(f"{output_dir}/model") if matcher == "ml" else None
    stream = stream and not blocking_only and not collect
    kept = _streamed(spark, link, output_dir, split, files) if stream else None
    if not stream:
        link.candidates().write.mode("overwrite").parquet(f"{output_dir}/candidates_{split}")
    pairs, ids = spark.read.parquet(f"{output_dir}/candidates_{split}"), link.s1_ids()
    out: dict = {"pairs": pairs.count(), "s1": ids.count()}
    truth = None
    if split == "train" and (evaluate or blocking_only):
        truth = tsv.read_truth(spark, tsv.data_path(spark, data_dir, "train_ground_truth.tsv", "train")).join(ids, "s1_id", "left_semi")
        out |= evaluation.blocking_recall(truth, pairs).first().asDict()
    if blocking_only:
        return out
    lists = scoring.candidate_lists(ids, pairs).toDF("source1_entity_id", "candidate_entity_ids")
    tsv.write_tsv(_in_order(lists, records), f"{output_dir}/candidate_pairs.tsv")
    if lists_only:
        return out
    feats = link.features(pairs) if kept is None else kept
    if collect:
        labelled = evaluation.labelled(training.stage1_scores(feats, link.model), truth)
        feats = training.training_set(labelled, link.learning).drop("p1")
    if (sample or collect) and kept is None:
        feats.write.mode("overwrite").parquet(f"{output_dir}/features_{split}")
        ids.write.mode("overwrite").parquet(f"{output_dir}/s1_ids_{split}")
        feats = spark.read.parquet(f"{output_dir}/features_{split}")
    if collect:
        return out | feats.agg(F.count("*").alias("kept"), F.sum("weight").alias("effective"), F.count_if("label").alias("true")).first().asDict()
    kept = link.decided(feats) if kept is None else streaming.final(kept, link.params, link.model)
    results = scoring.match_lists(ids, kept).toDF("source1_entity_id", "matched_entity_ids")
    tsv.write_tsv(_in_order(results, records), f"{output_dir}/matching_results.tsv")
    if truth is not None:
        out |= evaluation.macro(evaluation.per_entity(ids, kept.select("s1_id", "cand_id"), truth)).first().asDict()
    return out


def _streamed(spark: SparkSession, link: Linkage, output_dir: str, split: str, files: int) -> DataFrame:
    """The pairs that can still match, from S1's records as a stream; the candidates are written as a batch run writes them."""
    out = f"{output_dir}/stream_{split}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    mine = link.records.where("src = 'S1'").where(sampling.hash_sample(F.col("entity_id"), link.sample))
    mine.write.parquet(f"{out}/s1")
    rows = spark.readStream.schema(link.records.schema).option("maxFilesPerTrigger", files).parquet(f"{out}/s1")
    index = streaming.Index.of(link.records, link.blocking)
    streaming.start(rows, index, out, f"{out}/progress", link.blocking, link.params, model=link.model, learning=link.learning).awaitTermination()
    index.close()
    spark.read.parquet(f"{out}/pairs").drop("batch").write.mode("overwrite").parquet(f"{output_dir}/candidates_{split}")
    return spark.read.parquet(f"{out}/kept").drop("batch")


def _in_order(lists: DataFrame, records: DataFrame) -> DataFrame:
    """Result lists in the order in which S1 came."""
    place = records.where("src = 'S1'").select(F.col("entity_id").alias("source1_entity_id"), "ord")
    return lists.join(place, "source1_entity_id").orderBy("ord").drop("ord")


def tune(spark: SparkSession, data_dir: str, output_dir: str, matcher: str = "rules", stages: int = 2, eval_sample: int = 0, learning: Learning = Learning()) -> tuple[Params, float]:
    """Parameters (and with ml the model) from the features of a sampled or collected run."""
    feats, ids = spark.read.parquet(f"{output_dir}/features_train"), spark.read.parquet(f"{output_dir}/s1_ids_train")
    truth = tsv.read_truth(spark, tsv.data_path(spark, data_dir, "train_ground_truth.tsv", "train"))
    if "label" not in feats.columns:
        feats = evaluation.labelled(feats, truth)
    ids = ids.where(sampling.hash_sample(F.col("s1_id"), eval_sample))
    truth = truth.join(ids, "s1_id", "left_semi")
    start = Params()
    if matcher == "rules":
        seen = feats.join(ids, "s1_id", "left_semi").persist()
        best, value = training.coordinate_ascent(RULE_GRID, start, lambda p: training.macro_f05(seen.withColumn("score", scoring.rule_score(p)), ids, truth, p))
    else:
        oof = training.out_of_fold(feats, learning, stages)
        oof.write.mode("overwrite").parquet(f"{output_dir}/oof_ml")
        seen = spark.read.parquet(f"{output_dir}/oof_ml").join(ids, "s1_id", "left_semi").persist()
        best, value = training.coordinate_ascent(DECISION_GRID, start, lambda p: training.macro_f05(seen, ids, truth, p))
        training.fit(feats, learning, stages).save(f"{output_dir}/model")
    tsv.save_params(spark, f"{output_dir}/best_params_{matcher}.json", best)
    return best, value


def check(spark: SparkSession, data_dir: str, output_dir: str, split: str = "test") -> DataFrame:
    """``check, violations`` of the written result files."""
    results, bad = tsv.read_results(spark, f"{output_dir}/matching_results.tsv", ("source1_entity_id", "matched_entity_ids"))
    lists, worse = tsv.read_results(spark, f"{output_dir}/candidate_pairs.tsv", ("source1_entity_id", "candidate_entity_ids"))
    known = tsv.read_all(spark, data_dir, split).select("entity_id", "src")
    broken = bad.unionByName(worse).agg(F.count("*").alias("violations")).select(F.lit("malformed_lines").alias("check"), "violations")
    return evaluation.validate(results, known, lists).unionByName(broken)


def diagnose_blocking(spark: SparkSession, data_dir: str, output_dir: str, sample: int = 20, n: int = 12, cfg: Blocking = Blocking()) -> tuple[DataFrame, DataFrame]:
    """Causes of missed true pairs with their share, and ``n`` examples of each."""
    records = tsv.load_records(spark, data_dir, "train", output_dir, tsv.load_dictionary(spark, f"{output_dir}/translit_dict.json"))
    pairs = spark.read.parquet(tsv.newest(spark, [f"{output_dir}/candidates_train", f"{output_dir}/features_train"])).select("s1_id", "cand_id")
    truth = tsv.read_truth(spark, tsv.data_path(spark, data_dir, "train_ground_truth.tsv", "train")).where(sampling.hash_sample(F.col("s1_id"), sample))
    causes = diagnostics.miss_causes(evaluation.missed_pairs(truth, pairs), records, cfg)
    return diagnostics.histogram(causes, "cause").orderBy(F.desc("n"), "cause"), shown(tsv.read_all(spark, data_dir, "train"), causes, "cause", n)


def diagnose_matching(spark: SparkSession, data_dir: str, output_dir: str, matcher: str = "ml", n: int = 12) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of wrong decisions, their causes, and ``n`` examples of each cause."""
    truth = tsv.read_truth(spark, tsv.data_path(spark, data_dir, "train_ground_truth.tsv", "train"))
    params = tsv.load_params(spark, f"{output_dir}/best_params_{matcher}.json")
    feats = spark.read.parquet(f"{output_dir}/{'oof_ml' if matcher == 'ml' else 'features_train'}")
    feats = feats if "label" in feats.columns else evaluation.labelled(feats, truth)
    feats = feats if matcher == "ml" else feats.withColumn("score", scoring.rule_score(params))
    decided = mark_kept(feats, scoring.decide(feats, params))
    singles = spark.read.parquet(f"{output_dir}/s1_ids_train").join(truth, "s1_id", "left_anti")
    wrong = diagnostics.errors(decided)
    group = F.concat_ws(": ", "kind", "cause")
    return diagnostics.decision_counts(decided, singles), diagnostics.histogram(wrong, "kind", "cause", within="kind"), shown(tsv.read_all(spark, data_dir, "train"), wrong.withColumn("group", group), "group", n)


def mark_kept(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    marks = kept.select("s1_id", "cand_id", F.lit(True).alias("kept"))
    return pairs.join(marks, ["s1_id", "cand_id"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def shown(raw: DataFrame, pairs: DataFrame, group: str, n: int) -> DataFrame:
    """``n`` pairs of each group with both raw records."""
    key: Column = F.concat_ws("|", "s1_id", "cand_id")
    some = sampling.examples_per_group(pairs, group, key, n).select(group, "s1_id", "cand_id")
    ids = some.select(F.col("s1_id").alias("entity_id")).unionByName(some.select(F.col("cand_id").alias("entity_id"))).distinct()
    texts = diagnostics.raw_lookup(raw, ids)
    return some.join(texts.toDF("s1_id", "left"), "s1_id").join(texts.toDF("cand_id", "right"), "cand_id").select(group, "s1_id", "left", "cand_id", "right")


def from_documents(docs: DataFrame) -> DataFrame:
    """A linkage problem over a table of documents: all of them are records, dealt into three sources by id.

    The name is the first sentence, the address the length and the last line, and the
    country the language.
    """
    src = F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"))
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.concat(src, F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), src.alias("src"),
        F.regexp_extract(text, r"^[^.\n]*", 0).alias("business_name"),
        F.concat(F.length(text).cast("string"), F.lit(" "), F.substring_index(text, "\n", -1)).alias("business_address"),
        F.coalesce("lang", F.lit("")).alias("country"),
    )


def document_records(docs: DataFrame) -> DataFrame:
    return normalize_records(from_documents(docs))


def document_truth(docs: DataFrame) -> DataFrame:
    """``s1_id, cand_id``: records of S1 and of the others with the same text, once in S1 (its smallest id)."""
    marked = docs.select((F.col("doc_id") % 3).alias("r"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    left = marked.where("r = 0").groupBy("h").agg(F.concat(F.lit("S1-"), F.min("doc_id").cast("string")).alias("s1_id"))
    right = marked.where("r <> 0").select("h", F.concat(F.lit("S"), (F.col("r") + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("cand_id"))
    return left.join(right, "h").select("s1_id", "cand_id")
