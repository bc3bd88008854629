"""Command line: run, tune, dictionary, analyze, check, evaluate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluation
from .plans import linkage
from .sources import tsv


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="kindred")
    ap.add_argument("--data-dir", default="data")
    ap.add_argument("--output-dir", default="output")
    sub = ap.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("--split", choices=["train", "test"], default="train")
    run.add_argument("--matcher", choices=["rules", "ml"], default="rules")
    run.add_argument("--sample", type=int, default=0)
    for flag in ("--evaluate", "--blocking-only", "--collect", "--stream"):
        run.add_argument(flag, action="store_true")
    tune = sub.add_parser("tune")
    tune.add_argument("--matcher", choices=["rules", "ml"], default="rules")
    tune.add_argument("--stages", type=int, choices=[1, 2], default=2)
    tune.add_argument("--eval-sample", type=int, default=0)
    sub.add_parser("dictionary")
    analyze = sub.add_parser("analyze")
    analyze.add_argument("what", choices=["blocking", "matching"])
    analyze.add_argument("--sample", type=int, default=20)
    analyze.add_argument("-n", type=int, default=12)
    analyze.add_argument("--matcher", choices=["rules", "ml"], default="ml")
    check = sub.add_parser("check")
    check.add_argument("--split", choices=["train", "test"], default="test")
    ev = sub.add_parser("evaluate")
    ev.add_argument("predicted")
    ev.add_argument("truth")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("kindred").getOrCreate()
    if a.command == "run":
        print(linkage.run(spark, a.data_dir, a.output_dir, a.split, a.matcher, a.evaluate, a.sample, a.blocking_only, a.collect, stream=a.stream))
    elif a.command == "tune":
        print(linkage.tune(spark, a.data_dir, a.output_dir, a.matcher, a.stages, a.eval_sample))
    elif a.command == "dictionary":
        truth = tsv.read_truth(spark, tsv.data_path(spark, a.data_dir, "train_ground_truth.tsv", "train"))
        learned = linkage.learn_dictionary(tsv.read_all(spark, a.data_dir, "train"), truth)
        print(tsv.save_dictionary(spark, f"{a.output_dir}/translit_dict.json", learned), "tokens")
    elif a.command == "analyze":
        found = linkage.diagnose_blocking(spark, a.data_dir, a.output_dir, a.sample, a.n) if a.what == "blocking" else linkage.diagnose_matching(spark, a.data_dir, a.output_dir, a.matcher, a.n)
        for table in found:
            table.show(200, truncate=False)
    elif a.command == "check":
        table = linkage.check(spark, a.data_dir, a.output_dir, a.split)
        table.show(50, truncate=False)
        return int(table.where("violations > 0").count() > 0)
    else:
        predicted, truth = (tsv.read_truth(spark, p) for p in (a.predicted, a.truth))
        ids = tsv.read_tsv(spark, a.truth).select(F.col("entity_id").alias("s1_id")).distinct()
        evaluation.macro(evaluation.per_entity(ids, predicted.join(ids, "s1_id", "left_semi"), truth)).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
