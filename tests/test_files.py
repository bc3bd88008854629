import json

import pytest
from pyspark.sql import functions as F

from kindred.__main__ import main
from kindred.config import Learning
from kindred.functions.text import normalize_records
from kindred.plans import linkage
from kindred.sources import tsv
from kindred.streaming import linkage as stream

HEADER = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
TOWNS = ["Salem", "Dover", "Austin", "Boise", "Tulsa", "Provo", "Fargo", "Macon"]
KINDS = ["Bakery", "Motors", "Foods", "Textiles", "Optics", "Marine", "Timber", "Paper"]


def write(folder, split):
    (folder / f"data_{split}").mkdir(parents=True)
    s1, s2, s3, truth = [], [], [], ["source1_entity_id\tmatched_entity_ids\n"]
    for i in range(64):
        name, town, num = f"{TOWNS[i % 8]}ine {KINDS[i // 8]}", TOWNS[(i * 3) % 8], 100 + 7 * i
        s1.append(f"S1-{i}\t{name} Inc\t{num} {town} Street\tUS\n")
        if i % 4:
            s2.append(f"S2-{i}\t{name.upper()} Incorporated\t{num} {town} St\tUS\n")
            truth.append(f"S1-{i}\tS2-{i}" + (f",S3-{i}" if i % 4 == 1 else "") + "\n")
        else:
            truth.append(f"S1-{i}\t\n")
        if i % 4 == 1:
            s3.append(f'S3-{i}\t{name} "Co"\t\tUS\n')
    for n, rows in ((1, s1), (2, s2), (3, s3)):
        (folder / f"data_{split}" / f"{split}_source{n}.tsv").write_text(HEADER + "".join(rows))
    (folder / f"data_{split}" / "train_ground_truth.tsv").write_text("".join(truth))


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    data, out = tmp_path_factory.mktemp("data"), tmp_path_factory.mktemp("out")
    write(data, "train")
    write(data, "test")
    return str(data), str(out)


def test_fields_are_taken_as_they_stand(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text(HEADER + 'S1-1\ta "b\\c\tNA\t\nS1-2\t\tnull\tin\n')
    rows = [tuple(r) for r in tsv.read_tsv(spark, str(path)).collect()]
    assert rows == [("S1-1", 'a "b\\c', "NA", ""), ("S1-2", "", "null", "in")]
    tsv.write_tsv(tsv.read_tsv(spark, str(path)), str(tmp_path / "y"))
    assert sorted(tuple(r) for r in tsv.read_tsv(spark, str(tmp_path / "y")).collect()) == rows


def test_paths_params_and_cache(spark, folders, tmp_path):
    data, out = folders
    assert tsv.data_path(spark, data, "train_source1.tsv", "train").endswith("data_train/train_source1.tsv")
    (tmp_path / "flat.tsv").write_text("x")
    assert tsv.data_path(spark, str(tmp_path), "flat.tsv", "train") == f"{tmp_path}/flat.tsv"
    tsv.save_params(spark, f"{tmp_path}/sub/p.json", tsv.load_params(spark, str(tmp_path / "none.json")).with_(W_NAME=0.4))
    assert tsv.load_params(spark, f"file://{tmp_path}/sub/p.json").W_NAME == 0.4
    first = tsv.load_records(spark, data, "train", out)
    assert first.count() == tsv.load_records(spark, data, "train", out).count() == 64 + 48 + 16
    assert tsv.cache_name(spark, data, "train", {}) != tsv.cache_name(spark, data, "train", {"a": "b"})
    learned = spark.createDataFrame([("जैन", "jain")], "token string, english string")
    assert tsv.save_dictionary(spark, str(tmp_path / "d.json"), learned) == 1
    assert tsv.load_dictionary(spark, str(tmp_path / "d.json")) == {"जैन": "jain"} and tsv.load_dictionary(spark, "nowhere") == {}


def test_run_tune_check_and_diagnose(spark, folders):
    data, out = folders
    got = linkage.run(spark, data, out, evaluate=True)
    assert got["recall"] == 1.0 and got["macro_f05"] > 0.8 and got["singleton_accuracy"] > 0.8
    assert {r["violations"] for r in linkage.check(spark, data, out, "train").collect()} == {0}
    written = [r["s1_id"] for r in tsv.read_results(spark, f"{out}/matching_results.tsv", ("source1_entity_id", "matched_entity_ids"))[0].collect()]
    assert written == [f"S1-{i}" for i in range(64)]  # as they came
    sampled = linkage.run(spark, data, out, evaluate=True, sample=1)
    assert sampled["macro_f05"] == got["macro_f05"]
    small = Learning(trees=3, rate=0.5, depth=2)
    best, value = linkage.tune(spark, data, out, "ml", learning=small)
    assert 0 < value <= 1 and json.load(open(f"{out}/best_params_ml.json"))["MATCH_THRESHOLD"] == best.MATCH_THRESHOLD
    ml = linkage.run(spark, data, out, matcher="ml", evaluate=True)
    assert ml["macro_f05"] > 0.7
    counts, causes, examples = linkage.diagnose_matching(spark, data, out, "rules", 2)
    assert counts.first()["kept"] > 0 and set(causes.columns) == {"kind", "cause", "n", "percent"} and "left" in examples.columns
    causes, _ = linkage.diagnose_blocking(spark, data, out, sample=0)
    assert causes.count() == 0
    collected = linkage.run(spark, data, out, collect=True)
    assert collected["true"] == 64 and collected["effective"] >= collected["kept"]


def test_strict_reading_reports_bad_lines(spark, tmp_path):
    path = tmp_path / "r.tsv"
    path.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nbroken\nS1-2\ta\tb\n")
    rows, bad = tsv.read_results(spark, str(path), ("source1_entity_id", "matched_entity_ids"))
    assert [tuple(r) for r in rows.collect()] == [("S1-1", "S2-1")] and bad.count() == 2
    assert tsv.read_results(spark, str(path), ("other", "header"))[1].where("problem = 'header missing'").count() == 1


def test_command_line(spark, folders, capsys):
    data, out = folders
    at = ["--data-dir", data, "--output-dir", out]
    assert main([*at, "run", "--split", "test"]) == 0
    assert main([*at, "check", "--split", "test"]) == 0
    assert main([*at, "dictionary"]) == 0
    truth = f"{data}/data_train/train_ground_truth.tsv"
    assert main([*at, "evaluate", truth, truth]) == 0
    assert "1.0" in capsys.readouterr().out


def results(spark, out):
    rows = tsv.read_results(spark, f"{out}/matching_results.tsv", ("source1_entity_id", "matched_entity_ids"))[0]
    lists = tsv.read_results(spark, f"{out}/candidate_pairs.tsv", ("source1_entity_id", "candidate_entity_ids"))[0]
    return [tuple(r) for r in rows.collect()], [tuple(r) for r in lists.collect()]


@pytest.mark.parametrize("matcher", ["rules", "ml"])
def test_stream_gives_what_the_batch_run_gives(spark, folders, matcher):
    """However the stream is cut: files of the first source one by one, against the whole run."""
    data, out = folders
    if matcher == "ml":
        linkage.run(spark, data, out, sample=1)
        linkage.tune(spark, data, out, "ml", learning=Learning(trees=3, rate=0.5, depth=2))
    linkage.run(spark, data, out, matcher=matcher)
    whole = results(spark, out)
    got = linkage.run(spark, data, out, matcher=matcher, evaluate=True, stream=True, files=1)
    assert results(spark, out) == whole and got["macro_f05"] > 0.7
    assert sum(1 for _, ids in whole[0] if ids) >= 40


def test_stream_in_several_batches(spark, folders, tmp_path):
    data, _ = folders
    records = normalize_records(tsv.read_all(spark, data, "train")).persist()
    for k in range(3):
        records.where("src = 'S1'").where(F.crc32(F.col("entity_id").cast("binary")) % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream.start(rows, stream.Index.of(records), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    kept = spark.read.parquet(f"{tmp_path}/out/kept")
    assert kept.select("batch").distinct().count() == 3
    link = linkage.Linkage(records)
    batch = {(r["s1_id"], r["cand_id"], round(r["score"], 9)) for r in link.decided(link.features(link.candidates())).collect()}
    assert {(r["s1_id"], r["cand_id"], round(r["score"], 9)) for r in stream.final(kept).collect()} == batch
