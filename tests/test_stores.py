"""Stored memos, sweeps that go on, corpora that are scored once, rows that must not vanish or multiply."""

from __future__ import annotations

import glob
import gzip
import hashlib
import os
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import catalog
from wavetally.operators.memo import DIGITS, HASH, memo_todo, stored_memo, update_memo
from wavetally.operators.signal import one_reference_many_estimates, si_sdr
from wavetally.plans.batch import Evaluation, score_transcripts
from wavetally.plans.corpus import evaluate_corpus, store_corpus
from wavetally.plans.sweep import evaluate_sweep, pair_sweep, resume_sweep
from wavetally.session import scratch_dir, shuffle_partitions
from wavetally.sinks.writers import _merge_each, key_of_path, write_texts
from wavetally.sources.readers import checkpoint_folders, read_file_identities, read_hashed_files


def hashed(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id bigint").withColumn(HASH, F.md5(F.col("id").cast("string")))


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}


def test_memo_store_touches_only_its_folders(spark, tmp_path):
    path, payload = str(tmp_path / "memo"), "result string"

    def run(ids, name):
        update_memo(hashed(spark, ids).select(HASH, F.lit(name).alias("result")), path, payload)

    assert stored_memo(spark, path, payload).count() == 0
    run(range(300), "a")
    before = files(path)
    run([5, 1000], "b")
    touched = {r[0][:DIGITS] for r in hashed(spark, [5, 1000]).select(HASH).collect()}
    kept = {f: t for f, t in before.items() if os.path.basename(os.path.dirname(f)).split("=")[1] not in touched}
    assert kept.items() <= files(path).items() and len(kept) < len(before)
    run([], "c")
    rows = {r[HASH]: r["result"] for r in stored_memo(spark, path, payload).collect()}
    digest = {r["id"]: r[HASH] for r in hashed(spark, [5, 7, 1000]).collect()}
    assert len(rows) == 301 and rows[digest[5]] == "a" and rows[digest[1000]] == "b"
    todo = memo_todo(hashed(spark, [7, 1000, 1001, 1001]), stored_memo(spark, path, payload), "id").collect()
    assert [r["id"] for r in todo] == [1001]


def test_memo_probe_reads_only_its_folders(spark, tmp_path):
    path = str(tmp_path / "memo")
    update_memo(hashed(spark, range(300)).select(HASH, F.lit("a").alias("result")), path, "result string")
    probe = stored_memo(spark, path, "result string", hashed(spark, [3]))
    assert len(probe.inputFiles()) > 1  # of the table; the scan is pruned
    plan = probe._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and 1 <= probe.count() < 20


def test_repeats_in_a_sweep_do_not_multiply(spark):
    refs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], "k int, text string")
    preds = spark.createDataFrame(
        [("x", 1, "a"), ("x", 1, "b"), ("x", 2, "b"), ("x", 3, "d"), ("y", 1, "a"), ("y", 9, "z")],
        "checkpoint string, k int, hyp string",
    )
    got = sorted(tuple(r) for r in pair_sweep(refs, preds, "k", ["x", "y"]).select("checkpoint", "k", "status").collect())
    assert got == [
        ("x", 1, "duplicate_key"), ("x", 1, "duplicate_key"), ("x", 2, "duplicate_key"), ("x", 2, "duplicate_key"),
        ("x", 2, "duplicate_key"), ("x", 3, "ok"), ("y", 1, "ok"), ("y", 2, "duplicate_key"), ("y", 2, "duplicate_key"),
        ("y", 3, "missing_prediction"), ("y", 9, "missing_reference"),
    ]
    unasked = pair_sweep(refs, preds, "k").groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in unasked} == {"duplicate_key": 5, "ok": 2, "missing_reference": 1}
    _, summary = evaluate_sweep(refs, preds, score_transcripts, "k", ["cer"], ["x", "y"])
    assert [(r["checkpoint"], r["n"], r["n_rejected"]) for r in summary.collect()] == [("x", 1, 5), ("y", 1, 4)]


def test_many_repeats_of_one_key_in_a_sweep(spark):
    refs = spark.range(2_000).select(F.lit(1).alias("k"), F.lit("a").alias("text"))
    preds = spark.range(2_000).select(F.lit("x").alias("checkpoint"), F.lit(1).alias("k"), F.lit("a").alias("hyp"))
    assert pair_sweep(refs, preds, "k", ["x"]).count() == 4_000


def sweep_files(spark, path, names, n=40):
    ids = spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("hyp"))
    for name in names:
        ids.write.parquet(f"{path}/checkpoint={name}")


def test_sweep_goes_on(spark, tmp_path):
    arrived, stored = str(tmp_path / "predictions"), str(tmp_path / "scores")
    refs = spark.range(40).select(F.col("id").alias("k"), F.lit("word 7").alias("text"))

    def run(score=score_transcripts, **options):
        return resume_sweep(refs, arrived, stored, score, "k", ["cer"], batch_metadata={"dataset": "d"}, **options)

    sweep_files(spark, arrived, ["0010", "10"])
    scores, first = run()
    assert [(r["checkpoint"], r["n"]) for r in first.collect()] == [("0010", 40), ("10", 40)]
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{stored}/*/*.csv")}
    sweep_files(spark, arrived, ["20"])
    asked = []

    def spy(pairs):
        asked.append({r[0] for r in pairs.select("checkpoint").distinct().collect()})
        return score_transcripts(pairs)

    scores, second = run(spy)
    assert set().union(*asked) == {"20"}
    assert before.items() <= {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{stored}/*/*.csv")}.items()
    assert [(r["checkpoint"], r["n"]) for r in second.collect()] == [("0010", 40), ("10", 40), ("20", 40)]
    assert {r["dataset"] for r in scores.collect()} == {"d"} and scores.where("cer = 0").count() == 3
    again = run()[1].collect()
    assert again == second.collect()


def test_sweep_on_a_sample(spark, tmp_path):
    arrived = str(tmp_path / "predictions")
    sweep_files(spark, arrived, ["a", "b"])
    refs = spark.range(40).select(F.col("id").alias("k"), F.lit("word 7").alias("text"))
    scores, _ = resume_sweep(refs, arrived, str(tmp_path / "scores"), score_transcripts, "k", ["cer"], n=10, seed=3)
    keys = {c: {r["k"] for r in scores.where(F.col("checkpoint") == c).collect()} for c in "ab"}
    assert keys["a"] == keys["b"] and len(keys["a"]) == 10 and scores.where("status != 'ok'").count() == 0


def test_corpus_is_scored_once_and_stored(spark, tmp_path):
    corpus = spark.range(60).select(F.col("id").alias("sample_idx"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    preds = corpus.where("sample_idx % 5 > 0").select("sample_idx", F.lit("text 1").alias("hyp"))
    meta = corpus.select("sample_idx", (F.col("sample_idx") % 2).alias("half"))
    options = {"n": 20, "seed": 5, "predictions": preds, "meta": meta, "by": ["half"]}
    evaluation, path = Evaluation(score_transcripts), str(tmp_path / "runs")
    for _ in range(2):  # the same run again replaces its rows
        scores, summary = store_corpus(evaluation, corpus, "sample_idx", ["cer"], path, datetime(2025, 1, 2, 3, 4, 5), **options)
    other, _ = store_corpus(evaluation, corpus, "sample_idx", ["cer"], path, datetime(2025, 1, 2, 3, 4, 6), **{**options, "n": 3})
    assert scores.count() == 20 and other.count() == 3
    assert "PythonUDF" not in summary._jdf.queryExecution().executedPlan().toString()
    assert all("/runs/" in f for f in summary.inputFiles())
    direct = evaluate_corpus(evaluation, corpus, "sample_idx", ["cer"], **options)[1]

    def rows(df):
        return sorted((r["half"], r["n"], r["n_rejected"], round(r["mean"], 9)) for r in df.collect())

    assert rows(summary) == rows(direct)


def test_estimates_without_reference_stay(spark):
    refs = spark.createDataFrame([(1, [1.0, 2.0])], "ref_id int, ref array<double>")
    ests = spark.createDataFrame([(i, r, [1.0, 1.0]) for i, r in enumerate([1, 1, 2, None])], "est_id int, ref_id int, est array<double>")
    scored = si_sdr(one_reference_many_estimates(refs, ests, "ref_id", "est_id", 1, keep_unmatched=True)).collect()
    status = {r["est_id"]: (r["status"], r["si_sdr"] is None) for r in scored}
    assert status == {0: ("ok", False), 1: ("ok", False), 2: ("missing_reference", True), 3: ("missing_reference", True)}


def test_sweep_takes_names_from_folders(spark, tmp_path):
    arrived, stored = str(tmp_path / "predictions"), str(tmp_path / "scores")
    sweep_files(spark, arrived, ["0010"])
    spark.range(3).select(F.col("id").alias("k"), F.lit("x").alias("hyp"), F.lit("a=b/c").alias("checkpoint")).write.mode(
        "append"
    ).partitionBy("checkpoint").parquet(arrived)
    spark.range(0).select(F.col("id").alias("k"), F.lit("x").alias("hyp")).write.parquet(f"{arrived}/checkpoint=empty")
    os.makedirs(f"{arrived}/checkpoint=nothing")
    assert checkpoint_folders(spark, arrived) == ["0010", "a=b/c", "empty"]
    assert checkpoint_folders(spark, stored) == []
    refs = spark.range(3).select(F.col("id").alias("k"), F.lit("x").alias("text"))
    _, summary = resume_sweep(refs, arrived, stored, score_transcripts, "k", ["cer"])
    counts = {r["checkpoint"]: (r["n_ok"], r["n_rejected"]) for r in summary.collect()}
    assert counts == {"0010": (3, 37), "a=b/c": (3, 0), "empty": (0, 3)}
    assert checkpoint_folders(spark, stored) == ["0010", "a=b/c", "empty"]


def test_only_files_of_equal_length_are_hashed(spark, tmp_path):
    texts = {"a": "one", "b": "two", "c": "three", "d": "one", "e": "x" * 5000, "f": "", "g": "seven more"}
    for name, text in texts.items():
        (tmp_path / f"{name}.bin").write_text(text)

    def identities(**options):
        rows = read_file_identities(spark, str(tmp_path), "*.bin", **options).collect()
        return {r["path"][-5]: (r["length"], r["content_md5"]) for r in rows}

    expected = {
        n: (len(t), hashlib.md5(t.encode()).hexdigest() if len(t) == 3 else None) for n, t in texts.items() if t
    }
    assert identities() == expected
    known = spark.createDataFrame([(10,), (77,), (None,)], "length bigint")
    expected["g"] = (10, hashlib.md5(b"seven more").hexdigest())
    assert identities(known=known) == expected
    plan = read_file_identities(spark, str(tmp_path), "*.bin")._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.splitlines() if "FileScan binaryFile" in line]
    with_bytes = [line for line in reads if "content" in line]
    assert len(with_bytes) == 1 and "GreaterThanOrEqual(length,3), LessThanOrEqual(length,3)" in with_bytes[0].replace(" ", "").replace(",L", ", L"), plan


def test_texts_have_a_file_each_in_few_folders(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(300)] + [(7, "more"), (-3, None), (None, "x"), (1000, "")]
    df = spark.createDataFrame(rows, "k bigint, text string").repartition(3)
    where = str(tmp_path / "texts")
    assert write_texts(df, f"file:{where}", "k", "text") == 303
    assert len(os.listdir(where)) <= 4 and not glob.glob(f"{where}/*/.*")
    got = {r["k"]: r["content_md5"] for r in read_hashed_files(spark, where, "*.txt").select(key_of_path("k"), "content_md5").collect()}
    want = {i: {f"text {i}\n"} for i in range(300)} | {-3: {"\n"}, None: {"x\n"}, 1000: {"\n"}}
    want[7] = {"text 7\nmore\n", "more\ntext 7\n"}
    assert got.keys() == want.keys() and all(got[k] in {hashlib.md5(t.encode()).hexdigest() for t in want[k]} for k in want)


def contents(where):
    return {os.path.basename(f): open(f).read() for f in glob.glob(f"{where}/*/*")}


def test_tasks_write_the_texts_they_have(spark, tmp_path):
    where = str(tmp_path / "texts")
    df = spark.range(600).selectExpr("id k", "'text ' || id text").repartition(6)
    assert write_texts(df, where, "k", "text") == 600
    assert sorted(os.listdir(where)) == [f"part-{i:05d}" for i in range(6)]  # before, texts were shuffled to others
    assert contents(where) == {f"k={i}.txt": f"text {i}\n" for i in range(600)}
    assert write_texts(df.limit(0), str(tmp_path / "none"), "k", "text") == 0


def test_texts_go_to_python_in_small_batches(spark, tmp_path, monkeypatch):
    def count(directory, suffix):
        return lambda batches: (
            pa.RecordBatch.from_arrays([pa.array([str(b.num_rows)]), pa.array(["x"])], names=["name", "folder"]) for b in batches
        )

    seen, before = [], spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr("wavetally.sinks.writers._write_each", count)
    monkeypatch.setattr("wavetally.sinks.writers.scratch_dir", lambda s, name: seen.append(scratch_dir(s, name)) or seen[-1])
    monkeypatch.setattr("wavetally.sinks.writers._merge_each", lambda *_: lambda b: iter(()))
    write_texts(spark.range(2500, numPartitions=1).selectExpr("id k", "'x' text"), str(tmp_path), "k", "text")
    assert sorted(int(r["name"]) for r in spark.read.parquet(seen[0]).collect()) == [500, 1000, 1000]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_texts_of_a_key_in_several_tasks_share_a_file(spark, tmp_path):
    where = str(tmp_path / "texts")
    rows = spark.range(4000, numPartitions=8).selectExpr("if(id % 100 = 99, null, id % 100) k", "string(id) text")
    alone = spark.range(5000, 5050, numPartitions=2).selectExpr("id k", "string(id) text")
    assert write_texts(rows.unionByName(alone), where, "k", "text") == 150
    lines = {name: sorted(text.splitlines()) for name, text in contents(where).items()}
    want = {f"k={i if i < 99 else 'null'}.txt": sorted(str(j) for j in range(i, 4000, 100)) for i in range(100)}
    assert lines == want | {f"k={i}.txt": [str(i)] for i in range(5000, 5050)}
    assert len(glob.glob(f"{where}/*/*")) == 150 and not glob.glob(f"{where}/*/.*")


def test_merging_may_be_tried_again(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part-{i}").mkdir()
        (tmp_path / f"part-{i}" / "k=1.txt").write_text(f"{i}\n")
    found = spark.createDataFrame([("k=1", ["part-0", "part-1", "part-2"])], "name string, folders array<string>").coalesce(1)

    def merge():
        return found.mapInArrow(_merge_each(str(tmp_path), ".txt"), "n bigint").agg(F.sum("n")).first()[0]

    assert merge() == 2 and contents(tmp_path) == {"k=1.txt": "0\n1\n2\n"}
    (tmp_path / "part-2" / "k=1.txt").write_text("2\n")  # as if the first attempt had ended before
    assert merge() == 2 and glob.glob(f"{tmp_path}/part-*/*") == []
    assert contents(tmp_path) == {"k=1.txt": "0\n1\n2\n"}


def test_files_are_listed_once(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.bin").write_text("one" if name < "c" else "three")
    plan = read_file_identities(spark, str(tmp_path), "*.bin")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan binaryFile") == 1  # of the bytes; before, four more for the lengths


def odd_tree(top):
    names = ["a.txt", "b.bin", "x,y.txt", ".hidden.txt", "_tmp.txt", "_k=v.txt", "_metadata.txt", "c.txt._COPYING_",
             "in the/deep er/50%25 #1?.txt", "k=1/zip.txt.gz", "k=1/k=2/d.txt", ".dot/e.txt", "_under/f.txt",
             "_k=3/g.txt", "_metadata/h.txt"]
    for i, name in enumerate(names):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(gzip.compress(b"x") if name.endswith("gz") else b"\x00\xff%d\n" % i)
    (top / "empty.txt").touch()
    (top / "k=1" / "none").mkdir()
    (top / "long.txt").write_bytes(b"0123456789" * 300_000)
    (top / "link").symlink_to(top / "k=1")
    (top / "linked.txt").symlink_to(top / "a.txt")
    (top / "gone.txt").symlink_to(top / "nowhere")


def spark_scan(spark, path, pattern):
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return sorted(scan.load(path).select("path", "length", F.md5("content").alias("content_md5")).collect())


def test_tasks_list_the_files_that_sparks_scan_lists(spark, tmp_path):
    top = tmp_path / "a tree%20"
    odd_tree(top)
    for pattern in ("*", "*.txt", "*.{bin,gz}", "[!a-c]*.txt", "?.txt", "x,y.*", "a\\.txt", "*.t?t*", "nothing"):
        files = read_hashed_files(spark, str(top), pattern)
        assert files.schema == spark.createDataFrame([], "path string, length bigint, content_md5 string").schema
        assert sorted(files.collect()) == spark_scan(spark, str(top), pattern), pattern
    assert len(read_hashed_files(spark, str(top)).collect()) == 13
    for where in (f"file:{top}", f"file://{top}/", f"{top}/k=*", f"{top}/a.txt", f"{top}/*.txt", f"{top}/k=1/none"):
        assert sorted(read_hashed_files(spark, where).collect()) == spark_scan(spark, where, "*"), where
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_hashed_files(spark, f"{top}/nowhere")


def test_driver_and_tasks_do_not_grow_with_the_files(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"{i}.bin").write_text(f"text {i}")
    files = read_hashed_files(spark, str(tmp_path), "*.bin")
    assert not files.inputFiles()  # before, the driver held all 200
    assert files.rdd.getNumPartitions() == shuffle_partitions(spark)
    assert files.select("path", "content_md5").distinct().count() == 200


def test_stores_that_python_cannot_open_are_scanned_by_spark(spark, tmp_path, monkeypatch):
    (tmp_path / "a.bin").write_text("one")

    def refuse(directory):
        raise OSError("no library for this store")

    monkeypatch.setattr("wavetally.sources.readers.filesystem", refuse)
    files = read_hashed_files(spark, str(tmp_path))
    assert len(files.inputFiles()) == 1 and [r["length"] for r in files.collect()] == [3]


def test_queries_on_files_make_no_folder_for_each_row(spark, tmp_path, monkeypatch):
    made = []

    def spy(session, name):
        made.append(scratch_dir(session, name))
        return made[-1]

    monkeypatch.setattr("catalog.storage.scratch_dir", spy)
    monkeypatch.setattr("catalog.batch.scratch_dir", spy)
    tables = str(tmp_path)
    spark.range(200).selectExpr("id doc_id", "string(id) text").write.parquet(f"{tables}/documents.parquet")
    spark.range(0, 200, 2).selectExpr("id doc_id").write.parquet(f"{tables}/labels.parquet")
    spark.range(200).selectExpr("id page_id", "string(id) html").write.parquet(f"{tables}/pages.parquet")
    assert sorted(r["doc_id"] for r in catalog.QUERIES["file_memo"](spark, tables).collect()) == list(range(1, 200, 2))
    assert catalog.QUERIES["file_identities"](spark, tables).where("content_md5 is not null").count() == 200
    folders = [len(os.listdir(p)) for p in made if "/texts-" in p or "/pages-" in p]
    assert len(folders) == 2 and max(folders) <= 4


def test_dealt_pairs_give_the_same_scores(spark):
    pairs = spark.createDataFrame([(i, "a b c"[: i % 6], "a c") for i in range(50)], "k int, text string, hyp string")
    pairs = pairs.withColumn("status", F.lit("ok")).coalesce(1)
    dealt = score_transcripts(pairs, tasks=7)
    assert dealt.rdd.getNumPartitions() == 7
    assert sorted(map(str, dealt.collect())) == sorted(map(str, score_transcripts(pairs).collect()))
