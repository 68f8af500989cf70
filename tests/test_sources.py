import json
import subprocess

import pytest
from pyspark.sql import functions as F

from quarry import plugins
from quarry.operators import chunking
from quarry.plans import evaluation, retrieval
from quarry.settings import Settings, read_env_file
from quarry.sources import files, records, store
from quarry.streaming import updates


@pytest.fixture
def tree(tmp_path):
    put = lambda p, b: ((tmp_path / p).parent.mkdir(parents=True, exist_ok=True), (tmp_path / p).write_bytes(b))
    put("keep.py", b"def f():\n    return 1\n")
    put("sub/other.go", b"package main\n")
    put("app.min.js", b"x")
    put("package-lock.json", b"{}")
    put("blob.py", b"a\0b")
    put("node_modules/dep.js", b"x")
    put("data.unknownext", b"x")
    put("runme", b"#!/usr/bin/env python3\nprint(1)\n")
    put("long.py", b"x\n" * 50)
    put("ignored.py", b"x = 1\n")
    put("build_out/y.py", b"x = 1\n")
    put(".gitignore", b"ignored.py\nbuild_out/\n# note\n")
    return tmp_path


def test_scan(spark, tree):
    got = {r["file_path"]: r["language"] for r in files.scan(spark, str(tree)).collect()}
    assert got == {"keep.py": "python", "sub/other.go": "go", "runme": "python", "long.py": "python"}
    assert files.scan(spark, str(tree), max_lines=10).where("file_path = 'long.py'").count() == 0
    assert files.scan(spark, str(tree), max_bytes=50).where("file_path = 'long.py'").count() == 0
    assert {r["file_path"] for r in files.scan(spark, str(tree), languages=["go"]).collect()} == {"sub/other.go"}


def test_scan_opens_no_skipped_file(spark, tmp_path):
    root = tmp_path / "build" / "a b"  # a skipped name above the root, and one that a URI escapes
    for name in ("x.py", "sub/y.py", "node_modules/deep/z.js", "sub/.tox/w.py", "go.sum"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x = 1\n")
    found = files.scan(spark, str(root))
    assert {r["file_path"] for r in found.collect()} == {"x.py", "sub/y.py"}
    plan = found._jdf.queryExecution().executedPlan()
    found._jdf.queryExecution().toRdd().count()
    assert plan.collectLeaves().apply(0).metrics().apply("numFiles").value() == 2


def test_revision(tree):
    assert files.revision(str(tree)) is None
    subprocess.run(["git", "-C", str(tree), "init", "-q"], check=True)
    subprocess.run(["git", "-C", str(tree), "-c", "user.name=a", "-c", "user.email=a@b", "commit", "-q", "--allow-empty", "-m", "x"], check=True)
    assert len(files.revision(str(tree))) == 40


def test_records(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('// note\n\n{"id": "q1", "question": "Where?", "relevant_files": ["a.py"], "holdout": true}\n{"id": "q2", "question": "How?"}\n{"question": "no id"}\n')
    assert records.golden(spark, str(tmp_path / "g.jsonl")).count() == 2 and records.golden(spark, str(tmp_path / "g.jsonl"), False).count() == 1
    rows = [{"docstring": "adds", "code": "a+b"}, {"query": "", "doc": "x", "function": "f"}, {"query": "only"}, {"func_documentation_string": ["two", "words"], "whole_func_string": "g"}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert sorted((r["query"], r["code"]) for r in records.code_pairs(spark, str(tmp_path / "p.jsonl")).collect()) == [("adds", "a+b"), ("two words", "g"), ("x", "f")]
    rows = [{"task_id": 1, "id": 7, "prompt": "p", "canonical_solution": "c"}, {"question": "q", "answer": "a", "positives": ["x", "y"]}]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = {r["query"]: (r["id"], r["doc"], r["relevant_ids"]) for r in records.bench(spark, str(tmp_path / "b.jsonl")).collect()}
    assert got["p"] == ("7", "c", ["7"]) and got["q"][1:] == ("a", ["x", "y"])


def test_save_and_load(spark, tree, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    chunks = chunking.chunks(chunking.parse_files(files.scan(spark, str(tree))))
    store.save(spark, path, {"chunks": chunks}, Settings(final_k=3))
    tables, settings = store.load(spark, path)
    assert settings.final_k == 3 and tables["chunks"].count() == chunks.count() and set(tables) == {"chunks"}
    spark.createDataFrame([(99, "r", "s", "{}")], "version int, repo string, git_sha string, settings string").write.mode("overwrite").parquet(f"{path}/meta")
    with pytest.raises(RuntimeError):
        store.load(spark, path)


def test_golden_update(tmp_path):
    path = str(tmp_path / "g.jsonl")
    (tmp_path / "g.jsonl").write_text('{"id": "own"}\n')
    for rows in ([{"id": "a"}], [{"id": "b"}]):
        store.update_golden(path, rows)
    text = (tmp_path / "g.jsonl").read_text()
    assert '"own"' in text and '"b"' in text and '"a"' not in text
    out = store.save_results(str(tmp_path), "# x", [{"a": 1}], "now")
    assert json.load(open(f"{out}/results.json")) == [{"a": 1}]


def test_settings():
    s = Settings.from_env({"QUARRY_FINAL_K": "9", "QUARRY_MMR_LAMBDA": "0.2", "QUARRY_USE_MMR": "yes", "QUARRY_RRF_K": "many"}, dense_top_n=5)
    assert (s.final_k, s.mmr_lambda, s.use_mmr, s.rrf_k, s.dense_top_n) == (9, 0.2, True, 60, 5)
    assert read_env_file("A=1\n# c\nexport B='two'\n\nC", {"A": "own"}) == {"A": "own", "B": "two"}


class Flaky(Exception):
    status_code = 503


def test_retry():
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise Flaky
        return "ok"

    assert plugins.Retry(sleep=lambda s: None).run(call) == "ok" and len(tries) == 3
    with pytest.raises(ValueError):
        plugins.Retry(sleep=lambda s: None).run(lambda: (_ for _ in ()).throw(ValueError("bad model")))
    assert plugins.Retry.passes(TimeoutError()) and not plugins.Retry.passes(ValueError("no"))


def test_factories_are_told_apart():
    made = [plugins.Shared(f).get() for f in (lambda: "model A", lambda: "model B")]
    assert made == ["model A", "model B"]
    factory = lambda: object()
    assert plugins.Shared(factory).get() is plugins.Shared(factory).get()


def test_encoder(spark):
    df = spark.createDataFrame([("a", "getUser name"), ("b", None)], "id string, embed_text string")
    got = {r["id"]: r["vector"] for r in plugins.embed(df).collect()}
    assert len(got["a"]) == 64 and abs(sum(x * x for x in got["a"]) - 1) < 1e-6 and not any(got["b"])


class Answers:
    def generate(self, prompt, max_tokens):
        if "verdict" in prompt:
            return '{"results": [{"index": 0, "verdict": "SUPPORTED", "reason": ""}, {"index": 1, "verdict": "SUPPORTED", "reason": ""}]}'
        if "Reference:" in prompt:
            return '{"grade": "partially_correct", "reason": "half"}'
        if "JSON" in prompt:
            return 'Here: {"claims": [{"text": "It returns one.", "sources": [1], "supported": true, "reason": "r"}, {"text": "It flies.", "sources": [], "supported": true, "reason": ""}]}'
        return "It returns one [1]. See [9]."


def test_answers_and_evaluation(spark, tree):
    chunks = chunking.chunks(chunking.parse_files(files.scan(spark, str(tree)))).cache()
    index = retrieval.build_index(chunks)
    models = retrieval.Models(llm=Answers)
    got = evaluation.answer(spark.createDataFrame([(1, "what does f return")], "query_id long, query string"), index, Settings(), models)
    row = got.first()
    assert row["invalid_citations"] == [9] and row["valid_citations"] == [1] and "keep.py" in row["context"]
    faith = evaluation.faithfulness(got, models, Settings()).first()
    assert faith["n_claims"] == 2 and faith["faithfulness"] == 0.5 and not faith["judge_failed"]
    two = evaluation.faithfulness(got, models, Settings(single_call_judge=False)).first()
    assert two["n_claims"] == 2 and two["faithfulness"] == 0.5 and not two["judge_failed"]
    graded = got.select("query_id", "question", "answer").withColumn("reference", F.lit("one"))
    assert evaluation.correctness(graded, models).first()["grade"] == "partially_correct"
    questions = spark.createDataFrame([(1, "f return", ["keep.py"]), (2, "package main", ["sub/other.go"])], "query_id long, query string, relevant_files array<string>")
    scores = evaluation.evaluate(questions, index, ["dense", "hybrid", "rerank"])
    assert scores.groupBy("config").agg(F.avg("recall").alias("r")).where("r = 1").count() == 3
    assert evaluation.markdown([{"a": 0.5, "b": None}], ["a", "b"]).splitlines()[-1] == "| 0.500 |  |"


def test_stream(spark, tmp_path):
    source, table, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "file_path string, content_sha string, version long, deleted boolean"
    spark.createDataFrame([("a", "1", 1, False), ("b", "1", 1, False), ("a", "2", 2, False)], schema).write.parquet(source)
    assert updates.snapshot(spark, table) is None
    run = lambda: updates.follow_manifest(spark.readStream.schema(schema).parquet(source), table, check).awaitTermination()
    run()
    assert {(r["file_path"], r["content_sha"]) for r in updates.snapshot(spark, table).collect()} == {("a", "2"), ("b", "1")}
    spark.createDataFrame([("b", "1", 3, True), ("c", "1", 3, False)], schema).write.mode("append").parquet(source)
    run()
    assert {r["file_path"] for r in updates.live(updates.snapshot(spark, table)).collect()} == {"a", "c"}


def test_windows_on_a_stream(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double, user_id long"
    rows = [(f"2024-01-01 0{h}:00:00", "x", 1.0, 1) for h in (1, 2, 5)] + [("2024-01-03 00:00:00", "x", 1.0, 1)]
    spark.createDataFrame(rows, "ts string, event_type string, value double, user_id long").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "e"))
    stream = updates.tumbling(spark.readStream.schema(schema).parquet(str(tmp_path / "e")))
    stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {r["n"] for r in spark.table("tumbled").collect()} == {3, 1}
