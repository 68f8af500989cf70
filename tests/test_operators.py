import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, context, dense, fuse, graph, incremental, lexical, metrics, scaffold, verify
from quarry.plans import experiments, retrieval
from quarry.settings import Settings

REPO = [
    ("pkg/a.py", "python", "from pkg.b import helper\n\nX = 1\n\n\ndef top_level():\n    \"\"\"Do it.\"\"\"\n    return helper()\n\n\nclass Widget:\n    \"\"\"A widget.\"\"\"\n\n    def run(self):\n        return self.scale()\n\n    def scale(self):\n        return 2\n"),
    ("pkg/b.py", "python", "def helper():\n    return 42\n"),
    ("bad.py", "python", "def (((:\n"),
    ("notes", "text", "some words\n" * 120),
]


def files(spark, rows=REPO):
    return spark.createDataFrame(rows, "file_path string, language string, text string")


def symbols(spark, rows):
    return spark.createDataFrame(rows, "id string, qualified_name string, simple_name string, kind string, file_path string, start_line int, end_line int")


def test_python_chunks(spark):
    parsed = chunking.parse_files(files(spark))
    rows = {(r["file_path"], r["symbol_name"]): r for r in parsed.collect()}
    assert {"top_level", "Widget", "Widget.run", "Widget.scale", "pkg/a.py"} <= {n for f, n in rows if f == "pkg/a.py"}
    assert rows["pkg/a.py", "top_level"]["calls"] == ["helper"] and rows["pkg/a.py", "Widget.run"]["calls"] == ["scale"]
    assert "Class: Widget" in rows["pkg/a.py", "Widget.run"]["context_header"] and '"""Do it."""' in rows["pkg/a.py", "top_level"]["context_header"]
    assert "helper" in rows["pkg/a.py", "pkg/a.py"]["imports"]
    assert not rows["bad.py", None]["parsed"] and parsed.where("file_path = 'notes'").count() == 3
    assert chunking.chunks(parsed).select("id").distinct().count() == chunking.chunks(parsed).count()


def test_oversized_function(spark):
    body = "def big():\n" + "\n".join(f"    x{i} = {i}" for i in range(200)) + "\n"
    rows = chunking.parse_files(files(spark, [("m.py", "python", body)]), Settings(max_chunk_tokens=20)).collect()
    assert len(rows) > 2 and all(r["symbol_name"].startswith("big#") and "def big()" in r["context_header"] for r in rows)
    assert chunking.symbols(chunking.parse_files(files(spark, [("m.py", "python", body)]), Settings(max_chunk_tokens=20))).count() == 1


def test_graph_of_two_files(spark):
    parsed = chunking.parse_files(files(spark))
    nodes = chunking.symbols(parsed).withColumnRenamed("chunk_id", "id")
    edges = graph.build(nodes, chunking.calls(parsed), chunking.imports(parsed))
    name = {r["id"]: r["qualified_name"] for r in nodes.collect()}
    got = {(name[r["src"]], r["type"], name[r["dst"]]) for r in edges.collect()}
    defined = {("top_level", "calls", "helper"), ("Widget.run", "calls", "Widget.scale"), ("Widget", "contains", "Widget.run"), ("Widget", "contains", "Widget.scale")}
    assert got == defined | {("pkg/a.py", "imports", "helper")}


def test_imports(spark):
    sources = [
        ("pkg/__init__.py", "python", "VERSION = 1\n"),
        ("pkg/a.py", "python", "import pkg.b\nfrom . import c\nfrom .b import shared\nfrom ..other.d import *\n\ndef run():\n    return shared()\n"),
        ("pkg/b.py", "python", "X = 1\n\ndef shared():\n    return 1\n"),
        ("pkg/c.py", "python", "Y = 2\n\ndef shared():\n    return 2\n"),
        ("pkg/e.py", "python", "import pkg\nfrom nowhere import nothing\n"),
    ]
    parsed = chunking.parse_files(files(spark, sources))
    nodes = chunking.symbols(parsed).withColumnRenamed("chunk_id", "id")
    edges = graph.build(nodes, chunking.calls(parsed), chunking.imports(parsed))
    name = {r["id"]: (r["file_path"], r["simple_name"]) for r in nodes.collect()}
    got = {(name[r["src"]][0], r["type"], name[r["dst"]]) for r in edges.collect()}
    a, e = "pkg/a.py", "pkg/e.py"
    assert got == {(a, "imports", ("pkg/b.py", "b.py")), (a, "imports", ("pkg/c.py", "c.py")), (e, "imports", ("pkg/__init__.py", "__init__.py"))}
    assert {r["name"] for r in chunking.imports(parsed).where("file_path = 'pkg/a.py'").collect()} == {"pkg.b", "pkg.c", "c", "shared", "other.d"}


def test_long_module(spark):
    source = "\n".join(f"x{i} = {i}" for i in range(300))
    parsed = chunking.parse_files(files(spark, [("m.py", "python", source)]), Settings(max_chunk_tokens=50))
    rows = parsed.orderBy("start_line").collect()
    assert len(rows) > 5 and "\n".join(r["code"] for r in rows) == source and chunking.symbols(parsed).count() == 1


def test_ambiguous_names(spark):
    nodes = symbols(spark, [("xs", "shared", "shared", "function", "x.py", 1, 2), ("ys", "shared", "shared", "function", "y.py", 1, 2), ("xf", "foo", "foo", "function", "x.py", 3, 4), ("zb", "bar", "bar", "function", "z.py", 1, 2)])
    asked = spark.createDataFrame([("shared", "x.py"), ("shared", "z.py"), ("nowhere", "x.py"), ("mod.foo", "z.py")], "name string, file_path string")
    got = {(r["name"], r["file_path"]): r["target"] for r in graph.resolve(asked, nodes).collect()}
    assert got == {("shared", "x.py"): "xs", ("shared", "z.py"): None, ("nowhere", "x.py"): None, ("mod.foo", "z.py"): "xf"}
    imports = spark.createDataFrame([("z.py", "shared", "y.py")], "file_path string, simple_name string, from_file string")
    assert {r["file_path"]: r["target"] for r in graph.resolve(asked.where("name = 'shared'"), nodes, imports).collect()} == {"x.py": "xs", "z.py": "ys"}


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, t, i) for i, (a, b, t) in enumerate(rows)], "src string, dst string, type string, seq long")


def test_pagerank(spark):
    nodes = symbols(spark, [(n, n, n, "function", "f", 1, 1) for n in ("foo", "shared", "lonely")])
    seeds = spark.createDataFrame([(1, "foo")], "query_id int, id string")
    e = edges_of(spark, [("foo", "shared", "calls")])
    one = {r["id"]: r["score"] for r in graph.pagerank(seeds, e, nodes).collect()}
    assert one["shared"] > one.get("lonely", 0) == 0
    more = {r["id"]: r["score"] for r in graph.pagerank(seeds, graph.add_edges(e, nodes, edges_of(spark, [("foo", "lonely", "calls")])), nodes).collect()}
    assert more["lonely"] > 0
    assert {r["id"] for r in graph.pagerank(seeds, e, nodes, frontier=1).collect()} >= {"foo"}


def test_neighbours_and_edits(spark):
    e = edges_of(spark, [("a", "b", "calls"), ("c", "a", "contains"), ("b", "d", "calls"), ("a", "b", "imports")])
    seeds = spark.createDataFrame([(1, "a")], "query_id int, id string")
    got = [(r["id"], r["relation"], r["distance"]) for r in graph.neighbours(seeds, e, depth=2).orderBy("distance", "order").collect()]
    assert got == [("b", "calls", 1), ("c", "contained_by", 1), ("d", "calls", 2)]
    assert {r["id"] for r in graph.neighbours(seeds, e, relations=["contains"]).collect()} == {"c"}
    assert graph.remove_edges(e, spark.createDataFrame([("a", "b")], "src string, dst string")).count() == 2
    nodes = symbols(spark, [(n, n, n, "function", f"{n}.py", 1, 1) for n in "abcd"])
    left, kept = graph.remove_files(nodes, e, spark.createDataFrame([("b.py",)], "file_path string"))
    assert left.count() == 3 and kept.count() == 1
    assert graph.merge((left, kept), (nodes, e))[1].count() == 4
    assert graph.dot(nodes, e).count() == 2 + 4 + 4
    lines = graph.context_lines(spark.createDataFrame([(1, "a", 1)], "query_id int, id string, rank int"), e, nodes).first()["graph_context"]
    assert lines.splitlines()[0] == "- a calls b (b.py:1-1)" and len(lines.splitlines()) == 2
    own, inside = graph.subgraph(nodes, e, focus="a", depth=1)
    assert {r["id"] for r in own.collect()} == {"a", "b", "c"} and inside.count() == 3


def lists(spark, *of):
    return [spark.createDataFrame([(1, x, i) for i, x in enumerate(one, 1)], "query_id int, id string, rank int") for one in of]


def order(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_fusion(spark):
    assert order(fuse.rrf(lists(spark, "abxy", "cbzw")))[0] == "b"
    assert order(fuse.rrf(lists(spark, "y", "z"), weights=[10, 1])) == ["y", "z"] and order(fuse.rrf(lists(spark, "y", "z"), weights=[1, 10])) == ["z", "y"]
    with pytest.raises(ValueError):
        fuse.rrf(lists(spark, "a", "b"), weights=[1])


def test_listwise(spark):
    ranked = lists(spark, "abcde")[0]
    reply = lambda x: spark.createDataFrame([(1, x)], "query_id int, reply string")
    assert order(fuse.listwise(ranked, reply("3, 1, 5")))[:3] == ["c", "a", "e"]
    assert order(fuse.listwise(ranked, reply("2"))) == list("bacde") and order(fuse.listwise(ranked, reply(None))) == list("abcde")


def test_mmr(spark):
    rows = [(1, "a", 1, 3.0, "alpha beta gamma delta"), (1, "b", 2, 2.8, "alpha beta gamma delta"), (1, "c", 3, 2.5, "other words entirely here")]
    ranked = spark.createDataFrame(rows, "query_id int, id string, rank int, score double, code string")
    assert order(fuse.mmr(ranked, 2, 0.3)) == ["a", "c"]


def test_gate(spark):
    ranked = spark.createDataFrame([(1, x, i, s) for i, (x, s) in enumerate(zip("abcd", [3.0, -1.0, -2.0, -3.0]), 1)], "query_id int, id string, rank int, score double")
    assert fuse.gate(ranked, 1).count() == 1 and fuse.gate(ranked, 3).count() == 3


def test_bm25_finds_the_rare_name(spark):
    chunks = spark.createDataFrame([("1", "def frobnicate(x)"), ("2", "def other(x)"), ("3", "x y z")], "id string, text string")
    q = spark.createDataFrame([(1, "where is frobnicate")], "query_id int, text string")
    index = lexical.index(chunks)
    assert order(lexical.search(q, index)) == ["1"]
    assert lexical.search(q, lexical.removed(index, chunks.where("id = '1'"))).count() == 0


def test_containing(spark):
    texts = ["a bb cc dd e", "xa bb cc ddx", "bb cc", "bb  cc dd", "", None, "a bb\ncc dd", "a bb cc zz", "aa bb bb cc"]
    asked = ["a bb cc dd", "bb cc", "cc", "", None, "bb\ncc dd", "bb bb cc", "no such words here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    want = sorted((i, j) for i, a in enumerate(asked) for j, t in enumerate(texts) if a is not None and t is not None and a in t)
    assert sorted(tuple(r) for r in lexical.containing(q, docs).collect()) == want


def test_inverted_file_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((120, 64))[rng.integers(0, 120, 3000)] + 0.15 * rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    corpus = spark.createDataFrame([(f"{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>")
    q = corpus.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    exact = {(r["query_id"], r["id"]) for r in dense.search(q, corpus, 10).collect()}
    assert {(r["query_id"]) for r in dense.search(q, corpus, 1).where("query_id = id").collect()} == {f"{i:04d}" for i in range(0, 3000, 100)}
    near = {(r["query_id"], r["id"]) for r in dense.InvertedFile(corpus, 64).search(q, 10, 16).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_search_over_many_batches(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (700, 6)).astype(float)
    corpus = spark.createDataFrame([(int(i), x[i].tolist()) for i in rng.permutation(700)] + [(999, None)], "id int, vector array<double>").repartition(3)
    q = corpus.where("id < 300").withColumnRenamed("id", "query_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {}
        for r in dense.search(q, corpus, 7).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
        ranks = {r["query_id"]: r["rank"] for r in dense.gold_ranks(q.withColumn("gold", F.col("query_id") + 1), corpus, "query_id", "vector", "gold", "id", "vector").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    scores = x @ x.T
    for i in range(300):
        best = sorted(range(700), key=lambda j: (-scores[i, j], j))[:7]
        assert [(j, s) for _, j, s in sorted(got[i])] == [(j, scores[i, j]) for j in best]
        assert ranks[i] == 1 + (scores[i] > scores[i, i + 1]).sum()
    assert dense.search(q.limit(0), corpus, 7).count() == 0 and dense.search(q, corpus.limit(0), 7).count() == 0


def test_inverted_file_grows_and_is_saved(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 8))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<double>")
    file = dense.InvertedFile(corpus.where("id < 150"), 4).added(corpus.where("id >= 100")).removed(corpus.where("id = 7"))
    assert file.filed.count() == 199 and file.filed.select("id").distinct().count() == 199
    file.save(str(tmp_path / "ivf"))
    q = corpus.where("id % 20 = 7").withColumnRenamed("id", "query_id")
    want = sorted(tuple(r) for r in dense.search(q, corpus.where("id <> 7"), 5).collect())
    assert sorted(tuple(r) for r in dense.InvertedFile.load(spark, str(tmp_path / "ivf")).search(q, 5, 4).collect()) == want
    assert dense.backend("ivf", corpus)(q, 3).count() == 30
    with pytest.raises(ValueError):
        dense.backend("other", corpus)


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, x, i) for i, x in enumerate("abcd", 1)], "query_id int, item string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "d"), (2, "z")], "query_id int, item string")
    two, four = ({r["query_id"]: r for r in metrics.retrieval(ranked, relevant, k).collect()} for k in (2, 4))
    assert two[1]["recall"] == 0.5 and four[1]["recall"] == 1 and two[1]["rr"] == 0.5 and two[1]["precision"] == 0.5 and two[2]["recall"] == 0
    one = metrics.retrieval(ranked, relevant.where("item = 'b'").unionByName(spark.createDataFrame([(1, "q")], "query_id int, item string")), 5).first()
    assert abs(one["ndcg"] - (1 / np.log2(3)) / (1 + 1 / np.log2(3))) < 1e-6


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, 1.0, 0.0, float(i % 2)) for i in range(40)], "q int, a double, b double, c double")
    far = metrics.paired_bootstrap(df, "a", "b", "q").first()
    same = metrics.paired_bootstrap(df, "a", "a", "q").first()
    ci = metrics.bootstrap_ci(df, "c", "q").first()
    assert far["significant"] and not same["significant"] and ci["lo"] <= ci["mean"] <= ci["hi"] and ci["lo"] < ci["hi"]
    assert metrics.bootstrap_ci(df.limit(0), "c", "q").first()["mean"] == 0
    scores = df.select(F.lit("one").alias("config"), F.col("q").alias("query_id"), F.col("c").alias("recall"))
    both = metrics.intervals(scores.unionByName(scores.withColumn("config", F.lit("two"))), ["recall"]).collect()
    assert len(both) == 2 and all((r["mean"], r["lo"], r["hi"], r["n"]) == (ci["mean"], ci["lo"], ci["hi"], ci["n"]) for r in both)
    assert metrics.intervals(scores.limit(0), ["recall"]).count() == 0
    kinds = df.withColumn("kind", F.when(F.col("q") % 4 < 2, "x"))
    got = {r["kind"]: tuple(r)[1:] for r in metrics.deltas_by(kinds, "kind", "c", "b", "q").collect()}
    assert got == {k: tuple(metrics.paired_bootstrap(kinds.where(F.col("kind").eqNullSafe(F.lit(k))), "c", "b", "q").first()) for k in ("x", None)}


def test_task_summary(spark):
    rows = spark.createDataFrame([("a", "1", 1.0), ("a", "1", 0.0), ("a", "2", 1.0), ("b", "1", 0.25), ("failed", "1", None)], "task string, split string, ndcg double")
    assert {r["task"]: (r["score"], r["n_splits"]) for r in metrics.task_summary(rows).collect()} == {"a": (0.75, 2), "b": (0.25, 1), "failed": (None, 0), None: (0.5, 3)}


def ranked_chunks(spark, rows):
    return spark.createDataFrame([(1, i, f"id{i}", f, a, b, c, s, None, "retrieved", None) for i, (f, a, b, c, s) in enumerate(rows, 1)], "query_id int, rank int, id string, file_path string, start_line int, end_line int, code string, score double, symbol_name string, source string, relation string")


def test_context(spark):
    rows = [("a.py", 1, 20, "one", 1.0), ("a.py", 5, 10, "two", 0.5), ("b.py", 1, 5, "three", 0.4), ("c.py", 1, 5, "th ree", 0.3)]
    got = context.sources(context.assemble(ranked_chunks(spark, rows))).orderBy("n").collect()
    assert [(r["n"], r["file_path"], r["code"]) for r in got] == [(1, "a.py", "one"), (2, "b.py", "three")]
    long = [("a.py", 1, 2, "x" * 40, 1.0), ("b.py", 1, 2, "y" * 40, 0.5), ("c.py", 1, 2, "z", 0.2)]
    got = context.sources(context.assemble(ranked_chunks(spark, long), Settings(context_token_budget=11))).orderBy("n").collect()
    assert [r["file_path"] for r in got] == ["a.py", "c.py"]
    near = [("a.py", 11, 20, "later", 1.0), ("a.py", 1, 10, "first", 0.5)]
    got = context.sources(context.assemble(ranked_chunks(spark, near))).collect()
    assert [(r["start_line"], r["end_line"], r["code"]) for r in got] == [(1, 20, "first\nlater")]


def test_structural_check(spark):
    rows = spark.createDataFrame([(1, "a [1] b [2] c [1]", 2), (2, "see [3]", 2), (3, "This sentence makes a claim without any source.", 2)], "query_id int, answer string, n_sources int")
    got = {r["query_id"]: r for r in verify.structural(rows).collect()}
    assert got[1]["valid_citations"] == [1, 2] and got[1]["n_citations"] == 3 and got[2]["invalid_citations"] == [3] and len(got[3]["uncited_claims"]) == 1


def test_incremental(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("d", "1")], "file_path string, content_sha string")
    after = spark.createDataFrame([("a", "2"), ("c", "1"), ("d", "1")], "file_path string, content_sha string")
    diff = incremental.manifest_diff(before, after)
    assert {(r["file_path"], r["change"]) for r in diff.collect()} == {("a", "modified"), ("b", "deleted"), ("c", "added")}
    assert sorted(tuple(r) for r in incremental.apply(before, diff, after).collect()) == sorted(tuple(r) for r in after.collect())
    assert incremental.manifest_diff(after, after).count() == 0


def test_scaffold(spark):
    nodes = symbols(spark, [("1", "Mod.process_data", "process_data", "method", "a.py", 1, 2), ("2", "load_rows", "load_rows", "function", "b.py", 1, 2), ("3", "get", "get", "function", "b.py", 3, 4), ("4", "test_it_all", "test_it_all", "function", "b.py", 5, 6)])
    out = scaffold.questions(nodes, edges_of(spark, [("1", "2", "calls"), ("1", "3", "calls")]), 10).collect()
    assert {tuple(r["relevant_files"]) for r in out if r["type"] == "cross-file"} == {("a.py", "b.py")} and len(out) == 3
    assert not any("Mod.process_data" in r["relevant_symbols"] for r in scaffold.questions(nodes, edges_of(spark, [("1", "2", "calls")]), 10, used=["Mod.process_data"]).collect())


class Rewords:
    def generate(self, prompt, max_tokens):
        if "q30:" in prompt:
            return "no JSON"
        ids = [line.split(":")[0] for line in prompt.splitlines() if line.startswith("q")]
        return str({"rewrites": [{"id": i, "question": f" again {i} "} for i in [*ids[1:], "q30", "q99"]]}).replace("'", '"')


def test_paraphrase(spark):
    rows = spark.createDataFrame([(f"q{i}", f"text {i}", i) for i in range(10, 35)], "id string, question string, extra int")
    got = {r["id"]: r["question"] for r in scaffold.paraphrased(rows, Rewords).collect()}
    # the model leaves out the first of a batch; the batch of q30 stays as it is, as its reply is no JSON
    assert {k for k, v in got.items() if v == f"again {k}"} == {f"q{i}" for i in range(11, 22)} and len(got) == 25
    assert got["q10"] == "text 10" and got["q30"] == "text 30" and got["q34"] == "text 34"


class Says:
    def __init__(self, text):
        self.text = text

    def generate(self, prompt, max_tokens):
        if self.text is None:
            raise RuntimeError("down")
        return self.text


def test_retrieval_and_fallbacks(spark):
    parsed = chunking.parse_files(files(spark))
    chunks = chunking.chunks(parsed)
    nodes = chunking.symbols(parsed).withColumnRenamed("chunk_id", "id")
    edges = graph.build(nodes, chunking.calls(parsed), chunking.imports(parsed))
    index = retrieval.build_index(chunks, nodes=nodes, edges=edges)
    q = spark.createDataFrame([(1, "helper returns"), (2, "widget scale")], "query_id int, query string")
    plain = retrieval.retrieve(q, index, k=4)
    assert plain.count() == 8 and plain.where("source <> 'retrieved'").count() == 0
    with pytest.raises(ValueError):
        retrieval.retrieve(q, index, use_dense=False, use_bm25=False)
    down = retrieval.retrieve(q, index, Settings(llm_rerank=True), retrieval.Models(llm=lambda: Says(None)), k=4)
    assert sorted(tuple(r) for r in down.select("query_id", "id", "rank").collect()) == sorted(tuple(r) for r in plain.select("query_id", "id", "rank").collect())
    for s in (Settings(use_rerank=True, expand_graph=True, graph_rerank_boost=0.5), Settings(use_rerank=True, use_mmr=True), Settings(graph_rerank=True), Settings(graph_pagerank=True), Settings(expand_graph=True, graph_prererank_pool=False)):
        assert retrieval.retrieve(q, index, s, k=3).where("query_id = 1").count() >= 3


def test_experiments(spark):
    chunks = spark.createDataFrame([(str(i), f"f{i}.py", n, f"def {n}(): {w}") for i, (n, w) in enumerate([("frobnicate", "one"), ("handler", "two widgets"), ("parse_rows", "three"), (None, "rows of words")])], "id string, file_path string, symbol_name string, embed_text string")
    df = {r["term"]: r["df"] for r in experiments.symbol_df(chunks).collect()}
    assert df["frobnicate"] == 1 and df["rows"] == 1 and "words" not in df
    q = spark.createDataFrame([(1, "what does frobnicate do"), (2, "handler of two widgets"), (3, "")], "query_id int, query string")
    assert {r["query_id"]: r["named"] for r in experiments.names_rare_symbol(q, experiments.symbol_df(chunks)).collect()} == {1: True, 2: False, 3: False}
    index = retrieval.build_index(chunks)
    assert {r["id"] for r in experiments.adaptive(q, index).where("query_id = 1 AND rank = 1").collect()} == {"0"}
    models = retrieval.Models(llm=lambda: Says("- parse rows\n\n* frobnicate\nthree\nfour"))
    got = {(r["query_id"], r["part"]): r["query"] for r in experiments.parts(q, models).collect()}
    assert [got[2, i] for i in range(4)] == ["handler of two widgets", "parse rows", "frobnicate", "three"] and (2, 4) not in got
    down = {(r["query_id"], r["part"]): r["query"] for r in experiments.parts(q, retrieval.Models(llm=lambda: Says(None))).collect()}
    assert down[1, 1] == down[1, 0] and (1, 2) not in down
    fused = experiments.decomposed(q, index, models=models)
    lists = []
    for part in range(4):
        asked = spark.createDataFrame([(i, got[i, part]) for i in (1, 2, 3)], "query_id int, query string")
        pair = [retrieval.by_words(asked, index, Settings()), retrieval.by_vector(asked, index, Settings(), models)]
        lists += pair if part == 0 else pair[::-1]
    assert order(fused) == order(fuse.rrf(lists, 60))
    asked = q.where("query_id < 3").join(spark.createDataFrame([(1, ["f0.py"]), (2, ["f1.py"])], "query_id int, relevant_files array<string>"), "query_id")
    trial = experiments.reranker_trial(asked, index, retrieval.plugins.OverlapReranker).collect()
    assert len(trial) == 2 and all(r["recall_reranked"] == 1 and r["rr_reranked"] == 1 for r in trial)
