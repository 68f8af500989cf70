"""What is exchanged and held grows with the input, not with pairs of its rows."""

import math

import numpy as np
from helpers import SF, same
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry.functions import text as X
from quarry.operators import dense, graph, lexical, metrics


def exchanged(spark, act) -> int:
    """Rows that the stages act() starts write for others."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(jvm.java.util.ArrayList(), False, False, getattr(store, "stageList$default$4")(), jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    act()
    return sum(n for i, n in stages().items() if i not in before)


def bm25(texts: dict, queries: dict, n: int) -> dict:
    words = lambda s: s.lower().split()
    avgdl, df = sum(len(words(t)) for t in texts.values()) / len(texts), {}
    for t in texts.values():
        for w in set(words(t)):
            df[w] = df.get(w, 0) + 1
    out = {}
    for q, asked in queries.items():
        scores = {}
        for i, t in texts.items():
            own = words(t)
            if set(own) & set(words(asked)):
                scores[i] = round(sum(math.log((len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * own.count(w) * 2.5 / (own.count(w) + 1.5 * (0.25 + 0.75 * len(own) / avgdl)) for w in words(asked) if w in df), 6)
        out[q] = sorted(scores, key=lambda i: (-scores[i], i))[:n]
    return out


def test_bm25_exchanges_no_pairs(spark):
    rng = np.random.default_rng(4)
    texts = {i: " ".join(f"w{k}" for k in rng.zipf(1.3, 12) % 50) for i in range(1500)}
    queries = {q: " ".join(f"w{k}" for k in rng.integers(0, 50, 8)) for q in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "id int, text string").repartition(3)
    asked = spark.createDataFrame(list(queries.items()), "query_id int, text string")
    want = bm25(texts, queries, 5)
    for index, most in ((lexical.texts(docs), 8_000), (lexical.index(docs), 60_000)):
        got = {}
        n = exchanged(spark, lambda: [got.setdefault(r["query_id"], []).append((r["rank"], r["id"])) for r in lexical.search(asked, index, 5).collect()])
        assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == want
        assert n < most, n  # queries share a word with nearly all of 1500 texts: some 50,000 pairs, and three times as many postings


def test_search_by_slices(spark, monkeypatch):
    monkeypatch.setattr(lexical, "_PAIRS", 10)
    texts = {i: f"a{i % 7} b{i % 3} c" for i in range(90)}
    queries = {q: f"a{q} c b{q % 3} c" for q in range(9)}
    docs = spark.createDataFrame([*texts.items(), (None, "a1 c")], "id int, text string")
    asked = spark.createDataFrame([*((q, t[:3]) for q, t in queries.items()), *((q, t[3:]) for q, t in queries.items()), (99, None), (98, "nothing")], "query_id int, text string").coalesce(1)
    found = lexical.search(asked, lexical.texts(docs.where("id IS NOT NULL")), 12).collect()
    got = {q: [r["id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in queries}
    assert got == bm25(texts, queries, 12) and {r["query_id"] for r in found} == set(queries)


def test_counts_of_tokens(spark):
    rows = [(1, "getUser getUser x"), (1, "x user"), (2, "User"), (None, "user"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "id int, text string")
    want = docs.select("id", F.explode(X.code_tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("id").alias("df"))
    assert sorted(map(tuple, lexical.counts(docs).collect())) == sorted(map(tuple, want.collect()))
    many = spark.range(3000).select("id", F.lit("the same twenty words " * 5).alias("text")).repartition(4)
    assert exchanged(spark, lambda: lexical.counts(many).collect()) < 10_000  # ids and texts, and no row for each pair of token and text


def test_hashed_vectors_without_exchange(spark):
    docs = spark.range(200).select("id", F.concat(F.lit("parseHTML x "), F.col("id").cast("string")).alias("text")).unionByName(spark.createDataFrame([(900, ""), (901, None)], "id long, text string"))
    want = {r["id"]: r["v"] for r in docs.select("id", X.hashed_vector(X.code_tokens(F.coalesce("text", F.lit("")))).alias("v")).collect()}
    got = {}
    assert exchanged(spark, lambda: got.update((r["id"], r["vector"]) for r in dense.hashed(docs).collect())) == 0
    assert set(got) == set(want) and all(np.allclose(got[i], want[i]) for i in want)


def test_fused_queries_match_their_sql(spark):
    for name in ("rrf_adaptive", "hybrid_search", "tok_code_tokens"):
        assert same(entry.queries()[name](spark, SF), entry.oracle_sql()[name], SF)


def test_metrics_by_class(spark):
    rng = np.random.default_rng(5)
    labels = [(i, int(rng.integers(0, 3))) for i in range(600)] + [(600, 7), (601, None)]
    items = spark.createDataFrame(labels, "item int, class int").repartition(2)
    queries = items.where("item % 20 = 0 OR item = 601").withColumnRenamed("item", "query_id")
    ranked = spark.createDataFrame([(q, int(i), r) for q in range(0, 610, 20) for r, i in enumerate(rng.permutation(602)[:10], 1)], "query_id int, item int, rank int")
    relevant = queries.withColumnRenamed("class", "c").join(items, (F.col("c") == F.col("class")) & (F.col("query_id") != F.col("item")))
    want, got = sorted(map(tuple, metrics.retrieval(ranked, relevant, 5).collect())), []
    n = exchanged(spark, lambda: got.extend(map(tuple, metrics.retrieval_by_class(ranked, queries, items, 5).collect())))
    assert sorted(got) == want and len(want) == 30
    assert n < 4_000, n  # each of 30 queries has some 200 relevant items


def test_scored_queries_make_no_pairs(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, (v / np.linalg.norm(v)).tolist(), i % 2) for i, v in enumerate(rng.standard_normal((4000, 8)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    n = exchanged(spark, lambda: entry.queries()["eval_task_summary"](spark, str(tmp_path)).collect())
    assert n < 40_000, n  # 40 queries with 2000 relevant vectors each are 80,000 pairs


def test_boost_by_hub(spark):
    edges = spark.range(5000).select(F.lit("hub").alias("src"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("dst"), F.lit("calls").alias("type"), F.col("id").alias("seq"))
    edges = edges.unionByName(edges.where("seq < 3")).unionByName(spark.createDataFrame([("n1", "n1", "calls", 1)], edges.schema))
    ranked = spark.createDataFrame([(q, x, i, s) for q in (1, 2) for i, (x, s) in enumerate([("n1", 3.0), ("hub", 1.0), ("n2", -1.0), ("other", 2.0)], 1)], "query_id int, id string, rank int, score double")
    for q in (1, 2):
        got = [(r["id"], r["score"]) for r in graph.boosted(ranked, edges, 0.5).orderBy("rank").collect() if r["query_id"] == q]
        assert got == [("n1", 3.5), ("hub", 2.5), ("other", 2.0), ("n2", -0.5)]


def test_graph_boost_makes_no_pairs_of_a_nation(spark, tmp_path):
    s = spark.read.parquet(f"{SF}/supplier.parquet")
    many = s.crossJoin(spark.range(3000 // s.count() + 1).withColumnRenamed("id", "k")).withColumn("s_suppkey", F.col("s_suppkey") + 100_000 * F.col("k")).drop("k")
    many.write.parquet(str(tmp_path / "supplier.parquet"))
    spark.read.parquet(f"{SF}/nation.parquet").write.parquet(str(tmp_path / "nation.parquet"))
    n = exchanged(spark, lambda: entry.queries()["graph_boost"](spark, str(tmp_path)).collect())
    assert n < 20_000, n  # 3000 suppliers of 25 nations are some 180,000 pairs


def test_inverted_file_exchanges_no_vectors(spark):
    rng = np.random.default_rng(7)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((2000, 8)))], "id int, vector array<double>").repartition(2).cache()
    corpus.count()
    file, q = dense.InvertedFile(corpus, 8), corpus.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, dense.search(q, corpus, 5).collect()))
    got = []
    n = exchanged(spark, lambda: got.extend(map(tuple, file.search(q, 5, 8).collect())))
    assert sorted(got) == want and n < 1_600, n  # with all lists probed it is exact; 100 queries, 5 each, of some tasks
