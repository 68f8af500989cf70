"""Retrieval for whole batches of questions: one plan from questions to ranked chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import plugins
from quarry.functions import text as X
from quarry.operators import dense, fuse, graph, lexical
from quarry.settings import Settings
from quarry.shared import staged


@dataclass(frozen=True)
class Index:
    """What a search reads (by an inverted file over the vectors, if there is one): chunks(id, ordinal, file_path, start_line, end_line, code, symbol_name, embed_text, ...), vectors(id,
    vector), postings, and the graph if there is one."""

    chunks: DataFrame
    vectors: DataFrame | None = None
    postings: lexical.Postings | lexical.Texts | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    inverted: dense.InvertedFile | None = None


@dataclass(frozen=True)
class Models:
    """Factories of models; without an encoder vectors are hashes of tokens, computed by the engine."""

    encoder: Callable[[], object] | None = None
    reranker: Callable[[], object] | None = None
    llm: Callable[[], object] | None = None


def build_index(chunks: DataFrame, settings: Settings = Settings(), models: Models = Models(), nodes: DataFrame | None = None, edges: DataFrame | None = None, once: bool = False) -> Index:
    """once: for a single batch of queries; texts are searched as they are, and no postings are written."""
    postings = (lexical.texts if once else lexical.index)(chunks, "id", "embed_text")
    if models.encoder is None:
        vectors = dense.hashed(chunks, "id", "embed_text", settings.embed_dim)
    else:
        prefix = X.prefixes(settings.embed_model)[1] if settings.embed_doc_prefix is None else settings.embed_doc_prefix
        vectors = plugins.embed(chunks.select("id", "embed_text"), models.encoder, prefix=prefix, batch=settings.embed_batch).select("id", "vector")
    inverted = dense.InvertedFile(vectors) if settings.vector_backend == "ivf" else None
    return Index(chunks, vectors, postings, nodes, edges, inverted)


def encoded(queries: DataFrame, settings: Settings, models: Models, text: str = "query") -> DataFrame:
    """(query_id, vector)."""
    if models.encoder is None:
        return dense.hashed(queries.withColumnRenamed("query_id", "id"), "id", text, settings.embed_dim).withColumnRenamed("id", "query_id")
    prefix = X.prefixes(settings.embed_model)[0] if settings.embed_query_prefix is None else settings.embed_query_prefix
    return plugins.embed(queries.select("query_id", text), models.encoder, text, query=True, prefix=prefix).select("query_id", "vector")


def hyde(queries: DataFrame, models: Models) -> DataFrame:
    """queries with a made-up answer appended to what is encoded; the question alone where the model fails."""
    asked = queries.withColumn("prompt", F.concat(F.lit("Write a short code snippet that would answer this question.\n\n"), "query"))
    written = plugins.generate(asked, models.llm, max_tokens=256)
    return written.withColumn("query", F.when(F.coalesce("reply", F.lit("")) != "", F.concat("query", F.lit("\n"), "reply")).otherwise(F.col("query"))).drop("prompt", "reply")


def by_vector(queries: DataFrame, index: Index, settings: Settings, models: Models) -> DataFrame:
    """(query_id, id, score, rank): the nearest vectors, by the inverted file if the index has one."""
    asked = encoded(queries, settings, models)
    find = index.inverted.search if index.inverted is not None else dense.backend("exact", index.vectors)
    return find(asked, settings.dense_top_n)


def by_words(queries: DataFrame, index: Index, settings: Settings) -> DataFrame:
    return lexical.search(queries, index.postings, settings.bm25_top_n, settings.bm25_k1, settings.bm25_b, text="query")


def fused(queries: DataFrame, index: Index, settings: Settings = Settings(), models: Models = Models(), use_dense: bool = True, use_bm25: bool = True) -> DataFrame:
    """(query_id, id, rank): lists of both kinds fused by reciprocal rank and cut; one list alone in its own order."""
    if not (use_dense or use_bm25):
        raise ValueError("Enable at least one of dense / bm25 retrieval.")
    s, lists, weights = settings, [], []
    if use_dense:
        asked = hyde(queries, models) if s.use_hyde else queries
        lists.append(by_vector(asked, index, s, models))
        weights.append(s.dense_weight)
    if use_bm25:
        lists.append(by_words(queries, index, s))
        weights.append(s.bm25_weight)
    if len(lists) == 1:
        return lists[0].where(F.col("rank") <= s.fuse_top_n).select("query_id", "id", "rank")
    return fuse.rrf(lists, s.rrf_k, weights, s.fuse_top_n).select("query_id", "id", "rank")


def retrieve(queries: DataFrame, index: Index, settings: Settings = Settings(), models: Models = Models(), k: int | None = None, use_dense: bool = True, use_bm25: bool = True) -> DataFrame:
    """(query_id, id, score, rank, source, relation): k chunks for each of queries(query_id, query).

    The fused pool may take in neighbours and well-connected nodes; then one of four orders it: a language model's list,
    a reranker (with boost and diversity if asked for), connectivity, or the fused rank."""
    s = settings
    k = k or s.final_k
    # a few dozen rows a query, read more than once below
    pool = found = staged(fused(queries, index, s, models, use_dense, use_bm25), "pool").withColumn("relation", F.lit(None).cast("string"))
    if s.expand_graph and s.graph_prererank_pool and index.edges is not None:
        pool = _appended(pool, graph.pool_neighbours(pool, index.edges, index.nodes, s.graph_expand_seeds, s.graph_expand_depth, s.graph_pool_budget))
    if s.graph_pagerank and index.edges is not None:
        ppr = graph.pagerank(pool.where(F.col("rank") <= s.graph_pagerank_seeds), index.edges, index.nodes)
        pool = _appended(pool, graph.pool_pagerank(pool, ppr, s.graph_pagerank_add))
    if pool is not found:  # nodes of the graph need not be chunks
        pool = pool.join(index.chunks.select("id"), "id", "left_semi").select("query_id", "id", "rank", "relation")
    if s.llm_rerank:
        order = _llm_order(pool, queries, index, models, s)
        ranked = fuse.with_scores(order)
    elif s.use_rerank:
        ranked = _reranked(pool, queries, index, models, s, k)
    elif s.graph_rerank and index.edges is not None:
        ranked = fuse.with_scores(graph_order(pool, index, s))
    else:
        ranked = fuse.with_scores(pool.select("query_id", "id", "rank"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    top = ranked.withColumn("rank", rank).where(F.col("rank") <= k)
    if s.llm_rerank or s.graph_rerank or not s.use_rerank:
        top = fuse.with_scores(top)
    out = top.join(pool.select("query_id", "id", "relation"), ["query_id", "id"], "left")
    out = out.select("query_id", "id", "score", "rank", F.when(F.col("relation").isNull(), "retrieved").otherwise("graph").alias("source"), "relation")
    if s.expand_graph and not s.graph_prererank_pool and index.edges is not None:
        near = graph.pool_neighbours(out, index.edges, index.nodes, k, 1, s.graph_expand_budget)
        last = out.groupBy("query_id").agg(F.max("rank").alias("last"))
        more = near.join(last, "query_id").select("query_id", "id", F.lit(0.0).alias("score"), (F.col("last") + F.col("place")).cast("int").alias("rank"), F.lit("graph").alias("source"), "relation")
        out = out.unionByName(more)
    return out


def _appended(pool: DataFrame, more: DataFrame) -> DataFrame:
    last = pool.groupBy("query_id").agg(F.max("rank").alias("last"))
    return pool.unionByName(more.join(last, "query_id").select("query_id", "id", (F.col("last") + F.col("place")).alias("rank"), "relation"))


def graph_order(pool: DataFrame, index: Index, s: Settings) -> DataFrame:
    """(query_id, id, rank): the pool's order fused with its order by connectivity to the first rows."""
    ppr = graph.pagerank(pool.where(F.col("rank") <= s.graph_rerank_seeds).select("query_id", "id"), index.edges, index.nodes)
    scored = pool.join(ppr, ["query_id", "id"], "left").withColumn("c", F.round(F.coalesce("score", F.lit(0.0)), 9))
    by_graph = scored.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("c"), "rank")).alias("rank"))
    return fuse.rrf([pool.select("query_id", "id", "rank"), by_graph], s.rrf_k).select("query_id", "id", "rank")


def _reranked(pool: DataFrame, queries: DataFrame, index: Index, models: Models, s: Settings, k: int) -> DataFrame:
    pairs = pool.join(queries.select("query_id", "query"), "query_id").join(index.chunks.select("id", "embed_text", "code"), "id")
    scored = plugins.rerank(pairs, models.reranker or plugins.OverlapReranker, "query", "embed_text", "score")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank"))
    scored = scored.withColumn("rank", order)
    if s.graph_rerank_boost > 0 and index.edges is not None:
        better = graph.boosted(scored.select("query_id", "id", "score", "rank"), index.edges, s.graph_rerank_boost)
        scored = scored.drop("score", "rank").join(better, ["query_id", "id"])
    if s.use_mmr:
        chosen = fuse.mmr(scored.select("query_id", "id", "rank", "score", "code"), k, s.mmr_lambda)
        return chosen.join(scored.select("query_id", "id", "score"), ["query_id", "id"])
    return scored.select("query_id", "id", "rank", "score")


def _llm_order(pool: DataFrame, queries: DataFrame, index: Index, models: Models, s: Settings) -> DataFrame:
    head = pool.where(F.col("rank") <= s.llm_rerank_pool).join(index.chunks.select("id", "context_header", "code"), "id")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]\n"), X.rerank_snippet("context_header", "code"))
    listed = head.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("listed"))
    asked = listed.join(queries.select("query_id", "query"), "query_id").withColumn("prompt", F.concat(F.lit("Order these by how well they answer the question. Reply with numbers only, best first.\n\nQuestion: "), "query", F.lit("\n\n"), "listed"))
    return fuse.listwise(pool, plugins.generate(asked.select("query_id", "prompt"), models.llm, max_tokens=256), s.llm_rerank_pool)
