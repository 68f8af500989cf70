"""Variants of retrieval to be held against the default: weights that follow the question, questions taken apart, and
another reranker over a stored pool."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import plugins
from quarry.functions import text as X
from quarry.operators import fuse, lexical, metrics
from quarry.plans import retrieval
from quarry.settings import Settings
from quarry.shared import staged

#: Words that are parts of symbols and of plain questions alike (fixed values).
PLAIN = (
    "function", "class", "method", "request", "response", "model", "type",
    "value", "field", "param", "params", "config", "handler", "data", "from",
    "with", "that", "this", "does", "build", "create", "into", "used", "uses",
)
SHORTEST, MOST_SYMBOLS = 5, 3
#: Weights of the lists by vectors and by words: for questions that name a rare symbol, and for others.
NAMED, PROSE = (1.0, 1.5), (1.5, 1.0)
MOST_PARTS = 3


def symbol_df(chunks: DataFrame) -> DataFrame:
    """(term, df): the number of chunks in whose symbol_name each token occurs; chunks without a symbol do not count."""
    return lexical.counts(chunks.where("symbol_name IS NOT NULL"), "id", "symbol_name").select("term", "df")


def names_rare_symbol(queries: DataFrame, df: DataFrame) -> DataFrame:
    """(query_id, named): whether a question has a token of SHORTEST or more characters, no plain word, that at most
    MOST_SYMBOLS symbols hold."""
    terms = queries.select("query_id", F.explode(X.code_tokens("query")).alias("t")).select("query_id", F.lower("t").alias("term"))
    terms = terms.where((F.char_length("term") >= SHORTEST) & ~F.col("term").isin(*PLAIN))
    named = terms.join(df.where(F.col("df") <= MOST_SYMBOLS), "term", "left_semi").select("query_id").distinct()
    return queries.select("query_id").distinct().join(named.withColumn("named", F.lit(True)), "query_id", "left").select("query_id", F.coalesce("named", F.lit(False)).alias("named"))


def _lists(found: list[tuple[DataFrame, int]]) -> DataFrame:
    out = None
    for rows, number in found:
        part = rows.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.lit(number).alias("list"))
        out = part if out is None else out.unionByName(part)
    return out


def weighted(rows: DataFrame, named: DataFrame, k: int = 60, cut: int | None = None) -> DataFrame:
    """(query_id, id, score, rank) of rows(query_id, id, rank, list): lists 0 (vectors) and 1 (words), fused with the
    weights of questions that name a symbol or of those that do not."""
    weight = F.when(F.col("named"), F.when(F.col("list") == 0, NAMED[0]).otherwise(NAMED[1])).otherwise(F.when(F.col("list") == 0, PROSE[0]).otherwise(PROSE[1]))
    return fuse.rrf_rows(rows.join(named, "query_id").withColumn("weight", weight), k, cut)


def adaptive(queries: DataFrame, index: retrieval.Index, settings: Settings = Settings(), models: retrieval.Models = retrieval.Models()) -> DataFrame:
    """(query_id, id, score, rank): words count more for questions that name a rare symbol, vectors for all others."""
    rows = _lists([(retrieval.by_vector(queries, index, settings, models), 0), (retrieval.by_words(queries, index, settings), 1)])
    return weighted(rows, names_rare_symbol(queries, symbol_df(index.chunks)), settings.rrf_k, settings.fuse_top_n)


def parts(queries: DataFrame, models: retrieval.Models) -> DataFrame:
    """(query_id, part, query): each question as part 0, then up to MOST_PARTS questions that a model takes it apart into,
    a line each; the question once more where the model fails or says nothing."""
    ask = F.concat(F.lit("Take this question about code apart into two or three simpler ones, each about one thing to be found. One a line, no numbers.\n\n"), "query")
    told = plugins.generate(queries.select("query_id", "query", ask.alias("prompt")), models.llm, max_tokens=120)
    lines = F.transform(F.split(F.coalesce("reply", F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^[-*\s]+|[-*\s]+$", ""))
    own = F.slice(F.filter(lines, lambda x: x != ""), 1, MOST_PARTS)
    every = F.concat(F.array("query"), F.when(F.size(own) > 0, own).otherwise(F.array("query")))
    return told.select("query_id", F.posexplode(every).alias("part", "query"))


def decomposed(queries: DataFrame, index: retrieval.Index, settings: Settings = Settings(), models: retrieval.Models = retrieval.Models()) -> DataFrame:
    """(query_id, id, score, rank): the lists by words and by vectors of a question and of each of its parts, fused."""
    asked = staged(parts(queries, models).withColumn("key", F.concat(F.col("query_id").cast("string"), F.lit("/"), F.col("part").cast("string"))), "parts")
    each = asked.select(F.col("key").alias("query_id"), "query")
    # ties go to the first list: the question's own by words, by vectors, then those of its parts
    found = _lists([(retrieval.by_words(each, index, settings), 0), (retrieval.by_vector(each, index, settings, models), 1)])
    own = asked.select(F.col("key").alias("k"), F.col("query_id").alias("q"), "part")
    place = F.col("part") * 2 + F.when(F.col("part") == 0, F.col("list")).otherwise(1 - F.col("list"))
    rows = found.join(own, F.col("query_id") == F.col("k")).select(F.col("q").alias("query_id"), "id", "rank", place.alias("list"), F.lit(1.0).alias("weight"))
    return fuse.rrf_rows(rows, settings.rrf_k)


def reranker_trial(questions: DataFrame, index: retrieval.Index, factory: Callable[[], object], settings: Settings = Settings(), models: retrieval.Models = retrieval.Models(), pool: int = 50, k: int = 5) -> DataFrame:
    """(query_id, recall, rr, recall_reranked, rr_reranked) by files: the fused pool of each of questions(query_id, query,
    relevant_files), written once, in its own order and in that of another reranker. metrics.paired_bootstrap compares."""
    fused = retrieval.fused(questions.select("query_id", "query"), index, settings.but(fuse_top_n=pool), models)
    stored = staged(fused.join(index.chunks.select("id", "file_path", "embed_text"), "id"), "pool")
    scored = plugins.rerank(stored.join(questions.select("query_id", "query"), "query_id"), factory, "query", "embed_text", "score")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("rank")))
    again = scored.withColumn("new", order).select("query_id", "file_path", F.col("new").alias("rank"))
    relevant = questions.select("query_id", F.explode("relevant_files").alias("item"))
    rate = lambda ranked: metrics.retrieval(metrics.first_seen(ranked, "file_path"), relevant, k).select("query_id", "recall", "rr")
    new = rate(again).select("query_id", F.col("recall").alias("recall_reranked"), F.col("rr").alias("rr_reranked"))
    return rate(stored.select("query_id", "file_path", "rank")).join(new, "query_id")
