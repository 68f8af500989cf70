"""Fusion and reordering of ranked lists (query_id, id, rank[, score])."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X


def rrf(lists: list[DataFrame], k: int = 60, weights: list[float] | None = None, cut: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the sum of weight / (k + rank) over all lists; ties go to the id that comes first in
    the first list that has it. One list alone keeps its order."""
    if weights is not None and len(weights) != len(lists):
        raise ValueError(f"{len(weights)} weights for {len(lists)} ranked lists")
    if not lists:
        raise ValueError("at least one ranked list is needed")
    parts = [x.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.lit(i).alias("list"), F.lit(float(weights[i] if weights else 1)).alias("weight")) for i, x in enumerate(lists)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return rrf_rows(every, k, cut)


def rrf_rows(every: DataFrame, k: int = 60, cut: int | None = None) -> DataFrame:
    """The same for rows (query_id, id, rank, list, weight)."""
    summed = every.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first"))
    out = summed.withColumn("rank", rank)
    return (out if cut is None else out.where(F.col("rank") <= cut)).select("query_id", "id", "score", "rank")


def with_scores(ranked: DataFrame) -> DataFrame:
    """A ranked list without scores gets 1 / rank."""
    return ranked.withColumn("score", F.lit(1.0) / F.col("rank"))


def gate(ranked: DataFrame, min_sources: int = 3) -> DataFrame:
    """Without rows of negative score beyond the first min_sources."""
    return ranked.where((F.col("rank") <= min_sources) | (F.col("score") >= 0))


def min_max(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("relevance", X.min_max("score", Window.partitionBy("query_id")))


def mmr(ranked: DataFrame, k: int, lam: float = 0.7, text: str = "code") -> DataFrame:
    """(query_id, id, rank): k rows of each query, each the one of greatest lam * relevance less (1 - lam) * greatest
    Jaccard similarity to those already chosen; ties go to the better rank. ranked has (query_id, id, rank, score, text)
    and is a bounded pool for each query."""
    pool = min_max(ranked).select("query_id", "id", "rank", "relevance", X.code_tokens(text).alias("tokens"))
    kinds = {n: ranked.schema[n].dataType.simpleString() for n in ("query_id", "id")}

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        sets, left, chosen = [set(t) for t in group["tokens"]], list(range(len(group))), []
        relevance, near = group["relevance"].tolist(), [0.0] * len(group)
        while left and len(chosen) < k:
            best = max(left, key=lambda i: (round(lam * relevance[i] - (1 - lam) * near[i], 9), -i))
            chosen.append(best)
            left.remove(best)
            for i in left:
                union = len(sets[i] | sets[best])
                near[i] = max(near[i], len(sets[i] & sets[best]) / union if union else 0.0)
        out = group.iloc[chosen][["query_id", "id"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return pool.groupBy("query_id").applyInPandas(choose, f"query_id {kinds['query_id']}, id {kinds['id']}, rank int")


def first_then_rest(first: DataFrame, rest: DataFrame, limit: int | None = None) -> DataFrame:
    """One list, and after it what another has beyond it, in order."""
    tail = rest.join(first.select("query_id", "id"), ["query_id", "id"], "left_anti")
    both = first.select("query_id", "id", F.lit(0).alias("part"), F.col("rank").alias("r")).unionByName(tail.select("query_id", "id", F.lit(1).alias("part"), F.col("rank").alias("r")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("part", "r", "id"))
    out = both.withColumn("rank", rank)
    return (out if limit is None else out.where(F.col("rank") <= limit)).select("query_id", "id", "rank")


def listwise(ranked: DataFrame, replies: DataFrame, pool: int = 15) -> DataFrame:
    """The order that a reply names: its numbers (counted from 1 within the first pool rows), each once, those in range;
    then the rest of the pool. A null reply keeps the order of ranked, whole."""
    named = F.array_distinct(F.filter(F.transform(F.regexp_extract_all("reply", F.lit(r"\d+"), 0), lambda x: x.cast("int")), lambda n: (n >= 1) & (n <= pool)))
    both = ranked.join(replies.select("query_id", named.alias("named"), F.col("reply").isNotNull().alias("answered")), "query_id", "left")
    place = F.array_position("named", F.col("rank"))
    kept = both.where(~F.coalesce("answered", F.lit(False)) | (F.col("rank") <= pool))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(place > 0, place).otherwise(1_000_000 + F.col("rank"))))
    return kept.withColumn("new", order).select("query_id", "id", F.col("new").alias("rank"))
