"""Retrieval and answer metrics over whole question sets, and bootstrap significance."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X


def first_seen(ranked: DataFrame, item: str) -> DataFrame:
    """(query_id, item, rank): each item once, at its best rank, numbered anew."""
    best = ranked.groupBy("query_id", F.col(item).alias("item")).agg(F.min("rank").alias("r"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("r", "item"))).select("query_id", "item", "rank")


def retrieval(ranked: DataFrame, relevant: DataFrame, k: int, mrr_k: int | None = None) -> DataFrame:
    """(query_id, recall, precision, rr, ndcg) for every query of relevant(query_id, item), of ranked(query_id, item,
    rank). Recall and gain count a relevant item once; precision divides by k; the reciprocal rank looks at the whole
    list unless mrr_k bounds it."""
    wanted = relevant.select("query_id", "item").distinct()
    return _rated(ranked.join(wanted, ["query_id", "item"], "left_semi"), wanted.groupBy("query_id").agg(F.count("*").alias("n")), k, mrr_k)


def retrieval_by_class(ranked: DataFrame, queries: DataFrame, items: DataFrame, k: int, mrr_k: int | None = None) -> DataFrame:
    """The same where the items of a query's class are relevant to it, save the one that is the query itself:
    queries(query_id, class) and items(item, class), ids being unique. Classes are counted and the ranked items looked
    up, so no pairs of queries and items are made."""
    asked, own = queries.select("query_id", F.col("class").alias("wanted")), items.select("item", "class")
    sizes = own.groupBy("class").agg(F.count("*").alias("n"))
    itself = own.select(F.col("item").alias("query_id"), "class")
    sizes = asked.join(sizes, F.col("wanted") == F.col("class")).drop("class").join(itself, "query_id", "left")
    sizes = sizes.select("query_id", (F.col("n") - F.coalesce((F.col("wanted") == F.col("class")).cast("int"), F.lit(0))).alias("n")).where("n > 0")
    hits = ranked.where("query_id <> item").join(own, "item").join(asked, "query_id").where(F.col("wanted") == F.col("class"))
    return _rated(hits, sizes, k, mrr_k)


def _rated(hits: DataFrame, sizes: DataFrame, k: int, mrr_k: int | None) -> DataFrame:
    hits = hits.groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    inside = F.col("rank") <= k
    found = hits.groupBy("query_id").agg(
        F.count(F.when(inside, 1)).alias("hit"),
        F.min(F.when(F.col("rank") <= mrr_k, F.col("rank")) if mrr_k else "rank").alias("first"),
        F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1.0))).alias("gain"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return sizes.join(found, "query_id", "left").select(
        "query_id",
        zero(F.round(F.col("hit") / F.col("n"), 6)).alias("recall"),
        zero(F.round(F.col("hit") / F.lit(k), 6)).alias("precision"),
        zero(F.round(1.0 / F.col("first"), 6)).alias("rr"),
        zero(F.round(F.col("gain") / ideal, 6)).alias("ndcg"),
    )


def symbols(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, symbol_recall, symbol_rr) of ranked(query_id, symbol, rank) and relevant(query_id, symbol): symbols match
    by their last part, windows of one symbol count once."""
    named = first_seen(ranked.where("symbol IS NOT NULL").withColumn("symbol", X.without_window("symbol")), "symbol")
    wanted = relevant.select("query_id", F.col("symbol").alias("want")).distinct().withColumn("last", X.last_part("want"))
    met = wanted.join(named.withColumn("last", X.last_part("item")), ["query_id", "last"], "left").groupBy("query_id", "want").agg(F.min("rank").alias("rank"))
    return met.groupBy("query_id").agg(F.round(F.avg((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("double")), 6).alias("symbol_recall"), F.coalesce(F.round(1.0 / F.min("rank"), 6), F.lit(0.0)).alias("symbol_rr"))


def rank_summary(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: recall at each k and mean reciprocal rank of (query_id, rank)."""
    return ranks.agg(*[F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"recall_{k}") for k in ks], F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"))


def citation_pr(cited: DataFrame, sources: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, citation_precision, citation_recall) over distinct files: cited(query_id, n), sources(query_id, n, file),
    relevant(query_id, file)."""
    files = cited.join(sources, ["query_id", "n"]).select("query_id", "file").distinct()
    wanted = relevant.select("query_id", "file").distinct()
    n = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    both = n(wanted, "n_relevant").join(n(files, "n_cited"), "query_id", "left").join(n(files.join(wanted, ["query_id", "file"], "left_semi"), "n_hit"), "query_id", "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return both.select("query_id", F.coalesce(F.round(hit / F.col("n_cited"), 6), F.lit(0.0)).alias("citation_precision"), F.round(hit / F.col("n_relevant"), 6).alias("citation_recall"))


def faithfulness(claims: DataFrame) -> DataFrame:
    """(query_id, faithfulness, n_claims) of claims(query_id, text, supported): the share supported without abstentions;
    null support is none; 1 where no claim is left."""
    real = ~X.is_abstention("text")
    return claims.groupBy("query_id").agg(F.coalesce(F.round(F.avg(F.when(real, F.coalesce("supported", F.lit(False)).cast("double"))), 6), F.lit(1.0)).alias("faithfulness"), F.count(F.when(real, 1)).alias("n_claims"))


# ---- bootstrap

_A, _C, _M = 1103515245, 12345, 2147483648


def _draws(numbered: DataFrame, resamples: int) -> DataFrame:
    """(resample, mean) of numbered(i, n, x): element i of a resample is picked by a step of a fixed linear congruence."""
    n = numbered.agg(F.max("n").alias("n"))
    picks = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r")).select("n", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    step = F.pmod(F.pmod(F.lit(_A).cast("long") * (F.col("r") * F.col("n") + F.col("j") + 1) + _C, F.lit(_M).cast("long")) * F.lit(48271).cast("long"), F.lit(2147483647).cast("long"))
    return picks.withColumn("i", F.pmod(step, F.col("n"))).join(numbered.select("i", "x"), "i").groupBy("r").agg(F.round(F.avg("x"), 9).alias("mean"))


def _numbered(values: DataFrame, x: str, order: str) -> DataFrame:
    own = values.where(F.col(x).isNotNull()).select(F.col(x).alias("x"), F.col(order).alias("o"))
    return own.select((F.row_number().over(Window.orderBy("o")) - 1).cast("long").alias("i"), F.count("*").over(Window.partitionBy()).alias("n"), "x")


def bootstrap_ci(values: DataFrame, x: str, order: str, resamples: int = 1000, ci: float = 0.95) -> DataFrame:
    """One row (mean, lo, hi, n) of a question set's values: percentiles of the means of resamples. The draws follow a
    fixed congruence, so that any engine gets the same."""
    numbered = _numbered(values, x, order)
    low, high = int((1 - ci) / 2 * resamples), min(int((1 + ci) / 2 * resamples) - 1, resamples - 1)
    sorted_means = _draws(numbered, resamples).agg(F.array_sort(F.collect_list("mean")).alias("m"))
    total = numbered.agg(F.coalesce(F.round(F.avg("x"), 6), F.lit(0.0)).alias("mean"), F.count("*").alias("n"))
    return total.crossJoin(sorted_means).select("mean", F.coalesce(F.round(F.get("m", F.lit(low)), 6), F.lit(0.0)).alias("lo"), F.coalesce(F.round(F.get("m", F.lit(high)), 6), F.lit(0.0)).alias("hi"), "n")


def paired_bootstrap(pairs: DataFrame, a: str, b: str, order: str, resamples: int = 2000, ci: float = 0.95) -> DataFrame:
    """One row (mean_diff, lo, hi, p_value, n, significant) of a - b on the same questions."""
    numbered = _numbered(pairs.withColumn("_d", F.col(a) - F.col(b)), "_d", order)
    low, high = int((1 - ci) / 2 * resamples), min(int((1 + ci) / 2 * resamples) - 1, resamples - 1)
    means = _draws(numbered, resamples).agg(F.array_sort(F.collect_list("mean")).alias("m"), F.avg((F.col("mean") <= 0).cast("double")).alias("le"), F.avg((F.col("mean") >= 0).cast("double")).alias("ge"))
    total = numbered.agg(F.round(F.avg("x"), 6).alias("mean_diff"), F.count("*").alias("n"))
    p = F.least(F.lit(1.0), 2 * F.least("le", "ge"))
    return total.crossJoin(means).select("mean_diff", F.round(F.get("m", F.lit(low)), 6).alias("lo"), F.round(F.get("m", F.lit(high)), 6).alias("hi"), F.round(p, 6).alias("p_value"), "n", (p < 0.05).alias("significant"))


def by_config(scores: DataFrame, metrics: list[str], order: str = "query_id") -> DataFrame:
    """(config, metric, mean, n) of scores(config, query_id, metrics...); nulls do not count. intervals() gives the
    spread of each of these means."""
    long = scores.select("config", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in metrics])).alias("e")).select("config", "e.*")
    return long.groupBy("config", "metric").agg(F.round(F.avg("x"), 6).alias("mean"), F.count("x").alias("n"))


def intervals(scores: DataFrame, metrics: list[str], order: str = "query_id", resamples: int = 1000, ci: float = 0.95) -> DataFrame:
    """(config, metric, mean, lo, hi, n) of scores(config, query_id, metrics...): the mean of each configuration and
    metric with percentiles of the means of resamples, by the draws of bootstrap_ci(), all of them in one plan."""
    long = scores.select("config", F.col(order).alias("o"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("e"))
    own = long.select("config", "o", "e.*").where("x IS NOT NULL")
    out = _resampled(own, ["config", "metric"], resamples)
    low, high = _bounds(resamples, ci)
    return out.select("config", "metric", "mean", F.round(F.get("m", F.lit(low)), 6).alias("lo"), F.round(F.get("m", F.lit(high)), 6).alias("hi"), "n")


def _bounds(resamples: int, ci: float) -> tuple[int, int]:
    return int((1 - ci) / 2 * resamples), min(int((1 + ci) / 2 * resamples) - 1, resamples - 1)


def _resampled(values: DataFrame, by: list[str], resamples: int) -> DataFrame:
    """(by..., mean, n, m) of values(by..., o, x): of each group the sorted means of resamples, by the draws of
    bootstrap_ci(). A group is a question set, held in one array."""
    lists = values.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda v: v["x"]).alias("xs"), F.round(F.avg("x"), 6).alias("mean"), F.count("*").alias("n"))
    picked = lambda r, j: F.pmod(F.pmod(F.pmod(F.lit(_A).cast("long") * (r * F.col("n") + j + 1) + _C, F.lit(_M).cast("long")) * F.lit(48271).cast("long"), F.lit(2147483647).cast("long")), F.col("n"))
    each = lists.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), F.lit(0.0), lambda s, j: s + F.get("xs", picked(F.col("r"), j).cast("int")))
    means = each.select(*by, "mean", "n", F.round(total / F.col("n"), 9).alias("m"))
    return means.groupBy(*by, "mean", "n").agg(F.array_sort(F.collect_list("m")).alias("m"))


def deltas_by(pairs: DataFrame, slice: str, a: str, b: str, order: str = "query_id", resamples: int = 2000, ci: float = 0.95) -> DataFrame:
    """(slice, mean_diff, lo, hi, p_value, n, significant) of a - b on the same questions, for each slice (a type of
    questions; null is one, too) as paired_bootstrap() gives them, all in one plan; pairs with a null do not count."""
    values = pairs.select(slice, F.col(order).alias("o"), (F.col(a) - F.col(b)).cast("double").alias("x")).where("x IS NOT NULL")
    out = _resampled(values, [slice], resamples)
    low, high = _bounds(resamples, ci)
    share = lambda test: F.size(F.filter("m", test)) / F.lit(resamples)
    p = F.least(F.lit(1.0), 2 * F.least(share(lambda x: x <= 0), share(lambda x: x >= 0)))
    return out.select(slice, F.col("mean").alias("mean_diff"), F.round(F.get("m", F.lit(low)), 6).alias("lo"), F.round(F.get("m", F.lit(high)), 6).alias("hi"), F.round(p, 6).alias("p_value"), "n", (p < 0.05).alias("significant"))


def task_summary(scores: DataFrame, score: str = "ndcg") -> DataFrame:
    """(task, score, n_splits) of scores(task, split, score) of single questions: the mean of a task's means of splits, and
    under a null task the mean over all tasks. Tasks without a score (failed ones) have a row with null and do not count."""
    splits = scores.groupBy("task", "split").agg(F.avg(score).alias("x"))
    tasks = splits.groupBy("task").agg(F.avg("x").alias("x"), F.count("x").alias("n_splits"))
    every = tasks.agg(F.lit(None).cast(scores.schema["task"].dataType).alias("task"), F.avg("x").alias("x"), F.coalesce(F.sum("n_splits"), F.lit(0)).alias("n_splits"))
    return tasks.unionByName(every).select("task", F.round("x", 6).alias("score"), "n_splits")
