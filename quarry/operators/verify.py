"""Checks of answers against their numbered sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X


def structural(answers: DataFrame, answer: str = "answer", n_sources: str = "n_sources") -> DataFrame:
    """answers with n_citations, valid_citations, invalid_citations, uncited_claims and all_valid."""
    cited = X.citations(answer)
    valid = lambda n: (n >= 1) & (n <= F.col(n_sources))
    invalid = F.array_sort(F.array_distinct(F.filter(cited, lambda n: ~valid(n))))
    return answers.select(
        "*",
        F.size(cited).cast("long").alias("n_citations"),
        F.array_sort(F.array_distinct(F.filter(cited, valid))).alias("valid_citations"),
        invalid.alias("invalid_citations"),
        F.filter(X.sentences(answer), X.is_uncited_claim).alias("uncited_claims"),
        (F.size(invalid) == 0).alias("all_valid"),
    )


def verdicts(claims: DataFrame, judged: DataFrame) -> DataFrame:
    """claims(query_id, idx, text, sources) with supported from judged(query_id, idx, supported, reason); what has no
    verdict, and what cites nothing, is unsupported."""
    both = claims.join(judged.select("query_id", "idx", F.col("supported").alias("v"), "reason"), ["query_id", "idx"], "left")
    return both.withColumn("supported", F.coalesce("v", F.lit(False)) & (F.size("sources") > 0)).drop("v")


def needs_judge(checked: DataFrame, skip_when_clean: bool) -> DataFrame:
    """Of structural()'s rows those a judge is asked about."""
    clean = F.col("all_valid") & (F.size("uncited_claims") == 0)
    return checked.where(~clean) if skip_when_clean else checked
