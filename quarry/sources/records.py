"""Question and benchmark files in JSON lines, tolerant of their several layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GOLDEN = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("question", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("relevant_files", T.ArrayType(T.StringType())), T.StructField("relevant_symbols", T.ArrayType(T.StringType())),
    T.StructField("reference_answer", T.StringType()), T.StructField("holdout", T.BooleanType()),
])

#: Field names of benchmark records, the first that holds something wins (fixed values).
PAIR_QUERY = ("query", "docstring", "func_documentation_string", "doc")
PAIR_CODE = ("code", "func_code_string", "function", "whole_func_string")
BENCH_QUERY = ("query", "question", "nl", "prompt", "intent", "text")
BENCH_DOC = (
    "doc", "document", "canonical_solution", "answer", "code",
    "positive", "positive_passage", "passage", "context",
)
BENCH_ID = ("doc_id", "id", "_id", "docid")
BENCH_RELEVANT = ("relevant_ids", "positive_ids", "positives", "gold_ids")


def golden(spark: SparkSession, path: str, with_holdout: bool = True) -> DataFrame:
    """Questions of a JSON lines file; blank lines and // comments are passed over, id and question are needed."""
    lines = spark.read.text(path).where(~F.rlike("value", F.lit(r"^\s*(//|$)")))
    rows = lines.select(F.from_json("value", GOLDEN).alias("r")).select("r.*").where("id IS NOT NULL AND question IS NOT NULL")
    return rows if with_holdout else rows.where(~F.coalesce("holdout", F.lit(False)))


def _field(raw: Column, name: str) -> Column:
    """A field of a parsed record as text; lists of strings joined by a space; null if empty."""
    value = F.try_variant_get(raw, f"$['{name}']", "string")
    listed = F.array_join(F.try_variant_get(raw, f"$['{name}']", "array<string>"), " ")
    return F.nullif(F.coalesce(listed, value), F.lit(""))


def first_of(raw: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[_field(raw, n) for n in names])


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(~F.rlike("value", F.lit(r"^\s*$")))
    return lines.select(F.try_parse_json("value").alias("r"), F.monotonically_increasing_id().alias("line"))


def code_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(id, query, code) of records that have both."""
    r = F.col("r")
    return _parsed(spark, path).select(F.concat(F.lit("p"), F.col("line").cast("string")).alias("id"), first_of(r, PAIR_QUERY).alias("query"), first_of(r, PAIR_CODE).alias("code")).where("query IS NOT NULL AND code IS NOT NULL")


def bench(spark: SparkSession, path: str) -> DataFrame:
    """(id, query, doc, relevant_ids) of records that have query and doc: a record without relevant ids is its own answer, one without id has its line."""
    r = F.col("r")
    own = F.coalesce(first_of(r, BENCH_ID), F.concat(F.lit("d"), F.col("line").cast("string")))
    listed = F.coalesce(*[F.try_variant_get(r, f"$['{n}']", "array<string>") for n in BENCH_RELEVANT])
    rows = _parsed(spark, path).select(own.alias("id"), first_of(r, BENCH_QUERY).alias("query"), first_of(r, BENCH_DOC).alias("doc"), listed.alias("relevant_ids"))
    return rows.withColumn("relevant_ids", F.coalesce("relevant_ids", F.array("id"))).where("query IS NOT NULL AND doc IS NOT NULL")
