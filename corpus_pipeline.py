"""A corpus pipeline of five stages, each applying one operator of quarry.llm to all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
folder and reads it again as the next stage's docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, contamination, forest, quality, queries, secrets
from quarry.llm.common import bounded, keyed, rested, staged

#: Texts of at least this similarity of five-word shingles, in percent, are near duplicates.
SIMILAR = 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose probability of the highest grade is too low. Null text counts as empty; without labels of two
    grades all stay; each of repeated rows is judged alike."""
    rated = queries.quality_scores(docs.select(*COLUMNS), docs, queries.table(spark, sf_dir, "labels"))
    return rated.where(quality.kept()).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: of those with the least id (null ids last) the first. Rows are
    compared by their texts, whatever their ids: texts that share an id and are no near duplicates all stay, and so do
    rows without words."""
    rows = keyed(docs.select(*COLUMNS), "rows")
    found = forest.near_duplicates(rows, percent=SIMILAR, key="row_key")
    left = _without(rows, found.where("NOT first"))
    rested(spark)
    return left


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go that hold a window of a benchmark item, whatever their ids; rows without words and, without items, all stay."""
    rows = keyed(docs.select(*COLUMNS), "rows")
    found = contamination.contamination(rows, queries.table(spark, sf_dir, "benchmark"), key="row_key")
    left = _without(rows, found.where("n_hit > 0"))
    rested(spark)
    return left


def _without(rows: DataFrame, found: DataFrame) -> DataFrame:
    gone, _ = bounded(staged(found.select("row_key"), "gone"))
    return rows.join(gone, "row_key", "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; secrets in their texts give way to a mask. Null and empty texts stay as they are."""
    masked = secrets.scan(docs.select(*COLUMNS), secrets.train(docs), redacted="text")
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's token ids and their number; null text has none."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), queries.bpe_path())
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: The trained classifier, the trained field and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
