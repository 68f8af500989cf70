"""The corpus pipeline on rows with planted cases."""

import random

from helpers import SF

import corpus_pipeline
from quarry.llm import contamination, forest, queries


def test_stages_take_effect(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    secret = "The key is password=0123456789abcdef01 and nothing else in this otherwise plain text of words."
    item = queries.table(spark, SF, "benchmark").orderBy("item_id").first()["text"]
    extra = spark.createDataFrame([(9001, secret, "en", "p", 1), (9002, f"Some words. {item} More words.", "en", "p", 1), (9003, None, "en", "p", None), (9001, secret, "en", "p", 1)], docs.schema)
    docs = docs.unionByName(extra)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == corpus_pipeline.COLUMNS and kept.where("doc_id = 9001").count() == 1
    assert forest.near_duplicates(kept).where("NOT kept").count() == 0
    clean = corpus_pipeline.drop_contaminated(spark, kept, SF)
    assert clean.where("doc_id = 9002").count() == 0 and clean.where("doc_id = 9001").count() == 1
    assert contamination.contamination(clean, queries.table(spark, SF, "benchmark")).where("n_hit > 0").count() == 0
    masked = corpus_pipeline.mask_secrets(spark, clean, SF)
    assert masked.count() == clean.count()
    assert "0123456789abcdef01" not in masked.where("doc_id = 9001").first()["text"]
    assert corpus_pipeline.encode(spark, masked, SF).count() == masked.count()
    rated = corpus_pipeline.keep_quality(spark, docs, SF)
    assert rated.columns == corpus_pipeline.COLUMNS and rated.count() > 0.5 * docs.count()


def test_pairs_between_80_and_85_percent(spark):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        w = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
        v = [f"new{k}" if k in (20, 70, 120, 170) else x for k, x in enumerate(w)]
        a, b = ({tuple(x[k : k + 5]) for k in range(196)} for x in (w, v))
        assert 0.80 <= len(a & b) / len(a | b) < 0.85
        rows += [(2 * i, " ".join(w), "en", "p", 1), (2 * i + 1, " ".join(v), "en", "p", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 80, 2))
    assert [forest._deepest(p) for p in (85, 80)] == [8, 6]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.where("n_tokens <> size(token_ids)").count() == 0 and out.count() > 0
