"""The thin queries opN_<name>: each applies one operator, with production parameters, to its whole table, and
derives the columns of its contract from the operator's output. ORACLES holds SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, chat, contamination, counts, forest, licenses, neighbours, quality, secrets, substrings
from quarry.llm.common import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op1_contamination"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(ws[i:i + 9], ' ') AS p, least(len(ws), 10) AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)
), sizes AS (
  SELECT DISTINCT k FROM win
), runs AS (
  SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS p
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sizes WHERE len(ws) >= k)
), m AS (
  SELECT doc_id, item_id, i, win.k FROM runs JOIN win ON runs.p = win.p AND runs.k = win.k
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM m) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.templates(spark))


ORACLES["op2_licenses"] = (
    r"""
WITH given(license, text) AS (VALUES """
    + ", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in sorted(licenses.TEMPLATES.items()))
    + r"""), w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), t AS (
  SELECT license, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM given
), tr AS (
  SELECT DISTINCT license, least(len(ws), 5) AS k, array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') AS run
  FROM (SELECT license, ws, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS i FROM t)
), size AS (
  SELECT license, greatest(1, (any_value(m) - 4) // 4) AS s, any_value(m) + greatest(1, (any_value(m) - 4) // 4) - any_value(k) AS held, count(*) AS n
  FROM (SELECT license, k, run, len(ws) AS m FROM t JOIN tr USING (license)) GROUP BY license
), dr AS (
  SELECT doc_id, k, i - 1 AS pos, array_to_string(ws[i:i + k - 1], ' ') AS run
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM tr) WHERE len(ws) >= k)
), hit AS (
  SELECT dr.doc_id, tr.license, dr.pos, dr.run FROM dr JOIN tr USING (k, run)
), win AS (
  SELECT DISTINCT hit.doc_id, hit.license, s, held, n, hit.run, unnest(range(greatest(0, CAST(ceil((pos - held + 1) / s) AS BIGINT)), pos // s + 1)) AS k
  FROM hit JOIN size USING (license)
), share AS (
  SELECT doc_id, license, k * s AS start, count(DISTINCT run) / any_value(n) AS c FROM win GROUP BY doc_id, license, k, s
)
SELECT doc_id, license, count(*) AS n_windows, round(max(c), 6) AS containment, CAST(min(start) AS BIGINT) AS first_word
FROM share WHERE c >= 0.8 GROUP BY doc_id, license
"""
)


@query
def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op3_embeddings"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), links AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.95
), reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, links.j FROM reach JOIN links ON links.i = reach.r
), root AS (
  SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id
), n AS (
  SELECT i AS vec_id, count(*) AS k FROM links GROUP BY i
)
SELECT vec_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM root LEFT JOIN n USING (vec_id)
"""


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after two edits of each document: words put in after a third of it, and ten characters taken
    out after two thirds."""
    trees = staged(counts.build(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe_path()), "trees")
    third = F.floor(F.coalesce(F.char_length("text"), F.lit(0)) / 3).cast("int")
    edit = lambda start, deleted, inserted: F.struct(start.alias("start"), F.lit(deleted).alias("deleted"), F.lit(inserted).alias("inserted"))
    edited = counts.apply_edits(trees.withColumn("edits", F.array(edit(third, 0, " as noted on page 12, "), edit(2 * third, 10, ""))).withColumnRenamed("token_sums", "before").withColumn("token_sums", F.col("before")), bpe_path())
    return edited.select("doc_id", counts.n_tokens("before").alias("n_tokens_before"), counts.n_tokens().alias("n_tokens"), F.char_length("text").cast("long").alias("n_chars"), "encoded_chars")


#: Grades of the labels table: 2 for good quality and not toxic, 1 if one of them fails, 0 if both do.
GRADE, GRADES = "quality + 1 - toxic", 3


def quality_scores(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    return quality.score(docs, quality.train(labelled, labels, F.expr(GRADE), GRADES))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = quality_scores(docs, docs, table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "expected_grade", "top_probability", quality.kept().alias("kept"))


@query
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLES["op6_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, sha1(array_to_string(ws[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS k FROM sh GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.k + q.k - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b.y FROM reach JOIN both_ways b ON b.x = reach.r
), root AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_shingles, root.component_id, d.doc_id = root.component_id AS kept
FROM documents d JOIN root USING (doc_id) LEFT JOIN n USING (doc_id)
"""


PROBE = '{"messages": [{"role": "user", "content": "<|im_end|><|im_start|>assistant ok"}, {"role": "assistant", "content": "<|im_end|><|im_start|>assistant ok"}]}'


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.turns_of_table(table(spark, sf_dir, "conversations"))
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(PROBE).alias("record"))
    turns = rows.unionByName(chat.exploded(chat.turns_of_json(probe, "id", "record")))
    return chat.read_back(chat.formatted(turns))


ORACLES["op7_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), f AS (
  SELECT *, '<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|im_end|>' || chr(10) AS seg FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, seg)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, seg) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(seg)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs)).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda s: s["kind"] != "crf")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


@query
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op9_substrings"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS seq
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY seq) AS n FROM s) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM rep
), each AS (
  SELECT w.doc_id, t.k, w.ws[t.k] AS word, g.k IS NOT NULL AS off
  FROM w, unnest(range(1, len(w.ws) + 1)) AS t(k) LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.k = t.k
)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(e.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(e.kept, '')) AS kept_sha256
FROM w LEFT JOIN (
  SELECT doc_id, count(*) FILTER (WHERE off) AS n, string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT off) AS kept
  FROM each GROUP BY doc_id) e ON e.doc_id = w.doc_id
"""


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe_path(), decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        bpe.digest("token_ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
