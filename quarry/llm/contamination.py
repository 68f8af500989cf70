"""Benchmark decontamination over a distributed positional inverted index, with DataFrame functions only.

The index is parted by documents: each task turns its documents into postings (hash of the word, document, position),
sorts them by word and writes its shard, so building it shuffles nothing, and no word, however frequent, meets in one
task. A document's length is a posting of the empty word at the position past its last one.

A phrase is looked up by its rarest words: the lists of the rarest are read, their positions adjusted by the word's
place in the phrase to where the phrase would start, and intersected with the lists of the second rarest; what is left
is compared word by word with the documents, so the result is exact whatever hashes collide. proximity() finds
phrases' words in any order within a span.

An index is a table of its own: build_index() makes it once, and phrase_matches(), proximity() and contamination()
take it as often as wanted.

Every row of documents is indexed under a key of its own, so rows with a null id, with a repeated one, or with one that
stands for several texts are each searched and judged by their own text. Null and empty texts have no words: such
documents get a row with zeros, such items match nothing. Items with a null id mark words, and have no id to list;
repeated items count once. Empty tables give no rows, or rows without hits. Other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bounded, drop, keyed, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All that is in no word, once A-Z are lower-case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def lowered(text: str) -> Column:
    """The text with A-Z alone lower-cased, null as empty (lower() does the same to ASCII, and faster)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def words(text: str) -> Column:
    """The words of a text."""
    return F.array_remove(F.split(lowered(text), BETWEEN), "")


def build_index(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The postings (term, doc_id, pos) of all words, written in shards sorted by term; id names a key that no two rows share."""
    each = df.select(F.col(id).alias("doc_id"), F.posexplode(F.array_append(words(text), F.lit(""))).alias("pos", "word"))
    return staged(each.select(F.xxhash64("word").alias("term"), "doc_id", "pos").sortWithinPartitions("term"), "index")


def lengths(index: DataFrame) -> DataFrame:
    """(doc_id, n_words), a row for every row indexed."""
    return index.where(F.col("term") == F.xxhash64(F.lit(""))).select("doc_id", F.col("pos").cast("long").alias("n_words"))


def windows(items: DataFrame, id: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """(item_id, phrase): every run of width words of an item, or all its words if there are fewer."""
    w = items.select(F.col(id).alias("item_id"), words(text).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return w.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), width).alias("phrase")).distinct()


def _places(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """(phrase_id, n, term, off, r) for each word of each phrase, r = 1 for the one rarest in the index; phrases with a word that
    no document has are left out."""
    each = phrases.select("phrase_id", F.size("phrase").alias("n"), F.posexplode("phrase").alias("off", "word"))
    each = each.select("phrase_id", "n", F.xxhash64("word").alias("term"), "off")
    terms, _ = bounded(staged(each.select("term").distinct(), "terms"))
    seen = staged(index.select("term").join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")), "terms")
    ranked = each.join(bounded(seen)[0], "term").withColumn("r", F.row_number().over(Window.partitionBy("phrase_id").orderBy("df", "off")))
    there = F.count("*").over(Window.partitionBy("phrase_id"))
    return ranked.withColumn("there", there).where("there = n").select("phrase_id", "n", "term", "off", "r")


def phrase_matches(index: DataFrame, df: DataFrame, phrases: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(phrase, doc_id, start): every place where the words of a phrase (array<string>) follow each other in a document of df,
    of which index is the index by the same key."""
    named = staged(phrases.select("phrase").distinct().select(F.xxhash64("phrase").alias("phrase_id"), "phrase"), "phrases")
    places = staged(_places(named, index), "places")
    wanted, _ = bounded(places.where("r <= 2").select("term").distinct())
    lists = staged(index.join(wanted, "term", "left_semi"), "lists")  # of the rarest and the second rarest words, in one reading

    def listed(r: int) -> DataFrame:
        return bounded(places.where(F.col("r") == r).select("phrase_id", "term", "off"))[0]

    starts = lists.join(listed(1), "term").select("phrase_id", "doc_id", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
    expected = starts.join(listed(2), "phrase_id").select("phrase_id", "start", "term", "doc_id", (F.col("start") + F.col("off")).alias("pos"))
    alone = places.where("n = 1").select("phrase_id").distinct()
    both = expected.join(lists, ["term", "doc_id", "pos"], "left_semi").select("phrase_id", "doc_id", "start")
    found = staged(both.unionByName(starts.join(bounded(alone)[0], "phrase_id", "left_semi")), "starts")

    candidates, _ = bounded(found.select("doc_id").distinct())
    texts = df.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).join(candidates, "doc_id", "left_semi").select("doc_id", words("text").alias("w"))
    checked = texts.join(found.join(bounded(named)[0], "phrase_id"), "doc_id")
    matches = checked.where(F.slice("w", F.col("start") + 1, F.size("phrase")) == F.col("phrase"))
    matches = staged(matches.select("phrase", "doc_id", "start").distinct(), "matches")
    drop(named, places, lists, found)
    return matches


def proximity(index: DataFrame, phrases: DataFrame, span: int) -> DataFrame:
    """(phrase, doc_id, start, end): stretches of at most span words, each from the first to the last word that counts,
    that hold all distinct words of a phrase, in any order; one for each place where such a stretch can start.

    Only postings near one of the phrase's rarest word are read on, by blocks of span positions."""
    named = staged(phrases.select("phrase").distinct().select(F.xxhash64("phrase").alias("phrase_id"), "phrase"), "phrases")
    sets = named.select("phrase_id", F.array_distinct("phrase").alias("phrase"))
    places = staged(_places(sets, index), "places")
    anchor = places.where("r = 1").select("phrase_id", "term")
    anchors = index.join(bounded(anchor)[0], "term").select("phrase_id", "doc_id", F.explode(F.array(*[F.floor(F.col("pos") / span) + k for k in (-1, 0, 1)])).alias("block")).distinct()
    own = index.join(bounded(places.select("phrase_id", "term", "n"))[0], "term").withColumn("block", F.floor(F.col("pos") / span))
    own = own.join(anchors, ["phrase_id", "doc_id", "block"], "left_semi")
    # a stretch may cross a block's end: each posting is seen from its own block and the one before
    seen = own.withColumn("at", F.explode(F.array("block", F.col("block") - 1)))
    ahead = Window.partitionBy("phrase_id", "doc_id", "at").orderBy("pos").rangeBetween(0, span - 1)
    spans = seen.select("*", F.collect_set("term").over(ahead).alias("terms"), F.min_by("pos", "pos").over(ahead).alias("start"), F.collect_list(F.struct("pos", "term")).over(ahead).alias("ps"))
    full = spans.where((F.size("terms") == F.col("n")) & (F.col("at") == F.col("block")))
    firsts = F.transform(F.col("terms"), lambda t: F.array_min(F.transform(F.filter(F.col("ps"), lambda p: p["term"] == t), lambda p: p["pos"])))
    return full.select("phrase_id", "doc_id", "start", F.array_max(firsts).alias("end")).join(named, "phrase_id").select("phrase", "doc_id", "start", "end").distinct()


def contamination(
    df: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = WINDOW, key: str | None = None, index: DataFrame | None = None,
) -> DataFrame:
    """(row_key, id, n_words, n_hit, items) for every row of df: its words, how many of them are inside an occurrence of a
    window of an item, and the sorted ids (as strings) of the items whose windows occur.

    key names a column of df that no two rows share; without one, df is written with such keys first. index may be the
    index by that key, if it is there already."""
    rows = df.select(F.col(key).alias("row_key"), F.col(id).alias("id"), F.col(text).alias("text")) if key else keyed(df.select(F.col(id).alias("id"), F.col(text).alias("text")), "texts")
    own_index = index is None
    index = build_index(rows, "row_key", "text") if own_index else index
    own = staged(windows(items, item_id, item_text, width), "windows")
    matches = phrase_matches(index, rows, own, "row_key", "text")
    covered = matches.select("doc_id", F.explode(F.sequence("start", F.col("start") + F.size("phrase") - 1)).alias("pos"))
    n_hit = covered.distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    occur = matches.select("doc_id", "phrase").distinct().join(bounded(own)[0], "phrase").select("doc_id", F.col("item_id").cast("string").alias("item")).distinct()
    of_doc = occur.groupBy("doc_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = staged(n_hit.join(of_doc, "doc_id", "left"), "hits")
    n_words = staged(lengths(index), "lengths")
    drop(matches, own, *([index] if own_index else []))
    hit = n_words.join(bounded(hits)[0], "doc_id", "left").withColumnRenamed("doc_id", "row_key")
    out = rows.select("row_key", "id").join(hit, "row_key")
    return out.select("row_key", F.col("id").alias(id), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
