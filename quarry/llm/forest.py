"""Near-duplicate documents by an LSH forest of MinHash signatures.

Every distinct shingle set gets a label of DEPTH minhash values in each of TREES orders. A region is a common prefix
of labels in one tree, from FLOOR values on. In each tree a set's candidate is the least member of the deepest region
that it shares with a lesser one, so dense regions (thousands of near copies) are entered only by deep prefixes and
candidates stay linear in the number of sets. Sets whose own shingles, which no other set has, already rule out any
link are left out first: of thousands of copies, those with many edits. Candidates are confirmed on full sets; what they do not link, though it
shares a region with other components, is then compared within that region, at a greater depth where a region is
crowded, down to the depth that the threshold allows: DEPTH for 0.85, six values for 0.8. Two sets of similarity 0.85
share no prefix of FLOOR values in any tree with a probability below 1e-8, two of 0.8 with one below 1e-5, and none of
that greatest depth with one below 1e-4.

Every row has a key of its own, so a row with a null id, a repeated one, or one that stands for several texts is
compared by its own text. Null and empty texts have empty sets and link with nothing; texts of fewer words than a
shingle are one shingle. component_id is the least id in the component that is not null (null if there is none), kept
whether it is the row's own; where a component has null ids only, the row of the least key is kept. first is true for
just one row of each component: of those with the least id, that of the least key. Other columns are ignored."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.arrow import lean, slices
from quarry.llm.common import bounded, components, drop, keyed, rested, staged

TREES, DEPTH, FLOOR = 32, 8, 5
#: Members of different components up to which a region is compared as it is; beyond, it is parted by deeper prefixes.
CROWDED = 64
#: Longs of slots for each set: where one set has slots that another has not, it has shingles that the other has not.
WORDS = 16
#: Sets up to which a shingle is rare: such shingles are compared one by one where the rest cannot decide.
RARE = 20

_FACTORS = (np.random.default_rng(20240229).integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted hashes of the distinct runs of width words, or of the whole sequence if it is shorter."""
    h = W.hashes(W.split_lower(text))
    return np.unique(W.runs(h, min(width, len(h)))) if len(h) else h


def label(shingle: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minhash values of 16 bits, as two longs a tree."""
    x = (shingle >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 2000):
        np.minimum(least, (x[None, i : i + 2000] * _FACTORS[:, None]).min(axis=1), out=least)
    short = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")
    return short.view(">i8").astype(np.int64)


def _described(rows: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                n, digests, labels = [], [], []
                for x in batch.column("text").to_pylist():
                    own = shingles(x, width)
                    n.append(len(own))
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                    labels.append(label(own) if len(own) else np.empty(0, dtype=np.int64))
                offsets = np.cumsum([0, *map(len, labels)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(labels)))],
                    names=["key", "id", "n", "same", "label"],
                )

    return rows.mapInArrow(lean(run), "key long, id long, n long, same binary, label array<long>")


def _sets(df: DataFrame, width: int) -> DataFrame:
    """(id, own, bits): the set of each text, and which of 64 * WORDS slots its shingles fall into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                own = [shingles(x, width) for x in batch.column("text").to_pylist()]
                offsets = np.cumsum([0, *map(len, own)], dtype=np.int32)
                bits = np.zeros((len(own), 64 * WORDS), dtype=np.uint8)
                bits[np.repeat(np.arange(len(own)), np.diff(offsets)), np.concatenate(own) % np.uint64(64 * WORDS)] = 1
                bits = np.packbits(bits, axis=1).view(np.int64).ravel()
                places = np.arange(0, WORDS * len(own) + 1, WORDS, dtype=np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own).view(np.int64))), pa.ListArray.from_arrays(pa.array(places), pa.array(bits))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *lists], names=["id", "own", "bits"])

    return df.mapInArrow(lean(run), "id long, own array<long>, bits array<long>")


def _deepest(percent: int) -> int:
    """The greatest depth at which two sets of that similarity share no region with a probability below 1e-4."""
    return max([FLOOR] + [d for d in range(FLOOR, DEPTH + 1) if (1 - (percent / 100) ** d) ** TREES < 1e-4])


def _region(depth: int) -> list[Column]:
    """The columns that name a region: tree, the first four values, and as many of the other four as the depth adds."""
    return [F.col("tree"), F.col("hi"), F.shiftrightunsigned("lo", 16 * (8 - depth)).alias("part")]


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those that are similar enough, by their full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("own").alias("own_a"))
    right = sets.select(F.col("id").alias("b"), F.col("own").alias("own_b"))
    shared = F.size(F.array_intersect("own_a", "own_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    return joined.where(100 * shared >= percent * (F.size("own_a") + F.size("own_b") - shared)).select("a", "b")


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85, key: str | None = None) -> DataFrame:
    """(row_key, id, n_shingles, component_id, kept, first) for every row. Texts are linked if 100 * intersection >=
    percent * union of their sets of runs of width words; component_id is the least id that can be reached.

    key names a column of df that no two rows share; without one, df is written with such keys first."""
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), *([F.col(key).alias("key")] if key else []))
    rows = rows if key else keyed(rows, "texts", "key")
    spark = df.sparkSession
    described = staged(_described(rows.select("key", "id", "text"), width), "described")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    sets_of = described.where("n > 0").groupBy("same").agg(F.min("key").alias("rep"), F.first("label").alias("label"), first)
    classes = staged(sets_of, "classes")
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.element_at("label", 2 * t + 1).alias("hi"), F.element_at("label", 2 * t + 2).alias("lo")))
    every = classes.select("rep", F.explode(trees).alias("x")).select("rep", "x.*").withColumn("part", _region(FLOOR)[2])
    shared = every.groupBy("tree", "hi", "part").agg(F.count("*").alias("members")).where("members > 1").drop("members")
    met = staged(every.join(shared, ["tree", "hi", "part"]).select("rep", "tree", "hi", "lo"), "forest")

    involved, _ = bounded(met.select(F.col("rep").alias("key")).distinct())
    texts = rows.where("text IS NOT NULL").join(involved, "key", "left_semi").select(F.col("key").alias("id"), "text")
    sets = staged(_sets(texts, width), "sets")
    if not key:
        drop(rows)
    facts = staged(_linkable(sets, percent), "facts")
    forest = staged(met.join(facts.select("rep"), "rep"), "forest")
    drop(met)
    rested(spark)

    candidates = _deepest_lesser(forest)
    best = staged(candidates.groupBy("b").agg(F.max_by("a", F.struct("trees", -F.col("a"))).alias("a")), "best")
    links = [staged(_confirmed(best, sets, percent), "links")]
    roots = components(links[0])

    rest = _apart(candidates.join(best, ["a", "b"], "left_anti"), roots)
    links.append(staged(_confirmed(rest, sets, percent), "links"))
    drop(best, roots)
    roots = components(_all(links))
    rested(spark)

    pairs = _within_regions(forest, facts, roots, percent)
    drop(forest, facts)
    rested(spark)
    rest = _all(pairs).distinct().join(candidates.select("a", "b"), ["a", "b"], "left_anti")
    links.append(staged(_confirmed(rest, sets, percent), "links"))
    drop(*pairs, candidates, sets, roots)
    roots = components(_all(links))
    drop(*links)

    of_class = staged(classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("same", "first", F.col("component_id").alias("root")), "of_class")
    linked = of_class.where("root IS NOT NULL")
    of_root, _ = bounded(linked.groupBy("root").agg(F.min("first").alias("first")))
    drop(classes, roots)
    of_class = linked.select("same", "root").join(of_root, "root").select("same", "first").unionByName(of_class.where("root IS NULL").select("same", "first"))
    out = described.select("key", "id", "n", F.when(F.col("n") > 0, F.col("same")).alias("same")).join(of_class, "same", "left")
    alone = F.col("first").isNull()
    root = F.when(alone, F.col("id")).otherwise(F.col("first.id"))
    chosen = alone | (F.col("first.key") == F.col("key"))
    return out.select(
        F.col("key").alias("row_key"), F.col("id").alias(id), F.col("n").alias("n_shingles"), root.alias("component_id"),
        F.coalesce(F.col("id") == root, root.isNull() & chosen).alias("kept"), chosen.alias("first"),
    )


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _deepest_lesser(forest: DataFrame) -> DataFrame:
    """(a, b, trees): for each member b of a tree the least member a of the deepest region in which a lesser one is, and
    in how many trees that is so. From the deepest level up, only members without such a partner go on."""
    left, found, levels = forest.select("rep", "tree", "hi", "lo"), [], []
    for depth in range(DEPTH, FLOOR - 1, -1):
        here = left.withColumn("part", _region(depth)[2])
        # members that have a partner still count as partners of others
        least = forest.withColumn("part", _region(depth)[2]).groupBy("tree", "hi", "part").agg(F.min("rep").alias("a"))
        level = staged(here.join(least, ["tree", "hi", "part"]), "level")
        found.append(level.where("a < rep").select("a", F.col("rep").alias("b")))
        left = level.where("a >= rep").select("rep", "tree", "hi", "lo")
        levels.append(level)
    out = staged(_all(found).groupBy("a", "b").agg(F.count("*").alias("trees")), "candidates")
    drop(*levels)
    return out


def _component(roots: DataFrame, side: str) -> DataFrame:
    return roots.select(F.col("id").alias(side), F.col("component_id").alias(f"of_{side}"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose sides no links join yet."""
    with_roots = pairs.join(_component(roots, "a"), "a", "left").join(_component(roots, "b"), "b", "left")
    return with_roots.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _linkable(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, n, bits, common, rare): the size of each set, its slots, how many of its shingles more than RARE sets have, and the others
    that it shares. A set that shares too few for any link is left out: shingles of its own count in the union and in
    no intersection."""
    each = sets.select("id", F.explode("own").alias("s"))
    counts = each.groupBy("s").agg(F.count("*").alias("sets"), F.min("id").alias("least")).where(F.col("sets") <= RARE)
    alone = counts.where("sets = 1").groupBy(F.col("least").alias("id")).agg(F.count("*").alias("alone"))
    rare = each.join(counts.where("sets > 1").select("s"), "s").groupBy("id").agg(F.collect_list("s").alias("rare"))
    facts = sets.select("id", "bits", F.size("own").alias("n")).join(alone, "id", "left").join(rare, "id", "left")
    facts = facts.select(F.col("id").alias("rep"), "n", "bits", F.coalesce("alone", F.lit(0)).alias("alone"), F.coalesce("rare", F.array().cast("array<long>")).alias("rare"))
    able = facts.where(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n"))
    return able.select("rep", "n", "bits", (F.col("n") - F.col("alone") - F.size("rare")).alias("common"), "rare")


def _shared_at_most(n: str, bits: str, other: str) -> Column:
    """A bound of the shingles of a set that another may have, too: each slot that the other has not holds one at least
    that it has not."""
    missed = F.zip_with(bits, other, lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b))))
    return F.col(n) - F.aggregate(missed, F.lit(0), lambda total, k: total + k)


def _within_regions(forest: DataFrame, facts: DataFrame, roots: DataFrame, percent: int) -> list[DataFrame]:
    """Pairs of different components that share a region, each region at the least depth at which it is not crowded: a
    staged table for each depth. A pair may be in several.

    Of the members of a region only those outside its largest component are joined with all others, so that one large
    component and a few strangers make few pairs; and only where two bounds of what both have allow a link: by the common
    shingles and the rare ones of both, and by the slots that only one of them has."""
    bounds = [F.least("common", "common_x") + F.size(F.array_intersect("rare", "rare_x")), _shared_at_most("n", "bits", "bits_x"), _shared_at_most("n_x", "bits_x", "bits")]
    able = functools.reduce(lambda a, b: a & b, [(100 + percent) * most >= percent * (F.col("n") + F.col("n_x")) for most in bounds])
    joined = forest.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "tree", "hi", "lo", F.coalesce("component_id", "rep").alias("of"))
    left = staged(joined, "regions")
    pairs, deepest = [], _deepest(percent)
    for depth in range(FLOOR, deepest + 1):
        here = left.withColumn("part", _region(depth)[2])
        by_component = here.groupBy("tree", "hi", "part", "of").agg(F.count("*").alias("k"))
        regions = by_component.groupBy("tree", "hi", "part").agg(F.max_by("of", F.struct("k", "of")).alias("largest"), F.sum("k").alias("members"), F.max("k").alias("most")).where("members > most")
        known = staged(here.join(regions, ["tree", "hi", "part"]), "region")
        drop(left)
        open_now = (known if depth == deepest else known.where(F.col("members") - F.col("most") <= CROWDED)).join(facts, "rep")
        strangers = open_now.where("of <> largest").select("tree", "hi", "part", F.col("rep").alias("x"), F.col("of").alias("of_x"), F.col("n").alias("n_x"), F.col("bits").alias("bits_x"), F.col("common").alias("common_x"), F.col("rare").alias("rare_x"))
        met = open_now.join(strangers, ["tree", "hi", "part"]).where((F.col("of") != F.col("of_x")) & able).select(F.least("rep", "x").alias("a"), F.greatest("rep", "x").alias("b")).distinct()
        pairs.append(staged(met, "pairs"))
        if depth < deepest:
            # written, so that joins know how few they are
            left = staged(known.where(F.col("members") - F.col("most") > CROWDED).select("rep", "tree", "hi", "lo", "of"), "crowded")
        drop(known)
    return pairs
