"""Near-duplicate embeddings by NN-descent.

Distinct vectors get neighbour lists of K entries from ORDERS random sign orders (vectors that follow each other in an
order are compared), which rounds of neighbours-of-neighbours joins refine until few entries change. Edges of at least
the threshold give components. A list whose entries all pass the threshold is saturated: it may have no room for links
to other components. Vectors with such lists get further lists, of vectors of other components only, by the same orders
and rounds, and what passes the threshold joins components, until a search finds no more. The links of a vector are
then counted by comparing its component in blocks, exactly. Links lie within components, so what can be missed is a
link between two of them.

An audit measures that: it compares AUDIT vectors, the first by a hash of their key, and as many of those with links
with all vectors, and takes more of the former (up to AUDIT_MOST) until it has seen ENOUGH links. While it finds too
many links missing there are further orders and rounds; if REPAIRS searches do not bring the recall to RECALL, the
components are found exactly, by comparing all vectors in blocks. near_duplicates(report=[]) gets for each length of
vectors the recall before anything the audit saw was added, None if there were no links to see.

Every row has a key of its own, so rows with a null id, a repeated one, or one that stands for several vectors count as
vectors of their own. component_id is the least id of the component that is not null; of a component with null ids
only, it is null and the row of the least key is kept. Vectors that are null, zero or of no elements, or hold null or
non-finite elements, link with nothing. Vectors of different lengths do not link. Equal vectors are compared once and
count as many times as they occur. Other columns are ignored."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bounded, components, drop, staged

log = logging.getLogger(__name__)

K, ORDERS, NEAR, ROUNDS, REPAIRS = 10, 16, 6, 4, 4
AUDIT, AUDIT_MOST, ENOUGH, RECALL = 256, 8192, 500, 0.999
BLOCK = 512
#: A refinement ends when at most this share of list entries is new.
SETTLED = 0.01


def _matrix(column) -> np.ndarray:
    """A column of equally long binary vectors as rows of doubles."""
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64)
    return flat.reshape(len(column), -1)


def _vectors(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(key, id, dim, x): x the unit vector as binary doubles, null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                a = np.array(v, dtype=np.float64) if v else np.zeros(1)  # None becomes nan
                top = np.abs(a).max()
                a = a / top if np.isfinite(top) and top > 0 else None
                out.append(None if a is None else (a / np.sqrt(a @ a)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array([len(x) // 8 if x else 0 for x in out], pa.int32()), pa.array(out, pa.binary())], names=["key", "id", "dim", "x"])

    rows = df.select(F.monotonically_increasing_id().alias("key"), F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "key long, id long, dim int, x binary")


def _ordered(vectors: DataFrame, dim: int, seed: int) -> DataFrame:
    """Edges (v, u, sim) both ways between vectors of different groups that are near in one of the random sign orders.
    Of vectors of one group that follow each other only the outer ones count, so that a large group hides no other."""
    planes = np.random.default_rng(seed).standard_normal((ORDERS, 48, dim))
    weights = (1 << np.arange(47, -1, -1)).astype(np.int64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                for k in range(ORDERS):
                    key = (x @ planes[k].T > 0) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, dtype=np.int32)), pa.array(key), batch.column("id"), batch.column("x"), batch.column("of")], names=["k", "key", "id", "x", "of"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if before is not None:
                batch = pa.Table.from_batches([before, batch]).combine_chunks().to_batches()[0]
            k, of = batch.column("k").to_numpy(), batch.column("of").to_numpy()
            at = np.arange(len(k))
            change = np.flatnonzero((k[1:] != k[:-1]) | (of[1:] != of[:-1])) + 1
            run = np.searchsorted(change, at, "right")
            first, end = np.concatenate([[0], change])[run], np.concatenate([change, [len(k)]])[run]
            outer = np.flatnonzero((at - first < NEAR) | (end - at <= NEAR))
            batch, k, of = batch.take(pa.array(outer)), k[outer], of[outer]
            ids, x = batch.column("id").to_numpy(), _matrix(batch.column("x"))
            for step in range(1, min(NEAR, len(ids) - 1) + 1):
                same = (k[step:] == k[:-step]) & (of[step:] != of[:-step])
                a, b, sim = ids[step:][same], ids[:-step][same], np.einsum("ij,ij->i", x[step:], x[:-step])[same]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a])), pa.array(np.concatenate([sim, sim]))], names=["v", "u", "sim"])
            before = batch.slice(max(0, batch.num_rows - NEAR))

    rows = vectors.select("id", "x", "of").mapInArrow(keyed, "k int, key long, id long, x binary, of long")
    ordered = rows.repartitionByRange("k", "key", "id").sortWithinPartitions("k", "key", "id")
    return ordered.mapInArrow(near, "v long, u long, sim double")


def _best(edges: DataFrame, k: int = K) -> DataFrame:
    """Each vertex's k nearest of its edges."""
    once = edges.groupBy("v", "u").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))
    return once.withColumn("r", rank).where(F.col("r") <= k).select("v", "u", "sim", "r")


def _joined(lists: DataFrame, vectors: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Edges between groups that neighbours of a common vertex, by lists or by those within groups, would add."""
    worst = lists.groupBy(F.col("v").alias("u")).agg(F.when(F.count("*") >= K, F.min("sim")).otherwise(F.lit(-2.0)).alias("worst"))
    around = None
    for each in [lists] if within is None else [lists, within]:
        back = _best(each.select(F.col("u").alias("v"), F.col("v").alias("u"), "sim"))
        both = each.select("v", "u").unionByName(back.select("v", "u"))
        around = both if around is None else around.unionByName(both)
    member = around.distinct().join(vectors.select(F.col("id").alias("u"), "x", "of"), "u").join(worst, "u", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))

    def meet(table: pa.Table) -> pa.Table:
        ids, of, worst, x = table["u"].to_numpy(), table["of"].to_numpy(), table["worst"].to_numpy(), _matrix(table["x"].combine_chunks())
        sim = x @ x.T
        sim[of[:, None] == of] = -3
        a, b = np.nonzero(sim > worst[:, None])
        return pa.table({"v": ids[a], "u": ids[b], "sim": sim[a, b]})

    # a group is a vertex's list and its K nearest backward neighbours, of each kind: 4 * K rows at most
    return member.groupBy("v").applyInArrow(meet, "v long, u long, sim double")


def _refined(lists: DataFrame, vectors: DataFrame, within: DataFrame | None = None) -> DataFrame:
    lists = staged(lists, "lists")
    for _ in range(ROUNDS):
        better = staged(_best(lists.select("v", "u", "sim").unionByName(_joined(lists, vectors, within))), "lists")
        new = better.join(lists, ["v", "u"], "left_anti").count()
        total = better.count()
        drop(lists)
        lists = better
        if new <= SETTLED * total:
            break
    return lists


def _bridged(vectors: DataFrame, lists: DataFrame, of: DataFrame, dim: int, seed: int, least: float) -> DataFrame:
    """(id, component_id), with the components joined between which saturated lists had no room for links. A link that
    has no place in the list of one side is in that of the other, unless both are saturated."""
    full = staged(lists.where(F.col("sim") >= least).groupBy(F.col("v").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= K).select("id"), "full")
    within = None
    while True:
        here = vectors.select("id", "x").join(full, "id").join(of, "id").select("id", "x", F.col("component_id").alias("of"))
        if here.select("of").distinct().limit(2).count() < 2:
            return of
        here = staged(here, "saturated")
        if within is None:
            side = lambda n: full.select(F.col("id").alias(n))
            within = staged(lists.join(side("v"), "v", "left_semi").join(side("u"), "u", "left_semi").select("v", "u", "sim"), "within")
        seed += 1000
        across = _refined(_best(_ordered(here, dim, seed)), here, within)
        found = across.where(F.col("sim") >= least).select("v", "u")
        if not found.limit(1).count():
            return of
        of = staged(components(_star(of).unionByName(found), "v", "u"), "components")
        drop(here, across)


def _star(of: DataFrame) -> DataFrame:
    """Edges (v, u) that connect each component."""
    return of.select(F.col("id").alias("v"), F.col("component_id").alias("u"))


def _audited(vectors: DataFrame, chosen: DataFrame, most: int, least: float) -> DataFrame:
    """All edges of at least the threshold of chosen vectors (at most that many), by comparison with every vector."""
    got = chosen.select("id", "x").limit(most).collect()
    ids, x = np.array([r["id"] for r in got], dtype=np.int64), np.stack([np.frombuffer(r["x"], dtype=np.float64) for r in got])
    shared = vectors.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for batch in batches:
            if batch.num_rows:
                own, there = batch.column("id").to_numpy(), _matrix(batch.column("x"))
                for i in range(0, len(ids), BLOCK):
                    sim = x[i : i + BLOCK] @ there.T
                    a, b = np.nonzero(sim >= least)
                    other = ids[i + a] != own[b]
                    a, b = a[other], b[other]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + a]), pa.array(own[b]), pa.array(sim[a, b])], names=["v", "u", "sim"])

    out = staged(vectors.select("id", "x").mapInArrow(run, "v long, u long, sim double"), "audit")
    shared.destroy()
    return out


def _truth(vectors: DataFrame, of: DataFrame, least: float) -> DataFrame:
    """The links of the audited vectors: some with links found, and some of all, more of these until there are enough."""
    order = [F.xxhash64("id"), F.col("id")]
    total, size, out = vectors.count(), AUDIT, None
    linked = vectors.join(of.select("id"), "id", "left_semi").orderBy(*order)
    if linked.limit(1).count():
        out = _audited(vectors, linked, AUDIT, least)
    while True:
        some = _audited(vectors, vectors.orderBy(*order), size, least)
        if size >= min(total, AUDIT_MOST) or some.count() >= ENOUGH:
            return some if out is None else out.unionByName(some).distinct()
        drop(some)
        size *= 4


def _exactly(vectors: DataFrame, least: float) -> DataFrame:
    """(id, component_id) by comparing all vectors in blocks: the way that needs no luck, and n * n products. Each pair
    of blocks sends on a star for each component of the two, so rows stay few."""
    blocks = max(1, -(-vectors.count() // BLOCK))
    rows = vectors.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "x")

    def linked(table: pa.Table) -> pa.Table:
        ids, x = table["id"].to_numpy(), _matrix(table["x"].combine_chunks())
        a, b = np.nonzero(x @ x.T >= least)
        root = np.arange(len(ids))
        while True:  # the least place that can be reached
            new = root.copy()
            np.minimum.at(new, a, root[b])
            new = new[new]
            if (new == root).all():
                break
            root = new
        far = root != np.arange(len(ids))
        return pa.table({"v": ids[far], "u": ids[root[far]]})

    return components(rows.groupBy("i", "j").applyInArrow(linked, "v long, u long"), "v", "u")


def _links(vectors: DataFrame, dim: int, least: float) -> tuple[DataFrame, float | None]:
    """(id, component_id) of vectors with links, and the recall of links that the last audit measured."""
    vectors = vectors.withColumn("of", F.col("id"))
    truth, lists, recall = None, None, None
    for repair in range(REPAIRS):
        start = _ordered(vectors, dim, 7 + repair)
        if lists is not None:
            start = start.unionByName(lists.select("v", "u", "sim"))
        lists = _refined(_best(start), vectors)
        found = components(lists.where(F.col("sim") >= least), "v", "u")
        of = _bridged(vectors, lists, staged(found, "components"), dim, 7 + repair, least)
        truth = staged(_truth(vectors, of, least), "truth") if truth is None else truth
        side = lambda n: of.select(F.col("id").alias(n), F.col("component_id").alias(f"of_{n}"))
        seen, same = truth.join(side("v"), "v", "left").join(side("u"), "u", "left").agg(F.count("*"), F.count(F.when(F.col("of_v") == F.col("of_u"), 1))).first()
        recall = same / seen if seen else None
        if recall in (None, 1.0):
            return of, recall
    if recall < RECALL:
        log.warning("%d dimensions: recall of links %.4f after %d searches; comparing all vectors in blocks", dim, recall, REPAIRS)
        return _exactly(vectors, least), recall
    return staged(components(_star(of).unionByName(truth.select("v", "u")), "v", "u"), "components"), recall  # what the audit saw counts


def _counted(vectors: DataFrame, of: DataFrame, least: float) -> DataFrame:
    """(id, n): the weights of all vectors linked with each, by comparing each component's blocks with each other."""
    sizes = of.groupBy("component_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = vectors.join(of, "id").join(sizes, "component_id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component_id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "weight", "x")

    def count(table: pa.Table) -> pa.Table:
        ids, weight, block, x = table["id"].to_numpy(), table["weight"].to_numpy(), table["block"].to_numpy(), _matrix(table["x"].combine_chunks())
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        a, b = block == i, block == j
        linked = x[a] @ x[b].T >= least
        if i == j:
            np.fill_diagonal(linked, False)
            return pa.table({"id": ids[a], "n": linked @ weight[b]})
        return pa.table({"id": np.concatenate([ids[a], ids[b]]), "n": np.concatenate([linked @ weight[b], linked.T @ weight[a]])})

    return rows.groupBy("component_id", "i", "j").applyInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(df: DataFrame, id: str = "vec_id", vector: str = "embedding", least: float = 0.95, report: list | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of df. A report gets (length of vectors, audited recall)."""
    rows = staged(_vectors(df, id, vector), "vectors")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    classes = staged(rows.where("x IS NOT NULL").groupBy("dim", "x").agg(F.min("key").alias("rep"), F.count("*").alias("weight"), first), "classes")
    facts = None
    for (dim,) in sorted(tuple(r) for r in classes.select("dim").distinct().collect()):
        own = classes.where(F.col("dim") == dim).select(F.col("rep").alias("id"), "x", "weight")
        of, recall = _links(own, dim, least)
        log.info("%d dimensions, audited recall of links %s", dim, recall)
        if report is not None:
            report.append((dim, recall))
        here = own.select("id", "weight").join(of, "id", "left").join(_counted(own, of, least), "id", "left")
        facts = here if facts is None else facts.unionByName(here)
    if facts is None:
        return rows.select(F.col("id").alias(id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    facts = facts.select(F.col("id").alias("rep"), F.col("component_id").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    known = staged(classes.select("x", "rep", "first").join(facts, "rep"), "facts")
    linked = known.where("root IS NOT NULL")
    of_root, _ = bounded(linked.groupBy("root").agg(F.min("first").alias("first")))
    known = linked.select("x", "root", "n_links").join(of_root, "root").drop("root").unionByName(known.where("root IS NULL").select("x", "n_links", "first"))
    out = rows.select("key", "id", "x").join(known, "x", "left")
    alone = F.col("first").isNull()
    root = F.when(alone, F.col("id")).otherwise(F.col("first.id"))
    kept = F.coalesce(F.col("id") == root, root.isNull() & (alone | (F.col("first.key") == F.col("key"))))
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), kept.alias("kept"))
