"""Vector search: exact, by blocks of queries against every vector, and approximate, over an inverted file."""

from __future__ import annotations

import copy
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions import tokens as T
from quarry.operators.best import QUERY_SLICE, Slices, in_blocks, ranked


def hashed(chunks: DataFrame, id: str = "id", text: str = "text", dim: int = 64) -> DataFrame:
    """(id, vector): a stand-in for an encoder. Each token adds one to the bucket of its MD5; unit length, or zero for a
    text without tokens. Each text's tokens are counted where it is read; nothing is exchanged."""
    kind = chunks.schema[id].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in T.slices(batch, "t"):
                row, code, words = T.tokens(rows.column("t"))
                bucket = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in words.to_pylist()], np.int64)
                counts = np.bincount(row * dim + bucket[code], minlength=rows.num_rows * dim).reshape(-1, dim).astype(float)
                norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
                vector = pa.FixedSizeListArray.from_arrays(pa.array((counts / np.where(norm > 0, norm, 1)).ravel()), dim).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([rows.column("id"), vector], names=["id", "vector"])

    return chunks.select(F.col(id).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(encode, f"id {kind}, vector array<double>")


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)


def _own(df: DataFrame, id: str, vector: str) -> DataFrame:
    return df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")


def _in_blocks(queries: DataFrame, corpus: DataFrame, schema: str, visit: Callable[[list, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """visit(block of query rows, batches of corpus), by a pass over the corpus for each block of queries."""

    def pass_over(block: list) -> DataFrame:
        shared = corpus.sparkSession.sparkContext.broadcast(block)
        return corpus.mapInArrow(lambda batches: visit(shared.value, batches), schema)

    return in_blocks(queries, corpus.sparkSession.createDataFrame([], schema), pass_over)


def _with_ordinal(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("id")], names=["id", "ordinal"])


def search(queries: DataFrame, corpus: DataFrame, n: int = 40, query_id: str = "query_id", query_vector: str = "vector", id: str = "id", vector: str = "vector") -> DataFrame:
    """(query_id, id, score, rank): the n vectors of greatest dot product for each query, ties by id.

    Blocks of queries go to the tasks, which keep the n best of all they read; so the vectors are not shuffled, and what
    is grows with queries times tasks, not with vectors."""
    q_type, id_type = queries.schema[query_id].dataType, corpus.schema[id].dataType.simpleString()
    kind = to_arrow_type(q_type)

    def best(block: list, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, kept = np.array([r[1] for r in block]), Slices([r[0] for r in block], n)
        for batch in batches:
            if batch.num_rows:
                x, rows = _vectors(batch), _with_ordinal(batch)
                for first, last, own in kept:
                    own.add(np.round(matrix[first:last] @ x.T, 9), rows)
        yield from kept.batches(kind)

    asked = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    return ranked(_in_blocks(asked, _own(corpus, id, vector), f"query_id {q_type.simpleString()}, id {id_type}, ordinal {id_type}, score double", best), n)


def gold_ranks(queries: DataFrame, corpus: DataFrame, query_id: str, query_vector: str, gold: str, id: str, vector: str) -> DataFrame:
    """(query_id, rank): one more than the number of vectors that score strictly above the query's gold vector. Queries
    whose gold vector is not there have no row. Blocks of queries go to the tasks, which return a count for each."""
    q_type = queries.schema[query_id].dataType
    kind = to_arrow_type(q_type)

    def above(block: list, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, golds = np.array([r[1] for r in block]), np.array([r[2] for r in block])
        own, counts = np.round((matrix * golds).sum(axis=1), 9), np.zeros(len(block), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch)
                for at in range(0, len(block), QUERY_SLICE):
                    here = slice(at, at + QUERY_SLICE)
                    counts[here] += (np.round(matrix[here] @ x.T, 9) > own[here, None]).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in block], kind), pa.array(counts)], names=["query_id", "above"])

    q = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("qv"), F.col(gold).alias("gold")).where("qv IS NOT NULL")
    v = _own(corpus, id, vector)
    asked = q.join(v, F.col("gold") == F.col("id")).select("q", "qv", "v")
    counted = _in_blocks(asked, v, f"query_id {q_type.simpleString()}, above long", above)
    return counted.groupBy("query_id").agg((F.sum("above") + 1).alias("rank"))


def backend(name: str, corpus: DataFrame, id: str = "id", vector: str = "vector") -> Callable[..., DataFrame]:
    """A search(queries, n) over a corpus by name: "exact", or "ivf" for an inverted file fitted and filed here."""
    if name == "exact":
        return lambda queries, n: search(queries, corpus, n, id=id, vector=vector)
    if name == "ivf":
        return InvertedFile(corpus, id=id, vector=vector).search
    raise ValueError(f"no vector backend {name!r}: exact or ivf")


class InvertedFile:
    """Approximate search: vectors filed under the nearest of some centroids, queries against the nearest lists only.

    Centroids are fitted by k-means on at most sample vectors, the first by a hash of their id; every vector is filed."""

    def __init__(self, corpus: DataFrame, lists: int = 64, id: str = "id", vector: str = "vector", sample: int = 20_000, seed: int = 1):
        own = _own(corpus, id, vector)
        rows = own.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        x = np.array([r["v"] for r in rows])
        rng = np.random.default_rng(seed)
        centers = x[rng.permutation(len(x))[: min(lists, len(x))]].copy() if len(x) else np.zeros((1, 1))
        for _ in range(10 if len(x) else 0):
            near = (x @ centers.T).argmax(axis=1)
            for k in range(len(centers)):
                if (near == k).any():
                    mean = x[near == k].mean(axis=0)
                    centers[k] = mean / max(np.sqrt(mean @ mean), 1e-12)
        self.centers, self.id_type = centers, corpus.schema[id].dataType.simpleString()
        self.filed = self._file(own)

    def _file(self, own: DataFrame) -> DataFrame:
        shared = own.sparkSession.sparkContext.broadcast(self.centers)

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = (_vectors(batch) @ shared.value.T).argmax(axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(near), batch.column("id"), batch.column("v")], names=["list", "id", "v"])

        return own.mapInArrow(file, f"list int, id {self.id_type}, v array<double>")

    def _with(self, filed: DataFrame) -> InvertedFile:
        out = copy.copy(self)
        out.filed = filed
        return out

    def added(self, more: DataFrame, id: str = "id", vector: str = "vector") -> InvertedFile:
        """With more vectors under the same centroids; those of ids that are there replace them."""
        own = _own(more, id, vector)
        return self._with(self.filed.join(own.select("id"), "id", "left_anti").select("list", "id", "v").unionByName(self._file(own)))

    def removed(self, ids: DataFrame, id: str = "id") -> InvertedFile:
        return self._with(self.filed.join(ids.select(F.col(id).alias("id")), "id", "left_anti").select("list", "id", "v"))

    def save(self, path: str) -> None:
        """Write centroids, and vectors in a folder for each list, so that a search reads the lists it looks at."""
        rows = [(i, c.tolist()) for i, c in enumerate(self.centers)]
        self.filed.sparkSession.createDataFrame(rows, "list int, center array<double>").coalesce(1).write.parquet(f"{path}/centers")
        self.filed.repartition("list").write.partitionBy("list").parquet(f"{path}/filed")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> InvertedFile:
        out = cls.__new__(cls)
        out.centers = np.array([r["center"] for r in spark.read.parquet(f"{path}/centers").orderBy("list").collect()])
        out.filed = spark.read.parquet(f"{path}/filed").select("list", "id", "v")
        out.id_type = out.filed.schema["id"].dataType.simpleString()
        return out

    def search(self, queries: DataFrame, n: int = 10, probes: int = 16, query_id: str = "query_id", query_vector: str = "vector") -> DataFrame:
        """(query_id, id, score, rank) from each query's nearest lists. Blocks of queries go to the tasks, which multiply
        the vectors of each list with the queries that look at it and keep the n best of all they read."""
        q_type = queries.schema[query_id].dataType
        kind, centers = to_arrow_type(q_type), self.centers

        def pass_over(block: list) -> DataFrame:
            matrix = np.array([r[1] for r in block])
            looks = np.zeros((len(block), len(centers)), bool)
            np.put_along_axis(looks, np.argsort(-(matrix @ centers.T), axis=1, kind="stable")[:, :probes], True, 1)
            shared = self.filed.sparkSession.sparkContext.broadcast(([r[0] for r in block], matrix, looks))

            def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                keys, matrix, looks = shared.value
                kept = Slices(keys, n)
                for batch in batches:
                    by = np.argsort(batch.column("list").to_numpy(), kind="stable")
                    batch = batch.take(pa.array(by))
                    lists, starts = np.unique(batch.column("list").to_numpy(), return_index=True)
                    for which, at, to in zip(lists, starts, [*starts[1:], batch.num_rows]):
                        x, rows = _vectors(here := batch.slice(at, to - at)), _with_ordinal(here)
                        for first, last, own in kept:
                            asked = np.flatnonzero(looks[first:last, which])
                            own.add(np.round(matrix[first + asked] @ x.T, 9), rows, which=asked)
                yield from kept.batches(kind)

            read = self.filed.where(F.col("list").isin([int(i) for i in np.flatnonzero(looks.any(axis=0))]))
            return read.mapInArrow(best, f"query_id {q_type.simpleString()}, id {self.id_type}, ordinal {self.id_type}, score double")

        own = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("qv")).where("qv IS NOT NULL")
        none = self.filed.sparkSession.createDataFrame([], f"query_id {q_type.simpleString()}, id {self.id_type}, ordinal {self.id_type}, score double")
        return ranked(in_blocks(own, none, pass_over), n)


def added(corpus: DataFrame, more: DataFrame, id: str = "id") -> DataFrame:
    """Rows of more replace rows of the same id."""
    return corpus.join(more.select(id), id, "left_anti").unionByName(more)


def removed(corpus: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    return corpus.join(ids.select(id), id, "left_anti")
