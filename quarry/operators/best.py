"""The n best of all rows for each of some queries: kept in tasks, then ranked over all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one pass over the rows answers; more are answered in further passes.
QUERY_BLOCK = 4096
#: Of these as many meet a batch of rows at once.
QUERY_SLICE = 256


def ranked(scored: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "id", "score", "rank")


def in_blocks(queries: DataFrame, none: DataFrame, pass_over: Callable[[list], DataFrame]) -> DataFrame:
    """pass_over(rows of queries), by blocks, all together; none where there are no queries."""
    out, block = None, []
    for r in queries.toLocalIterator():
        block.append(tuple(r))
        if len(block) == QUERY_BLOCK:
            found = pass_over(block)
            out, block = found if out is None else out.unionByName(found), []
    if block:
        found = pass_over(block)
        out = found if out is None else out.unionByName(found)
    return none if out is None else out


class Best:
    """Of what is added to each query the n of greatest score, ties by ordinal; a score that is no number is the
    greatest, as an ORDER BY has it."""

    def __init__(self, queries: int, n: int):
        self.n, self.floor, self.most = n, np.full(queries, -np.inf), 10_000 + 4 * n * queries
        self.kept: list[tuple[np.ndarray, np.ndarray, pa.RecordBatch]] = []
        self.size = 0

    def add(self, scores: np.ndarray, rows: pa.RecordBatch, may: np.ndarray | None = None, which: np.ndarray | None = None) -> None:
        """Scores by query (all of them, or those at the places which) and row; rows has id and ordinal; may tells which
        pairs count."""
        if not scores.size:
            return
        which = np.arange(len(scores)) if which is None else which
        order = np.where(np.isnan(scores), np.inf, scores)
        if may is not None:
            order[~may] = -np.inf
        if order.shape[1] >= self.n and np.isinf(self.floor[which]).any():
            self.floor[which] = np.maximum(self.floor[which], -np.partition(-order, self.n - 1, axis=1)[:, self.n - 1])
        ok = order >= self.floor[which, None]
        if may is not None:
            ok &= may
        q, d = np.nonzero(ok)
        if len(q):
            self.kept.append((which[q], scores[q, d], rows.select(["id", "ordinal"]).take(pa.array(d))))
            self.size += len(q)
        if self.size > self.most:
            self._cut()

    def _cut(self) -> None:
        if not self.kept:
            return
        query, score = (np.concatenate([k[i] for k in self.kept]) for i in (0, 1))
        rows = pa.Table.from_batches([k[2] for k in self.kept]).combine_chunks().to_batches()[0]
        order = np.where(np.isnan(score), np.inf, score)
        by = np.lexsort((np.array(rows.column("ordinal").to_pylist()), -order, query))
        place = np.arange(len(by)) - np.searchsorted(query[by], query[by])
        last = by[place == self.n - 1]
        self.floor[query[last]] = order[last]
        by = by[place < self.n]
        self.kept, self.size = [(query[by], score[by], rows.take(pa.array(by)))], len(by)
        self.most = max(self.most, 4 * self.size)

    def batches(self, keys: list, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """(query_id, id, ordinal, score), a query's id being keys[its place]."""
        self._cut()
        for query, score, rows in self.kept:
            columns = [pa.array([keys[i] for i in query], kind), rows.column("id"), rows.column("ordinal"), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "ordinal", "score"])


class Slices:
    """A Best for each QUERY_SLICE of a block of queries: (first, last, best)."""

    def __init__(self, keys: list, n: int):
        self.keys = keys
        self.each = [(at, min(at + QUERY_SLICE, len(keys)), Best(min(QUERY_SLICE, len(keys) - at), n)) for at in range(0, len(keys), QUERY_SLICE)]

    def __iter__(self) -> Iterator[tuple[int, int, Best]]:
        return iter(self.each)

    def batches(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for first, last, best in self.each:
            yield from best.batches(self.keys[first:last], kind)
