"""Substring dedup: words in a window of many words that also starts elsewhere are removed.

Documents are dealt into blocks of about BLOCK_BYTES of text, by a key that no two rows share, so that copies of a row
are dealt like other rows. Blocks are buckets of a table, so later steps find the rows of a block without another
shuffle. Three passes over it:

1. Each block makes its part of a count-min sketch of all windows: for either lane the cells its windows fall into,
   as gaps between sorted cells (about a byte a window). Parts of the same range of cells are merged, and each block
   gets back one bit per cell: whether the merged count reaches two. The estimate never falls short.
2. Only windows that both lanes estimate repeated are grouped exactly, in the same manner, by keys of 128 bits: two
   hashes of the word sequence, each from hashes of the words of its own. (Different windows of equal keys would count
   as repeated; among 10^13 windows some pair has equal keys with a probability under 10^-12.)
3. Words covered by a window that is repeated are removed.

No message depends on a key's frequency: a window in a third of all documents is one key per block. A block sends one
message for each range of cells while such messages are worth sending (LEAST_CELLS cells on average). In larger inputs
a range would get less than that from a block: then blocks send to groups of ranges, messages of many blocks to one
group are merged first, and only what is merged goes on to the ranges; replies come back the same way. So messages grow
with the input, not with its square, and no task holds more than a range or a group of messages.

Null and empty texts have no words and keep the empty text; every row is a document, whatever its id; texts shorter
than a window stay whole. An empty table gives no rows. Other columns are ignored."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm import words as W
from quarry.llm.common import drop, keyed, remember, shared_root, staged

BLOCK_BYTES = 8_000_000
#: Spark's own limit for buckets of a table; more blocks than this are dealt into several partitions of the table.
MOST_BUCKETS = 100_000
#: Cells of a lane for each byte of text, about four for each window; merged ranges have this many cells, a power of two.
CELLS_PER_BYTE = 0.65
RANGE_BITS = 22
#: Cells that a message holds on average at least.
LEAST_CELLS = 128

_MESSAGE = "block long, lane int, part long, n long, keys binary, twice binary"
_REPLY = "block long, lane int, part long, bits binary"


@dataclass(frozen=True)
class Plan:
    """How windows of an input of a size are exchanged. bits: of a cell's number, range_bits of them within a range;
    group_bits: ranges in a group, as a power of two; union: blocks whose messages are merged before they go on."""

    width: int
    bits: int
    range_bits: int
    group_bits: int
    union: int

    @staticmethod
    def of(size: int, width: int, block_bytes: int = BLOCK_BYTES, range_bits: int = RANGE_BITS, least: int = LEAST_CELLS) -> Plan:
        bits = max(range_bits, math.ceil(math.log2(max(1, size * CELLS_PER_BYTE))))
        ranges, of_block = 1 << (bits - range_bits), max(1, int(block_bytes * CELLS_PER_BYTE / 4))
        groups = 1 << max(0, int(math.log2(max(1, of_block // least))))
        if ranges <= groups:
            return Plan(width, bits, range_bits, 0, 1)
        return Plan(width, bits, range_bits, (ranges // groups).bit_length() - 1, math.ceil(least * ranges / of_block))

    def messages(self, blocks: int) -> int:
        """How many messages of a lane are sent at most, on all levels."""
        ranges = 1 << (self.bits - self.range_bits)
        return blocks * (ranges >> self.group_bits) + (math.ceil(blocks / self.union) * ranges if self.group_bits else 0)

    def shift(self, lane: int, grouped: bool) -> int:
        """By how much a key's first column is shifted to give its range, or its group of ranges."""
        return self.range_bits + (64 - self.bits if lane == 2 else 0) + (self.group_bits if grouped else 0)

    def part(self, keys: np.ndarray, lane: int, grouped: bool) -> np.ndarray:
        shift = self.shift(lane, grouped)
        return keys[:, 0] >> np.uint64(shift) if shift < 64 else np.zeros(len(keys), dtype=np.uint64)


def _packed(keys: np.ndarray) -> bytes:
    """Keys in order: cells as gaps, byte plane by byte plane; pairs of hashes as they are."""
    if keys.shape[1] == 2:
        return np.ascontiguousarray(keys).tobytes()
    gaps = np.diff(keys[:, 0], prepend=np.uint64(0))
    gaps[0] = 0  # the first is stored before them
    wide = 8 if len(gaps) and int(gaps.max()) >> 32 else 4
    planes = gaps.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T.tobytes()
    return keys[:1, 0].tobytes() + bytes([wide]) + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, lane: int) -> np.ndarray:
    if lane == 2:
        return np.frombuffer(data, dtype=np.uint64).reshape(-1, 2)
    first, wide = np.frombuffer(data[:8], dtype=np.uint64)[0], data[8]
    planes = np.frombuffer(pa.decompress(data[9:], decompressed_size=wide * n, codec="zstd", asbytes=True), dtype=np.uint8)
    gaps = np.ascontiguousarray(planes.reshape(wide, -1).T).view(f"<u{wide}").ravel()
    return (first + np.cumsum(gaps, dtype=np.uint64)).reshape(-1, 1)


def _distinct(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of keys in order, how often each occurs (by n, if given), and the place of each row among them."""
    order = np.argsort(keys[:, 0], kind="stable") if keys.shape[1] == 1 else np.lexsort((keys[:, 1], keys[:, 0]))
    sorted_keys = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (sorted_keys[1:] != sorted_keys[:-1]).any(axis=1)
    group = np.cumsum(new) - 1
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = group
    return sorted_keys[new], np.bincount(place, weights=n, minlength=int(new.sum())).astype(np.int64), place


class _Block:
    """The words and windows of the documents of one block."""

    def __init__(self, texts: pa.ChunkedArray, plan: Plan):
        words, sizes, hashes = [], [], []
        for x in texts:
            own = W.split(x.as_py())
            words.append(own)
            sizes.append(len(own))
            hashes.append(W.hashes_128(own))
        self.words, self.sizes, self.plan = words, np.array(sizes, dtype=np.int64), plan
        h = np.concatenate(hashes) if hashes else np.empty((0, 2), dtype=np.uint64)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), self.sizes)
        self.total, width = len(h), plan.width
        self.starts = np.flatnonzero(doc[: max(0, self.total - width + 1)] == doc[width - 1 :])
        self.lanes = [W.runs(np.ascontiguousarray(h[:, lane]), width, lane)[self.starts] for lane in (0, 1)]

    def cells(self, lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct cells in order, how often each occurs, and for every window the place of its cell."""
        cell, place, n = np.unique(self.lanes[lane] >> np.uint64(64 - self.plan.bits), return_inverse=True, return_counts=True)
        return cell.reshape(-1, 1), n, place

    def candidates(self, replies: dict) -> np.ndarray:
        """Indexes of windows that both lanes estimate repeated."""
        keep = np.ones(len(self.starts), dtype=bool)
        for lane in (0, 1):
            cell, _, place = self.cells(lane)
            keep &= _answers(self.plan.part(cell, lane, True), replies, lane)[place]
        return np.flatnonzero(keep)

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows at these indexes: distinct keys in order, how often, and each window's place."""
        return _distinct(np.stack([self.lanes[0][at], self.lanes[1][at]], axis=1))


def _stretches(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, start, end) of each stretch of equal parts."""
    edges = np.flatnonzero(np.diff(part)) + 1
    for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(part)], strict=True):
        if i < j:
            yield int(part[i]), i, j


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n).astype(bool)


def _answers(part: np.ndarray, replies: dict, lane: int) -> np.ndarray:
    """The reply bits for keys in order, whose parts are given."""
    out = np.zeros(len(part), dtype=bool)
    for p, i, j in _stretches(part):
        out[i:j] = _bits(replies[lane, p], j - i)
    return out


def _messages(block: int, lane: int, part: np.ndarray, keys: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
    for p, i, j in _stretches(part):
        yield block, lane, p, j - i, _packed(keys[i:j]), np.packbits(n[i:j] > 1).tobytes()


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split(" ") for x in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[x for x, _ in fields])


def _replies(table: pa.Table) -> dict:
    return {(r["lane"], r["part"]): r["bits"] for r in table.to_pylist()}


def _sketch(plan: Plan):
    def run(table: pa.Table) -> pa.Table:
        block, own, out = table["block"][0].as_py(), _Block(table["text"], plan), []
        for lane in (0, 1):
            cell, n, _ = own.cells(lane)
            out += _messages(block, lane, plan.part(cell, lane, True), cell, n)
        return _table(out, _MESSAGE)

    return run


def _exact(plan: Plan):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], _MESSAGE)
        block, own = left["block"][0].as_py(), _Block(left["text"], plan)
        keys, n, _ = own.keys(own.candidates(_replies(right)))
        return _table(list(_messages(block, 2, plan.part(keys, 2, True), keys, n)), _MESSAGE)

    return run


def _merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of messages, how often each occurs (two stands for more), and the place of each message's keys."""
    keys = np.concatenate([_unpacked(r["keys"], r["n"], r["lane"]) for r in rows])
    n = np.concatenate([1 + _bits(r["twice"], r["n"]).astype(np.int64) for r in rows])
    return _distinct(keys, n)


def _dealt(rows: list[dict], bits: np.ndarray) -> pa.Table:
    """Replies to messages, whose keys' bits are given one after the other."""
    out, at = [], 0
    for r in rows:
        out.append((r["block"], r["lane"], r["part"], np.packbits(bits[at : at + r["n"]]).tobytes()))
        at += r["n"]
    return _table(out, _REPLY)


def _count(plan: Plan):
    """Replies of a range to its messages."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if rows[0]["lane"] == 2:
            _, n, place = _merged(rows)
            return _dealt(rows, (n > 1)[place])
        low = np.uint64((1 << plan.range_bits) - 1)
        count = np.zeros(1 << plan.range_bits, dtype=np.uint8)
        for r in rows:
            cells = _unpacked(r["keys"], r["n"], r["lane"])[:, 0] & low
            count[cells] = np.minimum(count[cells] + 1 + _bits(r["twice"], r["n"]), 2)
        many = np.concatenate([count[_unpacked(r["keys"], r["n"], r["lane"])[:, 0] & low] > 1 for r in rows])
        return _dealt(rows, many)

    return run


def _unite(plan: Plan):
    """Messages to a group of ranges become one to each range."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys, n, _ = _merged(rows)
        lane = rows[0]["lane"]
        return _table(list(_messages(rows[0]["block"] // plan.union, lane, plan.part(keys, lane, False), keys, n)), _MESSAGE)

    return run


def _divide(plan: Plan):
    """Ranges' replies to united messages become replies to the messages that were united."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows:
            return _table([], _REPLY)
        keys, _, place = _merged(rows)
        lane = rows[0]["lane"]
        return _dealt(rows, _answers(plan.part(keys, lane, False), _replies(right), lane)[place])

    return run


def _exchanged(messages: DataFrame, plan: Plan) -> DataFrame:
    """The replies to blocks' messages."""
    if not plan.group_bits:
        return staged(messages.groupBy("lane", "part").applyInArrow(_count(plan), _REPLY), "replies")
    messages = staged(messages.withColumn("united", F.floor(F.col("block") / plan.union)), "messages")
    to_group = ["united", "lane", "part"]
    united = messages.groupBy(*to_group).applyInArrow(_unite(plan), _MESSAGE)
    counted = staged(united.groupBy("lane", "part").applyInArrow(_count(plan), _REPLY), "counted")
    ranges_of = counted.select(F.col("block").alias("united"), "lane", F.shiftrightunsigned("part", plan.group_bits).alias("group"), "part", "bits")
    replies = staged(messages.groupBy(*to_group).cogroup(ranges_of.groupBy("united", "lane", "group")).applyInArrow(_divide(plan), _REPLY), "replies")
    drop(messages, counted)
    return replies


def _remove(plan: Plan, id_type: pa.DataType):
    width = plan.width

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own, replies = _Block(left["text"], plan), _replies(right)
        at = own.candidates(replies)
        keys, _, place = own.keys(at)
        first = own.starts[at[_answers(plan.part(keys, 2, True), replies, 2)[place]]]
        change = np.bincount(first, minlength=own.total + 1) - np.bincount(first + width, minlength=own.total + 1)
        keep = np.cumsum(change[:-1]) == 0
        kept, removed, i = [], [], 0
        for words in own.words:
            mask = keep[i : i + len(words)]
            i += len(words)
            removed.append(len(words) - int(mask.sum()))
            kept.append((b" ".join(words) if not removed[-1] else b" ".join([words[k] for k in np.flatnonzero(mask)])).decode())
        return pa.table([left["id"].combine_chunks().cast(id_type), pa.array(own.sizes), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    return run


def _blocks(docs: DataFrame, blocks: int, most: int) -> list[DataFrame]:
    """The rows with the number of their block, in tables of at most that many blocks, each a bucket of its own if their
    hashes agree; no catalog entry stays, and the files go when the program ends."""
    spark, name = docs.sparkSession, f"quarry_blocks_{uuid.uuid4().hex}"
    path, tables = f"{shared_root(spark)}/{name}", math.ceil(blocks / most)
    rows = keyed(docs, "rows")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row_key"), F.lit(blocks))).drop("row_key")
    dealt = dealt.withColumn("at", F.floor(F.col("block") / most)).repartition(min(blocks, most), "at", "block")
    remember(path, spark)
    write = dealt.write.option("compression", "zstd").option("path", path).bucketBy(min(blocks, most), "block")
    (write.partitionBy("at") if tables > 1 else write).saveAsTable(name)
    drop(rows)
    if tables > 1:  # each partition becomes a bucketed table of its own
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
        for k in range(tables):
            where = f"CLUSTERED BY (block) INTO {min(blocks, most)} BUCKETS LOCATION '{path}/at={k}'"
            spark.sql(f"CREATE TABLE {name}_{k} ({columns}, block BIGINT) USING parquet {where}")
    names = [f"{name}_{k}" for k in range(tables)] if tables > 1 else [name]
    parts = [spark.table(n).drop("at") for n in names]
    for n in {name, *names}:
        spark.sql(f"DROP TABLE {n}")  # external tables: the plans keep their files
    return parts


def remove_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 35, block_bytes: int = BLOCK_BYTES, range_bits: int = RANGE_BITS, most: int = MOST_BUCKETS, least: int = LEAST_CELLS) -> DataFrame:
    """(id, n_words, n_removed, kept_text) for every row: the words that no repeated window covers, one space between."""
    docs = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    plan = Plan.of(size, width, block_bytes, range_bits, least)
    tables = [t.groupBy("block") for t in _blocks(docs, blocks, most)]

    def with_replies(run, ddl: str, replies: DataFrame) -> DataFrame:
        own = [replies.where(F.floor(F.col("block") / most) == k) if len(tables) > 1 else replies for k in range(len(tables))]
        return _all([t.cogroup(r.groupBy("block")).applyInArrow(run, ddl) for t, r in zip(tables, own, strict=True)])

    estimated = _exchanged(_all([t.applyInArrow(_sketch(plan), _MESSAGE) for t in tables]), plan)
    exact = _exchanged(with_replies(_exact(plan), _MESSAGE, estimated), plan)
    id_type = docs.schema["id"].dataType
    out = with_replies(_remove(plan, to_arrow_type(id_type)), f"id {id_type.simpleString()}, n_words long, n_removed long, kept_text string", estimated.unionByName(exact))
    return out.withColumnRenamed("id", id)


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
