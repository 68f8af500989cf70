"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - score), with ordered thresholds and one score for all grades: the sum of the
weights of a document's distinct features, which are hashed words, the first letters of longer words, runs of
punctuation, and two shares of its characters. A feature's weight is its smoothed log ratio of high to low grades in
the sample times a fitted factor, so that a few telling words outweigh many that say little, however long the text.

The model is fitted in one task, on at most SAMPLE labelled rows, the first by a hash of their id (the bound is the
parameter sample; it does not grow with the corpus), and its weights (one array of BUCKETS doubles) go to the workers.
Every document is scored, by its whole text.

Labels with a null are not used. If fewer than two grades are left, or no feature tells them apart, nothing is known of
single documents: all get the expectation of the share of grades, and a null probability, by which none is rejected.
Null text counts as empty and is scored by its thresholds alone. Repeated rows
are scored each; of several grades or texts of a labelled id the least counts. Other columns stay."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.arrow import Memo, extended, lean, slices

BUCKETS = 1 << 18
SAMPLE = 20_000
STEPS, RATE, PENALTY, SMOOTHING, LEAST_DOCS = 120, 0.05, 1e-3, 30.0, 5
MEMO_WORDS = 300_000
SLICE = 500_000
#: Probability of the highest grade from which a document is kept.
KEEP = 0.6

_LETTERS = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_SIGNS = bytes(32 if chr(c).isalnum() or c >= 128 or c in b".," else c for c in range(256))
_NO_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_CAPITALS = bytes(range(65, 91))


def _bucket(feature: bytes) -> int:
    return xxhash.xxh3_64_intdigest(feature) % BUCKETS


def features(text: str | None) -> set[bytes]:
    """The distinct features of a text."""
    raw = (text or "").encode()
    low = set(raw.lower().translate(_LETTERS).split())
    out = set(low)
    out |= {b"^" + w[:4] for w in low if len(w) > 4}
    out |= {b"#" + w for w in raw.translate(_SIGNS).split()}
    size = max(1, len(raw))
    for name, share in ((b"\0up", size - len(raw.translate(None, _CAPITALS)) if raw else 0), (b"\0sign", size - len(raw.translate(None, _NO_SIGNS)) if raw else 0)):
        out.add(name + b"%d" % int(1.5 * np.log2(1024 * share / size + 1)))
    return out


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


class Sample:
    """Graded rows as a sparse matrix of 0 and 1: grade y of each row, and (column, row) of each distinct bucket of it."""

    def __init__(self, grades: np.ndarray, buckets: list[np.ndarray]):
        self.y = np.asarray(grades, dtype=np.int64)
        self.row = np.repeat(np.arange(len(buckets), dtype=np.int32), [len(b) for b in buckets])
        self.column = np.concatenate(buckets).astype(np.int32, copy=False) if buckets else np.empty(0, dtype=np.int32)

    def only(self, used: np.ndarray) -> None:
        """Leave out the buckets that are not used."""
        keep = used[self.column]
        self.column, self.row = self.column[keep], self.row[keep]

    def _summed(self, to: np.ndarray, values: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for i in range(0, len(to), SLICE):  # slice by slice, to need little memory
            out += np.bincount(to[i : i + SLICE], weights=values[of[i : i + SLICE]], minlength=size)
        return out

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return self._summed(self.row, weights, self.column, len(self.y))

    def by_bucket(self, values: np.ndarray) -> np.ndarray:
        return self._summed(self.column, values, self.row, BUCKETS)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def loss(sample: Sample, ratio: np.ndarray, x: np.ndarray, grades: int) -> tuple[float, np.ndarray]:
    """The penalised mean negative log likelihood at x (a factor for each bucket, the first threshold, and the logs of the
    gaps to the next ones), and its gradient."""
    y, n, k = sample.y, len(sample.y), grades - 1
    factors, gaps = x[:BUCKETS], np.exp(x[BUCKETS + 1 :])
    t = np.cumsum(np.concatenate([[x[BUCKETS]], gaps]))
    s = sample.scores(factors * ratio)
    hi = np.where(y == k, 1.0, _sigmoid(t[np.minimum(y, k - 1)] - s))
    lo = np.where(y == 0, 0.0, _sigmoid(t[np.maximum(y - 1, 0)] - s))
    chance = np.maximum(hi - lo, 1e-12)
    dhi, dlo = hi * (1 - hi) / chance / n, lo * (1 - lo) / chance / n
    of_threshold = np.bincount(np.minimum(y, k - 1), weights=np.where(y == k, 0, -dhi), minlength=k) + np.bincount(np.maximum(y - 1, 0), weights=np.where(y == 0, 0, dlo), minlength=k)
    after = np.cumsum(of_threshold[::-1])[::-1]
    gradient = np.concatenate([ratio * sample.by_bucket(dhi - dlo) + PENALTY * factors, [after[0]], after[1:] * gaps])
    return float(-np.log(chance).mean() + PENALTY / 2 * (factors @ factors)), gradient


def fit(sample: Sample, grades: int) -> Model:
    y, n = sample.y, len(sample.y)
    seen = np.bincount(y, minlength=grades)
    share = np.cumsum(seen + 0.5)[:-1] / (seen + 0.5).sum()
    thresholds = np.log(share / (1 - share))
    if (seen > 0).sum() < 2:
        return Model(np.zeros(BUCKETS), thresholds)
    top = y == y.max()
    docs, high, p = np.bincount(sample.column, minlength=BUCKETS), sample.by_bucket(top.astype(np.float64)), top.mean()
    ratio = np.log((high + SMOOTHING * p) / (docs - high + SMOOTHING * (1 - p))) - np.log(p / (1 - p))
    ratio[docs < min(LEAST_DOCS, 1 + n // 200)] = 0
    sample.only(ratio != 0)

    x = np.concatenate([np.zeros(BUCKETS), [thresholds[0]], np.log(np.maximum(np.diff(thresholds), 0.1))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        _, g = loss(sample, ratio, x, grades)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return Model(x[:BUCKETS] * ratio, np.cumsum(np.concatenate([[x[BUCKETS]], np.exp(x[BUCKETS + 1 :])])))


def train(docs: DataFrame, labels: DataFrame, grade, grades: int, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on the first sample rows of labels by a hash of their id; grade is a column expression over labels."""
    chosen = labels.select(F.col(id).alias("id"), grade.cast("int").alias("grade")).where("id IS NOT NULL AND grade IS NOT NULL")
    chosen = F.broadcast(chosen.groupBy("id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("id"), "id").limit(sample))
    rated = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).join(chosen, "id").groupBy("id", "grade").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(np.array([_bucket(f) for f in features(x)], dtype=np.int32)).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("grade"), pa.array(own, pa.binary())], names=["id", "grade", "buckets"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, own = [], []
        for batch in batches:
            ys += batch.column("grade").to_pylist()
            own += [np.frombuffer(b, dtype=np.int32) for b in batch.column("buckets").to_pylist()]
        made = fit(Sample(np.array(ys, dtype=np.int64), own), grades)
        yield pa.RecordBatch.from_arrays([pa.array([made.weights.tobytes()]), pa.array([made.thresholds.tobytes()])], names=["weights", "thresholds"])

    one = rated.mapInArrow(lean(run), "id string, grade int, buckets binary").repartition(1).sortWithinPartitions("id")  # at most sample rows
    got = one.mapInArrow(lean(fitted), "weights binary, thresholds binary").collect()
    if not got:  # no partition, so no row
        return fit(Sample(np.empty(0, dtype=np.int64), []), grades)
    return Model(*(np.frombuffer(bytes(x), dtype=np.float64) for x in got[0]))


def score(df: DataFrame, model: Model, text: str = "text", expected: str = "expected_grade", tail: str = "top_probability") -> DataFrame:
    """df with the expected grade and the probability of the highest grade (see kept())."""
    df = df.drop(expected, tail)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        knows = bool(m.weights.any())
        weight = Memo(lambda f: m.weights[_bucket(f)], MEMO_WORDS)
        for whole in batches:
            for batch in slices(whole, text):
                total = np.array([_total(features(x), weight) for x in batch.column(text).to_pylist()])
                tails = m.tails(total)
                top = pa.array(tails[:, -1]) if knows else pa.nulls(len(total), pa.float64())
                yield extended(batch, {expected: pa.array(tails.sum(axis=1)), tail: top})

    return df.mapInArrow(lean(run), T.StructType([*df.schema.fields, T.StructField(expected, T.DoubleType()), T.StructField(tail, T.DoubleType())]))


def _total(own: set[bytes], weight: Memo) -> float:
    return round(math.fsum(map(weight.__getitem__, own)), 9)


def kept(tail: str = "top_probability"):
    """Whether a document is good enough to stay."""
    return F.coalesce(F.col(tail) >= KEEP, F.lit(True))
