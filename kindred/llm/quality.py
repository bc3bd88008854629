"""Quality scores from random-indexing word vectors and a small neural network.

Tokens are runs of letters and digits, or of ASCII symbols; a word that repeats the
word before it becomes one common token.  Tokens are hashed into a fixed number of
rows.  Each row has a sparse random index vector, and its word vector is the sum, over
the whole corpus, of the index vectors of its neighbours.  A document is the mean and
the spread of its tokens' vectors and its length; a two-layer network gives a
probability, and a temperature fitted on rows kept back from training calibrates it.

Cases: a null or empty text has no tokens and gets the network's answer for a document
of zeros.  Labels that are null or whose document is missing teach nothing; of repeated
labels the mean decides (0.5 counts as 1).  Where a labelled doc_id has several texts, the
one of smallest hash teaches; equal texts teach once.  Without labels of both kinds every
score is the share of label 1, held to 0.001 and 0.999 (0.5 without labels).  With any
labels of both kinds the network is trained; the temperature is drawn to 1, as far as few
rows can't tell.  Very long texts are read whole, and bound by the working arrays' size
together with few others.  Equal texts have equal scores.  Other columns are kept by
``score``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, mix64, small_batches
from .shingles import _BYTES, _INVERSE, _MUL, _STEP, _power

ROW_BITS, DIMS, NONZERO, WINDOW = 14, 32, 4, 2
#: Labelled rows that training reads, at most: those of smallest hash.
SAMPLE = 20_000
HIDDEN, EPOCHS, RATE, BATCH = 32, 40, 3e-3, 256
#: How strongly the temperature is drawn to 1: the loss of a squared step of its logarithm.
PRIOR = 1.0
#: Rows of the table of vectors that travel together while the sums are gathered.
SLICE = 256
#: Partial sums that one step of the gathering adds up, about.
FAN_IN = 64

_CLASS = np.zeros(256, dtype=np.int8)
_CLASS[33:127] = 2
_CLASS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = 1
_CLASS[128:] = 1
_REPEAT = np.uint64(0x243F6A8885A308D3)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The row of each token of all texts, and where each text's tokens begin (one entry more than texts)."""
    raws = [(t or "").encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b"\n".join(raws) + b"\n", dtype=np.uint8)
    if len(buf) > 1 << 21 and len(raws) > 1:  # bound the working arrays
        half = len(raws) // 2
        (a, x), (b, y) = tokens(texts[:half]), tokens(texts[half:])
        return np.concatenate([a, b]), np.concatenate([x, y[1:] + x[-1]])
    kind = _CLASS[buf]
    edge = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(buf)]])
    begins, ends = edge[:-1], edge[1:]
    real = kind[begins] > 0
    begins, ends = begins[real], ends[real]
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[buf] * _power("step", _STEP, len(buf))[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[begins]) * _power("inverse", _INVERSE, len(buf))[begins]
    h = mix64(h + (ends - begins).astype(np.uint64) * _MUL)
    first = np.searchsorted(begins, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])]))
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (kind[begins[1:]] == 1)
    inner = first[(first > 0) & (first < len(h))]
    again[inner] = False
    h[again] = _REPEAT
    return (h >> np.uint64(64 - ROW_BITS)).astype(np.int64), first


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each row the places of its index vector's entries, and their signs."""
    r = mix64(np.arange(1, (NONZERO << ROW_BITS) + 1, dtype=np.uint64) * _MUL).reshape(-1, NONZERO)
    return (r % np.uint64(DIMS)).astype(np.int64), np.where(r >> np.uint64(63), 1.0, -1.0)


def context_sums(rows: np.ndarray, first: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total`` (rows by DIMS, and a count in the last column) what these texts have."""
    place, sign = index_vectors() if not _index else _index[0]
    if not _index:
        _index.append((place, sign))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    flat = np.zeros(total.shape[0] * DIMS)
    for k in range(1, WINDOW + 1):
        same = np.flatnonzero(text[k:] == text[:-k])
        a, b = rows[same], rows[same + k]
        for me, other in ((a, b), (b, a)):
            at = me[:, None] * DIMS + place[other]
            flat += np.bincount(at.reshape(-1), weights=sign[other].reshape(-1), minlength=len(flat))
    total[:, :DIMS] += flat.reshape(-1, DIMS)
    total[:, DIMS] += np.bincount(rows, minlength=total.shape[0])


_index: list[tuple[np.ndarray, np.ndarray]] = []


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << ROW_BITS, DIMS + 1))
    for batch in batches:
        context_sums(*tokens(batch.column("text").to_pylist()), total)
    yield from _sliced({i: total[i : i + SLICE] for i in range(0, len(total), SLICE)})


def _sliced(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    some = [(i, x) for i, x in parts.items() if x[:, DIMS].any()]
    salt = [TaskContext.get().partitionId()] * len(some)
    yield pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in some], pa.int64()), pa.array(salt, pa.int64()), pa.array([x.astype(np.int64).tobytes() for _, x in some], pa.binary())],
        names=["slice", "salt", "sums"],
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch.column("slice").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            x = np.frombuffer(raw, dtype=np.int64).reshape(-1, DIMS + 1).astype(float)
            parts[i] = parts[i] + x if i in parts else x
    yield from _sliced(parts)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors, of fixed size, from all texts: unit rows about their mean."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    schema = "slice long, salt long, sums binary"
    sums = texts.mapInArrow(_partial, schema)
    many = texts.rdd.getNumPartitions()
    # sums of sums, so that no task adds more than a bounded number of tables at large inputs
    while many > FAN_IN:
        many = -(-many // FAN_IN)
        sums = sums.withColumn("salt", F.pmod("salt", F.lit(many))).repartition(F.col("slice"), F.col("salt")).mapInArrow(_added, schema)
    sums = sums.repartition(F.col("slice")).mapInArrow(_added, schema)
    total = np.zeros((1 << ROW_BITS, DIMS + 1))
    for r in sums.toLocalIterator():
        total[r["slice"] : r["slice"] + SLICE] += np.frombuffer(r["sums"], dtype=np.int64).reshape(-1, DIMS + 1)
    v, n = total[:, :DIMS], total[:, DIMS]
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    if n.sum():
        v = v - (v * n[:, None]).sum(axis=0) / n.sum()
    return v.astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """A row per text: mean and spread of its tokens' vectors, and the logarithm of their number."""
    rows, first = tokens(texts)
    counts = np.diff(first)
    out = np.zeros((len(texts), 2 * DIMS + 1), dtype=np.float32)
    full = np.flatnonzero(counts)
    step = 64
    for i in range(0, len(full), step):  # bound the gathered vectors
        some = full[i : i + step]
        a, b = first[some[0]], first[some[-1] + 1]
        v = vectors[rows[a:b]]
        at = first[some] - a
        n = counts[some][:, None]
        mean = np.add.reduceat(v, at, axis=0) / n
        out[some, :DIMS] = mean
        out[some, DIMS : 2 * DIMS] = np.sqrt(np.maximum(np.add.reduceat(v * v, at, axis=0) / n - mean * mean, 0))
    out[:, -1] = np.log1p(counts)
    return out


@dataclass
class Network:
    """A hidden layer of tanh units and a logistic output, over standardised inputs."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Network:
    """Adam on the logistic loss; one row in five is kept back for the temperature."""
    x, y = x.astype(float), y.astype(float)
    d = x.shape[1] if x.ndim == 2 else 2 * DIMS + 1
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    net = Network(mean, scale, rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0, 1.0)
    z = (x - mean) / scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for i in range(0, len(fit), BATCH):
            zb, yb = z[fit[i : i + BATCH]], y[fit[i : i + BATCH]]
            a = np.tanh(zb @ params[0] + params[1])
            g = (1 / (1 + np.exp(-np.clip(a @ params[2] + params[3][0], -30, 30))) - yb) / len(yb)
            back = g[:, None] * params[2][None, :] * (1 - a * a)
            grads = [zb.T @ back + 1e-4 * params[0], back.sum(axis=0), a.T @ g + 1e-4 * params[2], np.array([g.sum()])]
            step += 1
            for p, q, u, v in zip(params, grads, m1, m2, strict=True):
                u += 0.1 * (q - u)
                v += 0.001 * (q * q - v)
                p -= RATE * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits, yh = net.logits(x[held]), y[held]

    def loss(t: float) -> float:
        s = np.clip(logits / t, -30, 30)
        return float(np.sum(np.log1p(np.exp(-s)) + (1 - yh) * s) + PRIOR * np.log(t) ** 2)

    net.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors from all of ``docs``, and a network from ``sample`` rows at most of ``labels`` (doc_id, quality)."""
    vectors = word_vectors(docs)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(sample)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # of fixed size

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h", "y")), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "h", "y", "x"])

    found = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "h", "y", "text")  # ``sample`` ids at most
    seen = found.mapInArrow(features, "doc_id long, h long, y int, x binary")
    got = seen.groupBy("doc_id").agg(F.min(F.struct("h", "y", "x")).alias("r")).select("doc_id", "r.y", "r.x").collect()
    got.sort(key=lambda r: r["doc_id"])
    x = np.array([np.frombuffer(r["x"], dtype=np.float32) for r in got]) if got else np.zeros((0, 2 * DIMS + 1))
    return vectors, train(x, np.array([r["y"] for r in got], dtype=float))


def score(docs: DataFrame, vectors: np.ndarray, network: Network, into: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``into``, from ``text`` alone.

    Where ``docs`` has a column of that name, it stays and the new one's name gets underscores.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))  # of fixed size

    @F.pandas_udf("double")
    def udf(texts: pd.Series) -> pd.Series:
        v, net = shared.value
        return pd.Series(net.scores(pooled([None if pd.isna(t) else t for t in texts], v).astype(float)))

    return docs.select("*", udf(F.col("text").cast("string")).alias(free_name(into, docs.columns)))
