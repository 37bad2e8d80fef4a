"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Texts become counts of hashed byte bigrams and of trigrams of their shape (letter case, digits, signs), square-rooted
and weighted by IDF within the fitting sample. A truncated SVD of a bounded sample of labelled rows (SAMPLE) gives
the latent axes; the sample's vectors (at most about SAMPLE x RANK floats) and the axes are broadcast. Every
document's cosines with all labelled vectors are computed exactly, in blocks, and its NEIGHBOURS nearest vote, each
label weighted by its similarity to the power POWER. Of neighbours with equal cosines those of the smallest doc_id vote.

Null or empty texts have the zero vector, whose cosines are all 0; the score is then the sample's share of label 1.
A very long text is counted whole, alone in its slice. Rows that repeat a doc_id are scored each by its own text; of
labelled ones one is fitted. Rows without doc_id are scored, and have no fold (held_out is null); labels without
doc_id or quality teach nothing. Without labelled rows the score is 0.5. Several labels of one document count by their
mean. An empty table gives an empty one. Only doc_id, text and labels' doc_id and quality are read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, ragged, slices, texts

HALF = 2048
WIDTH = 2 * HALF
RANK = 64
NEIGHBOURS = 15
#: A vote weighs the cosine to this power, so that far neighbours count little.
POWER = 4
#: Labelled rows that are fitted, about, at most.
SAMPLE = 4000
#: Documents whose counts are held at once.
BLOCK = 512

#: A byte's shape: a for lower case, A for upper case, 0 for digits, w for parts of other letters, else itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("w")


class Model(NamedTuple):
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    prior: float


def _count(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Counts (documents x HALF) of hashed n-grams of bytes."""
    docs, lengths = len(offsets) - 1, np.maximum(np.diff(offsets) - n + 1, 0)
    if len(data) < n:
        return np.zeros((docs, HALF), np.float32)
    wide, h = data.astype(np.uint32), np.uint32(0)
    for i in range(n):
        h = h * np.uint32(257) + wide[i : len(wide) - n + 1 + i]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 11)
    at = ragged(offsets[:-1], lengths)
    cell = h[at].astype(np.int64) + np.repeat(np.arange(docs) * HALF, lengths)
    return np.bincount(cell, minlength=docs * HALF).reshape(docs, HALF).astype(np.float32)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of relative counts of both halves, documents x WIDTH."""
    out = np.concatenate([_count(data, offsets, 2), _count(_SHAPE[data], offsets, 3)], axis=1)
    total = np.maximum(np.diff(offsets), 1).astype(np.float32)
    return np.sqrt(out / total[:, None])


def _blocks(batch: pa.RecordBatch):
    """Counts of at most BLOCK documents at once."""
    for part, data, offsets in slices(batch):
        for a in range(0, len(part), BLOCK):
            b = min(a + BLOCK, len(part))
            yield part.slice(a, b - a), counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model from a bounded sample of labels (doc_id, quality); None without any."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    labels = labels.groupBy("doc_id").agg(F.avg("quality").alias("vote"))
    n = labels.count()
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1, sample / max(n, 1))))

    def measure(batches):
        for batch in batches:
            for part, x in _blocks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("vote"), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["doc_id", "vote", "x"])

    # at most about SAMPLE rows are broadcast, and come back as WIDTH half floats each
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(measure, "doc_id long, vote double, x binary").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["doc_id", "x"]).drop_duplicates("doc_id")
    x = np.stack([np.frombuffer(b, np.float16) for b in rows["x"]]).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.1
    x *= idf
    rank = min(RANK, len(x), WIDTH)
    probe = np.random.default_rng(0).standard_normal((WIDTH, min(rank + 16, len(x)))).astype(np.float32)
    y = x @ probe
    for _ in range(3):
        y = x @ (x.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.copy()
    votes = rows["vote"].to_numpy(np.float32)
    return Model(idf, axes, _unit(x @ axes), votes, float(votes.mean()))


def nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """Each row's k columns of the largest cosines; of equal ones the first, which have the smallest doc_id."""
    rows, n = cosines.shape
    least = np.partition(cosines, n - k, axis=1)[:, n - k, None]
    above, equal = cosines > least, cosines == least
    room = k - above.sum(1, keepdims=True)
    chosen = above | equal & (np.cumsum(equal, axis=1) <= room)
    return np.nonzero(chosen)[1].reshape(rows, k)


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep (a text is never null then) and score (0 to 1, higher: label 1 likelier)."""
    shared = docs.sparkSession.sparkContext.broadcast(model and tuple(model))

    def vote(batches):
        model = shared.value and Model(*shared.value)
        for batch in batches:
            if model is None:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *keep)), pa.array(np.full(len(batch), 0.5))], ["doc_id", *keep, "score"])
                continue
            share = min(max(model.prior, 1e-3), 1 - 1e-3)
            k = min(NEIGHBOURS, len(model.votes))
            for part, x in _blocks(batch):
                cosines = _unit((x * model.idf) @ model.axes) @ model.vectors.T
                near = nearest(cosines, k)
                weight = np.maximum(np.take_along_axis(cosines, near, 1), 0) ** POWER
                good, bad = (weight * model.votes[near]).sum(1), (weight * (1 - model.votes[near])).sum(1)
                total = good + bad
                out = np.where(total > 0, good / np.maximum(total, 1e-12), share)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *keep)), pa.array(out.astype(np.float64))], ["doc_id", *keep, "score"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return texts(docs, *(c for c in keep if c != "text")).mapInArrow(vote, ", ".join(["doc_id long", *(f"`{c}` {kinds[c]}" for c in keep), "score double"]))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(crc32_of_id(doc_id), F.lit(3)) == 1


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
