"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from a bounded sample of labelled rows (SAMPLE, by a hash of doc_id); the log-probability matrix, at
most BUCKETS x languages, is broadcast, and whole texts are scored in slices by numpy gathers and segment sums.

A null text, one without letters, or an empty training set gives `und` with score 0. Ties go to the language that
sorts first. A very long text is scored whole, alone in its slice. Rows that repeat a doc_id are predicted each by its
own text; rows without doc_id are predicted, teach nothing, and have no fold (held_out is null). The matrix is broadcast
only up to LANGUAGES languages, more are an error. An empty table gives an empty one. Only doc_id, text and, in
training rows, lang are read; other columns go, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, ragged, segment_sums, slices, texts

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled rows that are learnt from, about, at most.
SAMPLE = 20_000
UNKNOWN = "und"
#: Distinct languages that the broadcast matrix may have: 256 MB of floats.
LANGUAGES = 1024


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.frompyfunc(lambda c: chr(c).isalpha(), 1, 1)(np.arange(0x110000)).astype(bool)


def code_points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, one after another, and each text's first offset plus the end."""
    lowered = [t.lower() for t in batch.column("text").to_pylist()]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate(([0], np.cumsum([len(t) for t in lowered]))).astype(np.int64)


def grams(points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the buckets of all n-grams and each text's first one plus the end. None crosses texts."""
    wide, hashes = points.astype(np.uint64), np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        hashes = (hashes[: len(points) - n + 1] + wide[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15) if len(points) >= n else hashes[:0]
        if n in ORDERS:
            lengths = np.maximum(np.diff(offsets) - n + 1, 0)
            whole = hashes[ragged(offsets[:-1], lengths)] if n > 1 else hashes
            yield (whole >> np.uint64(48)).astype(np.int64) % BUCKETS, np.concatenate(([0], np.cumsum(lengths)))


def train(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """Languages, the matrix (buckets x languages) and priors, from doc_id, text and lang; None without rows."""
    labelled = labelled.where("lang IS NOT NULL")
    n = labelled.count()
    kept = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1, sample / max(n, 1))))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, _, _ in slices(batch):
                points, offsets = code_points(part)
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in set(langs):
                    own = total.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    own[BUCKETS] += int((langs == lang).sum())
                    for buckets, first in grams(points, offsets):
                        of = np.repeat(langs == lang, np.diff(first))
                        own[:BUCKETS] += np.bincount(buckets[of], minlength=BUCKETS)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "bucket", "n"])

    rows = kept.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if not len(rows):
        return None
    langs = sorted(rows["lang"].unique())
    if len(langs) > LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the matrix that is broadcast takes {LANGUAGES}")
    counts = np.zeros((BUCKETS + 1, len(langs)))
    counts[rows["bucket"], rows["lang"].map({x: i for i, x in enumerate(langs)})] = rows["n"]
    priors = np.log(np.maximum(counts[BUCKETS], 1) / counts[BUCKETS].sum())
    smoothed = counts[:BUCKETS] + 0.1
    return langs, np.log(smoothed / smoothed.sum(0)).astype(np.float32), priors


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray] | None) -> DataFrame:
    """doc_id, lang_pred and score (the language's posterior) for every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model, letter = shared.value, letters()
        for batch in batches:
            for part, _, _ in slices(batch):
                points, offsets = code_points(part)
                spoken = segment_sums(letter[points].astype(np.int32), offsets) > 0
                pred, best = [UNKNOWN] * len(part), np.zeros(len(part))
                if model is not None:
                    langs, matrix, priors = model
                    logs = np.tile(priors, (len(part), 1))
                    for buckets, first in grams(points, offsets):
                        for k in range(len(langs)):
                            logs[:, k] += segment_sums(matrix[:, k][buckets], first)
                    top = logs.argmax(1)
                    best = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                    best[~spoken] = 0
                    pred = [langs[t] if s else UNKNOWN for t, s in zip(top, spoken, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(best)], ["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(score, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(crc32_of_id(doc_id), F.lit(4)) == 2


def op3(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    model = train(texts(docs.where(~held_out()), "lang"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
