"""Connected components of a graph that no machine holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Edges of which a worker builds one forest.
FOREST_EDGES = 1 << 19


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the smallest of its component, and that smallest node."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all() and (label[x] == label[y]).all():
            break
        label = new
    while not (label[label] == label).all():
        label = label[label]
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def forests(edges: DataFrame) -> DataFrame:
    """Far fewer edges (a, b) with the same components: each task sends a star for each component that it sees."""

    def thin(batches):
        parts, n = [], 0
        for batch in batches:
            parts.append((batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)))
            n += len(batch)
            if n >= FOREST_EDGES:
                parts = [_forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
                n = len(parts[0][0])
                if n >= FOREST_EDGES // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], ["a", "b"])
                    parts, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))], ["a", "b"])

    return edges.select("a", "b").mapInArrow(thin, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges (a, b: long, a != b) but the roots.

    Alternating large-star and small-star steps; each round is written to the shared folder.
    """

    def summary(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = materialise(forests(edges).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    before = summary(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        e = materialise(small.where("a != b").distinct(), "edges")
        now = summary(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
