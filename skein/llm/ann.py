"""Approximate nearest neighbours, made exact: a block matrix join over int8 tiles.

Vectors are dealt into tiles of a bounded size, and tiles into slots, TILES of them a slot, about; queries into blocks
and groups in the same way. Each pair of a slot and a group is one cell of the matrix: tiles and blocks meet there by an
equi-join on the cell, and no machine, the driver included, holds more than cells. The int8 product of a tile and
a block gives each squared distance with a bound on its quantisation error; pairs whose lower bound exceeds the
query's k-th smallest upper bound are dropped, the rest are recomputed in double precision and pushed on the heap of
the query's k best. The cells' heaps are merged by query.

Vectors that are null, zero, or hold null or non-finite components take no part; vectors meet only those of their own
dimension. Rows that repeat a vec_id are candidates each, but none of the query's own id. A repeated query id is one
query, its largest vector in Spark's order of arrays. Ties go to the smaller vec_id. Where a bound overflows, the pair
is recomputed; distances are finite as long as the differences are. An empty table gives an empty one. Only vec_id and
embedding are read; other columns go, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_tasks

K = 10
#: Vectors of a tile at most, and bytes of them.
TILE = 4096
TILE_BYTES = 4 << 20
#: Tiles of a slot, and blocks of a group, about.
TILES = 16
PAIRS = 1 << 20
PACKED = "dim int, tile long, n int, ids binary, v binary"
FOUND = "query_id long, vec_id long, score double"


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of double), of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(fine & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull())


def tiles(vectors: DataFrame, most: int = TILE) -> DataFrame:
    """Tiles of vectors of one dimension each; vectors: what valid() gives. Ids and components are packed in binary."""

    def pack(batches):
        first, made, held = TaskContext.get().partitionId() << 32, 0, {}

        def tile(d):
            nonlocal made
            ids, v = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([first + made], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()]), pa.array([v.tobytes()])], ["dim", "tile", "n", "ids", "v"])

        for batch in batches:
            ids, column = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("v")
            sizes = np.diff(column.offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == d)
                step = max(1, min(most, TILE_BYTES // (8 * d)))
                for a in range(0, len(of), step):
                    at = of[a : a + step]
                    v = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                    if sum(len(x) for x, _ in held.get(d, ())) + len(at) > step:
                        yield tile(d)
                    held.setdefault(d, []).append((ids[at], v))
        for d in list(held):
            yield tile(d)

    return vectors.mapInArrow(pack, PACKED)


class Block:
    """Vectors with their int8 codes, scales, norms, and norms of what the codes miss."""

    def __init__(self, ids: np.ndarray, v: np.ndarray) -> None:
        self.ids, self.v = ids, v
        self.scale = np.abs(v).max(1) / 127
        self.scale[self.scale == 0] = 1
        self.code = np.rint(v / self.scale[:, None]).astype(np.int8)
        near = self.code * self.scale[:, None]
        self.norm2 = np.einsum("ij,ij->i", v, v)
        self.near_norm = np.sqrt(np.einsum("ij,ij->i", near, near))
        self.missed = np.sqrt(np.einsum("ij,ij->i", v - near, v - near))
        # int8 products up to 127 * 127 * 1040 are exact in float32
        self.wide = self.code.astype(np.float32 if v.shape[1] <= 1040 else np.float64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows, summed from the first component to the last; scaled where the squares leave the range."""
    d = a - b

    def root(d):
        total = np.zeros(len(d))
        for k in range(d.shape[1]):
            total += d[:, k] * d[:, k]
        return np.sqrt(total)

    out = root(d)
    odd = np.flatnonzero(~((out > 1e-140) & (out < 1e150)))
    if len(odd):
        most = np.abs(d[odd]).max(1)
        unit = np.where((most > 0) & np.isfinite(most), most, 1)
        out[odd] = root(d[odd] / unit[:, None]) * unit
    return out


class Search:
    """A heap of the k best so far for each query of a block."""

    def __init__(self, queries: Block, k: int) -> None:
        self.q, self.k = queries, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
        #: Above a query's limit, squared, no pair is one of the k best.
        self.limit = np.full(len(queries.ids), np.inf)

    def add(self, c: Block) -> None:
        rows = max(1, PAIRS // max(len(c.ids), 1))
        with np.errstate(all="ignore"):  # bounds that overflow keep their pairs
            for a in range(0, len(self.q.ids), rows):
                self._tile(a, min(a + rows, len(self.q.ids)), c)

    def _tile(self, a: int, b: int, c: Block) -> None:
        q = self.q
        near = (q.wide[a:b] @ c.wide.T).astype(np.float64) * (q.scale[a:b, None] * c.scale)
        error = np.sqrt(q.norm2[a:b])[:, None] * c.missed + q.missed[a:b, None] * c.near_norm
        middle = q.norm2[a:b, None] + c.norm2 - 2 * near
        slack = 2 * error + 1e-9 * (q.norm2[a:b, None] + c.norm2)
        other = q.ids[a:b, None] != c.ids
        upper = np.where(other, middle + slack, np.inf)
        bound = self.limit[a:b]
        if upper.shape[1] >= self.k:
            bound = np.minimum(bound, np.partition(upper, self.k - 1, axis=1)[:, self.k - 1])
        # not above the bound, so that a pair without a finite bound survives
        i, j = np.nonzero(other & ~(middle - slack > bound[:, None]))
        for x in range(0, len(i), 65536):
            own, at = i[x : x + 65536] + a, j[x : x + 65536]
            score = distances(q.v[own], c.v[at])
            self._push(own.tolist(), score.tolist(), c.ids[at].tolist())

    def _push(self, owner: list[int], score: list[float], ids: list[int]) -> None:
        """The root of a heap is its worst pair: the farthest, and of those the one with the largest id."""
        heaps, k = self.heaps, self.k
        for own, s, i in zip(owner, score, ids, strict=True):
            heap = heaps[own]
            if len(heap) < k:
                heapq.heappush(heap, (-s, -i))
            elif (-s, -i) > heap[0]:
                heapq.heapreplace(heap, (-s, -i))
        for own in set(owner):
            if len(heaps[own]) == k and -heaps[own][0][0] < 1e150:
                self.limit[own] = (heaps[own][0][0] ** 2) * (1 + 1e-9) + 1e-290

    def found(self) -> list[tuple[int, int, float]]:
        return [(int(q), -i, -s) for q, heap in zip(self.q.ids, self.heaps, strict=True) for s, i in heap]


def _blocks(table: pa.Table):
    for d, ids, v in zip(*(table.column(c).to_pylist() for c in ("dim", "ids", "v")), strict=True):
        yield d, Block(np.frombuffer(ids, np.int64), np.frombuffer(v, np.float64).reshape(-1, d))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, tile: int = TILE, per_cell: int = TILES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of vectors to each row of queries, both vec_id and embedding."""
    spark = vectors.sparkSession
    asked = valid(queries).groupBy("vec_id").agg(F.max("v").alias("v"))
    # the fewest blocks that the bound allows: a block goes through every slot
    n_asked = asked.count()
    asked = materialise(tiles(asked.repartition(max(1, min(n_tasks(spark), -(-n_asked // tile)))), tile), "queries")
    stored = materialise(tiles(valid(vectors), tile), "tiles")
    slots, groups = (max(1, -(-x.count() // per_cell)) for x in (stored, asked))
    deal = lambda n: F.pmod(F.xxhash64("dim", "tile"), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = stored.withColumn("slot", deal(slots)).withColumn("group", every(groups))
    right = asked.withColumn("group", deal(groups)).withColumn("slot", every(slots))

    def search(own: pa.Table, asking: pa.Table) -> pa.Table:
        searches = [(d, Search(q, k)) for d, q in _blocks(asking)]
        for d, c in _blocks(own):
            for of, s in searches:
                if of == d:
                    s.add(c)
        found = [x for _, s in searches for x in s.found()]
        return pa.table([pa.array(x, t) for x, t in zip(list(zip(*found, strict=True)) or [[], [], []], (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    found = left.groupBy("slot", "group").cogroup(right.groupBy("slot", "group")).applyInArrow(search, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(embeddings: DataFrame) -> DataFrame:
    """The contract's columns."""
    return nearest(embeddings, embeddings.where(F.col("vec_id") % 100 == 0))


def oracle(k: int = K) -> str:
    """DuckDB SQL that tries every pair, and sums from the first component to the last."""
    return f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL),
     fine AS (SELECT * FROM v WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
     d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y)) AS score
           FROM fine q JOIN fine c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= {k}"""
