"""Substring dedup by line and paragraph hashing.

A text falls into pieces, which tile it from its first word on: a piece ends where a line does, after a word that ends
in `.`, `!` or `?`, and after one whose last byte and length say so (see Pieces), so that a passage is cut alike
wherever it stands, in the middle of a line too. A unit is a paragraph of consecutive pieces: from a piece on, as few
as hold `least` words; with 0 each piece is a unit. Its normal form is its words, A-Z lower-cased, one space between
them. Digests (96 bits) are grouped in the whole corpus, the occurrence with the smallest (doc_id, piece) stays, and
the pieces of all others go. What goes keeps its offsets, in characters of the original text.

LEAST is a parameter, not a cap: repeats of fewer words in a row stay, for they are common phrases of documents that
have nothing else in common. README gives figures for several values.

Null texts count as empty. A very long text is handled whole; a worker then holds some 60 bytes for each of its words.
Rows without doc_id take no part and keep their text. Rows that repeat a doc_id with another text are documents of
equal rank: a unit at the same piece of both stays in both, as all of equal rows does. An empty table gives an empty
one. Only doc_id and text are read; other columns go, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, mixed, slices, texts

#: Words that a unit holds at least.
LEAST = 40
#: Units whose earliest occurrences a task finds by itself before it sends them on.
COLLAPSE = 1 << 18
RESULT = "doc_id long, text string, n_units long, n_removed long, removed_chars long, spans array<struct<start:long,length:long>>"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class _Sums:
    """Hashes of stretches of a sequence of numbers: polynomials in an odd base, modulo 2**64, from prefix sums."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        n = len(values)
        up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.total, self.down = np.zeros(n + 1, np.uint64), np.cumprod(down)
        np.cumsum(values * np.cumprod(up)[:n], out=self.total[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.total[stop] - self.total[start]) * self.down[start] + (stop - start).astype(np.uint64))


class Pieces:
    """The words and pieces of several texts, one after another; bounds holds each piece's first word, plus the end."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        n = len(raw)
        self.data = _LOWER[raw]
        inside = ~_SPACE[self.data]
        before = np.concatenate(([False], inside[:-1])) if n else inside
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[heads] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.concatenate((inside[1:], [False])) if n else inside
        after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
        self.stop = np.flatnonzero(inside & ~after) + 1
        words = len(self.start)
        #: Each text's first word, plus the end.
        self.first = np.searchsorted(self.start, offsets)
        last = self.data[self.stop - 1] if words else np.empty(0, np.uint8)
        # content-defined: on average every third word or so
        cut = _STOP[last] | ((self.stop - self.start + (last & 63)) % 4 == 0)
        lines = np.concatenate(([0], np.cumsum(self.data == 10)))
        if words:
            cut[:-1] |= lines[self.start[1:]] > lines[self.stop[:-1]]
            cut[self.first[1:][self.first[1:] > self.first[:-1]] - 1] = True
        self.bounds = np.concatenate(([0], np.flatnonzero(cut) + 1))
        #: Each text's first piece, plus the end.
        self.first_piece = np.searchsorted(self.bounds, self.first)

    def units(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """First piece and piece after the last of every unit."""
        pieces = np.arange(len(self.bounds) - 1)
        to = np.maximum(np.searchsorted(self.bounds, self.bounds[:-1] + least), pieces + 1)
        end = self.first_piece[np.searchsorted(self.first_piece, pieces, "right")]
        fine = to <= end
        return pieces[fine], to[fine]

    def digests(self, piece: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of hashes of each unit's normal form."""
        wide = self.data.astype(np.uint64) + np.uint64(1)
        words = (_Sums(wide, base).of(self.start, self.stop) for base in _BASES)
        high, low = (_Sums(w, base).of(self.bounds[piece], self.bounds[to]) for w, base in zip(words, _BASES, strict=True))
        return high.view(np.int64), (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _emitted(columns: list[np.ndarray]) -> pa.RecordBatch:
    """Units with `later` true where an earlier occurrence is among them."""
    high, low, ids, unit = (np.concatenate(x) for x in zip(*columns, strict=True))
    order = np.lexsort((unit, ids, low, high))
    high, low, ids, unit = (x[order] for x in (high, low, ids, unit))
    new = np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (ids != ids[head]) | (unit != unit[head])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (later, high, low, ids, unit)], ["later", "high", "low", "doc_id", "unit"])


def digests(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """later, high, low, doc_id, unit of every unit. later: an equal unit that the same task saw stands earlier."""

    def emit(batches):
        held, n = [], 0
        for part, raw, offsets in (x for batch in batches for x in slices(batch)):
            found = Pieces(raw, offsets)
            piece, to = found.units(least)
            if len(piece):
                row = np.searchsorted(found.first_piece, piece, "right") - 1
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)[row]
                held.append((*found.digests(piece, to), ids, (piece - found.first_piece[row]).astype(np.int32)))
                n += len(piece)
            if n >= COLLAPSE:
                yield _emitted(held)
                held, n = [], 0
        if held:
            yield _emitted(held)

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(emit, "later boolean, high long, low int, doc_id long, unit int")


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id and units (first piece, low half of the digest) of the units that stand earlier too. docs: doc_id, text.

    Equal units collapse in each task first, so that a unit that a third of all documents share reaches the shuffle
    only once for every COLLAPSE units.
    """
    found = materialise(digests(docs, least), "units")
    order = Window.partitionBy("high", "low").orderBy("doc_id", "unit")
    # rank, not row_number: rows that repeat a doc_id are of equal rank
    late = found.where("NOT later").withColumn("rank", F.rank().over(order)).where("rank > 1")
    gone = found.where("later").select("doc_id", "unit", "low").unionByName(late.select("doc_id", "unit", "low"))
    gone = materialise(gone.groupBy("doc_id").agg(F.collect_set(F.struct("unit", "low")).alias("units")), "repeats")
    discard(found)
    return gone


def _cut(found: Pieces, raw: np.ndarray, offsets: np.ndarray, row: int, units: list, to: np.ndarray, low: np.ndarray) -> tuple:
    """What is left of one text, its pieces removed, and their spans in characters. to and low: by a unit's first piece."""
    base, size = found.first_piece[row], found.first_piece[row + 1] - found.first_piece[row]
    edge = np.zeros(size + 1, np.int64)
    for unit in units:
        at = unit["unit"]
        # another text of this doc_id may have the unit, which its digest tells
        if at < size and to[base + at] and low[base + at] == unit["low"]:
            edge[at] += 1
            edge[to[base + at] - base] -= 1
    gone = np.cumsum(edge)[:size] > 0
    step = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
    own = raw[offsets[row] : offsets[row + 1]]
    starts = np.append(found.start[found.bounds[base : base + size]] - offsets[row], len(own))
    chars = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
    kept, at, spans = [], 0, []
    for a, b in zip(starts[np.flatnonzero(step == 1)], starts[np.flatnonzero(step == -1)], strict=True):
        kept.append(own[at:a].tobytes())
        spans.append({"start": int(chars[a]), "length": int(chars[b] - chars[a])})
        at = b
    kept.append(own[at:].tobytes())
    return b"".join(kept).decode(), int(gone.sum()), spans


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, what is left of text, n_units (pieces), n_removed, removed_chars, and spans (start, length) that went."""
    docs = texts(docs)

    def cut(batches):
        for part, raw, offsets in (x for batch in batches for x in slices(batch)):
            found = Pieces(raw, offsets)
            to, low = np.zeros(len(found.bounds), np.int64), np.zeros(len(found.bounds), np.int32)
            if part.column("units").null_count < len(part):
                piece, ends = found.units(least)
                to[piece], low[piece] = ends, found.digests(piece, ends)[1]
            sizes = np.diff(found.first_piece)
            rows = []
            for row, (doc_id, text, units) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text"), part.column("units").to_pylist(), strict=True)):
                left, n, spans = _cut(found, raw, offsets, row, units, to, low) if units else (text.as_py(), 0, [])
                rows.append((doc_id, left, int(sizes[row]), n, sum(s["length"] for s in spans), spans))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "text", "n_units", "n_removed", "removed_chars", "spans"])

    return docs.join(repeats(docs, least), "doc_id", "left").select("doc_id", "text", "units").mapInArrow(cut, RESULT)


def op9(docs: DataFrame) -> DataFrame:
    """One row per document: what went, where it stood, and what is left."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"))), ",")
    return dedup(docs).select("doc_id", "n_units", "n_removed", "removed_chars", spans.alias("removed_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "text")


def oracle(least: int = LEAST) -> str:
    """DuckDB SQL that compares the units' normal forms themselves. Like op9, for doc_ids that don't repeat."""
    space = r"[ \t\n\r\f\v]"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+{space}*') AS toks FROM documents),
     w AS (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i, len(toks) AS n FROM d),
     x AS (SELECT *, translate(regexp_extract(tok, '[^ \t\n\r\f\v]+'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM w),
     c AS (SELECT *, word[-1] IN ('.', '!', '?') OR (strlen(word) + (ord(word[-1]) & 63)) % 4 = 0 OR contains(tok, chr(10)) OR i = n AS ends FROM x),
     y AS (SELECT *, CAST(coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS k FROM c),
     p AS (SELECT doc_id, k, min(i) - 1 AS a, max(i) AS b, sum(length(tok)) AS chars, string_agg(tok, '' ORDER BY i) AS piece FROM y GROUP BY doc_id, k),
     words AS (SELECT doc_id, list(word ORDER BY i) AS all_words FROM y GROUP BY doc_id),
     u AS (SELECT p.doc_id, p.k, e.k AS last, p.a, e.b FROM p ASOF JOIN p AS e ON p.doc_id = e.doc_id AND p.a + greatest({least}, 1) <= e.b),
     f AS (SELECT u.doc_id, u.k, u.last, array_to_string(all_words[a + 1 : b], ' ') AS form FROM u JOIN words USING (doc_id)),
     late AS (SELECT doc_id, k, last FROM (SELECT *, rank() OVER (PARTITION BY form ORDER BY doc_id, k) AS r FROM f) WHERE r > 1),
     gone AS (SELECT DISTINCT doc_id, unnest(range(k, last + 1)) AS k FROM late),
     q AS (SELECT p.*, gone.k IS NOT NULL AS gone, length(d.t) - sum(chars) OVER (PARTITION BY p.doc_id) + coalesce(sum(chars) OVER (PARTITION BY p.doc_id ORDER BY p.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
                  p.k - row_number() OVER (PARTITION BY p.doc_id, gone.k IS NOT NULL ORDER BY p.k) AS island
           FROM p JOIN d USING (doc_id) LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.k = p.k),
     spans AS (SELECT doc_id, string_agg(pos || ':' || n, ',' ORDER BY pos) AS removed_spans FROM (SELECT doc_id, CAST(min(pos) AS BIGINT) AS pos, CAST(sum(chars) AS BIGINT) AS n FROM q WHERE gone GROUP BY doc_id, island) GROUP BY doc_id),
     kept AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, CAST(coalesce(sum(chars) FILTER (gone), 0) AS BIGINT) AS removed_chars, coalesce(string_agg(piece, '' ORDER BY k) FILTER (NOT gone), '') AS rest FROM q GROUP BY doc_id),
     r AS (SELECT doc_id, t[1 : length(t) - coalesce((SELECT sum(chars) FROM p WHERE p.doc_id = d.doc_id), 0)] AS head FROM d)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed_chars, 0) AS removed_chars, coalesce(removed_spans, '') AS removed_spans,
       sha256(head || coalesce(rest, '')) AS kept_sha256, head || coalesce(rest, '') AS text
FROM r LEFT JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id)"""
