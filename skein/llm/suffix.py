"""Suffix-array dedup: bytes of every repeated string of at least MIN_LENGTH bytes, but the first occurrence, go.

1. Winnowing picks an anchor, the smallest hash of GRAM bytes, in each window of MIN_LENGTH bytes; equal windows
   pick equal anchors. Neighbouring windows with equal anchors form a run. A run whose anchor no other run in the
   corpus has, and whose windows all share one place of it, holds no repeat and is left out.
2. A run's bytes travel to its anchor's group. Equal runs collapse, in each task before that and in the group; all
   but the earliest are repeats.
3. A batch of groups is one text. Its suffixes are sorted by prefix doubling; on the Burrows-Wheeler transform a
   breadth-first backward extension grows the intervals of strings that occur twice or more, STEP bytes at a time,
   and so by increasing common prefix, until MIN_LENGTH bytes. Each interval then left is a repeated
   string; every occurrence but the earliest is a repeat.
4. Repeats, as ranges of bytes, return to their documents.

A group with over GROUP distinct runs, or GROUP_BYTES of them, is refined: its windows fall into two halves by the
distance to their anchor, and those of a half share some bytes beyond the anchor, by which they form new groups. Equal
windows stay together, each window is in one group, and after some rounds a group's windows are all equal. So no task
holds such a group, and nothing is paired. Order is (doc_id, start); matches never cross documents. Null texts count as empty. Rows without
doc_id take no part and keep their text. Rows that repeat a doc_id with another text are documents of equal rank:
the same string at the same start of both stays in both. Only doc_id and text are read, bar columns to be carried.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, discard, materialise, mixed, n_tasks, ragged, slices, texts, trim

MIN_LENGTH = 100
GRAM = 32
STEP = 8
#: Bytes of text of one Burrows-Wheeler transform, about.
BATCH = 1 << 19
#: Distinct runs of one anchor, and their bytes, beyond which its group is refined.
GROUP = 8192
GROUP_BYTES = 1 << 22
#: Groups to be refined that may be broadcast as a list.
BROADCAST_ROWS = 100_000
#: Stands after each run; no byte of UTF-8.
END = 0xFF
_BASE = 0x9E3779B97F4A7C15 | 1
_POSITION_BITS = 23


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    one = np.ones(n + 1, np.uint64)
    up, down = one.copy(), one.copy()
    up[1:] = np.uint64(_BASE)
    down[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
    return np.cumprod(up), np.cumprod(down)


def span_of(length: int) -> int:
    """Grams, and so windows that one anchor can serve, in a window. A longer run holds its anchor more than once."""
    return length - min(GRAM, length // 2) + 1


def _anchored(data: np.ndarray, offsets: np.ndarray, length: int, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Sums of powers before each byte, hash of each gram, begin of each window, and place of the anchor of each window."""
    gram = min(GRAM, length // 2)
    n = len(data)
    up, down = powers
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    if n < length:
        return total, np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = mixed((total[gram:] - total[: n - gram + 1]) * down[: n - gram + 1])
    low = np.uint64((1 << _POSITION_BITS) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, span = 1, span_of(length)
    while width * 2 <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if span > width:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    starts = ragged(offsets[:-1], np.maximum(np.diff(offsets) - length + 1, 0))
    return total, h, starts, (key & low).astype(np.int64)[starts]


def runs(data: np.ndarray, offsets: np.ndarray, length: int, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Anchor (hash), row, start within the row and number of windows of each run, and whether the anchor stands at several places in it."""
    _, h, starts, at = _anchored(data, offsets, length, powers)
    if not len(starts):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    anchor = h[at]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))))
    begin = starts[first]
    row = np.searchsorted(offsets, begin, "right") - 1
    size = np.diff(np.concatenate((first, [len(starts)])))
    # equal windows have their anchors at equal distances, so at different places; places never go back
    several = at[first] != at[first + size - 1]
    return anchor[first].view(np.int64), row, begin - offsets[row], size, several


def depths(length: int) -> int:
    """Halvings after which a group's windows are equal."""
    return (span_of(length) - 1).bit_length()


def refine(data: np.ndarray, offsets: np.ndarray, length: int, depth: int, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Key, row, start within the row and number of windows of the parts into which runs fall after so many halvings.

    Windows that begin high to low bytes before their anchor all hold the bytes from low before it to length - high after.
    """
    total, _, starts, at = _anchored(data, offsets, length, powers)
    if not len(starts):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    before = at - starts
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), span_of(length) - 1)
    for _ in range(depth):
        middle = (low + high + 1) // 2
        upper = before >= middle
        low, high = np.where(upper, middle, low), np.where(upper, high, middle - 1)
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (low[1:] != low[:-1]) | (starts[1:] != starts[:-1] + 1))))
    size = np.diff(np.concatenate((first, [len(starts)])))
    a, b = at[first] - low[first], at[first] + length - high[first]
    key = mixed((total[b] - total[a]) * powers[1][a]) ^ mixed(low[first].astype(np.uint64) + np.uint64(depth << 32))
    row = np.searchsorted(offsets, starts[first], "right") - 1
    return key.view(np.int64), row, starts[first] - offsets[row], size


def may_repeat(run: bytes, length: int) -> bool:
    """Whether a run may hold two equal windows: all windows of a short run hold its middle, which then stands twice."""
    n = len(run) - length + 1
    return n > span_of(length) or run.find(run[n - 1 : length], n) >= 0


def _cut_long(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, length: int):
    """The parts as they are, or a long text's pieces, each with the windows that begin in it: data, offsets, shift."""
    most = 1 << (_POSITION_BITS - 1)
    if len(data) <= most:
        yield data, offsets, 0
        return
    for row in range(len(part)):
        own = data[offsets[row] : offsets[row + 1]]
        for a in range(0, len(own), most):
            piece = own[a : a + most + length - 1]
            yield piece, np.array([0, len(piece)]), (row, a)


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """anchor, doc_id, th (the text's hash), start, n, several of all runs."""

    def emit(batches):
        powers = _powers(1 << 16)
        for batch in batches:
            for part, data, offsets in slices(batch):
                ids, hashes = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th"))
                for piece, own, shift in _cut_long(part, data, offsets, length):
                    if len(piece) > len(powers[0]) - 1:
                        powers = _powers(len(piece))
                    anchor, row, start, n, several = runs(piece, own, length, powers)
                    if shift:
                        row, start = row + shift[0], start + shift[1]
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ids[row]), pa.array(hashes[row]), pa.array(start), pa.array(n.astype(np.int32)), pa.array(several)], ["anchor", "doc_id", "th", "start", "n", "several"])
        trim()

    return docs.where("doc_id IS NOT NULL").mapInArrow(emit, "anchor long, doc_id long, th long, start long, n int, several boolean")


_FOUND = "span boolean, anchor long, run binary, doc_id long, th long, start long, n int"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _FOUND.split(", ")])


def _collapse(rows, length: int):
    """Batches of the earliest of equal runs, and of spans of the others; rows: anchor, run, doc_id, start, th."""
    seen: dict[tuple, tuple] = {}
    out: list[tuple] = []

    def kept():
        return _found([(False, a, run, d, t, s, len(run) - length + 1) for (a, run), (d, s, t) in seen.items()])

    for anchor, run, *place in rows:
        key, place = (anchor, run), tuple(place)
        other = seen.get(key)
        if other is None:
            seen[key] = place
        else:
            if place < other:
                seen[key], place = place, other
            if place[:2] != seen[key][:2]:
                out.append((True, None, None, place[0], place[2], place[1], len(run) - length + 1))
            else:  # rows that repeat a doc_id: both stay first
                out.append((False, anchor, run, place[0], place[2], place[1], len(run) - length + 1))
        if len(out) >= 50_000:
            yield _found(out)
            out = []
        if len(seen) >= 50_000:
            yield kept()
            seen.clear()
    if seen:
        yield kept()
    if out:
        yield _found(out)
    trim()


def _collapsed(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Runs that may hold repeats: the earliest of equal ones that a task sees, and spans of the others."""

    def read(batches):
        for part in (part for batch in batches for part, _, _ in slices(batch)):
            for doc_id, th, text, own in zip(part.column("doc_id").to_pylist(), part.column("th").to_pylist(), part.column("text"), part.column("runs").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                for x in own:
                    yield x["anchor"], raw[x["start"] : x["start"] + x["n"] + length - 1], doc_id, x["start"], th

    def emit(batches):
        yield from _collapse(read(batches), length)

    return docs.join(wanted, ["doc_id", "th"]).select("doc_id", "th", "text", "runs").mapInArrow(emit, _FOUND)


def _refined(runs_: DataFrame, depth: int, length: int) -> DataFrame:
    """The parts of runs after so many halvings, collapsed likewise."""

    def read(batches):
        powers = _powers(1 << 16)
        most = min(SLICE_BYTES, 1 << (_POSITION_BITS - 1))
        for part, data, offsets in (x for batch in batches for x in slices(batch, "run", most)):
            if len(data) > len(powers[0]) - 1:
                powers = _powers(len(data))
            raw, (doc_id, th, start) = data.tobytes(), (part.column(c).to_pylist() for c in ("doc_id", "th", "start"))
            for key, row, a, n in zip(*(x.tolist() for x in refine(data, offsets, length, depth, powers)), strict=True):
                at = int(offsets[row]) + a
                yield key, raw[at : at + n + length - 1], doc_id[row], start[row] + a, th[row]

    def emit(batches):
        yield from _collapse(read(batches), length)

    return runs_.select("run", "doc_id", "th", "start").mapInArrow(emit, _FOUND)


def _packed(text: np.ndarray, at: np.ndarray | slice, n: int) -> np.ndarray:
    """The n (8 at most) bytes from each position on as a number in their order. The text has 8 bytes to spare."""
    wide = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    return wide[at].astype(np.uint64) >> np.uint64(64 - 8 * n)


def suffix_order(spare: np.ndarray, n: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first depth bytes at least, by prefix doubling from eight bytes, and their places."""
    key, known = _packed(spare, slice(0, n), 8), 8
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    # a rank is the first place of its equals, so that it stays while they are sorted on
    first = np.flatnonzero(new)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    tied = np.flatnonzero(~new | ~np.append(new[1:], True))
    while known < depth and len(tied):
        moved = order[tied]
        key = (rank[moved].astype(np.int64) << 32) + rank[np.minimum(moved + known, n)] + 1
        sort = np.argsort(key)
        moved, key = moved[sort], key[sort]
        order[tied] = moved
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(key)))
        rank[moved] = np.repeat(tied[first], size)
        tied = tied[np.repeat(size > 1, size)]
        known *= 2
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    return order, place


def repeated(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Interval and position of each occurrence of every string of so many bytes that occurs twice or more.

    Backward extension on the Burrows-Wheeler transform, whose letters are the STEP bytes before a suffix. Strings
    that hold END are none; the text ends with END.
    """
    n = len(text)
    spare = np.concatenate((text, np.zeros(8, np.uint8)))
    order, place = suffix_order(spare, n, length)
    # a string of so many bytes begins where no END follows nearer; what stands before it then ends there too
    ends = np.flatnonzero(text == END).astype(np.int32)
    begins = np.concatenate(([0], ends[:-1] + 1)).astype(np.int32)
    whole = ends - begins
    past = np.arange(n, dtype=np.int32) - np.repeat(begins, whole + 1)
    # rows are those of suffixes with enough before them for the string still to be completed
    rows = np.flatnonzero(np.repeat(whole >= length, whole + 1)[order])
    parent, grown = np.zeros(len(rows), np.int32), 0
    while grown < length and len(rows):
        step = length % STEP if grown == 0 and length % STEP else min(STEP, length - grown)
        at = order[rows]
        # within its run the string must end at, and grow from, here
        fine = past[at] >= step
        before, parent = at[fine] - step, parent[fine]
        rows = place[before]
        sort = np.argsort(rows)
        rows, parent, letter = rows[sort], parent[sort], _packed(spare, before[sort], step)
        new = np.concatenate(([True], (parent[1:] != parent[:-1]) | (letter[1:] != letter[:-1])))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(rows)))
        twice = np.repeat(size > 1, size)
        rows, parent = rows[twice], np.repeat(np.arange(len(size), dtype=np.int32), size)[twice]
        grown += step
    return parent, order[rows].astype(np.int64)


def repeats_of(found: list[bytes], doc_id: np.ndarray, th: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """doc_id, th, start and windows of the repeats in a batch of runs; each run's place is that of its first byte."""
    sizes = np.fromiter((len(x) + 1 for x in found), np.int64, len(found))
    text = np.frombuffer(b"\xff".join(found) + b"\xff", np.uint8)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    interval, at = repeated(text, length)
    if not len(at):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    run = np.searchsorted(offsets, at, "right") - 1
    where = start[run] + at - offsets[run]
    order = np.lexsort((where, doc_id[run], interval))
    interval, run, where, at = interval[order], run[order], where[order], at[order]
    head = np.flatnonzero(np.concatenate(([True], interval[1:] != interval[:-1])))
    size = np.diff(np.concatenate((head, [len(interval)])))
    first_id, first_at = np.repeat(doc_id[run[head]], size), np.repeat(where[head], size)
    later = (doc_id[run] != first_id) | (where != first_at)
    at, run = at[later], run[later]
    order = np.argsort(at)
    at, run = at[order], run[order]
    if not len(at):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    head = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (run[1:] != run[:-1]))))
    n, run, at = np.diff(np.concatenate((head, [len(at)]))), run[head], at[head]
    return doc_id[run], th[run], start[run] + at - offsets[run], n


def _listed(anchors: DataFrame) -> DataFrame | None:
    """Anchors, written, to be broadcast only if so few have been counted; None without any."""
    stored = materialise(anchors, "groups")
    n = stored.count()
    return (F.broadcast(stored) if n <= BROADCAST_ROWS else stored) if n else None


def _large(runs_: DataFrame, length: int) -> DataFrame | None:
    """Anchors of groups too large for a task: many rows first, then many distinct runs among those."""

    def large(df: DataFrame) -> DataFrame:
        return df.groupBy("anchor").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).where((F.col("rows") > GROUP) | (F.col("bytes") > GROUP_BYTES)).select("anchor")

    sized = runs_.withColumn("bytes", F.col("n").cast("long") + (length - 1))
    many = _listed(large(sized))
    if many is None:
        return None
    return _listed(large(sized.join(many, "anchor", "left_semi").select("anchor", "bytes", F.xxhash64("run").alias("run")).distinct()))


def _grouped(found: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Runs whose groups a task can hold, and spans of repeats that were found on the way."""
    spans, fine, depth = [found.where("span")], [], 0
    todo = found.where("NOT span")
    while depth < depths(length):
        large = _large(todo, length)
        if large is None:
            break
        fine.append(todo.join(large, "anchor", "left_anti"))
        depth += 1
        parts = materialise(_refined(todo.join(large, "anchor", "left_semi"), depth, length), "refined")
        spans.append(parts.where("span"))
        todo = parts.where("NOT span")
    return [*fine, todo], spans


def _by_group(runs_: DataFrame, length: int) -> DataFrame:
    """doc_id, th, start, n of the repeats among runs, found within each anchor's group."""
    dealt = runs_.select("anchor", "run", "doc_id", "th", "start")
    dealt = dealt.repartition(n_tasks(runs_.sparkSession), "anchor").sortWithinPartitions("anchor")

    def search(batches):
        held: list[tuple] = []  # distinct runs of groups that have two or more, or a run that may hold repeats of its own
        late: list[tuple] = []  # repeats of whole runs
        group: dict[bytes, tuple] = {}
        size, last = 0, None

        def close():
            nonlocal size
            if len(group) > 1 or any(may_repeat(run, length) for run in group):
                held.extend((run, *place) for run, place in group.items())
                size += sum(map(len, group)) + len(group)
            group.clear()

        def done():
            columns = [np.array(x, np.int64) for x in zip(*late, strict=True)] or [np.empty(0, np.int64)] * 4
            if held:
                found, doc_id, start, th = zip(*held, strict=True)
                more = repeats_of(list(found), *(np.array(x, np.int64) for x in (doc_id, th, start)), length)
                columns = [np.concatenate(x) for x in zip(columns, more, strict=True)]
            held.clear()
            late.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns[:3]] + [pa.array(columns[3].astype(np.int32))], ["doc_id", "th", "start", "n"])

        for batch in batches:
            for anchor, run, doc_id, th, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != last:
                    close()
                    last = anchor
                if size > BATCH or len(late) > 100_000:
                    yield done()
                    trim()
                    size = 0
                place, other = (doc_id, start, th), group.get(run)
                if other is None:
                    group[run] = place
                    continue
                if place < other:
                    group[run], place = place, other
                if place[:2] != group[run][:2]:
                    late.append((place[0], place[2], place[1], len(run) - length + 1))
        close()
        if held or late:
            yield done()
        trim()

    return dealt.mapInArrow(search, "doc_id long, th long, start long, n int")


def repeats(docs: DataFrame, length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, th and spans (start, end, in bytes; they may overlap) of texts with repeats. docs: doc_id, text, th."""
    every = materialise(_anchors(docs, length), "runs")
    twice = every.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    some = every.where("NOT several").join(twice, "anchor", "left_semi").unionByName(every.where("several"))
    wanted = some.groupBy("doc_id", "th").agg(F.collect_set(F.struct("anchor", "start", "n")).alias("runs"))
    wanted = materialise(wanted, "wanted")
    discard(every)
    found = materialise(_collapsed(docs, wanted, length), "collapsed")
    discard(wanted)
    fine, spans = _grouped(found, length)
    late = _by_group(reduce(DataFrame.unionByName, fine), length)
    spans = reduce(DataFrame.unionByName, (x.select("doc_id", "th", "start", "n") for x in spans)).unionByName(late)
    spans = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n") + (length - 1)).alias("end"))).alias("spans"))
    spans = materialise(spans, "spans")
    discard(found)
    return spans


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for a, b in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def hashed(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text, th and the columns to be kept."""
    return texts(docs, *keep).withColumn("th", F.xxhash64("text"))


def op6(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    docs = hashed(docs)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def measure(batches):
        for part in (part for batch in batches for part, _, _ in slices(batch)):
            rows = []
            for doc_id, text, spans in zip(part.column("doc_id").to_pylist(), part.column("text"), part.column("spans").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.as_buffer() is not None else b""
                gone, kept, at = merged(spans), hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((doc_id, len(raw), sum(b - a for a, b in gone), len(gone), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.string()), strict=True)], [c.split()[0] for c in schema.split(", ")])
        trim()

    return docs.join(repeats(docs), ["doc_id", "th"], "left").select("doc_id", "text", "spans").mapInArrow(measure, schema)


def oracle(length: int = MIN_LENGTH) -> str:
    """DuckDB SQL that compares all windows by their bytes in hexadecimal. Like op6, for doc_ids that are neither null nor repeated."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     parts AS (SELECT doc_id, first, h[2 * first + 1 : 2 * (first + 1000 + {length - 1})] AS part FROM (SELECT doc_id, h, unnest(range(0, strlen(h) // 2, 1000)) AS first FROM d)),
     w AS (SELECT doc_id, first + i AS s, part[2 * i + 1 : 2 * (i + {length})] AS win FROM (SELECT *, unnest(range(0, strlen(part) // 2 - {length - 1})) AS i FROM parts)),
     late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS r FROM w) WHERE r > 1),
     marked AS (SELECT *, coalesce(s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= {length}, false) AS joined FROM late),
     island AS (SELECT *, sum(CAST(NOT joined AS INT)) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM marked),
     spans AS (SELECT doc_id, k, min(s) AS a, max(s) + {length} AS b FROM island GROUP BY doc_id, k),
     gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
     cut AS (SELECT doc_id, string_agg(h[2 * before + 1 : 2 * a], '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS gone, count(*) AS n FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || h[2 * coalesce(last, 0) + 1 :])) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""


def dedup(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text and the columns to be kept; repeats are cut out of the texts.

    A character of which any byte is a repeat goes whole, so that the rest is UTF-8.
    """
    own = hashed(docs, *keep)

    def left(text, spans):
        raw, at, parts = text.as_buffer().to_pybytes() if text.as_buffer() is not None else b"", 0, []
        for a, b in merged(spans):
            parts.append(raw[at:a])
            at = b
        parts.append(raw[at:])
        return b"".join(x.decode("utf-8", "ignore").encode() for x in parts)

    def cut(batches):
        for part in (part for batch in batches for part, _, _ in slices(batch)):
            columns = {name: part.column(name) for name in part.schema.names if name != "spans"}
            if part.column("spans").null_count < len(part):
                columns["text"] = pa.array([left(*x) for x in zip(part.column("text"), part.column("spans").to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        trim()

    joined = own.join(repeats(own.select("doc_id", "text", "th")), ["doc_id", "th"], "left").select("doc_id", "text", *keep, "spans")
    schema = joined.drop("spans").schema
    return joined.mapInArrow(cut, schema)
