"""SimHash near-dedup by Golay-code fuzzy hashing.

A fingerprint's 64 bits fall into four blocks of 16. If two fingerprints differ in at most three bits, a block is
equal, and one of the two 24-bit halves of the other three blocks has at most one error: eight tables. There a key
is the equal block with the index of the codeword, in the perfect binary Golay code, nearest to 23 bits of the half.
A word has one nearest codeword; the words one bit away have one or six between them. Each fingerprint sends
its own codeword's key and all keys of its neighbourhood, so that any two within reach meet at the own key of one.
All that share a key meet in one task, which compares them and sends a forest; no pairs are sent. A key with more than
a task holds is narrowed: two within reach differ in three of its free bits at most, so of four pieces of these one is
equal, and the pieces' values are the new keys. Components of all forests follow.

Equal fingerprints are one node, so copies are never paired. Null texts count as empty: fingerprint zero. A very long
text is hashed whole, its shingles in one array. Rows that repeat a doc_id are told apart by nothing but their texts;
rows without doc_id get a fingerprint, and their component is the smallest doc_id that they reach, or null. An empty
table gives an empty one. Only doc_id and text are read; other columns go, whatever their names.

similar() is for near-duplicates by similarity: texts whose sets of word shingles have a Jaccard similarity of 0.8 or
more. A fingerprint of such shingles would be too far away (one changed word changes five of them), so a text has
several, each of its set of single words under another seed. Fingerprints within reach, of any seed, give candidate
components; within one all texts are compared exactly. What no seed brings together, in one step or more, is missed.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mixed, n_tasks, ragged, texts
from .graph import FOREST_EDGES, _forest, components, forests

REACH = 3
WORDS = 3
#: Words of a shingle, and least similarity, of similar().
SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of a text in similar().
SEEDS = 5
#: Texts, and bytes of text, of a candidate component beyond which it is dealt out in blocks.
MEMBERS = 1024
BYTES = 4 << 20
#: Fingerprints with one key beyond which they are linked one after another, and rows that a task holds: a key with more is narrowed.
FEW = 16
MET_ROWS = 1 << 17
#: The Golay code's generator polynomial.
GENERATOR = 0xC75


def fingerprint(raw: bytes) -> int:
    """The fingerprint of a text's UTF-8 bytes."""
    words = raw.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        hashes = [digest(b" ".join(words), 42)]
    else:
        hashes = [digest(b"%b %b %b" % x, 42) for x in zip(words, words[1:], words[2:])]
    return majority(np.array(hashes, "<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        part = h[a : a + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def compute(batches):
        for batch in batches:
            column = batch.column("text")
            fps = np.fromiter((fingerprint(x.as_buffer().to_pybytes()) if x.as_buffer() is not None else 0 for x in column), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(compute, "doc_id long, fp long")


class Golay:
    """The perfect binary Golay code of length 23: every word lies within three bits of one codeword."""

    def __init__(self) -> None:
        self.patterns = np.zeros(1 << 11, np.uint32)  # by syndrome
        for n in range(4):
            for bits in combinations(range(23), n):
                e = np.uint32(sum(1 << b for b in bits))
                self.patterns[int(self.syndrome(np.array([e], np.uint32))[0])] = e

    @staticmethod
    def syndrome(word: np.ndarray) -> np.ndarray:
        """The remainder of division by the generator."""
        rest = word.astype(np.uint32)
        for bit in range(22, 10, -1):
            rest = np.where(rest >> np.uint32(bit) & np.uint32(1), rest ^ np.uint32(GENERATOR << (bit - 11)), rest)
        return rest

    def index(self, word: np.ndarray) -> np.ndarray:
        """The 12-bit index of the nearest codeword."""
        return (word ^ self.patterns[self.syndrome(word)]) >> np.uint32(11)


def _blocks(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp >> np.uint64(16 * i) & np.uint64(0xFFFF)) for i in range(4)]


def tables(fp: np.ndarray):
    """For each of the eight tables: its number with the equal block, and the 23 bits to be decoded."""
    blocks = _blocks(fp)
    for i in range(4):
        a, b, c = (blocks[k] for k in range(4) if k != i)
        rest = a | b << np.uint64(16) | c << np.uint64(32)
        for half in range(2):
            yield np.uint64((2 * i + half) << 28) | blocks[i] << np.uint64(12), (rest >> np.uint64(24 * half) & np.uint64(0x7FFFFF)).astype(np.uint32)


def keys(fps: DataFrame) -> DataFrame:
    """key, fp, own: keys of the codewords of all words at most one bit away, and whether it is that of the own codeword."""

    def send(batches):
        code = Golay()
        flips = np.concatenate(([0], 1 << np.arange(23))).astype(np.uint32)
        for batch in batches:
            signed = batch.column("fp").to_numpy(zero_copy_only=False)
            fp = signed.view(np.uint64)
            for base, word in tables(fp):
                found = np.sort(code.index((word[:, None] ^ flips).ravel()).reshape(len(fp), -1), axis=1)
                new = np.concatenate((np.ones((len(fp), 1), bool), found[:, 1:] != found[:, :-1]), axis=1)
                key, fps = (base[:, None] | found.astype(np.uint64))[new], np.broadcast_to(signed[:, None], found.shape)[new]
                own = (found == code.index(word)[:, None])[new]
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(np.ascontiguousarray(fps)), pa.array(own)], ["key", "fp", "own"])

    return fps.select("fp").mapInArrow(send, "key long, fp long, own boolean")


def narrowed(late: DataFrame) -> DataFrame:
    """key, fp, own and free of fingerprints under four new keys each; free has the bits in which those of a key may differ."""

    def send(batches):
        for batch in batches:
            key, signed, free = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "free"))
            for mask in np.unique(free).tolist():
                rows = free == mask
                fp, base = signed[rows].view(np.uint64), key[rows].view(np.uint64)
                for piece in np.array_split([b for b in range(64) if mask >> b & 1], REACH + 1):
                    bits = sum(1 << b for b in piece.tolist())
                    new = mixed(mixed(base + np.uint64(bits)) ^ (fp & np.uint64(bits)))
                    left = np.full(len(fp), (mask % (1 << 64)) & ~bits, np.uint64).view(np.int64)
                    columns = [pa.array(x) for x in (new.view(np.int64), signed[rows], np.ones(len(fp), bool), left)]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "fp", "own", "free"])

    return late.select("key", "fp", "free").mapInArrow(send, "key long, fp long, own boolean, free long")


def _connected(fp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within reach: so many that all such are connected. What one fingerprint reaches is one step."""
    label, a, b = np.arange(len(fp)), [], []
    for i in range(len(fp)):
        if (label == label[i]).all():
            break
        near = np.flatnonzero((np.bitwise_count(fp ^ fp[i]) <= reach) & (label != label[i]))
        if len(near):
            a.append(np.full(len(near), fp[i]))
            b.append(fp[near])
            label[np.isin(label, label[near])] = label[i]
    none = np.empty(0, np.uint64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def _within(key: np.ndarray, fp: np.ndarray, own: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows with equal keys, which are sorted: of each few all that have an own key, of many a forest."""
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(head, len(key)))
    few = (size > 1) & (size <= FEW)
    left = ragged(head[few], size[few])
    n, first = np.repeat(size[few], size[few]), np.repeat(head[few], size[few])
    mine = own[left]
    left, right = np.repeat(left[mine], n[mine]), ragged(first[mine], n[mine])
    fine = (left != right) & (np.bitwise_count(fp[left] ^ fp[right]) <= reach)
    parts = [(fp[left[fine]], fp[right[fine]])]
    parts += [_connected(np.unique(fp[h : h + k]), reach) for h, k in zip(head[size > FEW].tolist(), size[size > FEW].tolist(), strict=True)]
    a, b = (np.concatenate(x).view(np.int64) for x in zip(*parts, strict=True))
    return _forest(a, b) if len(a) else (a, b)


def _meet(batches):
    """a and b: links of rows that share a key, by which they are sorted; key, fp and free: rows of a key with too many."""
    names = ["a", "b", "key", "fp", "free"]

    def found(columns):
        a, b = _within(columns[0], columns[1].view(np.uint64), columns[2], REACH)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.nulls(len(a), pa.int64())] * 3], names)

    def late(columns):
        return pa.RecordBatch.from_arrays([*[pa.nulls(len(columns[0]), pa.int64())] * 2, *(pa.array(columns[i]) for i in (0, 1, 3))], names)

    held: list[tuple] = []
    rows, many = 0, None  # many: a key whose rows go on unheld
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names]
        if len(columns) == 3:  # the first keys: the block in the key is equal, the others are free
            block = (columns[0] >> 29).astype(np.uint64)
            columns.append(~(np.uint64(0xFFFF) << (np.uint64(16) * block)).view(np.int64))
        if many is not None:
            n = int(np.searchsorted(columns[0], many, "right"))
            if n:
                yield late([x[:n] for x in columns])
                columns = [x[n:] for x in columns]
            if not len(columns[0]):
                continue
            many = None
        held.append(tuple(columns))
        rows += len(columns[0])
        if rows < MET_ROWS:
            continue
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        end = int(np.searchsorted(columns[0], columns[0][-1]))  # the last key may go on
        if end:
            yield found([x[:end] for x in columns])
            held = [tuple(x[end:].copy() for x in columns)]
            rows -= end
        else:
            yield late(columns)
            many, held, rows = int(columns[0][0]), [], 0
    if held:
        yield found([np.concatenate(x) for x in zip(*held, strict=True)])


def links(fps: DataFrame) -> DataFrame:
    """a and b with the components of all pairs within reach, from distinct fingerprints (fp)."""
    sent, parts = keys(fps), []
    while True:
        met = sent.repartition("key").sortWithinPartitions("key").mapInArrow(_meet, "a long, b long, key long, fp long, free long")
        met = materialise(met, "met")
        parts.append(met.where("key IS NULL").select("a", "b"))
        late = met.where("key IS NOT NULL")
        if late.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        sent = narrowed(late)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id of those that links join."""
    prints = materialise(fingerprints(docs), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = components(links(distinct))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def word_prints(raw: bytes, seeds: int) -> list[int]:
    """One fingerprint for each seed, of the set of a text's words; zero without words."""
    h = np.array([xxhash.xxh64_intdigest(x, 42) for x in set(raw.lower().split())], "<u8")
    return [majority(mixed(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))) for k in range(seeds)]


def shingles(raw: bytes, words: int) -> np.ndarray:
    """Hashes of a text's distinct shingles: the whole sequence, perhaps empty, if the words are fewer."""
    found = raw.lower().split()
    whole = [b" ".join(found[i : i + words]) for i in range(max(len(found) - words + 1, 1))]
    return np.unique(np.array([xxhash.xxh64_intdigest(x, 42) for x in whole], "<u8"))


def similar_pairs(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with at least that Jaccard similarity: so many that all such pairs are connected."""
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(m), size)
    _, name = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(name, kind="stable")
    count = np.bincount(name)
    first, holders = np.cumsum(count) - count, owner[order]
    ends, label = np.cumsum(size), np.arange(m)
    a, b = [], []
    for i in range(m):
        if (label == label[i]).all():
            break
        own = name[ends[i] - size[i] : ends[i]]
        both = np.bincount(holders[ragged(first[own], count[own])], minlength=m)
        near = np.flatnonzero((both >= similarity * (size + size[i] - both)) & (label != label[i]))
        a.append(np.full(len(near), i))
        b.append(near)
        label[np.isin(label, label[near])] = label[i]
    return np.concatenate(a or [np.empty(0, np.int64)]), np.concatenate(b or [np.empty(0, np.int64)])


def _verified(dealt: DataFrame, words: int, similarity: float) -> DataFrame:
    """a and b: links of texts (th), compared within each group (root, i, j)."""

    def compare(batches):
        group: dict[int, np.ndarray] = {}
        last = None

        def close():
            th = np.array(list(group), np.int64)
            a, b = (th[x] for x in similar_pairs(list(group.values()), similarity))
            group.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j")), strict=True)
            for place, th, text in zip(places, batch.column("th").to_pylist(), batch.column("text"), strict=True):
                if place != last and len(group) > 1:
                    yield close()
                if place != last:
                    group.clear()
                    last = place
                if th not in group:
                    group[th] = shingles(text.as_buffer().to_pybytes() if text.as_buffer() is not None else b"", words)
        if len(group) > 1:
            yield close()

    return dealt.mapInArrow(compare, "a long, b long")


def similar(docs: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY, seeds: int = SEEDS) -> DataFrame:
    """doc_id and component_id: the smallest doc_id of those that links join, a link being an exact similarity.

    Equal texts are one node (by a 64-bit hash). Null texts count as empty; texts without words are equal, texts with
    fewer words than a shingle have one. Odd rows are as with near_duplicates().
    """

    def compute(batches):
        for batch in batches:
            fps = [word_prints(x.as_buffer().to_pybytes() if x.as_buffer() is not None else b"", seeds) for x in batch.column("text")]
            fps = pa.array(np.array(fps, np.uint64).reshape(-1).view(np.int64))
            fps = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * seeds), fps)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), batch.column("size"), fps], ["doc_id", "th", "size", "fps"])

    own = texts(docs).withColumn("th", F.xxhash64("text"))
    sized = own.withColumn("size", F.octet_length("text").cast("long"))
    prints = materialise(sized.mapInArrow(compute, "doc_id long, th long, size long, fps array<long>"), "prints")
    nodes = materialise(prints.groupBy("th").agg(F.min("doc_id").alias("first_id"), F.first("size").alias("size"), F.first("fps").alias("fps")), "nodes")

    met = []
    for k in range(seeds):
        printed = nodes.select("th", F.col("fps")[k].alias("fp"))
        by_print = materialise(printed.groupBy("fp").agg(F.min("th").alias("node")), "by-print")
        equal = printed.join(by_print, "fp").where("th != node").select(F.col("th").alias("a"), F.col("node").alias("b"))
        close = links(by_print)
        # each task that saw a group has sent a forest of it; few tasks make one of these before they are joined
        close = forests(close.coalesce(1 + close.count() // FOREST_EDGES))
        for end in ("a", "b"):
            close = close.join(by_print.select(F.col("fp").alias(end), F.col("node").alias(f"node_{end}")), end)
        met.append(materialise(equal.unionByName(close.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))), "met"))
    found = components(reduce(DataFrame.unionByName, met))

    members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "th")
    members = members.join(nodes.select("th", "first_id", "size"), "th")
    blocks = F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("size") / BYTES), F.lit(1)).cast("int")
    members = members.join(members.groupBy("root").agg(blocks.alias("blocks")), "root")
    block = F.pmod(F.xxhash64("th"), F.col("blocks")).cast("int")
    # one block is one group; of more, each pair of different blocks is
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (F.col("blocks") == 1) | (x != block))
    pairs = F.transform(others, lambda x: F.struct(F.least(x, block).alias("i"), F.greatest(x, block).alias("j")))
    members = members.select("th", "first_id", "root", F.explode(pairs).alias("pair")).select("th", "first_id", "root", "pair.i", "pair.j")
    dealt = own.join(members, "th").where("doc_id <=> first_id").select("root", "i", "j", "th", "text")
    dealt = dealt.repartition(n_tasks(docs.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j")
    linked = components(_verified(dealt, words, similarity))

    rooted = nodes.join(linked, nodes["th"] == linked["node"], "left").select("th", "first_id", F.coalesce("root", "th").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_text = rooted.join(least, "root").select("th", "component_id")
    return prints.select("doc_id", "th").join(by_text, "th").select("doc_id", "component_id")


def op4(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
