"""Packing: vector bin packing by the dot-product heuristic, under limits on tokens, segments and loss-bearing tokens.

Each task packs what it reads; an open sequence takes, of the pieces that fit, the one whose demands point most
along the room that is left. Documents may be cut: what fills a sequence alone goes first, remainders are packed
together, a gap that no remainder fits is filled by cutting one, and a task's last sequence is cut into lengths that
are powers of two, which need no padding. Examples of instruction data stay whole.

Null texts count as empty (one token, the end). A very long text is encoded whole; its full sequences leave at once.
Of pieces that fit equally well the one that waits longest is taken. Rows that repeat a doc_id, and rows without one,
are documents of their own. A sequence's id holds the task's partition, so ids are unique and a task that runs again
gives the same ones. An empty table gives an empty one. Only the named columns are read, whatever the others are called.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

LENGTH = 1024
#: Pieces that wait at once for a sequence; a full window is packed down to half.
WINDOW = 2048
SEGMENTS = 256
#: Tokens, turns and loss-bearing tokens of a sequence of conversations.
CONVERSATION_LIMITS = (2048, 16, 1024)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ByteBPE:
    """Token ids as little-endian unsigned 32-bit bytes, by a byte-level BPE that `tokenizers` describes.

    The ids are those of tokenizers' encode(text, add_special_tokens=False), by the same vocabulary in tiktoken.
    """

    def __init__(self, ranks: str, pattern: str, special: dict[str, int]) -> None:
        import base64

        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.special = special

    def encode(self, text: str) -> bytes:
        for word, number in self.special.items():
            if word in text:
                return np.array([number], "<u4").tobytes().join(self.encode(x) for x in text.split(word))
        # an array takes the list of ids faster than numpy does
        return np.asarray(array("I", self.plain.encode_ordinary(text)), "<u4").tobytes()


def byte_bpe_50k(path: str | None = None) -> ByteBPE:
    """The public 50k vocabulary; path: the folder of the vocabulary files."""
    import public_tokenizers as P

    place = (lambda name: os.path.join(path, name)) if path else P.path
    return ByteBPE(place("byte_bpe_50k.tiktoken"), P.PATTERN, {"<|endoftext|>": 50256})


class Packer:
    """Vector bin packing of a stream. Demands are rows of (tokens, segments, loss-bearing tokens)."""

    def __init__(self, limits: tuple[int, int, int], cut: bool) -> None:
        self.limits, self.cut = np.array(limits, np.int64), cut
        self.demand, self.items, self.done = [], [], []

    def add(self, item, demand: tuple[int, int, int]) -> None:
        """Items are passed back with their first token, their number of tokens and their place."""
        if (np.array(demand) > self.limits).any():
            self.done.append([(item, 0, demand[0])])
            return
        self.items.append((item, 0))
        self.demand.append(demand)
        if len(self.items) >= WINDOW:
            self.pack(WINDOW // 2)

    def pack(self, leave: int) -> None:
        """Fills sequences until at most so many items wait."""
        size, wait = np.array(self.demand, np.float64).reshape(-1, 3), np.ones(len(self.items), bool)
        items, share = list(self.items), 1 / self.limits
        while wait.sum() > leave:
            room, sequence = self.limits.astype(np.float64), []
            while True:
                fits = np.flatnonzero(wait & (size <= room).all(1))
                if not len(fits):
                    break
                best = fits[np.argmax((size[fits] * share) @ (room * share))]
                sequence.append((*items[best], int(size[best, 0])))
                room -= size[best]
                wait[best] = False
                if room[0] == 0:
                    break
            gap = int(min(room[0], room[2]))
            if self.cut and gap and room[1] >= 1 and wait.any():
                best = int(np.argmax(np.where(wait, size[:, 0], -1)))
                item, start = items[best]
                sequence.append((item, start, gap))
                items[best] = (item, start + gap)
                size[best] -= (gap, 0, gap)
            self.done.append(sequence)
        kept = np.flatnonzero(wait)
        self.items = [items[i] for i in kept]
        self.demand = [tuple(int(x) for x in size[i]) for i in kept]

    def finish(self) -> None:
        """Packs the rest; with cutting, sequences that are not full are cut into powers of two."""
        self.pack(0)
        if not self.cut or not self.done:
            return
        full = [s for s in self.done if sum(x[2] for x in s) == self.limits[0]]
        for sequence in (s for s in self.done if sum(x[2] for x in s) < self.limits[0]):
            left = sum(x[2] for x in sequence)
            queue = list(sequence)
            while left:
                room, part = 1 << (left.bit_length() - 1), []
                left -= room
                while room:
                    item, start, n = queue.pop(0)
                    take = min(n, room)
                    part.append((item, start, take))
                    room -= take
                    if take < n:
                        queue.insert(0, (item, start + take, n - take))
                full.append(part)
        self.done = full

    def drain(self) -> Iterator[list]:
        done, self.done = self.done, []
        yield from done


def pack_documents(docs: DataFrame, length: int = LENGTH, tokenizers_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def pack(batches):
        bpe, packer, n = byte_bpe_50k(tokenizers_path), Packer((length, SEGMENTS, length), True), 0
        first = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])
            rows.clear()
            return out

        def place():
            nonlocal n
            for sequence in packer.drain():
                offset = 0
                for (doc_id, at, ids, total), start, size in sequence:
                    rows.append((doc_id, at + start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), total, first + n, offset))
                    offset += size
                n += 1

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = bpe.encode(text.as_py()) + bytes(4)
                total = len(ids) // 4
                whole = total - total % length
                for start in range(0, whole, length):
                    rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, first + n, 0))
                    n += 1
                if total > whole:
                    packer.add((doc_id, whole, ids[4 * whole :], total), (total - whole, 1, total - whole))
                    if packer.done:
                        place()
                if len(rows) > 20_000:
                    yield flush()
        packer.finish()
        place()
        if rows:
            yield flush()

    return texts(docs).mapInArrow(pack, SCHEMA)


def pack_examples(examples: DataFrame, id_col: str, tokens: str, segments: str, loss: str, limits: tuple[int, int, int]) -> DataFrame:
    """Places whole examples of instruction data: id, sequence_id, offset (in tokens).

    Null demands count as 0. An example that exceeds a limit by itself has a sequence of its own.
    """
    kind = dict(examples.dtypes)[id_col]

    def pack(batches):
        packer, n = Packer(limits, False), 0
        first = TaskContext.get().partitionId() << 40

        def place():
            nonlocal n
            out = []
            for sequence in packer.drain():
                offset = 0
                for item, _, size in sequence:
                    out.append((item, first + n, offset))
                    offset += size
                n += 1
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], arrow_id), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], [id_col, "sequence_id", "offset"])

        arrow_id = None
        for batch in batches:
            arrow_id = batch.schema.field(0).type
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for item, *demand in zip(*columns, strict=True):
                packer.add(item, tuple(int(x or 0) for x in demand))
            if packer.done:
                yield place()
        packer.finish()
        if packer.done:
            yield place()

    return examples.select(id_col, tokens, segments, loss).mapInArrow(pack, f"`{id_col}` {kind}, sequence_id long, offset long")


def conversation_demands(conversations: DataFrame, tokenizers_path: str | None = None) -> DataFrame:
    """conv_id, tokens, segments (turns) and loss (tokens of the assistant's turns); each turn ends with the id 0.

    Null texts count as empty; turns without conv_id are one conversation.
    """

    def count(batches):
        bpe = byte_bpe_50k(tokenizers_path)
        for batch in batches:
            n = [len(bpe.encode(text.as_py())) // 4 + 1 for text in batch.column("text")]
            loss = [size if role == "assistant" else 0 for size, role in zip(n, batch.column("role").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(loss, pa.int64())], ["conv_id", "tokens", "loss"])

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "role", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counted = turns.mapInArrow(count, "conv_id long, tokens long, loss long")
    return counted.groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("segments"), F.sum("loss").alias("loss"))


def pack_conversations(conversations: DataFrame, limits: tuple[int, int, int] = CONVERSATION_LIMITS) -> DataFrame:
    """Whole conversations packed under limits on tokens, turns and loss-bearing tokens: conv_id, sequence_id, offset."""
    return pack_examples(conversation_demands(conversations), "conv_id", "tokens", "segments", "loss", limits)


def op8(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return pack_documents(docs)
