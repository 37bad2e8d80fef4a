"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, padded with zeros, become the 8-bit samples of a grey PNG, 64 samples a row. Each task
writes its payloads into tar shards in the shared folder, one member for each different content, named by its
digest; rows carry digest, shard, offset and length. A second pass fills metadata columns by range reads of the
header alone, and, for features, reads the stored bytes.

Null texts count as empty: 64 zero bytes. Equal texts share a member within a shard. A very long text is one member,
read and decoded whole; a worker holds it some four times over. Rows that repeat a doc_id, and rows without one, are
stored and read like others. An empty table gives an empty one. Only doc_id and text are read. A task that is run again
writes shards under new names; rows of the manifest only ever name shards of the attempt that was committed.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, materialise, n_tasks, scratch, texts

ROW = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and IHDR: what a header-only range read fetches.
HEADER_BYTES = 33
SHARD_BYTES = 256 << 20
#: Media read back by one task, about.
TASK_BYTES = 64 << 20
READ_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(raw: bytes) -> bytes:
    """Zeros up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % ROW if raw else ROW)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """A PNG whose samples are the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth, from the first HEADER_BYTES."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", first[16:25])


def decode(media: bytes) -> bytes:
    """The samples of a PNG that encode() made."""
    width, height, _ = header(media)
    at, body = 8, b""
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            body += media[at + 8 : at + 8 + size]
        at += size + 12
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


class Shards:
    """The tar shards that one task writes."""

    def __init__(self, folder: str) -> None:
        self.fs, self.folder = filesystem(folder)
        context = TaskContext.get()
        self.stem = f"{context.partitionId():06d}-{context.taskAttemptId()}" if context else uuid.uuid4().hex
        self.n, self.out, self.at, self.known = 0, None, 0, {}

    def put(self, digest: str, media: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            self.fs.create_dir(self.folder, recursive=True)
            self.name = f"{self.folder}/{self.stem}-{self.n:04d}.tar"
            self.out, self.at, self.known = self.fs.open_output_stream(self.name), 0, {}
            self.n += 1
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(media)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + media + bytes(-len(media) % 512))
        place = (self.name, self.at + len(head), len(media))
        self.at += len(head) + len(media) + -len(media) % 512
        self.known[digest] = place
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store(docs: DataFrame) -> DataFrame:
    """The manifest: doc_id, n_bytes, digest (of the payload), shard, offset, length. Written to the shared folder."""
    folder = f"{scratch(docs.sparkSession)}/media-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder)
        try:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    raw = text.as_buffer().to_pybytes() if text.as_buffer() is not None else b""
                    digest = hashlib.sha256(padded(raw)).hexdigest()
                    rows.append((doc_id, len(raw), digest, *(shards.known.get(digest) or shards.put(digest, encode(padded(raw))))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        finally:
            shards.close()

    made = texts(docs).mapInArrow(write, "doc_id long, n_bytes long, digest string, shard string, offset long, length long")
    return materialise(made, "manifest")


class Reader:
    """Range reads of shards, one file open at a time."""

    def __init__(self, folder: str) -> None:
        self.fs, _ = filesystem(folder)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            self.name, self.file = shard, self.fs.open_input_file(shard)
        return self.file.read_at(length, offset)


def _spread(manifest: DataFrame) -> DataFrame:
    """Neighbours in a shard go to one task; the number of tasks follows the media's bytes."""
    total = manifest.agg(F.sum("length")).first()[0] or 0
    return manifest.repartitionByRange(n_tasks(manifest.sparkSession, -(-total // TASK_BYTES)), "shard", "offset", "doc_id")


def metadata(manifest: DataFrame) -> DataFrame:
    """Adds width, height and bit_depth, from range reads of the headers alone."""
    where = scratch(manifest.sparkSession)

    def fill(batches):
        reader = Reader(where)
        for batch in batches:
            found = [header(reader.read(s, o, HEADER_BYTES)) for s, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[k] for x in found], pa.int32()) for k in range(3))], [*batch.schema.names, "width", "height", "bit_depth"])

    kinds = ", ".join(f"{n} {t}" for n, t in manifest.dtypes)
    return _spread(manifest).mapInArrow(fill, f"{kinds}, width int, height int, bit_depth int")


def features(media: bytes, head: tuple[int, int, int] | None = None) -> tuple:
    """What the stored bytes show, besides what the manifest has; head: width, height and bit depth, if they are known."""
    width, height, depth = head or header(media[:HEADER_BYTES])
    payload = decode(media)
    samples = np.frombuffer(payload, np.uint8)
    feature = f"png {width}x{height} gray{depth} sum={int(samples.sum(dtype=np.int64))} distinct={len(np.flatnonzero(np.bincount(samples, minlength=256)))}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature


def read_back(manifest: DataFrame) -> DataFrame:
    """Reads each row's stored form and computes its features, with the metadata columns where metadata() has filled them."""
    where, filled = scratch(manifest.sparkSession), "width" in manifest.columns

    def read(batches):
        reader, recent = Reader(where), OrderedDict()
        for batch in batches:
            rows = []
            heads = zip(*(batch.column(c).to_pylist() for c in ("width", "height", "bit_depth")), strict=True) if filled else [None] * len(batch)
            for doc_id, n, shard, offset, length, head in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "shard", "offset", "length")), heads, strict=True):
                if (shard, offset) not in recent:
                    recent[shard, offset] = features(reader.read(shard, offset, length), head)
                    if len(recent) > 256:
                        recent.popitem(last=False)
                rows.append((doc_id, n, *recent[shard, offset]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in READ_SCHEMA.split(", ")])

    return _spread(manifest).mapInArrow(read, READ_SCHEMA)


def op2(docs: DataFrame) -> DataFrame:
    """The contract's columns: stores every text, fills the metadata columns from the headers, and reads the texts back."""
    return read_back(materialise(metadata(store(docs)), "metadata"))
