"""Token files: fixed-width bit packing with block offsets.

One file holds the documents of one range of doc_id in ascending order. Each id takes the least number of bits that the
vocabulary needs, so id i of a block begins at bit i * bits and numpy unpacks any range of a block at once. Layout, all
numbers little-endian:

    header   40 bytes: magic "TOKPACK1", bits (4), vocabulary (4), documents (8), ids (8), ids a block (8)
    documents   documents * 25 bytes: doc_id (8 each, all first), 1 where the id is null (1 each), first id within the file (8), ids (8)
    offsets     (blocks + 1) * 8: where each block begins, counted from the end of this table
    blocks      packed ids, each block padded to whole bytes

A file is written under a name of its own and renamed when complete: a task that runs again or twice leaves one whole file.
Paths may be on any store that pyarrow can open (file, hdfs, s3, gs).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.llm.shared import documents, new_folder, send_code, staged
from cohortloom.llm.tokens import crc, default_tokenizer, encoder, slices, texts_of

MAGIC, HEADER = b"TOKPACK1", struct.Struct("<8sIIQQQ")
BLOCK_IDS = 65_536
# Ids that one task reads back.
RANGE_IDS = 8_000_000


def bits_for(vocabulary: int) -> int:
    """Least number of bits that holds every id below `vocabulary`."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another, `bits` each, least significant bit first, padded to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_ids(data: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """Ids first to first + count - 1 of packed data; only the bytes that hold them are looked at."""
    if bits in (8, 16, 32):
        width = bits // 8
        return np.frombuffer(data, f"<u{width}", count, first * width).astype(np.uint32)
    low = first * bits // 8
    view = np.frombuffer(data, np.uint8)[low : -(-(first + count) * bits // 8)]
    spread = np.unpackbits(view, bitorder="little")[first * bits - low * 8 :][: count * bits]
    return spread.reshape(count, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:/", "file:///", 1))


class TokenFile:
    """One file, opened for reading: its documents, and the ids of any range or document."""

    def __init__(self, uri: str):
        store, path = _store(uri)
        self.file = store.open_input_file(path)
        magic, self.bits, self.vocabulary, self.documents, self.ids, self.block_ids = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        n, blocks = self.documents, -(-self.ids // self.block_ids)
        data = self.file.read_at(25 * n + 8 * (blocks + 1), HEADER.size)
        self.doc_ids = np.frombuffer(data, "<i8", n)
        self.nulls = np.frombuffer(data, np.uint8, n, 8 * n)
        self.firsts = np.frombuffer(data, "<i8", n, 9 * n)
        self.counts = np.frombuffer(data, "<i8", n, 17 * n)
        self.offsets = np.frombuffer(data, "<i8", blocks + 1, 25 * n)
        self.base = HEADER.size + len(data)

    def read(self, first: int, count: int) -> np.ndarray:
        """Ids first to first + count - 1 of the file: only the blocks that hold them are read."""
        parts, end = [np.zeros(0, np.uint32)], first + count
        for block in range(first // self.block_ids, -(-end // self.block_ids) if count else 0):
            start = block * self.block_ids
            low, high = max(first, start) - start, min(end, start + self.block_ids) - start
            data = self.file.read_at(int(self.offsets[block + 1] - self.offsets[block]), self.base + int(self.offsets[block]))
            parts.append(unpack_ids(data, self.bits, low, high - low))
        return np.concatenate(parts)

    def document(self, row: int) -> np.ndarray:
        return self.read(int(self.firsts[row]), int(self.counts[row]))


class _Writer:
    """Collects packed blocks of one file (about the bytes of the file in memory) and writes it whole."""

    def __init__(self, vocabulary: int, block_ids: int):
        self.vocabulary, self.bits, self.block_ids = vocabulary, bits_for(vocabulary), block_ids
        self.doc_ids: list = []
        self.counts: list[int] = []
        self.blocks: list[bytes] = []
        self.open: list[np.ndarray] = []
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.open.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.open])
        whole = len(ids) if last else len(ids) - len(ids) % self.block_ids
        self.blocks += [pack_ids(ids[a : min(a + self.block_ids, whole)], self.bits) for a in range(0, whole, self.block_ids)]
        self.open, self.waiting = [ids[whole:]], len(ids) - whole

    def write(self, uri: str) -> None:
        self._flush(last=True)
        counts = np.array(self.counts, "<i8")
        firsts = (np.cumsum(counts) - counts).astype("<i8")
        offsets = np.cumsum([0, *map(len, self.blocks)]).astype("<i8")
        store, path = _store(uri)
        own = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            out.write(HEADER.pack(MAGIC, self.bits, self.vocabulary, len(counts), int(counts.sum()), self.block_ids))
            out.write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
            out.write(np.array([d is None for d in self.doc_ids], np.uint8).tobytes())
            out.write(firsts.tobytes() + counts.tobytes() + offsets.tobytes())
            for block in self.blocks:
                out.write(block)
        store.move(own, path)


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int | None = 2, block_ids: int = BLOCK_IDS
) -> DataFrame:
    """Writes the ids of every whole text (null: empty; end_id behind each) and returns the manifest, one row per file:

    file, part, n_docs, n_ids, start (ids of all files before). Documents are dealt by ranges of (doc_id, text hash, place in the input), so neither a
    repeated id nor rows that repeat whole fill one file, and sorted within; null ids come first. The manifest has no row for an empty table.
    """
    path = tokenizer or default_tokenizer()
    send_code(docs.sparkSession)
    rows = documents(docs).withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place").drop("tie", "place")
    store, at = _store(folder)
    store.create_dir(at)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        writer = _Writer(encode.vocabulary, block_ids)
        for batch in slices(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.encode_many(texts_of(batch))):
                writer.add(doc_id, ids if end_id is None else np.append(ids, np.uint32(end_id)))
        if writer.doc_ids:
            part = TaskContext.get().partitionId()
            file = f"{folder}/part-{part:06d}.tok"
            writer.write(file)
            yield pa.RecordBatch.from_pydict({"file": [file], "part": [part], "n_docs": [len(writer.doc_ids)], "n_ids": [sum(writer.counts)]})

    manifest = staged(rows.mapInArrow(write, "file string, part long, n_docs long, n_ids long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids) of every document, from the files.

    Files are read in ranges of about RANGE_IDS ids (one document at least), each by a task of its own. An empty manifest gives no rows.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, begin, end in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "begin", "end"))):
                file = TokenFile(name)
                for low in range(begin, end, 1000):
                    span = range(low, min(low + 1000, end))
                    first = int(file.firsts[low])
                    ids = file.read(first, int(file.firsts[span[-1]] + file.counts[span[-1]]) - first)
                    own = [ids[int(file.firsts[i]) - first :][: int(file.counts[i])] for i in span]
                    columns = [
                        pa.array(file.doc_ids[low : span[-1] + 1], mask=file.nulls[low : span[-1] + 1].astype(bool)),
                        pa.array(file.firsts[low : span[-1] + 1] + start), pa.array(file.counts[low : span[-1] + 1]),
                        pa.array([crc(x) for x in own], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in schema.split(", ")])

    send_code(manifest.sparkSession)
    step = F.greatest(F.lit(1), F.floor(F.lit(RANGE_IDS) * F.col("n_docs") / F.greatest("n_ids", F.lit(1)))).cast("long")
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, step)).alias("begin")
    ranges = manifest.select("file", "part", "start", "n_docs", step.alias("step"), begins)
    ranges = ranges.select("file", "part", "start", "begin", F.least(F.col("begin") + F.col("step"), "n_docs").alias("end"))
    # A number that is given isn't merged by adaptive execution: as many tasks as ranges.
    dealt = ranges.repartitionByRange(max(1, ranges.count()), "part", "begin")
    return dealt.select("file", "start", "begin", "end").mapInArrow(read, schema)


def token_folder(spark: SparkSession) -> str:
    return new_folder(spark, "tokens")
