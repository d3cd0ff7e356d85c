"""Best-two-fit packing of documents into token sequences of a fixed capacity.

Texts are encoded once, where they lie, into pieces of at most the capacity; only lengths and checksums travel. Pieces are dealt
by hash into blocks of bounded size and each block is packed by itself: a bin is filled greedily with the longest piece that
still fits; then its smallest piece is replaced by two unpacked ones if they fill the gap that it leaves more tightly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.shared import documents, send_code, staged
from cohortloom.llm.tokens import crc, default_tokenizer, encoder, slices, texts_of

CAPACITY, END_ID = 4096, 1
# Pieces packed together: about 1,500 bins of the usual mix, of which the last one or two stay partly empty.
BLOCK_PIECES = 10_000


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every document's pieces.

    A document is the ids of its whole text (null: empty) and end_id, so an empty one has one piece of one id. Only documents longer
    than the capacity are cut; their last piece may be shorter.
    """
    path = tokenizer or default_tokenizer()
    send_code(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    names = [part.split()[0] for part in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.encode_many(texts_of(batch))):
                ids = np.append(ids, np.uint32(end_id))
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(part), crc(part), *([part.astype(np.int32)] if keep_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return documents(docs).mapInArrow(cut, schema)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin number, offset) of each piece. Equal lengths are interchangeable and taken in the order given."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    taken_from = np.concatenate([[0], np.cumsum(counts)])[:-1]  # next unpacked piece of each length within `order`
    present = np.arange(capacity + 1)
    left = counts.copy()
    left[0] = 0
    # Largest length with unpacked pieces up to x.
    upto = np.maximum.accumulate(np.where(left > 0, present, 0))
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def refresh(length: int) -> None:
        """After the last piece of a length is taken, or the first put back."""
        nxt = length + 1
        while nxt <= capacity and not left[nxt]:
            nxt += 1
        upto[length:nxt] = length if left[length] else (upto[length - 1] if length else 0)

    def take(length: int) -> None:
        left[length] -= 1
        if not left[length]:
            refresh(length)

    number = 0
    while upto[capacity]:
        chosen, gap = [], capacity
        while gap and (length := int(upto[gap])):
            take(length)
            chosen.append(length)
            gap -= length
        if gap and upto[capacity] and len(chosen) > 1:
            smallest = chosen[-1]
            room = gap + smallest
            first = np.flatnonzero(left[: room // 2 + 1])
            if len(first):
                second = upto[room - first]
                second = np.where((second == first) & (left[first] < 2), upto[first - 1], second)
                sums = np.where(second > 0, first + second, 0)
                best = int(np.argmax(sums))
                if sums[best] > smallest:
                    left[smallest] += 1
                    if left[smallest] == 1:
                        refresh(smallest)
                    pair = (int(first[best]), int(second[best]))
                    take(pair[0])
                    take(pair[1])
                    chosen[-1:] = pair
        at = 0
        for length in chosen:
            row = order[taken_from[length]]
            taken_from[length] += 1
            bins[row], offsets[row] = number, at
            at += length
        number += 1
    return bins, offsets


def pack(rows: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """The rows of pieces() with sequence_id and offset (gapless from 0 in each sequence).

    Sequence ids are unique, not dense: block number times 2^32 plus bin number. A block's bins depend on its rows only (in the order of doc_id, piece,
    checksum), so a task that runs again gives the same. Repeated rows are pieces of their own: they are counted, and the copies dealt over all blocks.
    Empty input: empty result.
    """
    send_code(rows.sparkSession)
    blocks = rows.count() // block_pieces + 1
    counted = rows.groupBy("doc_id", "piece", "start", "length", "ids_crc32").agg(F.count("*").alias("copies"))
    rows = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "copy", F.lit("block")), F.lit(blocks)).cast("int"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def fill(block: pa.Table) -> pa.Table:
        block = block.sort_by([(name, "ascending") for name in ("doc_id", "piece", "ids_crc32")])
        bins, offsets = best_two_fit(block.column("length").to_numpy().astype(np.int64), capacity)
        ids = (block.column("block")[0].as_py() << 32) + bins
        return block.drop_columns(["block"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "block"]
    return rows.select(*columns).groupBy("block").applyInArrow(fill, schema)


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every document's pieces with their place, from whole texts: pieces() staged, then pack()."""
    return pack(staged(pieces(docs, tokenizer, capacity, end_id)), capacity)


def sequences(rows: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids (at most the capacity) of pack() rows joined with their pieces' ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
