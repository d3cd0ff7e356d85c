"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables, reranked with the original vectors.

Rotations are learned on a bounded sample so that the signs of the rotated coordinates lie close to the vectors (iterative quantisation);
each bit is cut at its median, so ones and zeros are balanced. A vector becomes a code of WIDTH bits. Each table takes some of the code's
bits, and vectors that share them meet; of these only pairs within a Hamming radius go on, and only their vectors are fetched and compared.
Radius and number of tables follow from the Hamming distances of sampled vectors to partners made at the least similarity (closer pairs
are found almost surely). Codes and keys travel, vectors only where a pair is left.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.components import components
from cohortloom.llm.shared import send_code, staged

SIMILARITY, RECALL = 0.95, 0.995
# Vectors the rotations are learned on at most (about; drawn by hash), and rounds of learning.
SAMPLE, ROUNDS = 20_000, 30
# Members of a bucket that are compared with one another at a time.
BLOCK = 512
# Bits of a code, and sampled vectors from which distances of linked pairs are measured.
WIDTH, MEASURED = 256, 2_000


def learn_rotations(vectors: np.ndarray, count: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """dims x (count * dims): rotations side by side, each from another random start, learned on vectors less their mean."""
    dims = vectors.shape[1]
    rng = np.random.default_rng(seed)
    centred = vectors - vectors.mean(axis=0) if len(vectors) else vectors
    found = []
    for _ in range(count):
        rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        for _ in range(rounds if len(vectors) else 0):
            signs = np.where(centred @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ centred)
            rotation = (left @ right).T
        found.append(rotation)
    return np.concatenate(found, axis=1)


def table_plan(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a table, tables) for bits that differ with probability arccos(similarity) / pi: bits grow with the logarithm of n, so unlike vectors rarely meet."""
    bits = max(8, math.ceil(math.log2(max(n, 2))) + 2)
    hit = (1 - math.acos(similarity) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def _tables(apart: list[np.ndarray], bits: int, recall: float, least: int) -> int:
    """The fewest tables, `least` or more, of `bits` bits drawn from a code that find pairs at these Hamming distances with the recall."""
    hits = [np.prod([(WIDTH - distances - i).clip(0) / (WIDTH - i) for i in range(bits)], axis=0) for distances in apart]

    def enough(tables: int) -> bool:
        return all(np.mean(1 - (1 - hit) ** tables) >= recall for hit in hits)

    high = least
    while not enough(high) and high < 1 << 20:
        high *= 2
    low = least if high == least else high // 2
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle + 1, high)
    return high


class Codes:
    """How vectors become codes and codes the keys of tables, and how far apart the codes of linked vectors lie."""

    def __init__(self, sample: np.ndarray, n: int, similarity: float, recall: float) -> None:
        dims = sample.shape[1]
        rng = np.random.default_rng(11)
        rotations = learn_rotations(sample, math.ceil(WIDTH / dims))
        self.rotation = rotations[:, rng.permutation(rotations.shape[1])[:WIDTH]]
        self.cut = np.median(sample @ self.rotation, axis=0) if len(sample) else np.zeros(WIDTH)
        bits, planned = table_plan(n, similarity, recall)
        apart = self._distances(sample[rng.permutation(len(sample))[:MEASURED]], similarity, rng)
        self.radius = int(max((d.max() for d in apart), default=WIDTH))
        # Where linked codes lie far apart (vectors in a narrow cone), tables of fewer bits find them; the radius sifts the larger buckets.
        while (tables := _tables(apart, bits, recall, planned)) > 4 * planned and bits > 8:
            bits -= 1
        tables = min(tables, 1 << 16)  # reached only where distances pass WIDTH - 8
        self.tables = tables
        # Column t holds the powers of two of the bits that table t takes.
        self.places = np.zeros((WIDTH, tables))
        for t in range(tables):
            self.places[rng.permutation(WIDTH)[:bits], t] = 2.0 ** np.arange(bits)

    def _distances(self, some: np.ndarray, similarity: float, rng: np.random.Generator) -> list[np.ndarray]:
        """Hamming distances of vectors to partners at the least similarity: in random directions, and towards other vectors."""
        found = []
        for ways in (rng.standard_normal(some.shape), some[rng.permutation(len(some))]) if len(some) else ():
            ways = ways - (ways * some).sum(axis=1, keepdims=True) * some
            norm = np.linalg.norm(ways, axis=1, keepdims=True)
            ways = np.where(norm > 1e-9, ways / np.maximum(norm, 1e-9), 0)
            partners = similarity * some + math.sqrt(1 - similarity**2) * ways
            found.append(hamming(self.words(self.of(some)), self.words(self.of(partners / np.linalg.norm(partners, axis=1, keepdims=True)))))
        return found

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits(vectors @ self.rotation > self.cut, axis=1)

    @staticmethod
    def words(codes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(codes).view(np.uint64)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """One key for each table (exact: below 2 ** 53)."""
        return (np.unpackbits(codes, axis=1).astype(np.float64) @ self.places).astype(np.int64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _prepared(vectors: DataFrame, key: str, embedding: str, columns: str, make: Callable[[list[bytes]], list]) -> DataFrame:
    """vec_id, print (128-bit digest; null where the vector can't be compared) and what `make` makes of the vectors (little-endian doubles)."""
    names = columns.split(" ")[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            values = pc.fill_null(lists.flatten(), np.nan).to_numpy(zero_copy_only=False).astype("<f8") + 0.0
            ends = np.cumsum(sizes)
            raws = []
            for end, size in zip(ends.tolist(), sizes.tolist()):
                one = values[end - size : end]
                filled = np.flatnonzero(one)
                raws.append(one[: filled[-1] + 1].tobytes() if len(filled) and np.isfinite(one).all() else None)
            prints = [None if raw is None else hashlib.blake2b(raw, digest_size=16).digest() for raw in raws]
            made = iter(make([raw for raw in raws if raw is not None]))
            rest = pa.array([None if raw is None else next(made) for raw in raws], out_type)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(prints, pa.binary()), rest], ["vec_id", "print", names])

    out_type = pa.binary() if columns.endswith("binary") else pa.int64()
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    return rows.mapInArrow(read, f"vec_id long, print binary, {columns}")


def _matrix(raws: list[bytes], dims: int) -> np.ndarray:
    """Unit vectors in double precision, shorter ones filled with zeros."""
    out = np.zeros((len(raws), dims))
    for i, raw in enumerate(raws):
        values = np.frombuffer(raw, "<f8")
        out[i, : len(values)] = values
    out /= np.abs(out).max(axis=1, keepdims=True) if len(out) else 1
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _bytes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


_GROUP = ["number", "key", "low", "high"]


def _members(coded: DataFrame, codes: Codes, block: int) -> DataFrame:
    """Each node once for each table and pair of blocks in which it meets others: print, node, copies, code, own block and the group."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = codes.keys(_bytes(batch.column("code"), WIDTH // 8))
                lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, codes.tables, dtype=np.int32), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("print"), lists], ["print", "keys"])

    members = coded.select("print", "code").mapInArrow(keys, "print binary, keys array<long>").select("print", F.posexplode("keys").alias("number", "key"))
    sizes = members.groupBy("number", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = members.join(sizes, ["number", "key"]).select("print", "number", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    members = members.withColumn("own", F.pmod(F.xxhash64("print", F.lit("block")), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("print", "number", "key", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    return members.join(coded, "print")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are sorted by group, cut only between groups."""
    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        edges = _edges(part)
        yield part.slice(0, edges[-1])
        rest = part.slice(edges[-1])
    if rest is not None:
        yield rest


def _edges(part: pa.Table) -> np.ndarray:
    """Where the groups of a table begin."""
    columns = [np.array(part.column(name)) for name in _GROUP]
    new = np.any([c[1:] != c[:-1] for c in columns], axis=0) if part.num_rows > 1 else np.zeros(0, bool)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _close(part: pa.Table, codes: Codes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row numbers, a few at a time) of one group within the Hamming radius that share no earlier table."""
    starts = _edges(part)
    sizes = np.diff([*starts, part.num_rows])
    ends = np.repeat(starts + sizes, sizes)
    own, number = np.array(part.column("own")), np.array(part.column("number"))
    within = np.array(part.column("low")) == np.array(part.column("high"))
    packed = _bytes(part.column("code"), WIDTH // 8)
    words, keys = codes.words(packed), None
    i = np.arange(part.num_rows)
    for step in range(1, int(sizes.max(initial=0))):
        i = i[i + step < ends[i]]
        a = i[within[i] | (own[i] != own[i + step])]
        a = a[hamming(words[a], words[a + step]) <= codes.radius]
        if len(a):
            keys = codes.keys(packed) if keys is None else keys
            shared = (keys[a] == keys[a + step]) & (np.arange(codes.tables) < number[a, None])
            a = a[~shared.any(axis=1)]
            yield a, a + step


def _left(blocks: DataFrame, codes: Codes) -> DataFrame:
    """Members of a group that have a partner within the radius there."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(b for b in batches if b.num_rows):
            near = np.zeros(part.num_rows, bool)
            for i, j in _close(part, codes):
                near[i] = near[j] = True
            yield from part.filter(pa.array(near)).to_batches()

    return blocks.mapInArrow(look, blocks.schema)


def _linked(blocks: DataFrame, codes: Codes, dims: int, similarity: float) -> DataFrame:
    """print, node, links (rows linked in this group), root (a node of the same linked set)."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(b for b in batches if b.num_rows):
            vectors, size = _matrix(part.column("vec").to_pylist(), dims), part.num_rows
            node, copies = np.array(part.column("node")), np.array(part.column("copies"))
            links, roots, pairs = np.zeros(size, np.int64), np.arange(size), []
            for i, j in _close(part, codes):
                same = np.einsum("ij,ij->i", vectors[i], vectors[j]) >= similarity
                i, j = i[same], j[same]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                pairs.append((i.astype(np.int32), j.astype(np.int32)))
            if not links.any():
                continue
            i, j = (np.concatenate(side) for side in zip(*pairs))
            while True:
                new = roots.copy()
                np.minimum.at(new, i, roots[j])
                np.minimum.at(new, j, roots[i])
                if (new == roots).all():
                    break
                roots = new
            seen = pa.array(links > 0)
            out = part.select(["print", "node"]).append_column("links", pa.array(links)).append_column("root", pa.array(node[roots]))
            yield from out.filter(seen).to_batches()

    return blocks.mapInArrow(compare, "print binary, node long, links long, root long")


def _in_groups(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP)


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", similarity: float = SIMILARITY, recall: float = RECALL,
    sample: int = SAMPLE, block: int = BLOCK,
) -> DataFrame:
    """One row per vector: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept.

    Two vectors link when their cosine in double precision is at least `similarity`. Null or empty vectors, and those with a null or
    non-finite component or of length zero, link with nothing and are components of their own. Vectors of unlike lengths are compared as if the shorter went on
    with zeros. Equal vectors are always linked and looked up once. Rows that repeat a vec_id link by the values each of them has. A null vec_id gives
    n_links, no component and kept = false. Empty table: empty result. Other columns are ignored.

    Buckets are cut into blocks of bounded size by hash and compared block by block, so no bucket meets in one task; pairs never leave a task,
    only each member's number of links and its root do. A pair is looked at in the first table that shows it.
    """
    send_code(vectors.sparkSession)
    rows = staged(_prepared(vectors, key, embedding, "width long", lambda raws: [len(raw) // 8 for raw in raws]))
    named = rows.where("print IS NOT NULL AND vec_id IS NOT NULL")
    n, dims = named.agg(F.count_distinct("print"), F.max("width")).first()
    nodes = rows.where("print IS NOT NULL").groupBy("print").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    if n:
        whole = _prepared(vectors, key, embedding, "vec binary", lambda raws: raws).where("print IS NOT NULL AND vec_id IS NOT NULL").select("print", "vec")
        cut = min(1.0, sample / n)
        drawn = whole.where(F.pmod(F.xxhash64("print"), F.lit(1 << 30)) < F.lit(int(cut * (1 << 30)))).groupBy("print").agg(F.first("vec").alias("vec")).collect()
        drawn = [bytes(r.vec) for r in sorted(drawn, key=lambda r: bytes(r.print))]
        codes = Codes(_matrix(drawn, dims), n, similarity, recall)
        coded = _prepared(vectors, key, embedding, "code binary", lambda raws: [c.tobytes() for c in codes.of(_matrix(raws, dims))]).where("print IS NOT NULL")
        nodes = staged(coded.groupBy("print").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("code").alias("code")))
        left = staged(_left(_in_groups(_members(nodes.where("node IS NOT NULL"), codes, block)), codes))
        fetched = whole.join(left.select("print").distinct(), "print", "left_semi").groupBy("print").agg(F.first("vec").alias("vec"))
        found = staged(_linked(_in_groups(left.join(fetched, "print")), codes, dims, similarity))
        linked = found.groupBy("print").agg(F.sum("links").alias("links"))
        labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        nodes = nodes.drop("code").join(linked, "print", "left").join(labels, "node", "left")
    else:
        nodes = nodes.withColumn("links", F.lit(0).cast("long")).withColumn("component", F.lit(None).cast("long"))
    nodes = nodes.select("print", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    out = rows.drop("width").join(nodes, "print", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
