"""Near-duplicate documents: BagMinHash bands find candidates, the multiset overlap of their five-word shingles decides.

Bands put alike documents into common buckets. A bucket isn't turned into all its pairs: in each round a few of its members (pivots) are
compared with the members that no link ties to them yet (by the first bucket two documents share), and leave the bucket; members that are already in one class needn't be
compared any more, so a bucket of near copies is done after a round or two, and a bucket of unlike documents shrinks
by ever more pivots a round. The rounds end when no bucket holds two classes: then every pair of a bucket has been compared or is
tied by links.

Pairs that can't be similar enough are left out before their texts are fetched: by size, and by a sketch of 1,024 bits, each the parity of
the number of shingles in one part of the hash space. Each shingle that two bags don't share changes one bit, so the bits that
differ are never more than the bags' difference: an exact bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import bag_minhash
from cohortloom.llm.components import components
from cohortloom.llm.shared import documents, gathered, new_folder, release, send_code, staged
from cohortloom.llm.shingles import bags, similarity
from cohortloom.llm.tokens import slices, texts_of

# A pair of similarity 0.8 shares at least one of 20 bands of 5 rows with probability 0.9996, one of 0.3 with 0.05.
LEAST, BANDS, ROWS = 0.8, 20, 5
# Pivots of a bucket grow by this factor each round.
GROWTH = 32
# 64-bit words of a bag's parity sketch.
SKETCH = 16
# Members of buckets (some 400 bytes) of one task, about, and labels or pivots' keys that are broadcast at most (under 1 MB).
TASK_MEMBERS, BROADCAST_ROWS = 10_000, 20_000


_WORDS = tuple(f"s{i}" for i in range(SKETCH))


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles (0: no words), print (128-bit digest of the bag), keys (one for each band), sketch of every whole text."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, prints, keys, sketches = [], [], [], []
            for elements, weights in bags(texts_of(batch)):
                odd = elements[weights % 2 == 1] % np.uint64(64 * SKETCH)
                bits = np.bincount(odd.astype(np.int64), minlength=64 * SKETCH) % 2
                sketches.append(np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8"))
                sizes.append(int(weights.sum()))
                prints.append(hashlib.blake2b(elements.tobytes() + weights.astype("<i8").tobytes(), digest_size=16).digest())
                keys.append(bag_minhash.bands(bag_minhash.signature(elements, weights, bands * rows), rows))
            lists = (
                pa.ListArray.from_arrays(np.arange(0, len(rows) * width + 1, width, dtype=np.int32), pa.array(np.concatenate(rows)))
                for rows, width in ((keys, bands), (sketches, SKETCH))
            )
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "print", "keys", "sketch"])

    return documents(docs).mapInArrow(sign, "doc_id long, n_shingles long, print binary, keys array<long>, sketch array<long>")


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b) of the pairs whose texts' bags overlap by `least` or more, once for each two texts. texts: node, text."""
    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")), "b")
    both = right.join(texts.select(F.col("node").alias("a"), "text"), "a").select("a", "text", "b", "other")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[str, tuple] | None = None
        for batch in slices(batches, "other"):
            kept = []
            others = bags(texts_of(batch, "other"))
            for i, bag in enumerate(others):
                text = batch.column("text")[i].as_py()
                if known is None or known[0] != text:
                    known = (text, bags([text])[0])
                if similarity(known[1], bag) >= least:
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int32())) for c in ("a", "b")], ["a", "b"])

    return both.mapInArrow(compare, "a long, b long")


def _small(rows: DataFrame, n: int) -> DataFrame:
    """n rows, broadcast if these are few."""
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def _links(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(node, component) of the members (band, key, node, size, sketch words) of all buckets, by the rounds described above."""
    labels, pivots_each, number, tasks = None, 1, 0, None
    while True:
        if labels is not None:
            members = members.drop("label").join(_small(labels, labels.count()), "node", "left").select(
                "band", "key", "node", "size", "keys", *_WORDS, F.coalesce("component", "node").alias("label"))
        else:
            members = members.withColumn("label", F.col("node"))
        mixed = members.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        members = members.join(mixed.select("band", "key"), ["band", "key"], "left_semi")
        # No round has more members than the one before.
        members, n, tasks = gathered(staged(members.coalesce(tasks) if tasks else members), TASK_MEMBERS)
        if not n:
            return labels if labels is not None else members.select("node", F.col("label").alias("component"))
        slot = F.pmod(F.xxhash64("node", F.lit(number)), F.lit(pivots_each))
        pivots = members.groupBy("band", "key", slot.alias("slot")).agg(F.min(F.struct("node", "size", "label", "keys", *_WORDS)).alias("p"))
        pivots = staged(pivots.select("band", "key", "p.*").coalesce(tasks))
        p = pivots.select("band", "key", F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("label").alias("a_label"), F.col("keys").alias("a_keys"), *(F.col(w).alias(f"a_{w}") for w in _WORDS))
        near = F.least("size", "a_size") >= F.lit(least - 1e-9) * F.greatest("size", "a_size")
        differing = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"a_{w}"))) for w in _WORDS), F.lit(0))
        near = near & (differing <= F.lit((1 - least) / (1 + least) + 1e-9) * (F.col("size") + F.col("a_size")))
        # The first band that two documents share is in charge of them: keys differ between bands, so earlier ones must have none in common.
        first = ~F.arrays_overlap(F.slice("keys", 1, F.col("band")), F.slice("a_keys", 1, F.col("band")))
        pairs = members.join(p, ["band", "key"]).where((F.col("label") != F.col("a_label")) & near & first)
        pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        links = verified(pairs, texts, least)
        if labels is not None:  # they stand for all links so far
            links = links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        labels = components(links)
        members = members.join(_small(pivots.select("band", "key", "node"), pivots.count()), ["band", "key", "node"], "left_anti")
        pivots_each, number = pivots_each * GROWTH, number + 1
        release(members.sparkSession)


def near_classes(docs: DataFrame, least: float = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), kept (doc_id = class_id), n_shingles.

    Documents link when the bags of their five-word shingles (see shingles) have a Jaccard similarity of `least` or more; a class is what
    links connect. Texts of equal bags are always in one class and looked up once. A text without words (null, empty, punctuation only) is
    near to nothing. Rows that share a doc_id are one document: their texts' links are its links. A null doc_id gives no class and
    kept = true, as nothing may be dropped for it. Whole texts count; very long ones too. Empty table: empty result.
    """
    spark = docs.sparkSession
    send_code(spark)
    signed = staged(signatures(docs, bands, rows))
    named = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    bag = named.groupBy("print").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("n_shingles").alias("size"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    bag = staged(bag)
    # Only (node, band, key) of all documents is shuffled; size and sketch join those that share a bucket.
    places = bag.select("node", F.posexplode("keys").alias("band", "key"))
    several = places.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    places = places.join(several, ["band", "key"], "left_semi")
    sketches = bag.select("node", "size", "keys", *(F.col("sketch")[i].alias(w) for i, w in enumerate(_WORDS)))
    members = staged(places.join(sketches, "node").select("band", "key", "node", "size", "keys", *_WORDS))
    folder = new_folder(spark, "texts")
    candidates = members.select(F.col("node").alias("doc_id")).distinct()
    documents(docs).join(candidates, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text").write.parquet(folder)
    release(spark)
    labels = _links(members, spark.read.parquet(folder), least)
    # Ties of equal bags: a document may have several rows and so several bags, which its id ties together.
    ties = named.select("doc_id", "print").join(bag.select("print", "node"), "print").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(ties)
    classes = components(links)
    return signed.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("class_id"),
        (F.col("doc_id").isNull() | F.col("component").isNull() | (F.col("component") == F.col("doc_id"))).alias("kept"), "n_shingles",
    )


def without_near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their class."""
    gone = near_classes(docs, least).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    own = {c: f"d_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*own.values())
    rows = rows.join(gone, F.col(own["doc_id"]).cast("long") == F.col("gone"), "left_anti")
    return rows.select(*(F.col(new).alias(old) for old, new in own.items()))
