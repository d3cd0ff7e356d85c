"""Sharding: rendezvous hashing of stable record keys over weighted shards. DataFrame functions only.

Every record scores each shard by a hash of (key, shard) and goes to the shard of its highest score. A shard that is
added takes the records it scores highest for and nothing else moves; one that leaves gives away only its own. With
weights, the score is -weight / ln(u), u being the hash as a number between 0 and 1, which gives each shard a share
in proportion to its weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.shared import documents, staged

# Rows that one task numbers at a time.
BLOCK_ROWS = 50_000


def rendezvous(key: Column, shards: int, weights: Sequence[float] | None = None) -> Column:
    """The shard (0 to shards - 1) of a key. Null keys are hashed like a value of their own.

    Ties of the score (never seen with 52 bits) go to the higher shard. A shard of weight 0 gets nothing; at least one
    weight must be above 0.
    """
    weights = [1.0] * shards if weights is None else [float(w) for w in weights]
    if shards < 1 or len(weights) != shards or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("one weight of 0 or more for each shard, and one above 0")
    bits = 1 << 52
    text = F.coalesce(key.cast("string"), F.lit("\x00"))

    def score(shard: int) -> Column:
        drawn = F.pmod(F.xxhash64(text, F.lit(shard)), F.lit(bits))
        return F.struct((F.lit(weights[shard]) / -F.log((drawn + F.lit(0.5)) / F.lit(float(bits)))).alias("score"), F.lit(shard).alias("shard"))

    return F.greatest(*(score(s) for s in range(shards) if weights[s] > 0))["shard"] if sum(w > 0 for w in weights) > 1 else F.lit(
        next(s for s in range(shards) if weights[s] > 0))


def shard(
    docs: DataFrame, shards: int, weights: Sequence[float] | None = None, grown_weight: float = 1.0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """All documents with their shard, a gapless slot in it, and the shard they would have with one shard more.

    Returns doc_id, size (UTF-8 bytes of the text plus 16; null text: 16), text_crc32, shard, slot, grown_shard. The
    shard depends on doc_id and the weights only: repeated rows and null ids stay together, each row keeps a slot
    of its own. Slots are numbered block by block, a block being a hash bucket of (doc_id, text) of bounded size, so
    neither a large shard nor a repeated id meets in one task; within a block order is doc_id, then checksum, then size.
    An empty table gives an empty result. Columns besides doc_id and text are ignored.
    """
    grown = [*([1.0] * shards if weights is None else weights), grown_weight]
    rows = documents(docs)
    data = F.encode("text", "utf-8")
    rows = staged(
        rows.select(
            "doc_id", (F.octet_length("text") + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
            rendezvous(F.col("doc_id"), shards, weights).alias("shard"), rendezvous(F.col("doc_id"), shards + 1, grown).alias("grown_shard"),
        )
    )
    blocks = rows.count() // (shards * block_rows) + 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit("block")), F.lit(blocks)).cast("int"))
    sums = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = sums.select(
        "shard", "block", F.expr("sum(n) OVER (PARTITION BY shard ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n").alias("before")
    )
    number = F.expr("row_number() OVER (PARTITION BY shard, block ORDER BY doc_id, text_crc32, size) - 1")
    return (
        rows.withColumn("number", number).join(before, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("number")).cast("long").alias("slot"), "grown_shard")
    )
