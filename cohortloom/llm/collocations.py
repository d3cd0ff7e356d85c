"""Collocations of a corpus: phrases that occur together more often than their parts would let one expect.

Every task cuts its texts into shards of some megabytes and builds a bidirectional FM-index over the word ids of each shard and language;
extending intervals lists a shard's phrases with their counts. They are handed on in packets, one row for all phrases of a shard that
fall into the same bucket by their hash, and summed across shards packet by packet. A phrase comes once from a shard at most, however frequent
it is, so packets are of even size; their number follows from the size of the corpus.

Counts are exact: nothing is sampled or cut off, and sums and scores are computed in integers and decimals.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.fm_index import FmIndex
from cohortloom.llm.shared import send_code, staged

LEAST, LONGEST, PERCENT, TOP = 10, 3, 50, 2000
# UTF-8 bytes of text in a shard (and the rest of the text that fills it), and of text whose phrases make a packet; the least number of packets.
SHARD_BYTES, PACKET_BYTES, LEAST_PACKETS = 8_000_000, 4_000_000, 256
# Parts into which a language's phrases are dealt before the best are taken from the best of all parts.
PARTS = 256
SEPARATORS = ".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans((string.ascii_uppercase + SEPARATORS + "\t").encode(), (string.ascii_lowercase + "\n" * len(SEPARATORS) + " ").encode())


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Ids of all words, 0 between pieces and at both ends, and the words of ids 1, 2, ... in byte order.

    No text and no byte of a text is looked at by itself: words are found and numbered as arrays.
    """
    raw = np.frombuffer(b"\n".join(texts).translate(_TABLE), np.uint8)
    ends_piece = raw == 10
    inside = ~(ends_piece | (raw == 32))
    edges = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(1, len(order) + 1)
    piece = np.cumsum(ends_piece)[starts]
    places = np.arange(1, len(starts) + 1) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
    text = np.zeros(len(starts) + 2 + (int(places[-1]) - len(starts) if len(starts) else 0), np.int64)
    text[places] = number[coded.indices.to_numpy()]
    return text, coded.dictionary.take(pa.array(order))


def _hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word (two CRCs), the same in every shard."""
    return np.array([zlib.crc32(w) << 32 | zlib.crc32(w, 1) for w in words.to_pylist()], np.uint64)


def _packets(words: pa.Array, hashes: np.ndarray, ids: np.ndarray, count: np.ndarray, number: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(packet, phrases divided by line ends, counts) of a shard's phrases; words hold neither blanks nor line ends."""
    mixed = np.zeros(len(ids), np.uint64)
    for k in range(ids.shape[1]):
        mixed = (mixed + hashes[ids[:, k] - 1]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    packet = (mixed >> np.uint64(16)) % np.uint64(number)
    order = np.argsort(packet, kind="stable")
    ids, count, packet = ids[order], count[order].astype("<i8"), packet[order]
    columns = [words.take(pa.array(ids[:, k] - 1)) for k in range(ids.shape[1])]
    joined = columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary()))
    lines = pc.binary_join_element_wise(joined, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    _, offsets, data = lines.buffers()
    offsets, data = np.frombuffer(offsets, np.int64)[: len(ids) + 1], memoryview(data)
    cuts = np.flatnonzero(np.diff(packet, prepend=packet[:1] + np.uint64(1), append=packet[-1:] + np.uint64(1)))
    for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(packet[start]), bytes(data[offsets[start] : offsets[end]]), count[start:end].tobytes()


def _shard_rows(texts: dict[str, list[bytes]], longest: int, number: int) -> Iterator[pa.RecordBatch]:
    for lang, own in texts.items():
        text, words = word_ids(own)
        if not len(words):
            continue
        index, hashes = FmIndex(text, max(longest, 2)), _hashes(words)
        found = index.single_words()
        for size in range(1, longest + 1):
            if size > 1:
                found = index.right(found)
            if len(found.count):
                rows = list(zip(*_packets(words, hashes, found.words, found.count, number)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int64()), pa.repeat(pa.scalar(lang), len(rows[0])), pa.repeat(pa.scalar(size, pa.int32()), len(rows[0])), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())],
                    ["packet", "lang", "size", "phrases", "counts"])


def _lines(blobs: list[bytes]) -> pa.Array:
    """The lines of all blobs, each of which ends with a line end."""
    raw = np.frombuffer(b"".join(blobs), np.uint8)
    ends = np.flatnonzero(raw == 10)
    offsets = np.zeros(len(ends) + 1, np.int64)
    offsets[1:] = ends - np.arange(len(ends))
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw[raw != 10])])


def frequent(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text: str = "text", lang: str = "lang", shard_bytes: int = SHARD_BYTES, packet_bytes: int = PACKET_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of every phrase of up to `longest` words that occurs `least` times or more in its language; and (lang, n): all words.

    A null lang is `und`, a null text is empty.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text")).where("text IS NOT NULL AND octet_length(text) > 0")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(LEAST_PACKETS, -(-size // packet_bytes))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = {}, 0
        for batch in batches:
            for one_lang, one in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = one.as_buffer().to_pybytes()
                texts.setdefault(one_lang, []).append(one)
                held += len(one) + 1
                if held >= shard_bytes:
                    yield from _shard_rows(texts, longest, number)
                    texts, held = {}, 0
        yield from _shard_rows(texts, longest, number)

    def summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, counts = [], []
        for batch in batches:
            phrases += batch.column("phrases").to_pylist()
            counts += batch.column("counts").to_pylist()
        table = pa.table({"phrase": _lines(phrases), "n": np.frombuffer(b"".join(counts), "<i8")}).group_by("phrase").aggregate([("n", "sum")])
        one_lang, words = key[1].as_py(), key[2].as_py()
        total = pc.sum(table["n_sum"]).as_py() if words == 1 else 0
        table = table.filter(pc.greater_equal(table["n_sum"], least))
        found = [*table["phrase"].cast(pa.large_string()).to_pylist(), ""]  # the line without a phrase has the number of all words
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(one_lang), len(found)), pa.array(found, pa.string()), pa.repeat(pa.scalar(words, pa.int32()), len(found)), pa.array([*table["n_sum"].to_pylist(), total], pa.int64())],
            ["lang", "phrase", "size", "n"])

    send_code(docs.sparkSession)
    packets = rows.mapInArrow(shards, "packet long, lang string, size int, phrases binary, counts binary")
    found = staged(packets.groupBy("packet", "lang", "size").applyInArrow(summed, "lang string, phrase string, size int, n long"))
    return found.where("phrase <> ''"), found.where("phrase = '' AND size = 1").groupBy("lang").agg(F.sum("n").alias("n"))


def _parts_of(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, score of each phrase of two words or more: its lowest cut, floor(1,000,000 a a / (l r)); ties go to the first cut."""
    words = F.split("phrase", " ")
    cut = F.struct(F.col("k"), _parts_of(words, F.lit(1), F.col("k")).alias("first"), _parts_of(words, F.col("k") + 1, F.col("size")).alias("rest"))
    cuts = found.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", cut.alias("cut")).select("lang", "phrase", "size", "a", "cut.*")
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(found.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    cuts = cuts.withColumn("above", F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a"))).withColumn("below", wide("l") * wide("r"))
    lowest = F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("low")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(lowest).select("lang", "phrase", "size", "a", "low.l", "low.r", "low.score")


def _not_within_longer(rows: DataFrame, percent: int) -> DataFrame:
    """Without the phrases that some longer one holds in at least so many percent of its occurrences."""
    words = F.split("phrase", " ")
    longer = rows.where("size > 2").select("lang", "size", "phrase", "a", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("part"))
    longer = longer.select("lang", "phrase", "a", "part", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("part") + 1)).alias("start"))
    within = longer.select("lang", _parts_of(words, F.col("start"), F.col("part")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    joined = rows.join(within, ["lang", "phrase"], "left")
    return joined.where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a"))).drop("most")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, percent: int = PERCENT, top: int = TOP, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language by score, then count, then phrase (bytes).

    Nulls: lang is `und`, text is empty. Repeated rows count as often as they stand there. No texts or no phrase that is frequent enough: an empty result.
    Extra columns are ignored. Counts must stay below 10^16.
    """
    found, totals = frequent(docs, longest, least, **options)
    rows = _not_within_longer(staged(scored(found)), percent)
    best = "ORDER BY score DESC, a DESC, phrase"
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    rows = rows.withColumn("place", F.expr(f"row_number() OVER (PARTITION BY lang, part {best})")).where(F.col("place") <= top)
    rows = rows.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {best})").cast("long")).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _sql() -> str:
    grams = ",\n".join(
        f"g{k} AS (SELECT lang, unnest([array_to_string(ws[i : i + {k - 1}], ' ') FOR i IN range(1, len(ws) - {k - 2})]) AS phrase, {k} AS size FROM pieces WHERE len(ws) >= {k})" for k in range(1, LONGEST + 1))
    cut = lambda k: f"""SELECT c.lang, c.phrase, c.size, c.n AS a, {k} AS k, l.n AS l, r.n AS r, 1000000 * CAST(c.n AS HUGEINT) * c.n // (CAST(l.n AS HUGEINT) * r.n) AS score
    FROM found c JOIN found l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[1:{k}], ' ')
    JOIN found r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[{k + 1}:], ' ') WHERE c.size > {k}"""  # noqa: E731
    return f"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
{grams},
totals AS (SELECT lang, count(*) AS n FROM g1 GROUP BY lang),
found AS (SELECT lang, phrase, size, count(*) AS n FROM ({' UNION ALL '.join(f'SELECT * FROM g{k}' for k in range(1, LONGEST + 1))}) GROUP BY lang, phrase, size HAVING count(*) >= {LEAST}),
cuts AS ({' UNION ALL '.join(map(cut, range(1, LONGEST)))}),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
within AS (
  SELECT lang, part, max(n) AS most FROM (
    SELECT lang, n, unnest([array_to_string(string_split(phrase, ' ')[i : i + 1], ' ') FOR i IN range(1, {LONGEST})]) AS part FROM found WHERE size = {LONGEST}) GROUP BY lang, part),
kept AS (SELECT l.* FROM lowest l LEFT JOIN within w ON w.lang = l.lang AND w.part = l.phrase WHERE w.most IS NULL OR 100 * w.most < {PERCENT} * l.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""


SQL = _sql()
