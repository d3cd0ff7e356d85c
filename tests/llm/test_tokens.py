"""Token files, counts and packing against the tokenizer itself."""

import sys
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import TOKENIZER, crc_of, ids_of, piece_rows, token_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortloom.llm import packing, queries, token_counts, token_files, tokens
from cohortloom.llm.shared import new_folder, staged

ENCODER = tokens.WordEncoder(tokens.default_tokenizer())
ODD = [
    "á éx", "x\xa0y z", "\x1c a\x1db", "<|endoftext|> b<|startoftext|>c", "<|STARTOFTEXT|>, Foo. FOO, foo", "Σ ΑΣ Σ.", "😀 a😀b", "it's don't 'll It'S, a.b.", "̈́ x",
    "ﬁ ǅ İstanbul", "1234 5a6", "", "  ", "​ ﻿ a", "e ́ ́", "한글 ㄱ", "a,, b., c.d, .", "Été, ÉTÉ. été",
]


@given(st.one_of(st.sampled_from(ODD), st.text(max_size=40), st.text(alphabet="aB.,' <|>́\n", max_size=30)))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_tokenizers(text):
    assert ENCODER.encode(text).tolist() == ids_of(text)


def test_stops_behind_letters_that_end_in_a_mark():
    """NFC and lower-casing turn these letters into ones that end in a combining mark, which is one piece with the stop."""
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha() and not unicodedata.normalize("NFC", c).lower()[-1].isalpha()]
    assert len(letters) >= 60 and "\u0130" in letters and "\u09df" in letters
    units = [f"{before}{c}{stop}" for c in letters for before in ("a", "\u09b9", "") for stop in (",", ".")]
    got = ENCODER.encode_many(units)
    assert [u for u, ids in zip(units, got) if ids.tolist() != ids_of(u)] == []


def test_ids_after_the_memory_is_cleared(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    encoder = tokens.WordEncoder(tokens.default_tokenizer())
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode_many(ODD)] == [ids_of(t) for t in ODD]


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=200), st.data())
@settings(max_examples=100, deadline=None)
def test_packed_ids_come_back(bits, ids, data):
    ids = np.array(ids, np.uint32) >> np.uint32(32 - bits)
    packed = token_files.pack_ids(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    first = data.draw(st.integers(0, len(ids)))
    count = data.draw(st.integers(0, len(ids) - first))
    assert token_files.unpack_ids(packed, bits, first, count).tolist() == ids[first : first + count].tolist()


def test_least_bits():
    assert [token_files.bits_for(n) for n in (1, 2, 3, 256, 257, 49_408, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_token_files_of_whole_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.op1_token_files(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == token_rows(docs)


def test_token_files_of_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    folder = new_folder(spark, "test")
    manifest = token_files.write_tokens(odd_docs, folder, block_ids=1000)
    rows = sorted(token_files.read_tokens(manifest, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in odd_docs.collect()), key=lambda i: (i is not None, i))
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    assert all(r.ids_crc32 == crc_of(r.ids) and len(r.ids) == r.n_tokens for r in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter((r.doc_id, (*ids_of(r.text), 2)) for r in odd_docs.collect())
    file = token_files.TokenFile(manifest.first().file)  # any document by itself
    for i in range(file.documents):
        assert file.document(i).tolist()[-1] == 2 and len(file.document(i)) == file.counts[i]
    assert token_files.read_tokens(token_files.write_tokens(no_docs, new_folder(spark, "test"))).collect() == []


def plain_table(lengths):
    return {
        n: (sum(x == n for x in lengths), sum(x <= n for x in lengths), sum(x for x in lengths if x <= n), sum(min(x, n) for x in lengths)) for n in set(lengths)
    }


def test_files_are_read_by_as_many_tasks_as_ranges(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = token_files.write_tokens(docs, new_folder(spark, "test"), block_ids=1000)
    whole = sorted(map(tuple, token_files.read_tokens(manifest).collect()))
    monkeypatch.setattr(token_files, "RANGE_IDS", 5000)
    rows = token_files.read_tokens(manifest)
    total = sum(r.n_ids for r in manifest.collect())
    assert rows.rdd.getNumPartitions() >= total // 5000 > 4 and sorted(map(tuple, rows.collect())) == whole
    used = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > total // 10_000


def test_repeated_rows_are_spread_over_files_and_blocks(spark):
    docs = spark.range(0, 40_000, 1, 8).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same few words").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the texts are short
    files = token_files.write_tokens(docs, new_folder(spark, "test")).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r.n_docs for r in files) == 40_000 and max(r.n_docs for r in files) < 20_000
    rows = packing.pack(staged(packing.pieces(docs)), 4096, block_pieces=4000)
    blocks = rows.groupBy(F.shiftright("sequence_id", 32).alias("block")).count().collect()
    assert len(blocks) == 11 and max(r["count"] for r in blocks) < 4500
    places(rows.collect(), 4096)


def test_memory_of_texts_without_spaces(monkeypatch):
    """Units that never repeat are forgotten by their characters and ids, long before there are many."""
    from cohortloom.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED_CHARS", 20_000)
    monkeypatch.setattr(tokens, "REMEMBERED_IDS", 40_000)
    encode = tokens.WordEncoder(tokens.default_tokenizer())
    for i in range(60):
        text = "".join(chr(0x4E00 + (i * 2000 + k * 7) % 20_000) for k in range(2000)) + " some words"
        assert encode.encode(text).tolist() == ids_of(text)
        assert encode.chars <= 20_000 + 2100 and encode.used <= 40_000 + 8100
    assert len(encode.known) < 60


def test_workers_keep_tables_of_one_operator():
    """Workers live through the stages of a pipeline: what one stage's operator keeps in them must not add to the next one's."""
    from cohortloom.llm import shared, shingles, tokens, toxicity

    path = tokens.default_tokenizer()
    first = tokens.encoder(path)
    assert tokens.encoder(path) is first and set(shared._HELD) == {"encoders"}
    bag = shingles.bags(["one two three four five six"])[0]
    assert set(shared._HELD) == {"shingles"}
    toxicity.features("You idiot!!", {"word": {}, "beginning": {}})
    assert set(shared._HELD) == {"toxicity"}
    assert tokens.encoder(path) is not first and tokens.encoder(path).encode("some words").tolist() == ids_of("some words")
    assert shingles.bags(["one two three four five six"])[0][0].tolist() == bag[0].tolist()


def test_length_table(spark, sf_dir, odd_docs, no_docs, monkeypatch):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_docs):
        lengths = [len(ids_of(r.text)) for r in docs.collect()]
        monkeypatch.setattr(token_counts, "SPAN", 100)
        table = token_counts.length_table(token_counts.token_lengths(docs))
        rows = {r.length: (r.n_docs, r.docs_upto, r.tokens_upto, r.truncated_total) for r in table.collect()}
        assert rows == plain_table(lengths)
        limits = [0, 5, 100, 4096, 10**9]
        got = {r["limit"]: (r.docs_upto, r.tokens_upto, r.truncated_total) for r in token_counts.at_limits(table, limits).collect()}
        assert got == {n: (sum(x <= n for x in lengths), sum(x for x in lengths if x <= n), sum(min(x, n) for x in lengths)) for n in limits}
    assert token_counts.length_table(token_counts.token_lengths(no_docs)).collect() == []


def places(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_whole_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.op6_best_two_fit(spark, sf_dir).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=str) == piece_rows(docs)
    assert places(rows, 4096) <= -(-sum(r.length for r in rows) // 4096) + 2


def test_packing_of_odd_rows_in_small_blocks(odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows = packing.pack(staged(packing.pieces(odd_docs, capacity=64)), 64, block_pieces=50).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=str) == piece_rows(docs, 64)
    places(rows, 64)
    assert packing.packed(no_docs).collect() == []


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 50)) for i in range(60)], "doc_id long, text string")
    pieces = staged(packing.pieces(docs, capacity=40, keep_ids=True))
    where = packing.pack(pieces.drop("ids"), 40)
    rows = packing.sequences(where.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])).collect()
    assert all(len(r.ids) <= 40 for r in rows)
    assert Counter(x for r in rows for x in r.ids) == Counter(x for i in range(60) for x in [*ids_of("word " * (i % 50)), 1])


@given(st.lists(st.integers(1, 64), min_size=1, max_size=120))
@settings(max_examples=150, deadline=None)
def test_best_two_fit_packs_every_piece(lengths):
    lengths = np.array(lengths)
    bins, offsets = packing.best_two_fit(lengths, 64)
    for b in set(bins.tolist()):
        order = np.argsort(offsets[bins == b])
        inside = lengths[bins == b][order]
        assert inside.sum() <= 64 and offsets[bins == b][order].tolist() == (np.cumsum(inside) - inside).tolist()
    assert len(set(bins.tolist())) <= max(-(-2 * lengths.sum() // 64), 1)


def test_two_pieces_replace_the_smallest():
    # Greedy filling takes 50 + 40 (gap 10); 26 + 24 fill the gap that 40 leaves behind.
    bins, _ = packing.best_two_fit(np.array([50, 40, 26, 24]), 100)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_tokenizer_is_read_by_path():
    assert ENCODER.vocabulary == TOKENIZER.get_vocab_size() == 49_408
    with pytest.raises(Exception):
        tokens.WordEncoder("/nowhere.json")
