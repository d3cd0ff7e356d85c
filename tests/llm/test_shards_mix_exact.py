"""Sharding, mixing and exact duplicates against plain versions."""

import zlib
from collections import Counter, defaultdict

import pytest
from brute import normalised
from compare import connect, differences
from pyspark.sql import functions as F

from cohortloom.llm import exact_dedup, mixing, queries, sharding


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE[name])[1] is None


def shard_rows(docs, shards, **options):
    return sharding.shard(docs, shards, **options).collect()


def test_shards_are_gapless_and_grow_into_the_new_one_only(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = shard_rows(docs, 5, block_rows=7)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        assert r.grown_shard in (r.shard, 5)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.doc_id: r.grown_shard for r in rows} == {r.doc_id: r.shard for r in shard_rows(docs, 6)}
    moved = sum(r.grown_shard == 5 for r in rows)
    assert 0 < moved < 2.5 * len(rows) / 6


def test_weights_set_the_shares(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = Counter(r.shard for r in ids.select(sharding.rendezvous(F.col("doc_id"), 4, [1, 2, 0, 1]).alias("shard")).collect())
    assert n[2] == 0 and abs(n[1] / 20_000 - 0.5) < 0.02 and abs(n[0] / 20_000 - 0.25) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), 2, [0, 0])


def test_odd_rows_keep_a_slot_each(odd_docs, no_docs):
    rows = shard_rows(odd_docs, 3)
    assert len(rows) == odd_docs.count() and shard_rows(no_docs, 3) == []
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1
    assert {r.size for r in rows if r.doc_id == 4} == {16}


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, list(names), float(sum(sizes.values()))
    while True:
        share = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / share > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / share for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
        open_ = [s for s in open_ if s not in over]
        left = sum(sizes.values()) - sum(target.values())


def test_targets_stop_and_share_the_excess(spark):
    sizes = {"a": 1000, "b": 10, "c": 5, "é": 300, "z": 1, None: 77, "": 0, "zz": 40}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = plain_targets(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)
    assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6


def test_mix_comes_near_its_targets_and_reruns_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(
        spark.createDataFrame([(10**6 + i, "w " * 50, "en", None, 100) for i in range(40)] + [(2 * 10**6, "only one", "en", "~", 8)], "doc_id long, text string, lang string, source string, n_chars long"))
    rows = mixing.mix(docs).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix(docs.repartition(3)).collect()))
    taken, largest = Counter(), Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for r in rows:
        assert -1e-6 <= r.target - taken[r.source] <= largest[r.source]


def test_mixed_documents_are_taken_as_often_as_the_mix_says(odd_docs, no_docs):
    want = Counter()
    for r in mixing.mix(odd_docs).collect():
        want[r.doc_id, r.source] += r.repeats
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == +want
    assert mixing.mix(no_docs).collect() == [] and mixing.mixed_documents(no_docs).collect() == []


def test_equal_rows_at_the_threshold_are_split(spark):
    """A third of a source is one row repeated: the mix takes as many of them as its target holds, whichever hash is the last to fit."""
    rows = [(f"{s}", 1000 * s + i, "w " * 20) for s in range(9) for i in range(40)] + [(f"{s}", 9000 + s, "v " * 30) for s in range(9) for _ in range(400)]
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(5)
    taken, target = Counter(), {}
    for r in mixing.mix(docs).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(-1e-6 <= target[s] - taken[s] <= 30 for s in target), (taken, target)
    mixed = mixing.mixed_documents(docs)
    assert Counter(taken) == Counter({r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()})


def plain_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[normalised(text)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return {text: (min(members)[3], len(members)) for text, members in groups.items()}


def test_exact_groups(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = plain_groups(rows)
    got = exact_dedup.exact_groups(odd_docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter((i, *want[normalised(t)]) for i, t in rows)
    assert exact_dedup.exact_groups(no_docs).collect() == []
    left = exact_dedup.without_copies(odd_docs)
    assert left.columns == odd_docs.columns
    assert sorted(hash(normalised(r.text)) for r in left.collect()) == sorted(map(hash, want))


def test_one_row_stays_of_rows_that_share_id_and_length(spark):
    rows = [(7, "a bc d"), (7, "ab c d"), (7, "ab cd "), (7, "ab c d"), (8, "ab cd"), (None, "x y"), (None, "xy "), (None, "x  y z"), (None, "xy  z ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = exact_dedup.without_copies(docs).collect()
    assert sorted(((r.doc_id or 0), normalised(r.text)) for r in left) == [(0, "xy"), (0, "xyz"), (7, "abcd")]
    assert {tuple(r) for r in left} == {tuple(r) for r in exact_dedup.without_copies(docs.repartition(4)).collect()}


def test_chunks_restore_the_text_and_are_content_defined(spark, sf_dir):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(30).collect()]
    body = normalised("".join(texts))
    rows = spark.createDataFrame([(0, body), (1, "zq" + body), (2, "漢字😀" * 5000), (3, "")], "id int, t string")
    cut = {r.id: r.c for r in rows.select("id", exact_dedup.chunks(F.col("t")).alias("c")).collect()}
    assert [hash("".join(cut[i])) for i in range(3)] == [hash(body), hash("zq" + body), hash("漢字😀" * 5000)] and cut[3] == []
    assert max(map(len, cut[0])) <= exact_dedup.MOST
    shared = len(set(cut[0]) & set(cut[1]))
    assert shared >= len(set(cut[0])) - 3


def test_an_identifier_of_two_contents_is_told_apart(spark):
    part = "struct<id:bigint,sha:binary>"
    rows = spark.sql(f"""SELECT * FROM VALUES
        (1L, 5, 0L, 'x', array(named_struct('id', 1L, 'sha', X'AA'))), (2L, 5, 0L, 'y', array(named_struct('id', 1L, 'sha', X'BB'))),
        (3L, 5, 0L, 'x', array(named_struct('id', 1L, 'sha', X'AA'))), (4L, 5, 0L, 'z', array(named_struct('id', 2L, 'sha', X'CC'))),
        (5L, 5, 0L, 'e', CAST(array() AS array<{part}>)) AS t(doc_id, n_points, text_hash, text_sha256, parts)""")
    recipe = {r.doc_id: tuple(r.recipe) for r in exact_dedup.verified(rows).collect()}
    assert recipe[1] == recipe[3] != recipe[2] and recipe[4] == (2,) and recipe[5] == ()


def test_native_plans_hold_no_python(spark, sf_dir):
    for name in ("op2_sharding", "op5_randomness_battery", "op8_exact_dedup", "op10_mixing"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop")), name
