"""The pipeline's stages, each against its input."""

from collections import Counter

import pytest
from brute import normalised, piece_rows
from test_near import plain_classes

import corpus_pipeline
from cohortloom.llm import mixing
from cohortloom.llm.shared import new_folder


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """Rows before the first stage and after each."""
    docs, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    found.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        folder = new_folder(spark, name)
        stage(spark, found[-1], sf_dir).write.parquet(folder)
        found.append(spark.read.parquet(folder))
    assert all(f.columns == columns for f in found[:-1])
    return [[tuple(r) for r in f.collect()] for f in found]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_each_stage_works_on_what_is_left(spark, sf_dir, steps):
    before, clean, unique, apart, mixed, packed = steps
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert {r[0] for r in clean} <= {r[0] for r in before} and {hash(r) for r in clean} <= {hash(r) for r in before}
    gone = {r[0] for r in before} - {r[0] for r in clean}
    assert all(toxic.get(i, 1) for i in gone)  # no document that is labelled clean
    longest = {}
    for doc_id, text, *_ in sorted(clean, key=lambda r: (-len(r[1]), r[0])):
        longest.setdefault(normalised(text), doc_id)
    assert sorted(r[0] for r in unique) == sorted(longest.values())
    classes = plain_classes([r[:2] for r in sorted(unique)])
    assert sorted(r[0] for r in apart) == sorted(set(classes.values()))
    taken = {r.doc_id: r.repeats for r in mixing.mix(spark.createDataFrame(apart, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert Counter(r[0] for r in mixed) == +Counter(taken)
    assert sorted((r[:5] for r in packed), key=str) == piece_rows([r[:2] for r in mixed])


def test_stages_over_odd_and_empty_tables(spark, sf_dir, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", "size", "kept")
    for rows in (docs, docs.limit(0)):
        left = rows
        for name, stage in corpus_pipeline.STAGES:
            folder = new_folder(spark, name)
            stage(spark, left, sf_dir).write.parquet(folder)
            left = spark.read.parquet(folder)
            if name != "packing":
                assert left.columns == docs.columns
                if name in ("toxicity", "exact_dedup", "near_dedup"):
                    assert left.count() <= rows.count() and left.exceptAll(rows).count() == 0
        assert (left.count() > 0) == (rows is docs)


def test_exact_stage_keeps_the_same_row_in_every_run(spark):
    rows = [(1, "same  text", "en", s, 10) for s in ("b", "a", None, "c")] + [(1, "same text ", "en", "0", 10), (2, "other", "en", "x", 5)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        left = corpus_pipeline.STAGES[1][1](spark, docs, "").collect()
        assert len(left) == 2 and len({tuple(r) for r in left}) == 2
        chosen = next(r for r in left if r.doc_id == 1)
        assert chosen.source in (None, "0")
    assert len({tuple(r) for order in (rows, rows[::-1]) for r in corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame(order, docs.schema), "").collect()}) == 2


def test_run_gives_the_last_stage(spark, sf_dir, steps):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(tuple(r)[:5] for r in rows) == Counter(r[:5] for r in steps[-1])
