"""Near duplicates, components and toxicity against plain versions."""

from collections import Counter

import numpy as np
import pytest
from brute import normalised  # noqa: F401

from cohortloom.llm import bag_minhash, embedding_dedup, near_dedup, shingles, toxicity
from cohortloom.llm.components import components


def plain_components(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(450, 450), (400, 401), (401, 400), (400, 401)]
    pairs += [tuple(map(int, p)) for p in rng.integers(500, 900, (300, 2))]
    want = plain_components(900, pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: c for i, c in enumerate(want) if c != i or i in got}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_bag(text):
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def plain_similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_shingles_are_those_of_the_plain_version():
    texts = ["", "...", "one", "Ünï x 12a", "a b c d e", "a b c d e f a b c d e", "x\x00y z_w 😀 q", "the The THE " * 50, "é" * 10, "İ ß ǅ a b c"]
    bags = shingles.bags(texts)
    for t, (elements, counts) in zip(texts, bags):
        assert sorted(counts.tolist()) == sorted(plain_bag(t).values()), t
        assert (np.diff(elements.astype(object)) > 0).all()
    for a, x in zip(texts, bags):
        for b, y in zip(texts, bags):
            assert abs(shingles.similarity(x, y) - plain_similarity(plain_bag(a), plain_bag(b))) < 1e-12


@pytest.mark.parametrize("a, b", [([1, 2, 3, 4, 5, 0, 0, 7], [1, 1, 3, 6, 0, 2, 1, 7]), ([1] * 8, [1] * 4 + [0] * 4), ([10] * 8, [9] * 8), ([100, 1], [50, 1])])
def test_signatures_estimate_the_weighted_similarity(a, b):
    a, b = np.array(a), np.array(b)
    rng, agree = np.random.default_rng(1), []
    for _ in range(200):
        e = rng.integers(0, 2**63, len(a)).astype(np.uint64)
        agree.append((bag_minhash.signature(e[a > 0], a[a > 0], 64) == bag_minhash.signature(e[b > 0], b[b > 0], 64)).mean())
    assert abs(np.mean(agree) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 4.5 * max(np.std(agree), 0.01) / 200**0.5


def plain_classes(rows):
    bags = [plain_bag(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bags[i] and bags[j] and plain_similarity(bags[i], bags[j]) >= 0.8]
    roots = plain_components(len(rows), links)
    return {rows[i][0]: rows[r][0] for i, r in enumerate(roots)}


def test_near_classes_of_planted_copies(spark, sf_dir):
    rng = np.random.default_rng(5)
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    for i in range(80):  # a chain: each copy changes another word of the one before
        base = list(base)
        base[int(rng.integers(0, 300))] = f"n{i}"
        rows.append((10**6 + i, " ".join(base)))
    for i in range(40):  # documents that share half of their words
        rows.append((2 * 10**6 + i, " ".join(base[:150] + [f"u{i}x{k}" for k in range(150)])))
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows)


def test_near_classes_of_odd_rows(odd_docs, no_docs):
    rows = near_dedup.near_classes(odd_docs).collect()
    assert len(rows) == odd_docs.count() and near_dedup.near_classes(no_docs).collect() == []
    classes = {r.doc_id: r.class_id for r in rows}
    assert classes[1] == classes[2] == classes[9] == 1 and classes[5] == classes[6] == 5 and classes[3] == 3 and classes[8] == 8 and classes[4] == 4
    assert all(r.kept and r.class_id is None for r in rows if r.doc_id is None)
    left = near_dedup.without_near_copies(odd_docs)
    assert left.columns == odd_docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(r.doc_id for r in odd_docs.collect() if r.doc_id not in (2, 9, 6))


def test_unlike_members_of_one_bucket_are_all_compared(spark, monkeypatch):
    """With one band of one row, buckets hold many unlike documents: the rounds must still find every link in them."""
    rng = np.random.default_rng(9)
    common = [f"c{k}" for k in range(300)]
    rows = []
    for i in range(60):
        words = common[:120] + [f"d{i % 30}x{k}" for k in range(200)]
        if i >= 30:
            words[int(rng.integers(150, 300))] = "changed"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), bands=40, rows=1).collect()}
    assert got == plain_classes(rows)


def test_few_edges_stay_in_few_tasks(spark):
    """Partitions follow the number of edges: else each step costs a task for each partition, however few edges there are."""
    parts, merged = spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set(merged, "false")
    try:
        labels = components(spark.createDataFrame([(i, (i + 1) % 200) for i in range(200)], "a long, b long"))
        assert {(r.node, r.component) for r in labels.collect()} == {(i, 0) for i in range(1, 200)}
        assert labels.rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set(merged, "true")


def plain_vectors(rows, least=0.95):
    ids = [i for i, _ in rows]
    use = [v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, float)).all() and any(v) for _, v in rows]
    width = max([len(v) for (_, v), u in zip(rows, use) if u], default=1)
    x = np.array([[*v, *[0] * (width - len(v))] if u else [0] * width for (_, v), u in zip(rows, use)], float)
    norm = np.linalg.norm(x, axis=1)
    x = x / np.where(norm > 0, norm, 1)[:, None]
    s = (x @ x.T >= least) & np.outer(use, use)
    np.fill_diagonal(s, False)
    roots = plain_components(len(ids), zip(*np.nonzero(s)))
    return {ids[i]: (int(s[i].sum()), ids[roots[i]]) for i in range(len(ids))}


def test_vectors_that_link(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, 24))
    rows = [(i, base[i].tolist()) for i in range(150)]
    for i in range(300):  # copies at angles around the threshold, and a large group
        v = base[i % 20 if i < 150 else 0]
        noise = rng.standard_normal(24)
        rows.append((1000 + i, (v / np.linalg.norm(v) + noise / np.linalg.norm(noise) * rng.uniform(0, 0.2)).tolist()))
    rows += [(2000 + i, base[1].tolist()) for i in range(30)] + [(2100, (base[1] * 2.5).tolist())]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [float("nan")] * 24), (3004, [None, 1.0]), (3005, [float("inf")] * 24), (3006, [1.0]), (3007, [2.0]), (3008, [1e-200] * 24)]
    frame = spark.createDataFrame([(*r, i, "x", True) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, node int, print string, kept boolean")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame, block=40).collect()}
    want = plain_vectors([(i, v) for i, v in rows if i != 3008])
    assert len(got) == len(rows)
    found, there = sum(got[i][0] for i in want), sum(n for n, _ in want.values())
    assert found <= there and found >= 0.99 * there
    assert all(got[i][0] <= want[i][0] for i in want)
    assert {i: c for i, (_, c) in got.items() if i in want and i >= 2000} == {i: c for i, (_, c) in want.items() if i >= 2000}
    assert embedding_dedup.near_duplicates(frame.limit(0)).collect() == []


def test_vectors_of_any_finite_length_link(spark):
    """Squares of these components underflow or overflow; the directions are alike nevertheless."""
    ones, other = [1.0] * 24, [1.0, -1.0] * 12
    scales = (1e-200, 1e-170, 5e-324, 1.0, 1e160, 1e308)
    rows = [(i, [x * s for x in ones]) for i, s in enumerate(scales)] + [(10 + i, [x * s for x in other]) for i, s in enumerate(scales)] + [(20, [0.0] * 24)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (0, 20) if i == 20 else (len(scales) - 1, i // 10 * 10) for i, _ in rows}


def test_tables_of_the_index_reach_the_recall():
    for n in (10, 10**4, 10**9):
        bits, tables = embedding_dedup.table_plan(n)
        hit = (1 - np.arccos(0.95) / np.pi) ** bits
        assert 2**bits >= n and 1 - (1 - hit) ** tables >= 0.995


@pytest.mark.parametrize("shift, unlike", [(0.0, 0.001), (2.0, 0.3)])
def test_bits_are_balanced_and_linked_codes_lie_within_the_radius(shift, unlike):
    """Vectors in all directions, and in a narrow cone (unlike ones at 0.8 or so) where plain signs would be all alike; partners at exactly the least similarity."""
    rng = np.random.default_rng(21)
    x = rng.standard_normal((4000, 32)) + shift
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = embedding_dedup.Codes(x[:3000], 10**6, 0.95, 0.995)
    ones = np.unpackbits(codes.of(x[3000:]), axis=1).mean(axis=0)
    assert ones.shape == (embedding_dedup.WIDTH,) and abs(ones - 0.5).max() < 0.08
    ways = rng.standard_normal(x.shape)
    ways -= (ways * x).sum(axis=1, keepdims=True) * x
    partners = 0.95 * x + np.sqrt(1 - 0.95**2) * ways / np.linalg.norm(ways, axis=1, keepdims=True)
    a, b = codes.of(x[3000:]), codes.of(partners[3000:])
    near = embedding_dedup.hamming(codes.words(a), codes.words(b)) <= codes.radius
    assert near.mean() > 0.995
    assert (near & (codes.keys(a) == codes.keys(b)).any(axis=1)).mean() > 0.985
    others = embedding_dedup.hamming(codes.words(a), codes.words(np.roll(a, 1, axis=0)))
    assert (others <= codes.radius).mean() < unlike


def test_recall_on_the_given_table(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(path).collect())
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.read.parquet(path)).collect()}
    assert got == plain_vectors(rows)


def toxic_table(spark, n=900):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 400, 60)]
        bad = i % 5 == 0
        if bad:
            words[10:14] = ["you", "utter", ["zorg", "blem", "idiot"][i % 3], "!!!"]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_table(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    held = [(r.score, r.doc_id % 5 == 0, r.predicted) for r in rows if r.held_out]
    good, bad = [s for s, t, _ in held if not t], [s for s, t, _ in held if t]
    assert len(rows) == 900 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert np.mean([[(b > g) + 0.5 * (b == g) for g in good] for b in bad]) > 0.97
    assert sum(p for _, t, p in held if not t) <= 2 and sum(p for _, t, p in held if t) >= 0.9 * len(bad)


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = toxic_table(spark, 300)
    held = toxicity.held_out(labels["doc_id"])
    flipped = labels.withColumn("toxic", held.cast("int") * (1 - labels["toxic"]) + (~held).cast("int") * labels["toxic"])
    score = lambda x: {r.doc_id: r.score for r in toxicity.toxicity(docs, x).collect()}
    assert score(labels) == score(flipped)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    _, labels = toxic_table(spark, 10)
    odd_labels = labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 0, 1)], "doc_id long, quality int, toxic int"))
    for table in (odd_labels, labels.limit(0)):
        rows = toxicity.toxicity(odd_docs, table).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(no_docs, labels).collect() == []
    docs, labels = toxic_table(spark, 300)
    wide = docs.selectExpr("*", "1 AS score", "'x' AS features", "2 AS probability", "3 AS rawPrediction", "4 AS f_score")
    left = toxicity.without_toxic(wide, labels)
    assert left.columns == wide.columns and 200 <= left.count() < 300
