"""Centroid clustering against plain Python."""

import hashlib
import math

import numpy as np
import pytest

from cohortloom.llm import centroids


def plain(rows, clusters=16, rounds=3, dims=64, scale=64):
    def whole(x):
        return int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale)

    kept = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    found = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]]

    def assign():
        out = []
        for _, v in kept:
            far = [sum((x - y) ** 2 for x, y in zip(v, c)) for c in found]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        at = assign()
        for c in range(len(found)):
            own = [v for (_, v), (k, _) in zip(kept, at) if k == c]
            if own:
                found[c] = [sum(column) // len(own) for column in zip(*own)]
    return sorted(((i, k, d, hashlib.sha256(",".join(map(str, found[k])).encode()).hexdigest()) for (i, _), (k, d) in zip(kept, assign())), key=str)


def test_transform_keeps_distances():
    rng = np.random.default_rng(3)
    x, y = rng.integers(-1000, 1000, (2, 5, 64))
    assert (((centroids.transform(x) - centroids.transform(y)) ** 2).sum(axis=1) == 64 * ((x - y) ** 2).sum(axis=1)).all()
    order = centroids.sequency(64)
    changes = (np.diff(np.sign(centroids.transform(np.eye(64, dtype=np.int64))), axis=1) != 0).sum(axis=1)
    assert changes[order].tolist() == list(range(64))


@pytest.mark.parametrize("spread", [2, 40, 1 << 40])
def test_nearest_equals_all_distances_with_ties(spread):
    rng = np.random.default_rng(spread % 97)
    x, c = rng.integers(-spread, spread, (300, 64)), rng.integers(-spread, spread, (16, 64))
    c[5] = c[2]
    x[7], x[8] = c[2], c[5]
    far = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
    cluster, distance = centroids.nearest(x, c)
    assert cluster.tolist() == [list(r).index(min(r)) for r in far] and distance.tolist() == [min(r) for r in far]
    assert cluster[7] == cluster[8] == 2


def rows_of(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in df.collect()), key=str)


def test_odd_vectors_as_in_plain_python(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(64) * (1 + i % 3)).tolist()) for i in range(200)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (300, rows[1][1]), (None, rows[2][1]), (302, [0.0] * 64), (303, [-1e-9] * 64)]
    rows += [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 65), (404, [None] + [1.0] * 63), (405, [float("nan")] * 64), (406, [math.inf] * 64)]
    df = spark.createDataFrame([(i, v, 3, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string, label int")
    out = centroids.cluster(df).cache()
    assert rows_of(out) == plain(rows)
    own = {}
    for r in out.collect():
        own[r.cluster] = own.get(r.cluster, 0) + r.distance
    assert {(r.cluster, r.cluster_inertia, r.inertia) for r in out.collect()} == {(k, v, sum(own.values())) for k, v in own.items()}


def test_few_huge_and_no_vectors(spark):
    rows = [(i, [float(i * 10**6 + d) for d in range(64)]) for i in range(5)] + [(9, [1e30] * 64), (10, [-3e307] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in centroids.cluster(df).collect()}
    expected = {i: (k, d, h) for i, k, d, h in plain(rows)}
    assert {i: (r.cluster, r.distance, r.centroid_sha256) for i, r in found.items()} == expected
    assert centroids.cluster(df.limit(0)).collect() == []
    one = centroids.cluster(spark.createDataFrame([(1, [1e300] * 64), (2, [0.0] * 64)], "vec_id long, embedding array<double>"), clusters=1).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in one} == {(0, None, None)}


def test_parameters(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(centroids.cluster(df, clusters=5, rounds=1, dims=16, scale=10)) == plain(rows, 5, 1, 16, 10)
    with pytest.raises(ValueError):
        centroids.cluster(df, dims=24)
