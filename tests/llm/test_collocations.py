"""FM-index and collocations against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortloom.llm import collocations
from cohortloom.llm.fm_index import FmIndex


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=12), max_size=8), st.integers(2, 4))
def test_index_extends_both_ways(pieces, depth):
    text = np.array([0, *(x for piece in pieces for x in [*piece, 0])] + [0])
    index = FmIndex(text, depth)
    for order in range(2 ** (depth - 1)):
        found = index.single_words()
        for step in range(depth):
            want = Counter(tuple(p[i : i + step + 1]) for p in pieces for i in range(len(p) - step))
            assert dict(zip(map(tuple, found.words.tolist()), found.count.tolist())) == dict(want)
            if step + 1 < depth:
                found = (index.left if order >> step & 1 else index.right)(found)


def test_many_symbols_are_sorted_by_column():
    rng = np.random.default_rng(1)
    text = np.concatenate([[0], rng.integers(1, 2**40, 30), [0]])
    ids = np.unique(text, return_inverse=True)[1]
    from cohortloom.llm import fm_index

    assert fm_index._order(ids, 3, 2**30).tolist() == fm_index._order(ids, 3, 64).tolist()


def words_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^\x20\x09]+", piece) for piece in re.split("[.,;:!?\x0a-\x0d]", text)]


def plain(rows, least, longest, percent, top):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for ws in words_of(text):
            total[lang] += len(ws)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in some.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in some.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), a, x, y, total[lang], -s) for i, (s, _, p, a, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def texts(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["New", "YORK", "new", "york", "city", "a", "the", "über", "Ü", "x\xa0y", "\x1c", "\x85", "　", " ", "日本", "end", "o'clock", "\\", "a b"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", "\x0b", "?!", ":", ";", " . "]
    return [(rng.choice(["en", "en", "en", "de", None, ""]), "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(rng.randrange(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("least, longest, percent, top, shard", [(10, 3, 50, 2000, 2000), (3, 4, 60, 40, 10**7), (2, 2, 50, 15, 500)])
def test_equal_to_plain_counts(spark, least, longest, percent, top, shard):
    rows = [*texts(least), (None, None), ("en", ""), ("en", " .\t\n"), ("en", "one piece without an end " * 50_000)]
    rows += [("fr", "A b c d e")] * 30
    docs = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], "lang string, text string, n int, phrase string, score double").repartition(3)
    got = collocations.collocations(docs, least, longest, percent, top, shard_bytes=shard, packet_bytes=shard // 4).collect()
    assert sorted(map(tuple, got)) == plain(rows, least, longest, percent, top)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    got = collocations.collocations(odd_docs).collect()
    assert sorted(map(tuple, got)) == plain(rows, 10, 3, 50, 2000)
    assert collocations.collocations(no_docs).collect() == []


def test_counts_beyond_64_bits(spark):
    """Products of counts are formed in decimals."""
    n = 3 * 10**15
    rows = [("en", "a b", 2, n), ("en", "a", 1, n + 5), ("en", "b", 1, n + 9), ("en", "a b c", 3, n - 7), ("en", "b c", 2, n), ("en", "c", 1, n + 1)]
    f = {p: a for _, p, _, a in rows}
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, size int, n long")).collect()}
    cut = lambda p, x, y: (f[p], f[x], f[y], 10**6 * f[p] ** 2 // (f[x] * f[y]))
    assert got["a b"] == cut("a b", "a", "b")
    assert got["a b c"] == min([cut("a b c", "a", "b c"), cut("a b c", "a b", "c")], key=lambda x: x[3])
