"""Importance resampling against plain Python, and radix selection against sorting."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pricewright.llm import importance as I
from pricewright.llm.queries import op11_importance, table

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, targets):
    """(id, n_features, weight, score, rank) of (id, text) rows, sorted."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in rows], targets))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for k, text in rows:
        n, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        out.append([n, k, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((x for x in out if x[0] >= 20), key=lambda x: (-x[4], x[1] is None, x[1] or 0, x[2]))
    ranks = {id(x): k for k, x in enumerate(fit[: 5 * len(fit) // 100], 1)}
    return sorted(((*x[1:], ranks.get(id(x))) for x in out), key=str)


def test_bucket_arrays():
    texts = ["Hello wörld 12 foo-bar x", "", "a" * 500 + " b c " + "q" * 129 + " z", "one", "日本語 x 文 " + "é" * 200]
    found, begin = I.bucket_arrays([t.encode() for t in texts])
    for k, text in enumerate(texts):
        got = [b for f in found for b in f[begin[k] : begin[k + 1]].tolist() if b >= 0]
        assert got == [zlib.crc32(f.encode()) % 10_000 for f in features(text)[1]]


def test_importance(spark, documents):
    docs = table(spark, SMALL, "documents")
    odd = [(-1, None), (-2, ""), (-3, "?!"), (None, "words of " * 30), (None, "words of " * 30), (-4, "same text here " * 10), (-4, "same text here " * 10), (-5, "z" * 100_000 + " and " * 50_000), (2**62, "one two three " * 9)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + odd + odd[-1:]
    wide = docs.unionByName(documents(*odd, odd[-1])).selectExpr("*", "1 AS row", "2 AS _score", "3 AS n_features", "4 AS rank", "5 AS key", "6 AS c0")
    targets = [r.text for r in table(spark, SMALL, "benchmark").collect()] + [None]
    target = table(spark, SMALL, "benchmark").unionByName(spark.createDataFrame([(None, None)], "item_id long, text string"))
    got = I.importance(wide, target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    want = brute(rows, targets)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    drawn = I.resampled(wide, target)
    assert drawn.columns == wide.columns
    assert sorted((r.doc_id for r in drawn.collect()), key=str) == sorted((x[0] for x in want if x[-1]), key=str)
    assert sorted(tuple(r) for r in op11_importance(spark, SMALL).select("rank", "doc_id").where("rank IS NOT NULL").collect()) == sorted((x[-1], x[0]) for x in brute([(r.doc_id, r.text) for r in docs.collect()], targets) if x[-1])


def test_importance_of_many_equal_rows(spark, documents):
    """A third and more of all rows are the same: as many of them are drawn as are due."""
    docs = documents(*[(7, "the very same words " * 8)] * 60, *((k, f"other words number {k} " * 8) for k in range(100, 140)))
    target = documents((1, "the very same words"))
    got = I.importance(docs, target, percent=40)
    assert sorted(r["rank"] for r in got.where("rank IS NOT NULL").collect()) == list(range(1, 41))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], ["the very same words"])
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(x[:4] for x in want)
    assert I.resampled(docs, target, percent=40).count() == 40


def test_importance_of_empty_tables(spark, documents):
    docs, none = documents((1, "some words " * 15), (2, None)), documents()
    assert I.importance(none, docs).collect() == [] and I.resampled(none, docs).collect() == []
    assert sorted(tuple(r) for r in I.importance(docs, none).collect()) == brute([(r.doc_id, r.text) for r in docs.collect()], [])


@pytest.mark.parametrize("few", [0, 3])
def test_radix_selection(spark, monkeypatch, few):
    monkeypatch.setattr(I, "FEW", few)
    monkeypatch.setattr(I, "DIGIT_BITS", 5)
    rng = random.Random(5)
    edge = [-(1 << 63), (1 << 63) - 1, 0, -1, 1]
    rows = [(rng.choice([*edge, rng.randrange(-50, 50)]), rng.choice([*edge, rng.randrange(-(1 << 60), 1 << 60)])) for _ in range(120)]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "a long, b long").cache()
    for k in (1, 2, 77, 149, 150):
        bound = I.kth_key(df, ["a", "b"], k)
        assert bound == sorted(rows)[k - 1]
    assert df.where(I.up_to(["a", "b"], bound)).count() == 150


def test_ranks_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(I, "RANGE_ROWS", 7)
    rows = [(k * 37 % 101,) for k in range(101)]
    got = I.ranked(spark.createDataFrame(rows, "a long"), ["a"], 101).collect()
    assert sorted((r.a, r["rank"]) for r in got) == [(k, k + 1) for k in range(101)]


def test_gains():
    assert I.gains_of(np.array([3, 0]), np.array([0, 5])).tolist() == [math.floor(1000 * math.log(1 * 5 / (4 * 7))), math.floor(1000 * math.log(6 * 5 / (1 * 7)))]
