"""MinHash near-dedup against all pairs on full sets."""

from __future__ import annotations

import random
import re

import numpy as np

from pricewright.llm import near_dedup
from pricewright.llm.queries import table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sets_of(rows, words=3):
    out = []
    for key, text in rows:
        w = WORD.findall((text or "").encode().lower())
        out.append((key, {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())))
    return out


def brute(rows, words=3, percent=85):
    """(key, n, component, kept) by all pairs."""
    sets = sets_of(rows, words)
    parent = {k: k for k, _ in sets if k is not None}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y:
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both) and root(a) != root(b):
                    a_, b_ = sorted((root(a), root(b)))
                    parent[b_] = a_
    return sorted(((k, len(s), None if k is None else root(k), k is None or root(k) == k) for k, s in sets), key=str)


def found(df, **options):
    return sorted(map(tuple, near_dedup.grouped(df, **options).collect()), key=str)


def near_copies(seed, groups=12, n=100):
    """Groups of copies, each changed in a few words of the one before or of the first."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    rows = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(n)]
        now = list(base)
        for _ in range(rng.randrange(1, 12)):
            rows.append(" ".join(now))
            now = list(now if g % 2 else base)
            for _ in range(rng.randrange(0, 4)):
                now[rng.randrange(n)] = rng.choice(words)
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_shingle_sets():
    texts = [b"", b"One two", b"one TWO three four", b"a a a a a a", b"one two"]
    shingles, starts = near_dedup.shingle_sets(texts, 3)
    assert np.diff(starts).tolist() == [0, 1, 2, 1, 1]
    assert shingles[0] == shingles[starts[4]]


def test_sketches_fill_every_bin_and_estimate_similarity():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 400):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.r_[x, rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)]
        starts = np.array([0, x.size, x.size + y.size])
        a, b = near_dedup.sketches(np.r_[x, y], starts)
        assert (a < np.iinfo(np.uint64).max).all()
        assert abs((a == b).mean() - x.size / y.size) < 0.15


def test_bands_miss_a_pair_at_the_threshold_once_in_a_million(documents):
    df = documents((1, " ".join(f"w{i}" for i in range(80))))
    for percent in (70, 75, 80, 85, 90, 95):
        bands = len(near_dedup.signatures(df, "doc_id", "text", 5, percent).first().bands)
        assert near_dedup.BINS % bands == 0
        assert (1 - (percent / 100) ** (near_dedup.BINS // bands)) ** bands <= 1e-6
    assert near_dedup.banding(85) == 24 and near_dedup.banding(80) == 30


def test_against_all_pairs(documents):
    rows = near_copies(3)
    assert found(documents(*rows)) == brute(rows)
    assert len({r[2] for r in brute(rows)}) < len(rows)


def test_chains_beyond_the_hub(documents, monkeypatch):
    """Blocks of a few nodes and checks, and links that no hub has."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "CHECKS", 2)
    rows = near_copies(8, groups=4, n=60)
    assert found(documents(*rows)) == brute(rows)
    assert found(documents(*rows), words=5, percent=80) == brute(rows, 5, 80)


def test_nulls_short_texts_ties_and_repeated_rows(documents):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "Hi there"), (5, "hi\nTHERE"), (6, "hi"), (9, long), (8, long + " x"), (8, long + " x"), (None, long), (7, "other words here altogether")]
    got = found(documents(*rows))
    want = brute(rows)
    assert got == want
    by = {r[0]: r[2] for r in got}
    assert by[5] == 4 and by[9] == 8 and by[None] is None and by[6] == 6


def test_rows_of_one_key_are_one_node(documents):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    got = found(documents((1, a), (5, a), (5, b), (7, b)))
    assert {r[0]: r[2] for r in got} == {1: 1, 5: 1, 7: 1}


def test_empty_table_other_columns_and_long_text(documents):
    assert near_dedup.report(documents().limit(0)).collect() == []
    long = " ".join(f"w{i * i % 9973}" for i in range(100_000))
    df = documents((1, long), (2, long + " end"), (3, "w1")).selectExpr("*", "1 AS key", "2 AS a", "3 AS b", "4 AS node")
    assert [r.component_id for r in near_dedup.report(df).orderBy("doc_id").collect()] == [1, 1, 3]
    kept = near_dedup.distinct_documents(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, near_dedup.report(docs).collect()), key=str)
    assert got == brute(rows)
