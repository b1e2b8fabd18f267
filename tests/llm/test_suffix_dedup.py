"""Suffix-array dedup against brute force over all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from pricewright.llm import suffix_dedup
from pricewright.llm.queries import table


def brute(rows, length=50):
    """doc -> (n_bytes, n_removed, n_spans, sha256), by a table of all windows."""
    first = {}
    texts = [(k, (t or "").encode()) for k, t in rows]
    for k, t in texts:
        k = float("inf") if k is None else k
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            first[w] = min(first.get(w, k), k)
    out = []
    for k, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < (float("inf") if k is None else k):
                gone[i : i + length] = True
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((k, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, **options):
    rows = suffix_dedup.deduped(df, **options)
    return sorted((tuple(r)[:5] for r in rows.select("key", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("shard_rows", [1, 300, 1 << 20])
def test_smallest_keys_of_shards(shard_rows):
    rng = random.Random(shard_rows)
    base = bytes(rng.choice(b"ab\0") for _ in range(300))
    bodies = [base[i : i + rng.randrange(50, 90)] for i in (rng.randrange(200) for _ in range(60))]
    keys = np.array([rng.randrange(40) for _ in bodies])
    known = {}
    for b, k in zip(bodies, keys):
        for i in range(len(b) - 49):
            known[b[i : i + 50]] = min(known.get(b[i : i + 50], 99), k)
    got = suffix_dedup.smallest_keys(bodies, keys, 50, shard_rows)
    assert got.tolist() == [known[b[i : i + 50]] for b in bodies for i in range(len(b) - 49)]
    assert suffix_dedup.smallest_keys([], keys, 50, shard_rows).size == 0


def planted(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(25) for _ in range(4)]
    rows = []
    for k in range(n):
        parts = [prose(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            parts += [rng.choice(passages)[rng.randrange(30) :], prose(20)]
        rows.append((k, " ".join(parts)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, rows[5][1][:-1] + "#"), (n + 3, "a" * 500), (n + 4, "a" * 120 + "b"), (n + 5, ""), (n + 6, None), (n + 7, "ab" * 20)]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(documents):
    rows = planted()
    assert found(documents(*rows)) == brute(rows)


def test_small_chunks_buckets_and_heavy_anchors(documents):
    rows = planted(2)
    options = {"chunk_bytes": 900, "range_bytes": 4000, "bucket_bytes": 3000, "shard_rows": 500}
    assert found(documents(*rows), **options) == brute(rows)
    assert found(documents(*rows), heavy=2, **options) == brute(rows)


def test_equal_keys_null_keys_and_repeated_rows(documents):
    long = "the same words in every one of these rows, which is long enough to count as a repeat"
    rows = [(5, long), (5, long), (None, long), (None, long + " and more"), (7, "x" + long)]
    assert found(documents(*rows)) == brute(rows)


def test_empty_table_and_other_columns(spark, documents):
    assert suffix_dedup.report(documents().limit(0)).collect() == []
    df = documents((1, "a" * 60), (2, "a" * 60)).selectExpr("*", "1 AS chunk", "2 AS bucket", "3 AS key", "4 AS block", "5 AS n_bytes")
    assert [r.n_removed for r in suffix_dedup.report(df).orderBy("doc_id").collect()] == [0, 60]


def test_very_long_text(documents):
    rng = random.Random(4)
    long = "".join(rng.choice("abc ") for _ in range(60_000))
    rows = [(1, long), (2, "q" + long[1000:50_000] + "q")]
    got = found(documents(*rows), chunk_bytes=10_000)
    assert got[1][2:4] == (49_000, 1)


def test_spans_and_texts(documents):
    same = "Ein Satz, der in beiden Texten steht und länger als fünfzig Bytes ist."
    df = documents((1, "Anfang. " + same), (2, same + " Ende."))
    rows = {r.key: r for r in suffix_dedup.deduped(df).collect()}
    assert rows[1].kept.decode() == "Anfang. " + same and rows[1].starts == []
    assert rows[2].kept.decode() == " Ende." and (rows[2].starts, rows[2].ends) == ([0], [len(same.encode())])


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in suffix_dedup.report(docs).collect()), key=str)
    assert got == brute(rows)
