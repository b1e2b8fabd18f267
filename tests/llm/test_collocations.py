"""Phrase collocations against counting in plain Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from pricewright.llm import collocations as C
from pricewright.llm.queries import table

SMALL = "/root/testdata/sf0.001"


def brute(rows, max_n=3, min_count=10, inside=50, top=2000):
    """Sorted result rows of (lang, text) rows; every longer candidate is looked at."""
    f = defaultdict(Counter)
    for lang, text in rows:
        plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain):
            words = re.findall(r"[^\x20\x09]+", piece)
            f["und" if lang is None else lang].update(tuple(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1))
    out = []
    for lang, counts in f.items():
        total = sum(c for k, c in counts.items() if len(k) == 1)
        known = {k: c for k, c in counts.items() if len(k) > 1 and c >= min_count}
        held = set()
        for k, c in known.items():
            for n in range(2, len(k)):
                held |= {k[i : i + n] for i in range(len(k) - n + 1) if 100 * c >= inside * known[k[i : i + n]]}
        found = []
        for k, a in known.items():
            score, _, left, right = min((1_000_000 * a * a // (counts[k[:j]] * counts[k[j:]]), j, counts[k[:j]], counts[k[j:]]) for j in range(1, len(k)))
            if k not in held:
                found.append((-score, -a, " ".join(k).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total, -score))
    return sorted(out)


def result(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert [t for _, t in df.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5
    return sorted(tuple(r) for r in df.collect())


ODD = [
    (-1, None, "en"), (-2, "", "en"), (-3, "Big Apple pie. big apple PIE; the big\tapple  pie\nis pie" * 12, None), (-4, "new york city, new york state; new york" * 20, "und"),
    (-5, "a b a b a b a " * 5_000, "xx"), (-6, "ÄB äb  x  y " * 15, "de"), (-7, "w" * 300 + " " + "v" * 200 + " z " + "k. " * 3, "xx"), (-7, "w" * 300 + " " + "v" * 200 + " z", "xx"),
]


def test_whole_table_with_odd_rows(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text", "lang")
    wide = docs.unionByName(spark.createDataFrame([*ODD, *ODD[2:4]], docs.schema)).selectExpr("*", "1 AS phrase", "2 AS a", "3 AS n", "4 AS _lang", "5 AS rank", "6 AS k")
    rows = [(r.lang, r.text) for r in wide.collect()]
    want = brute(rows)
    assert len({x[0] for x in want}) >= 5
    assert result(C.collocations(wide)) == want


@pytest.mark.parametrize("bits", [6, 27])
def test_longer_phrases_and_a_full_table(spark, bits):
    """With a table that lets everything through the result is the same."""
    docs = table(spark, SMALL, "documents").limit(80).select("doc_id", "text", "lang").unionByName(spark.createDataFrame(ODD, "doc_id long, text string, lang string"))
    got = result(C.collocations(docs, max_n=4, min_count=3, inside_percent=70, top=50, table_bits=bits))
    assert got == brute([(r.lang, r.text) for r in docs.collect()], 4, 3, 70, 50)


def test_scores_beyond_64_bits(spark):
    n = 3_000_000_000
    counts = spark.createDataFrame([("en", "a", n), ("en", "b", n + 1), ("en", "a b", n - 7)], C.COUNTS)
    got = C.scores(counts.where("phrase = 'a b'").withColumnRenamed("f", "a"), counts).collect()
    assert [tuple(r) for r in got] == [("en", "a b", n - 7, n, n + 1, 1_000_000 * (n - 7) ** 2 // (n * (n + 1)))]


def test_a_language_ranked_in_parts(spark):
    rows = [("en", f"p q{k}", k % 7 + 10, k % 5) for k in range(3000)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, score long")
    got = sorted((r["rank"], r.phrase) for r in C.first_of_each(df, 40).collect())
    want = sorted(rows, key=lambda x: (-x[3], -x[2], x[1].encode()))[:40]
    assert got == [(k, x[1]) for k, x in enumerate(want, 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert result(C.collocations(none)) == []
    assert result(C.collocations(spark.createDataFrame([(1, None, "en"), (2, "few words", None)], none.schema))) == []
