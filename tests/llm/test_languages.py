"""Language profiles against plain loops, and on held-out rows."""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from pricewright.llm import languages as L
from pricewright.llm.queries import op12_languages, table


def plain_bundle(text, dimensions=L.DIMENSIONS):
    """The sum of a text's n-gram vectors, one n-gram at a time."""
    symbols = [0]
    for c in text.lower():
        code = ord(c) if c.isalpha() or unicodedata.category(c)[0] == "M" else 0
        if code or symbols[-1]:
            symbols.append(code)
    if symbols[-1]:
        symbols.append(0)
    total = np.zeros(dimensions, np.int64)
    for (a, b, c), n in Counter(zip(symbols, symbols[1:], symbols[2:], strict=False)).items():
        va, vb, vc = (L.letter_vector(x, dimensions).astype(np.int64) for x in (a, b, c))
        total += n * np.roll(va, 2) * np.roll(vb, 1) * vc
    return total


TEXTS = ["Hello, World! hello", "a", "", "123 !!", "Ünïcode ÇÖ İstanbul é", "日本語の文 x", "x" * 5000, "मैं हिन्दी", " lead and trail  "]


@pytest.mark.parametrize("cells", [L.CELLS, 1])
def test_bundles_against_loops(monkeypatch, cells):
    monkeypatch.setattr(L, "CELLS", cells)
    monkeypatch.setattr(L, "GRAMS_AT_ONCE", 7)
    found = L.grams([t.encode() for t in TEXTS])
    got = L.bundles(found, np.arange(len(TEXTS)), len(TEXTS))
    for vector, text in zip(got, TEXTS, strict=True):
        assert (vector == plain_bundle(text)).all(), text
    assert found.lettered.tolist() == [any(c.isalpha() for c in t) for t in TEXTS]


def test_letter_vectors_are_near_orthogonal():
    a = np.array([L.letter_vector(c).astype(int) for c in range(97, 123)])
    cosine = a @ a.T / L.DIMENSIONS
    assert (np.diag(cosine) == 1).all() and np.abs(cosine - np.eye(26)).max() < 0.2


def test_held_out_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = op12_languages(spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    for lang in {r.lang for r in rows}:
        own = [r.lang_pred == lang for r in held if r.lang == lang]
        assert sum(own) >= 0.95 * len(own), lang
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_predictions_against_loops(spark, documents):
    texts = {"en": "the quick brown fox and the lazy dog", "de": "der schnelle braune Fuchs und der faule Hund", "fr": "le renard brun et rapide et le chien"}
    ids = [k for k in range(1, 60) if zlib.crc32(str(k).encode()) % 5][:12]
    train = [(k, text + f" {lang}" * (k % 3), lang) for k, (lang, text) in zip(ids, [*texts.items()] * 4, strict=False)]
    asked = [(100, "the dog"), (101, "der Hund"), (102, None), (103, ""), (104, "12 ..."), (None, "le chien"), (None, "le chien"), (105, "the fox " * 30_000)]
    held = next(k for k in range(200, 300) if zlib.crc32(str(k).encode()) % 5 == 0)
    docs = spark.createDataFrame([(*r, "s") for r in train] + [(k, t, None, "s") for k, t in asked] + [(held, "the dog", "xx", "s")], "doc_id long, text string, lang string, source string")
    wide = docs.selectExpr("*", "1 AS held_out", "2 AS score", "3 AS lang_pred", "4 AS at", "5 AS value")
    profiles = L.learn(wide)
    assert profiles.languages == ["de", "en", "fr"]
    prototypes = {lang: sum(plain_bundle(t) for _, t, x in train if x == lang) for lang in texts}
    cosine = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    for r in L.predicted(wide, profiles).where("doc_id >= 100 OR doc_id IS NULL").collect():
        text = dict(asked).get(r.doc_id, "the dog")
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        want = {lang: cosine(plain_bundle(text).astype(float), p.astype(float)) for lang, p in prototypes.items()}
        assert r.lang_pred == max(want, key=want.get) and r.score == pytest.approx(max(0.0, want[r.lang_pred]), abs=1e-9)
    assert L.predicted(wide, profiles).count() == docs.count()


def test_without_languages_or_rows(documents):
    docs = documents((1, "some text"), (2, None))
    nothing = L.learn(docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang"))
    assert nothing.languages == []
    assert {(r.lang_pred, r.score) for r in L.predicted(docs, nothing).collect()} == {("und", 0.0)}
    assert L.predicted(docs.limit(0), L.learn(docs)).collect() == []
