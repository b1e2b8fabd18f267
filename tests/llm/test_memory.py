"""Long words, repetitive pages and hot ids: what a task holds is bounded by bytes."""

from __future__ import annotations

import random
import time
import tracemalloc

import public_tokenizers
import pyarrow as pa
import sentencepiece

from pricewright.llm import decontamination, mixing, near_dedup, token_counts, token_files, toxicity, warc

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def long_words(n, size=5_000, seed=1):
    rng = random.Random(seed)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 500)]
    return ["".join(rng.choices(letters, k=size)).encode() for _ in range(n)]


def test_long_words_are_not_remembered(documents):
    texts = long_words(50)
    near_dedup.word_hashes().clear(), decontamination.word_hashes().clear(), toxicity.term_places().clear()
    near_dedup.shingle_sets(texts, 3)
    decontamination.hashed(texts)
    for t in texts:
        toxicity.terms(t, toxicity.term_places())
    assert not near_dedup.word_hashes() and not decontamination.word_hashes() and not toxicity.term_places()
    counter = token_counts.PieceCounter(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert counter.counts(texts[:5]) == [len(library.encode(t.decode())) for t in texts[:5]]
    assert not counter.remembered
    encoder = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(40):
        encoder.encode(pa.array([t.decode() for t in long_words(20, 50_000, k)]), 1)
        assert encoder.known.nbytes + encoder.flat.nbytes <= token_files.REMEMBERED_BYTES + (16 << 20)


def test_very_long_pre_tokens_against_the_library():
    counter, library = token_counts.PieceCounter(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(7)
    texts = ["a" * n for n in (199, 200, 201, 1000, 4097)] + ["".join(rng.choices("abcdeéß☃日本", k=n)) for n in (201, 500, 3000)]
    texts += ["".join(rng.choices("the and ing tion er".split(), k=400)), "ab " + "x" * 300 + " " + "▁" * 250 + "y" * 400 + "  z", "\U0001f600" * 300]
    assert counter.counts([t.encode() for t in texts]) == [len(library.encode(t)) for t in texts]
    text = "".join(rng.choices("etaoinshrdlu", k=160_000))
    began = time.perf_counter()
    want = len(library.encode(text))
    theirs, began = time.perf_counter() - began, time.perf_counter()
    assert counter.counts([text.encode()]) == [want]
    assert time.perf_counter() - began < max(3.0, 40 * theirs)


def test_repetitive_pages_are_read_in_bounded_stretches(spark, tmp_path, monkeypatch):
    page = "<p>menu</p>" * 95_000  # about 1 MB, packs to a few thousand bytes
    rows = spark.range(50).selectExpr("id AS page_id", "'http://a/' || id AS url", f"repeat('<p>menu</p>', 95000) || id AS html")
    folder, payloads = f"file://{tmp_path}/w", f"file://{tmp_path}/p"
    manifest = warc.write_archives(warc.resolved(warc.packed(rows.coalesce(1), payloads)), payloads, folder).collect()
    assert sum(r.records for r in manifest) >= 50 and max(r.records for r in manifest) * len(page) < warc.UNPACKED_BYTES + 2 * len(page)
    data = next(tmp_path.glob("w/*.warc.gz")).read_bytes()
    tracemalloc.start()
    n = sum(len(warc.parsed(m)["payload"]) for m in warc.members(data))
    assert n >= len(page) and tracemalloc.get_traced_memory()[1] < 12 * len(page)
    tracemalloc.stop()
    found = warc.read_archives(spark, spark.createDataFrame(manifest, warc.MANIFEST), folder)
    assert sorted(r.key for r in found.collect()) == list(range(50))


def test_small_payloads_stay_out_of_the_join(spark):
    rows = [(k, "u", None if k % 2 else "", ) for k in range(300)] + [(1000 + k, "u", "x" * 200) for k in range(40)]
    got = warc.report(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got.where("record_type = 'response'").count() == 301 and got.where("refers_to = 1000").count() == 39


def test_one_id_of_many_documents_is_no_one_key(spark, documents):
    docs = documents(*[(7, f"text number {k}") for k in range(3000)])
    keys = docs.select(mixing.random_key("doc_id", "text", "mix").alias("k"))
    assert keys.distinct().count() == 3000
    rows = mixing.report(docs)
    assert rows.count() == 3000 and rows.agg({"taken": "sum"}).first()[0] == 9000
