"""The pipeline on a small table, each stage held against what it was given."""

from __future__ import annotations

import math
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers  # noqa: E402

from pricewright.llm.shared import written  # noqa: E402

from .test_near_dedup import brute  # noqa: E402
from .test_operators import measures, near_passages  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "decontaminate", "mix_sources", "token_output"]
    kept = [docs]
    for stage in list(stages.values())[:-1]:
        kept.append(written(stage(spark, kept[-1], SMALL), "test-stage"))
        assert kept[-1].columns == docs.columns and 0 < kept[-1].count()
    good = {r.doc_id: r.text for r in kept[1].collect()}
    assert all(not measures(t)[5] for t in good.values())
    assert {r.doc_id for r in kept[2].collect()} == {k for k, _, _, stays in brute(list(good.items()), 5, 80) if stays}
    assert {r.doc_id for r in kept[3].collect()} < {r.doc_id for r in kept[2].collect()}
    before, after = (sum(len(r.text.split()) for r in k.collect()) for k in kept[3:])
    assert abs(before - after) <= 30
    tokens = stages["token_output"](spark, kept[4], SMALL)
    assert tokens.count() == kept[4].count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()} == {r.doc_id for r in tokens.collect()}


def budgets(sizes: dict[str, int]) -> dict[str, int]:
    """Whole words that each source gives: shares by weight, what is above three times a source's size dealt out again."""
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))}
    total, target = sum(sizes.values()), {}
    while True:
        open_ = [s for s in sizes if s not in target]
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not full:
            return {s: math.floor(t + 1e-6) for s, t in (target | share).items()}
        target |= {s: 3 * sizes[s] for s in full}


def test_each_stage_against_independent_code(spark):
    """Decontamination by laying every item along every text, the mix by its budgets word by word, the tokens by the library."""
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    # Documents that hold an item, whole, with a substitution, and with too many.
    words = items[0][1].split()
    changed = [w if k != 4 else "other" for k, w in enumerate(words)]
    broken = [w if k % 3 else "other" for k, w in enumerate(words)]
    source = docs.where("source IS NOT NULL").first()["source"]
    planted = [(10**6 + k, " ".join(["before", *part, "after"]), "en", source, 0) for k, part in enumerate((words, changed, broken))]
    docs = docs.union(spark.createDataFrame(planted, docs.schema))
    rows = {r.doc_id: r for r in docs.collect()}
    clean = written(stages["decontaminate"](spark, docs, SMALL), "test-clean")
    hits = {d for d, _ in near_passages([(k, r.text) for k, r in rows.items()], items)}
    assert {10**6, 10**6 + 1} <= hits and 10**6 + 2 not in hits
    assert sorted(r.doc_id for r in clean.collect()) == sorted(rows.keys() - hits)
    sizes = Counter()
    for r in clean.collect():
        sizes[r.source] += len(r.text.split())
    mixed = written(stages["mix_sources"](spark, clean, SMALL), "test-mix")
    taken, copies = Counter(), defaultdict(list)
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
        copies[r.doc_id].append(r.text)
    want = budgets(sizes)
    assert set(taken) <= set(want) and all(abs(taken[s] - n) <= 1 for s, n in want.items())
    for k, texts in copies.items():
        whole = rows[k].text
        rounds = want[rows[k].source] // sizes[rows[k].source]
        assert texts.count(whole) in (rounds, rounds + 1) and len(texts) <= rounds + 1 and all(whole.startswith(t) for t in texts)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [[*library.encode(r.text, add_special_tokens=False).ids, 1] for r in mixed.collect()]
    tokens = stages["token_output"](spark, mixed, SMALL).collect()
    assert Counter((r.n_tokens, r.ids_crc32) for r in tokens) == Counter((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids)


def test_stages_with_odd_rows_and_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    odd = [(None, docs.first()["text"], "en", None, 3), (-1, None, None, "s", None), (-2, "", "en", "s", 0), (-3, "word and more of it " * 20_000, "en", "s", 1)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).union(docs.limit(5)).selectExpr("*", "1 AS key", "2 AS _gone", "3 AS _mix", "4 AS row", "5 AS node")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = written(stage(spark, rows, SMALL), "test-stage")
            assert rows.columns == docs.columns, name
        tokens = corpus_pipeline.token_output(spark, rows, SMALL)
        assert tokens.count() == rows.count()
    assert rows.count() == 0
