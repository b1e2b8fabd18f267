"""What the operators share: scratch folders of queries side by side, checksums, and batches."""

from __future__ import annotations

import random
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa

from pricewright.llm import queries
from pricewright.llm.shared import crc_after, gathered

SMALL = "/root/testdata/sf0.001"


def test_queries_side_by_side(spark):
    """Queries in threads of one session do not delete each other's intermediate data."""
    names = ("op6_near_dedup", "op7_warc", "op10_toxicity", "op13_collocations")
    run = lambda name: sorted((tuple(r) for r in queries.queries()[name](spark, SMALL).collect()), key=str)
    alone = {name: run(name) for name in names}
    with ThreadPoolExecutor(len(names)) as pool:
        together = dict(zip(names, pool.map(run, names), strict=True))
    assert together == alone


def test_crc_of_joint_strings():
    rng = random.Random(3)
    pairs = [(rng.randbytes(rng.randrange(0, 50)), rng.randbytes(rng.choice([0, 1, 5, 127, 128, 129, 70_000]))) for _ in range(60)]
    left, right = (np.array([zlib.crc32(x) for x in xs], np.uint32) for xs in zip(*pairs, strict=True))
    got = crc_after(left, right, np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]
    none = np.zeros(0, np.uint32)
    assert crc_after(none, none, np.zeros(0, np.int64)).size == 0


def test_batches_gathered_by_bytes():
    texts = [["aa", None], [], ["bbbb"], ["c" * 9], [None], ["", "dd"]]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["text"]) for x in texts]
    got = [b.column(0).to_pylist() for b in gathered(iter(batches), 0, 6)]
    assert got == [["aa", None, "bbbb"], ["c" * 9], [None, "", "dd"]]
    assert list(gathered(iter([]), 0, 6)) == []
