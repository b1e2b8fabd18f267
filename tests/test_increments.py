"""Counted state after batches of changes against one full run; statistics against arrays."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricewright.functions import numbers
from pricewright.operators import increments as I
from pricewright.operators import snapshots

LISTING = "listing_id int, make string, model string, variant string, year int, price long"


def steps(rng, n=120):
    """Tables of listings that come, change and go from step to step; in the last one a make is gone."""
    rows, out = {}, [{}]
    for step in range(4):
        for k in range(n):
            if rng.random() < 0.4:
                rows[k] = (rng.choice(["A", "B", "C#/ x"]), rng.choice("mn"), rng.choice(["", "v"]), 2000 + rng.randrange(2), rng.randrange(1, 9) * 1000)
            elif rng.random() < 0.2:
                rows.pop(k, None)
        if step == 3:
            rows = {k: v for k, v in rows.items() if v[0] != "B"}
        out.append(dict(rows))
    return out


def test_state_after_batches_is_that_of_a_full_run(spark, tmp_path):
    tables = [spark.createDataFrame([(k, *v) for k, v in t.items()], LISTING) for t in steps(random.Random(4))]
    state, prices = f"file://{tmp_path}/s", f"file://{tmp_path}/p"
    for batch in range(1, 5):
        delta = I.changes(tables[batch - 1], tables[batch], ["listing_id"], [*I.SPEC, "price"])
        if batch == 2:  # cut short: one partition is merged, then the batch runs again
            I.merge(delta.where("make = 'A'"), state, I.SPEC_STATE, "make", batch)
        for _ in range(1 + (batch == 3)):
            I.update_spec_prices(delta, state, prices, batch)
        want = Counter((r.make, r.model, r.variant, r.year, r.price) for r in tables[batch].collect())
        got = {(r.make, r.model, r.variant, r.year, r.price): r.times for r in I.state(spark, state, I.SPEC_STATE).collect()}
        assert got == want
        full = I.spec_prices(tables[batch].groupBy(*I.SPEC, "price").agg(F.count("*").alias("times")))
        columns = full.columns
        assert sorted(map(tuple, I.stored_prices(spark, prices).select(*columns).collect())) == sorted(map(tuple, full.collect()))
    assert "B" not in {r.make for r in I.stored_prices(spark, prices).collect()}


def test_only_touched_partitions_are_written(spark, tmp_path):
    state = f"file://{tmp_path}/s"
    delta = lambda *rows: spark.createDataFrame(rows, "make string, model string, variant string, year int, price long, times long")
    I.merge(delta(("A", "m", "", 1, 5, 2), ("B", "m", "", 1, 5, 1)), state, I.SPEC_STATE, "make", 1)
    files = lambda make: sorted(p.name for p in Path(tmp_path, "s", f"make={make}").glob("*.parquet"))
    a, b = files("A"), files("B")
    I.merge(delta(("A", "m", "", 1, 5, -1)), state, I.SPEC_STATE, "make", 2)
    assert files("B") == b and files("A") != a
    with pytest.raises(Exception, match="not there"):
        I.merge(delta(("A", "m", "", 1, 5, -2)), state, I.SPEC_STATE, "make", 3)
    assert {(r.make, r.times) for r in I.state(spark, state, I.SPEC_STATE).collect()} == {("A", 1), ("B", 1)}


def test_changes(spark):
    old, new = ([(1, "A", "m", "", 1, 5), (2, "A", "m", "", 1, 6), (3, "A", None, "", 1, 6)], [(1, "A", "m", "", 1, 5), (2, "A", "m", "", 1, 7), (4, "A", "m", "", 1, 6)])
    found = I.changes(spark.createDataFrame(old, LISTING), spark.createDataFrame(new, LISTING), ["listing_id"], ["model", "price"])
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("m", 7, 1), (None, 6, -1)], key=str)  # 6 went with one listing and came with another


def test_statistics_by_ranks_against_arrays(spark):
    rng = random.Random(9)
    rows = []
    for s, n in enumerate((0, 1, 2, 3, 4, 5, 8, 17, 60, 400)):
        for _ in range(n):
            price = rng.choice([None, 1, 111, 49_999, 50_000, 150_000_000, 999_999_999, rng.randrange(900_000, 1_100_000), rng.randrange(900_000, 1_100_000), rng.randrange(900_000, 1_100_000), 1_000_000])
            rows.append((f"{len(rows):05d}", f"m{s}", "b", None if s == 5 else "v", 2020, price, rng.choice([None, 0, -5, 10_000, rng.randrange(1, 200_000)]), rng.random() < 0.1))
    df = spark.createDataFrame(rows, "listing_id string, make string, model string, variant string, year int, price long, mileage long, is_damaged boolean").cache()
    km = F.when(F.col("mileage") > 0, F.col("mileage"))
    arrays = df.where("NOT is_damaged").withColumn("km", km).groupBy("make").agg(
        F.count("*").alias("n"), numbers.without_outliers(F.array_sort(F.collect_list("price"))).alias("kept"), F.array_sort(F.collect_list("km")).alias("kms"), (numbers.slope("price", "km") * 10_000.0).alias("slope"),
    ).where(F.size("kept") > 0)
    want = arrays.select(
        "make", "n", F.size("kept").alias("n_kept"), *(numbers.at_rank(F.col("kept"), p).alias(k) for k, p in snapshots.SHARES.items()), F.array_min("kept").alias("min_price"), F.array_max("kept").alias("max_price"),
        F.size("kms").alias("n_mileages"), numbers.at_rank(F.col("kms"), 0.5).alias("median_mileage"), numbers.half_up(numbers.total(F.transform("kms", lambda x: x.cast("double"))) / F.nullif(F.size("kms"), F.lit(0))).alias("mean_mileage"),
        "slope", numbers.spread(F.col("kept")).alias("spread"),
    )
    counts = snapshots.counted(df)
    got = snapshots.statistics(counts)
    names = want.columns
    assert [tuple(r) for r in got.select(*names).orderBy("make").collect()] == [pytest.approx(tuple(r)) for r in want.orderBy("make").collect()]
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert snapshots.statistics(counts.limit(0)).count() == 0


def test_sums_of_a_large_segment_do_not_overflow(spark):
    counts = spark.createDataFrame([("A", "b", "c", 2020, 140_000_000 + 100_000 * k, 1_900_000 - 100_000 * k, 3_000_000_000) for k in range(6)], "make string, model string, variant string, year int, price long, mileage long, times long")
    s = snapshots.statistics(counts).first()
    assert (s.n, s.p50, s.median_mileage) == (18_000_000_000, 140_300_000, 1_700_000) and s.slope == pytest.approx(-10_000)
