"""Imports with a ledger: what becomes of each row, and what running again changes."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pricewright.operators import audit, ledger, versions

HEAD = "line long, brand string, Brand string, model string, variant string, package string, year string, driveType string, doors string, horsepower string, price string"
ROWS = [
    (1, "Audi", None, "A3", "1.6", "", "2020", None, "4", "100", "1000"), (2, "", "Audi", "A3", "1.6", "S Line", "2020", "4x4", "5", "110", "2000"), (3, "Audi", None, "A3", "1.6", None, "2020", "4x4", "3", "120", "0"),
    (4, None, None, "A3", "1.6", None, "2020", None, None, None, "5"), (5, "BMW", None, "X5", "3.0", None, "x", None, None, None, "5"), (6, "BMW", None, "X5", "3.0", None, "2021", None, None, None, "700000"),
]


def tables(spark, folder):
    at = versions.head(spark, folder)
    return at, {t: sorted(map(str, versions.read(spark, folder, t, at).collect())) for t in ("names", "specs", "prices", "ledger")}


def outcomes(spark, folder):
    return {(r.import_id, r.line): r.outcome for r in versions.read(spark, folder, "ledger").collect()}


def test_importing_twice_changes_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/i"
    rows = spark.createDataFrame(ROWS, HEAD)
    ledger.run(rows, folder, "one")
    assert outcomes(spark, folder) == {("one", 1): "created", ("one", 2): "created", ("one", 3): "updated", ("one", 4): "rejected", ("one", 5): "rejected", ("one", 6): "created"}
    first = tables(spark, folder)
    ledger.run(rows, folder, "one")
    assert tables(spark, folder) == first
    spec = {(r.make, r.package): r for r in ledger.chain(spark, folder).collect()}
    a = spec["Audi", None]
    # The last line's facts, the first line's drive; 0 counts as not given.
    assert (a.doors, a.market_average, a.drive, a.horsepower, a.body, json.loads(a.regional)["Ankara"]) == (3.0, 500_000.0, "Önden Çekiş", 120.0, "Sedan", 0.98)
    assert spec["Audi", "S Line"].drive == "4x4" and spec["Audi", "S Line"].horsepower == 120.0 and spec["BMW", None].market_average == 700_000.0
    assert versions.read(spark, folder, "names").groupBy("kind").count().orderBy("kind").rdd.map(tuple).collect() == [("body", 1), ("drive", 2), ("fuel", 1), ("make", 2), ("model", 2), ("package", 1), ("transmission", 1), ("variant", 2)]


def test_a_corrected_row_is_imported_alone(spark, tmp_path):
    folder = f"file://{tmp_path}/i"
    ledger.run(spark.createDataFrame(ROWS, HEAD), folder, "one")
    fixed = [*ROWS[:4], (5, "BMW", None, "X5", "3.0", None, "2022", None, None, None, "5"), ROWS[5], (7, *ROWS[5][1:])]
    ledger.run(spark.createDataFrame(fixed, HEAD), folder, "one")
    got = versions.read(spark, folder, "ledger")
    # The corrected row beside the one it corrects; row 7 is row 6 again, and in the ledger.
    assert got.count() == 7 and {r.outcome for r in got.where("line = 5").collect()} == {"rejected", "created"}
    ledger.run(spark.createDataFrame(ROWS[5:], HEAD), folder, "two")
    assert outcomes(spark, folder)["two", 6] == "updated" and versions.read(spark, folder, "specs").count() == 4
    ledger.run(spark.createDataFrame([], HEAD), folder, "three")
    assert versions.read(spark, folder, "ledger").count() == 8


def test_planted_differences_are_found(spark):
    base = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("a"), F.when(F.col("id") % 5 != 0, F.col("id") * 2).alias("b"))
    stored = base.withColumn("a", F.when(F.col("k") == 17, 99).otherwise(F.col("a"))).withColumn("b", F.when(F.col("k").isin(20, 21), F.lit(-1)).otherwise(F.col("b"))).where("k <> 4000")
    layers = {"match": base.select("k", "a"), "stored": stored, "again": base}
    found = sorted((r.k, r.field, r.left, r.right, r.left_value, r.right_value) for r in audit.differences(layers, "k", ["a", "b"], 64).collect())
    missing = [(4000, "a", "match", "stored", "3", "no row"), (4000, "a", "stored", "again", "no row", "3"), (4000, "b", "stored", "again", "no row", None)]
    changed = [(17, "a", "match", "stored", "3", "99"), (17, "a", "stored", "again", "99", "3"), (20, "b", "stored", "again", "-1", None), (21, "b", "stored", "again", "-1", "42")]
    assert sorted(found, key=str) == sorted(missing + changed, key=str)
    assert {r.field: (r.n_equal, r.n_probes) for r in audit.summary(layers, "k", ["a", "b"]).collect()} == {"a": (4998, 5000), "b": (4997, 5000)}
    same = {"x": base, "y": base.repartition(7)}
    assert audit.differences(same, "k", ["a", "b"]).count() == 0
    assert {tuple(r) for r in audit.summary({"x": base.limit(0), "y": base.limit(0)}, "k", ["a"]).collect()} == {("a", 0, 0)}
    with pytest.raises(ValueError, match="in common"):
        audit.differences({"x": base.select("k", "a"), "y": base.select("k", "b")}, "k", ["a", "b"])
