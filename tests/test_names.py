"""Keyword rules as one search against plain loops; detection and the catalogue of tiers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pricewright.functions.keywords import BOTH, Search, first_rules, output
from pricewright.functions.tiers import TIERS
from pricewright.operators import detection, reference, versions


def plain(tables, texts):
    """Each table's first rule that hits, by looking for every needle."""
    hit = lambda rule: any(all(p in texts[f] for p in n.split(BOTH)) for f, needles in rule.items() for n in needles)
    return [next((k for k, rule in enumerate(rules) if hit(rule)), None) for rules in tables.values()]


def test_search_against_loops():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abç", k=rng.randrange(0, n)))
    for _ in range(60):
        tables = {f"t{t}": [{f: [BOTH.join(word(4) for _ in range(rng.choice((1, 1, 2)))) or "a" for _ in range(rng.randrange(1, 3))] for f in rng.sample("xyz", rng.randrange(1, 3))} for _ in range(rng.randrange(0, 6))] for t in range(3)}
        search = Search(tables)
        for _ in range(30):
            texts = {f: word(12) for f in "xyz"}
            assert search.first(texts) == plain(tables, texts), (tables, texts)
    assert Search({}).first({"x": "a"}) == [] and Search({"t": [{"x": [""]}]}).first({"x": ""}) == [0]


def test_rows_keep_their_columns(spark):
    rows = spark.createDataFrame([(1, "ab", {"k": 1}), (2, None, None), (1, "ab", {"k": 1}), (3, "x" * 100_000 + "b", None)], "c0 int, found string, text0 map<string,int>")
    got = first_rules(rows, {"n": F.col("found")}, {"t": [{"n": ["ab"]}, {"n": ["b"]}], "none": []}, "r").withColumn("o", output(F.col("r.t"), ["first", "second"], "string"))
    assert got.columns == ["c0", "found", "text0", "r", "o"]
    assert sorted((r.c0, r.o, r.r.none) for r in got.collect()) == [(1, "first", None), (1, "first", None), (2, None, None), (3, "second", None)]
    assert first_rules(rows.limit(0), {"n": F.col("found")}, {"t": []}, "r").collect() == []


def plain_detected(folder, file, tag, title):
    folder, file, tag, title = (x or "" for x in (folder, file, tag, title))
    joint, upper = f"{folder} {file} {tag} {title}".upper(), folder.upper()
    make = next((m for m, a, b in detection.MAKES if any(x in joint for x in a) or any(x in upper for x in b)), None)
    make = make or (detection.DEFAULT_MAKE if folder in detection.OTHER_FOLDERS else folder)
    model = next((m for n, m in detection.MODELS.get(make, ()) if any(x in joint for x in n.split("|"))), tag or detection.DEFAULT_MODEL)
    trim = next((t for n, t in detection.TRIMS if any(x in f"{title} {tag}".upper() for x in n)), detection.DEFAULT_TRIM)
    return make, model, trim


def test_detection_against_loops(spark):
    rows = [
        ("Alfa Romeo", "giulietta-1", "1.6 JTD", "Distinctive"), ("sahibindne ilan", "x", "", "temiz bmw 3 serisi m sport"), ("Desktop", "a3", "35 TFSI", "s line"), ("", "", "", ""), (None, None, None, None), ("Lada", "niva", "1.7", "ti"),
        ("alfa", "156", "GT", "x"), ("BMW", "ix3", "M50", "i serisi"), ("x", "VW Golf", "1.0", ""), ("Citroën", "c4", "", "Kia"), ("Mercedes", "a 180", "AMG", "super"), ("Audi", "tt", "r8", "q7 sprint"),
    ]
    df = spark.createDataFrame(rows + rows[:2], "folder string, file string, make string, title string")
    got = detection.detected(df, F.col("folder"), F.col("file"), F.col("make"), F.col("title"))
    assert got.columns == [*df.columns, "detected"]
    for r in got.collect():
        assert tuple(r.detected) == plain_detected(r.folder, r.file, r.make, r.title), r
    assert got.count() == len(rows) + 2


def test_tiers_by_first_rule(spark, tmp_path):
    assert len(TIERS) == 32
    cases = {
        ("Audi", "A6", "45 TFSI"): ("luxury", 9_200_000), ("audi", "A6", "40 TDI"): ("luxury", 7_200_000), ("Audi Sport", "A6", ""): ("standard", 2_100_000), ("Audi", "RS3", ""): ("exotic", 17_000_000), ("AUDI", "80", None): ("luxury", 2_100_000),
        ("Togg", "T10X", "V1"): ("standard", 1_850_000), ("Togg", "T10X", "Long"): ("standard", 2_300_000), ("Fiat", "Egea Cross", "1.4"): ("economy", 1_650_000), ("Volkswagen/VW", "Polo", ""): ("standard", 2_200_000), (None, None, None): ("standard", 2_100_000),
        ("BMW", "M2", ""): ("luxury", 12_500_000), ("BMW", "M4", ""): ("exotic", 18_000_000), ("Škoda", "Fabia", ""): ("standard", 1_500_000), ("Rolls-Royce", "x", "y"): ("exotic", 55_000_000), ("Range Rover", "Range Rover Velar", ""): ("luxury", 11_500_000),
    }
    df = spark.createDataFrame([(*k, "old") for k in cases], "make string, model string, variant string, tier string")
    folder = f"file://{tmp_path}/c"
    versions.publish(reference.catalogue(spark), folder)
    before = versions.read(spark, folder)
    c = F.col
    got = {(r.make, r.model, r.variant): (r.tier, r.base_price) for r in reference.classified(df.drop("tier"), before, c("make"), c("model"), c("variant")).collect()}
    assert got == cases
    other = spark.createDataFrame([(0, "is", "fiat", 0, None, "luxury", 5)], reference.SCHEMA)
    versions.publish(other, folder)
    now = reference.classified(df.drop("tier"), versions.read(spark, folder), c("make"), c("model"), c("variant"))
    assert {(r.tier, r.base_price) for r in now.where("make = 'Fiat'").collect()} == {("luxury", 5)} and reference.classified(df.limit(0).drop("tier"), before, c("make"), c("model"), c("variant")).count() == 0


def test_a_catalogue_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(reference, "MAX_RULES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        reference.classified(spark.range(1), reference.catalogue(spark), F.lit("a"), F.lit("b"), F.lit("c"))
