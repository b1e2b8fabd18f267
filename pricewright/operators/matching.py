"""Comparables of a request: a fallback cascade over the snapshots.

Level 1 is the same segment with the same technical data, level 2 the variant in
the years around, level 3 the whole model two years around, level 4 nothing.  What a
level offers depends on few names and a year, not on the request: the first
snapshots of each such key are ranked once, on the side of the snapshots, and a
request looks up three keys.  The first level with enough listings stands.  Among the
snapshots of a key the order is by listings, year, variant and id, so the result does
not depend on how rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.config import DEFAULT, PricingConfig
from pricewright.functions.numbers import clamp
from pricewright.functions.text import known_variant

TOP = 10
POINTS = (("p5", 0.85), ("p35", 0.92), ("p50", 1.0), ("p60", 1.02), ("p95", 1.15))


#: What matching takes from a snapshot.
SNAP = ("n", "year", "p5", "p35", "p50", "p60", "p95", "median_mileage", "decay", "decay_source", "snapshot_id")
NAMES = ("make", "model", "variant", "trim", "body", "fuel", "transmission")
#: Years around a request by level; the key of a request, or snapshot, of any variant.
YEARS, ANY = {1: 0, 2: 1, 3: 2}, "\x01"


def offers(snapshots: DataFrame) -> DataFrame:
    """(make, model, key, asked, snaps1, snaps2, snaps3): the first snapshots, in order, of each key on each level; null for none.

    ``key`` is a variant or ANY, and ``asked`` the year of a request.  A snapshot
    stands under 13 keys; no more than TOP of a key go on.
    """
    keys = [f"struct({level} AS level, {key} AS key, year + ({d}) AS asked)" for level, years in YEARS.items() for d in range(-years, years + 1) for key in (("variant", f"'{ANY}'") if level < 3 else (f"'{ANY}'",))]
    snap = F.struct(*SNAP, *(F.lower(F.trim(F.coalesce(c, F.lit("")))).alias(f"low_{c}") for c in NAMES))
    rows = snapshots.select("make", "model", "variant", snap.alias("snap"), F.explode(F.expr(f"array({', '.join(keys)})")).alias("k")).select("make", "model", "variant", "snap", "k.*")
    order = [F.col("snap.n").desc(), F.col("snap.year").desc(), F.col("variant").asc_nulls_last(), F.col("snap.snapshot_id")]
    place = Window.partitionBy("level", "make", "model", "key", "asked").orderBy(*order)
    rows = rows.where("key IS NOT NULL").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= TOP).where("level > 1 OR rank = 1")
    lists = {level: F.collect_list(F.when(F.col("level") == level, F.struct("rank", "snap"))) for level in YEARS}
    snaps = {f"snaps{level}": F.transform(F.array_sort(f"_l{level}"), lambda x: x["snap"]) for level in YEARS}
    found = rows.groupBy("make", "model", "key", "asked").agg(*(x.alias(f"_l{level}") for level, x in lists.items()))
    return found.select("make", "model", "key", "asked", *(F.when(F.size(x) > 0, x).alias(name) for name, x in snaps.items()))


def offered(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The requests with the snapshots of their keys on each level, in arrays ``snaps1`` to ``snaps3``; null for none."""
    found = offers(snapshots).select(*(F.col(c).alias(f"_{c}") for c in ("make", "model", "key", "asked", "snaps1", "snaps2", "snaps3")))
    own = requests.withColumn("_variant", F.coalesce(F.trim(known_variant(F.col("variant"))), F.lit(ANY)))
    names = (F.trim(own["make"]) == F.col("_make")) & (F.trim(own["model"]) == F.col("_model")) & (own["year"] == F.col("_asked"))
    rows = own.join(found.drop("_snaps3").where("_snaps1 IS NOT NULL OR _snaps2 IS NOT NULL"), names & (F.col("_variant") == F.col("_key")), "left").drop("_make", "_model", "_key", "_asked")
    rows = rows.join(found.where(F.col("_key") == ANY).drop("_snaps1", "_snaps2"), names, "left").drop("_make", "_model", "_key", "_asked", "_variant")
    return rows.withColumnsRenamed({f"_snaps{level}": f"snaps{level}" for level in YEARS})


def candidates(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(request_id, level, rank, s_...): the ranked snapshots that each level offers a request."""
    rows = offered(requests.select("request_id", "make", "model", "variant", "year"), snapshots)
    levels = F.array_compact(F.array(*(F.when(F.col(f"snaps{level}").isNotNull(), F.struct(F.lit(level).alias("level"), F.col(f"snaps{level}").alias("snaps"))) for level in YEARS)))
    rows = rows.select("request_id", F.explode(levels).alias("l")).select("request_id", "l.level", F.posexplode("l.snaps").alias("rank", "s"))
    return rows.select("request_id", "level", (F.col("rank") + 1).alias("rank"), *(F.col(f"s.{c}").alias(f"s_{c}") for c in SNAP))


def _exact(snap: Column) -> Column:
    """Whether the request's data are all given and equal to the snapshot's."""
    out = F.lit(True)
    for name in NAMES:
        own = F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))
        out = out & (own == snap[f"low_{name}"])
        if name in ("variant", "body", "fuel", "transmission"):
            out = out & (own != "")
    return out


def growth(snaps: str, default: float) -> Column:
    """Yearly price ratio between the first and last year of ranked snapshots, if it is plausible.

    Of a year's snapshots the last one counts.
    """
    # One text, so that the rule is one expression to Spark and to the reader.
    known = f"filter({snaps}, x -> x.p50 > 0)"
    low, high = f"array_min(transform({known}, x -> x.year))", f"array_max(transform({known}, x -> x.year))"
    last = lambda year: f"CAST(element_at(filter({known}, x -> x.year = {year}), -1).p50 AS double)"
    rate = f"CASE WHEN size({snaps}) >= 2 AND {high} > {low} THEN pow({last(high)} / {last(low)}, 1D / ({high} - {low})) - 1 END"
    return F.expr(f"get(transform(array({rate}), r -> CASE WHEN r > 0.01D AND r < 0.20D THEN r ELSE {float(default)!r}D END), 0)")


def blended(snaps: str, year: str, rate: str) -> Column:
    """Percentiles of ranked snapshots, weighted by listings and distance in years: one pass that sums all of them."""
    price = lambda name, share: f"coalesce(nullif(CAST(x.{name} AS double), 0D), x.p50 * {float(share)!r}D)"
    weight = f"(CASE WHEN x.n > 0 THEN x.n ELSE 1 END * pow(0.92D, abs({year} - x.year)))"
    zero = ", ".join(f"0D AS {name}" for name, _ in POINTS)
    sums = ", ".join(f"a.{name} + {price(name, share)} * (1 + ({year} - x.year) * {rate}) * {weight} AS {name}" for name, share in POINTS)
    done = ", ".join(f"CAST(floor(a.{name} / a.w + 0.5D) AS long) AS {name}" for name, _ in POINTS)
    return F.expr(f"aggregate({snaps}, struct(0D AS w, {zero}), (a, x) -> struct(a.w + {weight} AS w, {sums}), a -> struct({done}))")


def matched(requests: DataFrame, snapshots: DataFrame, config: PricingConfig = DEFAULT) -> DataFrame:
    """The requests with level, n, p5..p95, median_mileage, decay, base_confidence, snapshot_id and growth."""
    c = F.col
    rows = offered(requests, snapshots)
    total = lambda level: F.expr(f"aggregate(snaps{level}, 0L, (a, x) -> a + x.n)")
    first = F.get("snaps1", F.lit(0))
    level = F.when((first["n"] >= 5) & _exact(first), 1).when(total(2) >= 5, 2).when(total(3) >= 3, 3).otherwise(4)
    rows = rows.withColumn("level", level)
    rows = rows.withColumn("snaps", F.when(c("level") == 1, c("snaps1")).when(c("level") == 2, c("snaps2")).when(c("level") == 3, c("snaps3"))).drop("snaps1", "snaps2", "snaps3")
    rows = rows.withColumns({"n": F.coalesce(F.expr("aggregate(snaps, 0L, (a, x) -> a + x.n)"), F.lit(0).cast("long")), "growth": F.when(c("level").isin(2, 3), growth("snaps", config.default_growth))})
    rows = rows.withColumn("_points", F.when(c("level").isin(2, 3), blended("snaps", "year", "growth")))
    top, last = F.get("snaps", F.lit(0)), F.element_at("snaps", -1)
    points = {name: F.when(c("level") == 1, top[name].cast("long")).otherwise(c("_points")[name]) for name, _ in POINTS}
    base = F.when(c("level") == 1, clamp(95 + F.floor(c("n") / 12), 83, 99)).when(c("level") == 2, clamp(78 + F.floor(c("n") / 20), 76, 88)).when(c("level") == 3, clamp(65 + F.floor(c("n") / 25), 62, 78)).otherwise(0)
    facts = {"median_mileage": last["median_mileage"], "decay": last["decay"], "decay_source": last["decay_source"], "base_confidence": base.cast("int"), "snapshot_id": top["snapshot_id"], "n_snapshots": F.size("snaps")}
    return rows.withColumns(points | facts).drop("snaps", "_points")
