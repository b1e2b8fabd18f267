"""Layers of the same results held against each other, by ranges of keys.

Each layer is dealt to ranges by a hash of its key, and a range is summed up to a count
and a digest that does not depend on the order of rows.  Layers agree in a range whose
digests agree; only rows of the other ranges are joined and compared field by field.
Layers need not have all fields: each pair of neighbours that have a field is compared
in it.  A row that a layer lacks differs in every field.  Layers are read several times
each: those that are costly to make are best written first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of keys.
RANGES = 4096


def _range(key: str, ranges: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(ranges))


def _shared(layers: Mapping[str, DataFrame], fields: Sequence[str]) -> list[tuple[str, str, list[str]]]:
    """Neighbouring layers with the fields that both have; a layer without any is passed over for the next."""
    pairs = []
    names = list(layers)
    for k, left in enumerate(names):
        open_ = [f for f in fields if f in layers[left].columns]
        for right in names[k + 1 :]:
            both = [f for f in open_ if f in layers[right].columns]
            if both:
                pairs.append((left, right, both))
            open_ = [f for f in open_ if f not in both]
    return pairs


def digests(layer: DataFrame, key: str, fields: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """(range, rows, digest): a sum over hashes of key and fields, nulls told from other values."""
    cells = [F.xxhash64(F.lit(k), F.coalesce(F.col(f).cast("string"), F.lit("\x00"))) for k, f in enumerate(fields)]
    row = F.xxhash64(key, *cells)
    # Two halves, each of which many rows cannot overflow.
    halves = F.struct(F.sum(F.shiftright(row, 32)).alias("high"), F.sum(row.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"))
    return layer.groupBy(_range(key, ranges).alias("range")).agg(F.count("*").alias("rows"), halves.alias("digest"))


def differences(layers: Mapping[str, DataFrame], key: str, fields: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """(key, field, left, right, left_value, right_value) of all that differs; keys are unique in each layer."""
    out = None
    for left, right, both in _shared(layers, fields):
        a, b = (digests(layers[x], key, both, ranges) for x in (left, right))
        a, b = a.select("range", F.struct("rows", "digest").alias("a")), b.select(F.col("range").alias("other"), F.struct("rows", "digest").alias("b"))
        wrong = a.join(b, F.col("range") == F.col("other"), "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(F.coalesce("range", "other").alias("_range"))
        side = lambda x, name: layers[x].withColumn("_range", _range(key, ranges)).join(wrong, "_range", "left_semi").select(F.col(key).alias(f"{name}_key"), F.struct(*both).alias(name))  # noqa: B023, E731
        rows = side(left, "a").join(side(right, "b"), F.col("a_key") == F.col("b_key"), "full_outer")
        text = lambda name, f: F.when(F.col(name).isNull(), "no row").otherwise(F.col(name)[f].cast("string"))
        cells = [F.struct(F.lit(f).alias("field"), text("a", f).alias("left_value"), text("b", f).alias("right_value"), (F.col("a").isNull() | F.col("b").isNull() | ~F.col("a")[f].eqNullSafe(F.col("b")[f])).alias("differs")) for f in both]
        found = rows.select(F.coalesce("a_key", "b_key").alias(key), F.explode(F.array(*cells)).alias("c")).where("c.differs")
        found = found.select(key, "c.field", F.lit(left).alias("left"), F.lit(right).alias("right"), "c.left_value", "c.right_value")
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no two layers have a field in common")
    return out


def summary(layers: Mapping[str, DataFrame], key: str, fields: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """(field, n_equal, n_probes): on how many keys all layers that have a field agree in it."""
    keys = None
    for layer in layers.values():
        keys = layer.select(key) if keys is None else keys.unionByName(layer.select(key))
    total = keys.distinct().agg(F.count("*").alias("n_probes"))
    wrong = differences(layers, key, fields, ranges).groupBy("field").agg(F.countDistinct(key).alias("n_wrong"))
    rows = total.select("n_probes", F.explode(F.array(*map(F.lit, fields))).alias("of"))
    return rows.join(wrong, F.col("of") == F.col("field"), "left").select(F.col("of").alias("field"), (F.col("n_probes") - F.coalesce("n_wrong", F.lit(0))).alias("n_equal"), "n_probes")
