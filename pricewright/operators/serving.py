"""What the service reads: facets, dashboard figures, pages, searches, breakdowns, permissions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.functions.numbers import half_up

FACETS = ("variant", "package", "body", "fuel", "transmission")


def where_given(**values: object) -> Column:
    """Equality with every value that is given."""
    return reduce(lambda a, b: a & b, (F.col(k) == v for k, v in values.items() if v is not None), F.lit(True))


def facets(specs: DataFrame, base: Mapping[str, object], chosen: Mapping[str, object] | None = None, names: Sequence[str] = FACETS) -> DataFrame:
    """(facet, choices, auto): what is left to choose, each facet under the choices before it.

    One scan of the base selection; ``auto`` is the choice where there is one only.
    """
    chosen = chosen or {}
    rows = specs.where(where_given(**base))
    sets, under = [], F.lit(True)
    for name in names:
        sets.append(F.array_sort(F.collect_set(F.when(under, F.col(name)))).alias(name))
        if chosen.get(name) is not None:
            under = under & (F.col(name) == chosen[name])
    found = rows.agg(*sets).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("facet", "choices"))
    return found.withColumn("auto", F.when(F.size("choices") == 1, F.element_at("choices", 1)))


def facet_counts(specs: DataFrame, base: Mapping[str, object], chosen: Mapping[str, object] | None = None, names: Sequence[str] = FACETS, top: int = 50) -> DataFrame:
    """(facet, choice, n, rank, n_choices): the most frequent choices of each facet under what is chosen in the others.

    One scan: a row counts for each facet whose other facets it fits, as grouping
    sets would have it.  Counts are summed before the shuffle, and a facet gives at
    most ``top`` rows, however many choices it has; equal counts go by choice.
    """
    chosen = {k: v for k, v in (chosen or {}).items() if v is not None}
    rows = specs.where(where_given(**base))
    fits = {name: F.coalesce(F.col(name) == value, F.lit(False)) for name, value in chosen.items()}
    counts = [F.when(reduce(lambda a, b: a & b, (x for name, x in fits.items() if name != facet), F.lit(True)), F.struct(F.lit(facet).alias("facet"), F.col(facet).cast("string").alias("choice"))) for facet in names]
    cells = rows.select(F.explode(F.array_compact(F.array(*counts))).alias("c")).select("c.*").where("choice IS NOT NULL")
    found = cells.groupBy("facet", "choice").agg(F.count("*").alias("n"))
    total = found.groupBy("facet").agg(F.count("*").alias("n_choices"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("facet").orderBy(F.col("n").desc(), "choice"))).where(F.col("rank") <= top)
    return ranked.join(total, "facet")


def choices(rows: DataFrame, levels: Sequence[str]) -> DataFrame:
    """(level, the levels' names, n, n_below): every name under the names above it, with its rows and how many names stand below.

    Names are null below a row's level, and a row without a name counts above it
    only.  Each level is counted from the one below, so the table is read once for the
    deepest and what is shuffled after that are names.
    """
    counted = rows.groupBy(*levels).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("n_below"))
    out = None
    for depth in range(len(levels), 0, -1):
        here, below = list(levels[:depth]), levels[depth:]
        shown = counted.where(F.col(here[-1]).isNotNull()).select(F.lit(depth).alias("level"), *here, *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in below), "n", "n_below")
        out = shown if out is None else out.unionByName(shown)
        counted = counted.groupBy(*here[:-1]).agg(F.sum("n").alias("n"), F.count(here[-1]).alias("n_below"))
    return out


def dashboard(evaluations: DataFrame, consignments: DataFrame) -> DataFrame:
    """One row of counts by status and the rounded mean valuation, 0 without any."""
    mean = F.coalesce(half_up(F.sum("estimated_value") / F.nullif(F.count("*"), F.lit(0))), F.lit(0))
    first = evaluations.agg(F.count("*").alias("n_evaluations"), mean.alias("average_valuation"))
    status = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("PENDING", "APPROVED", "COMPLETED")]
    # Two tables of one row each.
    return first.join(consignments.agg(F.count("*").alias("n_consignments"), *status))


def page(rows: DataFrame, newest: str, key: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the newest rows; equal times by key."""
    out = rows.orderBy(F.col(newest).desc(), F.col(key))
    return (out.offset(offset) if offset else out).limit(limit)


def search(rows: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Rows that hold the query in one of the columns, in any case."""
    q = query.lower()
    return rows.where(reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c).cast("string")).contains(q), F.lit(False)) for c in columns)))


def search_terms(rows: DataFrame, terms: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows where any term occurs in any column."""
    return rows.where(reduce(lambda a, b: a | b, (F.coalesce(F.col(c).contains(t), F.lit(False)) for c in columns for t in terms)))


def breakdown(rows: DataFrame, key: str, member: str, top: int = 10) -> DataFrame:
    """Count, distinct members and the first of them, per key."""
    members = F.array_sort(F.collect_set(member))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.size(members).alias("n_members"), F.slice(members, 1, top).alias("members"))


def over_cap(rows: DataFrame, key: str, cap: int = 7) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > cap)


def having(rows: DataFrame, *levels: tuple[DataFrame, str, str]) -> DataFrame:
    """Rows with a chain of children: each level is (rows, own key, key of the level above)."""
    inner, key = None, None
    for child, own, parent in reversed(levels):
        if inner is not None:
            child = child.join(inner.select(F.col(key).alias("_k")).distinct(), child[own] == F.col("_k"), "left_semi")
        inner, key = child, parent
    return rows.join(inner.select(F.col(key).alias("_k")).distinct(), rows[levels[0][2]] == F.col("_k"), "left_semi")


def missing(rows: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Rows whose name no known row has, in any case."""
    return rows.join(known.select(F.lower(F.col(name)).alias("_k")).distinct(), F.lower(rows[name]) == F.col("_k"), "left_anti")


def permitted(granted: Column, required: Column) -> Column:
    """Whether all required permissions are granted; none required permits."""
    return F.size(F.array_except(F.coalesce(required, F.array().cast("array<string>")), F.coalesce(granted, F.array().cast("array<string>")))) == 0


# Penalty points by state of a part, for roof and bonnet and for the rest.
MAIN_PARTS = ("Motor Kaputu", "Tavan")
PART_POINTS = {"DEGISEN": (8, 4), "BOYALI": (5, 2), "LOKAL": (3, 1)}
FLAG_POINTS = {"chassis_action": 25, "heavy_damage": 35, "scratch_dent": 2, "cracked_glass": 1}
MOST_POINTS = 60


def damage_points(parts: Column, flags: Mapping[str, Column]) -> Column:
    """Penalty points of a map from part to state and of flags, 60 at most."""

    def points(entry: Column) -> Column:
        out = F.lit(0)
        for state, (main, other) in PART_POINTS.items():
            out = F.when(entry["value"] == state, F.when(entry["key"].isin(*MAIN_PARTS), main).otherwise(other)).otherwise(out)
        return out

    sum_ = F.coalesce(F.aggregate(F.map_entries(parts), F.lit(0), lambda a, e: a + points(e)), F.lit(0))
    for name, worth in FLAG_POINTS.items():
        if name in flags:
            sum_ = sum_ + F.when(F.coalesce(flags[name], F.lit(False)), worth).otherwise(0)
    return F.least(F.lit(MOST_POINTS), sum_)


def parts_in(parts: Column, state: str) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(parts, lambda k, v: v == state)))


def details(text: Column, schema: str) -> Column:
    """A JSON text as a struct; null where it cannot be read."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})
