"""Runs of listing pages into listings, quarantine and snapshots, from version to version.

A run parses its pages, judges every row, and merges what it found into the listings
of earlier runs.  A listing is valid or quarantined by its newest row, so it can change
sides; one that a run does not see stays as it is.  The quarantine keeps a row for each
source, listing and reason that ever occurred, with the first and last run.  Only
segments in which a counted listing came, went or changed are aggregated again; the
other snapshots are taken over.  All three tables are one version, so readers see a
run as a whole or not at all, and a run that repeats changes nothing but its version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewright.config import DEFAULT, PricingConfig
from pricewright.operators import listings as L
from pricewright.operators import mutations, normalize, snapshots, versions
from pricewright.sources import html

VALID, QUARANTINED = "VALID", "QUARANTINED"
KEY = ("source", "listing_id")
#: The same as sort key: with the ids first, few pairs of rows are compared beyond their first bytes.
BY_KEY = KEY[::-1]
FACTS = ("make", "model", "variant", "title", "year", "mileage", "price", "is_damaged", "status", "reason", "raw_make", "raw_model")
#: What a listing adds to its segment's statistics.
COUNTED = ("make", "model", "variant", "year", "mileage", "price", "is_damaged", "status")
LISTINGS = (
    "source string, listing_id string, make string, model string, variant string, title string, year int, mileage long, price long, is_damaged boolean, status string, reason string, raw_make string, raw_model string, "
    "first_run long, last_run long, action string, was struct<make: string, model: string, variant: string, year: int>, counts boolean"
)
QUARANTINE = "source string, listing_id string, reason string, raw_make string, raw_model string, title string, price long, first_run long, last_run long"


def judged(pages: DataFrame, body: str = "body", page: str = "page", source: str = "html", config: PricingConfig = DEFAULT) -> DataFrame:
    """(source, listing_id, FACTS): every listing row of (page, body) rows, the page's path being make/model.html.

    A page that cannot be parsed gives one quarantined row under the name of its file.
    """
    c = F.col
    parts = F.split(page, "/")
    file = F.regexp_replace(F.element_at(parts, -1), r"(?i)\.html?$", "")
    named = pages.select(F.coalesce(F.when(F.size(parts) > 1, F.element_at(parts, -2)), F.lit("")).alias("folder"), file.alias("file"), F.col(body).alias("body"))
    # All rows of a page have its make and model.
    found = html.rows_by_class(named.withColumn("name", normalize.named(c("folder"), c("file"))), "body", ["folder", "file", "name"])
    tag = F.coalesce(F.nullif(F.trim("tag"), F.lit("")), c("file"))
    text = F.concat_ws(" ", "title", "tag", "location")
    raw = found.select(
        F.lit(source).alias("source"), "listing_id", c("folder").alias("make"), c("file").alias("model"), tag.alias("variant"), "title",
        c("year_text").alias("year"), c("mileage_text").alias("mileage"), c("price_text").alias("price"), text.alias("text"), "name", "error",
    )
    # Damage is looked for in all of the row's texts, names in the title alone.
    rows = L.judged(raw, config, damage=c("text"), keep=["error"], name=c("name"))
    # Rows and unreadable pages are told apart in one pass: of two, each would parse all pages.
    of_page = {
        "listing_id": F.concat(F.lit("ERROR_"), "raw_model"), "make": F.lit(""), "model": F.lit(""), "title": F.concat(F.lit("unreadable page: "), "raw_model"),
        "is_damaged": F.lit(False), "reason": F.concat(F.lit("PARSER_EXCEPTION: "), "error"),
    }
    broken = c("error").isNotNull()
    rows = rows.withColumns({name: F.when(broken, value).otherwise(c(name)) for name, value in of_page.items()} | {name: F.when(~broken, c(name)) for name in ("year", "mileage", "price")} | {"variant": F.when(broken, "").otherwise(F.coalesce("variant", F.lit("")))})
    return rows.withColumn("status", F.when(F.col("reason").isNull(), VALID).otherwise(QUARANTINED)).select(*KEY, *FACTS)


def one_each(rows: DataFrame) -> DataFrame:
    """One row per listing of a run: a quarantined one before valid ones, and the first of the total order."""
    return L.first_of(rows, BY_KEY, [F.col("status"), F.col("reason").asc_nulls_last(), *L.total_order(rows, "price", "mileage")])


def merged(old: DataFrame | None, new: DataFrame, run: int) -> DataFrame:
    """The listings after a run, with what became of each: ``action``, and the segments it left (``was``) and ``counts`` in.

    Actions are created, updated, quarantined (from valid), restored (to valid)
    and seen; null for a listing that the run did not see.
    """
    pack = lambda rows, name: rows.select(*(F.col(k).alias(f"{name}_{k}") for k in KEY), F.struct(*(F.col(f) for f in rows.columns)).alias(name))
    if old is None:  # nothing to join with
        both = pack(new, "n").withColumn("o", F.lit(None).cast(T.StructType.fromDDL(LISTINGS)))
    else:
        both = pack(old, "o").join(pack(new, "n"), (F.col("o_listing_id") == F.col("n_listing_id")) & (F.col("o_source") == F.col("n_source")), "full_outer")
    o, n = F.col("o"), F.col("n")
    differs = lambda names: _any(~o[f].eqNullSafe(n[f]) for f in names)
    before = o.isNotNull() & (o["status"] == VALID) & ~o["is_damaged"]
    after = n.isNotNull() & (n["status"] == VALID) & ~n["is_damaged"]
    moved = n.isNotNull() & (o.isNull() | differs(COUNTED))
    action = F.when(n.isNull(), None).when(o.isNull(), "created").when((o["status"] == VALID) & (n["status"] == QUARANTINED), "quarantined").when((o["status"] == QUARANTINED) & (n["status"] == VALID), "restored")
    action = action.when(differs(FACTS), "updated").otherwise("seen")
    fact = lambda f: F.when(n.isNotNull(), n[f]).otherwise(o[f]).alias(f)
    number = F.lit(run).cast("long")
    return both.select(
        *(fact(f) for f in (*KEY, *FACTS)), F.coalesce(o["first_run"], number).alias("first_run"), F.when(n.isNotNull(), number).otherwise(o["last_run"]).alias("last_run"), action.alias("action"),
        F.when(moved & before, F.struct(*(o[k].alias(k) for k in snapshots.SEGMENT))).alias("was"), (moved & after).alias("counts"),
    )


def _any(flags) -> Column:
    out = F.lit(False)
    for flag in flags:
        out = out | flag
    return out


def touched(listings: DataFrame) -> DataFrame:
    """Segments whose statistics a run changes: those that listings left, came to, or changed in."""
    here = F.when(F.col("counts"), F.struct(*snapshots.SEGMENT))
    return listings.select(F.explode(F.array_compact(F.array("was", here))).alias("s")).select("s.*").distinct()


def refreshed(served: DataFrame | None, listings: DataFrame, specs: DataFrame, config: PricingConfig = DEFAULT) -> DataFrame:
    """The served snapshots, with those of touched segments made anew or gone."""
    valid = listings.where(F.col("status") == VALID)
    if served is None:
        return snapshots.snapshots(valid, specs, config, ids=False)
    segments = touched(listings)
    fresh = snapshots.snapshots(valid.join(segments, list(snapshots.SEGMENT), "left_semi"), specs, config, ids=False)
    return served.join(segments, list(snapshots.SEGMENT), "left_anti").unionByName(fresh)


def quarantine(old: DataFrame | None, rows: DataFrame, run: int) -> DataFrame:
    """The quarantine after a run: known rows with new facts and last run, and those of new (source, listing, reason)."""
    number = F.lit(run).cast("long")
    bad = rows.where(F.col("status") == QUARANTINED).select(*KEY, "reason", "raw_make", "raw_model", "title", "price", number.alias("first_run"), number.alias("last_run"))
    if old is None:
        return L.first_of(bad, [*BY_KEY, "reason"], L.total_order(bad, *KEY, "reason"))
    return mutations.upsert(old, bad, [*BY_KEY, "reason"], ["raw_make", "raw_model", "title", "price", "last_run"]).select(*(x.split()[0] for x in QUARANTINE.split(", ")))


def run(pages: DataFrame, specs: DataFrame, folder: str, number: int, config: PricingConfig = DEFAULT, **options: str) -> versions.Pointer:
    """Merge a run into the version served in ``folder`` and serve the next one; again, should another writer come first.

    A version holds listings, quarantine and snapshots.  A run whose number has
    been merged already is left out, so a job may repeat it.
    """
    spark = pages.sparkSession

    def change(base: versions.Pointer | None):
        if base is not None and base.notes.get("run", -1) >= number:
            return None
        old, held, served = (None if base is None else versions.read(spark, folder, part, base) for part in ("listings", "quarantine", "snapshots"))
        read = lambda at, name: spark.read.parquet(f"{at}/{name}")
        return {
            "found": judged(pages, config=config, **options),
            "listings": lambda at: merged(old, one_each(read(at, "found")), number),
            "quarantine": lambda at: quarantine(held, read(at, "found"), number),
            "snapshots": lambda at: refreshed(served, read(at, "listings"), specs, config),
        }

    return versions.update(spark, folder, change, f"run{number}", {"run": number})
