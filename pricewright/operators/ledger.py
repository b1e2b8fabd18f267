"""Catalogue imports through names, specs and prices, with a ledger of every row.

An import has an id, and its rows are known by a digest of their cells.  A row whose
(import, digest) is in the ledger has been imported and is left out, so an import may
run again, whole or with corrected rows added, and changes nothing twice.  Every key is
made from the names on the way to it, so that runs agree on keys without looking them
up: make, model, variant and package hang on each other, and a spec on all of them.

Of lines for the same spec, and of those for the same variant's engine, the last stands;
the first one creates, the others update.  A spec that is updated keeps its drive, and
its price the regional factors.  Rows without make, model, variant or year are rejected.
Names, specs, prices and ledger are one version.  Lines are unique numbers.  Rows alike
in all cells are imported once; the ledger has one row for them, that of the last line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.config import REGIONAL_MULTIPLIERS
from pricewright.operators import imports, versions
from pricewright.operators.listings import first_of
from pricewright.operators.mutations import upsert

#: What a name hangs on.
PARENTS = {"make": None, "model": "make", "variant": "model", "package": "variant", "body": None, "fuel": None, "transmission": None, "drive": None}
ENGINE = ("engine_cc", "horsepower", "torque")
FACTS = ("doors", "seats", "consumption", "emission")
PRICE = ("market_average", "listing_average", "min_price", "max_price", "selling_days")
NAMES = f"kind string, id string, parent_id string, name string, {', '.join(f'{c} double' for c in ENGINE)}"
SPECS = f"spec_id string, year int, {', '.join(f'{k}_id string' for k in PARENTS)}, {', '.join(f'{c} double' for c in FACTS)}"
PRICES = f"spec_id string, {', '.join(f'{c} double' for c in PRICE)}, regional string"
LEDGER = "import_id string, digest string, line long, outcome string, spec_id string"


def path_of(kind: str) -> list[str]:
    """The names from the root to a kind's own."""
    return [*(path_of(PARENTS[kind]) if PARENTS[kind] else []), kind]


def key(kind: str) -> Column:
    """A name's key, from the names on the way to it; null for an empty name."""
    return F.when(F.col(kind) != "", F.sha2(F.concat_ws("\x01", F.lit(kind), *path_of(kind)), 256))


def digested(rows: DataFrame) -> DataFrame:
    """(line, digest) of rows with any headers, told apart by place where they differ in case only."""
    slots = rows.toDF(*(f"_{k}" for k in range(len(rows.columns))))
    line = rows.columns.index("line")
    cells = [F.concat(F.lit(f"{name}="), F.coalesce(F.col(f"_{k}").cast("string"), F.lit("\x00"))) for k, name in enumerate(rows.columns) if k != line]
    return slots.select(F.col(f"_{line}").cast("long").alias("line"), F.sha2(F.concat_ws("\x1e", *cells), 256).alias("digest"))


def judged(rows: DataFrame) -> DataFrame:
    """One row per digest, the last line: the imported columns with the keys, and ``valid``."""
    last = first_of(digested(rows), ["digest"], [F.col("line").desc()])
    found = imports.imported(rows)
    found = found.withColumn("line", F.col("line").cast("long")).withColumns({f"{kind}_id": key(kind) for kind in PARENTS})
    found = found.withColumn("spec_id", F.sha2(F.concat_ws("\x01", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in imports.SPEC)), 256))
    return last.join(found, "line", "left").withColumn("valid", F.col("spec_id").isNotNull())


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    return first_of(rows, keys, [F.col("line").desc()])


def names(old: DataFrame, rows: DataFrame) -> DataFrame:
    """The names after an import: new ones, and variants with the engine of their last line."""
    parts = []
    for kind, parent in PARENTS.items():
        engine = [F.col(c) if kind == "variant" else F.lit(None).cast("double").alias(c) for c in ENGINE]
        parent_id = F.col(f"{parent}_id") if parent else F.lit(None).cast("string")
        parts.append(F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("id"), parent_id.alias("parent_id"), F.col(kind).alias("name"), *engine))
    found = rows.where("valid").select("line", F.explode(F.array(*parts)).alias("n")).select("line", "n.*").where("id IS NOT NULL")
    return upsert(old, latest(found, ["kind", "id"]).drop("line"), ["kind", "id"], ENGINE)


def specs(old: DataFrame, rows: DataFrame) -> DataFrame:
    """The specs after an import: the last line's doors, seats, consumption and emission; the first line's drive."""
    valid = rows.where("valid")
    first = first_of(valid, ["spec_id"], [F.col("line")]).select("spec_id", F.col("drive_id").alias("first_drive"))
    found = latest(valid, ["spec_id"]).join(first, "spec_id").withColumn("drive_id", F.col("first_drive"))
    return upsert(old, found.select(*(c.split()[0] for c in SPECS.split(", "))), ["spec_id"], FACTS)


def prices(old: DataFrame, rows: DataFrame) -> DataFrame:
    """The price of each spec after an import."""
    regional = F.to_json(F.struct(*(F.lit(x).alias(city) for city, x in REGIONAL_MULTIPLIERS.items())))
    found = latest(rows.where("valid"), ["spec_id"]).select("spec_id", *PRICE, regional.alias("regional"))
    return upsert(old, found, ["spec_id"], PRICE)


def outcomes(old_specs: DataFrame, rows: DataFrame, import_id: str) -> DataFrame:
    """A ledger row for each row: rejected, created (the first line of a spec that was not known) or updated."""
    known = old_specs.select("spec_id", F.lit(True).alias("known"))
    place = F.row_number().over(Window.partitionBy("spec_id").orderBy("line"))
    found = rows.where("valid").withColumn("place", place).join(known, "spec_id", "left")
    found = found.select("digest", "line", F.when((F.col("place") == 1) & F.col("known").isNull(), "created").otherwise("updated").alias("outcome"), "spec_id")
    rejected = rows.where("NOT valid").select("digest", "line", F.lit("rejected").alias("outcome"), "spec_id")
    return found.unionByName(rejected).select(F.lit(import_id).alias("import_id"), "digest", "line", "outcome", "spec_id")


def run(rows: DataFrame, folder: str, import_id: str) -> versions.Pointer | None:
    """Import rows (with a ``line``) into the tables served in ``folder``; nothing is written where all are in the ledger."""
    spark = rows.sparkSession

    def change(base: versions.Pointer | None):
        schemas = {"names": NAMES, "specs": SPECS, "prices": PRICES, "ledger": LEDGER}
        old = {t: spark.createDataFrame([], schema) if base is None else versions.read(spark, folder, t, base) for t, schema in schemas.items()}
        done = old["ledger"].where(F.col("import_id") == import_id).select("digest")
        new = judged(rows).join(done, "digest", "left_anti")
        if base is not None and new.isEmpty():
            return None
        read = lambda at: spark.read.parquet(f"{at}/rows")
        return {
            "rows": new, "names": lambda at: names(old["names"], read(at)), "specs": lambda at: specs(old["specs"], read(at)), "prices": lambda at: prices(old["prices"], read(at)),
            "ledger": lambda at: old["ledger"].unionByName(outcomes(old["specs"], read(at), import_id)),
        }

    return versions.update(spark, folder, change, f"import-{import_id}", {"import": import_id})


def chain(spark, folder: str, pointer: versions.Pointer | None = None) -> DataFrame:
    """Every spec with all its names, its engine and its price."""
    at = pointer or versions.head(spark, folder)
    named = versions.read(spark, folder, "names", at)
    out = versions.read(spark, folder, "specs", at).join(versions.read(spark, folder, "prices", at), "spec_id", "left")
    for kind in PARENTS:
        own = named.where(F.col("kind") == kind).select(F.col("id").alias(f"{kind}_id"), F.col("name").alias(kind), *(ENGINE if kind == "variant" else ()))
        out = out.join(own, f"{kind}_id", "left")
    return out
