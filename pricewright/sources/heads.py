"""Files by their names and first bytes: a directory as a relation, and the brand it tells.

The listing reads no contents, and of a file only its head is read, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions.keywords import first_rules, output
from pricewright.sources.stores import opened

HEAD_BYTES = 5000
# Brands in the order in which names and heads are searched for them.
BRANDS = (
    "Abarth", "Aion", "Alfa Romeo", "Alpine", "Anadol", "Arora", "Aston Martin", "Audi", "BMW", "BYD", "Bajaj", "Bentley", "Buick", "Cadillac", "Chery", "Chevrolet", "Chrysler", "Citroen", "Cupra", "DS Automobiles",
    "Dacia", "Daewoo", "Daihatsu", "Dodge", "Eagle", "Ferrari", "Fiat", "Ford", "Geely", "Honda", "Hyundai", "Infiniti", "Isuzu", "Jaguar", "Jeep", "Kia", "Lada", "Lamborghini", "Lancia", "Land Rover", "Lexus",
    "Lincoln", "Lotus", "Maserati", "Mazda", "Mercedes-Benz", "Mini", "Mitsubishi", "Nissan", "Opel", "Peugeot", "Porsche", "Renault", "Rolls-Royce", "Rover", "Saab", "Seat", "Skoda", "Smart", "Subaru", "Suzuki",
    "Tesla", "Tofaş", "Toyota", "Volkswagen", "Volvo",
)


def listing(spark: SparkSession, folder: str, pattern: str = "*.html") -> DataFrame:
    """(path, folder, file, bytes) of all files below a folder; their contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    parts = F.split("path", "/")
    return rows.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"), F.col("length").alias("bytes"))


def heads(files: DataFrame, n: int = HEAD_BYTES) -> DataFrame:
    """The rows of a listing with the file's first ``n`` bytes as text in ``head``; null where it cannot be read."""
    columns = files.columns
    at = columns.index("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for path in batch.column(at).to_pylist():
                try:
                    with opened(path) as f:
                        texts.append(f.read(n).decode("utf-8", "replace"))
                except OSError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*columns, "head"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(read, f"{kinds}, head string")


def with_brand(rows: DataFrame, folder: Column, file: Column, head: Column, into: str = "brand") -> DataFrame:
    """The rows with the first brand that a file's name holds before a space, else the first in its head, else the folder."""
    tables = {"file": [{"file": [f"{b.lower()} "]} for b in BRANDS], "head": [{"head": [b.lower()]} for b in BRANDS]}
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    kept = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), folder.alias("folder"), low(file).alias("file"), low(head).alias("head"))
    found = first_rules(kept, {"file": F.col("file"), "head": F.col("head")}, tables, "rule")
    return found.select("row.*", F.coalesce(output(F.col("rule.file"), BRANDS, "string"), output(F.col("rule.head"), BRANDS, "string"), F.col("folder")).alias(into))
