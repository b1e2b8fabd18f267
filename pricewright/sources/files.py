"""CSV, JSON, settings and first sheets of workbooks."""

from __future__ import annotations

import json
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.config import PricingConfig
from pricewright.sources import workbook


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Header row, all columns texts."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, or one object, per file."""
    return spark.read.json(path, multiLine=True)


def settings(text: str | None, default: PricingConfig) -> PricingConfig:
    """Known keys of a JSON text over the defaults; a text that cannot be read changes nothing."""
    try:
        given = json.loads(text or "{}")
    except ValueError:
        return default
    known = {f.name for f in fields(default)}
    return replace(default, **{k: v for k, v in given.items() if k in known and v is not None})


def workbooks(spark: SparkSession, folder: str, every_sheet: bool = False) -> DataFrame:
    """(path, line, row map) of the first sheet of every ``.xlsx`` below a folder, or of all sheets with their names in ``sheet``."""
    workbook.register(spark)
    rows = spark.read.format("workbook").option("sheets", "all" if every_sheet else "first").load(folder)
    return rows if every_sheet else rows.drop("sheet")


def columns_of(rows: DataFrame, names: list[str]) -> DataFrame:
    """Named columns out of row maps."""
    return rows.select("line", *(F.col("row")[n].alias(n) for n in names))
