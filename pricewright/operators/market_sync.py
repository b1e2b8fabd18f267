"""Prices of the catalogue moved with the market: each month by the settings, or at once for some makes.

Specs and settings are one version: a writer that another one overtook starts again
from the newest, and a month that is done is not done twice, whoever asks again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.operators import versions
from pricewright.operators.prices import inflated


@dataclass(frozen=True)
class Settings:
    """What the monthly run goes by, the month it did last, and how many specs the last change moved."""

    enabled: bool = True
    monthly_percent: float = 2.5
    consignment_percent: float = 6.0
    cash_percent: float = 12.0
    luxury_min: int = 200_000
    luxury_max: int = 300_000
    last_month: str | None = None
    updated: int = 0


def _held(pointer: versions.Pointer | None) -> Settings:
    given = (pointer.notes if pointer else {}).get("settings", {})
    return Settings(**{f.name: given[f.name] for f in fields(Settings) if given.get(f.name) is not None})


def settings(spark: SparkSession, folder: str) -> Settings:
    """The settings in force; the default for each that was never given."""
    return _held(versions.head(spark, folder))


def _notes(now: Settings) -> dict:
    return {"settings": asdict(now)}


def save(spark: SparkSession, folder: str, tries: int = 5, **changes: object) -> Settings:
    """Change some settings; the specs stay the version that they are."""
    for _ in range(tries):
        base = versions.head(spark, folder)
        if base is None:
            raise FileNotFoundError(f"nothing is published in {folder}")
        now = replace(_held(base), **changes)
        try:
            versions.commit(spark, folder, base.version, base, _notes(now))
            return now
        except versions.Conflict:
            continue
    raise versions.Conflict(f"{folder}: {tries} times another writer came first")


def adjust(spark: SparkSession, folder: str, percent: float, makes: Sequence[str] | None = None, month: str | None = None, tries: int = 5) -> Settings:
    """Move list prices above 0 by ``percent``, of some makes or of all; other prices and nulls stay."""
    for _ in range(tries):
        base = versions.head(spark, folder)
        held = _held(base)
        if month is not None and (not held.enabled or (held.last_month or "") >= month):
            return held
        specs = versions.read(spark, folder, pointer=base)
        moved = specs.where(F.col("msrp") > 0)
        n = (moved.where(F.col("make").isin(*makes)) if makes else moved).count()
        now = replace(held, updated=n, last_month=month or held.last_month)
        version = versions.stage(folder, "specs", inflated(specs, percent, makes))
        try:
            versions.commit(spark, folder, version, base, _notes(now))
            return now
        except versions.Conflict:
            versions.drop(spark, folder, version)
    raise versions.Conflict(f"{folder}: {tries} times another writer came first")


def monthly(spark: SparkSession, folder: str, month: str) -> Settings:
    """The run of a month (``2026-01``): nothing where it is switched off, or this month or a later one is done."""
    return adjust(spark, folder, settings(spark, folder).monthly_percent, month=month)


def specs(spark: SparkSession, folder: str) -> DataFrame:
    return versions.read(spark, folder)
