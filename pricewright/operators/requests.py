"""Checks of incoming requests, joins that requests are shown with, and the log of what was done."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.functions.text import blank

# What a plate and a telephone number look like.
PATTERNS = {"plate": r"^(0[1-9]|[1-7][0-9]|8[0-1])[A-Z]{1,3}\d{2,4}$", "phone": r"^(05|5)\d{9}$"}


def checked(rows: DataFrame, required: Sequence[str], patterns: Mapping[str, str] = PATTERNS, not_negative: Sequence[str] = (), known: Sequence[str] | None = None) -> DataFrame:
    """The rows with ``errors``: sorted names of rules they break, such as ``phone:pattern``.

    A field that is missing breaks no other rule.  Numbers that come as text must
    be numbers.  With ``known``, columns of other names are errors of every row
    that gives a value there.
    """
    broken: list[Column] = []
    for name in required:
        broken.append(F.when(blank(F.col(name).cast("string")), f"{name}:required"))
    for name, pattern in patterns.items():
        broken.append(F.when(~blank(F.col(name)) & ~F.col(name).rlike(pattern), f"{name}:pattern"))
    for name in not_negative:
        number = F.col(name).try_cast("double")
        given = ~blank(F.col(name).cast("string"))
        broken.append(F.when(given & (number.isNull() | F.isnan(number)), f"{name}:number").when(given & (number < 0), f"{name}:negative"))
    for name in rows.columns if known is not None else ():
        if name not in known:
            broken.append(F.when(F.col(name).isNotNull(), f"{name}:unknown"))
    return rows.withColumn("errors", F.array_sort(F.array_compact(F.array(*broken))))


def accepted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) of ``checked`` rows; the refused keep their errors."""
    return rows.where(F.size("errors") == 0).drop("errors"), rows.where(F.size("errors") > 0)


def with_many(rows: DataFrame, many: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """The rows, each with the sorted list of its ``fields`` in ``many``; an empty list where there is none.

    The lists are made before the join, so a row is never repeated.
    """
    held = many.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    out = rows.join(held, list(keys), "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(held.schema[name].dataType)))


def through(left: DataFrame, bridge: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` that a bridge of key pairs leads to."""
    return left.join(bridge.select(left_key, right_key).distinct(), left_key).join(right, right_key)


def model_years(rows: DataFrame, year: str = "year") -> DataFrame:
    """The years to choose from: all from the newest of the rows' years down to the oldest."""
    ends = rows.agg(F.max(year).alias("newest"), F.min(year).alias("oldest")).where("newest IS NOT NULL")
    return ends.select(F.explode(F.sequence("newest", "oldest", F.lit(-1))).alias("year"))


def by_key(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one key; the filter reaches the scan."""
    return rows.where(F.col(key) == F.lit(value))


def logged(events: DataFrame, folder: str) -> None:
    """Append to a log by day; what is there is never rewritten."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(folder)
