"""Upserts and deletes on plain tables, as DataFrame rewrites.

Each function returns the new table; writing it is the caller's.  Keys are
compared null-safely only where stated.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.operators.listings import first_of, total_order


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``old`` with the ``update`` columns from ``new`` where the key is known, and the rows of new keys.

    Without ``update`` every column but the keys is replaced.  Null keys are equal
    to each other; of new rows with one key the first in the order of all columns
    counts.
    """
    update = [c for c in new.columns if c not in keys] if update is None else list(update)
    new = first_of(new, list(keys), total_order(new, *keys))
    # A row is one struct, so no column can clash with another or with a flag; a row that is missing is a null.
    left, right = (rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias(name)) for rows, name in ((old, "o"), (new, "n")))
    same = reduce(lambda a, b: a & b, (F.col("o").getField(k).eqNullSafe(F.col("n").getField(k)) for k in keys))
    both = left.join(right, same, "full_outer")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col("o").getField(c)
        first = F.col("n").isNotNull() if c in update else F.col("o").isNull()
        return F.when(first, F.col("n").getField(c)).otherwise(F.col("o").getField(c))

    return both.select(*(F.when(F.col("o").isNull(), F.col("n").getField(k)).otherwise(F.col("o").getField(k)).alias(k) for k in keys), *(value(c).alias(c) for c in old.columns if c not in keys))


def find_or_create(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def changed(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of ``new`` that differ from ``old`` in one of the columns, nulls compared as values."""
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    return new.alias("n").join(old.alias("o"), list(keys)).where(differs).select(*keys, *(F.col(f"n.{c}") for c in columns))


def delete_keys(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def cascade(tables: Sequence[tuple[DataFrame, str, str]], gone: DataFrame, key: str) -> list[DataFrame]:
    """Tables (rows, own key, parent key) from the parent down, without all that hangs on ``gone``."""
    kept = []
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    for rows, own, parent in tables:
        kept.append(rows.join(ids, rows[parent] == ids["_gone"], "left_anti"))
        ids = rows.join(ids, rows[parent] == ids["_gone"], "left_semi").select(F.col(own).alias("_gone")).distinct()
    return kept


def replace_groups(rows: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with all rows of each key in ``new`` replaced by the new ones."""
    return delete_keys(rows, new, keys).unionByName(new)
