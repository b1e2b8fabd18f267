"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key.  Within its source it falls into one of
many key ranges; the ranges' sizes are summed to prefix sums a source, and a
window inside each range completes them, so no source is sorted in one task.
The documents are taken in key order up to the source's exact budget: whole
rounds over the source first, where the budget exceeds it, then a prefix, whose
last document is taken in part.

Weights 1, 2, 3, repeating, go to the sources in code-point order, null last.
A target stops at ``cap`` times its source's size, and the excess is shared by
weight among the others.  Budgets are targets rounded down to whole words.

Null or empty texts have size 0 and are taken with 0 words.  A null id counts
as an empty one.  Documents with the same id count each on its own; ties
of the key go by id, size and the text's digest, so that reruns agree.  Texts of
any length are counted and cut as a whole.  An empty table gives no rows; extra
columns of any names are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.llm.shared import WORD_PATTERN, written

#: Documents of a key range, about.
RANGE_ROWS = 2_000


def words(text: str) -> Column:
    """Number of words of a text; 0 for a null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def random_key(key: str, text: str, seed: str) -> Column:
    """60 random bits from id and text; an id that many documents share is no one key."""
    of_text = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), of_text).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, cap: int = 3, weights: int = 3) -> DataFrame:
    """(source, n_docs, source_size, target) from rows of (source, size).

    With the sources in the order of cap * size / weight, the share a unit of
    weight gets when all sources before are capped is greatest where capping
    ends; that is the level to which all are filled.  The windows run over one
    row a source.
    """
    total = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    total = total.withColumn("weight", (rank - 1) % weights + 1)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    total = total.withColumn("level", left.cast("double") / F.sum("weight").over(after).cast("double"))
    level = F.max("level").over(everything)
    target = F.least(F.col("source_size").cast("double") * cap, level * F.col("weight"))
    return total.select("source", "n_docs", "source_size", target.alias("target"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", range_rows: int = RANGE_ROWS, keep_columns: bool = False) -> DataFrame:
    """Rows with size, source_size, target and taken in one column ``_mix``.

    With ``keep_columns`` all columns of ``docs`` stay, in one column ``row``;
    otherwise its key alone.
    """
    facts = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words(text).alias("size"), random_key(key, text, seed).alias("random"), F.xxhash64(text).alias("digest"))
    facts = written(facts, "mix-sizes")
    targets = written(source_targets(facts), "mix-targets")
    ranges = F.ceil(F.col("n_docs") / range_rows)
    place = F.floor(F.col("random") / F.lit(float(1 << 60)) * ranges).cast("long")
    placed = facts.join(targets, facts["source"].eqNullSafe(targets["source"])).select(facts["source"], place.alias("place"), "size")
    sums = placed.groupBy("source", "place").agg(F.sum("size").alias("n"))
    run = Window.partitionBy("source").orderBy("place")
    starts = sums.select(F.col("source").alias("s"), F.col("place").alias("p"), (F.sum("n").over(run) - F.col("n")).alias("range_start"))
    if keep_columns:
        rows = docs.select(
            F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).alias("key"), F.col(source).alias("source"), words(text).alias("size"), random_key(key, text, seed).alias("random"), F.xxhash64(text).alias("digest")
        )
    else:
        rows = facts
    rows = rows.join(targets.withColumnRenamed("source", "t"), F.col("source").eqNullSafe(F.col("t"))).withColumn("place", place)
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("place") == F.col("p")))
    within = Window.partitionBy("source", "place").orderBy("random", "key", "size", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("size").over(within) - F.col("size") + F.col("range_start")
    budget = F.floor("target").cast("long")
    rounds = F.coalesce(F.floor(budget / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    rest = budget - rounds * F.col("source_size") - F.col("before")
    taken = rounds * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    mix = F.struct("size", "source_size", "target", taken.alias("taken"))
    return rows.withColumn("before", before).select("row" if keep_columns else F.col("key").alias(key), mix.alias("_mix"))


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """The mix as documents: one row per whole copy, and one cut to the words left.

    A document that is taken 2.4 times gives three rows, the last with the first
    words of its text that make up 0.4 of it.
    """
    rows = mixed(docs, key, text, source, seed, keep_columns=True)
    size, taken = F.col("_mix.size"), F.col("_mix.taken")
    copies = F.ceil(taken / size).cast("int")
    rows = rows.where(taken > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    left = taken - (F.col("_copy") - 1) * size
    # Each word with the white space before it, so that the head keeps the text's own.
    whole = F.col("row").getField(text)
    words_apart = F.regexp_extract_all(whole, F.lit(r"[\x20\x09-\x0D]*" + WORD_PATTERN), F.lit(0))
    head = F.array_join(F.slice(words_apart, F.lit(1), left.cast("int")), "")
    cut = F.when(left >= size, whole).otherwise(head)
    return rows.select(*(cut.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS random
  FROM documents
), t AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM t
), g AS (
  SELECT source, source_size, least(3 * source_size::DOUBLE, max(level) OVER () * weight) AS target FROM l
), p AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
         (sum(size) OVER (PARTITION BY d.source ORDER BY random, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (coalesce(budget // nullif(source_size, 0), 0) * size
        + greatest(0, least(size, budget - coalesce(budget // nullif(source_size, 0), 0) * source_size - before)))::BIGINT AS taken
FROM p
"""


def report(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", "_mix.taken")
