"""A bounded report in Markdown: a table of the first rows and the facts behind it, or what failed.

Facts are one row of figures over all data; rules are conditions on them.  Where every
rule holds, the report shows the facts and at most ``top`` rows in a total order; else
it names the rules that failed, with the figure each was judged by, and shows no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from pricewright.functions.text import thousands
from pricewright.operators.versions import drop

TITLE, HEAD, ROWS, FACTS = range(4)


def _cell(rows: DataFrame, name: str) -> Column:
    """A value as a table shows it: whole numbers with dots, a dash for null, bars escaped."""
    whole = isinstance(rows.schema[name].dataType, IntegralType)
    text = thousands(F.col(name)) if whole else F.regexp_replace(F.col(name).cast("string"), r"[\r\n|]", " ")
    return F.coalesce(text, F.lit("-"))


def lines(rows: DataFrame, facts: DataFrame, rules: Mapping[str, tuple[str, Column]], title: str, columns: Mapping[str, str], order: Sequence[Column], top: int = 50) -> DataFrame:
    """(section, position, line) of the report; ``rules`` give the fact that each is judged by and its condition, ``columns`` the headings.

    A condition that is null has failed.  No facts give no report.
    """
    failed = [F.when(~F.coalesce(holds, F.lit(False)), F.concat(F.lit(f"- {name}: "), _cell(facts, fact))) for name, (fact, holds) in rules.items()]
    judged = facts.withColumn("_failed", F.array_compact(F.array(F.lit(None).cast("string"), *failed)))
    ok = F.size("_failed") == 0
    line = lambda section, position, text: F.struct(F.lit(section).alias("section"), F.lit(position).alias("position"), text.alias("line"))
    good = [line(TITLE, 1, F.lit(f"# {title}")), line(HEAD, 1, F.lit(f"| # | {' | '.join(columns.values())} |")), line(HEAD, 2, F.lit("| ---: " * (1 + len(columns)) + "|"))]
    good += [line(FACTS, k, F.concat(F.lit(f"- {name}: "), _cell(facts, name))) for k, name in enumerate(facts.columns, 1)]
    bad = F.transform("_failed", lambda x, k: F.struct(F.lit(FACTS).alias("section"), (k + 1).alias("position"), x.alias("line")))
    framed = judged.select(F.explode(F.when(ok, F.array(*good)).otherwise(F.concat(F.array(line(TITLE, 1, F.lit(f"# {title}: failed"))), bad))).alias("x")).select("x.*")
    # The first rows are few, whatever the table: a limit in order, and then numbers for those alone.
    first = rows.orderBy(*order).limit(top)
    shown = first.select(F.row_number().over(Window.orderBy(*order)).alias("position"), *(_cell(rows, c).alias(f"_{k}") for k, c in enumerate(columns)))
    text = F.concat(F.lit("| "), F.col("position").cast("string"), *(F.concat(F.lit(" | "), F.col(f"_{k}")) for k in range(len(columns))), F.lit(" |"))
    shown = shown.select(F.lit(True).alias("_ok"), F.lit(ROWS).alias("section"), "position", text.alias("line"))
    return framed.unionByName(shown.join(judged.where(ok).select(F.lit(True).alias("_ok")), "_ok").drop("_ok"))


def write(report: DataFrame, folder: str, name: str) -> bool:
    """Write a report as one text below ``folder``: ``name``, or ``name-failed``; the other of the two goes.  Whether it succeeded."""
    spark = report.sparkSession
    kept = report.persist()
    good = kept.where(F.col("section") == HEAD).limit(1).count() > 0
    parts = (name, f"{name}-failed") if good else (f"{name}-failed", name)
    kept.coalesce(1).sortWithinPartitions("section", "position").select("line").write.mode("overwrite").text(f"{folder}/{parts[0]}")
    drop(spark, folder, parts[1])
    kept.unpersist()
    return good
