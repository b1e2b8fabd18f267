"""The price catalogue as a versioned reference table, and the classification of names by it.

A row is a rule: a make by equality or as a part, words of model and variant (none: any
name of the make), and the tier and new price it gives.  Rows have an order; of the
makes that fit a name the first counts, and of its rules the first that hits, the
make's own row without words coming last.  The table can be replaced by another
version while jobs that resolved the one before go on with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.config import DEFAULT, PricingConfig
from pricewright.functions.keywords import BOTH, first_rules, output
from pricewright.functions.tiers import OTHERS, TIERS
from pricewright.operators import prices

SCHEMA = "place int, how string, make string, rule int, words string, tier string, base_price long"
#: Rules that a catalogue may have: they are read to the driver and searched as one automaton.
MAX_RULES = 100_000
_EDGE = "\x01"


def catalogue(spark: SparkSession) -> DataFrame:
    """The catalogue that comes with the library, a row a rule."""
    rows = []
    for place, (how, make, tier, price, rules) in enumerate(TIERS):
        rows += [(place, how, make, k, rule[0], rule[2] if len(rule) > 2 else tier, rule[1]) for k, rule in enumerate(rules)]
        rows.append((place, how, make, len(rules), None, tier, OTHERS[1] if price is None else price))
    return spark.createDataFrame(rows, SCHEMA)


def classified(rows: DataFrame, rules: DataFrame, make: Column, model: Column, variant: Column) -> DataFrame:
    """The rows with ``tier`` and ``base_price`` of the first rule that fits; those of OTHERS where none does."""
    held = rules.limit(MAX_RULES + 1).collect()
    if len(held) > MAX_RULES:
        raise ValueError(f"the catalogue has more than {MAX_RULES} rules")
    makes: dict[int, list] = {}
    for r in sorted(held, key=lambda r: (r.place, r.rule)):
        makes.setdefault(r.place, []).append(r)
    names = lambda r: [x if r.how == "has" else f"{_EDGE}{x}{_EDGE}" for x in r.make.split("|")]
    tables = {"make": [{"make": names(found[0])} for found in makes.values()]}
    words = lambda r: [x.replace("+", BOTH) for x in r.words.split("|")] if r.words else [""]
    tables |= {f"m{k}": [{"name": words(r)} for r in found] for k, found in enumerate(makes.values())}
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    fields = {"make": F.concat(F.lit(_EDGE), low(make), F.lit(_EDGE)), "name": F.concat_ws(" ", low(model), low(variant))}
    found = first_rules(rows, fields, tables, "_rule")
    number = F.col("_rule.make")
    tier, price = F.lit(OTHERS[0]), F.lit(OTHERS[1]).cast("long")
    for k, own in enumerate(makes.values()):
        rule = F.col(f"_rule.m{k}")
        tier = F.when(number == k, output(rule, [r.tier for r in own], "string")).otherwise(tier)
        price = F.when(number == k, output(rule, [r.base_price for r in own], "long")).otherwise(price)
    return found.withColumns({"tier": tier, "base_price": price}).drop("_rule")


def recalibrated(specs: DataFrame, rules: DataFrame, config: PricingConfig = DEFAULT) -> DataFrame:
    """Specs (make, model, variant, year, msrp) with tier and base price by the catalogue, and the prices that follow."""
    c = F.col
    return prices.recalibrated(classified(specs, rules, c("make"), c("model"), c("variant")), config)
