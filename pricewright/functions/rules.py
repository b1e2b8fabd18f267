"""Ordered keyword rules: the first rule whose needle occurs in one of its fields wins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (needles, output); a needle is searched in every field given for the rules.
Rules = Sequence[tuple[Sequence[str], object]]


def hit(fields: Sequence[Column], needles: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (f.contains(n) for f in fields for n in needles))


def first_match(fields: Sequence[Column], rules: Rules, default: Column | None = None) -> Column:
    """Output of the first rule that hits, else the default (null).  Fields must not be null."""
    chain = None
    for needles, output in rules:
        value = F.lit(output)
        chain = F.when(hit(fields, needles), value) if chain is None else chain.when(hit(fields, needles), value)
    return chain if default is None else chain.otherwise(default)


def first_rule(rules: Sequence[tuple[Mapping[str, Sequence[str]], str]], fields: Mapping[str, Column]) -> Column:
    """As ``first_match`` for rules that name the fields they search."""
    chain = None
    for needles, output in rules:
        found = reduce(lambda a, b: a | b, (hit([fields[name]], words) for name, words in needles.items()))
        chain = F.when(found, output) if chain is None else chain.when(found, output)
    return chain
