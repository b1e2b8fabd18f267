"""Ordered keyword rules over names, as one multi-pattern search.

A rule belongs to a table, has a priority and needles, and is searched in some of a
row's texts.  All needles of all tables make up one automaton; each distinct set of
texts passes it once, however many rules there are, and each table's first rule (by
priority) of those that hit is its result.  Names repeat far oftener than rows, so a
task remembers the names it has seen, up to a bound.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One rule: the needles by the text they are searched in.  Its place in its table is its priority.
#: A needle of several parts, joined by BOTH, hits where all of them occur.
Rule = Mapping[str, Sequence[str]]
BOTH = "\0"
#: Names that a task remembers before it starts anew, and bytes of a name beyond which it is not.
REMEMBERED, LONG = 100_000, 1000


class Search:
    """The automaton of some tables of rules; ``first`` gives each table's first hit in a row's texts."""

    def __init__(self, tables: Mapping[str, Sequence[Rule]]):
        self.n = len(tables)
        # What a part stands for: (table, priority) and the field, alone or as one of several parts of a needle.
        places: dict[str, list[tuple[str, int, int, int, int]]] = {}
        self.always: set[tuple[int, int]] = set()
        needles = [(t, p, field, x) for t, rules in enumerate(tables.values()) for p, rule in enumerate(rules) for field, found in rule.items() for x in found]
        for number, (table, priority, field, needle) in enumerate(needles):
            parts = {x for x in needle.split(BOTH) if x}
            if not parts:
                self.always.add((table, priority))
            for part in parts:
                places.setdefault(part, []).append((field, table, priority, number, len(parts)))
        self.automaton = ahocorasick.Automaton()
        for part, found in places.items():
            self.automaton.add_word(part, (part, found))
        self.empty = not places
        self.automaton.make_automaton()

    def first(self, texts: Mapping[str, str]) -> list[int | None]:
        """For each table the priority of its first rule with a needle in one of its fields; '' is in every text."""
        hits = set(self.always)
        seen: dict[int, set[str]] = {}
        if not self.empty:
            for field, text in texts.items():
                for _, (part, found) in self.automaton.iter(text):
                    for where, table, priority, number, n in found:
                        if where == field and (n == 1 or len(seen.setdefault(number, set()) | {part}) == n):
                            hits.add((table, priority))
                        if where == field and n > 1:
                            seen[number].add(part)
        best: list[int | None] = [None] * self.n
        for table, priority in hits:
            if best[table] is None or priority < best[table]:
                best[table] = priority
        return best


def first_rules(rows: DataFrame, fields: Mapping[str, Column], tables: Mapping[str, Sequence[Rule]], into: str) -> DataFrame:
    """The rows with a struct column ``into``: for each table the number of its first rule that hits, or null.

    ``fields`` are the texts that rules name; a null is an empty text.
    """
    names, own = list(fields), [f"c{k}" for k in range(len(rows.columns))]
    held = rows.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(rows.columns, own, strict=True)), *(F.coalesce(x.cast("string"), F.lit("")).alias(f"text{k}") for k, x in enumerate(fields.values())))
    found = T.StructType([T.StructField(f"t{k}", T.IntegerType()) for k in range(len(tables))])
    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(own, rows.schema.fields, strict=True)), T.StructField("found", found)])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, known = Search(tables), {}
        for batch in batches:
            out = []
            for texts in zip(*(batch.column(len(own) + k).to_pylist() for k in range(len(names))), strict=True):
                result = known.get(texts)
                if result is None:
                    result = of.first(dict(zip(names, texts, strict=True)))
                    if sum(map(len, texts)) <= LONG:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[texts] = result
                out.append(result)
            columns = [pa.array([r[k] for r in out], pa.int32()) for k in range(len(tables))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.StructArray.from_arrays(columns, [f"t{k}" for k in range(len(tables))])], names=[*own, "found"])

    done = held.mapInArrow(search, schema)
    numbers = F.struct(*(F.col("found").getField(f"t{k}").alias(t) for k, t in enumerate(tables)))
    return done.select(*(F.col(n).alias(c) for n, c in zip(own, rows.columns, strict=True)), numbers.alias(into))


def output(number: Column, outputs: Sequence, kind: str) -> Column:
    """The output that belongs to a rule's number; null where no rule hit."""
    return F.get(F.array(*(F.lit(x).cast(kind) for x in outputs)), number)
