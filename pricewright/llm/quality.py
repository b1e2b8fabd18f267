"""Quality rules as a short-circuit cascade.

Each rule rejects a document or lets it pass.  On a bounded sample the cascade
measures what each rule costs and how many documents it rejects, and then asks
the rules in the order of rejections per second, stopping at the first one that
rejects.  The verdict does not depend on the order; only the work does.

Words are runs outside space and U+0009-U+000D; a null text has none.  Empty
texts fail ``min_words``.  Repeated rows are judged each on its own, those with a
null id, too; an empty table gives no rows.  Of other columns ``verdicts`` takes
none, whatever their names, and ``passing`` keeps all.  The measurements are of
whole texts.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm.shared import byte_texts, session_of

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
#: Rows of the sample from which costs and selectivities are estimated.
SAMPLE_ROWS = 2000


class Measures:
    """What the rules ask about one text; each figure is made when first asked for."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a 3-word window that the text holds twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, n)
        base = len(known)
        if base == n:
            return 0
        pairs = ids[:-1] * base + ids[1:]
        if base < 2_000_000:
            windows = pairs[:-1] * base + ids[2:]
        else:  # three ids would not fit 63 bits
            windows = np.unique(pairs, return_inverse=True)[1][:-1] * base + ids[2:]
        order = np.argsort(windows, kind="stable")
        same = np.diff(windows[order]) == 0
        often = np.zeros(n - 2, bool)
        often[order[1:][same]] = True
        often[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= often
        return int(covered.sum())

    @cached_property
    def n_capitals(self) -> int:
        """ASCII letters in upper case."""
        return len(self.text) - len(self.text.translate(None, UPPER))

    @cached_property
    def n_letters(self) -> int:
        """ASCII letters of either case."""
        return len(self.text) - len(self.text.translate(None, LETTERS))

    @cached_property
    def n_shouts(self) -> int:
        return self.text.count(b"!")


@dataclass(frozen=True)
class Rule:
    """``rejects`` tells from a text's measures whether the document goes."""

    name: str
    rejects: Callable[[Measures], bool]


def default_rules(
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_symbols_per_word: float = 0.1,
    max_dup_line_share: float = 0.3,
    few_dup_lines: int = 2,
    word_length: tuple[float, float] = (2.5, 12.0),
    max_capital_share: float = 0.5,
    max_shouts_per_word: float = 0.3,
) -> list[Rule]:
    """The rules used in production, with their thresholds as parameters."""
    low, high = word_length
    return [
        Rule("min_words", lambda m: m.n_words < min_words),
        Rule("repeat_words", lambda m: 100 * m.n_repeat_words > max_repeat_percent * m.n_words),
        Rule("symbols", lambda m: m.n_symbols > max_symbols_per_word * m.n_words),
        Rule("dup_lines", lambda m: m.n_dup_lines > max(few_dup_lines, max_dup_line_share * len(m.lines))),
        Rule("word_length", lambda m: not low * m.n_words <= m.word_chars <= high * m.n_words),
        Rule("capitals", lambda m: 2 * m.n_letters > m.word_chars and m.n_capitals > max_capital_share * m.n_letters),
        Rule("shouts", lambda m: m.n_shouts > max_shouts_per_word * m.n_words),
    ]


def estimate(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS, text: str = "text") -> list[dict]:
    """Cost and selectivity of each rule on a sample of about ``sample_rows`` rows.

    The sample is measured on the executors; one row a rule comes back.  An
    empty table gives no figures, and then the given order stands.
    """
    session_of(docs)
    total = docs.count()
    if not total:
        return []
    sample = docs.select(text).sample(min(1.0, sample_rows / total), 17)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seconds, rejected, seen = [r.name for r in rules], [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for t in byte_texts(batch.column(0)):
                seen += 1
                for k, rule in enumerate(rules):
                    m = Measures(t)
                    began = time.perf_counter()
                    rejected[k] += bool(rule.rejects(m))
                    seconds[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": names, "seconds": seconds, "rejected": rejected, "seen": [seen] * len(names)})

    figures = (
        sample.mapInArrow(measure, "rule string, seconds double, rejected long, seen long")
        .groupBy("rule")
        .agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"), F.sum("seen").alias("seen"))
    )
    return [r.asDict() for r in figures.collect()]


def ordered(rules: Sequence[Rule], figures: Sequence[dict]) -> list[Rule]:
    """Most rejections per second first; rules without figures keep their place at the end."""
    worth = {f["rule"]: f["rejected"] / max(f["seconds"], 1e-9) for f in figures if f["seen"]}
    return sorted(rules, key=lambda r: -worth.get(r.name, -1.0))


def rejecting_rule(measures: Measures, rules: Sequence[Rule]) -> str | None:
    """The first rule, in the given order, that rejects; later ones are not asked."""
    for rule in rules:
        if rule.rejects(measures):
            return rule.name
    return None


def passing(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    session_of(docs)
    rules = default_rules() if rules is None else list(rules)
    order = ordered(rules, estimate(docs, rules, text=text))
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [rejecting_rule(Measures(t), order) is None for t in byte_texts(batch.column(at))]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


VERDICTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def verdicts(docs: DataFrame, rules: Sequence[Rule] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: its measures, ``base_failed`` and whether it is kept."""
    session_of(docs)
    rules = default_rules() if rules is None else list(rules)
    order = ordered(rules, estimate(docs, rules, text=text))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in byte_texts(batch.column(1)):
                m = Measures(t)
                base = m.n_words < 50 or 100 * m.n_repeat_words > 50 * m.n_words
                kept = not base and rejecting_rule(m, order) is None
                rows.append((m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, base, kept))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=[key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(judge, f"`{key}` {kind}, {VERDICTS}")


#: The verdicts of the default rules in DuckDB SQL.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), m AS (
  SELECT r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
    length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters, length(t) - length(replace(t, '!', '')) AS n_shouts FROM d
), p AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3
), s AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM p
), c AS (SELECT r, count(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM s WHERE n > 1) GROUP BY r
), b AS (
  SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed FROM m LEFT JOIN c ON c.r = m.r
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND n_symbols <= 0.1::DOUBLE * n_words AND n_dup_lines <= greatest(2, 0.3::DOUBLE * n_lines) AND word_chars BETWEEN 2.5::DOUBLE * n_words AND 12::DOUBLE * n_words
    AND NOT (2 * n_letters > word_chars AND n_capitals > 0.5::DOUBLE * n_letters) AND n_shouts <= 0.3::DOUBLE * n_words AS kept
FROM b
"""
