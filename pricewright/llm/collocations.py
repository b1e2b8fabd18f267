"""Phrase collocation mining: runs of words that stand together oftener than by chance.

Texts, A-Z in lower case, are split at ``.,;:!?`` and U+000A-U+000D into pieces, and
those at spaces and tabs into words.  All runs of 1 to ``max_n`` words within a piece
become rows, which Spark counts by language.  A run can be a candidate only where
both runs inside that are one word shorter occur ``min_count`` times; level by level,
occurrences that cannot be candidates are therefore never made into rows.  What is
frequent is looked up in a bit table of a fixed size, which may let others through
(they are counted and dropped) but loses none.

Candidates of two or more words meet the counts of what is before and after each cut;
scores are whole numbers from Decimal products.  A candidate goes where a candidate
one word longer that holds it has ``inside_percent`` of its count: if any longer one
has, one of these has, too.  What is left is ranked by language, first in parts of
a language, then among the first of each part.

A null language is ``und``; null and empty texts have no words.  Ties of score go
by count, then phrase in UTF-8 order, so that the rank is unique.  Repeated rows count
each.  Pieces and texts of any length are read as a whole.  An empty table gives no
rows.  Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.llm.shared import by_bytes, byte_texts, crc_after, joined_by_key, scratch, session_of, written

UNKNOWN = "und"
MAX_N, MIN_COUNT, INSIDE_PERCENT, TOP = 3, 10, 50, 2000
#: Bytes of text whose arrays a task holds at a time.
BYTES_AT_ONCE = 4 << 20
#: Bits of the table of frequent runs (16 MB), and parts in which a language is ranked first.
TABLE_BITS, PARTS = 27, 256
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
COUNTS = "lang string, phrase string, f long"


def runs(langs: list[str], texts: list[bytes], n: int, table: np.ndarray | None = None) -> pa.RecordBatch:
    """(lang, phrase, f): the runs of n words in some texts, those whose shorter runs the table has.

    For n of 1 there is a row with a null phrase and the number of all words for
    each language, too.
    """
    known: dict[bytes, int] = {}
    flat, piece_sizes, piece_langs = [], [], []
    of_lang = {name: k for k, name in enumerate(dict.fromkeys(langs))}
    for name, text in zip(langs, texts, strict=True):
        for piece in text.translate(_PLAIN).split(b"\n"):
            words = piece.split()
            if words:
                flat += words
                piece_sizes.append(len(words))
                piece_langs.append(of_lang[name])
    ids = np.fromiter((known.setdefault(w, len(known)) for w in flat), np.int64, len(flat))
    sizes = np.array(piece_sizes, np.int64)
    lang = np.repeat(np.array(piece_langs, np.int64), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(ids.size)  # words to the end of the piece
    at = np.flatnonzero(left >= n)
    if n > 1:
        frequent = _frequent(list(of_lang), list(known), lang, ids, left, n - 1, table)
        at = at[frequent[at] & frequent[at + 1]]
    code = lang[at]
    for k in range(n):
        first, code = np.unique(code * max(1, len(known)) + ids[at + k], return_index=True, return_inverse=True)[1:]
    f = np.bincount(code, minlength=0)
    first = at[first] if at.size else at
    words = pa.array(list(known), pa.binary()).cast(pa.string())
    parts = [words.take(pa.array(ids[first + k])) for k in range(n)]
    phrase = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
    names = pa.array(list(of_lang), pa.string()).take(pa.array(lang[first]))
    if n == 1:
        total = np.bincount(lang, minlength=len(of_lang))
        phrase = pa.concat_arrays([phrase, pa.nulls(len(of_lang), pa.string())])
        names, f = pa.concat_arrays([names, pa.array(list(of_lang), pa.string())]), np.r_[f, total]
    return pa.RecordBatch.from_arrays([names, phrase, pa.array(f, pa.int64())], names=["lang", "phrase", "f"])


def _frequent(langs: list[str], words: list[bytes], lang: np.ndarray, ids: np.ndarray, left: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """Whether the run of n words at each place is in the table."""
    start = np.array([zlib.crc32(x.encode() + b"\n") for x in langs], np.uint32)
    plain = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    spaced = np.fromiter((zlib.crc32(w, zlib.crc32(b" ")) for w in words), np.uint32, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    crc = crc_after(start[lang], plain[ids], size[ids])
    for k in range(1, n):
        after = ids[k:]
        crc = crc_after(crc[: after.size], spaced[after], size[after] + 1)
    place = crc & np.uint32(table.size * 64 - 1)
    found = np.zeros(ids.size, bool)
    found[: place.size] = (table[place >> np.uint32(6)] >> (place & np.uint32(63)).astype(np.uint64)) & np.uint64(1)
    return found & (left >= n)


def bit_table(counts: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """The runs of (lang, phrase) rows in a table of 2**bits bits; its words that are not 0 are gathered."""
    place = F.crc32(F.concat_ws("\n", "lang", "phrase").cast("binary")).bitwiseAND(F.lit((1 << bits) - 1))
    ones = counts.select(place.alias("place")).selectExpr("shiftright(place, 6) AS word", "shiftleft(1L, CAST(place & 63 AS INT)) AS bits")
    found = ones.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def counted(docs: DataFrame, n: int, min_count: int, shorter: DataFrame | None = None, table_bits: int = TABLE_BITS) -> DataFrame:
    """(lang, phrase, f) of (lang, text) rows: runs of n words with ``min_count`` occurrences or more."""
    table = None if shorter is None else docs.sparkSession.sparkContext.broadcast(bit_table(shorter, table_bits))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, BYTES_AT_ONCE):
                yield runs(part.column(0).to_pylist(), byte_texts(part.column(1)), n, None if table is None else table.value)

    rows = docs.mapInArrow(find, COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    out = written(rows.where(F.col("phrase").isNull() | (F.col("f") >= min_count)), f"phrases-{n}")
    if table is not None:
        table.unpersist()
    return out


def _looked_up(rows: DataFrame, counts: DataFrame, part: str, name: str, n_rows: int) -> DataFrame:
    """``rows`` with the count of their ``part`` as ``name``; a part with many rows is no hot key."""
    often = rows.groupBy(part).agg(F.count("*").alias("n"))
    facts = written(often.join(counts.select(F.concat_ws("\n", "lang", "phrase").alias(part), F.col("f").alias(name)), part), f"phrases-{name}")
    return joined_by_key(rows, facts, part, n_rows, "inner").drop("n", part)


def scores(candidates: DataFrame, counts: DataFrame, max_n: int = MAX_N) -> DataFrame:
    """(lang, phrase, a, l, r, score) of (lang, phrase, a): the cut with the lowest score, the first of equal ones."""
    words = F.split("phrase", " ")
    rows = candidates.select("lang", "phrase", "a", words.alias("words"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    joint = lambda part: F.concat_ws("\n", "lang", F.array_join(part, " "))
    cuts = rows.select("lang", "phrase", "a", "k", joint(F.slice("words", F.lit(1), F.col("k"))).alias("first"), joint(F.slice("words", F.col("k") + 1, F.lit(max_n))).alias("rest"))
    cuts = written(cuts, "phrases-cuts")
    n = cuts.count()
    found = _looked_up(written(_looked_up(cuts, counts, "first", "l", n), "phrases-first"), counts, "rest", "r", n)
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    # Up to 1e15 occurrences the products stay within 38 digits.
    found = found.withColumns({"_over": F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a"), "_under": wide("l") * wide("r")})
    found = found.withColumn("score", F.expr("_over div _under"))
    best = found.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def not_inside(scored: DataFrame, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """Candidates that no candidate one word longer holds with ``inside_percent`` of their count."""
    words = F.split("phrase", " ")
    n = F.size(words)
    both = F.array_distinct(F.array(F.array_join(F.slice(words, F.lit(1), n - 1), " "), F.array_join(F.slice(words, F.lit(2), n - 1), " ")))
    longer = scored.where(n > 2).select(F.col("lang").alias("_lang"), F.explode(both).alias("_phrase"), "a").groupBy("_lang", "_phrase").agg(F.max("a").alias("_most"))
    same = (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")) & (100 * F.col("_most") >= inside_percent * F.col("a"))
    return scored.join(longer, same, "left_anti")


def first_of_each(rows: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first rows by score, count and phrase with their rank; a language's rows are ranked in parts first."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    rows = rows.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= top).drop("_part", "_rank")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = MAX_N, min_count: int = MIN_COUNT, inside_percent: int = INSIDE_PERCENT, top: int = TOP, table_bits: int = TABLE_BITS) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n and score."""
    session_of(docs)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    with scratch(docs.sparkSession):
        levels = [counted(rows, 1, min_count)]
        total = levels[0].where("phrase IS NULL").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
        levels[0] = levels[0].where("phrase IS NOT NULL")
        for n in range(2, max_n + 1):
            levels.append(counted(rows, n, min_count, levels[-1], table_bits))
        every = levels[0]
        for level in levels[1:]:
            every = every.unionByName(level)
        candidates = every.where(F.col("phrase").contains(" ")).select("lang", "phrase", F.col("f").alias("a"))
        kept = not_inside(written(scores(candidates, every, max_n), "phrases-scored"), inside_percent)
        first = first_of_each(kept, top).join(total, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        return written(first, "phrases", keep=True)


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), e AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
), c AS (SELECT lang, k, phrase, count(*) AS f FROM e GROUP BY ALL
), t AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang
), cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE k > 1 AND f >= 10
), cuts AS (SELECT lang, k, phrase, a, w, j, array_to_string(w[1 : j], ' ') AS first, array_to_string(w[j + 1 :], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)
), s AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, w, j, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts JOIN c l ON l.lang = cuts.lang AND l.phrase = first JOIN c r ON r.lang = cuts.lang AND r.phrase = rest
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), x AS (SELECT lang, sub, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS sub FROM b WHERE k = 3) GROUP BY ALL
), o AS (SELECT b.* FROM b LEFT JOIN x ON x.lang = b.lang AND x.sub = b.phrase WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM o JOIN t USING (lang) QUALIFY rank <= 2000
"""
