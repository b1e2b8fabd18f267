"""Importance resampling towards a target distribution.

Hashed runs of one to three words are counted in the documents and in the target.
A bucket's gain is the log ratio of its smoothed shares, a document's weight the
sum of its features' gains, and its score the weight plus Gumbel noise made from
its id, so that the highest scores are a draw without replacement.

Texts become arrays of bucket numbers: a run's crc32 comes from those of its words
by table look-ups, and weights are differences of running sums of gains.  The k-th
highest score is found by radix selection: counts of the next digit of the
composite key (score, id), a bounded number of them, tell which digit holds the
k-th row, until few rows are left.  Only the rows up to that key are then sorted
by ranges and ranked.

Null and empty texts, and those without a word, have no features and weight 0.
Ties of score go to the smaller id, then to fewer features; null ids come last and
draw the noise of an empty id.  Rows alike in all of these count each on its own,
and which of them is drawn does not show in the result.  Texts are read as a whole,
whatever their length.  An empty table gives no rows, an empty target gains by the
documents' counts alone.  Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.llm.shared import by_bytes, byte_texts, crc_after, scratch, session_of, written

BUCKETS, RUN, MIN_WORDS = 10_000, 3, 20
#: Bytes of text whose arrays a task holds at a time.
BYTES_AT_ONCE = 4 << 20
#: Bits of a digit, and the number of rows whose keys are looked at one by one.
DIGIT_BITS, FEW = 12, 1024
#: Drawn documents of a range, about.
RANGE_ROWS = 50_000
#: Letters A-Z become small; of the other ASCII characters only a-z and digits stay.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def bucket_arrays(texts: list[bytes], buckets: int = BUCKETS, run: int = RUN) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length of a run the buckets at all words in a row, -1 where it does not fit its text; and where texts begin."""
    cut = [t.translate(_PLAIN).split() for t in texts]
    begin = np.r_[0, np.cumsum([len(w) for w in cut], dtype=np.int64)]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for words in cut for w in words), np.int64, int(begin[-1]))
    alone = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))
    spaced = np.fromiter((zlib.crc32(w, zlib.crc32(b" ")) for w in known), np.uint32, len(known))
    size = np.fromiter(map(len, known), np.int64, len(known)) + 1
    text = np.repeat(np.arange(len(texts)), np.diff(begin))
    crc, out = alone[ids], []
    for n in range(1, run + 1):
        if n > 1:
            last = ids[n - 1 :]
            crc = crc_after(crc[: last.size], spaced[last], size[last])
        found = np.full(ids.size, -1, np.int64)
        found[: crc.size] = np.where(text[: crc.size] == text[n - 1 :], (crc % np.uint32(buckets)).astype(np.int64), -1)
        out.append(found)
    return out, begin


def bucket_counts(rows: DataFrame, text: str = "text", buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """How many features of all texts fall into each bucket; a row a bucket comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in by_bytes(batch, 0, BYTES_AT_ONCE):
                for found in bucket_arrays(byte_texts(part.column(0)), buckets, run)[0]:
                    total += np.bincount(found[found >= 0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    session_of(rows)
    found = rows.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths, rounded down."""
    every, wanted, n = float(source.sum()), float(target.sum()), source.size
    ratio = [(t + 1) * (every + n) / ((s + 1) * (wanted + n)) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(key: object, seed: int) -> int:
    """A Gumbel variable in thousandths, made from the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORES = "n_features long, weight long, score long"


def scored(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = 42, run: int = RUN) -> DataFrame:
    """The rows as they came with n_features, weight and score in one column ``_score``."""
    session_of(docs)
    at_key, at_text = docs.columns.index(key), docs.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, at_text, BYTES_AT_ONCE):
                found, begin = bucket_arrays(byte_texts(part.column(at_text)), gains.size, run)
                worth = sum(np.where(x >= 0, gains[x], 0) for x in found)
                fits = sum((x >= 0).astype(np.int64) for x in found)
                weight, n = (np.diff(np.r_[0, np.cumsum(x)][begin]) for x in (worth, fits))
                total = weight + np.fromiter((noise(k, seed) for k in part.column(at_key).to_pylist()), np.int64, part.num_rows)
                own = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (n, weight, total)], ["n_features", "weight", "score"])
                yield pa.RecordBatch.from_arrays([*part.columns, own], names=[*names, "_score"])

    names = [f"c{k}" for k in range(len(docs.columns))]
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    rows = docs.toDF(*names).mapInArrow(score, f"{kinds}, _score struct<n_features: long, weight: long, score: long>")
    return rows.select(F.struct(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True))).alias("row"), "_score")


# --- radix selection ----------------------------------------------------------

_SIGN = 1 << 63


def kth_key(rows: DataFrame, keys: Sequence[str], k: int) -> tuple[int, ...]:
    """The k-th smallest (from 1) of the composite keys, which are whole numbers, not null; k is at most their number.

    Each round counts a digit of DIGIT_BITS bits, so at most that many counts
    come to the driver; at most FEW keys do at the end.
    """
    bound: list[int] = []
    for number, name in enumerate(keys):
        plain = F.col(name).cast("long")
        ordered = plain.bitwiseXOR(F.lit(-_SIGN))  # as unsigned bits, in order
        low, high, n = rows.agg(F.min(plain), F.max(plain), F.count("*")).first()
        if n <= FEW:
            rest = sorted(tuple(r) for r in rows.select(*(F.col(c).cast("long") for c in keys[number:])).collect())
            return (*bound, *rest[k - 1])
        low, high = low + _SIGN, high + _SIGN
        width = (low ^ high).bit_length()
        prefix = low >> width
        while width:
            step = min(DIGIT_BITS, width)
            width -= step
            digit = F.shiftrightunsigned(ordered, width).bitwiseAND(F.lit((1 << step) - 1))
            counts = {r["digit"]: r["n"] for r in rows.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()}
            for d in sorted(counts):
                if k <= counts[d]:
                    break
                k -= counts[d]
            prefix = (prefix << step) | d
            value = F.lit(prefix - (1 << 64) if prefix >= _SIGN else prefix)
            rows = rows.where(F.shiftrightunsigned(ordered, width) == value)
        bound.append(prefix - _SIGN)
    return tuple(bound)


def up_to(keys: Sequence[str], bound: Sequence[int]) -> Column:
    """Whether a row's composite key is at most the bound."""
    out = F.lit(True)
    for name, value in reversed(list(zip(keys, bound, strict=True))):
        out = (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def ranked(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The n rows with their rank by unique keys, a column ``rank`` from 1.

    Rows are dealt to ranges of about RANGE_ROWS, numbered within them, and
    moved on by the sizes of the ranges before.
    """
    dealt = written(rows.repartitionByRange(1 + n // RANGE_ROWS, *keys).withColumn("range", F.spark_partition_id()), "importance-ranges")
    sizes = dealt.groupBy("range").agg(F.count("*").alias("size"))
    # One row a range.
    starts = sizes.select(F.col("range").alias("of"), (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(*keys)) + F.col("start")
    return dealt.join(starts, F.col("range") == F.col("of")).withColumn("rank", rank.cast("long")).drop("range", "of", "start")


#: The composite key: higher scores first, then ids, null last, then fewer features, then any order.
KEYS = ("minus", "no_id", "id", "n_features", "copy")


def _keyed(rows: DataFrame, key: str) -> DataFrame:
    found = rows.select(F.col("row").getField(key).alias("key"), "_score.*")
    return found.select(
        "key", "n_features", "weight", "score", (-F.col("score")).alias("minus"), F.col("key").isNull().cast("int").alias("no_id"), F.coalesce(F.col("key").cast("long"), F.lit(0)).alias("id"),
        F.monotonically_increasing_id().alias("copy"),
    )


def eligible(min_words: int = MIN_WORDS, run: int = RUN) -> Column:
    """Whether a text has ``min_words`` words, told from its number of features."""
    return F.col("n_features") >= sum(max(0, min_words - k) for k in range(run))


def importance(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, min_words: int = MIN_WORDS, seed: int = 42) -> DataFrame:
    """A row per document: n_features, weight, score, and its rank if it is drawn, else null.

    ``percent`` of the documents with ``min_words`` words or more are drawn.
    ``key`` is a whole number.
    """
    docs = docs.select(key, text)
    gains = gains_of(bucket_counts(docs, text), bucket_counts(target, target_text))
    facts = written(_keyed(scored(docs, gains, key, text, seed), key), "importance-scores")
    fit = facts.where(eligible(min_words))
    n = percent * fit.count() // 100
    columns = [F.col("key").alias(key), "n_features", "weight", "score"]
    if not n:
        return facts.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = eligible(min_words) & up_to(KEYS, kth_key(fit, KEYS, n))
    first = ranked(facts.where(drawn), KEYS, n)
    return first.select(*columns, "rank").unionByName(facts.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, min_words: int = MIN_WORDS, seed: int = 42) -> DataFrame:
    """The documents drawn, with all their columns, in no order.

    Of rows alike in score, id and features at the bound, as many as are due.
    """
    spark = session_of(docs)
    with scratch(spark):
        gains = gains_of(bucket_counts(docs, text), bucket_counts(target, target_text))
        facts = written(_keyed(scored(docs.select(key, text), gains, key, text, seed), key).where(eligible(min_words)), "importance-scores")
        n = percent * facts.count() // 100
        if not n:
            return docs.limit(0)
        shown = KEYS[:-1]
        bound = kth_key(facts, shown, n)
        due = n - facts.where(up_to(shown, bound) & ~_equal(shown, bound)).count()
    rows = scored(docs, gains, key, text, seed)
    given = F.col("row").getField(key)
    rows = rows.select(
        "row", F.col("_score.n_features").alias("n_features"), (-F.col("_score.score")).alias("minus"), given.isNull().cast("int").alias("no_id"), F.coalesce(given.cast("long"), F.lit(0)).alias("id"),
        F.monotonically_increasing_id().alias("copy"),
    )
    rows = written(rows.where(eligible(min_words) & up_to(shown, bound)), "importance-drawn")
    tied = _equal(shown, bound)
    last = kth_key(rows.where(tied), ["copy"], due)[0]
    return rows.where(~tied | (F.col("copy") <= last)).select("row.*")


def _equal(keys: Sequence[str], bound: Sequence[int]) -> Column:
    out = F.lit(True)
    for name, value in zip(keys, bound, strict=True):
        out = out & (F.col(name) == value)
    return out


ORACLE = r"""
WITH crc AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM (SELECT unnest(range(256)) AS b))
), texts AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), w AS (
  SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), f AS (
  SELECT side, r, array_to_string(w[i : i + n - 1], ' ') AS f
  FROM (SELECT side, r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w CROSS JOIN (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)
), h AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x) // 2 + 1), lambda i: ('0x' || x[2 * i - 1 : 2 * i])::BIGINT)),
    lambda a, b: xor(a // 256, t[1 + xor(a % 256, b)])), 4294967295) % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)) CROSS JOIN crc
), b AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f JOIN h USING (f) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM b) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain FROM b
), d AS (
  SELECT w.r, any_value(w.doc_id) AS doc_id, any_value(len(w.w)) AS n_words, count(f.f) AS n_features, coalesce(sum(gain), 0)::BIGINT AS weight
  FROM w LEFT JOIN f ON f.r = w.r AND f.side = 'd' LEFT JOIN h ON h.f = f.f LEFT JOIN g ON g.bucket = h.bucket WHERE w.side = 'd' GROUP BY w.r
), e AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d
), o AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM e
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM o
"""
