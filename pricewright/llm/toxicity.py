"""Toxicity by a factorization machine over hashed terms.

A document's terms are its words (lower case, letters and digits only) and the
first five letters of longer words, hashed into a fixed number of places.  A
place's value is ``10 * log1p(count) / sqrt(words)``.  The machine adds to its
linear weights an inner product for every pair of places, so it learns, say, an
insult together with the mention of a group.

Learning uses a bounded sample of the labelled training rows (``max_rows`` ids
and ``max_entries`` places of texts, both parameters; all rows below them).  No
place is judged alone before its pairs are learnt: all that ``min_docs`` sampled
texts hold go into the machine.  Its steps shrink each linear weight and each
vector of factors by a constant, so that both end at exactly 0 where neither the
place nor a pair with it helps; such places leave the machine from the fourth
epoch on, and the last epochs fit the others almost without shrinking.

Held-out rows (crc32 of the id as text, modulo 5, is 0) are never learnt from.
Null and empty texts score by the bias alone; rows with a null id count as
training rows without a label.  Labels that are null are left out; of repeated
labels of an id the highest counts, and of repeated rows of an id its longest
text is learnt from, once.  Without any label of either kind every score is the
smoothed share of toxic labels.  Every row is scored, repeated ones each; an
empty table gives no rows.  Texts of any length are read as a whole.  Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.llm.shared import LONG_WORD, byte_texts, scratch, session_of, written

PLACES = 1 << 18
MAX_ROWS, MAX_ENTRIES = 20_000, 12_000_000
MIN_DOCS, RANK = 5, 8


class TermPlaces(dict):
    """word -> its places, remembered for words seen before."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        plain = "".join(filter(str.isalnum, word.decode("utf-8", "replace").lower()))
        places: tuple[int, ...] = ()
        if plain:
            places = (zlib.crc32(b"w" + plain.encode()) % PLACES,)
            if len(plain) > 5:
                places += (zlib.crc32(b"p" + plain[:5].encode()) % PLACES,)
        if len(word) <= LONG_WORD:
            if len(self) > 300_000:
                self.clear()
            self[word] = places
        return places


@functools.lru_cache(maxsize=1)
def term_places() -> TermPlaces:
    return TermPlaces()


def terms(text: bytes, of: TermPlaces, wanted: frozenset[int] | None = None) -> tuple[dict[int, int], int]:
    """Counts of a text's places (the wanted ones) and its number of words."""
    words = text.split()
    found: Counter[int] = Counter()
    for word, n in Counter(words).items():
        for place in of[word]:
            if wanted is None or place in wanted:
                found[place] += n
    return found, len(words)


def value(count: int, words: int) -> float:
    return 10 * math.log1p(count) / math.sqrt(max(words, 1))


@dataclass(frozen=True)
class Machine:
    """Weights of the places that were kept."""

    places: dict[int, int]
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, found: dict[int, int], words: int) -> float:
        z = self.bias
        if found:
            at = [self.places[p] for p in found]
            x = np.array([value(n, words) for n in found.values()])
            v = self.factors[at] * x[:, None]
            z += self.linear[at] @ x + 0.5 * float((v.sum(0) ** 2 - (v * v).sum(0)).sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def constant(n: int, toxic: int, rank: int = RANK) -> Machine:
    """The smoothed share of toxic labels for every text."""
    share = (toxic + 0.5) / (n + 2)
    return Machine({}, math.log(share / (1 - share)), np.zeros(0), np.zeros((0, rank)))


def fitted(
    y: np.ndarray, sizes: np.ndarray, at: np.ndarray, x: np.ndarray, places: list[int], rank: int = RANK,
    epochs: int = 25, last_epochs: int = 10, rate: float = 0.2, shrink: float = 0.1, prune_from: int = 3, seed: int = 7,
) -> Machine:
    """Weights by adaptive gradient steps on the logistic loss; same rows, same weights.

    Row k has label ``y[k]`` and ``sizes[k]`` entries of ``at`` (numbers of
    ``places``) and ``x`` (their values).
    """
    y, m = y.astype(float), len(places)
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(m), rng.normal(0, 0.05, (m, rank)), math.log(y.mean() / (1 - y.mean()))
    gw, gv, gb = np.full(m, 1e-2), np.full((m, rank), 1e-2), 1e-1
    batches = max(1, y.size // min(256, max(16, y.size // 64)))
    number = np.zeros(m, np.int64)
    for epoch in range(epochs + last_epochs):
        if epoch >= prune_from:
            stay = ((w != 0) | (v != 0).any(1))[at]
            sizes = np.diff(np.r_[0, np.cumsum(stay, dtype=np.int64)][np.r_[0, np.cumsum(sizes)]])
            at, x = at[stay], x[stay]
        less = shrink if epoch < epochs else 0.02 * shrink
        starts = np.cumsum(sizes) - sizes
        for batch in np.array_split(rng.permutation(y.size), batches):
            n = sizes[batch]
            full = np.flatnonzero(n)
            doc = np.repeat(np.arange(batch.size), n)
            take = np.repeat(starts[batch] - np.cumsum(n) + n, n) + np.arange(n.sum())
            i, xi = at[take], x[take].astype(float)
            vi = v[i] * xi[:, None]
            total, z = np.zeros((batch.size, rank)), np.full(batch.size, b)
            if full.size:
                begin = (np.cumsum(n) - n)[full]
                total[full] = np.add.reduceat(vi, begin)
                z[full] += np.add.reduceat(w[i] * xi - 0.5 * (vi * vi).sum(1), begin)
            g = 1 / (1 + np.exp(-np.clip(z + 0.5 * (total**2).sum(1), -30, 30))) - y[batch]
            gb += g.sum() ** 2
            b -= rate * g.sum() / math.sqrt(gb)
            if not full.size:
                continue
            own = np.flatnonzero(np.bincount(i, minlength=m))
            number[own] = np.arange(own.size)
            k, gx = number[i], g[doc] * xi
            dw = np.bincount(k, gx, own.size)
            dv = np.bincount((k[:, None] * rank + np.arange(rank)).ravel(), (gx[:, None] * (total[doc] - vi)).ravel(), own.size * rank).reshape(-1, rank)
            gw[own] += dw**2
            gv[own] += dv**2
            step = rate / np.sqrt(gw[own])
            moved = w[own] - step * dw
            w[own] = np.sign(moved) * np.maximum(np.abs(moved) - less * step, 0)
            step = 0.3 * rate / np.sqrt(gv[own])
            moved = v[own] - step * dv
            size = np.sqrt((moved**2).sum(1))
            v[own] = moved * np.maximum(1 - less * step.mean(1) / np.maximum(size, 1e-12), 0)[:, None]
    live = np.flatnonzero((w != 0) | (v != 0).any(1))
    return Machine({places[k]: n for n, k in enumerate(live.tolist())}, float(b), w[live], v[live])


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_entries: int = MAX_ENTRIES, min_docs: int = MIN_DOCS) -> Machine:
    """Fit a machine on labelled rows that are not held out."""
    with scratch(session_of(docs)):
        return _learnt(docs, labels, key, text, label, max_rows, max_entries, min_docs)


def _learnt(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_rows: int, max_entries: int, min_docs: int) -> Machine:
    train = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    total = train.count()
    if total > max_rows:
        train = train.where(F.pmod(F.xxhash64(F.lit("train"), "key"), F.lit(1_000_000)) < int(1_000_000 * max_rows / total))
    # At most about max_rows small rows: their size is bounded, so they are broadcast.
    sample = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(train), "key").select("y", F.col("key").cast("string"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t, term_places()) for t in byte_texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for _, n in found], pa.int64()), pa.array([list(f) for f, _ in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f, _ in found], pa.list_(pa.int32()))],
                names=["y", "key", "words", "places", "counts"],
            )

    counted = sample.mapInArrow(count, "y int, key string, words long, places array<int>, counts array<int>")
    once = counted.groupBy("key").agg(F.max(F.struct("words", "places", "counts", "y")).alias("row"))
    rows = written(once.select("row.y", "key", "row.words", "row.places", "row.counts"), "toxicity-terms")
    entries = rows.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    if entries > max_entries:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("entries"), "key"), F.lit(1_000_000)) < int(1_000_000 * max_entries / entries))
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or toxic in (0, n):
        return constant(n, toxic)
    seen = rows.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("docs"))
    places = sorted(r["place"] for r in seen.where(F.col("docs") >= min_docs).select("place").collect())
    number = np.full(PLACES, -1, np.int32)
    number[places] = np.arange(len(places))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, counts, words = batch.column(3), batch.column(4), batch.column(2).to_numpy()
            sizes, at = lists.value_lengths().to_numpy(), number[lists.flatten().to_numpy()]
            x = (10 * np.log1p(counts.flatten().to_numpy()) / np.sqrt(np.maximum(np.repeat(words, sizes), 1))).astype(np.float32)
            ends = pa.array(np.r_[0, np.cumsum(at >= 0)][np.r_[0, np.cumsum(sizes)]], pa.int32())
            own = [pa.ListArray.from_arrays(ends, pa.array(v[at >= 0])) for v in (at, x)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *own], names=["y", "key", "at", "x"])

    sample = rows.mapInArrow(keep, "y int, key string, at array<int>, x array<float>").orderBy("key").drop("key").toArrow()
    sizes = np.concatenate([c.value_lengths().to_numpy() for c in sample["at"].chunks])
    at, x = (np.concatenate([c.flatten().to_numpy() for c in sample[name].chunks]) for name in ("at", "x"))
    y = sample["y"].to_numpy()
    del sample
    return fitted(y, sizes, at, x, places)


def scored(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: held_out, score and predicted."""
    session_of(docs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = frozenset(machine.places)
        for batch in batches:
            scores = [machine.score(*terms(t, term_places(), wanted)) for t in byte_texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=[key, "held_out", "score", "predicted"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, held_out(key).alias("held_out"), text).mapInArrow(score, f"`{key}` {kind}, held_out boolean, score double, predicted int")
