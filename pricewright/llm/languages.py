"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point.  An
n-gram of three symbols is bound to one vector: the product of its letters'
vectors, each permuted (rolled) by its place.  The vectors of all n-grams of a text
are bundled to their sum, and those of all training texts of a language to its
prototype.  A document has the language whose prototype's cosine is highest.

Letters are in lower case; combining marks count as letters, everything else is a
boundary, of which a run counts once; texts begin and end with one.  Bundles are
sums of whole numbers, so they do not depend on how rows are dealt.

Learning takes the whole texts of all rows with a language that are not held out
(crc32 of the id as text, modulo 5, is 0).  Null and empty texts, and those
without a letter, are ``und`` with score 0, and so is every text where no language
was learnt.  Null ids are not held out.  Ties go to the language first in
code-point order.  Repeated rows count each; an empty table gives no rows.  Texts
are read as a whole, whatever their length.  Other columns are not looked at,
whatever their names.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.llm.shared import by_bytes, byte_texts, session_of

DIMENSIONS, SEED = 1024, 12
#: Bytes of text whose arrays a task holds at a time; n-gram vectors and cells of a table of counts at a time.
BYTES_AT_ONCE, GRAMS_AT_ONCE, CELLS = 2 << 20, 2048, 4 << 20
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def symbol_kinds() -> np.ndarray:
    """For each code point: 2 a letter, 1 a combining mark, 0 a boundary."""
    kinds = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            kinds[code] = 2
        elif unicodedata.category(c)[0] == "M":
            kinds[code] = 1
    return kinds


@functools.lru_cache(maxsize=4096)
def letter_vector(code: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """The random vector of a code point; 0 is the boundary."""
    bits = np.random.default_rng([seed, code]).integers(0, 2, dimensions, dtype=np.int8)
    return bits * 2 - 1


@dataclass(frozen=True)
class Grams:
    """N-grams of some texts: what they are, and of each text which and how often."""

    letters: np.ndarray  # code points of the symbols
    first: np.ndarray  # symbols of the distinct n-grams
    second: np.ndarray
    third: np.ndarray
    text: np.ndarray  # text, n-gram and number of each pair that occurs
    gram: np.ndarray
    times: np.ndarray
    lettered: np.ndarray  # whether a text has a letter


def grams(texts: list[bytes]) -> Grams:
    lowered = [t.decode("utf-8", "replace").lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 2
    codes = np.frombuffer("".join(f" {t} " for t in lowered).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(len(texts)), sizes)
    kinds = symbol_kinds()[codes]
    lettered = np.zeros(len(texts), bool)
    lettered[of[kinds == 2]] = True
    inner = kinds > 0
    # Boundaries that follow another one of their text go; marks without a letter stay what they are.
    stay = inner | np.r_[True, inner[:-1] | (of[1:] != of[:-1])]
    codes, of = np.where(inner, codes, 0)[stay], of[stay]
    letters = np.flatnonzero(np.bincount(codes, minlength=1)).astype(np.uint32)
    number = np.zeros(int(letters[-1]) + 1 if letters.size else 1, np.int64)
    number[letters] = np.arange(letters.size)
    s, m = number[codes], letters.size
    if s.size < 3:
        at = np.zeros(0, np.int64)
    else:
        at = np.flatnonzero((of[2:] == of[:-2]) & ((codes[:-2] > 0) | (codes[1:-1] > 0) | (codes[2:] > 0)))
    code, of = (s[at] * m + s[at + 1]) * m + s[at + 2], of[at]
    if m**3 <= CELLS:
        seen = np.zeros(m**3, bool)
        seen[code] = True
        distinct = np.flatnonzero(seen)
        place = np.cumsum(seen) - 1
        which = place[code]
    else:
        distinct, which = np.unique(code, return_inverse=True)
    pair = of * max(1, distinct.size) + which
    if len(texts) * distinct.size <= CELLS:
        counts = np.bincount(pair, minlength=1)
        pairs = np.flatnonzero(counts)
        times = counts[pairs]
    else:
        pairs, times = np.unique(pair, return_counts=True)
    n = max(1, distinct.size)
    return Grams(letters, distinct // (m * m), distinct // m % m, distinct % m, pairs // n, pairs % n, times, lettered)


def bundles(found: Grams, rows: np.ndarray, n: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """The bundled vectors of n rows; ``rows`` tells to which row each text goes.

    A matrix of counts times the n-grams' vectors, some n-grams at a time.  All
    sums are whole numbers below 2**53, or 2**24 in the shorter type.
    """
    total = np.bincount(rows[found.text], found.times, n)
    kind = np.float32 if total.max(initial=0) < 1 << 24 else np.float64
    base = np.array([letter_vector(c, dimensions, seed) for c in found.letters.tolist()], np.int8).reshape(-1, dimensions)
    places = [np.roll(base, 2, 1), np.roll(base, 1, 1), base]
    out = np.zeros((n, dimensions), kind)
    order = np.argsort(found.gram, kind="stable")
    gram, row, times = found.gram[order], rows[found.text[order]], found.times[order]
    for low in range(0, found.first.size, GRAMS_AT_ONCE):
        high = min(low + GRAMS_AT_ONCE, found.first.size)
        vectors = places[0][found.first[low:high]] * places[1][found.second[low:high]] * places[2][found.third[low:high]]
        part = slice(*np.searchsorted(gram, [low, high]))
        counts = np.bincount(row[part] * (high - low) + gram[part] - low, times[part], n * (high - low)).reshape(n, -1)
        out += counts.astype(kind) @ vectors.astype(kind)
    return out


@dataclass(frozen=True)
class Profiles:
    """A prototype of length 1 for each language, in code-point order."""

    languages: list[str]
    prototypes: np.ndarray


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> Profiles:
    """Bundle all training texts of each language.

    A task sums its texts' vectors by language; Spark adds those up, and one
    vector a language comes back.
    """
    session_of(docs)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).select(F.col(lang).cast("string"), text)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in by_bytes(batch, 1, BYTES_AT_ONCE):
                found = grams(byte_texts(part.column(1)))
                names = part.column(0).to_pylist()
                of = {name: k for k, name in enumerate(dict.fromkeys(names))}
                vectors = bundles(found, np.array([of[x] for x in names]), len(of), dimensions, seed)
                for name, k in of.items():
                    total[name] = total.get(name, 0) + vectors[k].astype(np.int64)
        for name, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(vector)], names=["lang", "at", "value"])

    found = rows.mapInArrow(bundle, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value")).toPandas()
    languages = sorted(set(found["lang"]))
    prototypes = np.zeros((len(languages), dimensions))
    prototypes[[languages.index(x) for x in found["lang"]], found["at"].to_numpy(np.int64)] = found["value"]
    length = np.sqrt((prototypes**2).sum(1, keepdims=True))
    return Profiles(languages, prototypes / np.maximum(length, 1e-300))


def predicted(docs: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """A row per document: held_out, lang_pred and the cosine with its prototype as score, at least 0."""
    session_of(docs)
    dimensions = profiles.prototypes.shape[1]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*profiles.languages, UNKNOWN])
        for batch in batches:
            for part in by_bytes(batch, 2, BYTES_AT_ONCE):
                n = part.num_rows
                best, score = np.full(n, len(profiles.languages)), np.zeros(n)
                if profiles.languages:
                    found = grams(byte_texts(part.column(2)))
                    vectors = bundles(found, np.arange(n), n, dimensions, seed).astype(np.float64)
                    length = np.sqrt((vectors**2).sum(1))
                    cosine = (vectors @ profiles.prototypes.T) / np.maximum(length, 1e-300)[:, None]
                    best = np.where(found.lettered, cosine.argmax(1), best)
                    score = np.where(found.lettered, np.clip(cosine.max(1), 0, 1), 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), names.take(pa.array(best)), pa.array(score)], names=[key, "held_out", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, held_out(key).alias("held_out"), text).mapInArrow(predict, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")
