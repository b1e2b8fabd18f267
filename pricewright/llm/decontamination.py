"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased and reduced to letters and digits.  A mask looks at some
positions of a stretch of words and ignores the others; documents and benchmark
items that agree under a mask at some place give a hit.  Around each hit the
document and the item are laid side by side without shifting, and the pair is
contaminated where ``WINDOW`` neighbouring words (or the whole item, if shorter)
agree in ``SHARE`` of them or more.  The two masks find every window of 13 words
with up to two substitutions, wherever these are.  Items of 8 to 12 words, which
may differ in one word (8, 9) or two, are also looked up under two masks of five
words; the four masks together miss no placement of these substitutions.

Items with fewer words than a mask's span are found as wholes and have to agree
in every word; items with fewer than ``min_words`` cannot be told from chance and
are left out (``left_out`` names them).

A benchmark of up to ``block_words`` words is broadcast with its hashes: the
documents are read once and not shuffled.  The hashes of a larger one are joined
with those of the documents, which are read once for them all: a bit table of a
fixed size lets through the documents' hashes that an item may have, and what
passes is joined by hash, each with the words around it, which is all that the
check needs.  Equal texts count once there, and the items are copied ``SALTS``
times, so that a passage which many texts share is dealt over as many tasks.

Null and empty texts on either side match nothing.  Repeated rows give repeated
results, rows with a null id too; repeated items count once.  Texts and items of
any length are read as a whole, hits are checked some at a time.  Empty tables
on either side give no rows.  Other columns, whatever their names, are not looked
at; ``clean`` carries them along.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm.shared import LONG_WORD, byte_texts, by_bytes, joined_by_key, session_of, written

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
#: In addition for items of SPAN to WINDOW - 1 words.
SHORT_MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
WINDOW, SHARE, MIN_WORDS = 13, 0.8, 5
#: Words of a benchmark that is broadcast: about 40 bytes each.
BLOCK_WORDS = 1_000_000
#: Bits of a hash by which an item's are looked up first, and those of the bit table for larger benchmarks (16 MB).
FILTER_BITS, TABLE_BITS = 22, 27
#: Bytes of texts that are hashed in one array, and hits that are checked in one.
BYTES_AT_ONCE, HITS_AT_ONCE = 1 << 18, 1 << 15
SALTS = 32
#: Words on each side of a mask's place that a window with it may hold; places without a word between texts.
AROUND = WINDOW - 1
PAD = AROUND + SPAN
#: Words of a hit with those around it.
CONTEXT = SPAN + 2 * AROUND


class WordHashes(dict):
    """word -> 64-bit hash of its letters and digits; 0 where it has none."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        plain = "".join(filter(str.isalnum, word.decode("utf-8", "replace").lower()))
        found = (xxhash.xxh3_64_intdigest(plain.encode()) | 1) if plain else 0
        if len(word) <= LONG_WORD:
            if len(self) > 150_000:
                self.clear()
            self[word] = found
        return found


@functools.lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, PAD zeros around each; where each text begins; its number of words."""
    of = word_hashes()
    cut = [t.split() for t in texts]
    every = np.array([of[w] for words in cut for w in words], np.uint64)
    full = every != 0
    sizes = np.diff(np.r_[0, np.cumsum(full)][np.r_[0, np.cumsum([len(w) for w in cut])].astype(np.int64)])
    begin = PAD + np.cumsum(sizes + PAD) - (sizes + PAD)
    words = np.zeros(PAD + int((sizes + PAD).sum()), np.uint64)
    words[np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))] = every[full]
    return words, begin, sizes


def masked(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the words that the mask looks at, for each place where it fits."""
    n = words.size - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, len(mask) * 1000 + mask[-1], np.uint64)
    for k, at in enumerate(mask):
        total = (total ^ words[at : at + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        total ^= total >> np.uint64(29)
    return total


def masks_for(n: int, min_words: int = MIN_WORDS) -> tuple[tuple[int, ...], ...]:
    """The masks under which an item of n words is looked up."""
    if n < min_words:
        return ()
    if n < SPAN:
        return (tuple(range(n)),)
    return MASKS if n >= WINDOW else MASKS + SHORT_MASKS


def places_of(words: np.ndarray, begin: np.ndarray, sizes: np.ndarray, mask: tuple[int, ...], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of the places ``at``, and which of these have the whole mask within their text."""
    text = np.searchsorted(begin, at, "right") - 1
    inside = (text >= 0) & (at + mask[-1] < begin[text] + sizes[text])
    return text, inside


def contexts(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The words around each place, CONTEXT of them; 0 where the text has ended."""
    around = np.arange(-AROUND, SPAN + AROUND)
    return words[np.clip(at[:, None] + around, 0, words.size - 1)]


def agreement(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of left and right contexts: the most words that agree in a window, and whether they are enough.

    A window lies within both texts; it has WINDOW words, or the item's ``sizes``
    if these are fewer.
    """
    there = (left != 0) & (right != 0)
    same = there & (left == right)
    most = np.zeros(sizes.size, np.int64)
    window = np.minimum(sizes, WINDOW)
    zero = np.zeros((sizes.size, 1), np.int16)
    both, agree = (np.concatenate([zero, np.cumsum(x, 1, dtype=np.int16)], 1) for x in (there, same))
    for n in np.unique(window).tolist():
        rows = np.flatnonzero(window == n)
        whole = both[rows, n:] - both[rows, :-n] == n
        most[rows] = np.where(whole, agree[rows, n:] - agree[rows, :-n], 0).max(1)
    need = np.where(sizes < SPAN, window, np.ceil(SHARE * window)).astype(np.int64)
    return most, most >= need


class Index:
    """Hashes of items, ready to be looked up from documents."""

    def __init__(self, items: list[tuple[int, bytes]], min_words: int = MIN_WORDS):
        self.keys = [k for k, _ in items]
        self.words, self.begin, self.sizes = hashed([t for _, t in items])
        wanted = [set(masks_for(n, min_words)) for n in self.sizes.tolist()]
        self.masks = []
        for mask in sorted(set().union(*wanted)):
            h = masked(self.words, mask)
            item, inside = places_of(self.words, self.begin, self.sizes, mask, np.arange(h.size))
            at = np.flatnonzero(inside & np.array([mask in w for w in wanted])[item])
            at = at[np.argsort(h[at], kind="stable")]
            known = np.zeros(1 << FILTER_BITS, bool)
            known[h[at] >> np.uint64(64 - FILTER_BITS)] = True
            self.masks.append((mask, h[at], item[at], at, known))

    def matches(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item key, most agreeing words of a window, item words) of each contaminated pair."""
        words, begin, sizes = hashed(texts)
        best: dict[tuple[int, int], int] = {}
        for mask, hashes, items, places, known in self.masks:
            h = masked(words, mask)
            at = np.flatnonzero(known[h >> np.uint64(64 - FILTER_BITS)])
            low, high = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            text, inside = places_of(words, begin, sizes, mask, at)
            hit = inside & (high > low)
            at, low, n, text = at[hit], low[hit], (high - low)[hit], text[hit]
            ends = np.cumsum(n)
            for first in range(0, int(ends[-1]) if ends.size else 0, HITS_AT_ONCE):
                number = np.arange(first, min(first + HITS_AT_ONCE, int(ends[-1])))
                of = np.searchsorted(ends, number, "right")
                k = low[of] + number - (ends - n)[of]
                most, enough = agreement(contexts(words, at[of]), contexts(self.words, places[k]), self.sizes[items[k]])
                for t, i, m in zip(text[of][enough].tolist(), items[k][enough].tolist(), most[enough].tolist(), strict=True):
                    best[t, i] = max(best.get((t, i), 0), m)
        return [(t, self.keys[i], m, int(self.sizes[i])) for (t, i), m in sorted(best.items())]


def words_of(text: str) -> F.Column:
    """About the words of a text: white space and one."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[\x20\x09-\x0D]+")) + 1, F.lit(0))


def items_of(benchmark: DataFrame, item: str, item_text: str) -> DataFrame:
    return benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).distinct()


def left_out(benchmark: DataFrame, item: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(item, text) of the items that have too few words to be looked for."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hashed(byte_texts(batch.column(1)))[2] < min_words))

    rows = items_of(benchmark, item, item_text)
    return rows.mapInArrow(few, rows.schema)


# --- large benchmarks: a join of hashes ---------------------------------------

HITS = "hash long, id binary, context binary, size int"


def _hashes(rows: DataFrame, masks_by_size: bool, min_words: int, table: np.ndarray | None) -> DataFrame:
    """(hash, id, context, size) of (id, text) rows: of all masks, or of those for a text's size; of what ``table`` lets through."""
    every = sorted({m for n in range(1, WINDOW + 1) for m in masks_for(n, min_words)})
    shared = None if table is None else rows.sparkSession.sparkContext.broadcast(table)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, BYTES_AT_ONCE):
                ids = part.column(0).cast(pa.binary()).to_pylist()
                words, begin, sizes = hashed(byte_texts(part.column(1)))
                for mask in every:
                    h = masked(words, mask)
                    at = np.arange(h.size) if shared is None else np.flatnonzero(passing(h, shared.value))
                    text, inside = places_of(words, begin, sizes, mask, at)
                    if masks_by_size:
                        inside &= np.array([mask in masks_for(n, min_words) for n in sizes.tolist()], bool)[text]
                    at, text = at[inside], text[inside]
                    for k in range(0, at.size, HITS_AT_ONCE):
                        a, t = at[k : k + HITS_AT_ONCE], text[k : k + HITS_AT_ONCE]
                        around = [x.tobytes() for x in contexts(words, a)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h[a].view(np.int64)), pa.array([ids[i] for i in t.tolist()], pa.binary()), pa.array(around, pa.binary()), pa.array(sizes[t], pa.int32())],
                            names=["hash", "id", "context", "size"],
                        )

    return rows.mapInArrow(find, HITS)


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of the bit table for each hash."""
    return h >> np.uint64(64 - TABLE_BITS), (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


def passing(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    first, second = _bits(h)
    test = lambda at: (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
    return (test(first) & test(second)).astype(bool)


def bit_table(hashes: DataFrame) -> np.ndarray:
    """All items' hashes in a table of 2**TABLE_BITS bits; its words are gathered, 2**TABLE_BITS / 64 at most."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_bits(batch.column(0).to_numpy().view(np.uint64)))
            word, bit = (at >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit)], names=["word", "bits"])

    found = hashes.select("hash").mapInArrow(place, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def _joined(docs: DataFrame, text: str, items: DataFrame, min_words: int) -> DataFrame:
    """(digest of a text, item, n_matched, n_item_words), a row per different text and item."""
    of_items = written(_hashes(items.select(F.col("item").cast("string"), "text"), True, min_words, None), "benchmark-hashes")
    texts = docs.where(F.col(text).isNotNull()).select(F.md5(F.col(text).cast("binary")).alias("digest"), F.col(text).alias("text"))
    hits = _hashes(texts, False, min_words, bit_table(of_items)).select("hash", F.col("id").alias("digest"), F.col("context").alias("around")).distinct()
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)))
    pairs = hits.join(of_items.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["hash", "salt"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, CONTEXT) for k in (2, 3))
            most, enough = agreement(left, right, batch.column(4).to_numpy().astype(np.int64))
            rows = batch.select(["digest", "item", "size"]).append_column("most", pa.array(most, pa.int32()))
            yield rows.filter(pa.array(enough))

    checked = pairs.select("digest", F.col("id").alias("item"), "around", "context", "size").mapInArrow(check, "digest binary, item binary, size int, most int")
    found = checked.groupBy("digest", "item").agg(F.max("most").alias("n_matched"), F.max("size").alias("n_item_words"))
    return written(found.select(F.col("digest").cast("string").alias("digest"), F.col("item").cast("string").cast("long").alias("item"), "n_matched", "n_item_words"), "benchmark-pairs")


def _is_large(items: DataFrame, block_words: int) -> bool:
    return items.agg(F.coalesce(F.sum(words_of("text")), F.lit(0))).first()[0] > block_words


def _broadcast_index(items: DataFrame, min_words: int):
    return items.sparkSession.sparkContext.broadcast(Index([(r["item"], r["text"].encode()) for r in items.collect()], min_words))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, item, n_matched, n_item_words): a row per document and item it holds; n_matched is of the best window."""
    session_of(docs)
    items = items_of(benchmark, item, item_text)
    if _is_large(items, block_words):
        found = _joined(docs, text, items, min_words)
        rows = written(docs.select(F.col(key).alias("key"), F.md5(F.col(text).cast("binary")).alias("digest")), "document-digests")
        held = found.groupBy("digest").agg(F.collect_list(F.struct("item", "n_matched", "n_item_words")).alias("held"))
        often = rows.join(found.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.count("*").alias("n"))
        rows = joined_by_key(rows, written(held.join(often, "digest"), "benchmark-held"), "digest", rows.count(), "inner")
        return rows.select(F.col("key").alias(key), F.explode("held").alias("held")).select(F.col(f"`{key}`"), F.col("held.item").alias(item), "held.n_matched", "held.n_item_words")
    index = _broadcast_index(items, min_words)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item}` long, n_matched int, n_item_words int"

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in by_bytes(batch, 1, BYTES_AT_ONCE):
                rows = index.value.matches(byte_texts(piece.column(1)))
                at, items, matched, sizes = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(pa.array(at, pa.int64())), pa.array(items, pa.int64()), pa.array(matched, pa.int32()), pa.array(sizes, pa.int32())],
                    names=[key, item, "n_matched", "n_item_words"],
                )

    return docs.select(key, text).mapInArrow(match, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    session_of(docs)
    items = items_of(benchmark, item, item_text)
    if _is_large(items, block_words):
        gone = written(_joined(docs, text, items, min_words).select("digest").distinct(), "benchmark-texts")
        return docs.join(gone, F.md5(docs[text].cast("binary")) == gone["digest"], "left_anti")
    index, at = _broadcast_index(items, min_words), docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in by_bytes(batch, at, BYTES_AT_ONCE):
                hit = {row[0] for row in index.value.matches(byte_texts(piece.column(at)))}
                yield piece.filter(pa.array([i not in hit for i in range(piece.num_rows)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
