"""Near-duplicate documents by fast similarity sketching, banding and exact checks.

A document's set holds its distinct ``words``-word shingles (words are runs
outside space and U+0009-U+000D, A-Z in lower case); with fewer words the whole
sequence is its one shingle.  Documents whose sets have a Jaccard similarity of
``percent`` / 100 or more are linked, and linked documents form groups.

Sketches have ``BINS`` coordinates.  In round i every shingle is hashed to a bin
and a value, and the bin keeps the smallest ``i + value``; once no bin is empty,
later rounds cannot change anything.  Rounds past ``BINS`` throw every shingle
into the one bin ``i - BINS``, so each coordinate is filled by round 2 * BINS at
the latest.  Documents that agree in all coordinates of a band are candidates;
``banding`` makes the bands so that a pair at the threshold is missed once in a
million at most.

1. Documents with the same set are one node, that of the smallest key.
2. In every band value the smallest node is the hub, and each other node is
   checked against it on the full sets.
3. Checked links are contracted to groups.  Nodes that band values connect form
   clusters; where a cluster holds more than one group, the pairs across groups,
   whose sketches do not rule a link out, are checked, too, within tasks that
   hold two blocks of the cluster each.  Pairs within a group have nothing left
   to add, and only links that join something leave a task.
4. All links together give the groups.

Null and empty texts have an empty set and are linked with nothing.  Rows with
one key are one node; all of them get its result, and ``kept``.  A null key is
in no group: its ``component_id`` is null and the row is kept.  Texts of any
length are hashed as a whole.  Other columns, whatever their names, are not
looked at; ``distinct_documents`` carries them along.  An empty table gives no
rows.

Sets and band values that more than a thousandth of all rows share are fewer than
a thousand and are broadcast, so that no task gathers their rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm.shared import LONG_WORD, byte_texts, joined_by_key, scratch, session_of, written

BINS = 120
WORDS, PERCENT = 3, 85
#: How often the bands may miss a pair whose similarity is just the threshold.
MISSES = 1e-6
#: Nodes of a block, when a cluster's nodes are compared two blocks at a time.
BLOCK = 256
#: Checks with one node that are streamed in one go; more are split.
CHECKS = 2000
#: Texts are hashed together up to so many bytes.
BYTES_AT_ONCE = 1 << 19
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: What the hash of round i adds to every shingle.
_ROUNDS = np.arange(1, 2 * BINS + 1, dtype=np.uint64) * _GOLD


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG_WORD:
            if len(self) > 150_000:
                self.clear()
            self[word] = found
        return found


@functools.lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and where each text's begin."""
    of = word_hashes()
    cut = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    every = np.fromiter((of[w] for ws in cut for w in ws), np.uint64, int(sizes.sum()))
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    # A text of fewer words has one shingle, padded with a mark that no word has.
    n = np.where(sizes == 0, 0, np.maximum(1, sizes - words + 1))
    doc = np.repeat(np.arange(len(cut)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    shingle = np.full(doc.size, words, np.uint64)
    for k in range(words):
        inside = at + k < sizes[doc]
        word = np.where(inside, every[np.minimum(first[doc] + at + k, max(every.size - 1, 0))], np.uint64(0)) if every.size else np.zeros(0, np.uint64)
        shingle = mixed((shingle + _GOLD) ^ word)
    order = np.lexsort((shingle, doc))
    shingle, doc = shingle[order], doc[order]
    own = np.ones(doc.size, bool)
    own[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    shingle, doc = shingle[own], doc[own]
    return shingle, np.searchsorted(doc, np.arange(len(cut) + 1))


def sketches(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of ``BINS`` coordinates a set: the hashes of the shingles that fill them.

    Rounds go on for the sets that still have an empty bin.
    """
    n, bins = starts.size - 1, BINS
    # Round and value of each bin as one number: the round above 52 bits of value.
    best = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(starts))
    going = shingles
    for i in range(2 * bins):
        h = mixed(going + _ROUNDS[i])
        value = (np.uint64(i) << np.uint64(52)) | (h >> np.uint64(12))
        at = (h & np.uint64(0xFFF)) % np.uint64(bins) if i < bins else np.full(h.size, i - bins, np.uint64)
        np.minimum.at(best, doc * bins + at.astype(np.int64), value)
        empty = (best.reshape(n, bins) == np.iinfo(np.uint64).max).any(1)
        if not empty[doc].any():
            break
        stay = empty[doc]
        going, doc = going[stay], doc[stay]
    return best.reshape(n, bins)


def banding(percent: int) -> int:
    """The fewest bands that miss a pair at ``percent`` in ``MISSES`` or less: 24 at 85 %, 30 at 80 %."""
    every = [b for b in range(1, BINS + 1) if BINS % b == 0]
    return next((b for b in every if (1 - (percent / 100) ** (BINS // b)) ** b <= MISSES), BINS)


def band_hashes(sketch: np.ndarray, bands: int) -> np.ndarray:
    """One hash a band of each sketch; the band's number is part of it."""
    n, bins = sketch.shape
    rows = sketch.reshape(n, bands, bins // bands)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, (n, bands)).copy()
    for k in range(bins // bands):
        total = mixed(total ^ rows[:, :, k])
    return total


def batched(texts: list[bytes]) -> Iterator[slice]:
    k = 0
    while k < len(texts):
        begin, size = k, 0
        while k < len(texts) and (k == begin or size + len(texts[k]) <= BYTES_AT_ONCE):
            size += len(texts[k])
            k += 1
        yield slice(begin, k)


SIGNATURES = "key long, n_shingles long, digest binary, bands array<long>"


def signatures(docs: DataFrame, key: str, text: str, words: int, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, digest of the set, bands) of every row."""
    n_bands = banding(percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = byte_texts(batch.column(1))
            for part in batched(texts):
                shingles, starts = shingle_sets(texts[part], words)
                found = sketches(shingles, starts)
                n = np.diff(starts)
                bands = pa.FixedSizeListArray.from_arrays(pa.array(band_hashes(found, n_bands).view(np.int64).ravel()), n_bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, part.stop - part.start).cast(pa.int64()), pa.array(n, pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(shingles[a:b].tobytes()) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.binary()),
                        bands,
                    ],
                    names=["key", "n_shingles", "digest", "bands"],
                )

    return docs.select(F.col(key).cast("long").alias("key"), text).mapInArrow(sign, SIGNATURES)


def verified(texts: DataFrame, pairs: DataFrame, n_pairs: int, words: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are similar enough, from (node, text) rows.

    For each a the texts of its partners are streamed past its own.  An a with
    many partners is split, with its own text once in each part.
    """
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHECKS).alias("parts"))
    legs = pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    legs = legs.select(F.col("b").alias("id"), "a", "part").unionByName(legs.select(F.col("a").alias("id"), "a", "part").distinct())
    rows = texts.withColumnRenamed("node", "id").join(written(legs, "near-checks", rows=2 * n_pairs), "id")
    rows = rows.select("a", "part", (F.col("id") != F.col("a")).alias("partner"), F.col("id").alias("b"), "text")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "a", "part").sortWithinPartitions("a", "part", "partner", "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, own = None, []
        for batch in batches:
            texts = byte_texts(batch.column(4))
            ids = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            partner, others = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            left, right = [], []
            for part in batched(texts):
                shingles, starts = shingle_sets(texts[part], words)
                for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True), part.start):
                    if not partner[k]:
                        own = own if of == ids[k] else []
                        own.append(shingles[a:b].copy())
                        of = ids[k]
                        continue
                    if of == ids[k] and any(similar(x, shingles[a:b], percent) for x in own):
                        left.append(ids[k][0])
                        right.append(others[k])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return written(rows.mapInArrow(check, "a long, b long"), "near-links")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets, sorted, have percent / 100 of their union in common."""
    if not a.size or not b.size or 100 * min(a.size, b.size) < percent * max(a.size, b.size):
        return False
    at = np.minimum(np.searchsorted(a, b), a.size - 1)
    both = int((a[at] == b).sum())
    return 100 * both >= percent * (a.size + b.size - both)


def components(edges: DataFrame, n: int) -> DataFrame:
    """(node, label): the smallest node that each node of ``n`` (a, b) edges, at most, can reach.

    Edges are turned to the smallest neighbour, of the larger neighbours and of
    the smaller ones in turn, until every group is a star; written in each turn.
    No turn makes more edges than there were.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).withColumn("m", F.least("w", "m"))
        large = both.join(least, both["u"] == least["w"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(least, large["u"] == least["w"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "near-groups", rows=n)
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before, n = now, now[0]


def crossing_links(texts: DataFrame, candidates: DataFrame, groups: DataFrame, n_nodes: int, words: int, percent: int) -> DataFrame:
    """(a, b): links between different groups of ``candidates``, (node, label) clusters.

    A cluster's largest group is its core.  Blocks of the other nodes meet each
    other and the blocks of the core; the core's blocks need not meet.  A task
    compares two blocks: it tries the pairs that sketches do not rule out, the
    likeliest first, skips those that are joined already, and gives what joins.
    """
    members = candidates.select(F.col("label").alias("cluster"), "node").unionByName(candidates.select(F.col("label").alias("cluster"), F.col("label").alias("node")).distinct())
    members = written(members.join(groups, "node", "left").select("cluster", "node", F.coalesce("label", "node").alias("group")), "near-members", rows=n_nodes)
    sizes = members.groupBy("cluster", "group").agg(F.count("*").alias("n"))
    clusters = sizes.groupBy("cluster").agg(F.max_by("group", F.struct("n", "group")).alias("core"), F.max("n").alias("n_core"), F.sum("n").alias("n")).where("n > n_core AND n > 2")
    rows = members.join(written(clusters, "near-clusters", rows=n_nodes), "cluster")
    rows = rows.withColumns({"others": F.ceil((F.col("n") - F.col("n_core")) / BLOCK).cast("int"), "cores": F.ceil(F.col("n_core") / BLOCK).cast("int")})
    inside = F.col("group") == F.col("core")
    own = F.when(inside, F.col("others") + F.pmod(F.xxhash64("node"), F.col("cores"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
    to = F.sequence(F.lit(0), F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("cores")) - 1)
    rows = rows.withColumn("own", own).withColumn("to", F.explode(to))
    rows = rows.select("cluster", F.least("own", "to").alias("x"), F.greatest("own", "to").alias("y"), "own", "node", "group").join(texts, "node")
    # What a sketch shows of a similar pair is below this once in millions of pairs.
    share = percent / 100
    least = math.floor(BINS * share - 5 * math.sqrt(BINS * share * (1 - share)))

    def compare(table: pa.Table) -> pa.Table:
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        own, node, group = (table[c].to_numpy() for c in ("own", "node", "group"))
        sets, sketch = [], []
        every = byte_texts(table["text"])
        for part in batched(every):
            shingles, starts = shingle_sets(every[part], words)
            sets += [shingles[i:j] for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            sketch.append((mixed(sketches(shingles, starts)) & np.uint64(0xFF)).astype(np.uint8))
        sketch = np.concatenate(sketch)
        first, second = np.flatnonzero(own == x), np.flatnonzero(own == y)
        found = []
        for i in first.tolist():
            to = second[group[second] != group[i]]
            to = to[to > i] if x == y else to
            same = (sketch[to] == sketch[i]).sum(1)
            near = np.flatnonzero(same >= least)
            found.append(np.stack([same[near], np.full(near.size, i), to[near]]))
        pairs = np.concatenate(found, 1) if found else np.zeros((3, 0), int)
        parent: dict[int, int] = {}

        def root(g: int) -> int:
            while (up := parent.get(g, g)) != g:
                g = up
            return g

        left, right = [], []
        for k in np.argsort(-pairs[0], kind="stable").tolist():
            i, j = int(pairs[1, k]), int(pairs[2, k])
            g, h = root(int(group[i])), root(int(group[j]))
            if g != h and similar(sets[i], sets[j], percent):
                parent[max(g, h)] = min(g, h)
                left.append(node[i])
                right.append(node[j])
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return written(rows.groupBy("cluster", "x", "y").applyInArrow(compare, "a long, b long"), "near-crossing")


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row."""
    spark = session_of(docs)
    signed = written(signatures(docs, key, text, words, percent), "near-signatures")
    with scratch(spark):
        n = signed.count()
        groups = written(_groups(docs, signed, n, key, text, words, percent), "near-components", keep=True, rows=n)
    of = F.coalesce("label", "key")
    rows = signed.select("key", "n_shingles").join(groups, signed["key"] == groups["node"], "left")
    return rows.select("key", "n_shingles", of.alias("component_id"), F.coalesce(of == F.col("key"), F.lit(True)).alias("kept"))


def _groups(docs: DataFrame, signed: DataFrame, n: int, key: str, text: str, words: int, percent: int) -> DataFrame:
    """(node, label) of the keys that are linked with another; ``signed`` has n rows."""
    full = signed.where("n_shingles > 0 AND key IS NOT NULL")
    sets = full.groupBy("digest").agg(F.min("key").alias("node"), F.count("*").alias("n")).where("n > 1")
    same = joined_by_key(full.select("key", "digest"), written(sets, "near-digests", rows=n), "digest", n)
    same = written(same.select("key", F.coalesce("node", "key").alias("node")), "near-sets", rows=n)
    # Rows of one key with several sets bring the bands of all of them.
    nodes = full.join(same.where("key = node").select("node").distinct(), F.col("key") == F.col("node"), "left_semi")
    nodes = nodes.select(F.col("key").alias("node"), "bands").distinct()
    values = nodes.select("node", F.explode("bands").alias("band"))
    hubs = written(values.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"), "near-hubs", rows=n * banding(percent) // 2)
    n_near = hubs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    near = joined_by_key(values, hubs, "band", n_near, "inner").where("node <> hub")
    pairs = written(near.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs", rows=n_near)
    n_pairs = pairs.count()
    wanted = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "near-nodes", rows=n)
    texts = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text")).join(wanted, "node")
    texts = written(texts, "near-texts")
    links = verified(texts, pairs, n_pairs, words, percent)
    alike = same.where("key <> node").select(F.col("node").alias("a"), F.col("key").alias("b"))
    # Keys of one set are joined from the start: a key may stand for several sets.
    groups = components(links.unionByName(alike), n_pairs + n)
    more = crossing_links(texts, components(pairs, n_pairs), groups, n, words, percent)
    if n_more := more.count():
        old = groups.select(F.col("node").alias("a"), F.col("label").alias("b"))
        groups = components(old.unionByName(more), n + n_more)
    return groups


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose key is its group's smallest, with all their columns."""
    gone = grouped(docs, key, text, words, percent).where("NOT kept").select(F.col("key").alias("gone")).distinct()
    gone = written(gone, "near-gone")
    return docs.join(gone, docs[key] == gone["gone"], "left_anti")


def report(docs: DataFrame) -> DataFrame:
    return grouped(docs).select(F.col("key").alias("doc_id"), "n_shingles", "component_id", "kept")
