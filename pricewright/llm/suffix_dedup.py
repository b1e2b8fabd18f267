"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

A byte of a document goes if some ``length``-byte string (50) that covers it
also starts in a document with a smaller key.  Texts are judged as they came in,
as UTF-8 bytes; no string crosses from one document to another.

1. Documents are packed into chunks of about a MB and written to the shared folder.
2. Every window of ``length`` bytes has an anchor: the smallest hash of the
   16-byte strings in it.  Equal windows have equal anchors, so a window whose
   anchor no second document has is no repeat.  Anchors are dealt out by ranges
   of their hash, and each range tells the chunks which of theirs occur again.
3. The runs of windows with one and the same such anchor are cut out as pieces
   and dealt out by anchor; pieces that could share a window meet.  A piece that
   comes again unchanged counts once, with its smallest key.
4. A piece that is alone with its anchor can share no window.  The others are
   split into shards, some anchors at a time.  Each shard gets its own
   sorted suffixes and Burrows-Wheeler transform, of the rows that can become the
   start of a window.  The transforms are merged by refining their interleave: a
   round takes every row back by one symbol (five bytes) with a stable counting
   sort, which orders the interleave by one symbol more, and rows that still have
   all symbols in common stay in one interval.  After ten rounds the intervals
   are those of suffixes with a common prefix of 50 bytes; no suffix is sorted
   again.  The smallest key of each interval decides about its windows.
5. What a bucket found goes back to the chunks, which cut the bytes out.

An anchor that more than about ``heavy`` documents have would make one bucket
large; its pieces are dealt out window by window, by the window's own hash, equal
windows of a chunk once with their places.

Texts of any length are read as a whole; a chunk holds one at least.  A null text
is empty.  A null key is larger than any other, and rows with equal
keys never remove from each other.  An empty table gives no rows.  Other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm.shared import byte_texts, session_of, written

LENGTH = 50
#: Bytes of the strings whose hashes are anchors; a power of two.
GRAM = 16
#: Bytes of a symbol of the transforms; ``length`` is a multiple of it.
SYMBOL = 5
#: A chunk is small enough for its packed text to be no large object to a JVM of small regions.
CHUNK_BYTES, RANGE_BYTES, BUCKET_BYTES = 1 << 20, 16 << 20, 8 << 20
#: Windows of a shard, and bytes of pieces whose shards are merged with each other, about.
SHARD_ROWS, MERGE_BYTES = 1 << 15, 1 << 18
#: Documents with the same anchor (counted to a factor of two) above which its pieces are dealt out by windows.
HEAVY = 20_000
NO_KEY = np.iinfo(np.int64).max


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


#: Columns of a block of pieces (document, start, key, which of the bodies that follow); of a block of marks, which has none.
PIECES, MARKS = ("<i4", "<i8", "<i8", "<i4"), ("<i4", "<i8", "<i8")


def squeezed(kinds: tuple[str, ...], columns: tuple[np.ndarray, ...], bodies: bytes = b"") -> bytes:
    """Small blocks without the headers of Arrow: number of rows, columns, bytes."""
    raw = b"".join([np.array([columns[0].size], "<i4").tobytes(), *(c.astype(k).tobytes() for c, k in zip(columns, kinds, strict=True)), bodies])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(kinds: tuple[str, ...], block: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True)
    n, at, columns = int.from_bytes(raw[:4], "little"), 4, []
    for kind in kinds:
        columns.append(np.frombuffer(raw, kind, n, at))
        at += columns[-1].nbytes
    return columns, raw[at:]


def chunked(docs: DataFrame, key: str, text: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, n_bytes, block): whole documents packed together."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys = batch.column(0).cast(pa.int64())
            texts = byte_texts(batch.column(1))
            ends = np.cumsum([len(t) for t in texts])
            of = (ends - 1) // chunk_bytes if len(texts) else ends
            for c in np.unique(of):
                at = np.flatnonzero(of == c)
                low, high = int(at[0]), int(at[-1]) + 1
                block = packed(pa.RecordBatch.from_arrays([keys.slice(low, high - low), pa.array(texts[low:high], pa.large_binary())], names=["key", "text"]))
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int64()), "n_bytes": pa.array([sum(map(len, texts[low:high]))], pa.int64()), "block": pa.array([block], pa.binary())})
                number += 1

    return docs.select(F.col(key).cast("long").alias("key"), text).mapInArrow(pack, "chunk long, n_bytes long, block binary")


# --- anchors ------------------------------------------------------------------


def anchors(text: np.ndarray, length: int) -> np.ndarray:
    """The anchor of the window at each place of a run of bytes."""
    if text.size < length:
        return np.zeros(0, np.uint64)
    h, n = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    while n < GRAM:
        high = h[n:]
        h = (h[:-n] * np.uint64(0xD6E8FEB86659FD93)) ^ (high + (high >> np.uint64(29)))
        n *= 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    width, n = length - GRAM + 1, 1
    while 2 * n <= width:
        h, n = np.minimum(h[:-n], h[n:]), 2 * n
    rest = width - n
    least = np.minimum(h[: h.size - rest], h[rest:]) if rest else h
    # Smallest hashes crowd near 0; a one-to-one mix spreads them over the ranges.
    least = (least ^ (least >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return least ^ (least >> np.uint64(27))


def runs(texts: list[bytes], length: int, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, start, windows, anchor) of the runs of windows with one anchor, some documents at a time."""
    k = 0
    while k < len(texts):
        begin, size = k, 0
        while k < len(texts) and (k == begin or size + len(texts[k]) <= at_once):
            size += len(texts[k])
            k += 1
        part = texts[begin:k]
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        starts = np.r_[0, np.cumsum(sizes)]
        found = anchors(np.frombuffer(b"".join(part), np.uint8), length)
        full = np.flatnonzero(sizes >= length)
        if not full.size:
            continue
        # The windows that lie within one document.
        windows = sizes[full] - length + 1
        first = np.r_[0, np.cumsum(windows)[:-1]]
        inside = np.repeat(starts[full] - first, windows) + np.arange(windows.sum())
        value = found[inside]
        new = np.r_[True, value[1:] != value[:-1]]
        new[first] = True
        at = np.flatnonzero(new)
        doc = np.searchsorted(first, at, "right") - 1
        yield full[doc] + begin, at - first[doc], np.diff(np.r_[at, value.size]), value[at]


def chunk_anchors(chunks: DataFrame, ranges: int, length: int) -> DataFrame:
    """(range, chunk, anchors, levels): sorted; level k says that 2**(k - 1) documents of the chunk or more have it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = []
                for doc, _, _, anchor in runs(byte_texts(unpacked(block)["text"]), length):
                    order = np.lexsort((doc, anchor))
                    d, a = doc[order], anchor[order]
                    parts.append(a[np.r_[True, (d[1:] != d[:-1]) | (a[1:] != a[:-1])]])
                if not parts:
                    continue
                a, n = np.unique(np.concatenate(parts), return_counts=True)
                level = (np.log2(n).astype(np.uint8) + 1).astype(np.uint8)
                of = ((a >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                cuts = np.searchsorted(of, np.arange(ranges + 1, dtype=np.uint64))
                own = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int32()), pa.array(np.full(own.size, chunk), pa.int64()), *(pa.array([x[cuts[r] : cuts[r + 1]].tobytes() for r in own], pa.binary()) for x in (a, level))],
                    names=["range", "chunk", "anchors", "levels"],
                )

    return chunks.select("chunk", "block").mapInArrow(find, "range int, chunk long, anchors binary, levels binary")


def repeated_anchors(found: DataFrame, heavy: int) -> DataFrame:
    """(chunk, again, heavy): for each chunk its anchors that occur in a second document."""

    def compare(table: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(x, np.uint64) for x in table["anchors"].to_pylist()]
        value, of = np.unique(np.concatenate(blocks), return_inverse=True)
        levels = np.frombuffer(b"".join(table["levels"].to_pylist()), np.uint8)
        count = np.bincount(of, np.exp2(levels - 1.0), value.size)
        cuts = np.cumsum([b.size for b in blocks])[:-1]
        rows = []
        for chunk, own in zip(table["chunk"].to_pylist(), np.split(of, cuts), strict=True):
            often = count[own] > heavy
            rows.append((chunk, value[own[(count[own] > 1) & ~often]].tobytes(), value[own[often]].tobytes()))
        columns = list(zip(*rows, strict=True))
        return pa.table({"chunk": pa.array(columns[0], pa.int64()), "again": pa.array(columns[1], pa.binary()), "heavy": pa.array(columns[2], pa.binary())})

    return found.groupBy("range").applyInArrow(compare, "chunk long, again binary, heavy binary")


# --- pieces -------------------------------------------------------------------


def pieces(chunks: DataFrame, again: DataFrame, buckets: int, length: int) -> DataFrame:
    """(bucket, chunk, block): pieces with document, start, key and bytes."""

    def gathered(column: pa.ChunkedArray) -> np.ndarray:
        return np.unique(np.frombuffer(b"".join(column.to_pylist()), np.uint64))

    def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        if not of.size:
            return np.zeros(values.size, bool)
        at = np.minimum(np.searchsorted(of, values), of.size - 1)
        return of[at] == values

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted, heavy = gathered(right["again"]), gathered(right["heavy"])
        out: list[tuple[int, int, bytes]] = []
        for chunk, block in zip(left["chunk"].to_pylist(), left["block"].to_pylist(), strict=True):
            docs = unpacked(block)
            texts, keys = byte_texts(docs["text"]), docs["key"].fill_null(NO_KEY).to_numpy()
            found = [[], [], [], []]
            for doc, start, windows, anchor in runs(texts, length):
                once, split = member(anchor, wanted), member(anchor, heavy)
                d, s = np.repeat(doc[split], windows[split]), np.repeat(start[split], windows[split])
                s = s + np.arange(s.size) - np.repeat(np.cumsum(windows[split]) - windows[split], windows[split])
                own = np.fromiter((hash_of(texts[i][j : j + length]) for i, j in zip(d.tolist(), s.tolist(), strict=True)), np.uint64, d.size)
                for to, a, b in zip(found, (doc, start, windows, anchor), (d, s, np.ones(d.size, np.int64), own), strict=True):
                    to += [a[once], b]
            if not found[0]:
                continue
            doc, start, windows, anchor = (np.concatenate(x) for x in found)
            bucket = ((anchor * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            doc, start, end, bucket = doc[order], start[order], (start + windows + length - 1)[order], bucket[order]
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if bucket.size else np.zeros(1, int)
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                d, s = doc[low:high], start[low:high]
                body = [texts[i][a:b] for i, a, b in zip(d.tolist(), s.tolist(), end[low:high].tolist(), strict=True)]
                # Equal pieces of a chunk go along once.
                own: dict[bytes, int] = {}
                which = np.fromiter((own.setdefault(x, len(own)) for x in body), np.int64, len(body))
                sizes = np.fromiter(map(len, own), "<i4", len(own))
                out.append((int(bucket[low]), chunk, squeezed(PIECES, (d, s, keys[d], which), b"".join([len(own).to_bytes(4, "little"), sizes.tobytes(), *own]))))
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.table({"bucket": pa.array(columns[0], pa.int32()), "chunk": pa.array(columns[1], pa.int64()), "block": pa.array(columns[2], pa.binary())})

    left, right = chunks.select("chunk", "block").groupBy("chunk"), again.groupBy("chunk")
    return left.cogroup(right).applyInArrow(cut, "bucket int, chunk long, block binary")


def hash_of(piece: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(piece)


# --- transforms ---------------------------------------------------------------


def stable_order(symbols: np.ndarray) -> np.ndarray:
    """Stable counting sort, by 16 bits at a time."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    if symbols.size and int(symbols.max()) >> 16:
        order = order[np.argsort((symbols >> 16).astype(np.uint16)[order], kind="stable")]
    return order


class Windows:
    """The windows of pieces, and the symbols that come before them on their way back.

    A symbol is SYMBOL bytes.  Round r looks at the rows that lie r symbols before
    their window's end, so it needs just one row a window, whose symbol before is
    always there: ``before(r, rows)``.  After length / SYMBOL rounds the rows are
    the windows' own starts.
    """

    def __init__(self, bodies: list[bytes], length: int):
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        windows = np.maximum(sizes - length + 1, 0)
        self.piece = np.repeat(np.arange(len(bodies)), windows)
        self.rounds = length // SYMBOL
        starts = np.cumsum(sizes) - sizes
        self.start = np.repeat(starts - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))
        data = np.frombuffer(b"".join(bodies), np.uint8)
        code = np.zeros(max(0, data.size - SYMBOL + 1), np.int64)
        for k in range(SYMBOL):
            code = (code << 8) | data[k : k + code.size]
        self.symbol = np.unique(code, return_inverse=True)[1].astype(np.int32)

    def before(self, done: int, rows: np.ndarray) -> np.ndarray:
        return self.symbol[self.start[rows] + (self.rounds - 1 - done) * SYMBOL]


def transform(windows: Windows, low: int, high: int) -> tuple[list[np.ndarray], np.ndarray]:
    """A shard's transform: of its rows in sorted order the symbols before them, in every round; and its windows sorted."""
    rows, symbols = np.arange(low, high), []
    for done in range(windows.rounds):
        symbols.append(windows.before(done, rows))
        rows = rows[stable_order(symbols[-1])]
    return symbols, rows


def merged(shards: list[tuple[list[np.ndarray], np.ndarray]], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all shards in merged order, and the interval of each.

    ``interleave`` tells for every place of the merged order from which shard it
    comes; a shard's own rows keep their order.  A round takes the shards'
    symbols in the order of the interleave and sorts the interleave by them,
    stably, which orders it by one symbol more.  Rows in one interval agree in
    all the symbols that were taken: that is their common prefix.
    """
    sizes = [rows.size for _, rows in shards]
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    interval = np.zeros(interleave.size, np.int32)
    begins = np.cumsum(sizes) - sizes

    def places() -> np.ndarray:
        at = np.empty(interleave.size, np.int32)
        for k, (begin, n) in enumerate(zip(begins.tolist(), sizes, strict=True)):
            at[np.flatnonzero(interleave == k)] = np.arange(begin, begin + n, dtype=np.int32)
        return at

    for done in range(rounds):
        symbol = np.concatenate([symbols[done] for symbols, _ in shards])[places()]
        order = stable_order(symbol)
        symbol, interval, interleave = symbol[order], interval[order], interleave[order]
        new = np.zeros(order.size, bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        interval = np.cumsum(new, dtype=np.int32)
    return np.concatenate([rows for _, rows in shards])[places()], interval


def smallest_keys(bodies: list[bytes], keys: np.ndarray, length: int, shard_rows: int = SHARD_ROWS) -> np.ndarray:
    """For each window of the pieces in a row the smallest key of a piece with that window."""
    windows = Windows(bodies, length)
    n = windows.piece.size
    if not n:
        return np.zeros(0, np.int64)
    cuts = [*range(0, n, shard_rows), n]
    rows, interval = merged([transform(windows, a, b) for a, b in zip(cuts, cuts[1:], strict=False)], windows.rounds)
    first = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
    least = np.minimum.reduceat(keys[windows.piece[rows]], first)
    found = np.empty(n, np.int64)
    found[rows] = np.repeat(least, np.diff(np.r_[first, n]))
    return found


def least_by_window(bodies: list[bytes], keys: np.ndarray, length: int, shard_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of each distinct piece, and in a row the smallest key of each window.

    Only pieces with one and the same anchor can have a window in common, so a
    piece that is alone with its anchor needs no merge, and the others are merged
    some anchors at a time.
    """
    windows = np.fromiter(map(len, bodies), np.int64, len(bodies)) - length + 1
    every = np.repeat(keys, windows)
    anchor = np.zeros(len(bodies), np.uint64)
    for doc, start, _, value in runs(bodies, length):
        anchor[doc[start == 0]] = value[start == 0]
    of, count = np.unique(anchor, return_inverse=True, return_counts=True)[1:]
    shared = np.flatnonzero(count[of] > 1)
    shared = shared[np.argsort(of[shared], kind="stable")]
    last = np.r_[of[shared][1:] != of[shared][:-1], True] if shared.size else np.zeros(0, bool)
    begin = np.r_[0, np.cumsum(windows)]
    low = size = 0
    for k, i in enumerate(shared.tolist()):
        size += len(bodies[i])
        if last[k] and (size >= MERGE_BYTES or k + 1 == shared.size):
            part = shared[low : k + 1]
            found = smallest_keys([bodies[j] for j in part.tolist()], keys[part], length, shard_rows)
            n = windows[part]
            every[np.repeat(begin[part] - np.cumsum(n) + n, n) + np.arange(n.sum())] = found
            low, size = k + 1, 0
    return windows, every


def repeats(parts: DataFrame, length: int, shard_rows: int) -> DataFrame:
    """(chunk, block): per document the runs of windows that start in a smaller key."""

    def settle(table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        least: list[int] = []
        blocks = []
        for chunk, block in zip(table["chunk"].to_pylist(), table["block"].to_pylist(), strict=True):
            (doc, start, keys, which), rest = unsqueezed(PIECES, block)
            n = int.from_bytes(rest[:4], "little")
            sizes = np.frombuffer(rest, "<i4", n, 4).astype(np.int64)
            ends = 4 + 4 * n + np.cumsum(sizes)
            of = np.fromiter((known.setdefault(rest[a:b], len(known)) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)), np.int64, n)[which]
            least += [NO_KEY] * (len(known) - len(least))
            for i, k in zip(of.tolist(), keys.tolist(), strict=True):
                if k < least[i]:
                    least[i] = k
            blocks.append((chunk, doc, start, keys, of))
        windows, every = least_by_window(list(known), np.array(least, np.int64), length, shard_rows)
        begin = np.r_[0, np.cumsum(windows)]
        out = []
        for chunk, doc, start, keys, of in blocks:
            n = windows[of]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            gone = every[np.repeat(begin[of], n) + offset] < np.repeat(keys, n)
            # Runs of windows that go, within each piece.
            head = gone & (np.r_[True, ~gone[:-1]] | (offset == 0)) if gone.size else gone
            at = np.flatnonzero(head)
            if not at.size:
                continue
            stop = np.flatnonzero(gone & np.r_[~gone[1:] | (offset[1:] == 0), True])
            piece = np.repeat(np.arange(n.size), n)[at]
            out.append((chunk, squeezed(MARKS, (doc[piece], start[piece] + offset[at], stop - at + 1))))
        columns = list(zip(*out, strict=True)) or [()] * 2
        return pa.table({"chunk": pa.array(columns[0], pa.int64()), "block": pa.array(columns[1], pa.binary())})

    return parts.groupBy("bucket").applyInArrow(settle, "chunk long, block binary")


# --- results ------------------------------------------------------------------

SPANS = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>, kept binary"


def cut_out(chunks: DataFrame, found: DataFrame, length: int, with_texts: bool) -> DataFrame:
    """A row per document; spans and remaining bytes where ``with_texts`` asks for them."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        marks = [unsqueezed(MARKS, x)[0] for x in right["block"].to_pylist()]
        doc, start, windows = (np.concatenate([m[k] for m in marks]) if marks else np.zeros(0, np.int64) for k in range(3))
        rows = []
        for block in left["block"].to_pylist():
            docs = unpacked(block)
            texts, keys = byte_texts(docs["text"]), docs["key"].to_pylist()
            # A byte between two documents keeps their spans apart.
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            begin = np.r_[0, np.cumsum(sizes + 1)]
            change = np.zeros(int(begin[-1]) + 1, np.int32)
            np.add.at(change, begin[doc] + start, 1)
            np.add.at(change, begin[doc] + start + windows + length - 1, -1)
            gone = np.cumsum(change) > 0
            edge = np.diff(np.r_[False, gone].astype(np.int8))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            of = np.searchsorted(starts, begin)
            for k, (key, text) in enumerate(zip(keys, texts, strict=True)):
                a, b = starts[of[k] : of[k + 1]] - begin[k], ends[of[k] : of[k + 1]] - begin[k]
                kept = text
                if a.size:
                    kept = b"".join(text[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True))
                spans = (a.tolist(), b.tolist(), kept) if with_texts else (None, None, None)
                rows.append((key, len(text), len(text) - len(kept), int(a.size), hashlib.sha256(kept).hexdigest(), *spans))
        columns = list(zip(*rows, strict=True)) or [()] * 8
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = [x.split()[0] for x in SPANS.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    left, right = chunks.select("chunk", "block").groupBy("chunk"), found.groupBy("chunk")
    return left.cogroup(right).applyInArrow(cut, SPANS)


def deduped(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, heavy: int = HEAVY, with_texts: bool = True,
    chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES, bucket_bytes: int = BUCKET_BYTES, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, starts, ends, kept) for every row."""
    if length % SYMBOL or length < GRAM:
        raise ValueError(f"length must be a multiple of {SYMBOL} and {GRAM} or more")
    session_of(docs)
    chunks = written(chunked(docs, key, text, chunk_bytes), "dedup-chunks")
    total = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    again = repeated_anchors(chunk_anchors(chunks, 1 + total // range_bytes, length), heavy)
    parts = pieces(chunks, again, 1 + total // bucket_bytes, length)
    return cut_out(chunks, repeats(parts, length, shard_rows), length, with_texts)


def report(docs: DataFrame) -> DataFrame:
    rows = deduped(docs, with_texts=False)
    return rows.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
