"""Token ids in compressed binary files, coded by a static range ANS.

Steps: tokenise every text once and write the ids to the shared folder; count
all ids for one frequency table; deal the documents out by ranges of their key
and write, per range, files of independent blocks; read them back block by
block.

File format (little-endian).  A block is::

    magic "RNS1" | u32 table checksum | u32 documents | u32 ids | u32 lanes
    | u32 words | u32 checksum of what follows
    | i64 keys[documents] | u8 key is null[documents] | u32 lengths[documents]
    | u64 states[lanes] | u32 words[words]

The ids of a block are dealt to ``lanes`` interleaved coders (id k to lane
k mod lanes), which share the frequency table and one sequence of 32-bit words.
Blocks hold whole documents and know nothing of each other; a file ends with its
checkpoints, one a block::

    (u64 offset, u64 bytes, u64 ids before it in this file, u32 documents)* | u64 ids of the file | u32 blocks | "RNSX"

so any block can be found, checked and decoded alone.  Readers take nothing from
the writers but the files' names and order.  The frequency table (one
count a vocabulary entry, 2**20 in sum) is written beside the files.

Rows with a null or empty text hold the end id alone.  Rows with a null key come
first.  Repeated keys stay separate rows, the shorter first.  A text of any
length is one document of one block.  An empty table gives no files and no rows.
Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.llm.shared import by_bytes, gathered, remove, session_of, shared_folder, written

SCALE = 20
LOW = np.uint64(1 << 31)
MAGIC, END = b"RNS1", b"RNSX"
HEAD, POINT, LAST = "<4s6I", "<QQQI", "<QI4s"
#: Ids after which a block is closed (at a document's end), and bytes after which a file is.
BLOCK_IDS, FILE_BYTES = 1 << 18, 32 << 20
LANES, IDS_A_LANE = 1024, 64
#: Parts of words that a worker remembers before it makes room, and their bytes with those of their ids.
REMEMBERED, REMEMBERED_BYTES = 800_000, 64 << 20
#: Bytes of text encoded in one go, and those given to the library in one go, whose tokens take some hundred bytes each.
BYTES_AT_ONCE, LIBRARY_BYTES = 4 << 20, 2 << 20


# --- tokenising -------------------------------------------------------------


#: A word whose letters and whose marks after them are separate pre-tokens in
#: any case: the letters are of Latin-1, which composes and lower-cases plainly.
LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}"
PLAIN = rf"^(?P<letters>[{LETTERS}]+)(?P<marks>[-.,!?;:%&#*$]*)$"
#: The normaliser and the splitter for which a text's ids are those of its words.
NORMALIZER = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
SPLITTER = [("Split", "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"), ("ByteLevel", None)]


def steps(part: dict | None) -> list[tuple[str, str | None]]:
    """Kinds and patterns of a sequence of normalisers or splitters."""
    every = (part or {}).get("normalizers") or (part or {}).get("pretokenizers") or ([part] if part else [])
    return [(x["type"], x["pattern"].get("Regex") if "pattern" in x else None) for x in every]


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: the byte's own, if it can be printed."""
    own = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}


def ragged(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin[k] .. begin[k] + sizes[k] of all k in a row."""
    n = int(sizes.sum(dtype=np.int64))
    kind = np.int32 if n + int(begin.max(initial=0)) < 1 << 31 else np.int64
    sizes = sizes.astype(kind, copy=False)
    first = np.cumsum(sizes, dtype=kind)
    np.subtract(sizes, first, out=first)
    first += begin.astype(kind, copy=False)
    found = np.repeat(first, sizes)
    found += np.arange(n, dtype=kind)
    return found


class WordEncoder:
    """Whole texts as the library encodes them, by way of their distinct words.

    Where the normaliser and the splitter are those named above, no token crosses
    a space or a line end, so a text's ids are the ids of its words, and those of
    a plain word are the ids of its letters and of its marks.  Each distinct part
    goes through the library and is remembered; when there are too many, those
    that came in one call only are forgotten.  With any other tokenizer whole
    texts go through the library.
    """

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task is one thread
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        made = json.loads(self.library.to_str())
        added = [x["content"] for x in made["added_tokens"]]
        self.by_words = (
            steps(made["normalizer"]) == NORMALIZER
            and steps(made["pre_tokenizer"]) == SPLITTER
            and not made["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"]
            and made["model"]["type"] == "BPE"
            and not made["model"]["dropout"]
            and not any(re.search(r"\s", x) or x.isalpha() for x in added)
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in made["added_tokens"])
        )
        self.letters = byte_letters()
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([""], pa.large_string())
        self.begin, self.sizes, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, self.width)
        #: Which of the known parts were looked up again; the first, the empty one, always stays.
        self.again = np.ones(1, bool)

    def full(self, share: int = 1) -> bool:
        """Whether more than one ``share``-th of the room is taken."""
        return len(self.known) > REMEMBERED // share or self.known.nbytes + self.flat.nbytes > REMEMBERED_BYTES // share

    def make_room(self) -> None:
        """Forget the parts that were not looked up again; all, if the others take more than half of the room."""
        kept = np.flatnonzero(self.again)
        self.known = self.known.take(pa.array(kept))
        begin, self.sizes = self.begin[kept], self.sizes[kept]
        self.flat = self.flat[ragged(begin, self.sizes)]
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.again = np.arange(kept.size) == 0
        if self.full(2):
            self.forget()

    @property
    def vocabulary(self) -> int:
        return self.library.get_vocab_size(with_added_tokens=True)

    @property
    def width(self) -> str:
        """The kind of number that ids take on their way to the files."""
        return "<u2" if self.vocabulary <= 1 << 16 else "<u4"

    def from_library(self, texts: pa.Array, plain: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of some texts in a row, and how many each has.

        The letters of a plain word are one pre-token already, so the vocabulary's
        merges are all that is left to do.  All ids go to one list: a list a text
        would keep the garbage collector busy.
        """
        merges, letters = self.library.model.tokenize, self.letters
        for part in by_bytes(pa.RecordBatch.from_arrays([texts], names=["text"]), 0, LIBRARY_BYTES):
            ids: list[int] = []
            sizes: list[int] = []
            if plain:
                for x in part.column(0).to_pylist():
                    tokens = merges(x if x.isascii() else x.encode().decode("latin-1").translate(letters))
                    ids += [t.id for t in tokens]
                    sizes.append(len(tokens))
            else:
                for e in self.library.encode_batch_fast(part.column(0).to_pylist(), add_special_tokens=False):
                    ids += e.ids
                    sizes.append(len(e))
            yield np.array(ids, self.width), np.array(sizes, np.int64)

    def places(self, letters: pa.Array, others: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each of some distinct parts is among the known ones; new ones go through the library.

        ``letters`` are those of plain words, in lower case; none is among the
        others.  Looking up builds a table of all known parts, so it is done once.
        """
        parts = pa.concat_arrays([letters, others])
        found = pc.index_in(parts, value_set=self.known)
        unknown = found.is_null()
        new, found = parts.filter(unknown), found.fill_null(0).to_numpy().astype(np.int64)
        self.again[found] = True
        if len(new):
            unknown = unknown.to_numpy(zero_copy_only=False)
            found[unknown] = len(self.known) + np.arange(len(new))
            plain = int(unknown[: len(letters)].sum())
            made = [*self.from_library(new[:plain], True), *self.from_library(new[plain:], False)]
            sizes = np.concatenate([x for _, x in made])
            self.begin = np.r_[self.begin, self.flat.size + np.cumsum(sizes) - sizes]
            self.sizes = np.r_[self.sizes, sizes]
            self.flat = np.concatenate([self.flat, *(x for x, _ in made)])
            self.again = np.r_[self.again, np.zeros(len(new), bool)]
            self.known = pa.concat_arrays([self.known, new])
        return found[: len(letters)], found[len(letters) :]

    def encode(self, texts: pa.Array, end_id: int) -> pa.Array:
        """Ids of each text as numbers of ``width``, the end id after them; a null text is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_words:
            end = np.array([end_id], self.width).tobytes()
            made = [x for ids, sizes in self.from_library(texts, False) for x in np.split(ids, np.cumsum(sizes)[:-1])]
            return pa.array([x.tobytes() + end for x in made], pa.large_binary())
        if self.full():
            self.make_room()
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = cut.flatten().dictionary_encode()
        split = pc.extract_regex(words.dictionary, PLAIN)
        letters, marks = (split.field(k).dictionary_encode() for k in (0, 1))
        plain = split.is_valid().to_numpy(zero_copy_only=False)
        # Each distinct word is two parts: letters and marks, or the whole word and nothing.
        lower = pc.utf8_lower(letters.dictionary).dictionary_encode()
        others = pa.concat_arrays([marks.dictionary, words.dictionary.filter(pa.array(~plain))]).dictionary_encode()
        own, rest = self.places(lower.dictionary, others.dictionary)
        rest = rest[others.indices.to_numpy()]
        first, second = np.zeros(plain.size, np.int64), np.zeros(plain.size, np.int64)
        if plain.any():
            at = np.flatnonzero(plain)
            first[at] = own[lower.indices.to_numpy()[letters.indices.fill_null(0).to_numpy()[at]]]
            second[at] = rest[marks.indices.fill_null(0).to_numpy()[at]]
        first[~plain] = rest[len(marks.dictionary) :]
        # The ids of the distinct words in a row, the end id last; then those of all words.
        both = np.stack([first, second], 1).ravel()
        sizes = self.sizes[both]
        flat = np.r_[self.flat[ragged(self.begin[both], sizes)], np.array([end_id], self.width)]
        sizes = np.r_[sizes.reshape(-1, 2).sum(1), 1]
        begin = np.cumsum(sizes) - sizes
        if flat.size < 1 << 31:  # half the memory where texts have very many words
            sizes, begin = sizes.astype(np.int32), begin.astype(np.int32)
        count = pc.list_value_length(cut).to_numpy()
        every = np.insert(words.indices.to_numpy(), np.cumsum(count), plain.size)
        n = sizes[every]
        ids = flat[ragged(begin[every], n)]
        ends = np.cumsum(n)[np.cumsum(count + 1) - 1] * int(self.width[2])
        offsets = np.r_[0, ends].astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


@functools.lru_cache(maxsize=1)
def word_encoder(tokenizer_file: str) -> WordEncoder:
    """One encoder a Python worker, which goes on remembering from task to task."""
    return WordEncoder(tokenizer_file)


def encoded(docs: DataFrame, tokenizer_file: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids as numbers of the encoder's width) for every row."""
    session_of(docs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_file)
        for batch in gathered(batches, 1, BYTES_AT_ONCE):
            for part in by_bytes(batch, 1, BYTES_AT_ONCE):
                ids = encoder.encode(part.column(1), end_id)
                yield pa.RecordBatch.from_arrays([part.column(0), ids.cast(pa.binary())], names=["key", "ids"])

    return docs.select(F.col(key).cast("long").alias("key"), text).mapInArrow(encode, "key long, ids binary")


# --- the coder ----------------------------------------------------------------


def frequency_table(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE; every id that occurs has one at least."""
    total, room = int(counts.sum()), 1 << SCALE
    seen = counts > 0
    if 2 * int(seen.sum()) > room:
        raise ValueError("the vocabulary is too large for this scale")
    if not total:
        return np.zeros(counts.size, np.uint32)
    scaled = np.where(seen, np.maximum(1, counts.astype(np.float64) * (room - int(seen.sum())) / total), 0).astype(np.int64)
    scaled[int(np.argmax(scaled))] += room - int(scaled.sum())
    return scaled.astype(np.uint32)


class Coder:
    """Encodes and decodes blocks with one table."""

    def __init__(self, table: np.ndarray):
        self.check = zlib.crc32(table.astype("<u4").tobytes())
        self.frequency = table.astype(np.uint64)
        self.start = np.r_[np.uint64(0), np.cumsum(self.frequency)[:-1]].astype(np.uint64)
        #: The id that holds each slot of the scale.
        self.holder = np.repeat(np.arange(table.size, dtype=np.uint32), table)

    def encode(self, ids: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """Final states and words; ids are coded last to first."""
        state = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        n, shift, most = ids.size, np.uint64(SCALE), np.uint64(63 - SCALE)
        frequency, start = self.frequency[ids], self.start[ids]
        for begin in range((n - 1) // lanes * lanes, -1, -lanes):
            f, s = frequency[begin : begin + lanes], start[begin : begin + lanes]
            x = state[: f.size]
            full = x >= (f << most)
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            x = np.where(full, x >> np.uint64(32), x)
            quotient = x // f
            state[: f.size] = (quotient << shift) + (x - quotient * f) + s
        return state, np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")

    def decode(self, n: int, state: np.ndarray, words: np.ndarray) -> np.ndarray:
        out, at, lanes = np.zeros(n, "<u4"), 0, state.size
        state, mask = state.copy(), np.uint64((1 << SCALE) - 1)
        for begin in range(0, n, lanes):
            x = state[: min(lanes, n - begin)]
            slot = x & mask
            found = self.holder[slot]
            x = self.frequency[found] * (x >> np.uint64(SCALE)) + slot - self.start[found]
            empty = x < LOW
            k = int(empty.sum())
            x[empty] = (x[empty] << np.uint64(32)) | words[at : at + k]
            at += k
            state[: x.size] = x
            out[begin : begin + x.size] = found
        if at != words.size or (state != LOW).any():
            raise ValueError("a block's words do not match its ids")
        return out

    def block(self, keys: list[int | None], ids: list[bytes], width: str) -> bytes:
        """A block of whole documents."""
        every = np.frombuffer(b"".join(ids), width)
        lanes = max(1, min(LANES, every.size // IDS_A_LANE))
        state, words = self.encode(every, lanes)
        body = b"".join([
            np.array([k or 0 for k in keys], "<i8").tobytes(),
            np.array([k is None for k in keys], "u1").tobytes(),
            np.array([len(x) // int(width[2]) for x in ids], "<u4").tobytes(),
            state.astype("<u8").tobytes(),
            words.tobytes(),
        ])
        return struct.pack(HEAD, MAGIC, self.check, len(keys), every.size, lanes, words.size, zlib.crc32(body)) + body

    def documents(self, block: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
        """(key, ids) of each document of a block, after checking its checksums."""
        magic, check, n_docs, n_ids, lanes, n_words, sum_ = struct.unpack_from(HEAD, block)
        body = memoryview(block)[struct.calcsize(HEAD) :]
        if magic != MAGIC or check != self.check or zlib.crc32(body) != sum_:
            raise ValueError("a block is damaged or of another table")
        parts, at = [], 0
        for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u8", lanes), ("<u4", n_words)):
            parts.append(np.frombuffer(body, kind, n, at))
            at += parts[-1].nbytes
        keys, null, lengths, state, words = parts
        ids, begin = self.decode(n_ids, state.astype(np.uint64), words), 0
        for key, none, n in zip(keys.tolist(), null.tolist(), lengths.tolist(), strict=True):
            yield None if none else key, ids[begin : begin + n]
            begin += n


# --- files --------------------------------------------------------------------


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and path of an address in the shared folder."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


FILES = "range int, file_no int, file string"


def write_files(spark: SparkSession, ids: DataFrame, counts: np.ndarray, width: str, folder: str) -> DataFrame:
    """Write (key, ids) rows in ascending key order; returns the files' names and order.

    Each range of keys is sorted and written by one task.  A task that runs
    again writes files of other names; only those of the task that ended are
    returned.
    """
    store, at = filesystem(folder)
    store.create_dir(at, recursive=True)
    table = frequency_table(counts)
    with store.open_output_stream(f"{at}/table.u4") as out:
        out.write(table.astype("<u4").tobytes())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, at = filesystem(folder)
        coder = load_coder(folder)
        keys: list[int | None] = []
        held: list[bytes] = []
        points: list[tuple] = []
        rows: list[tuple] = []
        size = ids_before = 0
        out = None

        def close_block() -> None:
            nonlocal size, ids_before, out
            if not keys:
                return
            if out is None:
                rows.append((part, len(rows), f"range-{part:06d}-{own}-{len(rows):04d}.rns"))
                out = store.open_output_stream(f"{at}/{rows[-1][2]}")
            block = coder.block(keys, held, width)
            points.append((size, len(block), ids_before, len(keys)))
            out.write(block)
            size, ids_before = size + len(block), ids_before + sum(map(len, held)) // int(width[2])
            keys.clear()
            held.clear()

        def close_file() -> None:
            nonlocal size, ids_before, out
            if out is None:
                return
            out.write(b"".join(struct.pack(POINT, *p) for p in points) + struct.pack(LAST, ids_before, len(points), END))
            out.close()
            points.clear()
            size, ids_before, out = 0, 0, None

        waiting = 0
        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                held.append(x)
                waiting += len(x) // int(width[2])
                if waiting >= BLOCK_IDS:
                    close_block()
                    waiting = 0
                    if size >= FILE_BYTES:
                        close_file()
        close_block()
        close_file()
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.string()), strict=True)], names=[x.split()[0] for x in FILES.split(", ")])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ids.repartitionByRange(parts, F.col("key").asc_nulls_first())
    dealt = dealt.sortWithinPartitions(F.col("key").asc_nulls_first(), F.length("ids"), "ids")
    return written(dealt.mapInArrow(write, FILES), "token-file-names")


@functools.lru_cache(maxsize=2)
def load_coder(folder: str) -> Coder:
    store, at = filesystem(folder)
    with store.open_input_stream(f"{at}/table.u4") as f:
        return Coder(np.frombuffer(f.read(), "<u4"))


def file_points(f: pa.NativeFile, size: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """The checkpoints at the end of a file, checked against its size, and the file's number of ids."""
    end = struct.calcsize(LAST)
    f.seek(max(0, size - end))
    ids, blocks, magic = struct.unpack(LAST, f.read(end)) if size >= end else (0, 0, b"")
    begin = size - end - blocks * struct.calcsize(POINT)
    if magic != END or begin < 0:
        raise ValueError("a file has no checkpoints")
    f.seek(begin)
    points = list(struct.iter_unpack(POINT, f.read(size - end - begin)))
    offset = before = 0
    for at, n, ids_before, _ in points:
        if at != offset or ids_before < before:
            raise ValueError("a file's checkpoints do not follow each other")
        offset, before = at + n, ids_before
    if offset != begin or before > ids:
        raise ValueError("a file's checkpoints do not match its size")
    return points, ids


POINTS = "range int, file_no int, file string, offset long, bytes long, first_id long, n_docs int, n_ids long, file_ids long"


def checkpoints(files: DataFrame, folder: str) -> DataFrame:
    """A row per block, from the ends of the files themselves."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = filesystem(folder)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                with store.open_input_file(f"{at}/{row['file']}") as f:
                    points, ids = file_points(f, f.size())
                nexts = [p[2] for p in points[1:]] + [ids]
                rows += [(row["range"], row["file_no"], row["file"], *p, n - p[2], ids) for p, n in zip(points, nexts, strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in POINTS.split(", ")])

    return written(files.mapInArrow(look, POINTS), "token-checkpoints")


def read_files(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Decode the blocks in parallel: a row per document, in the files' terms.

    ``start`` counts the ids of all documents before it: those of the ranges and
    files before, summed over one row a range and one row a file of a range, and
    those that the file's checkpoints name.  Documents are never gathered.
    """
    points = checkpoints(files, folder)
    sizes = points.groupBy("range", "file_no").agg(F.first("file_ids").alias("n"))
    run = Window.partitionBy("range").orderBy("file_no")
    in_range = sizes.select("range", "file_no", (F.sum("n").over(run) - F.col("n")).alias("file_start"))
    totals = sizes.groupBy("range").agg(F.sum("n").alias("n"))
    before = totals.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("range_start"))
    work = points.join(in_range, ["range", "file_no"]).join(before, "range")
    work = work.select("file", "offset", "bytes", "n_docs", "n_ids", (F.col("first_id") + F.col("file_start") + F.col("range_start")).alias("first"))
    work = work.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = filesystem(folder)
        coder = load_coder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{at}/{row['file']}") as f:
                    f.seek(row["offset"])
                    block = f.read(row["bytes"])
                if struct.unpack_from(HEAD, block)[2:4] != (row["n_docs"], row["n_ids"]):
                    raise ValueError("a block does not match its checkpoint")
                keys, starts, sizes, sums, first = [], [], [], [], row["first"]
                for key, ids in coder.documents(block):
                    keys.append(key)
                    starts.append(first)
                    sizes.append(ids.size)
                    sums.append(zlib.crc32(ids.tobytes()))
                    first += ids.size
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, starts, sizes, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return work.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def count_ids(ids: DataFrame, vocabulary: int, width: str) -> np.ndarray:
    """How often each id occurs over all documents; a row per id comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            values = b"".join(batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(values, width), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    found = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocabulary, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def write_and_read(docs: DataFrame, tokenizer_file: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all documents into files in the shared folder and read them back."""
    spark = session_of(docs)
    folder = shared_folder(spark, "token-files")
    ids = written(encoded(docs, tokenizer_file, end_id, key, text), "token-ids")
    encoder = WordEncoder(tokenizer_file)
    counts = count_ids(ids, encoder.vocabulary, encoder.width)
    files = write_files(spark, ids, counts, encoder.width, folder)
    remove(spark, ids)
    return read_files(spark, files, folder)
