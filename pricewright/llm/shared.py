"""What the operators share: the cluster's shared folder, and Arrow helpers."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python.  Texts can be long, so batches are short.
ARROW_ROWS = 1000

#: White space of a word's surroundings: a space and U+0009 to U+000D, exactly
#: what ``bytes.split()`` splits at.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def session_of(df: DataFrame) -> SparkSession:
    """The session of a frame, with Arrow batches short enough for long texts."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's address below ``spark.checkpoint.dir``, which all machines share.

    Only where the setting is absent and all runs in one process (tests) a
    temporary folder takes its place; a cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="pricewright-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders that the open ``scratch`` blocks of this thread or task delete at their end.
#: Each has a stack of its own, so queries that run side by side in one session do not meet.
_SCRATCH: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scratch", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is ``written`` inside is deleted at the end; what is to be kept, at the end of the next outer block."""
    own: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), own))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for at in own:
            remove_folder(spark, at)


#: A word of more bytes is not remembered by the tasks: texts without spaces make words of whole sentences.
LONG_WORD = 100

#: Rows of a part file where a frame's number of rows is known to be small.
FILE_ROWS = 10_000


def written(df: DataFrame, name: str, keep: bool = False, rows: int | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it again.

    This cuts the lineage with copies that survive a lost executor.  ``rows`` is
    a bound for the number of its rows, which are short: then there are no more
    tasks and files than that takes.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    at = shared_folder(spark, name)
    blocks = _SCRATCH.get()
    if len(blocks) > keep:
        blocks[-1 - keep].append(at)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def remove_folder(spark: SparkSession, at: str) -> None:
    """Delete a folder of the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what ``written`` wrote for frames that no later step reads."""
    for df in frames:
        files = df.inputFiles()
        if files:
            remove_folder(spark, files[0].rpartition("/")[0])


#: A key that holds more than one in so many rows is hot.
HOT_SHARE = 1000


def joined_by_key(rows: DataFrame, facts: DataFrame, key: str, n_rows: int, how: str = "left") -> DataFrame:
    """Join ``rows`` with ``facts``, a row per key with its number ``n`` of rows, without gathering a hot key's rows.

    Fewer than ``HOT_SHARE`` keys can have more than that share of ``n_rows``
    each, so those facts are small whatever the table, and are broadcast; the
    rows of all others are shuffled.  Both frames have no columns in common but
    the key, which is not null in ``facts``.  ``facts`` are read twice, so they
    are best ``written``.
    """
    hot, cold = F.broadcast(facts.where(F.col("n") * HOT_SHARE > n_rows)), facts.where(F.col("n") * HOT_SHARE <= n_rows)
    others = rows.join(hot.select(key), key, "left_anti").join(cold, key, how)
    return rows.join(hot, key).unionByName(others)


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a text column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``most`` bytes together, a text at least each."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy()
    part = np.cumsum(sizes, dtype=np.int64) // most
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if part.size else np.zeros(1, int)
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield batch.slice(low, high - low)


def gathered(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one, as long as their texts have no more than ``most`` bytes together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        own = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and size + own > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield pa.concat_batches(held)


#: Lengths for which the effect of appended bytes on a checksum is tabulated whole.
SHORT = 128


@functools.lru_cache(maxsize=1)
def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """How a crc32 moves on when bytes follow: by 0 to SHORT - 1 bytes, and by 2**k bytes.

    A table has the effect of each byte of the checksum, which add up by xor.
    """
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    short = [np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]]
    for _ in range(SHORT - 1):
        short.append((short[-1] >> 8) ^ step[short[-1] & 255])
    doubled = [short[1]]
    for _ in range(31):
        t = doubled[-1]
        doubled.append(t[0][t & 255] ^ t[1][(t >> 8) & 255] ^ t[2][(t >> 16) & 255] ^ t[3][t >> 24])
    return np.array(short), np.array(doubled)


def crc_after(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of joint byte strings, from those of their two parts and the right part's ``size`` in bytes."""
    short, doubled = _crc_tables()
    moved = np.empty_like(left)
    if size.size and int(size.max()) >= SHORT:
        few = size < SHORT
        moved[few] = crc_after(left[few], np.zeros_like(right[few]), size[few])
        c, n = left[~few], size[~few]
        for k in range(32):
            on = ((n >> k) & 1).astype(bool)
            x, t = c[on], doubled[k]
            c[on] = t[0][x & 255] ^ t[1][(x >> 8) & 255] ^ t[2][(x >> 16) & 255] ^ t[3][x >> 24]
        moved[~few] = c
    else:
        moved = short[size, 0, left & 255] ^ short[size, 1, (left >> 8) & 255] ^ short[size, 2, (left >> 16) & 255] ^ short[size, 3, left >> 24]
    return moved ^ right
