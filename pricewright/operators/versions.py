"""Versions of a table: written under unique names, and pointed to by compare-and-swap.

A version is a folder ``version=<name>-<unique>`` that nobody writes to once it is
staged; it may hold several tables.  A pointer is a file ``_current-<number>.json``
that names a version and the version it replaces.  It comes into being at once with
its whole content, and only if no file of that number exists: of two writers that
started from the same version one wins, the other gets ``Conflict`` and starts again
from the winner's.  Readers resolve the newest pointer once and go on with its
version; replaced versions stay for a grace period, after which ``clean`` takes them.
A writer that crashes leaves a version without a pointer, which nobody reads.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has replaced the version that a change was made from."""


@dataclass(frozen=True)
class Pointer:
    """The version that is served, the one it replaced, when (seconds), and the writer's notes."""

    number: int
    version: str
    replaces: str | None
    at: float
    notes: dict = field(default_factory=dict)


def _file(spark: SparkSession, at: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, pattern: str) -> list[str]:
    fs, path = _file(spark, pattern)
    return [x.getPath().getName() for x in fs.globStatus(path) or ()]


def _text(spark: SparkSession, at: str) -> str:
    fs, path = _file(spark, at)
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _create(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """Create a file with all its content at once; ``Conflict`` if it is there.

    The content goes to a file beside it, which then gets the name: by a link on
    a local disk, where renaming would replace, and by renaming elsewhere.
    """
    fs, part = _file(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    path = _file(spark, f"{folder}/{name}")[1]
    jvm = spark._jvm
    out = fs.create(part, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri())
            jvm.java.nio.file.Files.createLink(local(path), local(part))
        else:
            no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.isAbsolute() else fs.getUri(), spark._jsc.hadoopConfiguration()).rename(part, path, no_options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise Conflict(f"{folder}/{name} is there already") from None
        raise
    finally:
        fs.delete(part, False)


def head(spark: SparkSession, folder: str) -> Pointer | None:
    """The newest pointer; None where nothing was published."""
    newest = max(_names(spark, f"{folder}/_current-*.json"), default=None)
    return None if newest is None else Pointer(**json.loads(_text(spark, f"{folder}/{newest}")))


#: One table, or several by name; a table may be made from the folder of those written before it.
Tables = DataFrame | Mapping[str, DataFrame | Callable[[str], DataFrame]]


def stage(folder: str, name: str, tables: Tables) -> str:
    """Write a version that nothing points to yet; its unique name."""
    version = f"version={name}-{uuid.uuid4().hex}"
    for part, rows in ({"": tables} if isinstance(tables, DataFrame) else tables).items():
        rows = rows if isinstance(rows, DataFrame) else rows(f"{folder}/{version}")
        rows.write.mode("error").parquet(f"{folder}/{version}/{part}".rstrip("/"))
    return version


def commit(spark: SparkSession, folder: str, version: str, base: Pointer | None, notes: Mapping | None = None) -> Pointer:
    """Point to a staged version in place of ``base``; ``Conflict`` if another one has been pointed to since."""
    pointer = Pointer((base.number if base else 0) + 1, version, base.version if base else None, time.time(), dict(notes or {}))
    _create(spark, folder, f"_current-{pointer.number:012d}.json", json.dumps(asdict(pointer)))
    return pointer


def read(spark: SparkSession, folder: str, part: str = "", pointer: Pointer | None = None) -> DataFrame:
    """A table of the served version, or of that of a pointer resolved before."""
    pointer = pointer or head(spark, folder)
    if pointer is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{folder}/{pointer.version}/{part}".rstrip("/"))


def publish(rows: DataFrame, folder: str, name: str = "table", min_rows: int = 1) -> Pointer:
    """Stage a version, check it, and point to it in place of the one served when this began.

    A version with fewer than ``min_rows`` rows is deleted and refused; what is
    served stays as it is.
    """
    spark = rows.sparkSession
    base = head(spark, folder)
    version = stage(folder, name, rows)
    if min_rows and spark.read.schema(rows.schema).parquet(f"{folder}/{version}").limit(min_rows).count() < min_rows:
        drop(spark, folder, version)
        raise ValueError("the new version has too few rows")
    return commit(spark, folder, version, base)


def update(spark: SparkSession, folder: str, change: Callable[[Pointer | None], Tables | None], name: str = "table", notes: Mapping | None = None, tries: int = 5) -> Pointer | None:
    """Apply a change to the served version, again from the newest one where another writer came first.

    ``change`` gets the pointer it starts from and gives the new tables, or None
    where there is nothing to do.
    """
    for _ in range(tries):
        base = head(spark, folder)
        tables = change(base)
        if tables is None:
            return base
        version = stage(folder, name, tables)
        try:
            return commit(spark, folder, version, base, notes)
        except Conflict:
            drop(spark, folder, version)
    raise Conflict(f"{folder}: {tries} times another writer came first")


def drop(spark: SparkSession, folder: str, version: str) -> None:
    fs, path = _file(spark, f"{folder}/{version}")
    fs.delete(path, True)


def clean(spark: SparkSession, folder: str, grace: float = 86_400.0, now: float | None = None) -> list[str]:
    """Delete what has not been served for ``grace`` seconds: replaced versions, their pointers, and leftovers of crashes.

    The newest pointer and its version always stay.  A version without a pointer
    may belong to a writer at work; it goes once it is older than the grace.
    """
    now = time.time() if now is None else now
    files = sorted(_names(spark, f"{folder}/_current-*.json"))
    pointers = [Pointer(**json.loads(_text(spark, f"{folder}/{x}"))) for x in files]
    # A version was served until the next pointer came.
    kept = {p.version for p, after in zip(pointers, [*pointers[1:], None], strict=True) if after is None or now - after.at <= grace}
    gone = []
    fs, path = _file(spark, f"{folder}/version=*")
    for found in fs.globStatus(path) or ():
        name = found.getPath().getName()
        named = any(p.version == name for p in pointers)
        if name not in kept and (named or now - found.getModificationTime() / 1000 > grace):
            drop(spark, folder, name)
            gone.append(name)
    for name, p in zip(files, pointers, strict=True):
        if p.version not in kept:
            drop(spark, folder, name)
    for found in fs.globStatus(_file(spark, f"{folder}/._current-*")[1]) or ():
        if now - found.getModificationTime() / 1000 > grace:
            fs.delete(found.getPath(), False)
    return gone


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that a checkpoint folder belongs to."""
    return json.loads(_text(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]
