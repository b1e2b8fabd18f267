"""Files wherever Spark's paths lead: the local disk, or a store that Arrow's file systems reach."""

from __future__ import annotations

import re
from urllib.parse import quote

import pyarrow.fs as pafs


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path within it; spaces and the like may stand unquoted."""
    local = re.sub(r"^file:(//)?(?=/)", "", path)
    if "://" not in local:
        return pafs.LocalFileSystem(), local
    return pafs.FileSystem.from_uri(quote(path, safe="%/:@?&=+$,;~"))


def opened(path: str):
    """A file to be read in ranges."""
    store, at = located(path)
    return store.open_input_file(at)
