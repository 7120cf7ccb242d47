"""Where files lie: local folders and the stores that pyarrow knows, by one set of functions.

A path without a scheme (or with file://) is local; other addresses go to pyarrow's file system of
that scheme. ``known`` says whether there is one.
"""

from __future__ import annotations

import glob
import io
import os
from typing import NamedTuple

import pyarrow as pa


class Found(NamedTuple):
    path: str
    size: int
    time: int  # of the last change, in nanoseconds; 0 where a store doesn't say


def remote(path: str):
    """(file system, path in it) of an address that pyarrow reads, else null."""
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        return None


def bare(spec: str) -> str:
    return spec.removeprefix("file://")


def known(spec: str) -> bool:
    """Whether Python reads an address (and a pattern, if it is one); else only Spark does."""
    return "://" not in bare(spec) or (remote(spec) is not None and not glob.has_magic(spec))


def open_file(path: str) -> io.BufferedReader:
    if "://" not in path:
        return open(path, "rb")
    store, name = remote(path)
    return io.BufferedReader(store.open_input_file(name))


def create(path: str):
    """A new file to write bytes to, where open_file() reads."""
    if "://" not in path:
        return open(path, "wb")
    store, name = remote(path)
    return store.open_output_stream(name)


def make_folder(path: str) -> None:
    if "://" not in path:
        os.makedirs(path, exist_ok=True)
    else:
        store, name = remote(path)
        store.create_dir(name, recursive=True)


def put(path: str, data: bytes) -> None:
    """A file that is there whole or not at all; its folder is made."""
    if "://" not in path:
        make_folder(os.path.dirname(path))
        with open(path + ".tmp", "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(path + ".tmp", path)
        return
    make_folder(path.rsplit("/", 1)[0])
    store, name = remote(path)
    with store.open_output_stream(name + ".tmp") as f:
        f.write(data)
    store.move(name + ".tmp", name)


def delete(path: str) -> None:
    if "://" not in path:
        os.remove(path)
    else:
        store, name = remote(path)
        store.delete_file(name)


def names(folder: str) -> list[str]:
    """Names of a folder's files; none if there is no folder."""
    return [f.path.rsplit("/", 1)[-1] for f in _in_folder(folder)]


def _in_folder(folder: str) -> list[Found]:
    if "://" not in folder:
        if not os.path.isdir(folder):
            return []
        with os.scandir(folder) as entries:  # the entries carry what a stat of each would cost
            return [Found(e.path, s.st_size, s.st_mtime_ns) for e in entries if e.is_file() and (s := e.stat())]
    from pyarrow import fs

    store, name = remote(folder)
    scheme = folder[: folder.index("://") + 3]
    infos = store.get_file_info(fs.FileSelector(name, allow_not_found=True))
    return [Found(scheme + f.path, f.size, f.mtime_ns or 0) for f in infos if f.type == fs.FileType.File]


def listing(spec: str, missing: bool = False) -> list[Found]:
    """Files that a path, a folder or a pattern names, in order, with sizes and times; none is opened.

    A folder is listed at once; its hidden files (a dot first) don't count. An unreadable path is an error unless it may be missing.
    """
    path = bare(spec)
    if "://" in path:
        from pyarrow import fs

        store, name = remote(path)
        info = store.get_file_info(name)
        if info.type == fs.FileType.File:
            return [Found(path, info.size, info.mtime_ns or 0)]
        if info.type == fs.FileType.NotFound and not missing:
            raise FileNotFoundError(f"not a file: {spec}")
        found = _in_folder(path)
    elif os.path.isdir(path):
        found = _in_folder(path)
    else:
        matched = sorted(glob.glob(path)) if glob.has_magic(path) else [path]
        absent = [p for p in matched if not os.path.isfile(p)]
        if (absent or not matched) and not missing:
            raise FileNotFoundError(f"not a file: {(absent or [spec])[0]}")
        stats = [(p, os.stat(p)) for p in matched if p not in set(absent)]
        return [Found(p, s.st_size, s.st_mtime_ns) for p, s in stats]
    return sorted(f for f in found if not f.path.rsplit("/", 1)[-1].startswith("."))
