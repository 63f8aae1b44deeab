"""Files for tasks of Spark: listing, reading, and writing whole files that appear only when the job commits."""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str, pattern: str, recursive: bool) -> list[tuple[str, int]]:
    """Path (as URI where ``path`` was one) and size of all files below ``path`` whose name fits the pattern, in order of path."""
    store, inner = store_of(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=recursive))
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    files = [(head + f.path, f.size) for f in found if f.type == fs.FileType.File and (f is info or fnmatch.fnmatch(posixpath.basename(f.path), pattern))]
    return sorted(files)


def read_bytes(path: str) -> bytes:
    store, inner = store_of(path)
    with store.open_input_stream(inner) as f:
        return f.read()


@dataclass
class Made(WriterCommitMessage):
    """Files that one task wrote: where they lie now, and their names."""

    files: list[tuple[str, str]] = field(default_factory=list)


class WholeFileWriter(DataSourceWriter):
    """Writes files below a folder of its own; the job's commit moves them to ``path``, its abort removes them.

    A task that is killed or run twice leaves files that no commit names; they go with the folder. With ``overwrite``
    the commit also removes the files that were at ``path`` before. A name that two tasks made is an error.
    """

    def __init__(self, path: str, suffix: str, overwrite: bool) -> None:
        self.path, self.suffix, self.overwrite = path.rstrip("/"), suffix, overwrite
        self.open_folder = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    @contextmanager
    def file(self, name: str, made: Made) -> Iterator:
        """A stream that becomes the file ``name`` (with the suffix) on commit; slashes in it become underscores."""
        name = f"{name.replace('/', '_')}{self.suffix}"
        now = f"{self.open_folder}/{uuid.uuid4().hex}"
        store, inner = store_of(now)
        store.create_dir(posixpath.dirname(inner), recursive=True)
        with store.open_output_stream(inner) as out:
            yield out
        made.files.append((now, name))

    def commit(self, messages: list[Made | None]) -> None:
        store, inner = store_of(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"several documents of one name: {sorted({n for n in names if names.count(n) > 1})[:5]}")
        store.create_dir(inner, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(inner)):
                if f.type == fs.FileType.File and f.path.endswith(self.suffix):
                    store.delete_file(f.path)
        for now, name in files:
            store.move(store_of(now)[1], f"{inner}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Made | None]) -> None:
        store, inner = store_of(self.open_folder)
        if store.get_file_info(inner).type == fs.FileType.Directory:
            store.delete_dir(inner)
