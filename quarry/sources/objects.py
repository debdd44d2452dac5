"""Objects of a store as a data source: a row per object, written with commit and abort, read in partitions.

    spark.dataSource.register(Objects)
    pages.select("key", "content").write.format("objects").mode("append").save("s3://bucket/pages")
    spark.read.format("objects").option("prefix", "u1/").load("s3://bucket/pages")

Tasks write below a staging folder of their own; only when all have ended do
the objects move to their keys, and if one fails, or the job, staging goes and
nothing else has changed.  A task that ran twice leaves one copy.  A read deals
out the listing by size, so partitions hold about `partitionBytes` each, and
every task opens its own objects.  Any store that Arrow's file systems reach,
from driver and executors, will do.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

STAGING = "_staging"
PARTITION_BYTES = 64 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def checked(key: str | None) -> str:
    """A key that stays below the root; an error for any other."""
    if not key or key.startswith(("/", "_")) or posixpath.normpath(key) != key or key.split("/")[0] == "..":
        raise ValueError(f"no key of an object: {key!r}")
    return key


@dataclass
class _Part(InputPartition):
    keys: list[tuple[str, int]]


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    keys: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str, prefix: str, partition_bytes: int) -> None:
        self.path, self.prefix, self.partition_bytes = path, prefix, partition_bytes

    def partitions(self) -> list[InputPartition]:
        store, root = opened(self.path)
        # The listing starts at the deepest folder of the prefix.
        folder = posixpath.join(root, posixpath.dirname(self.prefix)) if "/" in self.prefix else root
        found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        base = root.rstrip("/") + "/"
        named = sorted((f.path.removeprefix(base), f.size or 0) for f in found if f.type == fs.FileType.File)
        parts: list[_Part] = []
        room = 0
        for key, size in named:
            if key.startswith(f"{STAGING}/") or not key.startswith(self.prefix):
                continue
            if not parts or room + size > self.partition_bytes:
                parts.append(_Part([]))
                room = 0
            parts[-1].keys.append((key, size))
            room += size
        return parts or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        store, root = opened(self.path)
        for key, size in partition.keys:
            with store.open_input_stream(posixpath.join(root, key)) as source:
                yield key, size, source.read()


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return posixpath.join(root, STAGING, self.job)

    def write(self, rows: Iterator[Row]) -> _Written:
        store, root = opened(self.path)
        folder = posixpath.join(self._staging(root), uuid.uuid4().hex)
        keys = []
        try:
            for row in rows:
                key = checked(row["key"])
                target = posixpath.join(folder, key)
                store.create_dir(posixpath.dirname(target), recursive=True)
                with store.open_output_stream(target) as out:
                    out.write(row["content"] or b"")
                keys.append(key)
        except BaseException:
            # What another attempt writes is not touched.
            if store.get_file_info(folder).type != fs.FileType.NotFound:
                store.delete_dir(folder)
            raise
        return _Written(folder, keys)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = opened(self.path)
        written = [m for m in messages if m is not None]
        keys = [k for m in written for k in m.keys]
        if len(keys) != len(set(keys)):
            self.abort(messages)
            raise ValueError("a key occurs twice")
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.base_name != STAGING:
                    store.delete_dir(old.path) if old.type == fs.FileType.Directory else store.delete_file(old.path)
        for folder in sorted({posixpath.dirname(k) for k in keys}):
            store.create_dir(posixpath.join(root, folder), recursive=True)
        for m in written:
            for key in m.keys:
                store.move(posixpath.join(m.folder, key), posixpath.join(root, key))
        self._clear(store, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(self._staging(root)).type != fs.FileType.NotFound:
            store.delete_dir(self._staging(root))
        above = posixpath.join(root, STAGING)
        if store.get_file_info(above).type != fs.FileType.NotFound and not store.get_file_info(fs.FileSelector(above)):
            store.delete_dir(above)


class Objects(DataSource):
    """Reads key, size, content; writes key, content."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return "key string, size long, content binary"

    def _path(self) -> str:
        if not (path := self.options.get("path")):
            raise ValueError("the path is missing")
        return path

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._path(), self.options.get("prefix", ""), int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if set(schema.fieldNames()) != {"key", "content"}:
            raise ValueError("objects have a key and a content")
        return _Writer(self._path(), overwrite)
