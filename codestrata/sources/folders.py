"""Folders that every task can open: trees of files to read, and, as a Python data source, files with names of their own to write.

Names are taken below one resolved root, so nothing is searched for in a path. Tasks list the files, which are dealt by their sizes. What
is written becomes visible by a rename when all tasks are done; a task that is lost or repeated leaves nothing behind. Names of files
stay in the tasks: the driver knows the folder of each task only.
"""

from __future__ import annotations

import os
import shutil
import sys
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from urllib.parse import unquote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

PART_BYTES, PART_FILES = 16 << 20, 1_000  # of a part that is dealt to a task
BATCH_BYTES = 4 << 20
PLACES, TASKS = "places", "tasks"  # files of a writer
FILES = "repo string, path string, content string, size_bytes long"
NAMED = "folder string, filename string, body string"


def local(path: str) -> str:
    """The absolute path of a local folder given as such or as a ``file:`` address."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return os.path.abspath(path)


def on_disk(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder of the machines themselves and not of a store that only Spark reads."""
    if path.startswith("file:") or "://" in path:
        return path.startswith("file:")
    return spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")


def listed(root: str, glob: str | None = None, share: int = 0, shares: int = 1) -> Iterator[tuple[str, int]]:
    """Regular files below ``root``, links to files among them, as paths from there and sizes; those below one of ``shares`` shares of its entries."""
    waiting = [""]
    while waiting:
        folder = waiting.pop()
        with os.scandir(os.path.join(root, folder)) as entries:
            for entry in entries:
                if not folder and zlib.crc32(os.fsencode(entry.name)) % shares != share:
                    continue
                below = os.path.join(folder, entry.name)
                if entry.is_dir(follow_symlinks=False):
                    waiting.append(below)
                elif entry.is_file() and (not glob or fnmatchcase(entry.name, glob)):
                    yield below, entry.stat().st_size


def shown(name: str) -> str:
    """A file name as text: bytes that are not UTF-8 as ``\\xff``, so that different names stay different."""
    return os.fsencode(name).decode("utf-8", "backslashreplace")


@dataclass
class Files:
    names: list[tuple[str, int]]


class TreeReader:
    """Files below a folder whose direct subfolders are repositories. Options: path, glob (of file names), share and shares (of the repositories)."""

    def __init__(self, options: dict):
        self.root, self.glob = local(options["path"]), options.get("glob")
        self.share = options.get("share", 0), options.get("shares", 1)

    def partitions(self) -> list[Files]:
        """Files in order of size, each part at most PART_BYTES or one larger file."""
        parts, held = [Files([])], 0
        for name, size in sorted(listed(self.root, self.glob, *self.share), key=lambda f: (-f[1], f[0])):
            if parts[-1].names and (held + size > PART_BYTES or len(parts[-1].names) == PART_FILES):
                parts.append(Files([]))
                held = 0
            parts[-1].names.append((name, size))
            held += size
        return parts

    def read(self, names: Iterable[str]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for name in names:
            repo, _, path = name.partition("/")
            if path:
                with open(os.path.join(self.root, name), "rb") as file:
                    data = file.read()
                if rows and held + len(data) > BATCH_BYTES:
                    yield self.table(rows)
                    rows, held = [], 0
                rows.append((shown(repo), shown(path), data.decode("utf-8", "replace"), len(data)))
                held += len(data)
        if rows:
            yield self.table(rows)

    def table(self, rows: list[tuple[str, str, str, int]]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds, strict=True)], ["repo", "path", "content", "size_bytes"])


def tree(spark: SparkSession, root: str, glob: str | None, shares: int) -> DataFrame:
    """A row for every file. Each task lists a share of the repositories and deals their files in parts, which go round to all tasks to be read."""
    options = {"path": root, "glob": glob}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for share in batch.column("id").to_pylist():
                for part in TreeReader(options | {"share": share, "shares": shares}).partitions():
                    names = [os.fsencode(name) for name, _ in part.names]
                    yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.binary()))], ["names"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names in batch.column("names"):
                yield from TreeReader(options).read(map(os.fsdecode, names.as_py()))

    parts = spark.range(0, shares, 1, shares).mapInArrow(deal, "names array<binary>").repartition(shares)
    return parts.mapInArrow(read, FILES)


def escaped(name: str) -> str:
    """A text as one path segment; ``unescaped`` gives it back."""
    if not name:
        raise ValueError("a file or folder needs a name")
    safe = name.replace("%", "%25").replace("/", "%2F").replace("\0", "%00")
    return safe if safe.strip(".") else safe.replace(".", "%2E")


def unescaped(name: str) -> str:
    return unquote(name)


# As Spark names the folders of partitions.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
IN_PARTITIONS = {i: f"%{i:02X}" for i in [*range(0x20), *b"\"#%'*/:=?\\{[]^", 0x7F]}


def partition(key: str, value: str | None) -> str:
    return f"{key}={value.translate(IN_PARTITIONS) if value else NO_VALUE}"


@dataclass
class Written(WriterCommitMessage):
    folder: str  # of a task: its files by number, and the list of their places below the root


class NamedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.staging = options["staging"]
        self.keys = options["keys"].split(",") if "keys" in options else None

    def place(self, folder: str | None, filename: str | None) -> str:
        if self.keys:
            return os.path.join(*map(partition, self.keys, (folder, filename)), "part-00000.txt")
        return os.path.join(escaped(folder), escaped(filename))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file for each (folder, filename); rows of one file follow each other and each ends in a line break."""
        own = os.path.join(self.staging, uuid.uuid4().hex)
        os.makedirs(own)
        last, out, files = None, None, 0
        with open(os.path.join(own, PLACES), "wb") as places:
            for batch in iterator:
                for folder, filename, body in zip(*(batch.column(c).to_pylist() for c in ("folder", "filename", "body")), strict=True):
                    if (folder, filename) != last:
                        if out:
                            out.close()
                        last = (folder, filename)
                        places.write(os.fsencode(self.place(folder, filename)) + b"\0")
                        out = open(os.path.join(own, str(files)), "wb")
                        files += 1
                    out.write(((body or "") + "\n").encode())
        if out:
            out.close()
        return Written(own)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.staging, exist_ok=True)
        with open(os.path.join(self.staging, TASKS), "w") as file:
            file.writelines(os.path.basename(message.folder) + "\n" for message in messages if message)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def move(own: str, root: str) -> None:
    """The files of a task's folder to their places below ``root``; a repeated call goes on where an earlier one ended."""
    with open(os.path.join(own, PLACES), "rb") as file:
        places = file.read().split(b"\0")[:-1]
    last = None
    for i, place in enumerate(places):
        target = os.path.join(root, os.fsdecode(place))
        if os.path.dirname(target) != last:
            last = os.path.dirname(target)
            os.makedirs(last, exist_ok=True)
        try:
            os.replace(os.path.join(own, str(i)), target)
        except FileNotFoundError:
            if not os.path.exists(target):
                raise


def write_files(named: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Rows (folder, filename, body), those of one file together and in order, as files below ``path``; tasks move what all tasks have written.

    With ``keys``, the names of the two columns, each file has a folder of its own, named as Spark names those of
    partitions; what was below ``path`` before goes when all tasks have written.
    """
    spark, root = named.sparkSession, local(path)
    staging = os.path.join(root, f".writing-{uuid.uuid4().hex}")
    spark.dataSource.register(NamedSource)
    try:
        named.write.format("named_files").mode("append").options(staging=staging, **({"keys": ",".join(keys)} if keys else {})).save()
        if keys:
            for entry in [*os.scandir(root)]:
                if entry.path != staging:
                    shutil.rmtree(entry.path) if entry.is_dir(follow_symlinks=False) else os.remove(entry.path)
        with open(os.path.join(staging, TASKS)) as file:
            folders = [os.path.join(staging, line.strip()) for line in file]
        if folders:
            spark.sparkContext.parallelize(folders, len(folders)).foreach(lambda own: move(own, root))
        if keys:
            open(os.path.join(root, "_SUCCESS"), "w").close()
    finally:
        shutil.rmtree(staging, ignore_errors=True)


class NamedSource(DataSource):
    """Writes ``folder/filename`` files of text to folders of the tasks, for ``move``.

    Options: staging, the folder of those; keys, for the folders of partitions. Files of the same name are replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return NAMED

    def writer(self, schema, overwrite: bool) -> NamedWriter:
        return NamedWriter(self.options)
