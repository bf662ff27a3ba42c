"""Files of a folder tree as a Spark data source (A1, A9), and reads of single files by ranges.

Spark's file scan never lists empty files; ``mail_tree`` lists every file with its size, so 'seen' and 'empty' are
true counts.  Options: ``path``; ``content`` (false: the listing alone); ``maxBytes`` and ``skipArchives`` (gates on the
listing: what they shut out is never opened); ``maxPartitionBytes`` and ``openCostInBytes`` (files are
packed into partitions by size plus cost); for streams ``log`` and ``maxFilesPerTrigger``.

The listing (path, size, time) is held by the planner, as it is for Spark's own file sources; contents are read
in tasks and leave them in Arrow batches of BATCH_BYTES, so a task holds one batch, or one file that is larger.
A file of 2 GB or more cannot be a cell: reading it raises an error, listing it and its fingerprint work.

A stream keeps one list of files for each batch under ``log`` (a folder that outlives the query, written whole, then
renamed): offsets are numbers of lists, so a replayed batch has the same files, whatever came since.  A file counts
as seen by its path; one that changes later is not read again.

Paths are of any file system that ``pyarrow.fs`` knows; they are named as Spark names them (``file:/a/b``).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from mailsieve.functions.constants import ARCHIVE_SUFFIXES

BATCH_BYTES = 16 << 20
RANGE_BYTES = 8 << 20
LISTED = "path string, length long, modificationTime timestamp"
ARCHIVES = tuple("." + s.replace("\\", "") for s in ARCHIVE_SUFFIXES)


def open_root(path: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, path within it, and what stands before such a path in a name."""
    local = re.sub(r"^file:(//)?", "", path)
    if local != path or "://" not in path:
        return pafs.LocalFileSystem(), local.rstrip("/") or "/", "file:"
    found, inner = pafs.FileSystem.from_uri(path)
    return found, inner, path.rstrip("/").removesuffix(inner)


def files(root: str) -> list[tuple[str, int, datetime]]:
    """(name, size, time) of every file below ``root``, or of ``root`` if it is a file; by name."""
    system, inner, before = open_root(root)
    top = system.get_file_info(inner)
    if top.type == pafs.FileType.NotFound:
        raise FileNotFoundError(root)
    found = [top] if top.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted((before + i.path, i.size or 0, i.mtime or datetime.fromtimestamp(0, timezone.utc)) for i in found if i.type == pafs.FileType.File)


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    listed: list[tuple[str, int, datetime]]


def pack(listed: list, most: int, cost: int) -> list[Files]:
    """Neighbouring files up to ``most`` bytes, each counted with ``cost``; a larger one stands alone."""
    out: list[Files] = []
    size = 0
    for f in listed:
        if not out or size + f[1] + cost > most:
            out.append(Files([]))
            size = 0
        out[-1].listed.append(f)
        size += f[1] + cost
    return out


class _Read:
    """What the batch and the stream reader share: gates, partitions and the reading itself."""

    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.content = options.get("content", "true").lower() == "true"
        self.max_bytes = int(options.get("maxbytes", 0))
        self.skip_archives = options.get("skiparchives", "false").lower() == "true"
        self.most = int(options.get("maxpartitionbytes", 128 << 20))
        self.cost = int(options.get("opencostinbytes", 64 << 10))

    def listed(self) -> list[tuple[str, int, datetime]]:
        return [f for f in files(self.root) if not (self.max_bytes and f[1] > self.max_bytes)
                and not (self.skip_archives and f[0].lower().endswith(ARCHIVES))]

    def packed(self, listed: list) -> list[Files]:
        return pack(listed, self.most, self.cost if self.content else self.most >> 16)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        system, _, before = open_root(self.root)
        for name, size, time in partition.listed:
            data = None
            if self.content:
                with system.open_input_stream(name.removeprefix(before)) as f:
                    data = f.read()
                held += len(data)
            rows.append((name, size, time, data))
            if held >= BATCH_BYTES or len(rows) >= 10_000:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list) -> pa.RecordBatch:
        name, size, time, data = zip(*rows)
        columns = {"path": pa.array(name, pa.string()), "length": pa.array(size, pa.int64()),
                   "modificationTime": pa.array(time, pa.timestamp("us", "UTC"))}
        if self.content:
            columns["content"] = pa.array(data, pa.binary())
        return pa.RecordBatch.from_pydict(columns)


class MailTreeReader(_Read, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.packed(self.listed()) or [Files([])]


class MailTreeStream(_Read, DataSourceStreamReader):
    """Offset n: the first n lists of files under ``log``."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        if "log" not in options:
            raise ValueError("a mail_tree stream needs the option log: a folder for its lists of files")
        self.log, self.log_path, _ = open_root(options["log"])
        self.per_trigger = int(options.get("maxfilespertrigger", 0))
        self.log.create_dir(self.log_path, recursive=True)
        self.n = 0
        self.seen: set[str] = set()
        while self.log.get_file_info(self._list(self.n + 1)).type == pafs.FileType.File:
            self.n += 1
            self.seen.update(f[0] for f in self._read_list(self.n))

    def _list(self, n: int) -> str:
        return f"{self.log_path}/{n}.json"

    def _read_list(self, n: int) -> list[tuple[str, int, datetime]]:
        with self.log.open_input_stream(self._list(n)) as f:
            return [(a, b, datetime.fromtimestamp(c, timezone.utc)) for a, b, c in json.loads(f.read())]

    def initialOffset(self) -> dict:
        return {"lists": 0}

    def latestOffset(self) -> dict:
        new = [f for f in self.listed() if f[0] not in self.seen]
        if self.per_trigger:
            new = sorted(new, key=lambda f: (f[2], f[0]))[:self.per_trigger]
        if new:
            with self.log.open_output_stream(self._list(self.n + 1) + ".part") as f:
                f.write(json.dumps([(a, b, c.timestamp()) for a, b, c in new]).encode())
            self.log.move(self._list(self.n + 1) + ".part", self._list(self.n + 1))
            self.n += 1
            self.seen.update(f[0] for f in new)
        return {"lists": self.n}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.packed([f for n in range(start["lists"] + 1, end["lists"] + 1) for f in self._read_list(n)])

    def commit(self, end: dict) -> None:
        """The lists stay: they say what was seen."""


class MailTree(DataSource):
    """``spark.read.format("mail_tree").load(root)``; see the module."""

    @classmethod
    def name(cls) -> str:
        return "mail_tree"

    def schema(self) -> str:
        return LISTED + (", content binary" if self.options.get("content", "true").lower() == "true" else "")

    def reader(self, schema) -> MailTreeReader:
        return MailTreeReader(self.options)

    def streamReader(self, schema) -> MailTreeStream:
        return MailTreeStream(self.options)


# --- single files by ranges ---------------------------------------------------------------

def sha256_of(name: str) -> str:
    """Hex SHA-256 of a file of any size, read in ranges; 'NA' where it cannot be read."""
    digest = hashlib.sha256()
    try:
        system, inner, _ = open_root(name)
        with system.open_input_stream(inner) as f:
            while piece := f.read(RANGE_BYTES):
                digest.update(piece)
    except OSError:
        return "NA"
    return digest.hexdigest()


def first_record(name: str) -> list[str]:
    """The fields of a CSV file's first record (quotes may hold line ends); none for an empty file."""
    import csv
    import io

    system, inner, _ = open_root(name)
    with system.open_input_file(inner) as f:
        return next(csv.reader(io.TextIOWrapper(f, "utf-8-sig", "replace", newline="")), [])
