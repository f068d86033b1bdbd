"""Archives and folders behind ``spark.read.format`` and ``spark.readStream.format``.

``archives`` reads the zip files below a folder, ``folders`` the files themselves, each as
rows ``path, entry, n, piece, content, problem``. Only names and lengths pass through the
driver, a slice at a time, and are kept packed, at some ten bytes a file. An archive is cut into byte ranges; a task takes the entries that begin in its range,
so one large archive is unpacked by many tasks, and many small ones share a task. An entry
comes in pieces of ``pieceBytes``, so it may be larger than a row.

As streams they go on from the time and name of the last file they have taken. A file counts
once it has not changed for ``settleSeconds``.

Options: ``path``; ``partitionBytes`` (128 MB); ``pieceBytes`` (64 MB); ``settleSeconds`` (0).
"""

from __future__ import annotations

import itertools
import pickle
import time
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from gleanwork.sources.archives import opened, safe_name
from gleanwork.sources.storage import LISTING_SLICE, folder_entries, open_store

ENTRY_SCHEMA = "path string, entry string, n bigint, piece int, content binary, problem string"
_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("entry", pa.string()),
        ("n", pa.int64()),
        ("piece", pa.int32()),
        ("content", pa.binary()),
        ("problem", pa.string()),
    ]
)
PARTITION_BYTES = 128 << 20
PIECE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
# A file costs at least as much as this many bytes, so that a task does not get too many.
OPEN_BYTES = 1 << 20
# With more tasks than this small ones are put together, as each takes memory of the driver.
MANY_SHARES = 2_000


@dataclass
class Found:
    """A file of the listing."""

    path: str
    length: int
    changed: int


@dataclass
class Share(InputPartition):
    """Byte ranges of one task, packed; ``size`` is the length of its files, or of what it takes of them."""

    packed: list[bytes]
    size: int

    @property
    def ranges(self) -> list[tuple[str, int, int]]:
        """Byte ranges ``path, start, end``; ``end`` is the file's own where it is not cut."""
        return [r for block in self.packed for r in zip(*pickle.loads(zlib.decompress(block)))]


def _share(ranges: list[tuple[str, int, int]]) -> Share:
    block = zlib.compress(pickle.dumps([*zip(*ranges)]), 1)
    return Share([block], sum(end - start for _, start, end in ranges))


def listed(folder: str, suffix: str) -> Iterator[Found]:
    """Files below a folder, in slices by path: a folder may have more files than the driver can hold."""
    todo = [folder.rstrip("/")]
    while todo:
        at = todo.pop()
        entries = folder_entries(at)
        while rows := sorted(itertools.islice(entries, LISTING_SLICE)):
            for name, is_dir, length, changed in rows:
                if is_dir:
                    todo.append(f"{at}/{name}")
                elif name.endswith(suffix):
                    yield Found(f"{at}/{name}", length, changed)


def shares(files: Iterable[Found], size: int, cut: bool) -> list[Share]:
    """Tasks of about ``size`` bytes; ``cut`` files go to several if they are larger."""
    out, ranges, held = [], [], 0
    for file in files:
        starts = range(0, max(file.length, 1), size) if cut else [0]
        for start in starts:
            end = min(start + size, file.length) if cut else file.length
            cost = max(end - start, min(OPEN_BYTES, size))
            if ranges and held + cost > size:
                out.append(_share(ranges))
                ranges, held = [], 0
            ranges.append((file.path, start, end))
            held += cost
    return _together([*out, _share(ranges)] if ranges else out, size)


def _together(some: list[Share], size: int) -> list[Share]:
    """At most ``MANY_SHARES`` tasks, by putting neighbours together, unless they had more than ``size`` bytes then."""
    most, out = -(-len(some) // MANY_SHARES), []
    for share in some:
        if out and len(out[-1].packed) < most and out[-1].size + share.size <= size:
            out[-1] = Share([*out[-1].packed, *share.packed], out[-1].size + share.size)
        else:
            out.append(share)
    return out


def _members(path: str, start: int, end: int, piece: int) -> Iterator[tuple]:
    """Entries of an archive whose header lies in a byte range; of equal names the last one counts."""
    store, inner = open_store(path)
    try:
        with store.open_input_file(inner) as source, opened(source) as archive:
            last = {safe_name(info.filename): info for info in archive.infolist() if not info.is_dir()}
            for entry, info in last.items():
                if start <= info.header_offset < end:
                    yield from _pieces(path, entry, info, archive, piece)
    except zipfile.BadZipFile:
        if start == 0:
            yield path, None, None, None, None, "bad_archive"


def _pieces(path: str, entry: str, info: zipfile.ZipInfo, archive: zipfile.ZipFile, piece: int) -> Iterator[tuple]:
    """An entry in pieces; one that cannot be read to its end gives a last row that says so."""
    number = 0
    try:
        with archive.open(info) as data:
            while (content := data.read(piece)) or number == 0:
                yield path, entry, info.file_size, number, content, None
                number += 1
                if len(content) < piece:
                    # reading on checks the sum at the end of the entry
                    data.read(1)
                    break
    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError):
        yield path, entry, info.file_size, number, None, "bad_entry"


def _whole(path: str, start: int, end: int, piece: int) -> Iterator[tuple]:
    store, inner = open_store(path)
    try:
        with store.open_input_stream(inner) as data:
            number = 0
            while (content := data.read(piece)) or number == 0:
                yield path, path.rsplit("/", 1)[-1], end, number, content, None
                number += 1
    except OSError:
        yield path, path.rsplit("/", 1)[-1], end, 0, None, "bad_file"


class _Work:
    """What readers of both kinds share."""

    suffix, cut, rows = "", False, staticmethod(_whole)

    def __init__(self, options: Mapping[str, str]):
        if not options.get("path"):
            raise ValueError("the path option is needed")
        self.folder = options["path"]
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))
        self.piece = int(options.get("pieceBytes", PIECE_BYTES))
        self.settle = float(options.get("settleSeconds", 0))

    def read(self, partition: Share | None) -> Iterator[pa.RecordBatch]:
        """Rows of a share; Spark gives None in place of a plan without shares."""
        held, size = [], 0
        for path, start, end in partition.ranges if partition is not None else []:
            for row in type(self).rows(path, start, end, self.piece):
                held.append(row)
                size += len(row[4] or b"")
                if size >= BATCH_BYTES or len(held) >= 2_000:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _Reader(_Work, DataSourceReader):
    def partitions(self) -> list[Share]:
        return shares(listed(self.folder, self.suffix), self.size, self.cut)


class _StreamReader(_Work, DataSourceStreamReader):
    """Offsets are the time and path of the last file taken."""

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def _settled(self) -> Iterator[Found]:
        limit = time.time_ns() - int(self.settle * 1e9)
        return (f for f in listed(self.folder, self.suffix) if f.changed <= limit)

    def latestOffset(self) -> dict:
        last = max(((f.changed, f.path) for f in self._settled()), default=(-1, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        low, high = (start["changed"], start["path"]), (end["changed"], end["path"])
        new = (f for f in self._settled() if low < (f.changed, f.path) <= high)
        return shares(new, self.size, self.cut)

    def commit(self, end: dict) -> None:
        """The offsets in the checkpoint are all there is to keep."""


class _Archives:
    suffix, cut, rows = ".zip", True, staticmethod(_members)


class ArchiveReader(_Archives, _Reader):
    pass


class ArchiveStreamReader(_Archives, _StreamReader):
    pass


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return ENTRY_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ArchiveStreamReader(self.options)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return ENTRY_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register_formats(spark: SparkSession) -> None:
    """Make ``archives`` and ``folders`` known to a session."""
    for source in (ArchiveSource, FolderSource):
        spark.dataSource.register(source)
