"""Archives and folder trees as rows of files."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.functions.urls import extraction_folder
from gleanwork.session import task_count
from gleanwork.sources.storage import list_files, open_store

# Archives below this size are read at once.
SMALL_BYTES = 1 << 17
ENTRY_SCHEMA = "entry string, n bigint, data binary, problem string"


def safe_name(name: str) -> str:
    """Entry path kept inside the target folder, as unpacking tools do."""
    return "/".join(part for part in name.split("/") if part not in ("", ".", ".."))


def opened(source) -> zipfile.ZipFile:
    """The archive in an open file of a store, which refuses to seek before the start of a small one."""
    return zipfile.ZipFile(io.BytesIO(source.read()) if source.size() < SMALL_BYTES else source)


class UnzipEntries:
    """One row per file of an archive; of equal names the last one stays.

    Entries are read one after the other, so a task holds the archive and one
    unpacked file. An unreadable archive or entry gives a row that says why.
    """

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is None:
            yield None, None, None, "missing_archive"
            return
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile:
            yield None, None, None, "bad_archive"
            return
        last = {safe_name(info.filename): info for info in archive.infolist() if not info.is_dir()}
        for name, info in last.items():
            try:
                yield name, info.file_size, archive.read(info), None
            except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError):
                yield name, info.file_size, None, "bad_entry"


def register_unzip(spark: SparkSession) -> None:
    spark.udtf.register("unzip_entries", F.udtf(UnzipEntries, returnType=ENTRY_SCHEMA))


def unzip(archives: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """``keys`` plus one row per unpacked file of the ``content`` column."""
    spark = archives.sparkSession
    register_unzip(spark)
    return spark.sql(
        f"select {', '.join(keys)}, entry, n, data, problem "
        f"from {{archives}}, lateral unzip_entries({content})",
        archives=archives,
    )


MEMBER_SCHEMA = "path string, chunk int, member int, entry string, problem string"
FILE_SCHEMA = "path string, entry string, n bigint, content binary, problem string"

# Unpacked bytes that one task reads from an archive, and that one Arrow batch holds.
CHUNK_BYTES = 256 << 20
BATCH_BYTES = 32 << 20
# Rows of a directory listing, or of small files, that are passed on at a time.
LISTED_ROWS = 2_000


def _list_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files of each archive from its directory, in chunks of about equal size."""
    columns, kinds = ["path", "chunk", "member", "entry", "problem"], {"chunk": "Int32", "member": "Int32"}
    for batch in batches:
        rows = []
        for path in batch["path"]:
            try:
                store, inner = open_store(path)
                with store.open_input_file(inner) as source, opened(source) as archive:
                    infos = archive.infolist()
            except zipfile.BadZipFile:
                rows.append((path, 0, None, None, "bad_archive"))
                infos = []
            last = {safe_name(info.filename): i for i, info in enumerate(infos) if not info.is_dir()}
            size = 0
            for entry, i in last.items():
                rows.append((path, size // CHUNK_BYTES, i, entry, None))
                size += infos[i].file_size
            if len(rows) >= LISTED_ROWS:
                yield pd.DataFrame(rows, columns=columns).astype(kinds)
                rows = []
        yield pd.DataFrame(rows, columns=columns).astype(kinds)


def _contents(path: str, archive: zipfile.ZipFile, members: Iterator[tuple[str, zipfile.ZipInfo]]) -> Iterator[tuple]:
    for entry, info in members:
        try:
            yield path, entry, info.file_size, archive.read(info), None
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError):
            yield path, entry, info.file_size, None, "bad_entry"


def _in_batches(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Rows of files in batches of about ``BATCH_BYTES``."""
    columns, held, size = ["path", "entry", "n", "content", "problem"], [], 0
    for row in rows:
        held.append(row)
        size += row[2] or 0
        if size > BATCH_BYTES or len(held) >= LISTED_ROWS:
            yield pd.DataFrame(held, columns=columns).astype({"n": "Int64"})
            held, size = [], 0
    yield pd.DataFrame(held, columns=columns).astype({"n": "Int64"})


def _read_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Content of the listed files; an archive is opened once per run of its rows."""

    def rows(batch: pd.DataFrame) -> Iterator[tuple]:
        by_path: dict[str, list] = {}
        for path, member, entry, problem in zip(batch["path"], batch["member"], batch["entry"], batch["problem"]):
            if problem is not None:
                yield path, None, None, None, problem
            else:
                by_path.setdefault(path, []).append((entry, int(member)))
        for path, members in by_path.items():
            store, inner = open_store(path)
            with store.open_input_file(inner) as source, opened(source) as archive:
                infos = archive.infolist()
                yield from _contents(path, archive, ((entry, infos[i]) for entry, i in members))

    for batch in batches:
        yield from _in_batches(rows(batch))


def _read_small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files of small archives, each opened once for its directory and its files."""

    def rows(paths: pd.Series) -> Iterator[tuple]:
        for path in paths:
            store, inner = open_store(path)
            with store.open_input_file(inner) as source:
                try:
                    archive = opened(source)
                except zipfile.BadZipFile:
                    yield path, None, None, None, "bad_archive"
                    continue
                with archive:
                    last = {safe_name(info.filename): info for info in archive.infolist() if not info.is_dir()}
                    yield from _contents(path, archive, last.items())

    for batch in batches:
        yield from _in_batches(rows(batch["path"]))


def read_archives(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Every zip below ``folder/owner/`` as file rows ``full_name, path, n, content, problem``.

    First the directories of larger archives are read, then their files in chunks, so
    that one big archive is unpacked by many tasks. These are opened in place and never
    held as a whole; archives below ``SMALL_BYTES`` are opened once and read at once.
    """
    archives = (
        list_files(spark, folder)
        .filter(F.col("file").endswith(".zip"))
        .select(F.concat_ws("/", "dir", "file").alias("path"), (F.col("length") < SMALL_BYTES).alias("small"))
    )
    tasks = task_count(spark)
    archives = archives.repartition(tasks, "path")
    small = archives.filter("small").select("path").mapInPandas(_read_small, FILE_SCHEMA)
    members = archives.filter("not small").select("path").mapInPandas(_list_members, MEMBER_SCHEMA)
    files = members.repartition(tasks, "path", "chunk").mapInPandas(_read_members, FILE_SCHEMA)
    named = files.unionByName(small).withColumn("full_name", F.regexp_extract("path", "([^/]+/[^/]+)[.]zip$", 1))
    return named.select(
        "full_name",
        F.concat_ws("/", extraction_folder(F.lit(out), "full_name"), "entry").alias("path"),
        "n",
        "content",
        "problem",
    )
