"""Files opened and folders listed inside tasks."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.session import stage, staged_metrics, task_count

# Entries of a folder that are passed on at a time.
LISTING_SLICE = 10_000
LISTING_SCHEMA = "dir string, file string, is_dir boolean, length bigint"


def open_store(path: str):
    """File system of a path and the path inside it; local when no scheme is given."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    scheme, found, rest = path.partition("://")
    if not found:
        return LocalFileSystem(), path.removeprefix("file:")
    if scheme == "file":
        return LocalFileSystem(), rest
    authority, _, inner = rest.partition("/")
    store, base = FileSystem.from_uri(f"{scheme}://{authority}/")
    return store, f"{base.rstrip('/')}/{inner}"


def folder_entries(folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """Name, whether it is a folder, length and modification time in ns of a folder's entries.

    Links to folders are left out, as a link to a folder above would never end.
    """
    from pyarrow.fs import FileSelector, FileType, LocalFileSystem

    store, inner = open_store(folder)
    if isinstance(store, LocalFileSystem):
        with os.scandir(inner) as entries:
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.name, True, 0, 0
                elif not entry.is_dir():
                    # a link that leads nowhere has the length of the link
                    stat = entry.stat(follow_symlinks=os.path.exists(entry.path))
                    yield entry.name, False, stat.st_size, stat.st_mtime_ns
        return
    for info in store.get_file_info(FileSelector(inner)):
        yield info.base_name, info.type == FileType.Directory, info.size or 0, info.mtime_ns or 0


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for folder in batch["dir"]:
            entries = folder_entries(folder)
            while rows := list(itertools.islice(entries, LISTING_SLICE)):
                yield pd.DataFrame([(folder, *row[:3]) for row in rows], columns=["dir", "file", "is_dir", "length"])


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below ``folder`` as ``dir, file, length``, folder levels in turn.

    Spark's file sources leave out empty files and names that start with ``_`` or
    ``.``, which source code is full of, so the folders are listed in tasks.
    """
    level = spark.createDataFrame([(folder.rstrip("/"),)], "dir string")
    files = None
    while True:
        entries = stage(
            level.repartition(task_count(spark), "dir").mapInPandas(_list_folders, LISTING_SCHEMA), "listing", folders=F.count_if("is_dir")
        )
        found = entries.filter(~F.col("is_dir")).drop("is_dir")
        files = found if files is None else files.unionByName(found)
        level = entries.filter("is_dir").select(F.concat_ws("/", "dir", "file").alias("dir"))
        if staged_metrics(entries)["folders"] == 0:
            return files
