"""File listings: walked folders, remote trees, and the choice between sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.operators.skew import ROWS_PER_TASK, join_counted, key_load, split_join
from gleanwork.session import stage, staged_metrics
from gleanwork.sources.archives import read_archives

# The entry types that are handled.
ENTRY_TYPES = ["file", "dir"]


def handled_entry(entry_type: str) -> Column:
    return F.col(entry_type).isin(*ENTRY_TYPES)


def list_tree(entries: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Files of a remote tree with their full path.

    ``entries(full_name, id, parent, name, type)``; top entries have no parent.
    Folder paths are built level by level, one join each over the folders alone;
    then the files, the bulk of a tree, join once. Other entry types are passed
    over, and a folder without listed children just ends there.
    """
    keys = ["full_name", "parent"]
    entries = entries.filter(handled_entry("type"))
    folders = entries.filter("type = 'dir'")
    files = entries.filter("type = 'file'")
    below = folders.filter(F.col("parent").isNotNull())
    level = stage(
        folders.filter(F.col("parent").isNull()).select("full_name", F.col("id").alias("parent"), F.col("name").alias("_above")),
        "folders",
    )
    paths, n_paths = level, 0
    while n_level := staged_metrics(level)["rows"]:
        n_paths += n_level
        level = stage(
            join_counted(below, level, n_level, keys, ["id"], rows_per_task=rows_per_task).select(
                "full_name", F.col("id").alias("parent"), F.concat_ws("/", "_above", "name").alias("_above")
            ),
            "folders",
        )
        paths = paths.unionByName(level)
    inside = files.filter(F.col("parent").isNotNull())
    listed = join_counted(inside, paths, n_paths, keys, ["id"], rows_per_task=rows_per_task).select(
        "full_name", "id", F.concat_ws("/", "_above", "name").alias("path")
    )
    top = files.filter(F.col("parent").isNull()).select("full_name", "id", F.col("name").alias("path"))
    return listed.unionByName(top)


def _jumps(rows: DataFrame, max_rounds: int, rows_per_task: int) -> DataFrame:
    """Join paths with themselves until they reach the top: ``full_name, id, up`` and, if ``rows`` has it, ``path``.

    ``up`` is the folder above what ``path`` covers, null at the top; a round doubles the
    length of all paths. Folders below one that is not listed are dropped. What is open after
    ``max_rounds`` keeps its ``up``.
    """
    keys = ["full_name", "up"]
    is_open = F.col("up").isNotNull()
    named = "path" in rows.columns
    rows = stage(rows, "jumps", open=F.count_if(is_open))
    done = rows.filter(~is_open)
    for _ in range(max_rounds):
        if not staged_metrics(rows)["open"]:
            break
        waiting = rows.filter(is_open)
        every = done.unionByName(waiting)
        # written paths are far smaller than in memory, so their size must not make them a broadcast
        above = every.select("full_name", F.col("id").alias("up"), F.col("up").alias("_up"), *([F.col("path").alias("_path")] if named else [])).hint("merge")
        # a folder with very many below it is a hot key
        met = split_join(waiting, above, keys, ["id"], key_load(waiting, keys, rows_per_task))
        longer = met.select("full_name", "id", F.col("_up").alias("up"), *([F.concat_ws("/", "_path", "path").alias("path")] if named else []))
        rows = stage(longer, "jumps", open=F.count_if(is_open))
        # what has reached the top is not written again
        done = done.unionByName(rows.filter(~is_open))
    return done.unionByName(rows.filter(is_open))


def folder_paths(folders: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``full_name, id, path`` of ``folders(full_name, id, parent, name)``, however deep they lie.

    Depth d costs about log d rounds. Folders that lead to no top folder, below one that is
    missing or in a circle, have no path. Circles are found first, without the names, as
    paths would double in them; a circle is what is open when every depth that the number of
    folders allows has been reached. A path without names would double too, in its slashes.
    """
    bare = stage(folders.select("full_name", "id", F.col("parent").alias("up"), "name"), "folders")
    rounds = staged_metrics(bare)["rows"].bit_length() + 1
    reached = _jumps(bare.drop("name"), rounds, rows_per_task)
    whole = reached.filter(F.col("up").isNull()).select("full_name", "id")
    named = bare.join(whole, ["full_name", "id"], "left_semi").select("full_name", "id", "up", F.col("name").alias("path"))
    return _jumps(named, rounds, rows_per_task).select("full_name", "id", "path")


def list_deep_tree(entries: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Like ``list_tree``, for trees of many levels: few rounds over all folders in place of one per level."""
    entries = entries.filter(handled_entry("type"))
    paths = folder_paths(entries.filter("type = 'dir'"), rows_per_task).select("full_name", F.col("id").alias("parent"), F.col("path").alias("_above"))
    # long paths that are written small: never a broadcast
    paths = paths.hint("merge")
    files = entries.filter("type = 'file'")
    inside, keys = files.filter(F.col("parent").isNotNull()), ["full_name", "parent"]
    listed = split_join(inside, paths, keys, ["id"], key_load(inside, keys, rows_per_task))
    listed = listed.select("full_name", "id", F.concat_ws("/", "_above", "name").alias("path"))
    top = files.filter(F.col("parent").isNull()).select("full_name", "id", F.col("name").alias("path"))
    return listed.unionByName(top)


def read_repositories(
    spark: SparkSession, mode: str, out: str, folder: str | None = None, entries: DataFrame | None = None
) -> DataFrame:
    """Files of repositories, from unpacked archives (``zip``) or listed trees (``api``).

    Both give ``full_name, path`` with the path below the output folder.
    """
    if mode == "zip":
        if folder is None:
            raise ValueError("the zip source needs a folder of archives")
        return read_archives(spark, folder, out).filter("problem is null").select("full_name", "path")
    if mode == "api":
        if entries is None:
            raise ValueError("the api source needs tree entries")
        return list_tree(entries).select(
            "full_name", F.concat_ws("/", F.lit(out), "full_name", "path").alias("path")
        )
    raise ValueError(f"unknown source {mode!r}")
