"""Bounded crawl over a link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.functions.urls import host_domains
from gleanwork.operators.skew import ROWS_PER_TASK, KeyLoad, join_counted, key_load, split_join
from gleanwork.session import stage, staged_metrics


def page_cap(
    found: DataFrame, max_pages: int, group: list[str] | None = None, order: list[str] | None = None
) -> DataFrame:
    """At most ``max_pages`` rows per seed, the shallowest first.

    The limit is applied in each task before the shuffle, so a hot seed sends no
    more than ``max_pages`` rows per task.
    """
    window = Window.partitionBy(*(group or ["seed"])).orderBy(*(order or ["depth", "node"]))
    return (
        found.withColumn("_place", F.row_number().over(window))
        .filter(F.col("_place") <= max_pages)
        .drop("_place")
    )


def allowed_edges(
    links: DataFrame, seeds: DataFrame, max_pages: int | None, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Edges ``node, domain, dst`` for the domains that some of the staged seeds may visit.

    Each edge is listed under its host and the parent domains of it, which turns
    the domain rule into a join key. With a page limit a crawl that has seen fewer
    than ``max_pages`` nodes can use no more than the first ``2 * max_pages`` edges
    of a page, so hub pages are cut to that before they are joined.
    """
    by_domain = (
        join_counted(
            links.withColumn("domain", F.explode(host_domains("host"))),
            seeds.select("domain").distinct(),
            staged_metrics(seeds)["rows"],
            ["domain"],
            ["src", "dst"],
            "left_semi",
            rows_per_task,
        )
        .select(F.col("src").alias("node"), "domain", "dst")
        .distinct()
    )
    if max_pages is None:
        return by_domain
    return page_cap(by_domain, 2 * max_pages, ["node", "domain"], ["dst"])


def own_limits(seeds: DataFrame, depth: int | None, max_pages: int | None) -> DataFrame:
    """``seed, domain, node, depth, _deep, _most``: seeds with the limits of their crawl.

    The arguments fill in where a seed names no limit; null means none at all.
    """

    def limit(name: str, default: int | None) -> Column:
        own = F.col(name) if name in seeds.columns else F.lit(None)
        return F.coalesce(own.cast("int"), F.lit(default).cast("int"))

    return seeds.select(
        "seed",
        "domain",
        "node",
        F.lit(0).alias("depth"),
        limit("max_depth", depth).alias("_deep"),
        limit("max_pages", max_pages).alias("_most"),
    )


def counted_starts(rows: DataFrame) -> DataFrame:
    """Rows of ``own_limits`` as a staged table with figures of their limits."""
    return stage(
        rows,
        "seeds",
        most=F.max("_most"),
        free=F.count_if(F.col("_most").isNull()),
        open=F.count_if(may_go_deeper(0)),
    )


def edge_limit(start: DataFrame) -> int | None:
    """The page limit that holds for all crawls, None if one has no limit."""
    metrics = staged_metrics(start)
    return None if metrics["free"] or metrics["most"] is None else max(metrics["most"], 0)


def may_go_deeper(level: Column | int) -> Column:
    return F.coalesce(F.col("_deep") > level, F.lit(True))


def follow(
    frontier: DataFrame,
    edges: DataFrame,
    rows_per_task: int = ROWS_PER_TASK,
    at_most: int | None = None,
    hubs: KeyLoad | None = None,
) -> DataFrame:
    """The nodes one level below ``frontier``, as rows of the same columns."""
    keys = ["node", "domain"]
    load = key_load(frontier, keys, rows_per_task, at_most=at_most)
    joined = split_join(frontier, edges, keys, ["seed"], load, right_spread=["dst"], right_load=hubs)
    return joined.select("seed", "domain", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"), "_deep", "_most")


def crawl(
    links: DataFrame,
    seeds: DataFrame,
    depth: int | None = 3,
    max_pages: int | None = 100,
    include_seed: bool = True,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Pages found from each seed: ``seed, node, depth``.

    ``links(src, dst, host)`` where host is the one of ``dst``; ``seeds(seed, domain,
    node)`` plus, if crawls differ, ``max_depth`` and ``max_pages``. The arguments hold for
    seeds that name no limit of their own. One round per level: join the newest nodes to
    the edges, merge with what was seen, apply the limit. A node deeper down never displaces
    a shallower one, so limiting each round gives the same rows as limiting the end result.
    """
    start = counted_starts(own_limits(seeds, depth, max_pages))
    most = edge_limit(start)
    edges = stage(allowed_edges(links, start, most, rows_per_task), "edges")
    # with a limit no page keeps more than 2 * max_pages edges; without one hubs are hot as well
    hubs = None if most is not None else key_load(edges, ["node", "domain"], rows_per_task)
    seen = own_cap(start if include_seed else start.filter(F.lit(False)), staged_metrics(start)["most"])
    frontier, newest, level = start.filter(may_go_deeper(0)), staged_metrics(start)["open"], 0
    while newest:
        level += 1
        merged = seen.unionByName(follow(frontier, edges, rows_per_task, newest, hubs))
        if most is not None and 2 * most * most <= rows_per_task:
            # a round of a limited crawl is small, so one shuffle by seed serves both steps below
            merged = merged.repartition("seed")
        merged = merged.groupBy("seed", "domain", "node", "_deep", "_most").agg(F.min("depth").alias("depth"))
        merged = own_cap(merged, staged_metrics(start)["most"])
        # the newest nodes whose crawl may go a level deeper
        is_open = (F.col("depth") == level) & may_go_deeper(level)
        seen = stage(merged.select(start.columns), "seen", newest=F.count_if(is_open))
        newest = staged_metrics(seen)["newest"]
        frontier = seen.filter(is_open)
    return seen.select("seed", "node", "depth")


def own_cap(found: DataFrame, highest: int | None) -> DataFrame:
    """Rows within the page limit of their seed, by depth and node; ``highest`` is the largest limit.

    Seeds without a limit stay out of the sort, as one of them may have a third of all rows.
    """
    if highest is None:
        return found
    window = Window.partitionBy("seed").orderBy("depth", "node")
    limited = (
        found.filter(F.col("_most").isNotNull())
        .withColumn("_place", F.row_number().over(window))
        .filter((F.col("_place") <= max(highest, 0)) & (F.col("_place") <= F.col("_most")))
        .drop("_place")
    )
    return limited.unionByName(found.filter(F.col("_most").isNull()))


def accumulate(before: DataFrame, crawled: DataFrame, max_pages: int) -> DataFrame:
    """Set union of pages found earlier and now, up to the limit: ``seed, node``.

    Earlier pages count against the limit and always stay. ``crawled`` must come
    from a crawl with the same limit: its first ``max_pages`` rows hold all that
    can still be added.
    """
    before = before.select("seed", "node").distinct()
    used = before.groupBy("seed").agg(F.count(F.lit(1)).alias("_used"))
    new = crawled.join(before, ["seed", "node"], "left_anti")
    window = Window.partitionBy("seed").orderBy("depth", "node")
    added = (
        new.withColumn("_place", F.row_number().over(window))
        .filter(F.col("_place") <= max_pages)
        .join(used, "seed", "left")
        .filter(F.col("_place") + F.coalesce("_used", F.lit(0)) <= max_pages)
        .select("seed", "node")
    )
    return before.unionByName(added)


def distinct_urls(found: DataFrame, group: str = "seed", url: str = "url") -> DataFrame:
    """Each address once per group, exact string equality."""
    return found.select(group, url).distinct()
