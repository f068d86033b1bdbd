"""Crawls that go on when pages, links or seeds arrive later.

A store keeps the links, the pages at hand, the seeds and what each crawl has seen, one
folder per run. A run looks at what is new: links from seen nodes, links that waited for a
page that has come, new seeds. What these reach, or reach on a shorter way, is followed
through all links until nothing changes. Depths only get smaller, so a page that fell to a
page limit in an earlier run stays behind the pages that were before it, and the rows after
several runs are those of one crawl over everything.

A run that broke off is written again under the same number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.operators.crawl import allowed_edges, counted_starts, edge_limit, follow, may_go_deeper, own_cap, own_limits
from gleanwork.operators.skew import ROWS_PER_TASK, key_load, split_join
from gleanwork.session import stage, staged_metrics
from gleanwork.sinks.runs import Runs, State

_LINKS = ["src", "dst", "host"]
_START = ["seed", "domain", "node", "depth", "_deep", "_most"]


class CrawlStore:
    """Crawls stored below ``path``, a folder that all executors reach.

    With ``pages_needed`` a link counts once the page it leads to is at hand. Node columns
    are of one type throughout, addresses or numbers.
    """

    def __init__(self, spark: SparkSession, path: str, pages_needed: bool = False, include_seed: bool = True):
        self._spark, self._runs = spark, Runs(spark, path, ["links", "pages", "seeds"])
        self._pages_needed, self._include_seed = pages_needed, include_seed

    def last_run(self) -> int:
        """Number of the last run that was committed, 0 before the first."""
        return self._runs.state().number

    def found(self) -> DataFrame | None:
        """``seed, node, depth`` after the last run, None before the first."""
        run = self.last_run()
        return None if not run else self._runs.of_run("seen", run).select("seed", "node", "depth")

    def _added(self, new: DataFrame | None, name: str, on: list[str], last: State, now: State) -> tuple[DataFrame | None, DataFrame | None]:
        """Rows of ``new`` that the store lacks, now in it, and all rows; of equal keys any one counts."""
        before = self._runs.stored(name, last) if name in last.tables else None
        if new is None:
            return None, before
        fresh = new.dropDuplicates(on)
        if before is not None:
            fresh = fresh.join(before.select(*on), on, "left_anti").select(new.columns)
        fresh = self._runs.put(fresh, name, now.number)
        now.tables.add(name)
        return fresh, fresh if before is None else before.select(new.columns).unionByName(fresh)

    def _live(self, links: DataFrame | None, pages: DataFrame | None) -> DataFrame | None:
        if links is None or not self._pages_needed:
            return links
        if pages is None:
            return links.filter(F.lit(False))
        known = pages.select(F.col("node").alias("dst"))
        return split_join(links, known, ["dst"], ["src"], key_load(links, ["dst"]), "left_semi")

    def update(
        self,
        links: DataFrame | None = None,
        pages: DataFrame | None = None,
        seeds: DataFrame | None = None,
        depth: int | None = 3,
        max_pages: int | None = 100,
        rows_per_task: int = ROWS_PER_TASK,
    ) -> DataFrame:
        """Take in ``links(src, dst, host)``, ``pages(node)`` and ``seeds(seed, domain, node)``; all found then.

        Limits are those of ``crawl`` and hold for the seeds given here. Links, pages and
        seeds that are known already change nothing.
        """
        last = self._runs.state()
        now = State(last.number + 1, last.base, set(last.tables))
        run = now.number
        new_links, all_links = self._added(None if links is None else links.select(*_LINKS), "links", ["src", "dst"], last, now)
        new_pages, all_pages = self._added(None if pages is None else pages.select("node"), "pages", ["node"], last, now)
        if seeds is not None:
            seeds = own_limits(seeds, depth, max_pages)
        new_start, all_start = self._added(seeds, "seeds", ["seed"], last, now)
        if all_start is None:
            raise ValueError("the first run needs seeds")
        start = counted_starts(all_start)
        most, highest = edge_limit(start), staged_metrics(start)["most"]
        schema = start.schema
        before = None if run == 1 else self._runs.of_run("seen", run - 1).select(*_START)

        def edges(rows: DataFrame | None, label: str) -> DataFrame | None:
            return None if rows is None else stage(allowed_edges(rows, start, most, rows_per_task), label)

        everything = edges(self._live(all_links, all_pages), "edges")
        # new ways: from what was seen over new links, from new seeds over all links
        fresh = [self._live(new_links, all_pages)]
        if self._pages_needed and new_pages is not None and run > 1:
            fresh.append(self._live(self._runs.stored("links", last), new_pages) if "links" in last.tables else None)
        fresh = [x for x in fresh if x is not None]
        ways = []
        if fresh and run > 1:
            # a known start, and every seen node above its crawl's limit of depth
            old = self._runs.stored("seeds", last).select(*_START).unionByName(before).distinct()
            ways.append(follow(old.filter(may_go_deeper(F.col("depth"))), edges(reduce(DataFrame.unionByName, fresh), "new_edges"), rows_per_task))
        if new_start is not None and everything is not None:
            ways.append(follow(new_start.select(*_START).filter(may_go_deeper(0)), everything, rows_per_task))
        seen = before if before is not None else self._spark.createDataFrame([], schema)
        if new_start is not None and self._include_seed:
            seen = seen.unionByName(new_start.select(*_START))
        changes = reduce(DataFrame.unionByName, ways) if ways else None
        hubs = None if most is not None or everything is None else key_load(everything, ["node", "domain"], rows_per_task)
        seen, n_open = self._merged(seen, changes, highest)
        while n_open:
            frontier = seen.filter("_new").filter(may_go_deeper(F.col("depth"))).select(*_START)
            seen, n_open = self._merged(seen.select(*_START), follow(frontier, everything, rows_per_task, n_open, hubs), highest)
        self._runs.put(seen.select(*_START), "seen", run)
        self._runs.commit(now)
        return self.found()

    def _merged(self, seen: DataFrame, changes: DataFrame | None, highest: int | None) -> tuple[DataFrame, int]:
        """What is seen with the smaller depths, ``_new`` where that is a change, and how many of these lead on."""
        rows = seen.withColumn("_before", F.col("depth"))
        if changes is not None:
            rows = rows.unionByName(changes.withColumn("_before", F.lit(None).cast("int")))
        keys = ["seed", "domain", "node", "_deep", "_most"]
        rows = rows.groupBy(*keys).agg(F.min("depth").alias("depth"), F.min("_before").alias("_before"))
        rows = own_cap(rows, highest)
        rows = rows.select(*_START, (F.col("_before").isNull() | (F.col("depth") < F.col("_before"))).alias("_new"))
        out = stage(rows, "seen", open=F.count_if(F.col("_new") & may_go_deeper(F.col("depth"))))
        return out, staged_metrics(out)["open"]
