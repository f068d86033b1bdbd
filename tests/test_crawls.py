"""Crawls with limits of their own, and crawls in several runs, against plain search."""

import random

import pytest

from gleanwork.operators.crawl import crawl
from gleanwork.operators.resume import CrawlStore
from gleanwork.session import fresh_path

SEEDS = "seed int, domain string, node int, max_depth int, max_pages int"
LINKS = "src int, dst int, host string"


def graph(n, rng):
    hosts = [f"{'a.' if i % 3 else ''}{'xy'[i % 2]}.org" for i in range(n)]
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(3 * n)} | {(i, i % 4) for i in range(n)} | {(1, i) for i in range(0, n, 2)}
    return [(a, b, hosts[b]) for a, b in sorted(pairs)]


def searched(links, seeds, depth, max_pages, include_seed=True):
    out = set()
    for seed, domain, node, own_depth, own_pages in seeds:
        deep = own_depth if own_depth is not None else depth
        most = own_pages if own_pages is not None else max_pages
        seen, level, at = ({node: 0} if include_seed else {}), 0, {node}
        while at and (deep is None or level < deep):
            level += 1
            at = {b for a, b, host in links if a in at and (host == domain or host.endswith("." + domain))} - set(seen)
            seen |= {b: level for b in at}
        kept = sorted((d, v) for v, d in seen.items())
        out |= {(seed, v, d) for d, v in (kept if most is None else kept[: max(most, 0)])}
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("seed", "node", "depth").collect())


def own_seeds(rng, n, k):
    limits = [None, 0, 1, 3, 40]
    return [(s, rng.choice(["x.org", "y.org", "a.x.org"]), rng.randrange(n), rng.choice([None, 0, 1, 2, 5]), rng.choice(limits)) for s in range(k)]


@pytest.mark.parametrize("depth,max_pages,include", [(3, 5, True), (2, None, True), (1, 7, False), (None, 30, True), (2, 0, True)])
def test_own_limits(spark, depth, max_pages, include):
    rng = random.Random(7)
    links, seeds = graph(40, rng), own_seeds(rng, 40, 25)
    got = crawl(spark.createDataFrame(links, LINKS), spark.createDataFrame(seeds, SEEDS), depth, max_pages, include)
    assert rows(got) == searched(links, seeds, depth, max_pages, include)


@pytest.mark.parametrize("seed,max_pages,include", [(1, 6, True), (2, None, True), (3, 9, False)])
def test_runs_add_up_to_one_crawl(spark, seed, max_pages, include):
    rng = random.Random(seed)
    links, seeds = graph(40, rng), own_seeds(rng, 40, 20)
    store = CrawlStore(spark, fresh_path(spark, "crawls"), include_seed=include)
    assert store.found() is None
    part = {link: rng.randrange(3) for link in links}
    begins = {s: rng.randrange(3) if s[0] else 0 for s in seeds}
    for run in range(3):
        now = [x for x in links if part[x] == run] + rng.sample(links, 5 if run == 2 else 0)
        some = [s for s in seeds if begins[s] == run]
        store.update(spark.createDataFrame(now, LINKS), None, spark.createDataFrame(some, SEEDS), 3, max_pages)
        known = [x for x in links if part[x] <= run or x in now]
        assert rows(store.found()) == searched(known, [s for s in seeds if begins[s] <= run], 3, max_pages, include)


def test_links_wait_for_their_pages(spark):
    rng = random.Random(4)
    links, seeds = graph(30, rng), own_seeds(rng, 30, 12)
    store = CrawlStore(spark, fresh_path(spark, "crawls"), pages_needed=True)
    spread = rng.sample(range(30), 30)
    store.update(spark.createDataFrame(links, LINKS), None, spark.createDataFrame(seeds, SEEDS))
    for part in (spread[:12], spread[8:25], spread[25:], spread):
        store.update(pages=spark.createDataFrame([(v,) for v in part], "node int"))
        known = set(spread[: spread.index(part[-1]) + 1])
        assert rows(store.found()) == searched([x for x in links if x[1] in known], seeds, 3, 100)


def test_a_broken_run_is_written_again(spark):
    rng = random.Random(5)
    links, seeds = graph(20, rng), own_seeds(rng, 20, 8)
    path = fresh_path(spark, "crawls")
    store = CrawlStore(spark, path)
    store.update(spark.createDataFrame(links[::2], LINKS), None, spark.createDataFrame(seeds, SEEDS))
    # links of a run that never got to its commit
    spark.createDataFrame(links, LINKS).write.parquet(f"{path}/links/run=2")
    assert store.last_run() == 1
    store.update(spark.createDataFrame(links, LINKS))
    assert rows(store.found()) == searched(links, seeds, 3, 100)
