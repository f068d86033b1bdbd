"""Near-duplicate documents by a chosen-path similarity join.

A document is the set of its five-word shingles. Several independent trees start with all
sets; a node sends a set to one child per branch, named by the set's smallest token under a
hash function that the node's path chooses. Two sets of similarity s share a child with
probability s per branch, so similar sets stay together while others part. Nodes with few
sets outside their largest known group are compared exhaustively; larger ones are compared
with one member and branch again. Every link is confirmed on full sets.

Only sets that no known link joins are compared. The comparison runs in blocks of a node's
sets, the most promising pairs first, stops between two groups once it has joined them, and
returns links alone, so no table ever holds the pairs of a node.

A pair at similarity 0.75 shares none of the ``TREES`` times ``ROOT_BRANCHES`` first children
with probability 6e-8, and is passed over by the short signature with one below 2e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.llm.common import packed, staged, unpacked
from gleanwork.llm.components import components, joined
from gleanwork.llm.hashing import WordHashes, mixed, multipliers, shingles
from gleanwork.session import staged_metrics, task_count

SHINGLE = 5
SIMILAR = 75  # hundredths
FUNCTIONS = 64
TREES = 4
ROOT_BRANCHES = 3
BRANCHES = 2
ROUNDS = 8
# Sets outside a node's largest group up to which all its pairs are compared, in the first
# round, where every set is a group of its own, and later.
FEW_FIRST, FEW = 8, 512
BLOCK = 1024
SET_BLOCK = 256  # where full sets are compared
# Of 64 functions, sets at 0.75 agree on 48 on average; fewer than 31 have probability below 2e-6.
AGREE = 31


def _set_rows(batches: Iterator, keep_set: bool) -> Iterator:
    """Per row: id, set size, digest of the set, its smallest values or the set itself, and
    the last byte of each value."""
    table = WordHashes(fold=bytes.lower)
    masks = mixed(multipliers(FUNCTIONS, 11))[:, None]
    factors = multipliers(FUNCTIONS, 12)[:, None]
    for batch in batches:
        out = {"doc_id": batch.column(0), "n": [], "digest": [], "data": [], "brief": []}
        for text in batch.column(1):
            found = shingles(table.of((text.as_py() or "").encode("utf-8", "surrogatepass").split()), SHINGLE)
            out["n"].append(len(found))
            out["digest"].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            brief = b""
            if keep_set:
                out["data"].append(found.tobytes())
            elif len(found):
                least = np.full(FUNCTIONS, 0xFFFFFFFF, dtype=np.uint64)
                for at in range(0, len(found), 1024):
                    values = (found[None, at : at + 1024] ^ masks) * factors
                    least = np.minimum(least, values.min(axis=1) >> np.uint64(32))
                out["data"].append(least.astype(">u4").tobytes())
                brief = least.astype("u1").tobytes()
            else:
                out["data"].append(b"")
            out["brief"].append(brief)
        kinds = [batch.schema.field(0).type, pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) if isinstance(v, list) else v for v, t in zip(out.values(), kinds)], list(out))


def _sets(docs: DataFrame, keep_set: bool) -> DataFrame:
    def rows(batches):
        yield from _set_rows(batches, keep_set)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, digest binary, data binary, brief binary"
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


@F.pandas_udf(T.IntegerType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = (np.frombuffer(b"".join(s), dtype="u1").reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).sum(axis=1).astype("int32"))


def _is_similar(p: np.ndarray, q: np.ndarray) -> bool:
    """Of two sorted sets, neither empty."""
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    both = np.count_nonzero(q[at] == p)
    return 100 * both >= SIMILAR * (len(p) + len(q) - both)


@F.pandas_udf(T.BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    sets = ((np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) for x, y in zip(a, b))
    return pd.Series([_is_similar(p, q) for p, q in sets], dtype=bool)


def _value(function: Column) -> Column:
    """The set's smallest value under a hash function."""
    return F.substring(F.col("data"), function * 4 + 1, F.lit(4))


def _children(rows: DataFrame, ways: list[Column]) -> DataFrame:
    return rows.select(F.explode(F.array(*ways)).alias("node"), "v")


def _confirmed(docs: DataFrame, reps: DataFrame, pairs: DataFrame, before: list[DataFrame]) -> DataFrame:
    """Links ``a, b`` among candidate pairs: first by size and agreement, then on full sets.

    Pairs in ``before`` have been looked at in earlier rounds; new ones are added to it.
    """
    if before:
        pairs = pairs.join(reduce(DataFrame.union, before), ["a", "b"], "left_anti")
    for side in ("a", "b"):
        theirs = reps.select(F.col("v").alias(side), F.col("n").alias(f"n_{side}"), F.col("brief").alias(f"brief_{side}"))
        pairs = pairs.join(theirs, side)
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * SIMILAR
    likely = pairs.filter(sizes).filter(_agreement("brief_a", "brief_b") >= AGREE)
    likely = staged(likely.select("a", "b").distinct(), "likely")
    before.append(likely)
    if not staged_metrics(likely)["rows"]:
        return likely
    wanted = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    full = staged(_sets(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), True), "sets")
    for side in ("a", "b"):
        likely = likely.join(full.select(F.col("doc_id").alias(side), F.col("data").alias(f"set_{side}")), side)
    return staged(likely.filter(_similar("set_a", "set_b")).select("a", "b").distinct(), "confirmed")


def _grouped(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    c = F.col("v") if labels is None else F.coalesce("c", "v")
    rows = members if labels is None else members.join(labels, "v", "left")
    return rows.select("node", "v", c.alias("c"))


def _open(members: DataFrame, labels: DataFrame | None, few: int, first: bool) -> tuple[DataFrame, dict]:
    """Members of the nodes that hold more than one known group, with figures of the node."""
    rows = _grouped(members, labels)
    groups = rows.groupBy("node", "c").agg(F.count(F.lit(1)).alias("k"), F.min("v").alias("least"), F.min_by("v", F.xxhash64("v", "node")).alias("any"))
    nodes = groups.groupBy("node").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("k").alias("size"),
        (F.sum("k") - F.max("k")).alias("outside"),
        F.max(F.struct("k", "c"))["c"].alias("top"),
        (F.min("least") if first else F.min_by("any", F.xxhash64("any", "node"))).alias("pivot"),
    )
    nodes = staged(nodes.filter("groups > 1").drop("groups"), "nodes", large=F.sum((F.col("outside") > few).cast("bigint")))
    return staged(rows.join(nodes, "node"), "open"), staged_metrics(nodes)


def _star(large: DataFrame) -> DataFrame:
    """Each member of a large node with its pivot."""
    star = large.filter("v <> pivot").select(F.col("pivot").alias("x"), F.col("v").alias("y"))
    return star.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _few_pairs(small: DataFrame) -> DataFrame:
    """All pairs in nodes of at most ``FEW_FIRST`` sets and one."""
    theirs = small.select("node", F.col("v").alias("b"))
    return small.select("node", F.col("v").alias("a")).join(theirs, "node").filter("a < b").select("a", "b")


def _grid(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members of nodes, cut into a grid of blocks of about ``block`` rows: each meets the sets outside the node's largest group.

    ``out`` rows are those outside, placed in a row of the grid; the others fill its columns.
    """
    cuts = {"o": F.ceil(F.col("outside") / block).cast("int"), "m": F.ceil(F.col("size") / block).cast("int")}
    place = lambda side: F.pmod(F.xxhash64("v"), cuts[side]).cast("int").alias(side)
    every = lambda side: F.explode(F.sequence(F.lit(0), cuts[side] - 1)).alias(side)
    kept = [c for c in rows.columns if c not in ("size", "outside", "top", "pivot")]
    members = rows.select(*kept, F.lit(False).alias("out"), place("m"), every("o"))
    outside = rows.filter("c <> top").select(*kept, F.lit(True).alias("out"), every("m"), place("o"))
    # the cost of a block does not show in its size, so tasks are not to be packed by size
    return members.unionByName(outside).repartition(task_count(rows.sparkSession), "node", "o", "m")


class _Block:
    """The sets of one block, and for each outside one the others that agree with it enough."""

    def __init__(self, rows: pa.Table):
        self._out = rows["out"].to_numpy()
        self._n = rows["n"].to_numpy()
        self._brief = np.frombuffer(b"".join(rows["brief"].to_pylist()), dtype="u1").reshape(len(self._out), -1)
        self.ids = rows["v"].combine_chunks()
        self.group = pd.factorize(rows["c"].to_pandas())[0]

    def likely(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each outside set with its likely partners of other groups and how far they agree."""
        right = np.flatnonzero(~self._out)
        for x in np.flatnonzero(self._out):
            sizes = 100 * np.minimum(self._n[x], self._n[right]) >= SIMILAR * np.maximum(self._n[x], self._n[right])
            near = right[sizes & (self.group[right] != self.group[x])]
            agree = (self._brief[near] == self._brief[x]).sum(axis=1)
            yield x, near[agree >= AGREE], agree[agree >= AGREE]

    def named(self, places: list) -> pa.Array:
        return self.ids.take(pa.array(np.concatenate([np.empty(0, dtype=np.int64), *places]).astype(np.int64)))


def _block_links(docs: DataFrame, apart: DataFrame, reps: DataFrame) -> DataFrame | None:
    """Links between groups that meet in a node, enough of them to join all groups that are linked.

    Pairs are never listed: a first look marks the sets that have a likely partner at all,
    a second one has the full sets of these in the blocks and confirms there. A block stops
    looking between two groups once it has joined them. A pair that meets in several nodes
    is confirmed in the one with the smallest name. None if no set has a partner.
    """
    kind = reps.schema["v"].dataType.simpleString()
    rows = apart.join(reps.select("v", "n", "brief"), "v")

    def mark(rows: pa.Table) -> pa.Table:
        block = _Block(rows)
        marked = np.zeros(rows.num_rows, dtype=bool)
        for x, near, _ in block.likely():
            marked[near] = True
            marked[x] |= len(near) > 0
        return pa.table([block.named([np.flatnonzero(marked)]).unique()], ["v"])

    marked = _grid(rows).groupBy("node", "o", "m").applyInArrow(mark, f"v {kind}").distinct()
    marked = staged(marked, "marked")
    if not staged_metrics(marked)["rows"]:
        return None
    full = _sets(docs.select("doc_id", "text").join(marked.withColumnRenamed("v", "doc_id"), "doc_id", "left_semi"), True)
    # an id with several texts has several sets; its vertex is the set of its own digest
    full = full.join(reps.select("digest", F.col("v").alias("doc_id")), ["digest", "doc_id"], "left_semi").dropDuplicates(["doc_id"])
    places = apart.join(marked, "v", "left_semi").groupBy("v").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    known = staged(full.select(F.col("doc_id").alias("v"), F.col("data").alias("whole")).join(places, "v"), "marked_sets")

    def confirm(rows: pa.Table) -> pa.Table:
        block, xs, ys = _Block(rows), [], []
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["whole"].to_pylist()]
        here = rows["node"][0].as_py()
        before = [{n for n in nodes if n < here} for nodes in rows["nodes"].to_pylist()]
        root = list(range(int(block.group.max()) + 1))

        def find(g: int) -> int:
            while root[g] != g:
                root[g] = root[root[g]]
                g = root[g]
            return g

        for x, near, agree in block.likely():
            for y in near[np.argsort(-agree, kind="stable")]:
                a, b = find(block.group[x]), find(block.group[y])
                if a != b and before[x].isdisjoint(before[y]) and _is_similar(sets[x], sets[y]):
                    root[max(a, b)] = min(a, b)
                    xs.append([x])
                    ys.append([y])
        return pa.table([block.named(xs), block.named(ys)], ["a", "b"])

    found = _grid(rows.join(known, "v"), SET_BLOCK).groupBy("node", "o", "m").applyInArrow(confirm, f"a {kind}, b {kind}")
    return staged(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "block_links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Documents with equal sets are one vertex, under their smallest id. Texts without words
    and null texts have an empty set and link with nothing. Rows with one id are one
    document, whatever their texts. A row without an id is a component of its own: its
    ``component_id`` is null and it is kept. No rows give no rows.
    """
    sets = staged(_sets(docs, False), "signatures")
    valid = sets.filter("n > 0 and doc_id is not null")
    reps = valid.groupBy("digest").agg(F.min("doc_id").alias("v"), F.any_value("n").alias("n"), F.any_value(F.struct("data", "brief")).alias("s"))
    reps = staged(reps.select("digest", "v", "n", "s.*"), "representatives")
    mine = staged(valid.select("doc_id", "digest").join(reps.select("digest", "v"), "digest"), "own")
    # an id with several texts joins their groups
    links = mine.filter("doc_id <> v").join(reps.select(F.col("v").alias("doc_id")), "doc_id", "left_semi")
    links = staged(links.select(F.col("doc_id").alias("a"), F.col("v").alias("b")), "shared_ids")
    roots = [F.xxhash64(F.lit(f), _value(F.lit(f))) for f in range(TREES * ROOT_BRANCHES)]
    members = _children(reps, roots)
    labels, before = None, []
    rest = FUNCTIONS - len(roots)
    for number in range(ROUNDS):
        few = (FEW if number else FEW_FIRST) if number < ROUNDS - 1 else 2**62  # the last compares all that is left
        rows, seen = _open(members, labels, few, number == 0)
        small, large = rows.filter(F.col("outside") <= few), rows.filter(F.col("outside") > few)
        n_large = seen["large"] or 0

        found = []
        if number == 0:
            found.append(_confirmed(docs, reps, _few_pairs(small).union(_star(large)).distinct(), before))
        else:
            if n_large:
                found.append(_confirmed(docs, reps, _star(large).distinct(), before))
            if seen["rows"] > n_large:
                found.append(_block_links(docs, small, reps))
        found = [x for x in found if x is not None and staged_metrics(x)["rows"]]
        if labels is None:
            labels = components(reduce(DataFrame.union, found, links))
        elif found:
            labels = joined(labels, reduce(DataFrame.union, found))
        if not n_large:
            break
        below = large.join(reps.select("v", "data"), "v")
        function = lambda j: F.lit(len(roots)) + F.pmod(F.xxhash64("node", F.lit(j)), F.lit(rest)).cast("int")
        ways = [F.xxhash64("node", F.lit(j), _value(function(j))) for j in range(BRANCHES)]
        members = staged(_children(below, ways).distinct(), "members")
    by_set = reps.select("digest", "v").join(labels, "v", "left").select("digest", F.coalesce("c", "v").alias("component_id"))
    df = sets.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(by_set, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    df = df.withColumn("component_id", component)
    return df.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Columns stay as given. Where rows share an id or have none, every row is a document of
    its own: of a group the smallest id stays, rows without id after all others, and of
    several rows with that id one. Texts without words are no one's duplicates and all stay.
    """
    clashes = staged(docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select("doc_id"), "clashes")
    if not staged_metrics(clashes)["rows"]:
        gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id")
        df = packed(docs).withColumn("doc_id", F.col("doc.doc_id"))
        return unpacked(df.join(staged(gone, "gone"), "doc_id", "left_anti"), docs.columns)
    rows = staged(packed(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "doc.text"))
    order = F.struct(F.col("doc.doc_id").isNull().alias("without"), F.col("doc.doc_id").alias("id"), "row")
    groups = rows.join(found.select(F.col("doc_id").alias("row"), "component_id"), "row").groupBy("component_id")
    first = groups.agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    return unpacked(rows.join(staged(first, "first"), "row", "left_semi"), docs.columns)
