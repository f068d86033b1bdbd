"""A Merkle manifest of a document table, built from copied hash states.

Leaves are digests of rows. Within a source every three neighbours have a parent, up to the
source's root; the roots of the sources make one more tree of the same kind. A parent keeps
a copy of its hash state before each child's slot. To fold a changed leaf, the state of its
slot is resumed with the new digest and the siblings to the right; nothing to the left is
hashed again.

Tasks hold ``6`` levels at a time: blocks of ``729`` neighbours, so a source with a third of
all rows is many blocks. A round makes the tops of all blocks, which are the leaves of the
next round. The paths from the blocks up to the root are short lists of siblings; a task
that folds a block's leaves turns the left siblings into states once.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.llm.common import staged
from gleanwork.operators.skew import number_rows
from gleanwork.session import staged_metrics

ARITY = 3
LEVELS = 6
BLOCK = ARITY**LEVELS

_PATH = "array<struct<left:array<string>,right:array<string>>>"


def digest_of(*values: Column) -> Column:
    """Digest of values, each ``-`` if null, else its number of bytes, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


class Subtree:
    """Some levels of a tree above ``nodes``, with a copied state before each child's slot."""

    def __init__(self, nodes: list[bytes], levels: int):
        self.levels, self.states = [nodes], []
        for _ in range(levels):
            below, states, parents = self.levels[-1], [], []
            for at in range(0, len(below), ARITY):
                h = hashlib.sha256()
                for child in below[at : at + ARITY]:
                    states.append(h.copy())
                    h.update(child)
                parents.append(h.hexdigest().encode())
            self.states.append(states)
            self.levels.append(parents)

    @property
    def top(self) -> bytes:
        return self.levels[-1][0]

    def siblings(self, i: int) -> list[tuple[list[bytes], list[bytes]]]:
        """Per level, the nodes left and right of node ``i`` or of its parent there."""
        out = []
        for nodes in self.levels[:-1]:
            start = i - i % ARITY
            out.append((nodes[start:i], nodes[i + 1 : start + ARITY]))
            i //= ARITY
        return out

    def steps(self, i: int) -> list[tuple]:
        """Per level, the state before the slot of node ``i`` and the siblings to its right."""
        out = []
        for nodes, states in zip(self.levels, self.states):
            out.append((states[i], nodes[i + 1 : i - i % ARITY + ARITY]))
            i //= ARITY
        return out


def fold(node: bytes, steps: list[tuple]) -> bytes:
    """The root above ``node`` when it stands in the slots of ``steps``."""
    for state, right in steps:
        h = state.copy()
        h.update(node)
        for other in right:
            h.update(other)
        node = h.hexdigest().encode()
    return node


def resumed(path: list[tuple[list[bytes], list[bytes]]]) -> list[tuple]:
    """Steps from lists of siblings: the left ones become a state."""
    return [(hashlib.sha256(b"".join(left)), right) for left, right in path]


def _n_levels(block: int, n: int) -> int:
    """Levels of a block with ``n`` nodes: all, unless it is the only one of its tree and ends sooner."""
    if block > 0 or n == BLOCK:
        return LEVELS
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _subtree(rows: pa.Table) -> tuple[pa.Table, Subtree]:
    """Rows of one block in order, and the levels above them."""
    rows = rows.sort_by("place")
    block = rows["place"][0].as_py() // BLOCK
    return rows, Subtree([x.encode() for x in rows["digest"].to_pylist()], _n_levels(block, rows.num_rows))


def _place_of_block() -> Column:
    return F.floor(F.col("place") / BLOCK).alias("block")


def block_tops(nodes: DataFrame) -> DataFrame:
    """``tree, place, digest`` of the nodes above the blocks of ``nodes(tree, place, digest)``."""

    def up(rows: pa.Table) -> pa.Table:
        rows, above = _subtree(rows)
        place = rows["place"][0].as_py() // BLOCK
        return pa.table({"tree": rows["tree"].slice(0, 1), "place": pa.array([place], pa.int64()), "digest": [above.top.decode()]})

    return nodes.select("tree", "place", "digest").groupBy("tree", _place_of_block()).applyInArrow(up, "tree string, place bigint, digest string")


def _paths_in_block(nodes: DataFrame) -> DataFrame:
    """``tree, place, path, above``: siblings of each node up to its block's top, and that top's place."""

    def paths(rows: pa.Table) -> pa.Table:
        rows, above = _subtree(rows)
        found = [[{"left": [x.decode() for x in left], "right": [x.decode() for x in right]} for left, right in above.siblings(i)] for i in range(rows.num_rows)]
        kind = pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))
        place = rows["place"][0].as_py() // BLOCK
        return pa.table({"tree": rows["tree"], "place": rows["place"], "path": pa.array(found, kind), "above": pa.array([place] * rows.num_rows, pa.int64())})

    return nodes.select("tree", "place", "digest").groupBy("tree", _place_of_block()).applyInArrow(paths, f"tree string, place bigint, path {_PATH}, above bigint")


def climbed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths ``tree, place, path`` of staged ``nodes`` to their roots, and roots ``tree, digest``.

    A round takes every tree up by ``LEVELS`` levels, until each has one node left.
    """
    empty = F.array().cast(_PATH)
    paths = nodes.select("tree", "place", F.col("place").alias("at"), empty.alias("path"))
    while (staged_metrics(nodes)["last"] or 0) > 0:
        part = _paths_in_block(nodes).withColumnsRenamed({"place": "at", "path": "more"})
        joined = paths.join(part, ["tree", "at"])
        paths = staged(joined.select("tree", "place", F.col("above").alias("at"), F.concat("path", "more").alias("path")), "paths")
        nodes = _placed(block_tops(nodes))
    return paths.select("tree", "place", "path"), nodes.select("tree", "digest")


def _placed(nodes: DataFrame) -> DataFrame:
    return staged(nodes.select("tree", "place", "digest"), "nodes", last=F.max("place"))


def numbered_leaves(leaves: DataFrame) -> DataFrame:
    """Leaves with ``place`` from 0 in their tree, by id (null first), then digest."""
    rows = number_rows(leaves, ["tree"], ["doc_id", "digest"], "place")
    return rows.withColumn("place", F.col("place") - 1)


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs``.

    ``docs`` has doc_id, source, lang, n_chars and text; other columns play no part,
    whatever their names. A leaf is the digest of these five. ``changed`` is the text to
    fold with, by default the text itself. Every row is a leaf, repeated rows and rows
    without id too; rows with one id stand in the order of their digests. Null sources are
    a tree of their own, the first one. The proof is the digest of all siblings from the
    leaf to the root. Texts are hashed where they lie, and only digests move, so their
    length does not matter. No rows give no rows.
    """
    text = F.col("text") if changed is None else changed
    fields = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("tree"),
        "doc_id",
        digest_of(*fields, F.col("text")).alias("digest"),
        F.when(~text.eqNullSafe(F.col("text")), digest_of(*fields, text)).alias("changed"),
    )
    leaves = staged(numbered_leaves(staged(leaves, "leaves")), "numbered")
    tops = _placed(block_tops(leaves))
    paths, subroots = climbed(tops)
    # the sources' roots in order of source are the leaves of the last tree
    everything = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("doc_id"), "digest")
    sources = staged(numbered_leaves(staged(everything, "subroots")), "sources", last=F.max("place"))
    source_paths, root = climbed(sources)
    top = root.first()
    ends = sources.join(source_paths.select("place", F.col("path").alias("rest")), "place")
    ends = ends.select(F.col("doc_id").alias("tree"), F.col("digest").alias("subroot"), F.lit(top and top["digest"]).alias("root"), "rest")
    paths = paths.join(ends, "tree").select("tree", F.col("place").alias("block"), F.concat("path", "rest").alias("path"), "subroot", "root")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def proofs(key: tuple, rows: pa.Table, path: pa.Table) -> pa.Table:
        rows, above = _subtree(rows)
        path = path.to_pylist()[0]
        upper = [([x.encode() for x in p["left"]], [x.encode() for x in p["right"]]) for p in path["path"]]
        beyond = resumed(upper)
        tail = b"".join(x for left, right in upper for x in left + right)
        proof, folded = [], []
        for i, (digest, other) in enumerate(zip(rows["digest"].to_pylist(), rows["changed"].to_pylist())):
            siblings = b"".join(x for left, right in above.siblings(i) for x in left + right)
            proof.append(hashlib.sha256(siblings + tail).hexdigest())
            folded.append(fold((other or digest).encode(), above.steps(i) + beyond).decode())
        n = rows.num_rows
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                "leaf": rows["digest"],
                "subroot": pa.array([path["subroot"]] * n, pa.string()),
                "root": pa.array([path["root"]] * n, pa.string()),
                "proof_sha256": pa.array(proof, pa.string()),
                "folded_root": pa.array(folded, pa.string()),
                "verified": pa.array([x == path["root"] for x in folded], pa.bool_()),
            }
        )

    blocks = leaves.withColumn("block", _place_of_block()).groupBy("tree", "block")
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocks.cogroup(staged(paths, "block_paths").groupBy("tree", "block")).applyInArrow(proofs, schema)
