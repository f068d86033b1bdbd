"""Removal of long word sequences that an earlier document has, by De Bruijn compaction.

A run of ``K`` words is an edge from its first ``K - 1`` words to its last. Of equal texts
the one with the smallest id makes edges; the others have all of theirs in it. Every edge
names the smallest hash among its runs of ``M`` words; equal edges name the same one, so
only edges whose name several documents share can repeat.

Neighbouring edges of one name are a path, written as one row. Where documents agree they cut
their paths alike, so most repeats are whole paths: a join on the digest of the words finds
the first source of each and leaves no branch inside it. Paths of one name that differ do
branch, mostly at the ends of what documents share. Only those are taken apart into edges
again, one copy of each, at the coordinates of its source.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.llm.common import staged
from gleanwork.llm.hashing import WordHashes, windows

K = 13
M = 5
_EMPTY = np.empty(0, dtype=np.uint64)
# stands for all edges of a text
_WHOLE = 2**40


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _names(h: np.ndarray) -> np.ndarray:
    """For each window of ``K`` words, the smallest hash among its runs of ``M``."""
    if len(h) < K:
        return _EMPTY
    runs = windows(h, M, seed=3)
    return np.lib.stride_tricks.sliding_window_view(runs, K - M + 1).min(axis=1)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("t"), "text")


def _sources(texts: DataFrame) -> DataFrame:
    """``doc_id, t, first``: each text under each id, and the smallest id that has the same text."""
    rows = staged(texts.select("doc_id", "t", F.sha2("text", 256).alias("digest")).distinct(), "digests")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    return staged(rows.join(first, "digest").select("doc_id", "t", "first"), "sources")


def _anchors(texts: DataFrame) -> DataFrame:
    """``name, doc_id, t``: the distinct window names of each document."""

    def rows(batches):
        table = WordHashes()
        for batch in batches:
            found = [np.unique(_names(table.of(_split(text.as_py())))) for text in batch.column(2)]
            counts = [len(x) for x in found]
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            names = np.concatenate([_EMPTY, *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), batch.column(0).take(at), batch.column(1).take(at)], ["name", "doc_id", "t"])

    return texts.mapInArrow(rows, "name bigint, doc_id bigint, t bigint")


def _paths(marked: DataFrame) -> DataFrame:
    """``a, b, name, doc_id, t, i, n, edges``: neighbouring edges whose name is marked.

    ``a`` and ``b`` are a digest of the words under the ``n`` edges from word ``i``;
    ``edges`` holds a hash of the words of each.
    """

    def rows(batches):
        table = WordHashes()
        columns = ["a", "b", "name", "doc_id", "t", "i", "n", "edges"]
        for batch in batches:
            digests, names, places, counts, edges, owner = [], [_EMPTY], [], [np.zeros(1, np.int64)], [_EMPTY], []
            for number, (text, shared) in enumerate(zip(batch.column(2), batch.column(3))):
                words = _split(text.as_py())
                h = table.of(words)
                of_edge = _names(h)
                starts = np.flatnonzero(np.concatenate([[True], of_edge[1:] != of_edge[:-1]]))
                n = np.diff(np.append(starts, len(of_edge)))
                shared = np.asarray(shared.values.to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64)
                chosen = np.isin(of_edge[starts], shared)
                edges.append(windows(h, K, seed=5)[np.repeat(chosen, n)])
                starts, n = starts[chosen], n[chosen]
                digests += [_digest(words[i : i + m + K - 1]) for i, m in zip(starts.tolist(), n.tolist())]
                names.append(of_edge[starts])
                places.append(starts)
                counts.append(n)
                owner.append(np.full(len(n), number))
            both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            take = pa.array(np.concatenate(owner or [np.empty(0, np.int64)]))
            n = np.concatenate(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(n).astype(np.int32)), pa.array(np.concatenate(edges).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(both[:, 0]),
                    pa.array(both[:, 1]),
                    pa.array(np.concatenate(names).view(np.int64)),
                    batch.column(0).take(take),
                    batch.column(1).take(take),
                    pa.array(np.concatenate(places or [np.empty(0, np.int64)])),
                    pa.array(n[1:]),
                    lists,
                ],
                columns,
            )

    schema = "a bigint, b bigint, name bigint, doc_id bigint, t bigint, i bigint, n bigint, edges array<bigint>"
    return marked.select("doc_id", "t", "text", "names").mapInArrow(rows, schema)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``doc_id, t, i, n``: ``n`` edges from word ``i`` start in a document with a smaller id."""
    texts = texts.filter("doc_id is not null and text is not null")
    sources = _sources(texts)
    own = sources.filter("doc_id = first").select("doc_id", "t")
    copies = sources.filter("doc_id > first").select("doc_id", "t", F.lit(0).cast("bigint").alias("i"), F.lit(_WHOLE).alias("n"))

    anchors = staged(_anchors(texts.join(own, ["doc_id", "t"]).select("doc_id", "t", "text")), "anchors")
    shared = anchors.groupBy("name").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("name")
    names = anchors.join(staged(shared, "shared"), "name").groupBy("doc_id", "t").agg(F.collect_set("name").alias("names"))
    paths = staged(_paths(texts.join(staged(names, "names"), ["doc_id", "t"])), "paths")

    # one row per path: its first source, and whether others have it
    graph = paths.groupBy("a", "b", "name").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"))
    graph = staged(graph, "graph")
    repeats = graph.filter("source < last").select("a", "b", "source")
    whole = paths.select("a", "b", "doc_id", "t", "i", "n").join(repeats, ["a", "b"]).filter("doc_id > source")

    # a name whose paths differ between sources branches
    forks = graph.groupBy("name").agg(F.min("source").alias("lo"), F.max("source").alias("hi")).filter("lo < hi").select("name")
    forked = graph.join(forks, "name", "left_semi").select("a", "b", F.col("source").alias("doc_id"))
    forked = staged(paths.select("a", "b", "name", "doc_id", "t", "i", "edges").join(forked, ["a", "b", "doc_id"]).drop("a", "b"), "forked")
    edges = forked.select("name", "doc_id", "t", "i", F.posexplode("edges").alias("at", "edge"))
    first = edges.groupBy("name", "edge").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    parts = edges.join(first.select("name", "edge", "lo"), ["name", "edge"]).filter("doc_id > lo")
    parts = parts.select("doc_id", "t", (F.col("i") + F.col("at")).alias("i"), F.lit(1).cast("bigint").alias("n"))
    return copies.unionByName(whole.select("doc_id", "t", "i", "n")).unionByName(parts)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for every row of ``docs(doc_id, text)``.

    Words under a window that starts in a document with a smaller id go; windows are those
    of the input. Null texts have no words. Rows without an id neither lose words nor take
    any. Rows with one id are no earlier than each other, repeated rows fare alike. Texts of
    any length are taken whole, extra columns are not read, no rows give no rows. Whole paths
    are equal by a digest of 128 bits, single edges of one name by a hash of 64.
    """
    texts = _texts(docs)
    spans = repeated_spans(texts).groupBy("doc_id", "t").agg(F.collect_list(F.struct("i", "n")).alias("spans"))
    df = texts.join(staged(spans, "spans"), ["doc_id", "t"], "left").select("doc_id", "text", "spans")

    def rows(batches):
        for batch in batches:
            out = {"n_words": [], "n_removed": [], "kept_text": []}
            for text, spans_of in zip(batch.column(1), batch.column(2)):
                words = _split(text.as_py())
                keep = np.ones(len(words), dtype=bool)
                if len(words) >= K:
                    for span in spans_of.as_py() or ():
                        keep[span["i"] : span["i"] + span["n"] + K - 1] = False
                out["n_words"].append(len(words))
                out["n_removed"].append(int(len(words) - keep.sum()))
                out["kept_text"].append(b" ".join([words[i] for i in np.flatnonzero(keep)]).decode("utf-8", "surrogatepass"))
            kinds = [pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, k) for v, k in zip(out.values(), kinds)]], ["doc_id", *out])

    return df.mapInArrow(rows, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
