"""Equal documents by content-defined chunk recipes.

A text is cut where a hash of the last ``WINDOW`` bytes has its low bits clear, so equal
passages are cut alike wherever they stand. A document's recipe is the ordered list of its
chunks' fingerprints. Texts stay where they are: recipes take a hundredth of their size, and
a recipe that no other document has proves that its text is alone.

Fingerprints of shared recipes are verified: the chunks under them are made distinct by
their bytes, inside each task first, so a passage with thousands of copies moves once per
task. A fingerprint with one content is an identifier as it stands. One with several gives
each content a number, and the numbers go beside the recipe. Documents are equal where both
lists are, in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.llm.common import packed, staged, unpacked
from gleanwork.llm.hashing import mixed
from gleanwork.session import staged_metrics

WINDOW = 16  # a power of two
LEAST, MOST = 512, 8192  # bytes of a chunk; the last one of a text may be shorter
CUT_BITS = 10
FINGERPRINT_BITS = 64
FILTER_BITS = 27  # of the table that goes to all tasks, 16 MB

_BYTE_HASH = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _cut_places(data: np.ndarray) -> np.ndarray:
    """Places after which the text may be cut, each by the ``WINDOW`` bytes before it."""
    if len(data) < WINDOW:
        return np.empty(0, dtype=np.int64)
    h = _BYTE_HASH[data]
    width = 1
    while width < WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, 2 * width
    # the top bits depend on all bytes of the window
    hit = np.flatnonzero(h[WINDOW - 1 :] >> np.uint32(32 - CUT_BITS) == 0)
    return hit + WINDOW


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of a text, in order; none for the empty text."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    places = _cut_places(np.frombuffer(data, dtype=np.uint8))
    ends, at = [], 0
    while n - at > LEAST:
        k = int(np.searchsorted(places, at + LEAST))
        end = min(int(places[k]) if k < len(places) else n, at + MOST, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def _normal(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z in lower case; ``bytes.lower`` leaves all others alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _fingerprint(chunk: bytes, bits: int) -> int:
    return (xxhash.xxh3_64_intdigest(chunk) >> (64 - bits)) - (1 << 63 if bits == 64 else 0)


def _chunks(text: str | None, bits: int) -> Iterator[tuple[int, bytes]]:
    data, start = _normal(text), 0
    for end in chunk_ends(data):
        yield _fingerprint(data[start:end], bits), data[start:end]
        start = end


def _key(fingerprints: list[int]) -> int:
    return xxhash.xxh3_64_intdigest(np.array(fingerprints, dtype=np.int64).tobytes()) - (1 << 63)


def recipes(docs: DataFrame, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """``doc_id, recipe, key, text_sha256`` for every row of ``docs(doc_id, text)``; ``key`` is a hash of the recipe."""

    def rows(batches):
        for batch in batches:
            found, digests = [], []
            for text in batch.column(1).to_pylist():
                found.append([f for f, _ in _chunks(text, bits)])
                digests.append(hashlib.sha256(_normal(text)).hexdigest())
            columns = [batch.column(0), pa.array(found, pa.list_(pa.int64())), pa.array(map(_key, found), pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "recipe", "key", "text_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, recipe array<bigint>, key bigint, text_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def _shared_keys(known: DataFrame) -> np.ndarray:
    """A bit table of the keys that several rows have, of at most ``2 ** FILTER_BITS`` bits.

    A key's bit is its remainder. A key that shares its bit with another costs a look at a
    text that is alone, never a wrong result.
    """
    shared = known.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = staged(shared.select("key"), "shared")
    size = 1 << min(FILTER_BITS, max(16, (16 * staged_metrics(shared)["rows"]).bit_length()))
    bit = F.pmod("key", F.lit(size))
    word = F.shiftright(bit, 5).alias("word")
    words = shared.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bit, F.lit(32)).cast("int"))).alias("bits"))
    table = np.zeros(size // 32, dtype=np.int64)
    found = words.toPandas()  # no more rows than the table has words
    table[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return table.astype(np.uint32)


def _contents(texts: DataFrame, bits: int, wanted: str) -> DataFrame:
    """``doc_id, text_sha256, seq, fingerprint, content`` of the chunks in the list ``wanted``."""

    def rows(batches):
        for batch in batches:
            ids, digests, seqs, prints, contents = [], [], [], [], []
            for place, (text, only) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                digest = hashlib.sha256(_normal(text)).hexdigest()
                for seq, (fingerprint, content) in enumerate(_chunks(text, bits)):
                    if fingerprint in only:
                        ids.append(place)
                        digests.append(digest)
                        seqs.append(seq)
                        prints.append(fingerprint)
                        contents.append(content)
            columns = [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(digests, pa.string()), pa.array(seqs, pa.int32()), pa.array(prints, pa.int64()), pa.array(contents, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_sha256", "seq", "fingerprint", "content"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_sha256 string, seq int, fingerprint bigint, content binary"
    return texts.select("doc_id", "text", wanted).mapInArrow(rows, schema)


def _ambiguous(docs: DataFrame, known: DataFrame, bits: int) -> DataFrame:
    """Fingerprints of shared recipes that stand for several contents, as a written table.

    Texts are read where they lie; only chunks of shared recipes leave the task.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_shared_keys(known))

    def rows(batches):
        table = sent.value
        for batch in batches:
            prints, contents = [], []
            for text in batch.column(0).to_pylist():
                found = list(_chunks(text, bits))
                bit = _key([f for f, _ in found]) % (32 * len(table))
                if table[bit // 32] >> np.uint32(bit % 32) & 1:
                    prints += [f for f, _ in found]
                    contents += [c for _, c in found]
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(contents, pa.binary())], ["fingerprint", "content"])

    contents = docs.select("text").mapInArrow(rows, "fingerprint bigint, content binary").distinct()
    several = contents.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return staged(several.select("fingerprint"), "ambiguous")


def _numbers(docs: DataFrame, known: DataFrame, ambiguous: DataFrame, bits: int) -> DataFrame:
    """``doc_id, text_sha256, numbers``: for chunks under an ambiguous fingerprint, place and number of the content."""
    hit = known.select("doc_id", F.explode(F.array_distinct("recipe")).alias("fingerprint")).join(ambiguous, "fingerprint")
    lists = staged(hit.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("fingerprint").alias("only")), "own_ambiguous")
    texts = docs.select("doc_id", "text").join(lists, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    found = staged(_contents(texts, bits, "only"), "contents")
    order = Window.partitionBy("fingerprint").orderBy("content")
    number = found.select("fingerprint", "content").distinct().withColumn("number", F.row_number().over(order))
    numbered = found.join(number, ["fingerprint", "content"])
    place = F.struct("seq", "number")
    # rows that share id and text are alike, so each place counts once
    return numbered.groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_set(place)).alias("numbers"))


def exact_groups(docs: DataFrame, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs(doc_id, text)``.

    Texts are equal when identical after lower-casing A-Z. Null counts as empty, and the
    empty text has the empty recipe, so these are one group. Of a group the row with the
    largest id stays; of several such rows, one. Rows without an id belong to their group
    and stay only if no other row of it has one; ``keep_id`` is then null. Other columns of
    ``docs``, whatever their names, play no part. A long text is one recipe and never moves
    as a whole. No rows give no rows.
    """
    known = recipes(docs, bits).withColumn("row", F.monotonically_increasing_id())
    known = staged(known, "recipes")
    ambiguous = _ambiguous(docs, known, bits)
    none = F.array().cast("array<struct<seq:int,number:int>>")
    if staged_metrics(ambiguous)["rows"]:
        # the digest only tells rows of one id apart
        numbers = staged(_numbers(docs, known, ambiguous, bits), "numbers").withColumnRenamed("doc_id", "_id").withColumnRenamed("text_sha256", "_sha")
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha"))
        known = known.join(numbers, same, "left").drop("_id", "_sha").withColumn("numbers", F.coalesce("numbers", none))
    else:
        known = known.withColumn("numbers", none)
    lists = ["recipe", "numbers"]
    groups = known.groupBy(*lists).agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    # most groups are one row; only the others are joined back
    several = staged(groups.filter("group_size > 1"), "groups")
    df = known.join(several, lists, "left")
    alone = F.col("last").isNull()
    return df.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("row") == F.col("last.row"))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as given.

    Rows that share an id and a text are one document and all stay here; rows without an
    id stay as well.
    """
    gone = exact_groups(docs).filter("not kept and doc_id is not null and doc_id <> keep_id").select("doc_id", "text_sha256").distinct()
    text = F.coalesce(F.col("doc").getField("text"), F.lit(""))
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = packed(docs).withColumn("doc_id", F.col("doc.doc_id")).withColumn("text_sha256", F.sha2(lower, 256))
    return unpacked(df.join(staged(gone, "gone"), ["doc_id", "text_sha256"], "left_anti"), docs.columns)
