"""Exact duplicates against plain comparison of texts."""

import hashlib
import random

import pytest

from gleanwork.llm import chunks

LONG = " ".join(f"Word{i * i % 977}" for i in range(9000))
ROWS = [
    (1, None),
    (2, ""),
    (3, "Same TEXT é É"),
    (4, "same text é É"),
    (5, "same text é é"),
    (6, LONG),
    (7, LONG.upper()),
    (8, LONG[:-1] + "x"),
    (9, "a" * 50_000),
    (10, "A" * 50_000),
    (11, "a" * 49_999),
    (12, "same text é É"),
    (None, "same text É"),
    (None, "same text É"),
    (13, "twice"),
    (13, "twice"),
    (13, "other"),
    (14, "x" * 512),
    (15, "x" * 513),
]
SCHEMA = "doc_id long, text string, `a.b` string, keep_id string, recipe int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], SCHEMA)


def lowered(text):
    return (text or "").encode().lower()


def expected(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(lowered(text), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text).hexdigest()
        # of rows that tie for the largest id one stays
        stay = [i for i in ids if i == keep][:1]
        rest = list(ids)
        rest.remove(keep)
        out += [(i, keep, len(ids), True, sha) for i in stay] + [(i, keep, len(ids), False, sha) for i in rest]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 6, 1])
def test_groups(spark, bits):
    """With few bits almost every fingerprint stands for several contents."""
    for rows in (ROWS, [], ROWS[:1]):
        got = sorted((tuple(r) for r in chunks.exact_groups(table(spark, rows), bits).collect()), key=repr)
        assert got == expected(rows)


def test_random_copies(spark):
    rng = random.Random(5)
    parts = ["".join(rng.choice("abC \n") for _ in range(rng.randrange(3000))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(4)))) for i in range(300)]
    for bits in (64, 3):
        got = sorted((tuple(r) for r in chunks.exact_groups(table(spark, rows), bits).collect()), key=repr)
        assert got == expected(rows)


def test_chunks_cover_the_text_and_find_their_place_again():
    rng = random.Random(1)
    text = bytes(rng.randrange(97, 123) for _ in range(60_000))
    ends = chunks.chunk_ends(text)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(text) and max(sizes) <= chunks.MOST and min(sizes[:-1]) >= chunks.LEAST
    moved = chunks.chunk_ends(b"something in front " * 40 + text)
    shift = len(b"something in front " * 40)
    assert len({e - shift for e in moved} & set(ends)) > 0.9 * len(ends)
    assert chunks.chunk_ends(b"") == [] and chunks.chunk_ends(b"x") == [1]


def test_rows_that_stay(spark):
    df = chunks.without_copies(table(spark, ROWS))
    assert df.columns == ["doc_id", "text", "a.b", "keep_id", "recipe"]
    assert sorted(r.doc_id for r in df.collect() if r.doc_id) == [2, 5, 7, 8, 10, 11, 12, 13, 13, 13, 14, 15]
    assert chunks.without_copies(table(spark, [])).count() == 0
