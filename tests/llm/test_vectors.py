"""Embedding near-duplicates: planted pairs are found, and every link is a true one."""

import math

import numpy as np

from gleanwork.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, `a.b` string, unit string, copies int"


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in rows], SCHEMA)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}


def linked(a, b):
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) >= 0.95


def test_planted_pairs(spark):
    """At least 0.97 of 1,200 pairs just above the threshold and up to 0.98 are found."""
    rng = np.random.default_rng(4)
    width, pairs = 64, 1200
    base = rng.standard_normal((pairs, width))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((pairs, width))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = np.linspace(0.9502, 0.98, pairs)[:, None]
    twins = cosine * base + np.sqrt(1 - cosine**2) * side
    far = 0.949 * base + math.sqrt(1 - 0.949**2) * np.roll(side, 1, axis=1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*base, *twins])]
    got = run(spark, rows + [(10_000 + i, [float(x) for x in v]) for i, v in enumerate(far[:200])])
    as_read = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in rows}
    hits = sum(got[i][1] == got[i + pairs][1] for i in range(pairs))
    assert hits >= 0.97 * pairs
    for i in range(pairs):
        if got[i][0]:
            assert linked(as_read[i], as_read[i + pairs]) or i < 200


def test_odd_vectors(spark):
    one = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, one), (2, [2 * x for x in one]), (3, None), (4, []), (5, [0.0] * 4), (6, [None, 1.0, 1.0, 1.0]), (7, [float("nan")] * 4), (8, [float("inf"), 1.0, 1.0, 1.0]), (9, one[:3]), (10, [-x for x in one])]
    got = run(spark, rows)
    assert got[1] == (1, 1, True) and got[2] == (1, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10))
    assert run(spark, []) == {}
