"""Hard negatives against all scores, and intervals against true inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanwork.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, `a.b` string, score string, x int, positives int"


def rows_of(rng, n, width, labels):
    centres = rng.standard_normal((6, width))
    x = centres[rng.integers(0, 6, n)] + 0.4 * rng.standard_normal((n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(int(i), int(rng.integers(0, labels)), [float(v) for v in x[i].astype(np.float32)]) for i in range(n)]


def expected(rows, step):
    ok = {}
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.setdefault((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    best = lambda found: sorted(found.items(), key=lambda t: (-t[1], t[0]))[:5]
    near, out = {}, {}
    for i, label, v in ok:
        if i % step == 0:
            scores = near.setdefault(i, {})
            for j, other, w in ok:
                if j != i and other == label and len(v) == len(w):
                    s = sum(map(int.__mul__, v, w))
                    scores[j] = max(s, scores.get(j, s))
    for i, label, v in ok:
        if i % step == 0:
            for p, ps in best(near[i]):
                found = out.setdefault((i, p, ps), {})
                for j, other, w in ok:
                    if other != label and len(v) == len(w):
                        s = sum(map(int.__mul__, v, w))
                        if 80 * ps <= 100 * s <= 100 * ps:
                            found[j] = max(s, found.get(j, s))
    return sorted((i, p, k + 1, j, ps, s) for (i, p, ps), found in out.items() for k, (j, s) in enumerate(best(found)))


def run(spark, rows, step):
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % step == 0).collect())


@pytest.mark.parametrize("width", [3, 64, 100])
def test_random_rows(spark, width):
    rows = rows_of(np.random.default_rng(width), 400, width, 4)
    got = run(spark, rows, 20)
    assert got == expected(rows, 20) and len(got) > 100


def test_copies_ties_and_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = rows_of(rng, 120, 16, 3)
    same = rows[0][2]
    rows += [(1000 + i, i % 3, same) for i in range(60)]
    rows += [(5, 1, same), (5, 1, same), (5, 2, rows[7][2]), (0, rows[0][1], same)]
    rows += [(2000, None, same), (2001, 1, None), (2002, 1, []), (2003, 1, [None, *same[1:]]), (None, 1, same)]
    rows += [(2004, 1, [float("nan"), *same[1:]]), (2005, 1, [float("inf"), *same[1:]]), (2006, 1, [0.0] * 16), (2007, 2, same[:3]), (2010, 2, same[:3])]
    rows += [(2020, 7, same), (2030, 1, [-x for x in same])]
    assert run(spark, rows, 10) == expected(rows, 10)
    assert run(spark, [], 10) == [] and run(spark, rows[1:3], 10) == []


def test_many_blocks(spark, monkeypatch):
    """Rows and anchors in many blocks give the same rows."""
    monkeypatch.setattr(negatives, "BLOCK", 8)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rows = rows_of(np.random.default_rng(9), 300, 24, 3)
    assert run(spark, rows, 25) == expected(rows, 25)


def test_intervals_hold_and_are_narrow():
    rng = np.random.default_rng(2)
    for width in (1, 7, 64, 200):
        x = rng.integers(-200, 200, (500, width))
        x[0] = 0
        coded = negatives.Coded.read(negatives.Coded.of(x).stored())
        for y in [*x[:20], np.ones(width, dtype=np.int64)]:
            low, high = negatives.Asked(y).interval(coded)
            true = x @ y
            assert (low <= true).all() and (true <= high).all()
        if width >= 64:
            length = np.linalg.norm(x[1]) * np.linalg.norm(x[1:], axis=1)
            low, high = negatives.Asked(x[1]).interval(coded)
            assert np.median((high - low)[1:] / length) < 0.5
