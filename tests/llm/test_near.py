"""Near duplicates in groups whose members are like each other to all degrees, and the pipeline's stage."""

import random

import pytest
from tests.llm.test_brute_force import shingle_set

from gleanwork.llm import near
from gleanwork.llm.common import staged
from gleanwork.llm.components import components, joined

SCHEMA = "doc_id long, text string, `a.b` string, component_id string, row int, v int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], SCHEMA)


def roots(rows):
    """Smallest place of each row's group, by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    return root


def varied(rng, base, rate):
    return " ".join(f"z{rng.randrange(10**6)}" if rng.random() < rate else w for w in base)


@pytest.mark.parametrize("few,few_first", [(512, 8), (6, 3)])
def test_groups_around_the_threshold(spark, monkeypatch, few, few_first):
    """Changed words leave similarities from 0.5 to 0.95, so groups join only in part."""
    monkeypatch.setattr(near, "FEW", few)
    monkeypatch.setattr(near, "FEW_FIRST", few_first)
    rng = random.Random(few)
    texts = []
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(300)]
        texts += [varied(rng, base, rng.choice([0.005, 0.02, 0.03, 0.04, 0.05])) for _ in range(45)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = roots(rows)
    got = {r.doc_id: r.component_id for r in near.near_duplicates(table(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == want
    assert 4 < len(set(want)) < 150


def test_one_of_each_where_ids_clash(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(3, long), (3, "other text here"), (4, long + " tail"), (None, long), (None, "alone"), (5, None), (5, ""), (2, "Other TEXT here"), (6, None), (7, "a b c d e f g"), (7, "a b c d e f g")]
    df = near.keep_one_of_each(table(spark, rows))
    assert df.columns == ["doc_id", "text", "a.b", "component_id", "row", "v"]
    got = sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    assert got == sorted([(3, long), (2, "Other TEXT here"), (None, "alone"), (5, None), (5, ""), (6, None), (7, "a b c d e f g")], key=repr)
    assert near.keep_one_of_each(table(spark, [])).count() == 0
    plain = [(i, t) for i, t in enumerate([long, long + " x", "b", None, "b", ""])]
    assert sorted(r.doc_id for r in near.keep_one_of_each(table(spark, plain)).collect()) == [0, 2, 3, 5]


def test_labels_after_further_links(spark):
    """Links that come in three deliveries give the components of all of them."""
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(240)]
    schema = "a long, b long"
    whole = {r.v: r.c for r in components(staged(spark.createDataFrame(edges, schema), "all")).collect()}
    labels = components(staged(spark.createDataFrame(edges[:80], schema), "first"))
    for at in (80, 160):
        labels = joined(labels, spark.createDataFrame(edges[at : at + 80], schema))
    rows = labels.collect()
    got = {r.v: r.c for r in rows}
    assert len(rows) == len(got)
    assert {v: c for v, c in got.items() if v in whole} == whole and all(got[v] == v for v in got.keys() - whole.keys())
    none = joined(components(staged(spark.createDataFrame([], schema), "none")), spark.createDataFrame(edges[:3], schema))
    assert none.count() == len({v for e in edges[:3] for v in e})
