"""The manifest against a plain tree built in one piece."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gleanwork.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, `a.b` string, tree string, place int"


def digest(*values):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def up(nodes):
    """All levels above some nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([hashlib.sha256("".join(below[i : i + 3]).encode()).hexdigest() for i in range(0, len(below), 3)])
    return levels


def expected(rows, cut):
    leaves = sorted(((r[1] is not None, r[1] or "", r[0] is not None, r[0] or 0, digest(*r), digest(*r[:4], cut(r))) for r in rows))
    sources = sorted({x[:2] for x in leaves}, key=lambda s: (s[0], s[1].encode()))
    trees = [up([x[4] for x in leaves if x[:2] == s]) for s in sources]
    top = up([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for i, (_, _, has, doc_id, leaf, changed) in enumerate(x for x in leaves if x[:2] == s):
            siblings, node = [], changed
            for levels, at in ((trees[k], i), (top, k)):
                for nodes in levels[:-1]:
                    run = list(nodes[at - at % 3 : at - at % 3 + 3])
                    siblings += run[: at % 3] + run[at % 3 + 1 :]
                    run[at % 3] = node
                    node = hashlib.sha256("".join(run).encode()).hexdigest()
                    at //= 3
            proof = hashlib.sha256("".join(siblings).encode()).hexdigest()
            out.append((doc_id if has else None, leaf, trees[k][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "t", 9) for r in rows], SCHEMA)
    cut = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return sorted((tuple(r) for r in merkle.manifest(df, cut).collect()), key=repr)


def cut(row):
    return row[4].replace("\n", "") if row[4] is not None and row[0] is not None and row[0] % 2 == 0 else row[4]


AWKWARD = [
    (1, "a", "en", 3, "x\ny"),
    (2, "a", None, None, None),
    (2, "a", None, None, None),
    (2, "a", "en", 1, "é\n"),
    (None, "a", "en", 1, "no id"),
    (None, "a", "en", 1, "no id"),
    (3, None, "en", 0, ""),
    (4, "", "en", 5, "a:b\n\n-"),
    (5, "Z", "en", 1, "\n" * 70_000),
    (6, "é", "en", 1, "word " * 30_000 + "\n"),
    (7, "\U0001f600", "en", 1, "x"),
    (8, "￿", "en", 1, "x"),
]


@pytest.mark.parametrize("rows", [[], AWKWARD[:1], AWKWARD])
def test_awkward_rows(spark, rows):
    assert run(spark, rows) == expected(rows, cut)


def test_blocks_of_several_rounds(spark, monkeypatch):
    """With blocks of nine a source needs several rounds."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = [(i, f"s{i % 97 % 13}" if i % 3 else "hot", "en", i, f"text\n{i}") for i in range(400)]
    assert run(spark, rows) == expected(rows, cut)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 728, 729, 730])
def test_sizes_around_a_block(n):
    nodes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    if n <= merkle.BLOCK:
        tree = merkle.Subtree([x.encode() for x in nodes], merkle._n_levels(0, n))
        assert tree.top.decode() == up(nodes)[-1][0]
        for i in {0, n // 2, n - 1}:
            assert merkle.fold(nodes[i].encode(), tree.steps(i)) == tree.top
            assert merkle.fold(nodes[i].encode(), merkle.resumed(tree.siblings(i))) == tree.top
            assert merkle.fold(b"0" * 64, tree.steps(i)) != tree.top
    else:
        tops = [merkle.Subtree([x.encode() for x in nodes[at : at + 729]], 6).top for at in (0, 729)]
        assert merkle.Subtree(tops, 1).top.decode() == up(nodes)[-1][0]
