"""Rollups against plain sums, and toxicity with few labels and held out."""

import collections

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleanwork.llm import counts, toxicity
from gleanwork.session import fresh_path

CHANGES = "source string, lang string, version string, d_docs long, d_tokens long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_batches_count_once(spark):
    path = fresh_path(spark, "rollup")
    rollup = counts.Rollup(spark, path)
    assert rows(rollup.totals()) == []
    frame = lambda *r: spark.createDataFrame(list(r), CHANGES)
    one = frame(("a", None, "v", 2, 10), (None, "en", "v", 1, 5), ("a", None, "v", -1, -4))
    assert rollup.commit("1", one) and not rollup.commit("1", one)
    with pytest.raises(ValueError, match="other sums"):
        rollup.commit("1", frame(("a", None, "v", 2, 11)))
    # what a broken run leaves behind does not count
    spark.createDataFrame([("a", "x", "v", 9, 9)], CHANGES).write.parquet(f"{path}/sums/run=2")
    assert rows(rollup.totals()) == [("a", None, "v", 1, 6), (None, "en", "v", 1, 5)]
    assert rollup.commit("2", frame((None, "en", "v", -1, -5)))
    assert rows(rollup.totals()) == [("a", None, "v", 1, 6)]
    rollup.fold()
    assert rows(rollup.totals()) == [("a", None, "v", 1, 6)] and not rollup.commit("1", one)
    assert rollup.commit("3", frame(("a", None, "v", 0, 1))) and rows(rollup.totals()) == [("a", None, "v", 1, 7)]
    # another object on the same folder goes on from there
    assert rows(counts.Rollup(spark, path).totals()) == [("a", None, "v", 1, 7)]


def test_corpus_totals(spark, sf_dir):
    schema = "doc_id long, source string, lang string, text string, `a.b` string, tokens string"
    docs = [(1, "s", "en", "one two"), (2, "s", "en", "one two"), (3, "t", "en", "one two"), (4, None, None, None), (5, "s", "en", ""), (5, "s", "en", "one two"), (None, "s", "en", "one two"), (6, "s", "en", "é <|endoftext|> x")]
    odd = spark.createDataFrame([(*d, "x", "y") for d in docs], schema)
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (odd, odd.limit(0), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        given = df.select("doc_id", "source", "lang", "text").collect()
        first = {}
        for r in given:
            if r.doc_id is not None and r.text is not None:
                key = r.source, r.text
                first[key] = min(first.get(key, r.doc_id), r.doc_id)
        want = collections.defaultdict(lambda: [0, 0])
        for r in given:
            if r.doc_id is None or r.text is None or first[(r.source, r.text)] >= r.doc_id:
                text = r.text or ""
                for version, n in (("words", len(text.encode().split())), ("byte_bpe_50k", len(encode.encode(text, add_special_tokens=False).ids))):
                    want[(r.source, r.lang, version)][0] += 1
                    want[(r.source, r.lang, version)][1] += n
        got = counts.corpus_totals(df, fresh_path(spark, "rollup"))
        assert rows(got) == sorted(((*k, *v) for k, v in want.items() if v != [0, 0]), key=repr)


def test_few_labels(spark):
    docs = spark.createDataFrame([(i, f"some text {i}", "x", 1.0) for i in range(8)] + [(None, None, "x", 1.0)], "doc_id long, text string, `a.b` string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == 9 and all(r.predicted == 0 and 0 <= r.score < 0.3 for r in got)
    some = spark.createDataFrame([(i, 1, int(i == 1)) for i in range(8)] + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert sum(r.predicted for r in toxicity.toxicity(docs, some).collect()) <= 2
    assert toxicity.toxicity(docs.limit(0), some).count() == 0


def test_held_out_documents(spark):
    """Rows that no label was learned from: most toxic ones are found, few others."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id")
    n = {(r.toxic, r.predicted): r.n for r in found.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    assert n.get((1, 1), 0) >= 0.6 * (n.get((1, 1), 0) + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.05 * (n.get((0, 1), 0) + n.get((0, 0), 0))
