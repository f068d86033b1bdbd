"""The pipeline's stages on awkward rows, and packing against the described tokenizer."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleanwork.llm import packing, quality
from gleanwork.llm.common import staged

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, failed_rules int, row int, `a.b` string"
GOOD = " ".join(f"word{i % 97} then{i}" for i in range(60))
ROWS = [
    (1, GOOD),
    (2, GOOD),
    (3, GOOD + " and a tail"),
    (4, None),
    (5, ""),
    (None, "Other " + GOOD),
    (6, "line one of it here\nline two of it here\nline three of it here\n" + GOOD.replace("word", "term")),
    (7, "line one of it here\nline two of it here\nline three of it here\n" + GOOD.replace("word", "name")),
    (7, GOOD.replace("word", "same")),
    (7, GOOD.replace("word", "same")),
    (8, " ".join(f"long{i} text{i * 7}" for i in range(20_000))),
    (9, "é <|endoftext|> " + GOOD.replace("word", "mot")),
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 5 else None, 1, "d", 1, 2, "x") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("rows", [ROWS, ROWS[3:5], []])
def test_stages_on_awkward_rows(spark, rows):
    docs = table(spark, rows)
    names = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = staged(stage(spark, docs, ""), name)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names, name
        if rows is ROWS and name == "near_dedup":
            ids = sorted(r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is not None)
            # the three texts in 1 to 3 are one group, the rows under 7 are two texts
            assert ids == [1, 6, 7, 7, 8, 9]
    assert (docs.count() > 0) == (rows is ROWS)


def test_the_filter_does_not_write_the_ledger_out_again(spark):
    plan = quality.keep_good(table(spark, ROWS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 4


def test_pieces_hold_each_id_once(spark, sf_dir):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (spark.read.parquet(f"{sf_dir}/documents.parquet"), table(spark, [(i, t) for i, (_, t) in enumerate(ROWS)]), table(spark, [])):
        tokens = {r.doc_id: encode.encode(r.text or "", add_special_tokens=False).ids + [0] for r in df.select("doc_id", "text").collect()}
        pieces = packing.pack(df).collect()
        by_doc, by_sequence = {}, {}
        for p in pieces:
            ids = np.array(tokens[p.doc_id][p.start : p.start + p.length], dtype="<u4")
            assert p.length == len(ids) > 0 and p.ids_crc32 == zlib.crc32(ids.tobytes()) and p.doc_tokens == len(tokens[p.doc_id])
            by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
            by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert set(by_doc) == set(tokens)
        for parts, whole in [(v, len(tokens[k])) for k, v in by_doc.items()] + [(v, None) for v in by_sequence.values()]:
            end = 0
            for start, length in sorted(parts):
                assert start == end
                end += length
            assert end == whole if whole is not None else end <= 1024
        total = sum(map(len, tokens.values()))
        assert len(by_sequence) * 1024 <= 1.1 * total + 16 * 1024
