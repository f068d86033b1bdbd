"""Operators that SQL cannot express against plain versions on small texts."""

import hashlib
import re

from pyspark.sql import functions as F

from gleanwork.llm import near, pii, substrings

SCHEMA = "doc_id long, text string, `a.b` string, kind string"
A = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    None,
    "",
    A,
    A,
    "x y " + " ".join(A.split()[10:40]) + " z",
    A + " tail",
    "mail a.b@c.d_e@f.g, 10.0.0.256 1.2.3.4.5 é +1 (212) 555-0100 4111 1111 1111 1111 4111111111111112",
    "Dear Maria Lopez, call 212-555-0199. ssn 212-45-6781\n" * 3,
    "a@b.c" * 3 + "@" * 5 + "1" * 3000,
]


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], SCHEMA)


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def base_spans(text):
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m.group())]


def test_base_spans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for df in (docs, table(spark)):
        got = {r.doc_id: r.s for r in pii.personal_data(df).select("doc_id", pii.written(F.col("base")).alias("s")).collect()}
        assert got == {r.doc_id: ",".join(base_spans(r.text)) for r in df.collect()}


def test_added_spans_are_apart(spark):
    rows = pii.personal_data(table(spark)).collect()
    for row in rows:
        for s in row.added:
            assert all(b.end <= s.start or s.end <= b.start for b in row.base)
    assert pii.personal_data(table(spark, [])).count() == 0


def test_votes_that_agree_win():
    scores = pii.accepted({"name|1|1|1|middle|word": 50, "name|0|0|0|middle|word": 5000, "name|1|0|0|middle|word": 900})
    assert scores["name|1|1|1|middle|word"] > 0.9 > 0.5 > scores["name|1|0|0|middle|word"]


def removed(docs):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    first = {}
    for i, w in sorted(words.items()):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = {}
    for i, w in words.items():
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


def test_repeated_spans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for df in (docs, table(spark), table(spark, [])):
        rows = substrings.without_repeats(df).select("*", F.sha2("kept_text", 256).alias("h")).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.h) for r in rows} == removed([(r.doc_id, r.text) for r in df.collect()])


# passages cut at other places, repeated words, one id twice
FORKS = [
    (1, A, "x"),
    (2, " ".join(A.split()[:25] + ["other"] + A.split()[26:]), None),
    (3, " ".join(A.split()[5:24] + A.split()[40:58]), "x"),
    (3, " ".join(A.split()[20:50]), None),
    (4, "same " * 40, None),
    (5, "same " * 30 + A, None),
    (5, "same " * 30 + A, None),
    (6, " ".join(A.split()[:12]), None),
    (7, " ".join(A.split()[:12]), None),
    (8, "other " + " ".join(A.split()[26:39]), None),
    (9, A.upper(), None),
]


def test_repeated_spans_that_branch(spark):
    """Rows of one id take their windows together; they are no earlier than each other."""
    df = spark.createDataFrame(FORKS, "doc_id long, text string, t string")
    first = {}
    for i, text, _ in FORKS:
        w = text.split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    expected = []
    for i, text, _ in FORKS:
        w = text.split()
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        expected.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    rows = substrings.without_repeats(df).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows) == sorted(expected)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def test_near_duplicates(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for df in (docs, table(spark), table(spark, [])):
        sets = {r.doc_id: shingle_set(r.text) for r in df.collect()}
        root = {i: i for i in sets}
        ids = sorted(sets)
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    lo, hi = sorted((root[a], root[b]))
                    root = {i: lo if r == hi else r for i, r in root.items()}
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(df).collect()}
        assert got == {i: (len(sets[i]), root[i], root[i] == i) for i in ids}
