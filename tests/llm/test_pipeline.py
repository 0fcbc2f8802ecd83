"""The corpus pipeline: each stage against a plain version or on edge cases, and the size of its plans."""

import random

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sultry.llm.quality_rules import clean_lines
from sultry.llm.secrets import find_spans

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_ string, kept string, cleaned string"
A, B, C = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in rows], SCHEMA)


EDGES = [(None, None), (1, None), (2, ""), (3, A), (4, A), (4, B), (5, C), (5, C), (None, C), (None, B + " more"), (6, "one two"), (7, " \n\t ")]


def test_filter_leaves_the_plan_small(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    whole = size(clean_lines(docs))
    for column in ("kept", "base_failed", "n_repeat_words > 3 and n_lost_words < 5"):
        assert size(clean_lines(docs).where(column)) < 1.5 * whole < 20_000
    assert size(cp.quality(spark, docs, SF)) < 1.5 * whole


@pytest.mark.parametrize("k", range(5))
def test_stage_edges(spark, k):
    name, stage = cp.STAGES[k]
    rows = stage(spark, table(spark, EDGES), SF).collect()
    if k < 4:
        assert all(r.asDict().keys() == set(cp.COLUMNS) for r in rows)
    got = sorted(((r.doc_id, r.text) for r in rows), key=str) if k < 4 else []
    if name == "quality rules":
        assert got == sorted(((i, t) for i, t in EDGES if t and len(t) > 20), key=str)
    elif name == "n-gram Jaccard join":
        assert got == sorted([(None, None), (1, None), (2, ""), (3, A), (4, B), (5, C), (6, "one two"), (7, " \n\t ")], key=str)
    elif k < 4:
        assert got == sorted(EDGES, key=str)
    else:
        assert {r.doc_id for r in rows} == {i for i, _ in EDGES} and all(0 <= r.offset and r.offset + r.length <= 1024 for r in rows)
    assert stage(spark, table(spark, []), SF).count() == 0


def test_decontamination_judges_rows_by_their_text(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first().text
    docs = table(spark, [(1, A), (1, "Before. " + item + " After."), (None, item), (2, B)])
    assert sorted((r.doc_id, r.text) for r in cp.decontamination(spark, docs, SF).collect()) == [(1, A), (2, B)]


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(5)
    base = [[f"w{r.randrange(400)}" for _ in range(60)] for _ in range(6)]
    docs = {}
    for i in range(60):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 9])):
            w[r.randrange(60)] = "z"
        docs[i] = " ".join(w)
    want = {i for i, (_, c) in brute.jaccard(docs, least=80, n=5).items() if c == i}
    assert {x.doc_id for x in cp.near_duplicates(spark, table(spark, list(docs.items())), SF).collect()} == want


def test_whole_pipeline(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    first = {r.doc_id: r.text for r in cp.quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert first.keys() == {i for i, t in docs.items() if not brute.quality(t)[-1]} & first.keys() and len(first) > len(docs) / 2
    alone = {i for i, (_, c) in brute.jaccard(first, least=80, n=5).items() if c == i}
    items = [brute.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = lambda t: any(" " + " ".join(w) + " " in f" {' '.join(brute.words(t))} " for w in items)
    left = {i for i in alone if not held(first[i])}
    rows = cp.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == left
    last = cp.secrets(spark, spark.createDataFrame([(i, first[i], "en", "s", 1) for i in left], "doc_id long, text string, lang string, source string, n_chars long"), SF)
    assert not [r.doc_id for r in last.collect() if [s for s in find_spans(r.text) if s["kind"] != "entropy"]]
    totals = {}
    for r in rows:
        totals[r.sequence_id] = totals.get(r.sequence_id, 0) + r.length
    assert max(totals.values()) <= 1024 and sorted({r.sequence_id for r in rows}) == list(range(len(totals)))
    assert last.agg(F.count("*")).first()[0] == len(left)
