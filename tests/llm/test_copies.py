"""The pipeline's copy stages over null and repeated ids: one row of each group stays."""

from __future__ import annotations

import corpus_pipeline

WORDS = [f"word{i}" for i in range(60)]
BASE = " ".join(WORDS)
NEAR = BASE + " tail"


def left(spark, stage, rows):
    table = spark.createDataFrame(rows, "row int, doc_id long, text string").repartition(3)
    out = stage(spark, table, "")
    assert out.columns == table.columns
    return sorted(((r["doc_id"] or 0, r["text"]) for r in out.collect()), key=str)


def test_exact_copies(spark):
    rows = [(0, 1, "a b"), (1, 2, "ab"), (2, None, "ab"), (3, 4, "own"), (4, 4, "a  b"), (5, 4, "own"), (6, None, "lone"), (7, None, "lone")]
    assert left(spark, corpus_pipeline.without_copies, rows) == [(0, "lone"), (4, "a  b"), (4, "own")]
    assert left(spark, corpus_pipeline.without_copies, []) == []


def test_near_copies(spark):
    other = " ".join(f"else{i}" for i in range(60))
    rows = [(0, 7, BASE), (1, 7, NEAR), (2, None, BASE + " end"), (3, 3, NEAR), (4, 7, other), (5, None, "x y"), (6, None, "x y"), (7, 9, None), (8, 9, None)]
    want = [(0, "x y"), (3, NEAR), (7, other), (9, None), (9, None)]  # texts without a word have no links
    assert sorted(left(spark, corpus_pipeline.without_near_copies, rows), key=str) == sorted(want, key=str)
    assert left(spark, corpus_pipeline.without_near_copies, []) == []
