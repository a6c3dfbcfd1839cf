"""Queries that read whole texts, symbol strings and vectors."""

from __future__ import annotations

from leadframe.plans import registry
from leadframe.session import table

SF = "/root/testdata/sf0.001"


def test_answer_reads_the_end_of_the_text(spark):
    rows = registry.queries()["q71_answer"](spark, SF).join(table(spark, SF, "documents").selectExpr("doc_id", "char_length(text) AS n"), "doc_id").collect()
    assert rows and all(r["n_chars"] <= r["n"] + 12 for r in rows)  # both halves and the mark between them
    assert any(r["n_chars"] > 20 for r in rows)


def test_padding_keeps_every_symbol(spark):
    rows = registry.queries()["q52_ragged_pad"](spark, SF).collect()
    assert sum(x != "-2" for r in rows for x in r["padded"].split()) == table(spark, SF, "events").count()


def test_lookup_reaches_all_vectors_and_unknown_tokens(spark):
    """The range of tokens as the query draws them: up to 99 beyond the last vector."""
    got = {r["event_id"]: r["total"] for r in registry.queries()["q54_vector_lookup"](spark, SF).collect()}
    sums = {r["vec_id"]: sum(r["embedding"]) for r in table(spark, SF, "embeddings").collect()}
    n = max(sums) + 100
    assert len(got) == table(spark, SF, "events").count()
    assert all(abs(v - (0 if i % 7 == 0 else sums.get(i % n, 0))) < 1e-4 for i, v in got.items())
    assert any(i % n > max(sums) for i in got) and max(i % n for i in got if i % n in sums) == max(sums)
