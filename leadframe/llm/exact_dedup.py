"""Exact dedup by progressive refinement, in DataFrame operations only.

Rows are told apart by the length of their normalised text, then by the hash of its first characters, and only what still
shares both is grouped by the full hash. Only lengths and hashes are shuffled, never text: the scan derives them, and the
contract's digest of every row is the full hash itself, so no second read of the texts is needed. A length, prefix or text that
a large part of all rows has is joined by broadcast, so its rows never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, SPACE_CLASS, documents, joined, stored, with_rows, without_rows

PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """text without ASCII white space."""
    return F.regexp_replace(text, f"{SPACE_CLASS}+", "")


def exact_dedup(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when their normalised forms are; null counts as empty, and empty texts are equal. Of a group the row
    with the most code points stays, then the smallest doc_id (a null id comes last), then the first of repeated rows, so
    exactly one row of each group has kept. An empty table gives an empty result; other columns are not looked at.
    """
    return _marked(docs, F.monotonically_increasing_id(), prefix_chars).drop("row")


def _marked(docs: DataFrame, row: Column, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """What exact_dedup gives, and the key of each row."""
    text = F.col("text")
    rows = documents(docs, row.alias("row")).select(
        "doc_id",
        F.char_length(text).cast("long").alias("n_chars"),
        F.octet_length(normalised(text)).alias("norm_len"),
        F.xxhash64(F.substring(normalised(text), 1, prefix_chars)).alias("prefix"),
        F.sha2(F.encode(normalised(text), "UTF-8"), 256).alias("text_sha256"),
        "row",
    )
    rows = stored(rows, "exact")
    total = rows.count()
    lengths = rows.groupBy("norm_len").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    same_length = joined(rows, lengths, ["norm_len"], total, "left_semi")
    prefixes = same_length.groupBy("norm_len", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    best = F.min(F.struct((-F.col("n_chars")).alias("shortness"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = joined(rows, stored(prefixes, "prefixes"), ["norm_len", "prefix"], total, "left_semi").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
    groups = stored(groups.where("n > 1"), "groups")
    return joined(rows, groups, ["text_sha256"], total, "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("row") == F.col("best.row"))).alias("kept"),
        "text_sha256",
        "n_chars",
        "row",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns: one of each group of equal texts, whatever its ids.

    Rows are decided one by one: repeated rows of a doc_id and rows with a null doc_id are copies like any others.
    """
    keyed = with_rows(docs, "exact-rows")
    gone = stored(_marked(keyed, F.col(ROW)).where("NOT kept").select(F.col("row").alias(ROW)), "exact-gone")
    return without_rows(keyed, gone).select(*docs.columns)


SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS m FROM documents),
h AS (SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(m) AS text_sha256 FROM n),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS size FROM h)
SELECT doc_id, keep_id, size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256, n_chars FROM w
"""
