"""The SQL surface: tables as views, and the operators as functions that SQL text can call."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadframe.functions import kernels
from leadframe.operators import text, tokens

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LETTERS = np.array(list("abcdefghijklmnopqrstuvwxyz"))


def views(spark: SparkSession, folder: str) -> None:
    """A temporary view of each table in a folder."""
    for t in TABLES:
        spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(t)


def symbols_of(values: np.ndarray) -> str:
    """Letters of one signal: NaN and infinities are 0, then min-max over all of it and 26 levels."""
    x = np.nan_to_num(np.asarray(values, "f8"), nan=0.0, posinf=0.0, neginf=0.0)
    if not len(x):
        return ""
    unit = np.clip((x - x.min()) / (x.max() - x.min() + 1e-6), 0, 1)
    return "".join(LETTERS[np.minimum(np.floor(unit * 26), 25).astype(int)])


def register(spark: SparkSession, merges: list[tokens.Merge] | None = None) -> None:
    """SQL functions, by name.

    clean_text(text), answer_of(text): SQL bodies, so Catalyst sees through them. symbolise(array<double>) string,
    encode_symbols(string) array<int>, decode_symbols(array<int>) string: Arrow functions; the latter two need merges.
    signal_features(double) array<double>: an aggregate over a group's values in their order of arrival. segments_of(array<double>,
    int): a table function with idx and segment, whole windows only.
    """
    body = lambda name, arguments, column: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS STRING RETURN {column}")
    roles, tags = text.ROLES, r"(?i)<\\s*(?:ecg|image)\\s*>\\s*"
    signal = rf"regexp_replace(regexp_replace(regexp_replace(t, '{tags}', ''), '\\bI(?i:mage)\\b', 'Signal'), '\\bi(?i:mage)\\b', 'signal')"
    body("clean_text", "t STRING", rf"regexp_replace({signal}, '^\\s*(?:[:：]\\s*|(?i:{roles})\\s*:\\s*)+', '')")

    @F.pandas_udf("string")
    def symbolise(column: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else symbols_of(x) for x in column], dtype=object)

    @F.pandas_udf("array<double>")
    def signal_features(column: pd.Series) -> list[float]:
        return kernels.lead_features(column.to_numpy(), 250.0)

    @F.udtf(returnType="idx: int, segment: array<double>")
    class SegmentsOf:
        def eval(self, values: list[float], length: int) -> Iterator[tuple[int, list[float]]]:
            for i in range(len(values or []) // length):
                yield i, values[i * length : (i + 1) * length]

    spark.udf.register("symbolise", symbolise)
    spark.udf.register("signal_features", signal_features)
    spark.udtf.register("segments_of", SegmentsOf)
    if merges is not None:
        trie, pieces = tokens.trie_of(merges), tokens.pieces_of(merges)
        shown = {i: "".join(chr(b) if b < 128 else f"<{b}>" for b in p) for i, p in pieces.items()}

        @F.pandas_udf("array<int>")
        def encode_symbols(column: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else tokens.greedy_ids(t.encode(), trie) for t in column], dtype=object)

        @F.pandas_udf("string")
        def decode_symbols(column: pd.Series) -> pd.Series:
            return pd.Series([None if ids is None else "".join(shown[i] for i in ids) for ids in column], dtype=object)

        spark.udf.register("encode_symbols", encode_symbols)
        spark.udf.register("decode_symbols", decode_symbols)


def query(spark: SparkSession, folder: str, sql: str, merges: list[tokens.Merge] | None = None) -> DataFrame:
    """SQL text over the tables of a folder, with the functions at hand."""
    views(spark, folder)
    register(spark, merges)
    return spark.sql(sql)
