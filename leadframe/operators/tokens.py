"""Symbol tokenisation: pair counts, merge training, greedy encoding, decoding, skip-gram preparation, budgets, padding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadframe.functions import uniform

Merge = tuple[int, int, int, int]


def exploded(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, c: the characters of a string."""
    return rows.select(key, F.posexplode(F.split(text, "")).alias("pos", "c")).where(F.col("c") != "")


def frequencies(ids: DataFrame, column: str) -> DataFrame:
    """id, freq: counts of ids from 0 to the greatest, with zeros; a vocabulary has one entry more than its greatest id."""
    counts = ids.groupBy(F.col(column).alias("id")).agg(F.count(F.lit(1)).alias("freq"))
    every = counts.agg(F.max("id").alias("m")).where("m IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long"))).alias("id"))
    return every.join(counts, "id", "left").select("id", F.coalesce("freq", F.lit(0)).cast("long").alias("freq"))


def pair_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """l, r, n: neighbours within a record, overlapping. A string is cut into characters once; partial counts meet in one shuffle, and no window is needed."""
    chars = F.filter(F.split(F.col(text), ""), lambda c: c != "")
    cut = rows.select(chars.alias("c")).where(F.size("c") > 1)
    pairs = cut.select(F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("l"), F.slice("c", F.lit(2), F.size("c") - 1).alias("r"))).alias("p"))
    return pairs.groupBy("p.l", "p.r").agg(F.count(F.lit(1)).alias("n"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair; ties: the smaller left, then right."""
    return pairs.orderBy(F.desc("n"), "l", "r").limit(1)


def merged(ids: np.ndarray, left: int, right: int, new: int) -> np.ndarray:
    """ids with every (left, right) replaced, left to right and without overlap; of a run of equal ids every other pair counts."""
    at = np.flatnonzero((ids[:-1] == left) & (ids[1:] == right))
    if left == right and len(at):
        starts = np.append(True, np.diff(at) > 1)
        first = at[starts][np.cumsum(starts) - 1]
        at = at[(at - first) % 2 == 0]
    if not len(at):
        return ids
    out, keep = ids.copy(), np.ones(len(ids), bool)
    out[at], keep[at + 1] = new, False
    return out[keep]


def _independent(pairs: list[tuple[int, int, int]], most: int, top: int) -> list[tuple[int, int, int]]:
    """Of pairs by rank as many as are the next merges whatever the merges before them do.

    Pairs that share no id with a merged pair keep their counts, and a pair that a merge makes is no more frequent than one
    that touched the merged ids. So a pair is next as long as it shares no id and is more frequent than all that do.
    """
    out, used, touched = [], set(), pairs[-1][2] if len(pairs) == top else -1  # less frequent pairs than these were not looked at
    for left, right, n in pairs:
        if len(out) == most or out and n <= touched:
            break
        if left in used or right in used:
            touched = max(touched, n)
            continue
        out.append((left, right, n))
        used |= {left, right}
    return out


def train_merges(rows: DataFrame, text: str, merges: int, folder: str, rounds: int = 16, top: int = 1000) -> list[Merge]:
    """(left, right, new id, count) by rank. Pairs do not cross records; a tie goes to the smaller left, then right id.

    Records stay in the cluster: distinct texts with their multiplicity are stored as ids, a job counts pairs in every
    partition and the driver sees the `top` most frequent. A job finds all merges that are independent of each other; every so
    many rounds the ids are written anew under `folder`. Merging goes on down to a count of 1 and ends when no pair is left.
    """
    spark = rows.sparkSession
    seen = rows.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    at, pending, out = 0, [], []

    def flat(batch: pa.RecordBatch, ids_of, todo: list[Merge]) -> tuple[np.ndarray, np.ndarray]:
        """The batch's ids one after the other with -1 after each text, merged, and how often each text occurs."""
        own = [x for t in batch.column(0).to_pylist() for x in (ids_of(t), np.array([-1], "i4"))]
        ids = np.concatenate(own) if own else np.zeros(0, "i4")
        for left, right, new, _ in todo:
            ids = merged(ids, left, right, new)
        return ids, batch.column(1).to_numpy(zero_copy_only=False)

    def packed(ids_of, todo: list[Merge]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, n = flat(batch, ids_of, todo)
                ends = np.flatnonzero(ids == -1)
                starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
                yield pa.RecordBatch.from_pydict({"t": pa.array([ids[a:b].astype("<i4").tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()), "n": pa.array(n, pa.int64())})

        return run

    def counted(todo: list[Merge]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, int] = {}
            for batch in batches:
                ids, n = flat(batch, from_binary, todo)
                text_of = np.cumsum(ids == -1) - (ids == -1)
                whole = (ids[:-1] >= 0) & (ids[1:] >= 0)
                keys, where = np.unique((ids[:-1].astype("i8") << 32 | ids[1:].astype("i8"))[whole], return_inverse=True)
                for k, c in zip(keys.tolist(), np.bincount(where, n[text_of[:-1][whole]], len(keys)).astype("i8").tolist(), strict=True):
                    total[k] = total.get(k, 0) + c
            yield pa.RecordBatch.from_pydict({"l": pa.array([k >> 32 for k in total], pa.int64()), "r": pa.array([k & 0xFFFFFFFF for k in total], pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

        return run

    from_text = lambda t: np.frombuffer(t.encode(), "u1").astype("i4")
    from_binary = lambda t: np.frombuffer(t, "<i4")

    def written(table: DataFrame, ids_of, todo: list[Merge]) -> DataFrame:
        nonlocal at
        path = f"{folder}/ids-{at}"
        at += 1
        table.mapInArrow(packed(ids_of, todo), "t binary, n long").write.mode("overwrite").parquet(path)
        return spark.read.schema("t binary, n long").parquet(path)

    table, done = written(seen, from_text, []), 0
    while len(out) < merges:
        counts = table.mapInArrow(counted(pending), "l long, r long, n long").groupBy("l", "r").agg(F.sum("n").alias("n"))
        best = [(r["l"], r["r"], r["n"]) for r in counts.orderBy(F.desc("n"), "l", "r").limit(top).collect()]
        chosen = _independent(best, merges - len(out), top)
        if not chosen:
            break
        new = [(left, right, 256 + len(out) + k, n) for k, (left, right, n) in enumerate(chosen)]
        out, pending, done = out + new, pending + new, done + 1
        if done % rounds == 0:
            table, pending = written(table, from_binary, pending), []
    return out


def save_merges(spark: SparkSession, merges: list[Merge], path: str) -> None:
    """The merges as a table by rank: a tokenizer is this table."""
    spark.createDataFrame([(k, *m) for k, m in enumerate(merges)], "rank long, left long, right long, id long, n long").coalesce(1).write.mode("overwrite").parquet(path)


def load_merges(spark: SparkSession, path: str) -> list[Merge]:
    return [(r["left"], r["right"], r["id"], r["n"]) for r in spark.read.parquet(path).orderBy("rank").collect()]  # as many rows as a vocabulary has


def pieces_of(merges: list[Merge]) -> dict[int, bytes]:
    out = {i: bytes([i]) for i in range(256)}
    for left, right, new, _ in merges:
        out[new] = out[left] + out[right]
    return out


def trie_of(merges: list[Merge]) -> dict:
    """Nested dictionaries by byte; under None the id of the piece that ends there. Of merges that spell the same bytes the later counts."""
    root: dict = {}
    for i, piece in sorted(pieces_of(merges).items()):
        node = root
        for b in piece:
            node = node.setdefault(b, {})
        node[None] = i
    return root


def greedy_ids(text: bytes, trie: dict) -> list[int]:
    """Longest match from the left; single bytes always match."""
    out, i = [], 0
    while i < len(text):
        node, j, found, end = trie, i, 0, i
        while j < len(text) and (node := node.get(text[j])) is not None:
            j += 1
            if None in node:
                found, end = node[None], j
        out.append(found)
        i = end
    return out


def encode(rows: DataFrame, key: str, text: str, merges: list[Merge]) -> DataFrame:
    """key, ids of each text; a null text has no ids."""
    shared = rows.sparkSession.sparkContext.broadcast(trie_of(merges))  # a vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "ids": [greedy_ids((t or "").encode(), shared.value) for t in batch[text]]})

    return rows.select(key, text).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, ids array<int>")


def decode(encoded: DataFrame, merges: list[tuple[int, int, int, int]], ids: str = "ids") -> Column:
    """The text that ids stand for, as a column: a literal map of pieces, no join. Bytes over 127 show as <n>."""
    shown = {i: "".join(chr(b) if b < 128 else f"<{b}>" for b in p) for i, p in pieces_of(merges).items()}
    table = F.create_map(*[F.lit(x) for pair in shown.items() for x in pair])
    return F.array_join(F.transform(ids, lambda i: F.element_at(table, i)), "")


def skip_gram_pairs(tokens: DataFrame, key: str, pos: str, token: str, width: int) -> DataFrame:
    """center, context, n: all ordered pairs within `width`, a superset of what random half-widths draw."""
    w = Window.partitionBy(key).orderBy(pos)
    around = F.array(*[F.lag(token, k).over(w) for k in range(1, width + 1)], *[F.lead(token, k).over(w) for k in range(1, width + 1)])
    both = tokens.select(F.col(token).alias("center"), around.alias("around")).select("center", F.explode(F.array_compact("around")).alias("context"))
    return both.groupBy("center", "context").agg(F.count(F.lit(1)).alias("n"))


def keep_probability(freq: Column, total: Column, t: float = 1e-5) -> Column:
    share = F.greatest(F.lit(1e-12), freq / F.greatest(F.lit(1), total))
    return F.least(F.lit(1.0), F.sqrt(F.lit(t) / share) + F.lit(t) / share)


def subsampled(tokens: DataFrame, key: str, pos: str, token: str, freq: str, total: str, t: float = 1e-5, seed: int = 42) -> DataFrame:
    """tokens that a draw keeps: each place is kept with its token's probability, by a digest of its key and position."""
    return tokens.where(uniform(seed, F.col(key), F.col(pos)) < keep_probability(F.col(freq), F.col(total), t))


def trainable(sequences: DataFrame, ids: str) -> DataFrame:
    """Sequences of two ids and more. Raises when none is left."""
    left = sequences.where(F.size(ids) > 1)
    if left.isEmpty():
        raise ValueError("no sequence of more than one token is left")
    return left


def signal_tokens(ids: Column, prefix: str = "signal_") -> Column:
    """Names of symbol ids in a language model's vocabulary."""
    return F.transform(ids, lambda i: F.concat(F.lit(prefix), i.cast("string")))


def signal_ids(names: Column, prefix: str = "signal_") -> Column:
    """The ids behind names: names that are none are left out."""
    own = F.filter(names, lambda n: F.startswith(n, F.lit(prefix)) & F.substring(n, len(prefix) + 1, 20).rlike(r"^[0-9]+$"))
    return F.transform(own, lambda n: F.substring(n, len(prefix) + 1, 20).cast("long"))


def extended_vocabulary(spark: SparkSession, base: int, merges: list[Merge], prefix: str = "signal_") -> DataFrame:
    """name, signal_id, id: the names of a tokenizer's ids, numbered after a vocabulary of `base` entries."""
    n = 256 + len(merges)
    return spark.range(n).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("name"), F.col("id").alias("signal_id"), (F.col("id") + base).alias("id"))


def budget(before: Column, ecg: Column, after: Column, length: int, least: int) -> tuple[Column, Column, Column]:
    """Kept signal tokens, kept tokens after them, and left padding for one example. An example whose prompt leaves no room for `least` signal tokens has nulls."""
    total = before + ecg + after
    fits = total <= length
    room = F.least(ecg, F.greatest(F.lit(least), F.lit(length) - before - after))
    bad = ~fits & (before + least > length)
    kept = F.when(bad, None).when(fits, ecg).otherwise(room)
    rest = F.when(bad, None).when(fits, after).otherwise(F.lit(length) - before - room)
    return kept, rest, F.when(bad, None).otherwise(F.greatest(F.lit(0), F.lit(length) - total))


def left_padded(ids: Column, length: int, pad) -> Column:
    """The last `length` ids, padded on the left."""
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(F.lit(0), length - F.size(ids))), F.when(F.size(ids) > length, F.slice(ids, -length, length)).otherwise(ids))
