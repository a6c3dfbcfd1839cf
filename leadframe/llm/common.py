"""What the operators share: shared storage, joins that bear hot keys, distributed ranks, word splitting, bounded caches."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadframe.session import hadoop_path, scratch

#: ASCII white space, as the contracts write it.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"

#: What a worker handles at once: so many rows, and so many bytes of text unless one text alone is longer.
PART_ROWS, PART_BYTES = 1000, 4_000_000

#: A key with more than this part of a table's rows is joined by broadcast; there are fewer than HOT_PART such keys.
HOT_PART = 1000

#: Row keys that a broadcast holds at most (some 16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

#: The column that tells a stored table's rows apart, whatever their ids.
ROW = "_leadframe_row"


_folder: ContextVar[str | None] = ContextVar("leadframe_folder", default=None)


def trim() -> None:
    """Gives memory that is free within a worker back to the system; workers outlive their tasks, and several wait beside those that run."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that trims its worker before its first batch and after its last."""
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        yield from run(batches)
        trim()

    return both


def small_parts(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, cut so that none has more than PART_ROWS rows or PART_BYTES bytes in `column`, single rows excepted."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("i8")
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, "right"))
            to = min(max(to, at + 1), at + PART_ROWS)
            yield batch.slice(at, to - at)
            at = to


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the run's folder, or in the shared folder; there it is removed when the application ends."""
    if inside := _folder.get():
        return f"{inside}/{label}-{uuid.uuid4().hex}"
    return f"{scratch(spark, label)}/data"


def removed(spark: SparkSession, path: str) -> None:
    system, where = hadoop_path(spark, path)
    system.delete(where, True)


@contextmanager
def run_folder(spark: SparkSession, label: str, keep: bool = False) -> Iterator[str]:
    """Intermediate tables made within share one folder, whose path it gives. It goes at the end, so what is to stay must have been written elsewhere; with keep it stays."""
    path = fresh_path(spark, label)
    token = _folder.set(path)
    try:
        yield path
    finally:
        _folder.reset(token)
        if not keep:
            removed(spark, path)


@contextmanager
def arrow_parts(spark: SparkSession) -> Iterator[None]:
    """Jobs that run within hand texts to Python in parts of PART_ROWS and PART_BYTES, which bounds the JVM's buffers as well; the session's settings come back at the end."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(PART_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(PART_BYTES)}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage ends there, and lost executors take nothing with them."""
    spark = df.sparkSession
    path = path or fresh_path(spark, label)
    with arrow_parts(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """After large tables have been stored: the executors' shuffle files go once the driver has collected the plans that made them, which a quiet driver does late."""
    gc.collect()
    spark._jvm.System.gc()


def joined(rows: DataFrame, groups: DataFrame, on: list[str], total: int, how: str = "inner", count: str = "n") -> DataFrame:
    """rows joined with groups (inner, left or left_semi), a table with one row for each key of non-null columns `on`, `count` of them in rows.

    Keys that have more than 1/HOT_PART of all `total` rows are fewer than HOT_PART: they are broadcast, so their rows stay
    where they are; the other keys are shuffled, and none of them is large.
    """
    is_hot = F.col(count) * HOT_PART > total
    hot, cold = F.broadcast(groups.where(is_hot)), groups.where(~is_hot)
    first = rows.join(hot, on, "left_semi" if how == "left_semi" else "inner")
    return first.unionByName(rows.join(hot, on, "left_anti").join(cold, on, how))


def without_rows(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """keyed without the rows whose ROW is in gone, a stored table. Up to BROADCAST_ROWS keys are broadcast and keyed stays where it is; more are shuffled."""
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(gone) if few else gone, ROW, "left_anti")


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, whole text (null: empty) and the columns named; whatever else docs has is not looked at."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def with_rows(docs: DataFrame, label: str) -> DataFrame:
    """docs, stored, with a key of each row in ROW: written once, so it is the same at each read."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), label)


def with_slots(df: DataFrame, group: list[str], tie: list[str], label: str, rows_per_bucket: int = 8192) -> DataFrame:
    """df with `slot`, gapless from 0 in each group, in the order of a hash of `tie`.

    A group may hold any share of the rows: rows are dealt into hash buckets of about rows_per_bucket rows, each bucket is
    numbered by itself and starts where the counts of the buckets before it end. df must be a stored table.
    """
    n = df.count()
    bits = max(0, int(np.ceil(np.log2(max(1, n / rows_per_bucket)))))
    keyed = df.withColumn("_h", F.xxhash64(F.lit(label), *tie)).withColumn("_b", F.shiftrightunsigned("_h", 64 - bits) if bits else F.lit(0).cast("long"))
    counts = keyed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*group, "_b").orderBy("_h", *tie)
    return keyed.join(starts, [*group, "_b"]).withColumn("slot", F.col("_start") + F.row_number().over(own) - 1).drop("_h", "_b", "_start")


class WordCache:
    """word -> value for the words of an executor's batches, with a bound on its size.

    A word that is looked up for the first time takes the next place; new words get their values together, after a part's
    words have all been looked up. When the bound is reached the half that came first stays: frequent words come early.
    """

    def __init__(self, make: Callable[[list], Iterable], most: int = 120_000, mean_len: int = 20):
        self.make, self.most, self.mean_len = make, most, mean_len
        self._keep([])

    def _keep(self, words: list) -> None:
        self.place_of = defaultdict(count(len(words)).__next__, zip(words, range(len(words)), strict=True))
        self.length = sum(map(len, words))
        self._cut(len(words))

    def _cut(self, n: int) -> None:
        self.data = getattr(self, "data", [])[:n]

    def _add(self, values: Iterable) -> None:
        self.data.extend(values)

    def _learn(self) -> None:
        if new := list(islice(self.place_of, len(self), None)):
            self.length += sum(map(len, new))
            self._add(self.make(new))

    def shrink(self, n: int) -> None:
        """Keeps the n words that came first, so that a worker that waits holds little."""
        if len(self) > n:
            self._keep(list(islice(self.place_of, n)))

    def _bound(self) -> None:
        if len(self) > self.most or self.length > self.most * self.mean_len:
            kept = list(islice(self.place_of, self.most // 2))
            self._keep(kept if sum(map(len, kept)) <= self.most * self.mean_len // 2 else [])

    def __len__(self) -> int:
        return len(self.data)

    def values(self, cut: list[list]) -> list[list]:
        """The values of each text's words, in order."""
        self._bound()
        places = [list(map(self.place_of.__getitem__, own)) for own in cut]
        self._learn()
        return [list(map(self.data.__getitem__, own)) for own in places]


class HashCache(WordCache):
    """A cache of 64-bit numbers, which come as arrays."""

    def _cut(self, n: int) -> None:
        self.used, self.numbers = n, getattr(self, "numbers", np.zeros(1024, "u8"))

    def _add(self, values: Iterable) -> None:
        new = np.array(list(values), "u8")
        if self.used + len(new) > len(self.numbers):
            self.numbers = np.concatenate([self.numbers[: self.used], np.zeros(max(self.used, len(new)) + len(new), "u8")])
        self.numbers[self.used : self.used + len(new)] = new
        self.used += len(new)

    def __len__(self) -> int:
        return self.used

    def values(self, cut: list[list]) -> list[np.ndarray]:
        self._bound()
        places = [np.fromiter(map(self.place_of.__getitem__, own), "i8", len(own)) for own in cut]
        self._learn()
        return [self.numbers[own] for own in places]


_WORDS = re.compile(r"[^\W_]+")


def plain_words(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _WORDS.findall(text.lower())


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
