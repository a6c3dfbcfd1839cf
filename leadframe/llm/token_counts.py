"""Token counts as delta-maintained rollups.

A batch is a table of signed changes: inserts count +1, deletes -1, a revision is a delete of the old count and an insert of
the new one. A batch is summed by source, language and tokenizer version and committed once under its id: its sums are written
to a folder of their own, which is then renamed to the batch's. A batch is there as a whole or not at all, whatever broke or
ran twice. Totals are a snapshot plus the batches committed since; folding takes those into the next snapshot.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_path, removed, small_parts, stored, tidied
from .tokens import byte_bpe, default_path, default_pattern

GROUP = ["source", "lang", "tokenizer"]


def counted(docs: DataFrame, tokenizer: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens, n_bytes of each row; null texts count as empty, with no tokens.

    Repeated rows give repeated rows, null ids, sources and languages stay, an empty table gives an empty result.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in small_parts(batches):
            texts = batch.column("text").to_pylist()
            n = [len(x) for x in bpe.ids(texts)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "source": batch.column("source"), "lang": batch.column("lang"), "tokenizer": pa.array([tokenizer] * len(n), pa.string()), "n_tokens": pa.array(n, pa.int64()), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64())})

    return documents(docs, "source", "lang").mapInArrow(tidied(run), "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_bytes long")


def estimated(docs: DataFrame, tokenizer: str, bytes_per_token: int = 4) -> DataFrame:
    """The same columns with a first estimate of the count, to be revised."""
    n = F.octet_length("text").cast("long")
    return documents(docs, "source", "lang").select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.ceil(n / bytes_per_token).alias("n_tokens"), n.alias("n_bytes"))


def inserts(rows: DataFrame) -> DataFrame:
    return rows.select(*GROUP, F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(*GROUP, F.lit(-1).cast("long").alias("docs"), (-F.col("n_tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """old's rows go, new's rows come; no join is needed, as the sums meet in the rollup."""
    return deletes(old).union(inserts(new))


class Ledger:
    """Batches committed under a shared folder whose file system renames folders as one step (HDFS and POSIX do)."""

    SUMS = "source string, lang string, tokenizer string, docs long, tokens long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _there(self, path: str) -> bool:
        system, where = self._fs(path)
        return system.exists(where)

    def _names(self, folder: str) -> list[str]:
        system, where = self._fs(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []

    def _write_text(self, path: str, text: str) -> None:
        system, where = self._fs(path)
        out = system.create(where, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _read_text(self, path: str) -> str:
        return "".join(self.spark.sparkContext.textFile(path, 1).collect())

    def _publish(self, sums: DataFrame, target: str, note: str) -> bool:
        """Writes sums and a note aside and renames the folder to target. False if another writer's is there, which stays as it is."""
        owner = uuid.uuid4().hex
        aside = f"{self.root}/aside/{owner}"
        sums.write.parquet(aside)
        self._write_text(f"{aside}/note.json", note)
        self._write_text(f"{aside}/owner-{owner}", "")
        system, where = self._fs(target)
        system.mkdirs(where.getParent())
        if not system.exists(where):
            system.rename(self._fs(aside)[1], where)  # a folder that came between takes ours in as a subfolder, or refuses it
        won = self._there(f"{target}/owner-{owner}")
        for left in () if won else (aside, f"{target}/{owner}"):
            removed(self.spark, left)
        return won

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Sums signed changes and commits them under the batch's id (letters, digits, ., _ and -). False, and nothing changes, if the id is there already."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
            raise ValueError(f"no batch id: {batch!r}")
        if self._there(f"{self.root}/batches/{batch}"):
            return False
        sums = changes.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return self._publish(sums, f"{self.root}/batches/{batch}", "{}")

    def _snapshot(self) -> tuple[int, set[str]]:
        """Number of the latest snapshot, 0 if there is none, and the batches in it."""
        numbers = [int(n) for n in self._names("snapshots")]
        if not numbers:
            return 0, set()
        return max(numbers), set(json.loads(self._read_text(f"{self.root}/snapshots/{max(numbers)}/note.json"))["batches"])

    def _sums(self) -> tuple[DataFrame, int, set[str]]:
        number, folded = self._snapshot()
        batches = set(self._names("batches"))
        folders = [f"{self.root}/batches/{b}" for b in sorted(batches - folded)] + [f"{self.root}/snapshots/{number}"] * (number > 0)
        rows = self.spark.read.schema(self.SUMS).parquet(*[f"{f}/part-*" for f in folders]) if folders else self.spark.createDataFrame([], self.SUMS)
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), number, batches | folded

    def fold(self) -> bool:
        """Takes all committed batches into a new snapshot. False if another writer made that snapshot. Folded batches stay as ids; their sums go."""
        sums, number, batches = self._sums()
        _, before = self._snapshot()
        if number and batches == before:
            return True
        won = self._publish(sums.where("docs <> 0 OR tokens <> 0"), f"{self.root}/snapshots/{number + 1}", json.dumps({"batches": sorted(batches)}))
        if won:
            for n in self._names("snapshots"):
                if int(n) < number:  # the one before stays for those who read it now
                    removed(self.spark, f"{self.root}/snapshots/{n}")
            for b in before:  # in two snapshots by now
                for part in self._names(f"batches/{b}"):
                    if part.startswith("part-"):
                        removed(self.spark, f"{self.root}/batches/{b}/{part}")
        return won

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens after all committed batches; groups without documents are left out, an empty ledger has none.

        Null sources and languages are groups of their own.
        """
        sums, _, _ = self._sums()
        return sums.select(*GROUP, F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")


def maintained(docs: DataFrame, tokenizer: str = "byte_bpe_multi_50k") -> DataFrame:
    """source, lang, tokenizer, n_docs, n_tokens of all of docs, after a life of changes.

    Estimates of all rows are inserted and revised to exact counts; the snapshot takes these in; then a third of the rows, by a
    hash of the id, is deleted and inserted again. Each batch is sent twice. Null and empty texts count as documents without
    tokens, repeated rows as often as they occur, null ids, sources and languages like any others; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ledger = Ledger(spark, fresh_path(spark, "ledger"))
    exact = stored(counted(docs, tokenizer), "counts")
    rough = exact.withColumn("n_tokens", F.ceil(F.col("n_bytes") / 4))
    some = exact.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    for batch, changes in (("1", inserts(rough)), ("2", revisions(rough, exact)), ("3", deletes(some)), ("4", inserts(some))):
        ledger.commit(batch, changes)
        ledger.commit(batch, changes)
        if batch == "2":
            ledger.fold()
    return ledger.totals()
