"""Plain file sources and sinks: catalogues of files, JSON arrays, path lists, CSV, segments, results, configurations, run folders."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadframe.session import hadoop_path


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header; an empty field is null."""
    return spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def write_table(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replaces a table as a whole: parquet, or CSV with a header that `csv` reads back, blank strings as nulls."""
    out = rows.write.mode("overwrite")
    out.option("header", "true").option("escape", '"').option("quoteAll", "true").csv(path) if kind == "csv" else out.parquet(path)


#: The rows that a split of a hub corpus has: fixed values.
SPLIT_ROWS = {"train": 400_000, "test": 20_000}
TRAIN_ROWS = {"ecg-instruct-45k-250-1250": 63_062}


def hub_split(spark: SparkSession, path: str, corpus: str, split: str, index: str = "row_idx") -> DataFrame:
    """The first rows of a split, in file order, from its parquet export, which has each row's number in `index`: a predicate that reaches the scan."""
    if split not in SPLIT_ROWS:
        raise ValueError(f"unknown split {split}")
    most = TRAIN_ROWS.get(corpus, SPLIT_ROWS[split]) if split == "train" else SPLIT_ROWS[split]
    return spark.read.parquet(path).where(F.col(index) < most)


def write_segments(segments: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Writes segments, reads them back and returns keys and reason of those that are not whole: none, or an empty signal.

    Parquet's commit leaves no half-written file; a missing key or an empty array is what could still go wrong.
    """
    segments.write.mode("overwrite").parquet(path)
    back = segments.sparkSession.read.schema(segments.schema).parquet(path)
    sizes = back.select(*keys, F.size("signal").alias("_n"))
    both = segments.select(*keys).join(sizes, keys, "left")
    return both.where(F.col("_n").isNull() | (F.col("_n") < 1)).select(*keys, F.when(F.col("_n").isNull(), "missing").otherwise("empty").alias("reason"))


def write_json(rows: DataFrame, path: str) -> None:
    """One object a line, in as many files as there are partitions; `json_lines` reads it back."""
    rows.write.mode("overwrite").json(path)


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_path_list(paths: DataFrame, column: str, path: str) -> None:
    paths.select(F.col(column).cast("string")).where(F.trim(column) != "").write.mode("overwrite").text(path)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    system, where = hadoop_path(spark, path)
    out = system.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_config(spark: SparkSession, config, path: str) -> None:
    """A dataclass or dictionary as one JSON object."""
    plain = dataclasses.asdict(config) if dataclasses.is_dataclass(config) else dict(config)
    _write_text(spark, path, json.dumps(plain, indent=2, sort_keys=True, ensure_ascii=False))


def read_config(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect()))  # one small file


def write_result(report: DataFrame, checkpoint: str) -> str:
    """A one-row report as JSON beside a checkpoint, under the checkpoint's name; the path."""
    path = checkpoint.rpartition(".")[0] + ".json" if "." in checkpoint.rpartition("/")[2] else checkpoint + ".json"
    _write_text(report.sparkSession, path, json.dumps(report.first().asDict(recursive=True), default=str, sort_keys=True))
    return path


def rank_frequency(counts: DataFrame, freq: str) -> DataFrame:
    """rank, freq, tokens: what a rank-frequency plot shows, one row for each frequency: the first of its ranks and how many tokens have it."""
    from pyspark.sql import Window

    by = counts.groupBy(F.col(freq).alias("freq")).agg(F.count(F.lit(1)).alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy(F.desc("freq"))) - F.col("tokens")  # a row for each frequency
    return by.select((before + 1).alias("rank"), "freq", "tokens")


def histogram(rows: DataFrame, value: Column, bins: int = 30) -> DataFrame:
    """bin, low, high, n: equal bins from the least to the greatest value, the last one closed; empty bins have 0."""
    given = rows.select(value.cast("double").alias("v"))
    extent = given.agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    own = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("_lo")) / width), F.lit(bins - 1).cast("long"))).otherwise(F.lit(0).cast("long"))
    counts = given.where("v IS NOT NULL").crossJoin(F.broadcast(extent)).groupBy(own.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row
    edges = rows.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(extent))
    return edges.join(counts, "bin", "left").select("bin", (F.col("_lo") + F.col("bin") * width).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def token_spans(encoded: DataFrame, key: str, ids: str, lengths: dict[int, int]) -> DataFrame:
    """key, place, id, first, past: which stretch of a symbol string each id covers; lengths: of each id's piece."""
    from pyspark.sql import Window

    table = F.create_map(*[F.lit(x).cast("long") for pair in lengths.items() for x in pair])
    rows = encoded.select(key, F.posexplode(F.col(ids).cast("array<bigint>")).alias("place", "id")).withColumn("n", F.element_at(table, F.col("id")))
    past = F.sum("n").over(Window.partitionBy(key).orderBy("place"))
    return rows.select(key, F.col("place").cast("long").alias("place"), "id", (past - F.col("n")).alias("first"), past.alias("past"))


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Files that each hold one JSON array of objects."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """path: the lines of a text list, trimmed, without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def catalogue(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """name, path of the files with a suffix, path without it; name is the base name up to its first period. Of equal names the last path wins. Contents are not read, and empty files are not listed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path).select("path")
    bare = found.select(F.substring_index(F.element_at(F.split("path", "/"), -1), ".", 1).alias("name"), F.expr(f"substring(path, 1, length(path) - {len(suffix)})").alias("path"))
    return bare.groupBy("name").agg(F.max("path").alias("path"))


def exams(parts: DataFrame) -> DataFrame:
    """exam_id, tracing of an export (part, idx, exam_id, tracing): of equal ids that of the last part, then the last index."""
    return parts.groupBy("exam_id").agg(F.max_by("tracing", F.struct("part", "idx")).alias("tracing"))


def next_run(spark: SparkSession, root: str) -> str:
    """A new folder under root, named by the integer after the largest there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()] if fs.exists(path) else []
    new = f"{root.rstrip('/')}/{max((int(n) for n in names if n.isdigit()), default=-1) + 1}"
    fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(new))
    return new
