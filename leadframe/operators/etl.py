"""Catalogue, mapping, mixing, sampling and split operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from leadframe.functions import hash32, uniform


def report_text(columns: list[str]) -> Column:
    """Report parts joined by a space; nulls are skipped."""
    return F.concat_ws(" ", *columns)


def without_empty_reports(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.dropna(how="all", subset=columns)


def complete(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without a null or blank string, and the number of the others."""
    bad = F.lit(False)
    for name, kind in rows.dtypes:
        c = F.col(name)
        bad = bad | (c.isNull() | (F.trim(c) == "") if kind == "string" else c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull())
    return rows.where(~bad), rows.where(bad).agg(F.count(F.lit(1)).alias("dropped"))


def basename(path: Column) -> Column:
    """Last path part, up to the first dash."""
    return F.substring_index(F.substring_index(path, "/", -1), "-", 1)


def last_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of rows with one key the last in order: a partial aggregate, no window."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def expanded(instances: DataFrame, segments: DataFrame, keys: list[str], most: int = 100) -> DataFrame:
    """One row for each segment that an instance has: an equi-join on data set and key, indices under `most`."""
    return instances.join(segments.where(F.col("seg_idx") < most), keys)


def aligned(left: DataFrame, right: DataFrame, pattern: str = r"(\d+)_(\d+)") -> DataFrame:
    """Names of two listings that carry equal numeric keys; of one key the last name wins."""
    def keyed(rows: DataFrame, name: str) -> DataFrame:
        k = [F.regexp_extract("name", pattern, i).try_cast("long").alias(f"k{i}") for i in (1, 2)]
        return rows.select(*k, "name").where("k1 IS NOT NULL AND k2 IS NOT NULL").groupBy("k1", "k2").agg(F.max("name").alias(name))

    return keyed(left, "left_name").join(keyed(right, "right_name"), ["k1", "k2"])


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Order-preserving dedup: the first row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")


def sample_exact(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows (or all) with the smallest hashes of key. Only the hash bucket in which the n-th row lies is sorted."""
    hashed = rows.withColumn("_h", hash32(F.col(key), seed)).withColumn("_b", F.shiftright("_h", 16))
    below, edge = 0, None
    for bucket, count in sorted((r["_b"], r["n"]) for r in hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()):  # 65536 buckets at most
        if below + count > n:
            edge = bucket
            break
        below += count
    if edge is None:
        return rows
    rest = hashed.where(F.col("_b") == edge).orderBy("_h", key).limit(n - below)
    return hashed.where(F.col("_b") < edge).unionByName(rest).drop("_h", "_b")


def sample_fraction(rows: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    if not 0 <= fraction <= 1:
        raise ValueError("a fraction lies between 0 and 1")
    return sample_exact(rows, key, max(1, int(fraction * rows.count())), seed)


def folds(rows: DataFrame, patient: str, k: int = 5, seed: int = 42) -> DataFrame:
    """rows with fold 1..k by patient, so no patient is in two folds."""
    return rows.withColumn("fold", (F.pmod(F.floor(hash32(F.col(patient), seed) / 65536), F.lit(k)) + 1).cast("int"))


def mixed(*parts: DataFrame) -> DataFrame:
    """Bag union in the order given, with the ordinal of each part."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def key_of(corpus: str, path: Column) -> Column:
    """The segment key of a corpus' path; null where the corpus' rule has none."""
    parts = F.split(path, "/")
    after = lambda n: F.array_join(F.slice(parts, F.lit(n + 1), F.greatest(F.size(parts) - n, F.lit(0))), "_")
    last, first = F.element_at(parts, -1), F.element_at(parts, 1)
    ptb = lambda stem: F.concat(F.lit("records500_"), F.substring(stem, 1, 2), F.lit("000_"), stem)
    if corpus in ("ecg_instruct_45k", "pretrain_mimic"):
        return F.array_join(parts, "_")
    if corpus.startswith("ecg-qa"):
        return after(2)
    if corpus.startswith("ecg_grounding"):
        return F.when(first == "mimic-iv", after(1)).when(first == "ecg_ptbxl_benchmarking", after(3)).when(first == "code15", last)
    if corpus == "ecg_instruct_pulse":
        stem = F.concat(F.substring_index(last, "_", 1), F.lit("_hr"))
        middle = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
        mimic = F.array_join(F.concat(F.array(F.lit("files")), middle, F.array(F.substring_index(last, "-", 1))), "_")
        return F.when(first.isin("mimic_v4", "mimic"), mimic).when(first == "ptb-xl", ptb(stem)).when(first == "code15_v4", F.substring_index(last, "-", 1))
    if corpus in ("ecgqa-test", "ptb-test-report", "ptb-test"):
        return ptb(path)
    if corpus == "code15-test":
        return F.substring_index(path, "-", 1)
    if corpus in CATALOGUED:
        raise ValueError(f"{corpus} is looked up in a catalogue: catalogued_keys")
    raise ValueError(f"unsupported corpus {corpus}")


#: Corpora whose items name a file alone, and the data set whose catalogue has its path.
CATALOGUED = {"cpsc-test": "cpsc", "csn-test-no-cot": "csn"}


def catalogued_keys(items: DataFrame, file_name: str, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items with key, the catalogue's path of their file with `_` for `/`, and the items whose file it does not have.

    catalogue: name, path; of several paths of one name the last counts.
    """
    paths = catalogue.groupBy(F.col("name").alias(file_name)).agg(F.replace(F.max("path"), F.lit("/"), F.lit("_")).alias("key"))
    both = items.join(paths, file_name, "left")
    return both.where("key IS NOT NULL"), both.where("key IS NULL").drop("key")


#: Rate and shape (samples, leads) that a data set's recordings must have; null: any.
SHAPES = {"mimic": (500, 5000, 12), "ptb": (500, 5000, 12), "csn": (500, 5000, 12), "code15": (400, 4096, 12), "cpsc": (500, None, None)}


def rejections(dataset: Column, rate: Column, samples: Column, leads: Column) -> Column:
    """Why a recording is not taken: its data set, rate or shape; null where it is."""
    reason = F.when(~F.coalesce(dataset.isin(*SHAPES), F.lit(False)), "dataset")
    for name, (hertz, n, k) in SHAPES.items():
        reason = reason.when((dataset == name) & ~F.coalesce(rate == hertz, F.lit(False)), "rate")
        if n is not None:
            reason = reason.when((dataset == name) & ~F.coalesce((samples == n) & (leads == k), F.lit(False)), "shape")
    return reason


def instance_rejections(samples: Column, report: Column) -> Column:
    """Why an instance is not kept: no signal, or no report."""
    return F.when(~F.coalesce(samples > 0, F.lit(False)), "signal").when(F.coalesce(report, F.lit("")) == "", "report")


def input_rejections(signal: Column) -> Column:
    """Why a signal (an array of leads) does not go to a tokenizer: it is missing, empty, or has a NaN."""
    numbers = F.flatten(signal)
    return F.when(signal.isNull() | numbers.isNull(), "missing").when(F.size(numbers) == 0, "empty").when(F.exists(numbers, lambda x: x.isNull() | F.isnan(x)), "nan")


def taken(rows: DataFrame, reason: Column, name: str = "taken") -> tuple[DataFrame, Observation]:
    """The rows without a reason against them, and counts of rows seen and skipped, known once the rows have been computed."""
    counts = Observation(name)
    marked = rows.withColumn("_reason", reason)
    seen = marked.observe(counts, F.count(F.lit(1)).alias("seen"), F.count("_reason").alias("skipped"))
    return seen.where("_reason IS NULL").drop("_reason"), counts


def catalogue_sample(rows: DataFrame, key: str, dev: int | None = None, toy: bool = False) -> DataFrame:
    """The first `dev` rows in the order of key if dev is given, then an exact sample of 60 % of what is left if toy."""
    if dev is not None:
        rows = rows.orderBy(key).limit(dev)
    return sample_fraction(rows, key, 0.6) if toy else rows


def paired_fraction(left: DataFrame, right: DataFrame, position: str, fraction: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The same positions of two lists, a fraction of them."""
    kept = sample_fraction(left.select(position), position, fraction, seed)
    return left.join(kept, position, "left_semi"), right.join(kept, position, "left_semi")


def ranked(rows: DataFrame, order: list[str], folder: str, name: str = "pos") -> DataFrame:
    """rows with their place in the order of all, from 0: sorted in ranges, each numbered from where those before it end. Ties go by the order of the columns given, so these should tell rows apart.

    The sorted rows are written under folder, so that a range is the same at both reads.
    """
    spark = rows.sparkSession
    sorted_rows = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    sorted_rows.write.mode("overwrite").parquet(folder)
    back = spark.read.schema(sorted_rows.schema).parquet(folder)
    counts = back.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # a row for each range
    own = Window.partitionBy("_part").orderBy(*order)
    return back.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.row_number().over(own) - 1).drop("_part", "_start")


def shuffled(rows: DataFrame, key: str, epoch: int, shards: int = 1, seed: int = 0) -> DataFrame:
    """rows with shard and pos: an order drawn anew for each epoch and dealt to shards in turn, as a distributed sampler deals it.

    All shards get equally many rows: the first rows come again at the end where the number does not divide. Ranks come from
    the counts of 65536 hash buckets, so no task orders more than a bucket.
    """
    drawn = rows.withColumn("_h", uniform(seed * 1_000_003 + epoch, F.col(key))).withColumn("_b", F.floor(F.col("_h") * 65536))
    counts = drawn.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_all"))  # 65536 rows at most
    own = Window.partitionBy("_b").orderBy("_h", key)
    placed = drawn.join(F.broadcast(starts), "_b").withColumn("_at", F.col("_start") + F.row_number().over(own) - 1)
    whole = F.ceil(F.col("_all") / shards) * shards
    dealt = placed.withColumn("_at", F.explode(F.sequence("_at", whole - 1, "_all")))
    return dealt.withColumn("shard", (F.col("_at") % shards).cast("int")).withColumn("pos", F.floor(F.col("_at") / shards)).drop("_h", "_b", "_start", "_all", "_at")


def segment_stem(path: Column, index: Column) -> Column:
    return F.concat_ws("_", F.replace(path, F.lit("/"), F.lit("_")), index.cast("string"))


def decoded(text: Column, schema: str) -> Column:
    """JSON of a schema, null where it does not parse; the raw text stays beside it."""
    return F.from_json(text, schema)


#: What a representation of the signal may be joined with.
_VISION = {"clip-vit-base-patch32", "siglip-base-patch16-224", "vit-base-patch16-224-in21k"}
ENCODERS = {"token": {None, "signal2vec"}, "image": _VISION, "stacked_signal": _VISION, "signal": {"signal2vec", "merl", "st_mem", "mtae", "mlae", "projection"}}


def check_encoder(representation: str, encoder: str | None) -> None:
    """Raises where the encoder does not take the representation."""
    if representation not in ENCODERS:
        raise ValueError(f"unknown representation {representation}")
    if encoder not in ENCODERS[representation]:
        raise ValueError(f"{representation} does not go with encoder {encoder}")


def line_counts(texts: DataFrame, text: str, comment: str = "#") -> DataFrame:
    """lines, code_lines: all lines, and those that are neither blank nor begin with the comment sign."""
    line = texts.select(F.explode(F.split(F.col(text), "\n")).alias("line"))
    code = (F.trim("line") != "") & ~F.startswith(F.trim("line"), F.lit(comment))
    return line.agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(code, 1)).alias("code_lines"))


def runs(rows: DataFrame, keys: list[str], order: list[str], inside: Column) -> DataFrame:
    """keys, first, past: half-open position ranges of neighbouring rows for which `inside` holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    placed = rows.select(*keys, *order, (F.row_number().over(w) - 1).cast("long").alias("_at"), F.coalesce(inside, F.lit(False)).alias("_in"))
    island = placed.where("_in").withColumn("_g", F.col("_at") - F.row_number().over(w))
    return island.groupBy(*keys, "_g").agg(F.min("_at").alias("first"), (F.max("_at") + 1).alias("past")).drop("_g")
