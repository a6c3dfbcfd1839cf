"""Signal operators over the long layout (record, lead, order key, value)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadframe.functions import clean, denormalised, letter, letter_level, level, r6, uniform, unit

#: Lead permutations of the corpora whose recordings come in another order; fixed values.
LEAD_ORDER = {"mimic": [0, 1, 2, 5, 3, 4, 6, 7, 8, 9, 10, 11], "code15": [0, 1, 2, 4, 3, 5, 6, 7, 8, 9, 10, 11]}


def cleaned(samples: DataFrame, value: str = "value") -> DataFrame:
    """samples without NaN and infinities: both become 0, and nulls stay."""
    return samples.withColumn(value, clean(F.col(value)))


def single(samples: DataFrame, value: str = "value") -> DataFrame:
    """samples in single precision, as segments are stored: the cast comes before anything is cut."""
    return samples.withColumn(value, F.col(value).cast("float"))


def records(samples: DataFrame, record: str | list[str], order: list[str], value: str = "value") -> DataFrame:
    """One row per record: low, high, ordered values. One shuffle; a record is bounded by its duration."""
    row = F.struct(*order, clean(F.col(value)).alias("v"))
    return samples.groupBy(record).agg(F.min(clean(F.col(value))).alias("low"), F.max(clean(F.col(value))).alias("high"), F.transform(F.array_sort(F.collect_list(row)), lambda x: x["v"]).alias("values"))


def symbolise(samples: DataFrame, record: str | list[str], order: list[str], value: str = "value") -> DataFrame:
    """record, symbols: min-max over all leads, 26 levels, letters, lead after lead."""
    keys = [record] if isinstance(record, str) else record
    return records(samples, record, order, value).select(*keys, F.array_join(F.transform("values", lambda v: letter(level(unit(v, F.col("low"), F.col("high"))))), "").alias("symbols"))


def reconstruction_error(samples: DataFrame, record: str, value: str = "value") -> DataFrame:
    """record, max_error, span: after quantising and back; the error stays within span / 26. NaN and infinities count as 0, here as in the operators below."""
    samples = cleaned(samples, value)
    bounds = samples.groupBy(record).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    q = level(unit(F.col(value), F.col("low"), F.col("high")))
    back = denormalised(letter_level(letter(q)), F.col("low"), F.col("high"))
    return samples.join(bounds, record).groupBy(record).agg(r6(F.max(F.abs(back - F.col(value)))).alias("max_error"), r6(F.max(F.col("high") - F.col("low"))).alias("span"))


def lead_statistics(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Exact mean, population deviation, extremes and quartiles."""
    samples, v = cleaned(samples, value), F.col(value)
    stats = {"mean": F.avg(v), "std": F.stddev_pop(v), "max": F.max(v), "min": F.min(v), "median": F.percentile(v, 0.5), "p25": F.percentile(v, 0.25), "p75": F.percentile(v, 0.75)}
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[r6(c).alias(k) for k, c in stats.items()])


def with_position(samples: DataFrame, keys: list[str], order: list[str], name: str = "idx") -> DataFrame:
    return samples.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def segments(samples: DataFrame, keys: list[str], order: list[str], length: int) -> DataFrame:
    """samples with idx and seg_idx in whole tumbling windows of `length`; the remainder is dropped."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    placed = with_position(samples, keys, order).withColumn("_n", n)
    return placed.where(F.col("idx") < F.floor(F.col("_n") / length) * length).withColumn("seg_idx", F.floor(F.col("idx") / length)).drop("_n")


def difference_features(samples: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Mean absolute difference and root mean square of differences of neighbours."""
    samples = cleaned(samples, value)
    d = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return samples.withColumn("_d", d).groupBy(*keys).agg(r6(F.avg(F.abs("_d"))).alias("mean_abs_diff"), r6(F.sqrt(F.avg(F.col("_d") * F.col("_d")))).alias("rms_diff"))


def z_scored(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """samples with z: centred, and scaled where the deviation is over 1e-6."""
    samples = cleaned(samples, value)
    stats = samples.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    centred = F.col(value) - F.col("_m")
    return samples.join(stats, keys).withColumn("z", F.when(F.col("_s") > 1e-6, centred / F.col("_s")).otherwise(centred)).drop("_m", "_s")


def stacked_levels(samples: DataFrame, record: str, value: str = "value") -> DataFrame:
    """samples with pixel: 0 to 255, truncated, of the record's min-max; the three channels of a stacked signal are alike."""
    samples = cleaned(samples, value)
    bounds = samples.groupBy(record).agg(F.min(value).alias("_l"), F.max(value).alias("_h"))
    return samples.join(bounds, record).withColumn("pixel", F.floor(unit(F.col(value), F.col("_l"), F.col("_h")) * 255)).drop("_l", "_h")


def reorder_leads(segment: DataFrame, dataset: str, column: str = "signal") -> DataFrame:
    """Lead-major arrays in the target lead order; a lead that is missing is null, and datasets without a permutation pass through."""
    order = LEAD_ORDER.get(dataset)
    return segment if order is None else segment.withColumn(column, F.array(*[F.get(column, F.lit(i)) for i in order]))


def lead_major(samples: DataFrame, record: str, lead: str, order: list[str], value: str = "value") -> DataFrame:
    """record, signal: an array for each lead in the order of lead names, each with its values in order. A record is bounded by its duration."""
    rows = cleaned(samples, value).groupBy(record, lead).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("_r"))
    rows = rows.select(record, lead, F.transform("_r", lambda x: x["_v"]).alias("_x"))
    return rows.groupBy(record).agg(F.transform(F.array_sort(F.collect_list(F.struct(lead, "_x"))), lambda x: x["_x"]).alias("signal"))


def flattened(segment: DataFrame, column: str = "signal") -> DataFrame:
    """Lead after lead in one array: what the encoder-free path takes."""
    return segment.withColumn(column, F.flatten(column))


def blackout(samples: DataFrame, value: str = "value") -> DataFrame:
    """samples with zeros for all values; it comes after noise."""
    return samples.withColumn(value, F.lit(0.0))


def perturbed(samples: DataFrame, record: str, lead: str, order: list[str], sample: str, representation: str, noise: bool = True, black: bool = False, value: str = "value", seed: int = 11) -> DataFrame:
    """samples normalised to [0, 1] of their record, with noise and blackout in the order that the representation has.

    `signal` is normalised first and perturbed then, so its values may leave [0, 1]; `token`, `image` and `stacked_signal` are
    perturbed raw and normalised then.
    """
    if representation not in ("signal", "token", "image", "stacked_signal"):
        raise ValueError(f"unknown representation {representation}")

    def normal(rows: DataFrame) -> DataFrame:
        rows = cleaned(rows, value)
        bounds = rows.groupBy(record).agg(F.min(value).alias("_l"), F.max(value).alias("_h"))
        return rows.join(bounds, record).withColumn(value, unit(F.col(value), F.col("_l"), F.col("_h"))).drop("_l", "_h")

    rows = normal(samples) if representation == "signal" else samples
    rows = noisy(rows, record, lead, order, sample, value, seed) if noise else rows
    rows = blackout(rows, value) if black else rows
    return rows if representation == "signal" else normal(rows)


def captions(samples: DataFrame, record: str, lead: str, value: str = "value") -> DataFrame:
    """record, lead, caption: what stands beside a normalised lead in a prompt, its mean and deviation in three decimals."""
    stats = cleaned(samples, value).groupBy(record, lead).agg(r6(F.avg(value)).alias("m"), r6(F.stddev_pop(value)).alias("s"))  # steady in the order of the sum
    return stats.select(record, lead, F.format_string("ECG Lead %s - sampled at ~250Hz, normalized (mean=%s, std=%s)", lead, three_decimals("m"), three_decimals("s")).alias("caption"))


def three_decimals(column: str) -> Column:
    """Rounded as the binary number is, which decimal casts do not."""
    each = F.pandas_udf(lambda x: pd.Series([None if v is None or v != v else f"{v:.3f}" for v in x], dtype=object), "string")
    return each(column)


def clamp_outliers(rows: DataFrame, row: str, value: str, q: float, exact: bool = False) -> DataFrame:
    """Values clamped to plus and minus a bound on their absolute values; q = 1 leaves them.

    The bound is the mean of each row's q quantile or, if exact, the value at int(q n) of all n in order. That one is found by
    two counts: values in steps of a 4096th of the greatest, then those of one step.
    """
    if q == 1:
        return rows
    size = F.abs(F.col(value))
    if exact:
        n, top = rows.agg(F.count(value), F.max(size)).first()
        step = F.least(F.floor(size / F.lit((top or 0.0) / 4096 or 1.0)), F.lit(4095).cast("long"))
        left, bound = int(q * n), 0.0
        for k, count in sorted((r["k"], r["n"]) for r in rows.where(F.col(value).isNotNull()).groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()):  # 4096 rows at most
            if left < count:
                ranked = rows.where(step == k).select(size.alias("_v")).orderBy("_v").offset(left).limit(1)
                bound = ranked.first()["_v"]
                break
            left -= count
        return rows.withColumn(value, F.greatest(F.least(F.col(value), F.lit(bound)), F.lit(-bound)))
    bound = rows.groupBy(row).agg(F.percentile(size, q).alias("_q")).agg(F.avg("_q").alias("_b"))
    return rows.crossJoin(F.broadcast(bound)).withColumn(value, F.greatest(F.least(F.col(value), F.col("_b")), -F.col("_b"))).drop("_b")  # one row


def patches(samples: DataFrame, size: int, layout: str, record: str, lead: str, value: str = "value") -> DataFrame:
    """Patches as arrays; samples have idx, gapless in each lead, and size divides every lead.

    `time` (record, patch, values): size samples of all leads, sample after sample, the leads of each together. `leads`
    (record, patch, values): a lead is a patch. `lead_time` (record, lead, patch, values): size samples of one lead. A lead
    that is no multiple of size raises when the patches are made.
    """
    i, v = F.col("idx"), F.col(value).alias("_v")
    keys, order = {
        "time": ([record, F.floor(i / size).alias("patch")], ["idx", lead]),
        "leads": ([record, F.col(lead).alias("patch")], ["idx"]),
        "lead_time": ([record, lead, F.floor(i / size).alias("patch")], ["idx"]),
    }[layout]
    made = samples.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, v))), lambda x: x["_v"]).alias("values"), F.size(F.collect_set(lead)).alias("_leads"))
    if layout == "leads":
        return made.drop("_leads")
    whole = F.size("values") == size * F.col("_leads")
    return made.withColumn("values", F.when(whole, F.col("values")).otherwise(F.raise_error(F.lit(f"a lead is no multiple of {size} samples")))).drop("_leads")


def unpatched(rows: DataFrame, record: str, size: int, leads: int) -> DataFrame:
    """record, lead number, idx, value of patches in the `time` layout: the inverse of `patches`."""
    at = F.col("_at")
    return rows.select(record, "patch", F.posexplode("values").alias("_at", "value")).select(record, (at % leads).cast("long").alias("lead"), (F.col("patch") * size + F.floor(at / leads)).alias("idx"), "value")


def patch_size(length: int) -> int:
    """The divisor that gives 16 to 64 patches, nearest to 32; where there is none, the divisor nearest to the root of a 32nd of the length. Ties: the smaller."""
    divisors = [p for p in range(1, length + 1) if length % p == 0]
    if found := [p for p in divisors if 16 <= length // p <= 64]:
        return min(found, key=lambda p: (abs(length // p - 32), p))
    target = int((length / 32) ** 0.5)
    return min(divisors, key=lambda p: (abs(p - target), p))


def noisy(samples: DataFrame, record: str, lead: str, order: list[str], sample: str, value: str = "value", seed: int = 11) -> DataFrame:
    """samples with noise in half the records, 5 % of the record's deviation, and in half of those a baseline wander of 7 % of its largest value, 1 to 5 half cycles in each lead.

    Draws are digests of `sample`, the key of a row, and of `record`, so they do not depend on partitions.
    """
    samples = cleaned(samples, value)
    stats = samples.groupBy(record).agg(F.stddev_pop(value).alias("_s"), F.max(F.abs(F.col(value))).alias("_m"))
    placed = with_position(samples, [record, lead], order, "_i").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(record, lead)))
    own, each = F.col(record), F.col(sample)
    normal = F.sqrt(F.lit(-2.0) * F.log(uniform(seed, each))) * F.cos(F.lit(2.0) * F.pi() * uniform(seed + 1, each))
    cycles = F.floor(uniform(seed + 4, own) * 5) + 1
    wander = F.lit(0.07) * F.col("_m") * F.sin(cycles * F.pi() * F.col("_i") / F.greatest(F.col("_n") - 1, F.lit(1)))
    added = F.lit(0.05) * F.col("_s") * normal + F.when(uniform(seed + 3, own) < 0.5, wander).otherwise(0.0)
    return placed.join(stats, record).withColumn(value, F.col(value) + F.when(uniform(seed + 2, own) < 0.5, added).otherwise(0.0)).drop("_s", "_m", "_i", "_n")


def masked_loss(patches: DataFrame, keys: list[str], target: str, predicted: str, removed: str, standardise: bool = False) -> DataFrame:
    """keys, loss: the mean over removed patches (1 in `removed`) of a patch's mean square error; null where none is removed.

    standardise: a patch's target is centred and divided by the root of its sample variance plus 1e-6.
    """
    n = F.size(target)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    rows = patches
    if standardise:
        mean = total(target) / n
        rows = rows.withColumn("_m", mean).withColumn("_v", total(F.transform(target, lambda x: (x - F.col("_m")) * (x - F.col("_m")))) / (n - 1))
        rows = rows.withColumn(target, F.transform(target, lambda x: (x - F.col("_m")) / F.sqrt(F.col("_v") + F.lit(1e-6))))
    error = total(F.zip_with(predicted, target, lambda p, t: (p - t) * (p - t))) / n
    return rows.select(*keys, F.col(removed).cast("double").alias("_r"), error.alias("_e")).groupBy(*keys).agg((F.sum(F.col("_e") * F.col("_r")) / F.nullif(F.sum("_r"), F.lit(0.0))).alias("loss"))
