"""Signal queries. A record is a user's events, a lead an event type, the order within a lead (ts, event_id)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from leadframe.functions import hash32, kernels, r6
from leadframe.operators import schedule, signal
from leadframe.session import table

from .registry import query

LEAD = ["user_id", "event_type"]
ORDER = ["ts", "event_id"]
FLAT = ["event_type", "ts", "event_id"]

R6 = "floor(({}) * 1e6 + 0.5) / 1e6"
BOUNDS = "b AS (SELECT user_id, min(value) AS low, max(value) AS high FROM events GROUP BY 1)"
UNIT = "least(greatest((value - low) / (high - low + 1e-6), 0.0), 1.0)"
LEVEL = f"least(floor({UNIT} * 26), 25)::BIGINT"
SYMBOLS = f"""{BOUNDS}, l AS (SELECT user_id, event_type, ts, event_id, value, low, high, {LEVEL} AS q FROM events JOIN b USING (user_id)),
sym AS (SELECT user_id, string_agg(substr('abcdefghijklmnopqrstuvwxyz', (q + 1)::INT, 1), '' ORDER BY event_type, ts, event_id) AS symbols FROM l GROUP BY 1)"""
PLACED = "p AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)"


def symbols(spark, sf_dir):
    return signal.symbolise(table(spark, sf_dir, "events"), "user_id", FLAT)


@query(f"WITH {SYMBOLS} SELECT user_id, symbols FROM sym")
def q01_symbolise(spark, sf_dir):
    return symbols(spark, sf_dir)


@query("SELECT user_id, event_type, count(*) AS n, " + ", ".join(f"{R6.format(e)} AS {n}" for n, e in {"mean": "avg(value)", "std": "stddev_pop(value)", "max": "max(value)", "min": "min(value)", "median": "quantile_cont(value, 0.5)", "p25": "quantile_cont(value, 0.25)", "p75": "quantile_cont(value, 0.75)"}.items()) + " FROM events GROUP BY 1, 2")
def q02_lead_statistics(spark, sf_dir):
    return signal.lead_statistics(table(spark, sf_dir, "events"), LEAD)


@query(f"WITH {PLACED} SELECT user_id, event_type, (idx // 8)::BIGINT AS seg_idx, idx::BIGINT AS idx, event_id, value FROM p WHERE idx < n // 8 * 8")
def q03_segments(spark, sf_dir):
    rows = signal.segments(table(spark, sf_dir, "events"), LEAD, ORDER, 8)
    return rows.select(*LEAD, "seg_idx", "idx", "event_id", "value")


@query(f"WITH {SYMBOLS} SELECT user_id, {R6.format('max(abs(q / 25.0::DOUBLE * (high - low) + low - value))')} AS max_error, {R6.format('max(high - low)')} AS span FROM l GROUP BY 1")
def q04_reconstruction_error(spark, sf_dir):
    return signal.reconstruction_error(table(spark, sf_dir, "events"), "user_id")


TWELVE = "SELECT user_id // 4 AS record, user_id % 4 || event_type AS lead, ts, event_id, value FROM events"


def twelve_leads(spark, sf_dir):
    """Records of four users, up to twenty leads each: user and event type."""
    lead = F.concat((F.col("user_id") % 4).cast("string"), F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 4).alias("record"), lead.alias("lead"), *ORDER, "value")
    return signal.lead_major(rows, "record", "lead", ORDER)


@query(f"""WITH e AS ({TWELVE}), l AS (SELECT record, lead, row_number() OVER (PARTITION BY record ORDER BY lead) - 1 AS source, count(*) AS n, sum(value) AS total, arg_min(value, (ts, event_id)) AS first FROM e GROUP BY 1, 2)
SELECT record::BIGINT AS record, CASE source WHEN 5 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 ELSE source END::BIGINT AS target, n, {R6.format('total')} AS total, {R6.format('first')} AS first FROM l WHERE source < 12""")
def q05_lead_reorder(spark, sf_dir):
    """The samples of twelve leads in a mimic recording's target order, as count, sum and first value of each place."""
    rows = signal.reorder_leads(twelve_leads(spark, sf_dir), "mimic").select("record", F.posexplode("signal").alias("target", "x")).where("x IS NOT NULL")
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return rows.select("record", F.col("target").cast("long").alias("target"), F.size("x").cast("long").alias("n"), r6(total).alias("total"), r6(F.col("x")[0]).alias("first"))


@query(f"""WITH e AS ({TWELVE}), o AS (SELECT record, value, row_number() OVER (PARTITION BY record ORDER BY lead, ts, event_id) AS i FROM e)
SELECT record::BIGINT AS record, count(*) AS n, {R6.format('sum(value * (i % 97))')} AS weighted FROM o GROUP BY 1""")
def q99_flatten(spark, sf_dir):
    """All leads of a record in one array; its length and a sum weighted by place."""
    rows = signal.flattened(twelve_leads(spark, sf_dir))
    weighted = F.aggregate(F.transform("signal", lambda x, i: x * ((i + 1) % 97)), F.lit(0.0), lambda s, v: s + v)
    return rows.select("record", F.size("signal").cast("long").alias("n"), r6(weighted).alias("weighted"))


@query(f"""WITH d AS (SELECT user_id, event_type, value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS d FROM events)
SELECT user_id, event_type, {R6.format("avg(abs(d))")} AS mean_abs_diff, {R6.format("sqrt(avg(d * d))")} AS rms_diff FROM d GROUP BY 1, 2""")
def q06_differences(spark, sf_dir):
    return signal.difference_features(table(spark, sf_dir, "events"), LEAD, ORDER)


@query(f"WITH {BOUNDS} SELECT event_id, floor({UNIT} * 255)::BIGINT AS pixel, 0.0::DOUBLE AS blackout FROM events JOIN b USING (user_id)")
def q07_stacked_levels(spark, sf_dir):
    rows = signal.stacked_levels(table(spark, sf_dir, "events"), "user_id")
    return signal.blackout(rows, "blackout").select("event_id", "pixel", "blackout")


@query()
def q08_resample(spark, sf_dir):
    """Every lead at half its rate: not-a-knot cubic spline per lead."""
    def run(key, pdf):
        values = kernels.resample(pdf.sort_values(["ts", "event_id"])["value"].to_numpy(), 2.0, 1.0)
        return pd.DataFrame({"user_id": key[0], "event_type": key[1], "idx": np.arange(len(values)), "value": values})

    rows = table(spark, sf_dir, "events").select(*LEAD, *ORDER, "value")
    return rows.groupBy(*LEAD).applyInPandas(run, "user_id long, event_type string, idx long, value double")


@query(f"""WITH s AS (SELECT user_id, event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1, 2)
SELECT event_id, {R6.format("CASE WHEN s > 1e-6 THEN (value - m) / s ELSE value - m END")} AS z FROM events JOIN s USING (user_id, event_type)""")
def q09_z_score(spark, sf_dir):
    return signal.z_scored(table(spark, sf_dir, "events"), LEAD).select("event_id", r6(F.col("z")).alias("z"))


@query(f"""WITH {PLACED}, w AS (SELECT *, idx // 4 AS patch FROM p WHERE idx < n // 4 * 4),
k AS (SELECT user_id, event_type, patch, avg(value * value) AS loss, (((user_id * 31 + patch) * 2654435761 + 7) % 4294967296)::BIGINT AS h, max(n) // 4 AS patches FROM w GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY h, patch) AS rn FROM k)
SELECT user_id, event_type, patch::BIGINT AS patch, (rn > patches * 25 // 100)::INT AS removed, {R6.format("loss")} AS loss FROM r""")
def q89_patch_mask(spark, sf_dir):
    """Patches of 4 samples; the quarter with the smallest hashes is kept, and each has its mean square as reconstruction loss of zeros."""
    from pyspark.sql import Window

    whole = signal.segments(table(spark, sf_dir, "events"), LEAD, ORDER, 4).withColumnRenamed("seg_idx", "patch")
    k = whole.groupBy(*LEAD, "patch").agg(F.avg(F.col("value") * F.col("value")).alias("loss")).withColumn("h", hash32(F.col("user_id") * 31 + F.col("patch"), 7))
    own = Window.partitionBy(*LEAD)
    rank = F.row_number().over(own.orderBy("h", "patch"))
    kept = F.floor(F.count(F.lit(1)).over(own) * 25 / 100)
    return k.select(*LEAD, "patch", (rank > kept).cast("int").alias("removed"), r6(F.col("loss")).alias("loss"))


@query(f"SELECT pos::BIGINT AS pos, dim::BIGINT AS dim, {R6.format('CASE WHEN dim < 8 THEN sin(pos / pow(10000.0, dim / 8.0)) ELSE cos(pos / pow(10000.0, (dim - 8) / 8.0)) END')} AS value FROM range(64) a(pos), range(16) b(dim)")
def q90_sin_cos(spark, sf_dir):
    """64 positions of 16 dimensions, sines first."""
    grid = spark.range(64).select(F.col("id").alias("pos"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("dim"))
    angle = F.col("pos") / F.pow(F.lit(10000.0), F.when(F.col("dim") < 8, F.col("dim")).otherwise(F.col("dim") - 8) / F.lit(8.0))
    return grid.select("pos", "dim", r6(F.when(F.col("dim") < 8, F.sin(angle)).otherwise(F.cos(angle))).alias("value"))


@query()
def q97_lead_features(spark, sf_dir):
    """The 24 features of ten users' flattened signals at 250 Hz: 224 samples and more, so that all five wavelet levels are there."""
    def run(key, pdf):
        values = kernels.lead_features(pdf.sort_values(["user_id", *FLAT])["value"].to_numpy(), 250.0)
        return pd.DataFrame({"record": [key[0]], "features": [values]})

    rows = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 10).alias("record"), "user_id", *FLAT, "value")
    return signal.cleaned(rows).groupBy("record").applyInPandas(run, "record long, features array<double>")


@query(f"""WITH {PLACED}, w AS (SELECT *, lag(value) OVER q AS a, lead(value) OVER q AS c FROM p WINDOW q AS (PARTITION BY user_id ORDER BY event_type, ts, event_id)),
k AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id) - 1 AS i, value > a AND value > c AS peak FROM w),
d AS (SELECT user_id, i - lag(i) OVER (PARTITION BY user_id ORDER BY i) AS rr FROM k WHERE peak)
SELECT user_id, {R6.format("60 / (avg(rr) / 250.0)")} AS heart_rate, {R6.format("stddev_pop(rr / 250.0)")} AS hrv FROM d GROUP BY 1 HAVING count(rr) > 0""")
def q94_heart_rate(spark, sf_dir):
    """Intervals between local maxima of the flattened record at 250 Hz."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(*FLAT)
    rows = table(spark, sf_dir, "events").select("user_id", *FLAT, "value").select("user_id", (F.row_number().over(w) - 1).alias("i"), ((F.col("value") > F.lag("value").over(w)) & (F.col("value") > F.lead("value").over(w))).alias("peak"))
    rr = rows.where("peak").select("user_id", (F.col("i") - F.lag("i").over(Window.partitionBy("user_id").orderBy("i"))).alias("rr"))
    return rr.groupBy("user_id").agg(r6(60 / (F.avg("rr") / 250.0)).alias("heart_rate"), r6(F.stddev_pop(F.col("rr") / 250.0)).alias("hrv"), F.count("rr").alias("n")).where("n > 0").drop("n")


@query(f"WITH q AS (SELECT user_id, quantile_cont(abs(value), 0.95) AS q FROM events GROUP BY 1), b AS (SELECT avg(q) AS b FROM q) SELECT event_id, {R6.format('greatest(least(value, b), -b)')} AS value FROM events, b")
def q98_outlier_clamp(spark, sf_dir):
    """Clamped to the mean of the records' 95 % quantiles."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return signal.clamp_outliers(rows, "user_id", "value", 0.95).select("event_id", r6(F.col("value")).alias("value"))


@query(f"WITH o AS (SELECT abs(value) AS v, row_number() OVER (ORDER BY abs(value)) - 1 AS i, count(*) OVER () AS n FROM events), b AS (SELECT max(v) AS b FROM o WHERE i = floor(0.95 * n)) SELECT event_id, {R6.format('greatest(least(value, b), -b)')} AS value FROM events, b")
def q107_outlier_clamp_exact(spark, sf_dir):
    """Clamped to the value at 95 % of all in order."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return signal.clamp_outliers(rows, "user_id", "value", 0.95, exact=True).select("event_id", r6(F.col("value")).alias("value"))


@query("""SELECT event_type AS epoch, count(*) AS steps, floor(avg(value) * 1e6 + 0.5) / 1e6 AS mean_loss, floor(sum(value) * 1e3 + 0.5) / 1e3 AS total_loss FROM events GROUP BY 1""")
def q33_epoch_loss(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("epoch")).agg(F.count(F.lit(1)).alias("steps"), r6(F.avg("value")).alias("mean_loss"), (F.floor(F.sum("value") * 1e3 + 0.5) / 1e3).alias("total_loss"))


@query("""WITH l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value FROM events),
w AS (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING) AS best FROM l)
SELECT user_id, epoch::BIGINT AS epoch, coalesce(value > best + 0.1, false) AS stop FROM w""")
def q34_early_stop(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    best = F.min("value").over(w.rowsBetween(Window.unboundedPreceding, -5))
    return table(spark, sf_dir, "events").select("user_id", F.row_number().over(w).cast("long").alias("epoch"), F.coalesce(F.col("value") > best + F.lit(0.1), F.lit(False)).alias("stop"))


LR = "floor(greatest({peak} * {rise}, 1e-8) * 1e12 + 0.5) / 1e12"
RISE = "sqrt(500.0) * least(1 / sqrt(greatest(step, 1)::DOUBLE), greatest(step, 1) * pow(500.0, -1.5))"


@query(f"""SELECT step::BIGINT AS step, {LR.format(peak='1e-4', rise=RISE)} AS lr, {LR.format(peak='1e-4 * 4.0', rise=RISE)} AS scaled, {LR.format(peak='1e-4', rise='1 / sqrt(greatest(step, 1)::DOUBLE)')} AS no_warmup,
 0.01::DOUBLE AS decay, 0.01 / 2::DOUBLE AS inv_sqrt, 0.01 / 4::DOUBLE AS inv FROM range(0, 12001) r(step)""")
def q53_learning_rate(spark, sf_dir):
    """Twelve thousand steps: warm-up of 500 and then inverse square root, peak 1e-4; a batch four times the reference; no warm-up; and weight decay by batch."""
    scale = schedule.batch_scale(256, 64)
    rounded = lambda c: F.floor(c * 1e12 + 0.5) / 1e12
    rates = [schedule.learning_rate(F.col("step"), 1e-4, w, k) for w, k in ((500, 1.0), (500, scale), (0, 1.0))]
    decay = [F.lit(schedule.weight_decay(0.01, scale, mode)).alias(name) for mode, name in (("none", "decay"), ("inv_sqrt", "inv_sqrt"), ("inv", "inv"))]
    return spark.range(12_001).withColumnRenamed("id", "step").select("step", *[rounded(c).alias(n) for c, n in zip(rates, ("lr", "scaled", "no_warmup"), strict=True)], *decay)


def _draw(seed: int, key: str) -> str:
    return f"((('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)"


@query(f"""WITH {PLACED}, s AS (SELECT user_id, stddev_pop(value) AS s, max(abs(value)) AS m FROM events GROUP BY 1)
SELECT event_id, {R6.format(f"value + CASE WHEN {_draw(13, 'user_id')} < 0.5 THEN 0.05::DOUBLE * s * sqrt(-2 * ln({_draw(11, 'event_id')})) * cos(2 * pi() * {_draw(12, 'event_id')}) + CASE WHEN {_draw(14, 'user_id')} < 0.5 THEN 0.07::DOUBLE * m * sin((floor({_draw(15, 'user_id')} * 5) + 1) * pi() * idx / greatest(n - 1, 1)) ELSE 0.0 END ELSE 0.0 END")} AS value FROM p JOIN s USING (user_id)""")
def q95_noise(spark, sf_dir):
    """Seeded noise and baseline wander."""
    rows = signal.noisy(table(spark, sf_dir, "events").select("event_id", *LEAD, "ts", "value"), "user_id", "event_type", ORDER, "event_id")
    return rows.select("event_id", r6(F.col("value")).alias("value"))


@query(f"""WITH r AS (SELECT event_id, user_id, CASE event_id % 11 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE ELSE value END AS raw FROM events),
c AS (SELECT event_id, user_id, CASE WHEN isnan(raw) OR isinf(raw) THEN 0.0 ELSE raw END AS value FROM r), b AS (SELECT user_id, min(value) AS low, max(value) AS high FROM c GROUP BY 1)
SELECT event_id, floor({UNIT} * 255)::BIGINT AS pixel FROM c JOIN b USING (user_id)""")
def q100_clean_levels(spark, sf_dir):
    """Levels of signals with NaN and infinities, which count as 0."""
    value = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 1, F.lit(float("inf"))).when(F.col("event_id") % 11 == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", value.alias("value"))
    return signal.stacked_levels(rows, "user_id").select("event_id", "pixel")


NOISE = f"""n AS (SELECT event_id, user_id, value, {{v}} + CASE WHEN {_draw(13, 'user_id')} < 0.5 THEN 0.05::DOUBLE * s * sqrt(-2 * ln({_draw(11, 'event_id')})) * cos(2 * pi() * {_draw(12, 'event_id')}) + CASE WHEN {_draw(14, 'user_id')} < 0.5 THEN 0.07::DOUBLE * m * sin((floor({_draw(15, 'user_id')} * 5) + 1) * pi() * idx / greatest(n - 1, 1)) ELSE 0.0 END ELSE 0.0 END AS noisy FROM p JOIN s USING (user_id))"""


@query(f"""WITH {BOUNDS}, {PLACED.replace('FROM events', 'FROM (SELECT events.*, ' + UNIT + ' AS u FROM events JOIN b USING (user_id))')}, s AS (SELECT user_id, stddev_pop(u) AS s, max(abs(u)) AS m FROM p GROUP BY 1), {NOISE.format(v='u')},
t AS (SELECT user_id, stddev_pop(value) AS s, max(abs(value)) AS m FROM p GROUP BY 1), {NOISE.format(v='value').replace('n AS', 'r AS', 1).replace('JOIN s', 'JOIN t')}, rb AS (SELECT user_id, min(noisy) AS low, max(noisy) AS high FROM r GROUP BY 1)
SELECT event_id, {R6.format('n.noisy')} AS signal, {R6.format(UNIT.replace('value', 'r.noisy'))} AS token FROM n JOIN r USING (event_id) JOIN rb ON r.user_id = rb.user_id""")
def q103_perturbation_order(spark, sf_dir):
    """The signal's way (normalised, then perturbed) and the tokens' (perturbed raw, then normalised)."""
    events = table(spark, sf_dir, "events").select("event_id", *LEAD, "ts", "value")
    ways = [signal.perturbed(events, "user_id", "event_type", ORDER, "event_id", name).select("event_id", r6(F.col("value")).alias(name)) for name in ("signal", "token")]
    return ways[0].join(ways[1], "event_id")


@query(f"""WITH {PLACED}, w AS (SELECT *, min(n) OVER (PARTITION BY user_id) // 3 * 3 AS whole FROM p), x AS (SELECT * FROM w WHERE idx < whole)
SELECT user_id, 'time' AS layout, (idx // 3)::VARCHAR AS patch, md5(string_agg(event_id::VARCHAR, ',' ORDER BY idx, event_type)) AS digest FROM x GROUP BY user_id, idx // 3
UNION ALL SELECT user_id, 'leads', event_type, md5(string_agg(event_id::VARCHAR, ',' ORDER BY idx)) FROM x GROUP BY user_id, event_type
UNION ALL SELECT user_id, 'lead_time', event_type || ':' || (idx // 3), md5(string_agg(event_id::VARCHAR, ',' ORDER BY idx)) FROM x GROUP BY user_id, event_type, idx // 3""")
def q104_patches(spark, sf_dir):
    """The three patch layouts over the whole patches of three samples that all leads of a record have; the ids of the samples in each patch."""
    placed = signal.with_position(table(spark, sf_dir, "events").select("event_id", *LEAD, "ts"), LEAD, ORDER)
    whole = placed.groupBy(*LEAD).agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg((F.floor(F.min("n") / 3) * 3).alias("whole"))
    rows = placed.join(whole, "user_id").where("idx < whole")
    digest = F.md5(F.array_join(F.col("values").cast("array<string>"), ",").cast("binary"))
    out = None
    for layout, patch in (("time", F.col("patch").cast("string")), ("leads", F.col("patch")), ("lead_time", F.concat_ws(":", "event_type", F.col("patch").cast("string")))):
        one = signal.patches(rows, 3, layout, "user_id", "event_type", "event_id").select("user_id", F.lit(layout).alias("layout"), patch.alias("patch"), digest.alias("digest"))
        out = one if out is None else out.union(one)
    return out


@query(f"SELECT user_id, event_type, 'ECG Lead ' || event_type || ' - sampled at ~250Hz, normalized (mean=' || printf('%.3f', {R6.format('avg(value)')}) || ', std=' || printf('%.3f', {R6.format('stddev_pop(value)')}) || ')' AS caption FROM events GROUP BY 1, 2")
def q105_captions(spark, sf_dir):
    return signal.captions(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT event_id, (value::REAL)::DOUBLE AS value FROM events")
def q106_single_precision(spark, sf_dir):
    return signal.single(table(spark, sf_dir, "events")).select("event_id", F.col("value").cast("double").alias("value"))


@query(f"""WITH {PLACED}, w AS (SELECT *, idx // 4 AS patch FROM p WHERE idx < n // 4 * 4), m AS (SELECT user_id, event_type, patch, avg(value) AS m, var_samp(value) AS v, (patch % 3 > 0)::INT AS removed FROM w GROUP BY 1, 2, 3),
e AS (SELECT user_id, event_type, patch, removed, avg((value - sqrt(2)) * (value - sqrt(2))) AS plain, avg((sqrt(2) - (value - m) / sqrt(v + 1e-6)) ** 2) AS scaled FROM w JOIN m USING (user_id, event_type, patch) GROUP BY 1, 2, 3, 4)
SELECT user_id, {R6.format('sum(plain * removed) / nullif(sum(removed), 0)')} AS plain, {R6.format('sum(scaled * removed) / nullif(sum(removed), 0)')} AS standardised FROM e GROUP BY 1""")
def q134_masked_loss(spark, sf_dir):
    """A record's loss over its removed patches of four samples where all predictions are the root of 2, as it is and with standardised targets."""
    whole = signal.segments(table(spark, sf_dir, "events"), LEAD, ORDER, 4)
    rows = signal.patches(whole, 4, "lead_time", "user_id", "event_type").select(*LEAD, "values", F.transform("values", lambda x: F.sqrt(F.lit(2.0))).alias("predicted"), (F.col("patch") % 3 > 0).cast("int").alias("removed"))
    plain, scaled = (signal.masked_loss(rows, ["user_id"], "values", "predicted", "removed", s).withColumnRenamed("loss", n) for s, n in ((False, "a"), (True, "b")))
    return plain.join(scaled, "user_id").select("user_id", r6(F.col("a")).alias("plain"), r6(F.col("b")).alias("standardised"))
