"""File sources, streaming, and kernels against known values or brute force."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadframe import surface
from leadframe.functions import kernels
from leadframe.functions.stems import meteor, stem
from leadframe.operators import alignment, etl, signal, tokens, vectors
from leadframe.sources import files, wfdb
from leadframe.streaming import symbols as streaming

SF = "/root/testdata/sf0.001"


def _packed(x: np.ndarray) -> bytes:
    """Format 212."""
    a, b = (x.astype(int) & 0xFFF).reshape(-1, 2).T
    return np.stack([a & 0xFF, a >> 8 | (b >> 8) << 4, b & 0xFF], 1).astype("u1").tobytes()


def test_wfdb(spark, tmp_path):
    x = np.array([[100, -200], [300, -2047], [0, 2047], [-1, 1]])
    (tmp_path / "a").mkdir()
    (tmp_path / "a/r1.hea").write_text("# made here\nr1 2 250 4\nr1.dat 212 200(10)/mV 12 0 0 0 0 I\nr1.dat 212 100/mV 12 5 0 0 0 II\n")
    (tmp_path / "a/r1.dat").write_bytes(_packed(x.ravel()))
    (tmp_path / "r2.hea").write_text("r2 1 500 3\nr2.dat 16 1000/mV 16 0\n")
    (tmp_path / "r2.dat").write_bytes(np.array([1000, -32768, 5], "<i2").tobytes())
    (tmp_path / "r3.hea").write_text("broken\n")
    (tmp_path / "r4.hea").write_text("r4 1 500 3\nr4.dat 16\n")
    got, rejects = wfdb.read(spark, str(tmp_path))
    rows = {(r["record"], r["place"]): r for r in got.collect()}
    assert set(rows) == {("r1", 0), ("r1", 1), ("r2", 0)}
    assert np.allclose(rows["r1", 0]["values"], (x[:, 0] - 10) / 200) and np.allclose(rows["r1", 1]["values"], (x[:, 1] - 5) / 100)
    assert rows["r1", 1]["lead"] == "II" and rows["r2", 0]["fs"] == 500 and rows["r2", 0]["values"][1] is None
    assert sorted(r["path"].rsplit("/", 1)[1] for r in rejects.collect()) == ["r3", "r4"]


def test_files(spark, tmp_path):
    for d in ("x", "y"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "rec.1.hea").write_text("x")
    (tmp_path / "list.txt").write_text(" a \n\n b\n")
    (tmp_path / "q.json").write_text(json.dumps([{"k": 1}, {"k": 2}]))
    (tmp_path / "c.csv").write_text("id,t\n1,\n2,x\n")
    one = files.catalogue(spark, str(tmp_path), ".hea").collect()
    assert [r["name"] for r in one] == ["rec"] and one[0]["path"].endswith("y/rec.1")
    assert sorted(r["path"] for r in files.path_list(spark, str(tmp_path / "list.txt")).collect()) == ["a", "b"]
    assert files.json_array(spark, str(tmp_path / "q.json"), "k long").agg(F.sum("k")).first()[0] == 3
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "c.csv"), "id int, t string").orderBy("id").collect()] == [(1, None), (2, "x")]
    parts = spark.createDataFrame([(0, 5, 7, [1.0]), (1, 0, 7, [2.0]), (0, 1, 8, [3.0])], "part int, idx int, exam_id long, tracing array<double>")
    assert {r["exam_id"]: r["tracing"] for r in files.exams(parts).collect()} == {7: [2.0], 8: [3.0]}
    root = str(tmp_path / "runs")
    assert [files.next_run(spark, root).rsplit("/", 1)[1] for _ in range(3)] == ["0", "1", "2"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 5).parquet(str(tmp_path / "in"))
    out = streaming.symbolised(stream, "user_id", "ts", ["ts", "event_id"], window="1 day", late="400 days")
    run = out.writeStream.outputMode("complete").format("memory").queryName("symbols").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    batch = streaming.symbolised(events, "user_id", "ts", ["ts", "event_id"], window="1 day")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spark.table("symbols")) == rows(batch) != []


def test_stems_and_meteor():
    known = {"caresses": "caress", "ponies": "poni", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "sized": "size", "filing": "file", "happy": "happi", "relational": "relat", "generalizations": "gener", "oscillators": "oscil", "controlling": "control", "adoption": "adopt"}
    assert {w: stem(w) for w in known} == known
    assert meteor("the cat sat".split(), "The cat sat".split()) == pytest.approx(1 - 0.5 / 27)
    assert meteor("the cat sits".split(), "cat sitting".split()) == pytest.approx(1 * (2 / 3) / (0.9 + 0.1 * 2 / 3) * (1 - 0.5 / 8))
    assert meteor(["a"], ["b"]) == 0


def test_svcca_and_metric_names(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(200, 12))
    b = np.hstack([a[:, :6] @ rng.normal(size=(6, 6)) + 0.1 * rng.normal(size=(200, 6)), rng.normal(size=(200, 5))])
    rows = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b)], "a array<double>, b array<double>").repartition(5)

    def leading(x):
        x = (x - x.mean(0)) / (x.std(0, ddof=1) + 1e-8)
        return np.linalg.svd(x, full_matrices=False)[0][:, :10]

    want = np.linalg.svd(leading(a).T @ leading(b), compute_uv=False).mean()
    assert alignment.svcca(rows, "a", "b") == pytest.approx(want, abs=1e-6)
    keyed = rows.withColumn("id", F.monotonically_increasing_id())
    k, l, m = a @ a.T, b @ b.T, len(a)
    h = np.eye(m) - 1 / m

    def whole(x, y):
        return np.trace(x @ h @ y @ h)

    def apart(x, y):
        x, y = x - np.diag(np.diag(x)), y - np.diag(np.diag(y))
        return ((x * y.T).sum() + x.sum() * y.sum() / ((m - 1) * (m - 2)) - 2 * (x @ y).sum() / (m - 2)) / (m * (m - 3))

    for metric, hsic in (("cka", whole), ("unbiased_cka", apart)):
        want = hsic(k, l) / (np.sqrt(hsic(k, k) * hsic(l, l)) + 1e-6)
        assert alignment.measured(metric, keyed, "id", "a", "b").first()[0] == pytest.approx(want, rel=1e-9), metric
    near = lambda s: np.argsort(-(s - 1e8 * np.eye(m)), 1, kind="stable")[:, :10]
    na, nb = near(k), near(l)
    want = np.mean([len(set(x) & set(y)) for x, y in zip(na.tolist(), nb.tolist())]) / 10
    order = [r["id"] for r in keyed.select("id", "a").collect()]
    keyed = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))], "id long, a array<double>, b array<double>")
    assert len(order) == m and alignment.measured("mutual_knn", keyed, "id", "a", "b").first()[0] == pytest.approx(want)
    assert alignment.measured("lcs_knn", keyed, "id", "a", "b").first()[0] == pytest.approx(np.mean([kernels.longest_common(x, y) for x, y in zip(na.tolist(), nb.tolist())]))
    assert alignment.measured("svcca", keyed, "id", "a", "b").first()[0] == pytest.approx(alignment.svcca(rows, "a", "b"), abs=1e-6)
    for metric in ("cycle_knn", "edit_distance_knn", "cknna"):
        assert -1 <= alignment.measured(metric, keyed, "id", "a", "b").first()[0] <= 1
    with pytest.raises(ValueError):
        alignment.measured("cknna", keyed, "id", "a", "b", k=1)
    with pytest.raises(ValueError):
        alignment.check_metric("other")


def test_alias_table_and_vectors(spark):
    weights = np.array([5.0, 1, 1, 3])
    keep, other = vectors.alias_table(weights)
    share = keep.copy()
    for i, o in enumerate(other):
        share[o] += 1 - keep[i]
    assert np.allclose(share / 4, weights / weights.sum())
    assert np.allclose(np.bincount(vectors.draw(keep, other, 20000, 1), minlength=4) / 20000, weights / 10, atol=0.02)
    pairs = spark.createDataFrame([("a", "b", 50), ("b", "a", 50), ("c", "d", 50), ("d", "c", 50)], "center string, context string, n long")
    names, _, losses = vectors.train(pairs)
    assert names == ["a", "b", "c", "d"] and losses[-1] < 0.8 * losses[0]


def test_samples_are_exact(spark):
    rows = spark.range(1000)
    got = [r[0] for r in etl.sample_exact(rows, "id", 137).collect()]
    assert sorted(got) == sorted(sorted(range(1000), key=lambda k: (k * 2654435761 + 42) % 2**32)[:137])
    assert etl.sample_exact(rows, "id", 5000).count() == 1000 and etl.sample_exact(rows, "id", 0).count() == 0
    huge = spark.createDataFrame([(2**62 + 5,)], "id long")
    assert etl.sample_fraction(huge, "id", 0.5).count() == 1
    with pytest.raises(ValueError):
        etl.sample_fraction(rows, "id", 1.5)
    etl.check_encoder("token", None), etl.check_encoder("signal", "signal2vec"), etl.check_encoder("image", "siglip-base-patch16-224")
    for representation, encoder in (("image", "merl"), ("image", "clip"), ("token", "merl"), ("other", None)):
        with pytest.raises(ValueError):
            etl.check_encoder(representation, encoder)


def test_negatives():
    weights, positives = np.array([6.0, 3, 1]), np.repeat([0, 1, 2], 4000)
    got = vectors.negatives(positives, weights, 5, 3)
    assert got.shape == (12000, 5)
    p = weights / weights.sum()
    same = np.array([(got[positives == i] == i).mean() for i in range(3)])
    assert np.allclose(same, p * p, atol=0.02)  # drawn again once, so twice in a row


def test_patch_size_and_layouts(spark):
    assert [signal.patch_size(n) for n in (500, 1250, 2500)] == [20, 50, 100]
    assert signal.patch_size(7) == 1 and signal.patch_size(2 * 10007) == 2  # no divisor gives 16 to 64: the one nearest to the root of a 32nd
    rows = spark.createDataFrame([(1, lead, i, float(10 * lead + i)) for lead in range(2) for i in range(6)], "rec int, lead int, idx long, value double")
    made = signal.patches(rows, 3, "time", "rec", "lead")
    assert {r["patch"]: r["values"] for r in made.collect()} == {0: [0, 10, 1, 11, 2, 12], 1: [3, 13, 4, 14, 5, 15]}
    back = {(r["lead"], r["idx"]): r["value"] for r in signal.unpatched(made, "rec", 3, 2).collect()}
    assert back == {(lead, i): 10.0 * lead + i for lead in range(2) for i in range(6)}
    assert {r["patch"]: r["values"] for r in signal.patches(rows, 3, "leads", "rec", "lead").collect()} == {0: [0, 1, 2, 3, 4, 5], 1: [10, 11, 12, 13, 14, 15]}
    assert {(r["lead"], r["patch"]): r["values"] for r in signal.patches(rows, 3, "lead_time", "rec", "lead").collect()}[1, 1] == [13, 14, 15]
    with pytest.raises(Exception, match="no multiple of 4"):
        signal.patches(rows, 4, "time", "rec", "lead").collect()


def test_clean_and_constant_signals(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([nan, inf, -inf, 4.0])] + [(2, 0, 3.0), (2, 1, 3.0)], "rec int, i int, value double")
    assert {r["rec"]: r["symbols"] for r in signal.symbolise(rows, "rec", ["i"]).collect()} == {1: "aaaz", 2: "aa"}
    assert {r["rec"]: (r["mean"], r["max"]) for r in signal.lead_statistics(rows, ["rec"]).collect()} == {1: (1, 4), 2: (3, 3)}
    assert [r["max_error"] for r in signal.reconstruction_error(rows, "rec").orderBy("rec").collect()] == [pytest.approx(0, abs=0.16), 0]
    assert [r["value"] for r in signal.blackout(rows).collect()] == [0] * 6
    assert signal.single(rows.where("rec = 2")).dtypes[2] == ("value", "float")


def test_outlier_bounds(spark):
    x = np.array([[1.0, 2, 30, -4], [5, -60, 7, 8]])
    rows = spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "row int, j int, value double")
    bound = np.quantile(np.abs(x), 0.5, axis=1).mean()
    got = {(r["row"], r["j"]): r["value"] for r in signal.clamp_outliers(rows, "row", "value", 0.5).collect()}
    assert got == {(i, j): pytest.approx(np.clip(v, -bound, bound)) for i, row in enumerate(x) for j, v in enumerate(row)}
    bound = np.sort(np.abs(x).ravel())[int(0.75 * 8)]
    got = {(r["row"], r["j"]): r["value"] for r in signal.clamp_outliers(rows, "row", "value", 0.75, exact=True).collect()}
    assert got == {(i, j): np.clip(v, -bound, bound) for i, row in enumerate(x) for j, v in enumerate(row)}
    assert signal.clamp_outliers(rows, "row", "value", 1) is rows


def test_injection(spark):
    rows = spark.createDataFrame([(e, p, [1.0, 1.0], {0: [2, -2, 9], 1: [-1]}[e]) for e in (0, 1) for p in range(4)], "e int, pos long, v array<double>, at array<int>")
    new = spark.createDataFrame([(0, 0, [5.0, 6.0]), (0, 1, [7.0, 7.0]), (0, 2, [8.0, 8.0]), (1, 0, [9.0, 9.0])], "e int, k int, v array<double>")
    got = {(r["e"], r["pos"]): r["v"] for r in alignment.injected(rows, new, "e", "v", "at").collect()}
    assert got == {(e, p): [5, 6] if (e, p) == (0, 2) else [1, 1] for e in (0, 1) for p in range(4)}
    zero = new.withColumn("v", F.array(F.lit(0.0), F.lit(0.0)))
    assert all(r["v"] == [1, 1] for r in alignment.injected(rows, zero, "e", "v", "at").collect())
    assert alignment.injected(rows, new.where("false"), "e", "v", "at").where("v[0] <> 1").count() == 0
    with pytest.raises(Exception, match="out of range"):
        alignment.injected(rows, new, "e", "v", "at", strict=True).collect()


def test_shuffle_deals_equal_shards(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    for shards in (1, 3, 4, 16):
        got = etl.shuffled(rows, "k", epoch=1, shards=shards).collect()
        sizes = {s: sorted(r["pos"] for r in got if r["shard"] == s) for s in range(shards)}
        assert all(p == list(range(-(-10 // shards))) for p in sizes.values()) and {r["k"] for r in got} == set(range(10))
    order = lambda epoch: [r["k"] for r in etl.shuffled(rows, "k", epoch).orderBy("pos").collect()]
    assert order(1) == order(1) != order(2)


def test_rows_taken_and_counted(spark):
    rows = spark.range(10)
    kept, counts = etl.taken(rows, F.when(F.col("id") % 3 == 0, "third"), "some")
    assert kept.count() == 6 and counts.get == {"seen": 10, "skipped": 4}
    with pytest.raises(ValueError):
        etl.key_of("csn-test-no-cot", F.lit("x"))
    with pytest.raises(ValueError):
        tokens.trainable(spark.createDataFrame([([1],)], "ids array<int>"), "ids")
    assert tokens.trainable(spark.createDataFrame([([1],), ([1, 2],)], "ids array<int>"), "ids").count() == 1
    names = tokens.extended_vocabulary(spark, 1000, [(97, 98, 256, 1)])
    assert names.count() == 257 and names.where("name = 'signal_256'").first()["id"] == 1256


def test_sinks(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(1, "a, \"b\"\nc"), (2, ""), (3, None)], "id int, t string")
    files.write_table(rows, f"{root}/t", "csv")
    files.write_table(rows.where("id < 3"), f"{root}/t", "csv")
    assert [tuple(r) for r in files.csv(spark, f"{root}/t", "id int, t string").orderBy("id").collect()] == [(1, "a, \"b\"\nc"), (2, None)]
    files.write_table(rows, f"{root}/p")
    assert spark.read.parquet(f"{root}/p").count() == 3
    files.write_json(rows, f"{root}/j")
    assert files.json_lines(spark, f"{root}/j", "id int, t string").orderBy("id").collect() == rows.orderBy("id").collect()
    files.write_path_list(rows, "t", f"{root}/l")
    assert files.path_list(spark, f"{root}/l").count() == 2  # the text of row 1 has two lines
    segments = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [])], "rec int, seg int, signal array<double>")
    assert [tuple(r) for r in files.write_segments(segments, f"{root}/s", ["rec", "seg"]).collect()] == [(1, 1, "empty")]
    files.write_config(spark, {"b": 1, "a": "ü"}, f"{root}/c.json")
    assert files.read_config(spark, f"{root}/c.json") == {"a": "ü", "b": 1}
    path = files.write_result(spark.createDataFrame([(0.5, 3)], "bleu double, n int"), f"{root}/run/epoch_1.best.pt")
    assert path.endswith("epoch_1.best.json") and files.read_config(spark, path) == {"bleu": 0.5, "n": 3}
    spark.range(30).withColumnRenamed("id", "row_idx").write.parquet(f"{root}/hub")
    assert files.hub_split(spark, f"{root}/hub", "x", "test").count() == 30
    with pytest.raises(ValueError):
        files.hub_split(spark, f"{root}/hub", "x", "dev")


def test_hub_split_is_a_prefix_and_reaches_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(files.TRAIN_ROWS, "small", 7)
    spark.range(30).selectExpr("id AS row_idx", "id AS v").write.parquet(str(tmp_path / "h"))
    got = files.hub_split(spark, str(tmp_path / "h"), "small", "train")
    assert sorted(r["row_idx"] for r in got.collect()) == list(range(7))
    assert "LessThan(row_idx,7)" in got._jdf.queryExecution().toString()


def test_plot_tables(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 2), ("c", 5), ("d", 1)], "t string, n int")
    assert sorted(tuple(r) for r in files.rank_frequency(counts, "n").collect()) == [(1, 5, 2), (3, 2, 1), (4, 1, 1)]
    got = files.histogram(spark.createDataFrame([(float(v),) for v in (0, 1, 9, 10)], "v double"), F.col("v"), 5).orderBy("bin").collect()
    assert [r["n"] for r in got] == [2, 0, 0, 0, 2] and (got[0]["low"], got[4]["high"]) == (0, 10)
    same = files.histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), F.col("v"), 3).orderBy("bin").collect()
    assert [r["n"] for r in same] == [2, 0, 0]


def test_registered_functions(spark):
    sql = """SELECT clean_text('user: <ecg>\\nThe Image') AS c, symbolise(array(0D, 1D, CAST('NaN' AS DOUBLE))) AS s, encode_symbols('abc') AS e, decode_symbols(array(256, 99)) AS d,
    symbolise(CAST(NULL AS ARRAY<DOUBLE>)) AS n, (SELECT count(*) FROM segments_of(array(1D, 2D, 3D, 4D, 5D), 2)) AS k, (SELECT size(signal_features(value)) FROM events) AS f"""
    got = surface.query(spark, SF, sql, [(97, 98, 256, 1)]).first()
    assert tuple(got) == ("The Signal", "aza", [256, 99], "abc", None, 2, 24)
