"""Every registered query of the reference's own operators against its SQL, at the smallest size."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from oracle import connection, difference

from leadframe.functions import kernels
from leadframe.operators import tokens
from leadframe.plans import registry
from leadframe.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    assert difference(registry.queries()[name](spark, SF), duck, registry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_resample_is_exact_on_cubics():
    cubic = lambda x: 2 * x**3 - x**2 + 3 * x - 1
    assert np.allclose(kernels.resample(cubic(np.arange(10.0)), 2, 1), cubic(np.linspace(0, 9, 5)))
    assert kernels.resample(np.zeros((4096, 12)), 400, 250).shape == (2560, 12)


def train(spark, texts, n, folder, **more):
    return tokens.train_merges(spark.createDataFrame([(t,) for t in texts], "t string").repartition(3), "t", n, str(folder), **more)


def test_bpe_vectors(spark, tmp_path):
    assert [(m[2], m[3]) for m in train(spark, ["aaabdaaabac"], 3, tmp_path / "a")] == [(256, 4), (257, 2), (258, 2)]
    assert [m[3] for m in train(spark, ["aaaa"], 5, tmp_path / "b")] == [3, 1]
    assert train(spark, ["", "x", None], 5, tmp_path / "c") == []
    merges = [(ord("a"), ord("b"), 256, 1), (ord("b"), ord("c"), 257, 1)]
    assert tokens.greedy_ids(b"abc", tokens.trie_of(merges)) == [256, 99]
    assert tokens.merged(np.array([1, 1, 1, 2, 1, 1, 1, 1]), 1, 1, 9).tolist() == [9, 1, 2, 9, 9]


def one_by_one(texts, n):
    """Merge after merge over all texts, in plain Python."""
    seen, out = [list(t.encode()) for t in texts], []
    for k in range(n):
        counts = Counter(p for ids in seen for p in zip(ids, ids[1:]))
        if not counts:
            break
        pair, count = min(counts.items(), key=lambda x: (-x[1], x[0]))
        out.append((*pair, 256 + k, count))
        for i, ids in enumerate(seen):
            new, j = [], 0
            while j < len(ids):
                hit = tuple(ids[j : j + 2]) == pair
                new.append(256 + k if hit else ids[j])
                j += 1 + hit
            seen[i] = new
    return out


@pytest.mark.parametrize("top", [1000, 6])
def test_bpe_training_is_exact(spark, tmp_path, top):
    """Several merges in one job are those that one at a time would give, ties and repeated texts included; the tokenizer survives its table."""
    draw = np.random.default_rng(2)
    texts = ["".join(draw.choice(list("abcdef"), draw.integers(1, 60), p=[0.3, 0.25, 0.2, 0.15, 0.05, 0.05])) for _ in range(60)]
    texts += texts[:20]
    merges = train(spark, texts, 60, tmp_path / "ids", rounds=3, top=top)
    assert merges == one_by_one(texts, 60)
    tokens.save_merges(spark, merges, str(tmp_path / "merges"))
    assert tokens.load_merges(spark, str(tmp_path / "merges")) == merges
    pieces = tokens.pieces_of(merges)
    for t in texts:
        ids, i = tokens.greedy_ids(t.encode(), tokens.trie_of(merges)), 0
        for k in ids:
            assert len(pieces[k]) == max(len(p) for p in pieces.values() if t.encode().startswith(p, i))
            i += len(pieces[k])
        assert b"".join(pieces[k] for k in ids) == t.encode()


def test_learned_ids_of_whole_records(spark):
    """Training over all records' symbols against one merge at a time."""
    texts = [r["symbols"] for r in registry.queries()["q01_symbolise"](spark, SF).collect()]
    got = [(r["left"], r["right"], r["id"], r["n"]) for r in registry.queries()["q43_bpe_merges"](spark, SF).orderBy("rank").collect()]
    assert got == one_by_one(texts, 16)


def test_resample_query_against_a_dense_system(spark):
    """Whole leads at half their rate; the spline's system solved as a dense matrix, not-a-knot rows included."""
    rows = table(spark, SF, "events").select("user_id", "event_type", "ts", "event_id", "value").toPandas()
    got = registry.queries()["q08_resample"](spark, SF).toPandas()
    for key, own in got.groupby(["user_id", "event_type"]):
        y = rows[(rows["user_id"] == key[0]) & (rows["event_type"] == key[1])].sort_values(["ts", "event_id"])["value"].to_numpy()
        n, at = len(y), np.linspace(0, len(y) - 1, len(y) // 2)
        if n < 4:
            want = np.polyval(np.polyfit(np.arange(n), y, n - 1), at) if n > 1 else y[: n // 2]
        else:
            a, right = np.zeros((n, n)), np.zeros(n)
            for i in range(1, n - 1):
                a[i, i - 1 : i + 2], right[i] = (1, 4, 1), 6 * (y[i + 1] - 2 * y[i] + y[i - 1])
            a[0, :3] = a[-1, -3:] = 1, -2, 1
            m = np.linalg.solve(a, right)
            k = np.minimum(at.astype(int), n - 2)
            t, u = at - k, 1 - at + k
            want = u * y[k] + t * y[k + 1] + ((u**3 - u) * m[k] + (t**3 - t) * m[k + 1]) / 6
        assert np.allclose(own.sort_values("idx")["value"], want), key


def test_feature_query_against_plain_loops(spark):
    """Every record's 24 features, computed one by one from their definitions."""
    rows = table(spark, SF, "events").toPandas().sort_values(["user_id", "event_type", "ts", "event_id"])
    fs = 250.0
    for r in registry.queries()["q97_lead_features"](spark, SF).collect():
        x = rows[rows["user_id"] // 10 == r["record"]]["value"].to_numpy()
        got, n = r["features"], len(x)
        assert len(got) == 24 and n >= 224
        assert np.allclose(got[:7], [x.mean(), x.std(), x.max(), x.min(), np.median(x), np.percentile(x, 25), np.percentile(x, 75)])
        k = min(1024, n)
        hann = [0.5 - 0.5 * math.cos(2 * math.pi * i / k) for i in range(k)]
        spectra = []
        for start in range(0, n - k + 1, k // 2):
            part = x[start : start + k]
            windowed = np.array([(v - part.mean()) * w for v, w in zip(part, hann)])
            power = np.array([abs(sum(windowed * np.exp(-2j * np.pi * f * np.arange(k) / k))) ** 2 for f in range(k // 2 + 1)]) / (fs * sum(w * w for w in hann))
            power[1 : len(power) - (k % 2 == 0)] *= 2
            spectra.append(power)
        p, f = np.mean(spectra, 0), np.arange(k // 2 + 1) * fs / k
        assert np.allclose(got[7:11], [p.sum(), p.max(), f[p.argmax()], (f * p).sum() / p.sum()])
        floor = 0.3 * (x.max() - x.min()) + x.min()
        tops = [i for i in range(1, n - 1) if x[i - 1] < x[i] > x[i + 1] and x[i] >= floor]
        for i in sorted(tops, key=lambda i: x[i])[::-1]:
            if i in tops:
                tops = [j for j in tops if j == i or abs(j - i) >= 50]
        rr = np.diff(tops) / fs
        widths = []
        for i in tops:
            w = x[max(0, i - 25) : i + 25]
            widths.append(sum(abs(v - w.mean()) > 0.1 * (w.max() - w.min()) + w.min() for v in w) / fs)
        between = x[tops[-2] : tops[-1]]
        assert np.allclose(got[11:16], [60 / rr.mean(), rr.std() if len(rr) > 1 else 0, np.mean(widths), between.max() - between.min(), x[min(tops[-1] + 20, n - 1)] - x[tops[-1]]])
        assert np.allclose(got[22:], [np.abs(np.diff(x)).mean(), np.sqrt((np.diff(x) ** 2).mean())])
        a, energies = x, []
        for _ in range(5):
            at = lambda i, a=a: a[-i - 1] if i < 0 else a[2 * len(a) - 1 - i] if i >= len(a) else a[i]
            low, high = kernels.DB4[::-1], kernels.DB4 * np.array([-1, 1] * 4)
            a, d = (np.array([sum(c[j] * at(2 * i + 1 - j) for j in range(8)) for i in range((len(a) + 7) // 2)]) for c in (low, high))
            energies.append(np.abs(d).mean())
        assert np.allclose(got[16:22], [np.abs(a).mean(), *energies[::-1]])


def test_summary_rouge_query_against_plain_loops(spark):
    """Every pair's score from sets and a table of the longest common subsequence filled cell by cell."""
    from leadframe.plans import evaluation

    def sentences(t):
        return [" ".join(x.split()).split(" ") for x in t.split(".") if x]

    def reached(a, b):
        best = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                best[i, j] = 0 if not i or not j else best[i - 1, j - 1] + 1 if a[i - 1] == b[j - 1] else max(best[i - 1, j], best[i, j - 1])
        i, j, out = len(a), len(b), set()
        while i and j:
            if a[i - 1] == b[j - 1]:
                out.add(a[i - 1])
                i, j = i - 1, j - 1
            elif best[i - 1, j] > best[i, j - 1]:
                i -= 1
            else:
                j -= 1
        return out

    got = {(r["conv_id"], r["turn"]): r["rouge_l"] for r in registry.queries()["q69_rouge_l"](spark, SF).collect()}
    rows = evaluation.pairs(spark, SF).collect()
    assert len(rows) == len(got) > 20
    for r in rows:
        ref, hyp = sentences(r["ref"]), sentences(r["hyp"])
        found = set().union(*(reached(x, y) for x in ref for y in hyp))
        p, q = len(found) / len({w for x in hyp for w in x}), len(found) / len({w for x in ref for w in x})
        assert got[r["conv_id"], r["turn"]] == pytest.approx(2 * p * q / (p + q + 1e-8), abs=1e-6)


def test_svcca_query_against_whole_matrices(spark):
    e = np.array([r["embedding"] for r in table(spark, SF, "embeddings").collect()], "f8")
    views = [v / np.linalg.norm(v, axis=1, keepdims=True) for v in (e[:, :32], e[:, 32:])]
    bases = [np.linalg.svd((v - v.mean(0)) / (v.std(0, ddof=1) + 1e-8), full_matrices=False)[0][:, :10] for v in views]
    want = np.linalg.svd(bases[0].T @ bases[1], compute_uv=False).mean()
    assert registry.queries()["q88_svcca"](spark, SF).first()[0] == pytest.approx(want, abs=1e-6)


def test_skip_gram_vectors_descend_the_stated_loss(spark):
    """The query's vectors against the same descent on gradients taken by differences."""
    from leadframe.operators import vectors

    pairs = spark.createDataFrame([("a", "b", 5), ("b", "a", 4), ("b", "c", 1), ("c", "a", 2)], "center string, context string, n long")
    names, got, losses = vectors.train(pairs, dims=2, epochs=3, rate=0.1)
    seen = np.array([[0, 5, 0], [4, 0, 1], [2, 0, 0]]) / 12
    noise = seen.sum(0) ** 0.75
    against = np.outer(seen.sum(1), noise / noise.sum())
    draw = np.random.default_rng(42)
    x = np.concatenate([draw.uniform(-0.5, 0.5, (3, 2)) / 2, np.zeros((3, 2))])

    def loss(x):
        near = 1 / (1 + np.exp(-(x[:3] @ x[3:].T)))
        return -(seen * np.log(near)).sum() - (against * np.log(1 - near)).sum()

    m, v = np.zeros_like(x), np.zeros_like(x)
    for epoch in range(1, 4):
        assert losses[epoch - 1] == pytest.approx(loss(x), abs=1e-6)
        g = np.zeros_like(x)
        for i in np.ndindex(x.shape):
            step = np.zeros_like(x)
            step[i] = 1e-6
            g[i] = (loss(x + step) - loss(x - step)) / 2e-6
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.1 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    assert names == ["a", "b", "c"] and np.allclose(got, x[:3], atol=1e-3)


def test_wavelets_keep_energy_and_count_levels():
    x = np.random.default_rng(0).normal(size=4000)
    assert [len(kernels.wavelet_energies(x[:n])) for n in (6, 13, 14, 28, 223, 224)] == [1, 1, 2, 3, 5, 6]
    assert kernels.wavelet_energies(np.ones(300))[1:] == pytest.approx([0] * 5, abs=1e-9)  # details of a constant


def test_qrs_counts_samples_over_the_segment_s_own_threshold():
    x = np.zeros(100)
    x[50] = 10.0
    assert kernels.qrs_duration(x, 50, 250) == pytest.approx(1 / 250)  # one sample is further from the mean 0.2 than 1
    assert kernels.qrs_duration(np.ones(100), 50, 250) == 0


def test_statistics():
    assert kernels.t_quantile(0.975, 2) == pytest.approx(4.302652729749464)
    assert kernels.t_quantile(0.975, 10) == pytest.approx(2.228138851964939, abs=1e-6)
    assert kernels.longest_common(list("abcd"), list("acbd")) == 3 and kernels.edits(list("kitten"), list("sitting")) == 3
    x = np.sin(2 * math.pi * 5 * np.arange(1000) / 250)
    f, p = kernels.welch(x, 250)
    assert f[p.argmax()] == pytest.approx(5, abs=0.3)
    assert len(kernels.lead_features(x, 250)) == 24 and len(kernels.peaks(x, 0.5, 20)) == 20
    assert kernels.common_words(list("abcd"), list("acbd")) in (["a", "b", "d"], ["a", "c", "d"])
