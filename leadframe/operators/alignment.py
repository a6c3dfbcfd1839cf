"""Representation alignment of two views of the same items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(vec: Column) -> Column:
    norm = F.sqrt(dot(vec, vec))
    return F.when(norm > 0, F.transform(vec, lambda x: x / norm)).otherwise(vec)


def neighbours(sims: DataFrame, k: int) -> DataFrame:
    """i, j, sim, rank: the k nearest others; ties by id."""
    w = Window.partitionBy("i").orderBy(F.desc("sim"), "j")
    return sims.where("i <> j").select("i", "j", "sim", F.row_number().over(w).cast("long").alias("rank")).where(F.col("rank") <= k)


def neighbours_blocked(rows: DataFrame, key: str, vec: str, k: int, block: int = 2048) -> DataFrame:
    """The same of rows, never all pairs at once: blocks against blocks by matrix products, the k best of each block pair, then of all."""
    import numpy as np
    import pandas as pd

    n = max(1, -(-rows.count() // block))
    dealt = rows.select(F.col(key).alias("id"), F.col(vec).alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).alias("blk"))
    left = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    right = dealt.withColumnRenamed("blk", "other").withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"i": [], "j": [], "sim": []})
        b = b.sort_values("id")
        sims = np.stack(a["v"].to_numpy()) @ np.stack(b["v"].to_numpy()).T
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        sims[ia[:, None] == ib[None]] = -np.inf
        top = np.argsort(-sims, 1, kind="stable")[:, :k]
        got = pd.DataFrame({"i": np.repeat(ia, top.shape[1]), "j": ib[top].ravel(), "sim": np.take_along_axis(sims, top, 1).ravel()})
        return got[np.isfinite(got["sim"])]

    best = left.groupBy("blk", "other").cogroup(right.groupBy("blk", "other")).applyInPandas(run, "i long, j long, sim double")
    return neighbours(best, k)


def mutual_knn(a: DataFrame, b: DataFrame, k: int, n: int) -> Column | DataFrame:
    return a.join(b.select("i", "j"), ["i", "j"]).agg((F.count(F.lit(1)) / F.lit(float(k * n))).alias("mutual_knn"))


def cycle_knn(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """Share of i that some j near it in b has near itself in a."""
    back = a.select(F.col("i").alias("j"), F.col("j").alias("i"))
    return b.select("i", "j").join(back, ["i", "j"]).agg((F.countDistinct("i") / F.lit(float(n))).alias("cycle_knn"))


def moments(rows: DataFrame, a: str, b: str) -> DataFrame:
    """kind, p, q, s: sums over all items of a[p] b[q] (kl), a[p] a[q] (kk) and b[p] b[q] (ll); the views may be of different widths.

    Dims squared rows; products of whole batches, summed in each partition before the shuffle.
    """
    import numpy as np
    import pandas as pd

    def run(batches):
        total = None
        for batch in batches:
            if len(batch):
                x, y = np.stack(batch["a"].to_numpy()), np.stack(batch["b"].to_numpy())
                own = [x.T @ y, x.T @ x, y.T @ y]
                total = own if total is None else [t + o for t, o in zip(total, own, strict=True)]
        for kind, t in zip(("kl", "kk", "ll"), total or [], strict=False):
            p, q = np.indices(t.shape)
            yield pd.DataFrame({"kind": kind, "p": p.ravel(), "q": q.ravel(), "s": t.ravel()})

    parts = rows.select(F.col(a).alias("a"), F.col(b).alias("b")).mapInPandas(run, "kind string, p int, q int, s double")
    return parts.groupBy("kind", "p", "q").agg(F.sum("s").alias("s"))


def totals(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, sa, sb, the number of items and the sums of their vectors."""
    def of(c: str, name: str) -> DataFrame:
        sums = rows.select(F.posexplode(c).alias("p", "v")).groupBy("p").agg(F.sum("v").alias("v"))
        return sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x["v"]).alias(name))  # a number for each dimension

    return rows.agg(F.count(F.lit(1)).cast("double").alias("n")).crossJoin(of(a, "sa")).crossJoin(of(b, "sb"))  # one row each


def linear_cka(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Biased linear CKA from centred column products: dimensions squared, never items squared."""
    both = moments(rows, a, b).crossJoin(F.broadcast(totals(rows, a, b)))  # one row
    first, second = F.when(F.col("kind") == "ll", F.col("sb")).otherwise(F.col("sa")), F.when(F.col("kind") == "kk", F.col("sa")).otherwise(F.col("sb"))
    centred = F.col("s") - F.element_at(first, F.col("p") + 1) * F.element_at(second, F.col("q") + 1) / F.col("n")
    h = both.select("kind", (centred * centred).alias("c")).agg(*[F.sum(F.when(F.col("kind") == k, F.col("c"))).alias(k) for k in ("kl", "kk", "ll")])
    return h.select((F.col("kl") / (F.sqrt(F.col("kk") * F.col("ll")) + F.lit(1e-6))).alias("cka"))


def _unbiased(x: str, a: str, b: str, p: str, m: Column) -> Column:
    """The estimator from the sum of products x, the sums a and b and the product of row sums p."""
    return (F.col(x) + F.col(a) * F.col(b) / ((m - 1) * (m - 2)) - F.lit(2.0) * F.col(p) / (m - 2)) / (m * (m - 3))


def unbiased_linear_cka(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Zero-diagonal CKA of linear kernels. A row sum is the product of a vector with the sum of all, so no pair of items is formed."""
    sums = totals(rows, a, b)
    va, vb = F.col(a), F.col(b)
    each = rows.crossJoin(F.broadcast(sums)).select("n", dot(va, va).alias("na"), dot(vb, vb).alias("nb"), dot(va, F.col("sa")).alias("ta"), dot(vb, F.col("sb")).alias("tb"))  # one row
    each = each.select("n", "na", "nb", (F.col("ta") - F.col("na")).alias("ra"), (F.col("tb") - F.col("nb")).alias("rb"))
    total = lambda x, y, name: F.sum(F.col(x) * F.col(y)).alias(name)
    rowwise = each.agg(F.max("n").alias("n"), F.sum("ra").alias("sra"), F.sum("rb").alias("srb"), total("ra", "rb", "pkl"), total("ra", "ra", "pkk"), total("rb", "rb", "pll"), total("na", "nb", "dkl"), total("na", "na", "dkk"), total("nb", "nb", "dll"))
    squares = moments(rows, a, b).agg(*[F.sum(F.when(F.col("kind") == c, F.col("s") * F.col("s"))).alias(c) for c in ("kl", "kk", "ll")])
    one = rowwise.crossJoin(squares).select("*", *[(F.col(c) - F.col(f"d{c}")).alias(f"x{c}") for c in ("kl", "kk", "ll")])  # one row each
    m = F.col("n")
    kl, kk, ll = _unbiased("xkl", "sra", "srb", "pkl", m), _unbiased("xkk", "sra", "sra", "pkk", m), _unbiased("xll", "srb", "srb", "pll", m)
    return one.select((kl / (F.sqrt(kk * ll) + F.lit(1e-6))).alias("unbiased_cka"))


def rbf_cka(rows: DataFrame, key: str, a: str, b: str, sigma: float = 1.0, block: int = 2048) -> DataFrame:
    """Biased CKA of Gaussian kernels: the kernels of block pairs become row sums where they are made; a pair never leaves its task."""
    import numpy as np
    import pandas as pd

    n = max(1, -(-rows.count() // block))
    dealt = rows.select(F.col(key).alias("id"), F.col(a).alias("a"), F.col(b).alias("b"), F.pmod(F.xxhash64(key), F.lit(n)).alias("blk"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left, right = dealt.withColumn("other", each), dealt.withColumnRenamed("blk", "other").withColumn("blk", each)
    names = ["k", "l", "kl", "kk", "ll"]

    def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        apart = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
        return np.exp(-np.maximum(apart, 0) / (2 * sigma**2))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({c: [] for c in ("id", *names)})
        k, l = (kernel(np.stack(x[c].to_numpy()), np.stack(y[c].to_numpy())) for c in ("a", "b"))
        return pd.DataFrame({"id": x["id"].to_numpy(), "k": k.sum(1), "l": l.sum(1), "kl": (k * l).sum(1), "kk": (k * k).sum(1), "ll": (l * l).sum(1)})

    parts = left.groupBy("blk", "other").cogroup(right.groupBy("blk", "other")).applyInPandas(run, "id long, " + ", ".join(f"{c} double" for c in names))
    by_row = parts.groupBy("id").agg(*[F.sum(c).alias(c) for c in names])
    pairs = {"kl": ("k", "l"), "kk": ("k", "k"), "ll": ("l", "l")}
    s = by_row.agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(c) for c in names], *[F.sum(F.col(x) * F.col(y)).alias(f"p{c}") for c, (x, y) in pairs.items()])
    h = {c: F.col(c) - F.lit(2.0) * F.col(f"p{c}") / F.col("n") + F.col(x) * F.col(y) / (F.col("n") * F.col("n")) for c, (x, y) in pairs.items()}
    return s.select((h["kl"] / (F.sqrt(h["kk"] * h["ll"]) + F.lit(1e-6))).alias("rbf_cka"))


def cknna(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """Unbiased CKA over the pairs that are neighbours in both views. a and b: i, j, sim of each item's nearest others."""
    k, l = F.col("k"), F.col("l")
    edges = a.select("i", "j", F.col("sim").alias("k")).join(b.select("i", "j", F.col("sim").alias("l")), ["i", "j"], "full")  # null: no neighbour there
    both = k.isNotNull() & l.isNotNull()
    sides = {"kl": (F.when(both, k), F.when(both, l)), "kk": (k, k), "ll": (l, l)}
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0.0)).alias(name)
    split = edges.select("i", "j", *[c.alias(f"{v}{name}") for name, pair in sides.items() for v, c in zip("ab", pair, strict=True)])
    turned = split.select(F.col("j").alias("i"), F.col("i").alias("j"), *[F.col(f"b{c}").alias(f"t{c}") for c in sides])  # neighbourhood is not symmetric
    products = split.join(turned, ["i", "j"]).agg(*[total(F.col(f"a{c}") * F.col(f"t{c}"), f"x{c}") for c in sides])
    columns = split.groupBy(F.col("j").alias("i")).agg(*[total(F.col(f"a{c}"), f"a{c}") for c in sides])
    rows = split.groupBy("i").agg(*[total(F.col(f"b{c}"), f"b{c}") for c in sides])
    cross = columns.join(rows, "i", "full").agg(*[total(F.col(f"a{c}") * F.col(f"b{c}"), f"p{c}") for c in sides], *[total(F.col(f"{v}{c}"), f"s{v}{c}") for v in "ab" for c in sides])
    one = products.crossJoin(cross)  # one row each
    kl, kk, ll = (_unbiased(f"x{c}", f"sa{c}", f"sb{c}", f"p{c}", F.lit(float(n))) for c in sides)
    return one.select((kl / (F.sqrt(kk * ll) + F.lit(1e-6))).alias("cknna"))


def svcca(rows: DataFrame, a: str, b: str, dims: int = 10) -> float:
    """Mean canonical correlation of the leading `dims` singular directions of the standardised views.

    The directions' correlations follow from the views' products, dims squared numbers, which come to the driver; items do not.
    """
    import numpy as np

    one = totals(rows, a, b).first()
    n, means = one["n"], (np.array(one["sa"]), np.array(one["sb"]))
    got = moments(rows, a, b).toPandas().sort_values(["p", "q"])
    product = {}
    for c, x, y in (("kl", 0, 1), ("kk", 0, 0), ("ll", 1, 1)):
        outer = np.outer(means[x], means[y])
        product[c] = got[got["kind"] == c]["s"].to_numpy().reshape(outer.shape) - outer / n
    scale = [np.sqrt(np.diag(product[c]) / (n - 1)) + 1e-8 for c in ("kk", "ll")]
    kl, kk, ll = product["kl"] / np.outer(*scale), product["kk"] / np.outer(scale[0], scale[0]), product["ll"] / np.outer(scale[1], scale[1])

    def leading(x: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(x)
        top = values.argsort()[::-1][:dims]
        return vectors[:, top] / np.sqrt(np.maximum(values[top], 1e-12))

    return float(np.linalg.svd(leading(kk).T @ kl @ leading(ll), compute_uv=False).clip(0, 1).mean())


METRICS = ("mutual_knn", "cycle_knn", "lcs_knn", "edit_distance_knn", "cka", "unbiased_cka", "cknna", "svcca")


def check_metric(name: str) -> str:
    if name not in METRICS:
        raise ValueError(f"unknown alignment metric {name}")
    return name


def neighbour_lists(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, a, b: each item's neighbours in both views, nearest first."""
    ordered = lambda x, name: x.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "j"))), lambda e: e["j"]).alias(name))
    return ordered(a, "a").join(ordered(b, "b"), "i")


def row_distances(rows: DataFrame, a: str, b: str, distance, name: str = "distance") -> DataFrame:
    """rows with a number for each pair of arrays, by an Arrow function of two lists."""
    import pandas as pd

    each = F.pandas_udf(lambda x, y: pd.Series([float(distance(list(p), list(q))) for p, q in zip(x, y, strict=True)], dtype="f8"), "double")
    return rows.withColumn(name, each(a, b))


def measured(metric: str, rows: DataFrame, key: str, a: str, b: str, k: int = 10, dims: int = 10) -> DataFrame:
    """One row with a metric, by its name, of two views (arrays) of the items; names that are none raise."""
    from leadframe.functions.kernels import edits, longest_common

    check_metric(metric)
    if metric == "cka":
        return linear_cka(rows, a, b)
    if metric == "unbiased_cka":
        return unbiased_linear_cka(rows, a, b)
    if metric == "svcca":
        return rows.sparkSession.createDataFrame([(svcca(rows, a, b, dims),)], "svcca double")
    if metric == "cknna" and k < 2:
        raise ValueError("cknna needs two neighbours and more")
    n, na, nb = rows.count(), neighbours_blocked(rows, key, a, k), neighbours_blocked(rows, key, b, k)
    if metric == "mutual_knn":
        return mutual_knn(na, nb, k, n)
    if metric == "cycle_knn":
        return cycle_knn(na, nb, n)
    if metric == "cknna":
        return cknna(na, nb, n)
    lists = neighbour_lists(na, nb)
    if metric == "lcs_knn":
        return row_distances(lists, "a", "b", longest_common).agg(F.avg("distance").alias("lcs_knn"))
    return row_distances(lists, "a", "b", edits).agg((1 - F.avg("distance") / k).alias("edit_distance_knn"))


def looked_up(tokens: DataFrame, vectors: DataFrame, token: str, vec: str, dims: int) -> DataFrame:
    """tokens with the vector of each; pads and unknown tokens have zeros."""
    return tokens.join(vectors, token, "left").withColumn(vec, F.coalesce(F.col(vec), F.array_repeat(F.lit(0.0), dims)))


def scattered(rows: DataFrame, written: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """rows with the vectors written at their keys; all-zero vectors are not written."""
    new = written.select(*keys, F.col(vec).alias("_new")).where(F.exists("_new", lambda x: x != 0))
    return rows.join(new, keys, "left").withColumn(vec, F.coalesce("_new", vec)).drop("_new")


def injected(positions: DataFrame, signals: DataFrame, example: str, vec: str, index: str, strict: bool = False) -> DataFrame:
    """positions (example, pos, vec) with the k-th signal vector of an example at the k-th index of its array `index`.

    signals: example, k, vec. Pads (-2), the -1 of an example without a place, all-zero vectors and places beyond the
    example's positions are not written; strict raises at such a place instead. Without signals all stays as it is.
    """
    asked = signals.select(example, "k", F.col(vec).alias("_new")).join(positions.select(example, index).distinct(), example)
    at = asked.withColumn("pos", F.try_element_at(F.col(index), (F.col("k") + 1).cast("int")).cast("long"))
    extent = positions.groupBy(example).agg(F.max("pos").alias("_last"))
    placed = at.join(extent, example)
    inside = (F.col("pos") >= 0) & (F.col("pos") <= F.col("_last"))
    if strict:
        placed = placed.withColumn("pos", F.when(F.coalesce(inside, F.lit(False)), F.col("pos")).otherwise(F.raise_error(F.lit("a signal position is out of range"))))
    usable = placed.where(inside & F.exists("_new", lambda x: x != 0)).select(example, "pos", "_new")
    return positions.join(usable, [example, "pos"], "left").withColumn(vec, F.coalesce("_new", vec)).drop("_new")


def masked_mean(positions: DataFrame, keys: list[str], vec: str, mask: str, dims: int) -> DataFrame:
    """keys and the mean vector of the positions whose mask is 1, over at least one; zeros where none is."""
    kept = [F.sum(F.when(F.col(mask) == 1, F.element_at(vec, d + 1)).otherwise(0.0)) for d in range(dims)]
    n = F.greatest(F.sum(F.col(mask).cast("double")), F.lit(1.0))
    return positions.groupBy(*keys).agg(F.array(*[c / n for c in kept]).alias(vec))


def layer_mean(rows: DataFrame, example: str, vec: str, dims: int) -> DataFrame:
    """example and the mean over its layers' vectors."""
    return rows.groupBy(example).agg(F.array(*[F.avg(F.element_at(vec, d + 1)) for d in range(dims)]).alias(vec))


def pooled(vec: Column, n: int, k: int) -> Column:
    """n numbers averaged to k: bin i goes from floor(i n / k) to ceil((i + 1) n / k), so bins may overlap."""
    def part(i: int) -> Column:
        first, past = i * n // k, -(-(i + 1) * n // k)
        return F.aggregate(F.slice(vec, first + 1, past - first), F.lit(0.0), lambda s, x: s + x) / (past - first)

    return F.array(*[part(i) for i in range(k)])


def info_nce(pairs: DataFrame, a: str, b: str, key: str = "id", batch: str = "batch", temperature: float = 0.07) -> DataFrame:
    """batch, loss: row and column cross entropy of the batch's similarities, added; a row's own partner is the right one. Both sides are scaled to unit length."""
    x = pairs.select(batch, F.col(key).alias("i"), normalised(F.col(a)).alias("x"))
    y = pairs.select(batch, F.col(key).alias("j"), normalised(F.col(b)).alias("y"))
    s = x.join(y, batch).select(batch, "i", "j", (dot(F.col("x"), F.col("y")) / temperature).alias("s"))
    own = F.max(F.when(F.col("i") == F.col("j"), F.col("s")))
    side = lambda c: s.groupBy(batch, c).agg((F.log(F.sum(F.exp("s"))) - own).alias("l")).groupBy(batch).agg(F.avg("l").alias(f"l{c}"))
    return side("i").join(side("j"), batch).select(batch, (F.col("li") + F.col("lj")).alias("loss"))
