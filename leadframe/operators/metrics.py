"""Text metrics over (reference, hypothesis) pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadframe.functions import r6
from leadframe.functions.kernels import common_words, t_quantile
from leadframe.functions.stems import meteor

from .alignment import dot, normalised


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams, joined by a space."""
    count = F.size(tokens) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def ngram_counts(pairs: DataFrame, key: list[str], most: int = 4) -> DataFrame:
    """key, n, matched, total, ref_len, hyp_len. Hypothesis n-grams match at most as often as the reference has them.

    Each side's n-grams are counted apart in one aggregate by (key, n, n-gram); the smaller of the two counts is what matches.
    """
    tokens = pairs.select(*key, words(F.col("ref")).alias("r"), words(F.col("hyp")).alias("h"))

    def of_order(c: str, n: int) -> Column:
        return F.transform(ngrams(F.col(c), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))

    grams = lambda c: F.flatten(F.array(*[of_order(c, n) for n in range(1, most + 1)]))
    side = lambda c, mine: tokens.select(*key, F.explode(grams(c)).alias("e")).select(*key, "e.*", F.lit(mine).alias("mine"))
    counts = side("r", 0).union(side("h", 1)).groupBy(*key, "n", "g").agg(F.sum("mine").alias("h"), F.sum(1 - F.col("mine")).alias("r"))
    matched = counts.groupBy(*key, "n").agg(F.sum(F.least("h", "r")).alias("matched"))
    orders = F.explode(F.array(*[F.lit(n) for n in range(1, most + 1)]))
    sizes = tokens.select(*key, F.size("r").cast("long").alias("ref_len"), F.size("h").cast("long").alias("hyp_len"), orders.alias("n"))
    rows = sizes.join(matched, [*key, "n"], "left")
    return rows.select(*key, "n", F.coalesce("matched", F.lit(0)).cast("long").alias("matched"), F.greatest(F.col("hyp_len") - F.col("n") + 1, F.lit(0)).cast("long").alias("total"), "ref_len", "hyp_len")


def sentence_bleu(counts: DataFrame, key: list[str]) -> DataFrame:
    """key, bleu of each pair, with orders up to the shorter of the two, 4 at most; 0 where no word matches."""
    kept = counts.withColumn("top", F.least(F.lit(4), "ref_len", "hyp_len")).where("n <= top")
    ratio = F.when(F.col("matched") == 0, 0.1).otherwise(F.col("matched").cast("double")) / F.greatest("total", F.lit(1))
    each = kept.groupBy(*key).agg(F.max(F.when(F.col("n") == 1, F.col("matched"))).alias("m1"), F.max("ref_len").alias("r"), F.max("hyp_len").alias("h"), F.max("top").alias("top"), F.sum(F.log(ratio)).alias("s"))
    brevity = F.when(F.col("h") > F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("h")))
    return each.select(*key, F.when(F.col("m1") > 0, brevity * F.exp(F.col("s") / F.col("top"))).otherwise(0.0).alias("bleu"))


def sentences(text: Column) -> Column:
    """What stands between periods, each with single spaces; nothing between two periods is none, but blanks are an empty sentence."""
    parts = F.filter(F.split(text, r"\."), lambda s: s != "")
    return F.transform(parts, lambda s: F.array_join(words(s), " "))


def sentence_words(text: Column) -> Column:
    """The words of all sentences; an empty sentence has one empty word."""
    return F.flatten(F.transform(sentences(text), lambda s: F.split(s, " ")))


def _f_measure(found: Column, ref: Column, hyp: Column) -> Column:
    recall, precision = F.coalesce(F.try_divide(found, ref), F.lit(0.0)), F.coalesce(F.try_divide(found, hyp), F.lit(0.0))
    return F.lit(2.0) * (precision * recall / (precision + recall + F.lit(1e-8)))


def rouge_n(ref: Column, hyp: Column, n: int) -> Column:
    """F of the sets of n-grams; ref and hyp: columns that hold the words of all sentences, which are looked at many times."""
    r, h = (F.array_distinct(ngrams(x, n)) for x in (ref, hyp))
    return _f_measure(F.size(F.array_intersect(r, h)), F.size(r), F.size(h))


def rouge_l(ref: Column, hyp: Column) -> Column:
    """Summary-level F: the distinct words that the longest common subsequences of all sentence pairs reach, over the distinct words of each side."""
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for r, h in zip(a, b, strict=True):
            rs, hs = [x.split(" ") for x in r], [x.split(" ") for x in h]
            reached = {w for x in rs for y in hs for w in common_words(x, y)}
            n, m = len({w for x in hs for w in x}), len({w for x in rs for w in x})
            p, q = (len(reached) / n if n else 0.0), (len(reached) / m if m else 0.0)
            out.append(2 * (p * q / (p + q + 1e-8)))
        return pd.Series(out, dtype="f8")

    return score(sentences(ref), sentences(hyp))


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("num_pairs"), F.coalesce(F.avg((F.col("ref") == F.col("hyp")).cast("int")), F.lit(0.0)).alias("accuracy"))


def scored(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows (key, ref, hyp) with both sides non-empty; an unequal number of references and hypotheses (a null side) raises."""
    if not rows.where("ref IS NULL OR hyp IS NULL").isEmpty():
        raise ValueError("the number of references and hypotheses must be the same")
    return rows.where((F.col("ref") != "") & (F.col("hyp") != "")).select(*key, "ref", "hyp")


def report(rows: DataFrame, key: list[str], most: int = 4) -> DataFrame:
    """One row: num_pairs, bleu, bleu_sent, meteor_es, rouge_1, rouge_2, rouge_l, accuracy of the non-empty pairs; all 0 where there is none."""
    pairs = scored(rows, key)
    counts = ngram_counts(pairs, key, most)
    meteor_of = F.pandas_udf(lambda a, b: pd.Series([meteor(r.split(), h.split()) for r, h in zip(a, b, strict=True)], dtype="f8"), "double")
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    each = pairs.select("ref", "hyp", meteor_of("ref", "hyp").alias("m"), rouge_l(F.col("ref"), F.col("hyp")).alias("l"), sentence_words(F.col("ref")).alias("rw"), sentence_words(F.col("hyp")).alias("hw"))
    each = each.select("ref", "hyp", "m", "l", *[rouge_n(F.col("rw"), F.col("hw"), n).alias(f"r{n}") for n in (1, 2)])
    one = each.agg(F.count(F.lit(1)).alias("num_pairs"), zero(F.avg("m"), "meteor_es"), zero(F.avg("r1"), "rouge_1"), zero(F.avg("r2"), "rouge_2"), zero(F.avg("l"), "rouge_l"), zero(F.avg((F.col("ref") == F.col("hyp")).cast("int")), "accuracy"))
    return one.crossJoin(corpus_bleu(counts)).crossJoin(sentence_bleu(counts, key).agg(zero(F.avg("bleu"), "bleu_sent")))  # one row each


def turn_pairs(gold: DataFrame, generated: DataFrame) -> DataFrame:
    """conv_id, turn, ref, hyp: each gold response against what was generated for its turn, which had the gold turns before it as context."""
    return gold.select("conv_id", "turn", F.trim("text").alias("ref")).join(generated.select("conv_id", "turn", F.trim("text").alias("hyp")), ["conv_id", "turn"])


def run_pairs(folds: list, seeds: list) -> list[tuple]:
    """Folds and seeds in pairs, not all combinations; both lists must be of one length."""
    return list(zip(folds, seeds, strict=True))


def corpus_bleu(counts: DataFrame) -> DataFrame:
    """bleu of all pairs: zero numerators count as 0.1; 0 where no word matches."""
    sums = counts.groupBy("n").agg(F.sum("matched").alias("m"), F.sum(F.greatest("total", F.lit(1))).alias("t"), F.sum("ref_len").alias("r"), F.sum("hyp_len").alias("h"))
    one = sums.agg(F.count(F.lit(1)).alias("orders"), F.sum(F.log(F.when(F.col("m") == 0, 0.1).otherwise(F.col("m").cast("double")) / F.col("t"))).alias("s"), F.max("r").alias("r"), F.max("h").alias("h"), F.max(F.when(F.col("n") == 1, F.col("m"))).alias("m1"))
    brevity = F.when(F.col("h") > F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("h")))
    return one.select(r6(F.when(F.col("m1") > 0, brevity * F.exp(F.col("s") / F.col("orders"))).otherwise(0.0)).alias("bleu"))


def run_statistics(runs: DataFrame, metric: str, value: str) -> DataFrame:
    """metric, runs, mean, std (n - 1), half width of the 95 % interval; values count in percent, a single run has nulls."""
    n = F.count(F.lit(1))
    quantiles = F.create_map(*[F.lit(x) for k in range(1, 31) for x in (k, t_quantile(0.975, k))])
    std = F.stddev_samp(F.col(value) * 100)
    return runs.groupBy(metric).agg(n.alias("runs"), r6(F.avg(F.col(value) * 100)).alias("mean"), r6(std).alias("std"), r6(F.element_at(quantiles, F.least(n, F.lit(31)).cast("int") - 1) * std / F.sqrt(n.cast("double"))).alias("half_width"))


def greedy_match(ref: Column, hyp: Column) -> Column:
    """precision, recall, f1 of two arrays of token vectors: the mean of each token's largest cosine on the other side; 0 where a side is empty."""
    def best(of: Column, among: Column) -> Column:
        among = F.transform(among, normalised)
        each = F.transform(F.transform(of, normalised), lambda x: F.array_max(F.transform(among, lambda y: dot(x, y))))
        return F.when((F.size(of) > 0) & (F.size(among) > 0), F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(of)).otherwise(0.0)

    p, r = best(hyp, ref), best(ref, hyp)
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"))
