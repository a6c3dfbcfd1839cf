"""Queries over symbol strings and token sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leadframe import surface
from leadframe.functions import r6
from leadframe.operators import tokens, vectors
from leadframe.session import scratch, table
from leadframe.sources import files

from .registry import query
from .signals import R6, SYMBOLS, symbols

CHARS = f"WITH {SYMBOLS}, c AS (SELECT user_id, i::BIGINT AS pos, substr(symbols, i::INT + 1, 1) AS c FROM sym, unnest(range(length(symbols))) t(i))"
#: Merges whose ids the encode queries use: by rank, left and right letters or ids.
FIXED_MERGES = [(ord("m"), ord("m"), 256, 0), (ord("l"), ord("m"), 257, 0), (256, ord("l"), 258, 0)]


@query(f"WITH {SYMBOLS}, t AS (SELECT unnest(list_transform(regexp_extract_all(symbols, 'mml|mm|lm|.'), lambda x: CASE x WHEN 'mm' THEN 256 WHEN 'lm' THEN 257 WHEN 'mml' THEN 258 ELSE ascii(x) END)) AS id FROM sym), f AS (SELECT id, count(*) AS freq FROM t GROUP BY 1) SELECT r.id::BIGINT AS id, coalesce(freq, 0)::BIGINT AS freq FROM range((SELECT max(id) + 1 FROM f)) r(id) LEFT JOIN f USING (id)")
def q40_token_frequencies(spark, sf_dir):
    """Counts of token ids up to the greatest, with zeros for those that do not occur."""
    ids = tokens.encode(symbols(spark, sf_dir), "user_id", "symbols", FIXED_MERGES).select(F.explode(F.col("ids").cast("array<bigint>")).alias("id"))
    return tokens.frequencies(ids, "id")


PAIRS = CHARS + ", pr AS (SELECT c AS l, lead(c) OVER (PARTITION BY user_id ORDER BY pos) AS r FROM c), pc AS (SELECT l, r, count(*) AS n FROM pr WHERE r IS NOT NULL GROUP BY 1, 2)"


@query(PAIRS + " SELECT l, r, n FROM pc")
def q41_pair_counts(spark, sf_dir):
    return tokens.pair_counts(symbols(spark, sf_dir), "user_id", "symbols")


@query(PAIRS + " SELECT l, r, n FROM pc ORDER BY n DESC, l, r LIMIT 1")
def q42_best_pair(spark, sf_dir):
    return tokens.best_pair(tokens.pair_counts(symbols(spark, sf_dir), "user_id", "symbols"))


@query()
def q43_bpe_merges(spark, sf_dir):
    """Sixteen merges learned from the records' symbol strings."""
    merges = tokens.train_merges(symbols(spark, sf_dir), "symbols", 16, scratch(spark, "merges"))
    return spark.createDataFrame([(k, *m) for k, m in enumerate(merges)], "rank long, left long, right long, id long, n long")


@query(f"WITH {SYMBOLS} SELECT user_id, len(regexp_extract_all(symbols, 'mml|mm|lm|.'))::BIGINT AS n_tokens, array_to_string(list_transform(regexp_extract_all(symbols, 'mml|mm|lm|.'), lambda x: CASE x WHEN 'mm' THEN '256' WHEN 'lm' THEN '257' WHEN 'mml' THEN '258' ELSE ascii(x)::VARCHAR END), ' ') AS ids FROM sym")
def q44_greedy_encode(spark, sf_dir):
    rows = tokens.encode(symbols(spark, sf_dir), "user_id", "symbols", FIXED_MERGES)
    return rows.select("user_id", F.size("ids").cast("long").alias("n_tokens"), F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(f"WITH {SYMBOLS} SELECT user_id, symbols AS decoded FROM sym")
def q45_decode(spark, sf_dir):
    rows = tokens.encode(symbols(spark, sf_dir), "user_id", "symbols", FIXED_MERGES)
    return rows.select("user_id", tokens.decode(rows, FIXED_MERGES).alias("decoded"))


@query(f"WITH {SYMBOLS}, e AS (SELECT length(symbols) AS a, len(regexp_extract_all(symbols, 'mml|mm|lm|.')) AS b FROM sym) SELECT sum(a)::BIGINT AS original, sum(b)::BIGINT AS encoded, {R6.format('sum(a) / sum(b)::DOUBLE')} AS ratio, 259::BIGINT AS vocabulary FROM e")
def q46_compression(spark, sf_dir):
    source = symbols(spark, sf_dir)
    encoded = tokens.encode(source, "user_id", "symbols", FIXED_MERGES)
    rows = encoded.select(F.length(tokens.decode(encoded, FIXED_MERGES)).alias("a"), F.size("ids").alias("b"))
    return rows.agg(F.sum("a").alias("original"), F.sum("b").alias("encoded"), r6(F.sum("a") / F.sum("b")).alias("ratio")).withColumn("vocabulary", F.lit(256 + len(FIXED_MERGES)).cast("long"))


@query(CHARS + """, f AS (SELECT c, count(*) AS n FROM c GROUP BY 1), k AS (SELECT user_id, c.c FROM c JOIN f USING (c) WHERE n >= 100)
SELECT user_id, count(*) AS kept FROM k GROUP BY 1 HAVING count(*) > 1""")
def q47_min_count(spark, sf_dir):
    chars = tokens.exploded(symbols(spark, sf_dir), "user_id", "symbols")
    frequent = chars.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n >= 100")
    return chars.join(F.broadcast(frequent), "c").groupBy("user_id").agg(F.count(F.lit(1)).alias("kept")).where("kept > 1")  # at most 26 letters


@query(CHARS + f", f AS (SELECT c, count(*)::DOUBLE AS n FROM c GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS total FROM f) SELECT c, {R6.format('least(1.0, sqrt(1e-5 / greatest(1e-12, n / greatest(1, total))) + 1e-5 / greatest(1e-12, n / greatest(1, total)))')} AS keep, {R6.format('pow(n, 0.75) / sum(pow(n, 0.75)) OVER ()')} AS noise FROM t")
def q48_subsampling_and_noise(spark, sf_dir):
    """Keep probability of each symbol, and its share of the noise distribution."""
    freq = tokens.exploded(symbols(spark, sf_dir), "user_id", "symbols").groupBy("c").agg(F.count(F.lit(1)).cast("double").alias("n"))
    totals = freq.agg(F.sum("n").alias("total"), F.sum(F.pow("n", F.lit(0.75))).alias("mass"))
    both = freq.crossJoin(F.broadcast(totals))  # one row
    return both.select("c", r6(tokens.keep_probability(F.col("n"), F.col("total"))).alias("keep"), r6(F.pow("n", F.lit(0.75)) / F.col("mass")).alias("noise"))


@query(CHARS + " SELECT a.c AS center, b.c AS context, count(*) AS n FROM c a JOIN c b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND a.pos <> b.pos GROUP BY 1, 2")
def q50_skip_gram(spark, sf_dir):
    return tokens.skip_gram_pairs(tokens.exploded(symbols(spark, sf_dir), "user_id", "symbols"), "user_id", "pos", "c", 2)


@query("""WITH t AS (SELECT doc_id, len(string_split(text, ' '))::BIGINT AS ecg, doc_id % 40 AS before, doc_id % 90 AS after FROM documents)
SELECT doc_id, CASE WHEN before + ecg + after <= 512 THEN ecg ELSE least(ecg, greatest(100, 512 - before - after)) END AS kept,
 CASE WHEN before + ecg + after <= 512 THEN after ELSE 512 - before - least(ecg, greatest(100, 512 - before - after)) END AS rest,
 CASE WHEN before + ecg + after <= 512 THEN 512 - before - ecg - after ELSE 0 END AS padding FROM t""")
def q51_token_budget(spark, sf_dir):
    kept, rest, padding = tokens.budget(F.col("before"), F.col("ecg"), F.col("after"), 512, 100)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", " ", -1)).cast("long").alias("ecg"), (F.col("doc_id") % 40).alias("before"), (F.col("doc_id") % 90).alias("after"))
    return rows.select("doc_id", kept.alias("kept"), rest.alias("rest"), padding.alias("padding"))


@query(CHARS + """, a AS (SELECT user_id, list(ascii(c) ORDER BY pos) AS ids FROM c GROUP BY 1), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY user_id // 8) AS w FROM a)
SELECT user_id, array_to_string(list_concat(ids, list_transform(range(w - len(ids)), lambda x: -2)), ' ') AS padded FROM m""")
def q52_ragged_pad(spark, sf_dir):
    """Batches of eight records, whole symbol strings padded with -2 to the longest of the batch."""
    rows = symbols(spark, sf_dir).select("user_id", F.transform(F.split("symbols", ""), lambda c: F.ascii(c)).alias("ids"))
    rows = rows.withColumn("ids", F.filter("ids", lambda x: x > 0))
    width = F.max(F.size("ids")).over(Window.partitionBy(F.floor(F.col("user_id") / 8)))
    return rows.withColumn("w", width).select("user_id", F.array_join(F.concat("ids", F.array_repeat(F.lit(-2), F.col("w") - F.size("ids"))).cast("array<string>"), " ").alias("padded"))


@query()
def q56_skip_gram_vectors(spark, sf_dir):
    """Vectors of the symbols, trained on the pair counts of all records."""
    counted = tokens.skip_gram_pairs(tokens.exploded(symbols(spark, sf_dir), "user_id", "symbols"), "user_id", "pos", "c", 2)
    names, trained, _ = vectors.train(counted)
    return spark.createDataFrame([(t, v.tolist()) for t, v in zip(names, trained, strict=True)], "token string, vector array<double>")


@query(f"WITH {SYMBOLS} SELECT user_id, symbols AS decoded FROM sym")
def q49_learned_round_trip(spark, sf_dir):
    """Merges learned from all records, stored and loaded as a table, and every record encoded by them and decoded."""
    source, folder = symbols(spark, sf_dir), scratch(spark, "learned")
    tokens.save_merges(spark, tokens.train_merges(source, "symbols", 64, f"{folder}/ids"), f"{folder}/merges")
    merges = tokens.load_merges(spark, f"{folder}/merges")
    rows = tokens.encode(source, "user_id", "symbols", merges)
    return rows.select("user_id", tokens.decode(rows, merges).alias("decoded"))


@query(f"WITH {SYMBOLS}, t AS (SELECT user_id, regexp_extract_all(symbols, 'mml|mm|lm|.') AS x FROM sym) SELECT user_id, array_to_string(list_transform(x, lambda t: 'signal_' || CASE t WHEN 'mm' THEN '256' WHEN 'lm' THEN '257' WHEN 'mml' THEN '258' ELSE ascii(t)::VARCHAR END), ' ') AS names, len(x)::BIGINT AS n FROM t")
def q114_signal_tokens(spark, sf_dir):
    """Names of signal tokens in a model's vocabulary; n ids come back from them, and none from a name that is no signal token."""
    rows = tokens.encode(symbols(spark, sf_dir), "user_id", "symbols", FIXED_MERGES).withColumn("names", tokens.signal_tokens(F.col("ids")))
    back = tokens.signal_ids(F.concat("names", F.array(F.lit("signal_"), F.lit("signal_x"), F.lit("other_7"))))
    return rows.where(back == F.col("ids").cast("array<bigint>")).select("user_id", F.array_join("names", " ").alias("names"), F.size(back).cast("long").alias("n"))


@query(CHARS + """, a AS (SELECT user_id, list(ascii(c)::BIGINT ORDER BY pos) AS ids FROM c GROUP BY 1)
SELECT user_id, array_to_string(CASE WHEN len(ids) >= 60 THEN ids[-60:] ELSE list_concat(list_transform(range(60 - len(ids)), lambda x: 0), ids) END, ' ') AS padded FROM a""")
def q115_left_pad(spark, sf_dir):
    """The last 60 symbols of a record, padded on the left: what fits a model's input."""
    ids = F.filter(F.transform(F.split("symbols", ""), lambda c: F.ascii(c).cast("long")), lambda x: x > 0)
    rows = symbols(spark, sf_dir).select("user_id", ids.alias("ids"))
    return rows.select("user_id", F.array_join(tokens.left_padded(F.col("ids"), 60, F.lit(0).cast("long")).cast("array<string>"), " ").alias("padded"))


@query(CHARS + """, f AS (SELECT c, count(*)::DOUBLE AS n FROM c GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS total FROM f), k AS (SELECT c, least(1.0, sqrt(1e-2 / (n / total)) + 1e-2 / (n / total)) AS keep FROM t)
SELECT user_id, pos, c FROM c JOIN k USING (c) WHERE (('0x' || substr(md5('42:' || user_id || ':' || pos), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE < keep""")
def q116_subsample(spark, sf_dir):
    """The places that subsampling of frequent symbols keeps."""
    chars = tokens.exploded(symbols(spark, sf_dir), "user_id", "symbols")
    freq = chars.groupBy("c").agg(F.count(F.lit(1)).cast("double").alias("n"))
    known = freq.crossJoin(F.broadcast(freq.agg(F.sum("n").alias("total"))))  # one row
    kept = tokens.subsampled(chars.join(F.broadcast(known), "c"), "user_id", "pos", "c", "n", "total", 1e-2)  # at most 26 letters
    return kept.select("user_id", F.col("pos").cast("long").alias("pos"), "c")


@query(CHARS + ", f AS (SELECT c, count(*) AS freq FROM c GROUP BY 1), g AS (SELECT freq, count(*) AS tokens FROM f GROUP BY 1) SELECT (sum(tokens) OVER (ORDER BY freq DESC) - tokens + 1)::BIGINT AS rank, freq, tokens FROM g")
def q121_rank_frequency(spark, sf_dir):
    """What a rank-frequency plot of the symbols shows."""
    counts = tokens.exploded(symbols(spark, sf_dir), "user_id", "symbols").groupBy("c").agg(F.count(F.lit(1)).alias("freq"))
    return files.rank_frequency(counts, "freq")


@query(f"""WITH l AS (SELECT n_chars::DOUBLE AS v FROM documents), e AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 30 AS w FROM l), b AS (SELECT least(floor((v - lo) / w), 29)::BIGINT AS bin, count(*) AS n FROM l, e GROUP BY 1)
SELECT r.bin::BIGINT AS bin, {R6.format('lo + r.bin * w')} AS low, {R6.format('lo + (r.bin + 1) * w')} AS high, coalesce(n, 0)::BIGINT AS n FROM range(30) r(bin) CROSS JOIN e LEFT JOIN b ON b.bin = r.bin""")
def q122_length_histogram(spark, sf_dir):
    """Thirty bins of document lengths."""
    return files.histogram(table(spark, sf_dir, "documents"), F.col("n_chars")).select("bin", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), "n")


@query(f"""WITH {SYMBOLS}, t AS (SELECT user_id, regexp_extract_all(symbols, 'mml|mm|lm|.') AS x FROM sym), u AS (SELECT user_id, i::BIGINT AS place, x[i::INT + 1] AS t FROM t, unnest(range(len(x))) r(i)),
p AS (SELECT *, sum(length(t)) OVER (PARTITION BY user_id ORDER BY place)::BIGINT AS past FROM u)
SELECT user_id, place, CASE t WHEN 'mm' THEN 256 WHEN 'lm' THEN 257 WHEN 'mml' THEN 258 ELSE ascii(t) END::BIGINT AS id, past - length(t) AS first, past FROM p""")
def q123_token_spans(spark, sf_dir):
    """Which stretch of a record's symbols each token covers."""
    encoded = tokens.encode(symbols(spark, sf_dir), "user_id", "symbols", FIXED_MERGES)
    return files.token_spans(encoded, "user_id", "ids", {i: len(p) for i, p in tokens.pieces_of(FIXED_MERGES).items()})


@query(f"WITH {SYMBOLS}, e AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, symbols, symbols AS decoded, n // 8 AS segments FROM sym JOIN e USING (user_id)")
def q124_sql_surface(spark, sf_dir):
    """SQL text over views, with registered functions and a table function."""
    sql = """WITH s AS (SELECT user_id, transform(array_sort(collect_list(struct(event_type, ts, event_id, value))), x -> x.value) AS v FROM events GROUP BY user_id),
    g AS (SELECT user_id, count(*) AS segments FROM s, LATERAL segments_of(v, 8) GROUP BY user_id), y AS (SELECT user_id, symbolise(v) AS symbols FROM s)
    SELECT y.user_id, symbols, decode_symbols(encode_symbols(symbols)) AS decoded, coalesce(segments, 0L) AS segments FROM y LEFT JOIN g ON g.user_id = y.user_id"""
    return surface.query(spark, sf_dir, sql, FIXED_MERGES)
