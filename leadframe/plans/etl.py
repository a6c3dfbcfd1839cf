"""Catalogue, mapping and mixing queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leadframe.functions import r6
from leadframe.operators import etl, text
from leadframe.session import scratch, table
from leadframe.sources import files

from .registry import query


@query("SELECT c_custkey, concat_ws(' ', nullif(c_mktsegment, 'BUILDING'), n_name, CASE WHEN c_acctbal > 0 THEN 'credit' END) AS report FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE nullif(c_mktsegment, 'BUILDING') IS NOT NULL OR c_acctbal > 0")
def q10_report_concat(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    rows = rows.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("report_0"), F.col("n_name").alias("report_1"), F.when(F.col("c_acctbal") > 0, "credit").alias("report_2"))
    return etl.without_empty_reports(rows, ["report_0", "report_2"]).select("c_custkey", etl.report_text(["report_0", "report_1", "report_2"]).alias("report"))


@query("SELECT l_orderkey, l_linenumber, o_custkey, o_orderstatus, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus GROUP BY 1, 2, 3, 4")
def q11_two_key_join(spark, sf_dir):
    left, right = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    both = left.join(right, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linestatus") == F.col("o_orderstatus")))
    return both.groupBy("l_orderkey", "l_linenumber", "o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH k AS (SELECT page_id, split_part(string_split(split_part(url, '?', 1), '/')[-1], '-', 1) AS base FROM pages), c AS (SELECT base, max(page_id) AS winner FROM k GROUP BY 1)
SELECT page_id, base, winner FROM k JOIN c USING (base)""")
def q12_basename_join(spark, sf_dir):
    """Each page against the last page of its base name."""
    keyed = table(spark, sf_dir, "pages").select("page_id", etl.basename(F.substring_index("url", "?", 1)).alias("base"))
    catalogue = etl.last_by(keyed, "base", ["page_id"]).withColumnRenamed("page_id", "winner")
    return keyed.join(catalogue, "base").select("page_id", "base", "winner")


@query("""WITH s AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS seg_idx FROM lineitem)
SELECT o_orderkey, seg_idx::BIGINT AS seg_idx, o_orderkey || '_' || seg_idx AS stem FROM orders JOIN s ON o_orderkey = k WHERE seg_idx < 100""")
def q13_segment_expansion(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    segments = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1).cast("long").alias("seg_idx"))
    both = etl.expanded(table(spark, sf_dir, "orders").select("o_orderkey"), segments, ["o_orderkey"])
    return both.select("o_orderkey", "seg_idx", etl.segment_stem(F.col("o_orderkey").cast("string"), F.col("seg_idx")).alias("stem"))


@query("""WITH a AS (SELECT 'doc_' || doc_id % 300 || '_' || doc_id % 7 || '_' || doc_id AS name FROM documents), b AS (SELECT 'conv_' || conv_id || '_' || turn AS name FROM conversations),
ka AS (SELECT regexp_extract(name, '(\\d+)_(\\d+)', 1)::BIGINT AS k1, regexp_extract(name, '(\\d+)_(\\d+)', 2)::BIGINT AS k2, max(name) AS left_name FROM a GROUP BY 1, 2),
kb AS (SELECT regexp_extract(name, '(\\d+)_(\\d+)', 1)::BIGINT AS k1, regexp_extract(name, '(\\d+)_(\\d+)', 2)::BIGINT AS k2, max(name) AS right_name FROM b GROUP BY 1, 2)
SELECT k1, k2, left_name, right_name FROM ka JOIN kb USING (k1, k2)""")
def q14_regex_alignment(spark, sf_dir):
    d = F.col("doc_id")
    left = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), d % 300, F.lit("_"), d % 7, F.lit("_"), d).alias("name"))
    right = table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv_"), "conv_id", F.lit("_"), "turn").alias("name"))
    return etl.aligned(left, right)


@query("SELECT 'kept' AS part, count(*) AS n FROM documents d JOIN labels l USING (doc_id) WHERE trim(text) <> '' UNION ALL SELECT 'dropped', count(*) FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS NULL OR trim(text) = ''")
def q15_drop_any_null(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    kept, dropped = etl.complete(rows)
    return kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("part"), "n").union(dropped.select(F.lit("dropped"), "dropped"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def q16_type_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "purchase")).select("event_id", "user_id", "event_type")


@query("SELECT doc_id FROM documents ORDER BY (doc_id * 2654435761 + 42) % 4294967296, doc_id LIMIT (SELECT greatest(1, floor(0.6 * count(*))::BIGINT) FROM documents)")
def q17_sample_fraction(spark, sf_dir):
    """An exact sample of 60 % by hash order."""
    return etl.sample_fraction(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.6)


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text")
def q18_ordered_dedup(spark, sf_dir):
    return etl.first_by(table(spark, sf_dir, "documents").select("text", "doc_id", "lang"), "text", "doc_id").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"), "lang")


@query("""WITH p AS (SELECT page_id, string_split(regexp_replace(split_part(url, '?', 1), '^https?://', ''), '/') AS a FROM pages)
SELECT page_id, array_to_string(a, '_') AS plain, array_to_string(a[3:], '_') AS qa, 'records500_' || substr(a[1], 1, 2) || '000_' || a[1] AS ptb, split_part(a[-1], '-', 1) AS code15 FROM p""")
def q19_path_keys(spark, sf_dir):
    path = F.regexp_replace(F.substring_index("url", "?", 1), "^https?://", "")
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    p = F.col("path")
    return rows.select("page_id", etl.key_of("pretrain_mimic", p).alias("plain"), etl.key_of("ecg-qa_ptbxl", p).alias("qa"), etl.key_of("ptb-test", F.substring_index(p, "/", 1)).alias("ptb"), F.substring_index(F.substring_index(p, "/", -1), "-", 1).alias("code15"))


@query(r"""WITH d AS (SELECT doc_id, 'User: <ecg>' || chr(10) || 'The Image and image ' || text AS t FROM documents), s AS (SELECT doc_id, regexp_replace(t, '(?i)<(?:ecg|image)>\n?', '', 'g') AS t FROM d),
i AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\bI(?i:mage)\b', 'Signal', 'g'), '\bi(?i:mage)\b', 'signal', 'g') AS t FROM s)
SELECT doc_id, md5(regexp_replace(t, '^(?:\s*(?i:user|assistant|human|gpt|model|system|q|a)?\s*[:：]\s*)+', '')) AS digest FROM i""")
def q20_text_clean(spark, sf_dir):
    raw = F.concat(F.lit("User: <ecg>\nThe Image and image "), "text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(text.cleaned(raw), "UTF-8")).alias("digest"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (props ->> '$.k')::BIGINT END AS k, CASE WHEN event_id % 5 = 0 THEN 'raw ' || props END AS raw FROM events")
def q21_json_fallback(spark, sf_dir):
    """Every fifth cell is no JSON and stays as it is."""
    cell = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("raw "), "props")).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", cell.alias("cell")).withColumn("j", etl.decoded(F.col("cell"), "k long"))
    return rows.select("event_id", F.col("j.k").alias("k"), F.when(F.col("j.k").isNull(), F.col("cell")).alias("raw"))


@query("SELECT 0 AS part, doc_id AS id, lang, NULL::VARCHAR AS origin FROM documents UNION ALL SELECT 1, item_id, NULL, 'benchmark' FROM benchmark")
def q22_bag_union(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("origin"))
    return etl.mixed(a, b).select("part", "id", "lang", "origin")


@query("SELECT 'union' AS op, count(*) AS n FROM (SELECT l_partkey FROM lineitem UNION SELECT p_partkey FROM part) UNION ALL SELECT 'intersect', count(*) FROM (SELECT l_orderkey FROM lineitem INTERSECT SELECT o_orderkey FROM orders)")
def q23_set_operations(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    union = lineitem.select("l_partkey").union(table(spark, sf_dir, "part").select("p_partkey")).distinct()
    both = lineitem.select("l_orderkey").intersect(table(spark, sf_dir, "orders").select("o_orderkey"))
    return union.agg(F.count(F.lit(1)).alias("n")).select(F.lit("union").alias("op"), "n").union(both.agg(F.count(F.lit(1))).select(F.lit("intersect"), "*"))


@query("SELECT o_orderkey, o_custkey, (((o_custkey * 2654435761 + 42) % 4294967296 // 65536) % 5 + 1)::INT AS fold FROM orders")
def q24_grouped_folds(spark, sf_dir):
    return etl.folds(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


@query("SELECT CASE WHEN doc_id < 400 THEN 'train' ELSE 'test' END AS split, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def q25_split_prefix(spark, sf_dir):
    """The first 400 rows train, all others test; a split is a predicate on an explicit row index."""
    rows = table(spark, sf_dir, "documents")
    return rows.groupBy(F.when(F.col("doc_id") < 400, "train").otherwise("test").alias("split")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("WITH r AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS leads FROM events GROUP BY 1) SELECT user_id, n, leads, CASE WHEN leads < 5 THEN 'leads' WHEN n < 60 THEN 'short' END AS reason FROM r")
def q26_validity(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("leads"))
    return rows.withColumn("reason", F.when(F.col("leads") < 5, "leads").when(F.col("n") < 60, "short"))


@query("SELECT p_partkey, sum(l_quantity)::BIGINT AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def q30_top_k(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").cast("long").alias("quantity"))
    return lines.join(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").orderBy(F.desc("quantity"), "p_partkey").limit(50)


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def q31_membership(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT n_nationkey, count(s_suppkey) AS suppliers, floor(coalesce(sum(s_acctbal), 0) * 100 + 0.5) / 100 AS balance FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def q32_zero_fill(spark, sf_dir):
    by = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("s_suppkey").alias("suppliers"), F.sum("s_acctbal").alias("b"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey").join(by, "n_nationkey", "left")
    return rows.select("n_nationkey", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), (F.floor(F.coalesce("b", F.lit(0.0)) * 100 + 0.5) / 100).alias("balance"))


@query("SELECT count(*) AS lines, count(*) FILTER (trim(line) <> '' AND NOT starts_with(trim(line), '#')) AS code_lines FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)")
def q35_line_counts(spark, sf_dir):
    return etl.line_counts(table(spark, sf_dir, "documents"), "text")


@query("""WITH p AS (SELECT user_id, event_type <> 'view' AS inside, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS island FROM p WHERE inside) SELECT user_id, min(pos)::BIGINT AS first, (max(pos) + 1)::BIGINT AS past FROM g GROUP BY user_id, island""")
def q36_response_ranges(spark, sf_dir):
    """Ranges of a user's neighbouring events that are no views."""
    return etl.runs(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], F.col("event_type") != "view")


SHAPED = "(ARRAY['mimic', 'ptb', 'csn', 'code15', 'cpsc', 'other'])[doc_id % 6 + 1] AS dataset, CASE WHEN doc_id % 5 = 0 THEN 400 WHEN doc_id % 7 = 0 THEN NULL ELSE 500 END AS rate, CASE WHEN doc_id % 3 = 0 THEN 4096 ELSE 5000 END AS samples, CASE WHEN doc_id % 11 = 0 THEN 8 ELSE 12 END AS leads"


@query(f"""WITH r AS (SELECT doc_id, {SHAPED}, CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END AS report, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE 1250 END AS size FROM documents)
SELECT doc_id, CASE WHEN dataset = 'other' THEN 'dataset' WHEN coalesce(rate, 0) <> (CASE dataset WHEN 'code15' THEN 400 ELSE 500 END) THEN 'rate' WHEN dataset = 'code15' AND (samples <> 4096 OR leads <> 12) THEN 'shape' WHEN dataset IN ('mimic', 'ptb', 'csn') AND (samples <> 5000 OR leads <> 12) THEN 'shape' END AS record,
 CASE WHEN size = 0 THEN 'signal' WHEN report = '' THEN 'report' END AS instance FROM r""")
def q101_rejections(spark, sf_dir):
    """Why recordings are not taken by their data set's rate and shape, and why instances are not kept."""
    d = F.col("doc_id")
    dataset = F.element_at(F.array(*[F.lit(x) for x in ("mimic", "ptb", "csn", "code15", "cpsc", "other")]), (d % 6 + 1).cast("int"))
    rate = F.when(d % 5 == 0, 400).when(d % 7 == 0, None).otherwise(500)
    record = etl.rejections(dataset, rate, F.when(d % 3 == 0, 4096).otherwise(5000), F.when(d % 11 == 0, 8).otherwise(12))
    instance = etl.instance_rejections(F.when(d % 17 == 0, 0).otherwise(1250), F.when(d % 13 == 0, "").otherwise(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", record.alias("record"), instance.alias("instance"))


@query("SELECT user_id, CASE user_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'empty' WHEN 2 THEN 'nan' END AS reason FROM events GROUP BY 1")
def q102_input_guard(spark, sf_dir):
    """Signals that a tokenizer does not take: missing, empty, or with a NaN."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("value").alias("x"))
    u, none = F.col("user_id") % 5, F.lit(None).cast("array<array<double>>")
    signal = F.when(u == 0, none).when(u == 1, F.array(F.slice("x", 1, 0))).when(u == 2, F.array(F.col("x"), F.array(F.lit(float("nan"))))).otherwise(F.array("x"))
    return rows.select("user_id", etl.input_rejections(signal).alias("reason"))


@query("""WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY (('0x' || substr(md5('3:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
a AS (SELECT doc_id, i FROM h UNION ALL SELECT doc_id, i + n FROM h WHERE i < (7 - n % 7) % 7) SELECT doc_id, (i % 7)::INT AS shard, (i // 7)::BIGINT AS pos FROM a""")
def q108_shuffle(spark, sf_dir):
    """Documents in the order of epoch 3, dealt to seven shards of one length."""
    return etl.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", epoch=3, shards=7)


@query("""WITH k AS (SELECT doc_id FROM documents ORDER BY (doc_id * 2654435761 + 42) % 4294967296, doc_id LIMIT (SELECT greatest(1, floor(0.3 * count(*))::BIGINT) FROM documents))
SELECT 'left' AS side, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents JOIN k USING (doc_id) UNION ALL SELECT 'right', count(*), sum(doc_id)::BIGINT FROM labels JOIN k USING (doc_id)""")
def q109_paired_sample(spark, sf_dir):
    """The same positions of two lists."""
    left, right = etl.paired_fraction(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 0.3)
    one = lambda side, rows: rows.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))
    return one("left", left).union(one("right", right))


@query("""WITH d AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 1000) SELECT doc_id FROM d ORDER BY (doc_id * 2654435761 + 42) % 4294967296, doc_id LIMIT (SELECT greatest(1, floor(0.6 * count(*))::BIGINT) FROM d)""")
def q110_dev_then_toy(spark, sf_dir):
    """The first thousand rows, then 60 % of them: limits that are the feature."""
    return etl.catalogue_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", dev=1000, toy=True)


@query("""WITH p AS (SELECT page_id, split_part(url, '?', 1) AS path, split_part(string_split(split_part(url, '?', 1), '/')[-1], '.', 1) AS name FROM pages), c AS (SELECT name, max(path) AS path FROM p WHERE path LIKE 'https:%' GROUP BY 1)
SELECT page_id, replace(c.path, '/', '_') AS key FROM p LEFT JOIN c USING (name)""")
def q111_catalogued_keys(spark, sf_dir):
    """Items that name a file alone, looked up in a catalogue of the pages with https."""
    path = F.substring_index("url", "?", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.substring_index(F.substring_index(path, "/", -1), ".", 1).alias("name"))
    found, unknown = etl.catalogued_keys(rows.select("page_id", "name"), "name", rows.where("path LIKE 'https:%'").select("name", "path"))
    return found.select("page_id", "key").union(unknown.select("page_id", F.lit(None).cast("string")))


@query("""WITH p AS (SELECT page_id, regexp_replace(split_part(url, '?', 1), '^https?://', '') AS path FROM pages), a AS (SELECT page_id, string_split(path, '/') AS a, string_split(path, '/')[-1] AS l FROM p)
SELECT page_id, array_to_string(a, '_') AS plain, array_to_string(a[2:], '_') AS grounding_mimic, array_to_string(a[3:], '_') AS grounding_ptb, l AS grounding_code15,
 CASE WHEN len(a) > 1 THEN array_to_string(list_concat(['files'], a[1:-2], [split_part(l || '-0.png', '-', 1)]), '_') ELSE 'files_' || split_part(l || '-0.png', '-', 1) END AS pulse_mimic,
 'records500_' || substr(split_part(l, '_', 1) || '_hr', 1, 2) || '000_' || split_part(l, '_', 1) || '_hr' AS pulse_ptb, split_part(l, '-', 1) AS pulse_code15, 'records500_' || substr(l, 1, 2) || '000_' || l AS test_ptb FROM a""")
def q112_path_rules(spark, sf_dir):
    """The key rules of every corpus."""
    path = F.regexp_replace(F.substring_index("url", "?", 1), "^https?://", "")
    p, last = F.col("path"), F.substring_index("path", "/", -1)
    under = lambda head, tail="": F.concat(F.lit(head), p, F.lit(tail))
    rules = {
        "plain": ("ecg_instruct_45k", p), "grounding_mimic": ("ecg_grounding", F.concat(F.lit("mimic-iv/"), F.regexp_replace(p, "^[^/]*/?", ""))), "grounding_ptb": ("ecg_grounding", F.concat(F.lit("ecg_ptbxl_benchmarking/"), p)),
        "grounding_code15": ("ecg_grounding", under("code15/")), "pulse_mimic": ("ecg_instruct_pulse", under("mimic_v4/", "-0.png")), "pulse_ptb": ("ecg_instruct_pulse", under("ptb-xl/")), "pulse_code15": ("ecg_instruct_pulse", under("code15_v4/")), "test_ptb": ("ptb-test", last),
    }
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", *[etl.key_of(corpus, c).alias(name) for name, (corpus, c) in rules.items()])


@query("SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, c_acctbal FROM customer")
def q125_csv_round_trip(spark, sf_dir):
    """A table written as CSV and scanned again: blank fields are nulls."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), "c_acctbal")
    path = scratch(spark, "csv") + "/customer"
    files.write_table(rows, path, "csv")
    return files.csv(spark, path, ", ".join(f"{c} {k}" for c, k in rows.dtypes))


@query("SELECT doc_id, md5(text) AS digest, lang FROM documents")
def q126_json_round_trip(spark, sf_dir):
    """Whole documents written as JSON and scanned again."""
    rows, path = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), scratch(spark, "json") + "/documents"
    files.write_json(rows, path)
    return files.json_lines(spark, path, "doc_id long, text string, lang string").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"), "lang")


@query("SELECT url AS path, count(*) AS n FROM pages WHERE contains(url, '?') GROUP BY 1")
def q127_path_list(spark, sf_dir):
    """A list of paths written as text, blanks for those without a question mark, and read back without them."""
    path = scratch(spark, "paths") + "/list"
    files.write_path_list(table(spark, sf_dir, "pages").select(F.when(F.contains("url", F.lit("?")), F.col("url")).otherwise(" ").alias("url")), "url", path)
    return files.path_list(spark, path).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id % 50 AS exam_id, floor(arg_max(list_sum(embedding::DOUBLE[]), (vec_id % 18) * 1000000 + vec_id) * 1e6 + 0.5) / 1e6 AS total FROM embeddings GROUP BY 1")
def q129_exams(spark, sf_dir):
    """Exams in parts: of equal ids that of the last part, then the last index."""
    parts = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 18).alias("part"), F.col("vec_id").alias("idx"), (F.col("vec_id") % 50).alias("exam_id"), F.col("embedding").cast("array<double>").alias("tracing"))
    return files.exams(parts).select("exam_id", r6(F.aggregate("tracing", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("SELECT user_id, event_type, 'empty' AS reason FROM events GROUP BY 1, 2 HAVING user_id % 10 = 0")
def q130_segment_sink(spark, sf_dir):
    """Segments written and read back: those that came back empty."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.collect_list("value").alias("v"))
    segments = rows.select("user_id", "event_type", F.when(F.col("user_id") % 10 == 0, F.slice("v", 1, 0)).otherwise(F.col("v")).alias("signal"))
    return files.write_segments(segments, scratch(spark, "segments") + "/all", ["user_id", "event_type"])


@query("SELECT corpus, count(*) AS n, sum(row_idx)::BIGINT AS ids FROM (SELECT 'ecg-instruct-45k-250-1250' AS corpus, event_id AS row_idx FROM events WHERE event_id < 63062 UNION ALL SELECT 'other', event_id FROM events WHERE event_id < 400000 UNION ALL SELECT 'test', event_id FROM events WHERE event_id < 20000) GROUP BY 1")
def q131_hub_splits(spark, sf_dir):
    """Splits of an exported corpus: a prefix in file order."""
    path = scratch(spark, "hub") + "/rows"
    table(spark, sf_dir, "events").select(F.col("event_id").alias("row_idx")).write.parquet(path)
    out = None
    for name, corpus, split in (("ecg-instruct-45k-250-1250",) * 2 + ("train",), ("other", "other", "train"), ("test", "other", "test")):
        one = files.hub_split(spark, path, corpus, split).agg(F.lit(name).alias("corpus"), F.count(F.lit(1)).alias("n"), F.sum("row_idx").alias("ids"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT page_id, row_number() OVER (ORDER BY k1, url, page_id) - 1 AS pos FROM (SELECT page_id, url, coalesce(try_cast(regexp_extract(url, '(\\d+)', 1) AS BIGINT), -1) AS k1 FROM pages)")
def q133_ranked(spark, sf_dir):
    """Pages in the order of the number in their URL, then the URL."""
    number = F.coalesce(F.regexp_extract("url", r"(\d+)", 1).try_cast("long"), F.lit(-1))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", number.alias("k1"))
    return etl.ranked(rows, ["k1", "url", "page_id"], scratch(spark, "ranked") + "/pages").select("page_id", "pos")
