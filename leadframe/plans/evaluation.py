"""Prompt, label and text-metric queries. Pairs: an assistant turn is the reference, the user turn before it the hypothesis."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from leadframe.functions import r6
from leadframe.functions.stems import meteor
from leadframe.operators import metrics, signal, text
from leadframe.session import table

from .registry import query
from .signals import R6

PAIRS = """c AS (SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS said FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, text AS ref, said AS hyp FROM c WHERE role = 'assistant' AND before = 'user' AND trim(text) <> '' AND trim(said) <> '')"""


def pairs(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("ref"), F.lag("role").over(w).alias("before"), F.lag("text").over(w).alias("hyp"))
    return rows.where((F.col("role") == "assistant") & (F.col("before") == "user") & (F.trim("ref") != "") & (F.trim("hyp") != "")).select("conv_id", "turn", "ref", "hyp")


def turns(spark, sf_dir):
    """conv_id, turns: array of role and text in order."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _prompt_sql(name: str, head: str, each: str, tail: str = "", roles: tuple[str, str] = ("user", "assistant")) -> str:
    """The digest of one style: what each turn becomes, r its role, m its text and i its index."""
    each = each.replace("{r}", f"CASE WHEN human THEN '{roles[0]}' ELSE '{roles[1]}' END")
    return f"md5({head} || string_agg({each}, '' ORDER BY turn){' || ' + tail if tail else ''}) AS {name}"


_NL = "chr(10)"
_SAID = {
    "llama3": f"'<|start_header_id|>' || {{r}} || '<|end_header_id|>' || {_NL} || {_NL} || CASE WHEN m = '' THEN '' ELSE regexp_replace(m, '^\\s+|\\s+$', '', 'g') || '<|eot_id|>' END",
    "chatml": f"'<|im_start|>' || {{r}} || {_NL} || CASE WHEN m = '' THEN '' ELSE m || '<|im_end|>' || {_NL} END",
    "gemma": f"'<start_of_turn>' || {{r}} || {_NL} || CASE WHEN m = '' THEN '' ELSE m || '<end_of_turn>' || {_NL} END",
    "default": f"{{r}} || CASE WHEN m = '' THEN ':' ELSE ': ' || m || {_NL} END",
    "llama2": "CASE WHEN m = '' THEN tag WHEN i = 0 THEN m || ' ' ELSE tag || ' ' || m || CASE WHEN i % 2 = 0 THEN ' ' ELSE '{sep}' END END",
    "deepseek": f"{{r}} || CASE WHEN m = '' THEN ':' ELSE ': ' || m || CASE WHEN i % 2 = 0 THEN {_NL} || {_NL} ELSE '<｜end▁of▁sentence｜>' END END",
}
_PROMPTS = [
    _prompt_sql("raw", "''", "m"),
    _prompt_sql("llama_31", f"'Cutting Knowledge Date: December 2023' || {_NL} || 'Today Date: {{{{currentDateTimev2}}}}' || {_NL}", _SAID["default"]),
    _prompt_sql("gemini", _NL, _SAID["default"], roles=("user", "model")),
    _prompt_sql("mistral", "'[INST] '", _SAID["llama2"].replace("{sep}", "</s>")),
    _prompt_sql("llama_2", "'[INST] '", _SAID["llama2"].replace("{sep}", " </s><s>")),
    _prompt_sql("llama_3", "'<|begin_of_text|>'", _SAID["llama3"]),
    _prompt_sql("qwen", f"'<|im_start|>system' || {_NL} || 'You are a helpful assistant.<|im_end|>' || {_NL}", _SAID["chatml"]),
    _prompt_sql("deepseek", "'<｜begin▁of▁sentence｜>'", _SAID["deepseek"], roles=("User", "Assistant")),
    _prompt_sql("gemma", "'<bos>'", _SAID["gemma"], roles=("user", "model")),
    _prompt_sql("gemma_2", "'<bos>'", _SAID["gemma"], "'<eos>'", ("user", "model")),
    f"md5('<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || {_NL} || {_NL} || 'Be brief.<|eot_id|>' || string_agg(" + _SAID["llama3"].replace("{r}", "CASE WHEN human THEN 'user' ELSE 'assistant' END") + ", '' ORDER BY turn)) AS llama_3_system",
]
STYLES = {"raw": "raw", "llama_31": "meta-llama-3.1", "gemini": "gemini", "mistral": "mistral", "llama_2": "llama-2", "llama_3": "llama-3", "qwen": "qwen-7b-chat", "deepseek": "deepseek-chat", "gemma": "gemma", "gemma_2": "gemma-2"}


@query(f"""WITH t AS (SELECT conv_id, turn, lower(role) IN ('human', 'user') AS human, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
f AS (SELECT *, CASE WHEN human AND row_number() OVER (PARTITION BY conv_id, human ORDER BY turn) = 1 THEN '<signal>' || chr(10) || text ELSE text END AS m, CASE WHEN i % 2 = 0 THEN '[INST]' ELSE '[/INST]' END AS tag FROM t)
SELECT conv_id, {', '.join(_PROMPTS)} FROM f GROUP BY 1""")
def q60_prompts(spark, sf_dir):
    """Every conversation in every style that has a renderer, a placeholder before the first human turn."""
    digest = lambda style, system=None: F.md5(F.encode(text.prompt(F.col("turns"), style, 1, system), "UTF-8"))
    return turns(spark, sf_dir).select("conv_id", *[digest(style).alias(name) for name, style in STYLES.items()], digest("llama-3", "Be brief.").alias("llama_3_system"))


#: Word-level watch ids: 1 begins, 4 ends a turn, 5 3 starts a response, 6 ends the whole.
WORDS = text.Watch((1,), (4,), (5, 3), (6,))


def word_ids(spark, sf_dir):
    """conv_id, ids: 1, then for each turn 5 and 2 (user) or 3 (others), its words' lengths + 10, and 4; 6 at the end."""
    said = lambda t: F.transform(metrics.words(t["text"]), lambda w: (F.length(w) + 10).cast("long"))
    one = lambda *k: F.array(*[F.lit(x).cast("long") for x in k])
    ids = F.concat(one(1), F.flatten(F.transform("turns", lambda t: F.concat(F.when(t["role"] == "user", one(5, 2)).otherwise(one(5, 3)), said(t), one(4)))), one(6))
    return turns(spark, sf_dir).select("conv_id", ids.alias("ids"))


@query("""WITH t AS (SELECT conv_id, turn, role, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::BIGINT AS n FROM conversations)
SELECT conv_id, (1 + sum(CASE WHEN role = 'user' THEN 0 ELSE n + 1 END))::BIGINT AS labelled, (2 + sum(n + 3))::BIGINT AS total, (count(*) FILTER (role <> 'user') + (count(*) FILTER (turn = m AND role = 'user')))::BIGINT AS ranges
FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM t) GROUP BY 1""")
def q61_label_mask(spark, sf_dir):
    """Labelled: what the turns of others say, with their end, and the end of the whole. A range ends where a label does."""
    rows = word_ids(spark, sf_dir).withColumn("label", text.labels(F.col("ids"), WORDS))
    ranges = text.response_ranges(F.col("label"))
    return rows.select("conv_id", F.size(F.filter("label", lambda x: x != text.IGNORE)).cast("long").alias("labelled"), F.size("ids").cast("long").alias("total"), F.size(ranges).cast("long").alias("ranges"))


@query("""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS a FROM conversations), p AS (SELECT *, list_position(a, 'the') AS first FROM w),
g AS (SELECT *, a[4:] AS rest FROM p), c AS (SELECT *, list_position(rest, 'of') AS o, list_position(rest, 'and') AS n FROM g)
SELECT conv_id, turn, coalesce(first, 0)::BIGINT AS first, (CASE WHEN coalesce(first, 0) = 0 THEN len(a) ELSE len(a) - first + 1 END)::BIGINT AS attended,
 array_to_string(CASE WHEN first IS NULL OR first = 0 THEN ['-1'] ELSE list_filter(list_transform(a, lambda x, i: CASE WHEN x = 'the' THEN (i - 1)::VARCHAR END), lambda x: x IS NOT NULL) END, ' ') AS places,
 array_to_string(rest[1 : coalesce(least(nullif(o, 0), nullif(n, 0)), len(rest) + 1) - 1], ' ') AS continued FROM c""")
def q62_attention_mask(spark, sf_dir):
    """The word 'the' stands for the first token and the signal's; the first three words are the prompt, 'of' and 'and' stop what follows them."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", metrics.words(F.col("text")).alias("a")).withColumn("first", F.array_position("a", F.lit("the")))
    mask = text.attention(F.col("a"), F.lit("the"))
    continued = text.continuation(F.slice("a", 1, 3), F.col("a"), ("of", "and"))
    joined = lambda c: F.array_join(c.cast("array<string>"), " ")
    return rows.select("conv_id", "turn", "first", F.aggregate(mask, F.lit(0), lambda s, x: s + x).cast("long").alias("attended"), joined(text.places(F.col("a"), F.lit("the"))).alias("places"), joined(continued).alias("continued"))


@query("""SELECT conv_id, turn, md5(coalesce(string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS context FROM conversations QUALIFY role = 'assistant'""")
def q63_gold_history(spark, sf_dir):
    """Each response's context: all turns before it, as they were. A conversation is joined once, a context is its beginning."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "conversations")
    whole = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "|").alias("whole"))
    placed = rows.select("conv_id", "turn", "role", F.coalesce(F.sum(F.char_length("text") + 1).over(w) - 1, F.lit(0)).cast("int").alias("length")).where("role = 'assistant'")
    return placed.join(whole, "conv_id").select("conv_id", "turn", F.md5(F.encode(F.substring("whole", F.lit(1), F.col("length")), "UTF-8")).alias("context"))


@query(f"WITH {PAIRS} SELECT count(*) AS num_pairs, {R6.format('coalesce(avg((ref = hyp)::INT), 0)')} AS accuracy FROM p")
def q64_accuracy(spark, sf_dir):
    return metrics.accuracy(pairs(spark, sf_dir)).select("num_pairs", r6(F.col("accuracy")).alias("accuracy"))


NGRAMS = f"""{PAIRS}, w AS (SELECT conv_id, turn, list_filter(string_split_regex(ref, '\\s+'), lambda w: w <> '') AS r, list_filter(string_split_regex(hyp, '\\s+'), lambda w: w <> '') AS h FROM p),
o AS (SELECT unnest([1, 2, 3, 4]) AS n),
rg AS (SELECT conv_id, turn, n, array_to_string(r[i : i + n - 1], ' ') AS g, count(*) AS c FROM w, o, unnest(range(1, greatest(len(r) - n + 2, 1))) t(i) GROUP BY 1, 2, 3, 4),
hg AS (SELECT conv_id, turn, n, array_to_string(h[i : i + n - 1], ' ') AS g, count(*) AS c FROM w, o, unnest(range(1, greatest(len(h) - n + 2, 1))) t(i) GROUP BY 1, 2, 3, 4),
m AS (SELECT conv_id, turn, n, sum(least(rg.c, hg.c))::BIGINT AS matched FROM rg JOIN hg USING (conv_id, turn, n, g) GROUP BY 1, 2, 3),
k AS (SELECT conv_id, turn, n, coalesce(matched, 0) AS matched, greatest(len(h) - n + 1, 0)::BIGINT AS total, len(r)::BIGINT AS ref_len, len(h)::BIGINT AS hyp_len FROM w CROSS JOIN o LEFT JOIN m USING (conv_id, turn, n))"""


@query(f"WITH {NGRAMS} SELECT conv_id, turn, n, matched, total, ref_len, hyp_len FROM k")
def q65_ngram_counts(spark, sf_dir):
    return metrics.ngram_counts(pairs(spark, sf_dir), ["conv_id", "turn"])


@query(f"""WITH {NGRAMS}, s AS (SELECT n, sum(matched) AS m, sum(greatest(total, 1)) AS t, sum(ref_len) AS r, sum(hyp_len) AS h FROM k GROUP BY 1)
SELECT {R6.format("CASE WHEN max(CASE WHEN n = 1 THEN m END) > 0 THEN CASE WHEN max(h) > max(r) THEN 1.0 ELSE exp(1 - max(r) / max(h)::DOUBLE) END * exp(sum(ln(CASE WHEN m = 0 THEN 0.1 ELSE m END::DOUBLE / t)) / 4) ELSE 0.0 END")} AS bleu FROM s""")
def q66_corpus_bleu(spark, sf_dir):
    return metrics.corpus_bleu(metrics.ngram_counts(pairs(spark, sf_dir), ["conv_id", "turn"]))


@query(f"""WITH {NGRAMS}, e AS (SELECT *, least(4, ref_len, hyp_len) AS top FROM k), s AS (SELECT conv_id, turn, max(CASE WHEN n = 1 THEN matched END) AS m1, max(ref_len) AS r, max(hyp_len) AS h, max(top) AS top, sum(ln(CASE WHEN matched = 0 THEN 0.1 ELSE matched END::DOUBLE / greatest(total, 1))) AS s FROM e WHERE n <= top GROUP BY 1, 2)
SELECT {R6.format("avg(CASE WHEN m1 > 0 THEN CASE WHEN h > r THEN 1.0 ELSE exp(1 - r / h::DOUBLE) END * exp(s / top) ELSE 0.0 END)")} AS bleu FROM s""")
def q67_sentence_bleu(spark, sf_dir):
    """Mean over pairs, with orders up to the shorter of the two, at most 4."""
    each = metrics.sentence_bleu(metrics.ngram_counts(pairs(spark, sf_dir), ["conv_id", "turn"]), ["conv_id", "turn"])
    return each.agg(r6(F.avg("bleu")).alias("bleu"))


def _sentence_words_sql(c: str) -> str:
    return f"flatten(list_transform(list_filter(string_split({c}, '.'), lambda s: s <> ''), lambda s: string_split(array_to_string(list_filter(string_split_regex(s, '\\s+'), lambda w: w <> ''), ' '), ' ')))"


ROUGE = f"""{PAIRS}, w AS (SELECT conv_id, turn, {_sentence_words_sql('ref')} AS r, {_sentence_words_sql('hyp')} AS h FROM p), o AS (SELECT unnest([1, 2]) AS n),
rg AS (SELECT DISTINCT conv_id, turn, n, array_to_string(r[i : i + n - 1], ' ') AS g FROM w, o, unnest(range(1, greatest(len(r) - n + 2, 1))) t(i)), hg AS (SELECT DISTINCT conv_id, turn, n, array_to_string(h[i : i + n - 1], ' ') AS g FROM w, o, unnest(range(1, greatest(len(h) - n + 2, 1))) t(i)),
f AS (SELECT w.conv_id, w.turn, o.n, coalesce(b.c, 0) AS x, coalesce(s.c, 0)::DOUBLE AS r, coalesce(u.c, 0)::DOUBLE AS h FROM w CROSS JOIN o LEFT JOIN (SELECT conv_id, turn, n, count(*) AS c FROM rg GROUP BY 1, 2, 3) s USING (conv_id, turn, n)
 LEFT JOIN (SELECT conv_id, turn, n, count(*) AS c FROM hg GROUP BY 1, 2, 3) u USING (conv_id, turn, n) LEFT JOIN (SELECT conv_id, turn, n, count(*) AS c FROM rg JOIN hg USING (conv_id, turn, n, g) GROUP BY 1, 2, 3) b USING (conv_id, turn, n)),
e AS (SELECT conv_id, turn, n, CASE WHEN x = 0 THEN 0.0 ELSE 2 * ((x / h) * (x / r) / (x / h + x / r + 1e-8)) END AS f FROM f)"""


@query(f"WITH {ROUGE} SELECT n, {R6.format('avg(f)')} AS rouge FROM e GROUP BY 1")
def q68_rouge_n(spark, sf_dir):
    """F of sets of n-grams over the words of all sentences, n = 1 and 2."""
    each = [F.struct(F.lit(n).alias("n"), metrics.rouge_n(F.col("r"), F.col("h"), n).alias("f")) for n in (1, 2)]
    said = pairs(spark, sf_dir).select(metrics.sentence_words(F.col("ref")).alias("r"), metrics.sentence_words(F.col("hyp")).alias("h"))
    return said.select(F.explode(F.array(*each)).alias("e")).groupBy("e.n").agg(r6(F.avg("e.f")).alias("rouge"))


@query()
def q69_rouge_l(spark, sf_dir):
    """Summary-level F of longest common subsequences of sentences; held against brute force in the tests."""
    return pairs(spark, sf_dir).select("conv_id", "turn", r6(metrics.rouge_l(F.col("ref"), F.col("hyp"))).alias("rouge_l"))


@query(f"""WITH {NGRAMS}, s AS (SELECT n, sum(matched) AS m, sum(greatest(total, 1)) AS t, sum(ref_len) AS r, sum(hyp_len) AS h FROM k GROUP BY 1)
SELECT (SELECT count(*) FROM p) AS num_pairs, {R6.format("CASE WHEN max(CASE WHEN n = 1 THEN m END) > 0 THEN CASE WHEN max(h) > max(r) THEN 1.0 ELSE exp(1 - max(r) / max(h)::DOUBLE) END * exp(sum(ln(CASE WHEN m = 0 THEN 0.1 ELSE m END::DOUBLE / t)) / 4) ELSE 0.0 END")} AS bleu, {R6.format("(SELECT avg((ref = hyp)::INT) FROM p)")} AS accuracy, 0 AS empty_pairs, 0.0::DOUBLE AS empty_bleu FROM s""")
def q119_report(spark, sf_dir):
    """The combined report's count, BLEU and accuracy, and those of no pairs at all."""
    got = metrics.report(pairs(spark, sf_dir), ["conv_id", "turn"])
    none = metrics.report(pairs(spark, sf_dir).where("false"), ["conv_id", "turn"]).select(F.col("num_pairs").cast("int").alias("empty_pairs"), F.col("bleu").alias("empty_bleu"))
    return got.select("num_pairs", r6(F.col("bleu")).alias("bleu"), r6(F.col("accuracy")).alias("accuracy")).crossJoin(none)  # one row each


@query("""WITH g AS (SELECT conv_id, turn, trim(text) AS ref FROM conversations WHERE role = 'assistant'), h AS (SELECT conv_id, turn + 1 AS turn, trim(text) AS hyp FROM conversations WHERE role = 'user')
SELECT conv_id, turn, md5(ref) AS ref, md5(hyp) AS hyp FROM g JOIN h USING (conv_id, turn) WHERE ref <> '' AND hyp <> ''""")
def q120_turn_pairs(spark, sf_dir):
    """Every gold response against what was generated for its turn; what the user said before stands for that."""
    rows = table(spark, sf_dir, "conversations")
    said = rows.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), "text")
    both = metrics.scored(metrics.turn_pairs(rows.where("role = 'assistant'"), said), ["conv_id", "turn"])
    return both.select("conv_id", "turn", *[F.md5(F.encode(c, "UTF-8")).alias(c) for c in ("ref", "hyp")])


@query(f"""WITH e AS (SELECT event_type AS metric, user_id % 3 AS run, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT metric, count(*) AS runs, {R6.format("avg(v * 100)")} AS mean, {R6.format("stddev_samp(v * 100)")} AS std, {R6.format("4.302652729749464 * stddev_samp(v * 100) / sqrt(count(*)::DOUBLE)")} AS half_width FROM e GROUP BY 1""")
def q70_run_statistics(spark, sf_dir):
    """Three runs, a fold and a seed each; a run's value is the mean over its fold's users."""
    events, pairs_of = table(spark, sf_dir, "events"), metrics.run_pairs([0, 1, 2], [10, 20, 30])
    run = F.coalesce(*[F.when(F.col("user_id") % 3 == fold, F.lit(f"{fold}-{seed}")) for fold, seed in pairs_of])
    runs = events.groupBy(F.col("event_type").alias("metric"), run.alias("run")).agg(F.avg("value").alias("v"))
    return metrics.run_statistics(runs, "metric", "v")


ASKED = "said AS (SELECT doc_id, 'Answer: no' || chr(10) || '---' || chr(10) || 'Reasoning. Answer: ' || substr(text, 1, length(text) // 2) || chr(10) || 'Answer:  ' || substr(text, length(text) // 2 + 1) || ' . ' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '##-- after' ELSE '' END AS t FROM documents)"


@query(rf"""WITH {ASKED}, b AS (SELECT doc_id, regexp_extract_all(t, '(?s)Answer:\s*(.+?)(?:\n(?:[-#]{{{{3,}}}}|Output:|Question:)|$)', 1)[-1] AS b FROM said),
a AS (SELECT doc_id, regexp_replace(replace(regexp_replace(b, '^\s+|\s+$', '', 'g'), chr(10), ' '), '[ .]+$', '') AS answer FROM b) SELECT doc_id, length(answer)::BIGINT AS n_chars, md5(answer) AS answer FROM a""".replace("{{", "{").replace("}}", "}"))
def q71_answer(spark, sf_dir):
    """The last answer block of a text that has several; the block runs on over later marks, to a line of dashes or the end."""
    half = F.floor(F.char_length("text") / 2).cast("int")
    closing = F.when(F.col("doc_id") % 2 == 0, "\n##-- after").otherwise("")
    said = F.concat(F.lit("Answer: no\n---\nReasoning. Answer: "), F.substring("text", F.lit(1), half), F.lit("\nAnswer:  "), F.substring("text", half + 1, F.char_length("text")), F.lit(" . "), closing)
    rows = table(spark, sf_dir, "documents").select("doc_id", text.answer(said).alias("answer"))
    return rows.select("doc_id", F.char_length("answer").cast("long").alias("n_chars"), F.md5(F.encode("answer", "UTF-8")).alias("answer"))


@query()
def q72_meteor(spark, sf_dir):
    """METEOR by exact words, then stems; no synonyms."""
    @F.pandas_udf("double")
    def score(ref: pd.Series, hyp: pd.Series) -> pd.Series:
        return pd.Series([meteor(r.split(), h.split()) for r, h in zip(ref, hyp, strict=True)])

    return pairs(spark, sf_dir).select("conv_id", "turn", r6(score("ref", "hyp")).alias("meteor_es"))


@query(f"""WITH x AS (SELECT vec_id, list_transform(range(0, 8), lambda i: embedding[i * 4 + 1 : i * 4 + 4]::DOUBLE[]) AS r, list_transform(range(8, 16), lambda i: embedding[i * 4 + 1 : i * 4 + 4]::DOUBLE[]) AS h FROM embeddings),
s AS (SELECT vec_id, list_sum(list_transform(h, lambda a: list_max(list_transform(r, lambda b: list_cosine_similarity(a, b))))) / 8 AS p, list_sum(list_transform(r, lambda a: list_max(list_transform(h, lambda b: list_cosine_similarity(a, b))))) / 8 AS q FROM x)
SELECT vec_id, {R6.format('p')} AS precision, {R6.format('q')} AS recall, {R6.format('CASE WHEN p + q = 0 THEN 0.0 ELSE 2 * p * q / (p + q) END')} AS f1 FROM s""")
def q73_greedy_match(spark, sf_dir):
    """The token-vector score of each embedding's halves, taken as eight vectors of four."""
    e = F.col("embedding").cast("array<double>")
    side = lambda first: F.array(*[F.slice(e, i * 4 + 1, 4) for i in range(first, first + 8)])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", metrics.greedy_match(side(0), side(8)).alias("s"))
    return rows.select("vec_id", *[r6(F.col(f"s.{c}")).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH q AS (SELECT item_id, 'Is it <ecg>' || chr(10) || item_id || '?' AS question, ['yes', item_id::VARCHAR] AS answers FROM benchmark)
SELECT item_id, 'Is it ' || item_id || '?' AS mimic, 'yes ' || item_id AS joined, 'yes' || item_id AS listed FROM q""")
def q117_corpus_formats(spark, sf_dir):
    """A question without break and tag, answers joined by a space, and a list without anything between."""
    question, answers = F.concat(F.lit("Is it <ecg>\n"), "item_id", F.lit("?")), F.array(F.lit("yes"), F.col("item_id").cast("string"))
    turns_of = text.question_answer(question, answers)
    mimic = text.formatted(turns_of, "pretrain-mimic-250-1250")
    return table(spark, sf_dir, "benchmark").select("item_id", mimic[0]["text"].alias("mimic"), text.formatted(turns_of, "ecg-qa")[1]["text"].alias("joined"), text.listed(answers).alias("listed"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query(f"""WITH s AS (SELECT user_id, event_type, {R6.format('avg(value)')} AS m, {R6.format('stddev_pop(value)')} AS d FROM events GROUP BY 1, 2),
c AS (SELECT user_id, string_agg('series' || 'ECG Lead ' || event_type || ' - sampled at ~250Hz, normalized (mean=' || printf('%.3f', m) || ', std=' || printf('%.3f', d) || ')', '|' ORDER BY event_type) AS captions FROM s GROUP BY 1)
SELECT user_id, md5('text' || {_quoted(text.QUESTION.split('{}')[0])} || 'Is user ' || user_id || ' well?' || {_quoted(text.QUESTION.split('{}')[1])} || '|' || captions || '|text' || {_quoted(text.CLOSING)}) AS prompt,
 CASE WHEN user_id % 2 = 0 THEN 'input_text:Is user ' || user_id || ' well?|input_image:data:image/png;base64,' || user_id ELSE 'input_text:Is user ' || user_id || ' well?' END AS content FROM c""")
def q118_question_prompts(spark, sf_dir):
    """A question about a record with a caption for each lead, and the same as chat messages with an image."""
    captions = signal.captions(table(spark, sf_dir, "events"), "user_id", "event_type")
    rows = captions.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "caption"))), lambda x: x["caption"]).alias("captions"))
    question = F.concat(F.lit("Is user "), "user_id", F.lit(" well?"))
    image = F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string"))
    parts = F.transform(text.question_prompt(question, F.col("captions")), lambda p: F.concat(p["kind"], p["text"]))
    content = F.transform(text.messages(question, image, "Be brief.")[1]["content"], lambda c: F.concat_ws(":", c["type"], c["value"]))
    return rows.select("user_id", F.md5(F.encode(F.array_join(parts, "|"), "UTF-8")).alias("prompt"), F.array_join(content, "|").alias("content"))
