"""Prompt text against cases that follow from the definitions, not from our own SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leadframe.operators import metrics, text


def one(spark, column, **values):
    """A column's value over one row of given values."""
    rows = spark.range(1).select(*[v.alias(k) for k, v in values.items()]) if values else spark.range(1)
    return rows.select(column.alias("out")).first()["out"]


def plain(x):
    return x.asDict(recursive=True) if hasattr(x, "asDict") else [plain(y) for y in x] if isinstance(x, list) else x


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("<ecg>\nhello", "hello"),
        ("< image >   \n  hello", "hello"),
        ("a <ECG> b", "a b"),
        ("Image, image and IMAGE of images", "Signal, signal and Signal of images"),
        ("user: assistant : hi", "hi"),
        ("user：hi", "user：hi"),  # a role takes an ASCII colon alone
        ("：: hi", "hi"),
        ("  Q: A:: hi", "hi"),
        ("  hi", "  hi"),
        ("a user: hi", "a user: hi"),
        ("", ""),
    ],
)
def test_cleaning(spark, said, want):
    assert one(spark, text.cleaned(F.lit(said))) == want


TURNS = [("Human", " one "), ("gpt", "two"), ("user", ""), ("system", "three")]


def turns():
    return F.array(*[F.struct(F.lit(r).alias("role"), F.lit(t).alias("text")) for r, t in TURNS])


@pytest.mark.parametrize(
    ("style", "system", "want"),
    [
        ("raw", None, " one twothree"),
        ("meta-llama-3.1", "S", "S\nuser:  one \nassistant: two\nuser:assistant: three\n"),
        ("gemini", None, "\nuser:  one \nmodel: two\nuser:model: three\n"),
        ("mistral", None, "[INST]  one  [/INST] two</s>[INST][/INST] three</s>"),
        ("mistral", "S", "[INST] S\n one  [/INST] two</s>[INST][/INST] three</s>"),
        ("llama-2", "S", "[INST] <<SYS>>\nS\n<</SYS>>\n\n one  [/INST] two </s><s>[INST][/INST] three </s><s>"),
        ("llama-3", None, "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\none<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\ntwo<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n<|start_header_id|>assistant<|end_header_id|>\n\nthree<|eot_id|>"),
        ("qwen-7b-chat", None, "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\n one <|im_end|>\n<|im_start|>assistant\ntwo<|im_end|>\n<|im_start|>user\n<|im_start|>assistant\nthree<|im_end|>\n"),
        ("qwen-7b-chat", "", "<|im_start|>system\n<|im_end|>\n<|im_start|>user\n one <|im_end|>\n<|im_start|>assistant\ntwo<|im_end|>\n<|im_start|>user\n<|im_start|>assistant\nthree<|im_end|>\n"),
        ("deepseek-chat", None, "<｜begin▁of▁sentence｜>User:  one \n\nAssistant: two<｜end▁of▁sentence｜>User:Assistant: three<｜end▁of▁sentence｜>"),
        ("gemma", "S", "<bos><start_of_turn>user\n one <end_of_turn>\n<start_of_turn>model\ntwo<end_of_turn>\n<start_of_turn>user\n<start_of_turn>model\nthree<end_of_turn>\n"),
        ("gemma-2", None, "<bos><start_of_turn>user\n one <end_of_turn>\n<start_of_turn>model\ntwo<end_of_turn>\n<start_of_turn>user\n<start_of_turn>model\nthree<end_of_turn>\n<eos>"),
    ],
)
def test_renderers(spark, style, system, want):
    assert one(spark, text.rendered(turns(), style, system)) == want


@pytest.mark.parametrize(
    ("style", "seps", "want"),
    [
        ("colon", ("|",), "S|U:  one |A: two|U:A: three|"),
        ("colon", ("|", "#"), "S|U:  one |A: two#U:A: three#"),
        ("colon_space", ("|",), "S|U:  one |A: two|U: A: three|"),
        ("new_line", ("|",), "S|U\n one |A\ntwo|U\nA\nthree|"),
        ("no_colon", ("|", "#"), "SU one |Atwo#UAthree#"),
    ],
)
def test_styles_without_a_template(spark, style, seps, want):
    assert one(spark, text.rendered(turns(), text.Template(style, ("U", "A"), seps, system="S"))) == want


def test_templates(spark):
    assert text.template_table(spark).count() == 11
    with pytest.raises(ValueError):
        text.rendered(turns(), "internlm-chat")  # its style has no renderer
    with pytest.raises(ValueError):
        text.template("other")


def test_placeholders(spark):
    said = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(t).alias("text")) for r, t in [("gpt", "x"), ("human", "<image>\nwhat image"), ("human", "y")]])
    got = plain(one(spark, text.with_placeholders(said, 2)))
    assert [t["text"] for t in got] == ["x", "<signal> <signal>\nwhat signal", "y"]
    assert [t["text"] for t in plain(one(spark, text.with_placeholders(said, 0)))] == ["x", "what signal", "y"]
    before, after = text.split_prompt(F.lit("a<signal>b<signal>"))
    assert (one(spark, before), one(spark, after)) == ("a", "b<signal>")
    assert [one(spark, c) for c in text.split_prompt(F.lit("abc"))] == ["abc", ""]


def ids(*x):
    return F.array(*[F.lit(i).cast("long") for i in x]) if x else F.array().cast("array<bigint>")


I = text.IGNORE


@pytest.mark.parametrize(
    ("watch", "given", "want"),
    [
        (text.WATCH["llama-3.2-1b-instruct"], [128006, 78191, 128007, 271, 7, 128000, 5, 128006, 78191, 128007, 271, 8, 9, 128009, 3], [I] * 11 + [8, 9, 128009, I]),  # nothing starts before the first begin
        (text.WATCH["qwen2.5-1.5b-instruct"], [151644, 1, 151645, 198, 151644, 77091, 198, 4, 151645, 198, 151644, 77091, 198, 6], [I] * 7 + [4, 151645] + [I] * 5),  # the end that closed a response begins no pattern
        (text.WATCH["gemma-2-2b-it"], [2, 106, 107, 108, 106, 2516, 108, 5, 107, 108, 1], [I] * 7 + [5, 107, I, 1]),
        (text.Watch((1,), (4,), (3, 3)), [1, 3, 3, 3, 3, 9], [I, I, I, 3, 3, 9]),  # no start within a response
        (text.Watch((1,), (4,), (3,)), [1, 3], [I, I]),
        (text.Watch((1,), (4,), (3,)), [1, 3, 4, 4], [I, I, 4, I]),
        (text.Watch((1,), (4,), ()), [1, 2, 4], [I, I, I]),
        (text.Watch((1,), (4,), (3,)), [], []),
    ],
)
def test_labels(spark, watch, given, want):
    assert one(spark, text.labels(F.col("x"), watch), x=ids(*given)) == want


def test_label_ranges_and_nulls(spark):
    assert [tuple(r) for r in one(spark, text.response_ranges(ids(I, 5, 6, I, 7)))] == [(1, 3), (4, 5)]
    assert one(spark, text.response_ranges(ids())) == [] and one(spark, text.response_ranges(ids(I))) == []
    assert one(spark, text.labels(F.col("x"), text.WATCH["gemma-2-2b-it"]), x=F.lit(None).cast("array<bigint>")) is None


def test_continuations(spark):
    got = lambda p, g: one(spark, text.continuation(ids(*p), ids(*g), (4, 5)))
    assert got([1, 2], [1, 2, 7, 5, 8]) == [7] and got([1, 3], [1, 2, 7, 5, 8]) == [1, 2, 7] and got([1, 2], [1]) == [1] and got([], [7]) == [7] and got([1], [1, 4]) == []
    assert one(spark, text.places(ids(3, 9, 3), 3)) == [0, 2] and one(spark, text.places(ids(3), 9)) == [-1]


@pytest.mark.parametrize(
    ("said", "want"),
    [("Answer: yes .", "yes"), ("Answer: a. Answer: b.", "a. Answer: b"), ("Answer: a\n---\nAnswer: b\nc . ", "b c"), ("Answer: a\nOutput: x", "a"), ("none", ""), ("Answer:", ""), ("Answer:\n\n x..", "x")],
)
def test_answers(spark, said, want):
    assert one(spark, text.answer(F.lit(said))) == want


def test_prompt_parts(spark):
    parts = plain(one(spark, text.question_prompt(F.lit("Why?"), F.array(F.lit("c1"), F.lit("c2")))))
    assert [p["kind"] for p in parts] == ["text", "series", "series", "text"] and "Question: Why?\n" in parts[0]["text"] and parts[3]["text"].endswith('"Answer: "')
    said = plain(one(spark, text.messages(F.lit("q"), F.lit(None).cast("string"), "s")))
    assert said == [{"role": "system", "content": [{"type": "input_text", "value": "s"}]}, {"role": "user", "content": [{"type": "input_text", "value": "q"}]}]


@pytest.mark.parametrize(
    ("ref", "hyp", "words", "rouge_l"),
    [
        ("the cat. ", "the cat", ["the", "cat", ""], (2 / 2, 2 / 3)),  # blanks after a period are an empty sentence with one empty word
        ("the cat", "the cat.", ["the", "cat"], (1, 1)),
        ("a b c", "c b a", ["a", "b", "c"], (1 / 3, 1 / 3)),
        ("a b. c d", "a c. b d", ["a", "b", "c", "d"], (1, 1)),  # each pair of sentences reaches a word
        ("a a a", "a", ["a", "a", "a"], (1, 1)),  # words count once
    ],
)
def test_rouge(spark, ref, hyp, words, rouge_l):
    assert one(spark, metrics.sentence_words(F.lit(ref))) == words
    p, q = rouge_l
    assert one(spark, metrics.rouge_l(F.col("r"), F.col("h")), r=F.lit(ref), h=F.lit(hyp)) == pytest.approx(2 * p * q / (p + q + 1e-8))


def test_rouge_counts_sets(spark):
    words = lambda t: metrics.sentence_words(F.lit(t))
    f = one(spark, metrics.rouge_n(F.col("r"), F.col("h"), 2), r=words("a b. b c"), h=words("a b b"))  # {ab, bb, bc} and {ab, bb}
    assert f == pytest.approx(2 * (1 * 2 / 3) / (1 + 2 / 3 + 1e-8))
    assert one(spark, metrics.rouge_n(F.col("r"), F.col("h"), 1), r=words("a"), h=words("b")) == 0


def test_report(spark):
    rows = spark.createDataFrame([(1, "a b c d", "a b c d"), (2, "x", "y"), (3, "", "y"), (4, "x", "")], "k int, ref string, hyp string")
    got = metrics.report(rows, ["k"]).first()
    assert got["num_pairs"] == 2 and got["accuracy"] == 0.5 and got["bleu_sent"] == 0.5 and got["rouge_1"] == pytest.approx(0.5, abs=1e-6)
    none = metrics.report(rows.where("k > 2"), ["k"]).first()
    assert none["num_pairs"] == 0 and all(none[c] == 0 for c in ("bleu", "bleu_sent", "meteor_es", "rouge_1", "rouge_2", "rouge_l", "accuracy"))
    with pytest.raises(ValueError, match="must be the same"):
        metrics.report(spark.createDataFrame([(1, "a", None)], "k int, ref string, hyp string"), ["k"]).collect()
    assert metrics.run_pairs([1, 2, 3], [7, 8, 9]) == [(1, 7), (2, 8), (3, 9)]
    with pytest.raises(ValueError):
        metrics.run_pairs([1, 2], [7])
