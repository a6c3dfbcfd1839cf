"""Prompt text: cleaning, corpus formats, chat renderers, label masks, continuations, answer extraction."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles whose prefix is stripped.
ROLES = "user|assistant|human|gpt|model|system|q|a"
#: What stands for the signal in a prompt, what a signal token's name begins with, and who speaks for the human.
PLACEHOLDER, TOKEN_PREFIX, HUMAN = "<signal>", "signal_", ("human", "user")
IGNORE = -100


def without_tags(text: Column) -> Column:
    """Without signal and image tags, blanks inside them and the white space that follows them."""
    return F.regexp_replace(text, r"(?i)<\s*(?:ecg|image)\s*>\s*", "")


def image_to_signal(text: Column) -> Column:
    """The word image becomes signal, its first letter's case kept."""
    return F.regexp_replace(F.regexp_replace(text, r"\bI(?i:mage)\b", "Signal"), r"\bi(?i:mage)\b", "signal")


def without_roles(text: Column) -> Column:
    """Without leading colons, ASCII or full-width, and role names with an ASCII colon, repeated."""
    return F.regexp_replace(text, rf"^\s*(?:[:：]\s*|(?i:{ROLES})\s*:\s*)+", "")


def cleaned(text: Column) -> Column:
    return without_roles(image_to_signal(without_tags(text)))


@dataclass(frozen=True)
class Template:
    """How a conversation becomes one string. seps alternate with the messages."""

    style: str
    roles: tuple[str, str] = ("USER", "ASSISTANT")
    seps: tuple[str, ...] = ("\n",)
    system_template: str = "{}"
    system: str = ""
    stop: str = ""
    stop_ids: tuple[int, ...] = ()


#: The templates by name.
TEMPLATES = {
    "raw": Template("no_colon", ("", ""), ("",)),
    "meta-llama-3.1": Template("default", ("user", "assistant"), (), system="Cutting Knowledge Date: December 2023\nToday Date: {{currentDateTimev2}}"),
    "gemini": Template("default", ("user", "model"), ()),
    "internlm-chat": Template("chatintern", ("<|User|>", "<|Bot|>"), ("<eoh>", "<eoa>"), system="A chat between a curious <|User|> and an <|Bot|>. The <|Bot|> gives helpful, detailed, and polite answers to the <|User|>'s questions.\n\n", stop="<|User|>", stop_ids=(1, 103028)),
    "mistral": Template("llama2", ("[INST]", "[/INST]"), (" ", "</s>"), "[INST] {}\n"),
    "llama-2": Template("llama2", ("[INST]", "[/INST]"), (" ", " </s><s>"), "[INST] <<SYS>>\n{}\n<</SYS>>\n\n"),
    "llama-3": Template("llama3", ("user", "assistant"), ("",), "<|start_header_id|>system<|end_header_id|>\n\n{}<|eot_id|>", stop="<|eot_id|>", stop_ids=(128001, 128009)),
    "qwen-7b-chat": Template("chatml", ("<|im_start|>user", "<|im_start|>assistant"), ("<|im_end|>",), "<|im_start|>system\n{}", "You are a helpful assistant.", "<|endoftext|>", (151643, 151644, 151645)),
    "deepseek-chat": Template("colon_no_head_sep", ("User", "Assistant"), ("\n\n", "<｜end▁of▁sentence｜>"), system="<｜begin▁of▁sentence｜>", stop="<｜end▁of▁sentence｜>"),
    "gemma": Template("gemma", ("user", "model"), ("<end_of_turn>\n",), stop="<end_of_turn>"),
    "gemma-2": Template("gemma", ("user", "model"), ("<end_of_turn>\n",), stop="<eos>"),
}

#: Of the styles that are a head and turns: what follows the system text, between role and message, and after the role of an empty message.
_PLAIN = {
    "colon": ("sep", ": ", ":"),
    "colon_no_head_sep": ("", ": ", ":"),
    "colon_space": ("sep", ": ", ": "),
    "new_line": ("sep if any", "\n", "\n"),
    "no_colon": ("", "", ""),
    "default": ("\n", ": ", ":"),
}


def template_table(spark) -> DataFrame:
    """The templates as a table: name, style, user, assistant, stop, stop_ids."""
    rows = [(n, t.style, *t.roles, t.stop, list(t.stop_ids)) for n, t in TEMPLATES.items()]
    return spark.createDataFrame(rows, "name string, style string, user string, assistant string, stop string, stop_ids array<long>")


def template(name: str) -> Template:
    if name not in TEMPLATES:
        raise ValueError(f"no template {name}")
    return TEMPLATES[name]


def rendered(turns: Column, style: str | Template, system: str | None = None) -> Column:
    """A conversation (array of role, text in order) as one string; a null text is an empty message.

    Roles of HUMAN, in any case, take the template's first role, all others its second. system replaces the template's text.
    """
    t = template(style) if isinstance(style, str) else style
    said = t.system if system is None else system
    head = t.system_template.replace("{}", said)
    seps = t.seps or ("\n",)
    role = lambda x: F.when(F.lower(x["role"]).isin(*HUMAN), t.roles[0]).otherwise(t.roles[1])
    sep = lambda i: F.lit(seps[0]) if len(seps) == 1 else F.element_at(F.array(*[F.lit(x) for x in seps]), (i % len(seps) + 1).cast("int"))
    empty = lambda x: F.coalesce(x["text"], F.lit("")) == ""
    tail = ""
    if t.style in _PLAIN:
        after, colon, bare = _PLAIN[t.style]
        head += {"sep": seps[0], "sep if any": seps[0] if head else ""}.get(after, after)
        last = (lambda i: F.lit("\n")) if t.style == "default" else sep
        each = lambda x, i: F.when(empty(x), F.concat(role(x), F.lit(bare))).otherwise(F.concat(role(x), F.lit(colon), x["text"], last(i)))
    elif t.style == "llama2":  # the first message stands bare behind the head, tags go by position
        head = head if said else "[INST] "
        tag = lambda i: F.when(i % 2 == 0, t.roles[0]).otherwise(t.roles[1])
        each = lambda x, i: F.when(empty(x), tag(i)).when(i == 0, F.concat(x["text"], F.lit(" "))).otherwise(F.concat(tag(i), F.lit(" "), x["text"], sep(i)))
    elif t.style == "chatml":
        head = head + seps[0] + "\n" if head else ""
        each = lambda x, i: F.concat(role(x), F.lit("\n"), F.when(empty(x), "").otherwise(F.concat(x["text"], F.lit(seps[0] + "\n"))))
    elif t.style == "llama3":
        head = "<|begin_of_text|>" + (head if said else "")
        stripped = lambda x: F.regexp_replace(x["text"], r"^\s+|\s+$", "")
        each = lambda x, i: F.concat(F.lit("<|start_header_id|>"), role(x), F.lit("<|end_header_id|>\n\n"), F.when(empty(x), "").otherwise(F.concat(stripped(x), F.lit("<|eot_id|>"))))
    elif t.style == "gemma":  # has no system text
        head, tail = "<bos>", "<eos>" if t.stop == "<eos>" else ""
        each = lambda x, i: F.concat(F.lit("<start_of_turn>"), role(x), F.lit("\n"), F.when(empty(x), "").otherwise(F.concat(x["text"], F.lit(seps[0]))))
    else:
        raise ValueError(f"no renderer for {t.style}")
    return F.concat(F.lit(head), F.array_join(F.transform(turns, each), ""), F.lit(tail))


def formatted(turns: Column, corpus: str) -> Column:
    """The turns that a corpus' conversations have for training.

    pretrain-mimic: the first two, the question without line breaks and signal tags. All others pass through; `question_answer`
    makes turns of the ecg-qa corpora.
    """
    if "pretrain-mimic" not in corpus:
        return turns
    question = F.replace(F.replace(turns[0]["text"], F.lit("\n"), F.lit("")), F.lit("<ecg>"), F.lit(""))
    return F.array(F.struct(F.lit("human").alias("role"), question.alias("text")), F.struct(F.lit("assistant").alias("role"), turns[1]["text"].alias("text")))


def question_answer(question: Column, answers: Column) -> Column:
    """Turns of a question and a list of answers, joined by a space."""
    return F.array(F.struct(F.lit("human").alias("role"), question.alias("text")), F.struct(F.lit("assistant").alias("role"), F.array_join(answers, " ").alias("text")))


def listed(values: Column) -> Column:
    """A value that is a list of strings as one, without anything between."""
    return F.array_join(values, "")


def with_placeholders(turns: Column, signals: int = 1) -> Column:
    """Cleaned turns with so many placeholders before the first human turn; none for 0."""
    first = F.array_position(F.transform(turns, lambda x: F.lower(x["role"]).isin(*HUMAN)), True)
    mark = F.lit(" ".join([PLACEHOLDER] * signals) + "\n" if signals else "")
    return F.transform(turns, lambda x, i: F.struct(x["role"].alias("role"), F.concat(F.when(i + 1 == first, mark).otherwise(""), cleaned(x["text"])).alias("text")))


def prompt(turns: Column, style: str | Template, signals: int = 1, system: str | None = None) -> Column:
    return rendered(with_placeholders(turns, signals), style, system)


def split_prompt(text: Column) -> tuple[Column, Column]:
    """What is before and after the first placeholder; without one all is before it."""
    at = F.instr(text, PLACEHOLDER)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), F.when(at > 0, F.substring(text, at + len(PLACEHOLDER), F.length(text))).otherwise("")


#: Fixed text: how a question about a signal is put.
QUESTION = """You are an expert cardiologist analyzing an ECG (electrocardiogram).

Clinical Context: 12-lead ECG recording.

Your task is to examine the ECG signal and answer the following medical question:

Question: {}

Instructions:
- Begin by analyzing the time series without assuming a specific answer.
- Think step-by-step about what the observed patterns suggest regarding the cardiac condition.
- Write your rationale as a single, natural paragraph — do not use bullet points, numbered steps, or section headings.
- Do **not** mention any final answer until the very end.
- Consider the ECG morphology, intervals, and any abnormalities that relate to the question."""
CLOSING = """Based on your analysis of the ECG data, provide your answer.
Make sure that your last word is the answer. You MUST end your response with "Answer: \""""


def question_prompt(question: Column, captions: Column) -> Column:
    """The parts of a prompt with time series in order: kind (text or series) and text; captions: an array, one for each lead."""
    before, after = QUESTION.split("{}")
    part = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    return F.concat(F.array(part("text", F.concat(F.lit(before), question, F.lit(after)))), F.transform(captions, lambda c: part("series", c)), F.array(part("text", F.lit(CLOSING))))


def messages(question: Column, image: Column, system: str) -> Column:
    """System and user messages of a chat request: role and content, an array of type and value; a null image is left out."""
    content = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    own = F.array(content("input_text", question), F.when(image.isNotNull(), content("input_image", F.concat(F.lit("data:image/png;base64,"), image))))
    message = lambda role, parts: F.struct(F.lit(role).alias("role"), parts.alias("content"))
    return F.array(message("system", F.array(content("input_text", F.lit(system)))), message("user", F.array_compact(own)))


@dataclass(frozen=True)
class Watch:
    """Ids that a label mask looks for: begin, end, the end of the whole, and the pattern that starts a response."""

    begin: tuple[int, ...]
    end: tuple[int, ...]
    start: tuple[int, ...]
    final: tuple[int, ...] = ()


#: Of three models.
WATCH = {
    "llama-3.2-1b-instruct": Watch((128000,), (128009,), (128006, 78191, 128007, 271)),
    "qwen2.5-1.5b-instruct": Watch((151644,), (151645,), (151645, 198, 151644, 77091, 198)),
    "gemma-2-2b-it": Watch((2,), (107,), (107, 108, 106, 2516, 108), (1,)),
}


def labels(ids: Column, watch: Watch) -> Column:
    """Labels, one for each id: what follows the start pattern is its own label, up to and with an end; all else IGNORE.

    Nothing starts before the first begin, nor within a response. A final id at the very last place is labelled too. An Arrow
    kernel over each array, linear in its length; null arrays stay null.
    """
    begin, end, start, final, k = frozenset(watch.begin), frozenset(watch.end), list(watch.start), frozenset(watch.final), len(watch.start)

    def of(own: list) -> list:
        n, out = len(own), [IGNORE] * len(own)
        at = next((i for i, x in enumerate(own) if x in begin), n) if k else n
        while at < n:
            if own[at] == start[0] and own[at : at + k] == start:
                first = at + k
                last = next((i for i in range(first, n) if own[i] in end), n - 1)
                out[first : last + 1] = own[first : last + 1]
                at = max(first, last + 1)
            else:
                at += 1
        if n and own[-1] in final:
            out[-1] = own[-1]
        return out

    @F.pandas_udf("array<long>")
    def kernel(column: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else of(x.tolist()) for x in column], dtype=object)

    return kernel(ids)


def response_ranges(label: Column) -> Column:
    """Half-open ranges (first, past) of neighbouring labels that are not IGNORE, in order."""
    n = F.size(label)
    inside = lambda i: (i >= 1) & (i <= n) & (F.coalesce(F.try_element_at(label, F.greatest(i, F.lit(1))), F.lit(IGNORE)) != IGNORE)
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    firsts = F.filter(at, lambda i: inside(i) & ~inside(i - 1))
    lasts = F.filter(at, lambda i: inside(i) & ~inside(i + 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct((a - 1).cast("long").alias("first"), b.cast("long").alias("past")))


def attention(ids: Column, begin) -> Column:
    """0 before the first `begin`, 1 from there; all 1 where it was cut away."""
    first = F.array_position(ids, begin)
    return F.transform(ids, lambda _, i: F.when(i + 1 >= first, 1).otherwise(0))


def places(ids: Column, wanted) -> Column:
    """Indices of an id, [-1] where there is none: where signal vectors go."""
    found = F.filter(F.transform(ids, lambda x, i: F.when(x == wanted, i.cast("long"))), lambda i: i.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(-1).cast("long")))


def continuation(prompt: Column, generated: Column, stop: tuple) -> Column:
    """What was generated: without the prompt where it begins with exactly that, up to the first stop id."""
    rest = F.when(F.slice(generated, F.lit(1), F.size(prompt)) == prompt, F.slice(generated, F.size(prompt) + 1, F.size(generated))).otherwise(generated)
    ends = F.filter(F.transform(rest, lambda x, i: F.when(x.isin(*stop), i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(ends) > 0, F.slice(rest, F.lit(1), F.element_at(ends, 1) - 1)).otherwise(rest)


def answer(text: Column) -> Column:
    """The last block that `Answer:` begins, to a line of dashes or `Output:` or `Question:`, on one line without closing periods."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)Answer:\s*(.+?)(?=\n(?:[-#]{3,}|Output:|Question:)|\z)"), F.lit(1))
    last = F.when(F.size(blocks) > 0, F.element_at(blocks, -1)).otherwise("")
    return F.regexp_replace(F.replace(F.regexp_replace(last, r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" ")), r"[ .]+$", "")
