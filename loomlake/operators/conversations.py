"""Conversations: alignment to one layout, validity, markers, reasoning text. Array functions inside a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomlake.operators.columns import let, strip

EMPTY = "array<struct<role:string,content:string>>"


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def nest_turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: (key, messages) in order of turn."""
    turns = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return df.groupBy(key).agg(F.transform(turns, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def unnest_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    return df.select(key, F.posexplode("messages").alias("turn", "m")).select(key, F.col("turn").cast("long").alias("turn"), "m.role", F.col("m.content").alias("text"))


def align_sharegpt(df: DataFrame, messages: str = "messages", user: tuple = ("user", "observation"), assistant: tuple = ("assistant", "function"), ranking: bool = False) -> DataFrame:
    """Adds _prompt, _response, _system. A leading system message is split off; user and assistant roles must take
    turns; the number must be even (odd for ranking data, whose answers are elsewhere). Broken rows get empty arrays."""
    m = F.col(messages)
    lead = F.coalesce(F.get(m, 0)["role"] == "system", F.lit(False))
    df = df.withColumn("_system", F.when(lead, F.get(m, 0)["content"]).otherwise("")).withColumn("__m", F.when(lead, F.slice(m, 2, F.greatest(F.size(m), F.lit(1)))).otherwise(m))
    turns = F.col("__m")
    ok = F.forall(F.transform(turns, lambda x, i: F.when(i % 2 == 0, x["role"].isin(*user)).otherwise(x["role"].isin(*assistant))), lambda x: x)
    ok &= (F.size(turns) % 2 == (1 if ranking else 0)) & (F.size(turns) > 0)
    none = F.array().cast(EMPTY)
    prompt = turns if ranking else F.slice(turns, 1, F.size(turns) - 1)
    df = df.withColumn("__ok", ok)
    df = df.withColumn("_prompt", F.when(F.col("__ok"), F.when(F.size(turns) > 0, prompt).otherwise(none)).otherwise(none))
    return df.withColumn("_response", F.when(F.col("__ok"), F.slice(turns, F.size(turns), 1) if not ranking else none).otherwise(none)).drop("__m", "__ok")


def align_alpaca(df: DataFrame, instruction: str = "instruction", query: str = "input", output: str = "output", history: str | None = None, kto_tag: str | None = None, chosen: str | None = None, rejected: str | None = None) -> DataFrame:
    """Adds _prompt and _response from instruction columns: history pairs, then the non-empty ones of instruction and
    query joined by a line feed; the response by tag (KTO), as chosen and rejected, or as it is."""
    asked = F.concat_ws("\n", *[F.when(F.length(c) > 0, F.col(c)) for c in (instruction, query)])
    last = F.array(message("user", asked))
    if history:
        pairs = F.flatten(F.transform(F.coalesce(F.col(history), F.array().cast("array<array<string>>")), lambda p: F.array(message("user", F.get(p, 0)), message("assistant", F.get(p, 1)))))
        last = F.concat(pairs, last)
    given, empty = message("assistant", F.col(output)), message("assistant", F.lit(""))
    answer = F.when(F.col(output).isNotNull(), F.array(given)).otherwise(F.array().cast(EMPTY))
    if chosen and rejected:
        answer = F.when(F.col(chosen).isNotNull() & F.col(rejected).isNotNull(), F.array(message("assistant", F.col(chosen)), message("assistant", F.col(rejected)))).otherwise(answer)
    if kto_tag:
        answer = F.when(F.col(kto_tag), F.array(given, empty)).when(~F.col(kto_tag), F.array(empty, given)).otherwise(answer)
    return df.withColumn("_prompt", last).withColumn("_response", answer)


def valid_examples(df: DataFrame, stage: str = "sft") -> DataFrame:
    """Rows with an odd number of prompt messages and, by stage, one response (sft), at least two (rm, kto) or any."""
    n = F.size("_response")
    return df.where((F.size("_prompt") % 2 == 1) & {"sft": n == 1, "rm": n >= 2, "kto": n >= 2}.get(stage, F.lit(True)))


def list_to_conversation(turns: Column) -> Column:
    """A flat list of texts as user and assistant messages; an odd last one goes; null below two."""
    even = F.slice(turns, 1, (F.size(turns) - F.size(turns) % 2).cast("int"))
    return F.when(F.size(turns) >= 2, F.transform(even, lambda t, i: message(F.when(i % 2 == 0, "user").otherwise("assistant"), t)))


def parse_marked_text(text: Column, human: str = "Human:", assistant: str = "Assistant:") -> Column:
    """Text with speaker marks as messages; pieces without text go."""
    parts = F.filter(F.transform(F.split(text, human), lambda x: F.trim(x)), lambda p: p != "")
    both = F.transform(parts, lambda p: F.transform(F.split(p, assistant, 2), lambda x: F.trim(x)))
    return F.filter(F.flatten(F.transform(both, lambda b: F.array(message("user", F.get(b, 0)), message("assistant", F.coalesce(F.get(b, 1), F.lit("")))))), lambda m: m["content"] != "")


def preference_dialogue(chosen: Column, rejected: Column) -> Column:
    """(instruction, chosen, rejected, n_history) by the last speaker marks of a dialogue text."""
    a, h = "\n\nAssistant: ", "\n\nHuman: "
    turns = F.split(chosen, a)
    before = F.array_join(F.slice(turns, 1, F.size(turns) - 1), a)
    return F.struct(F.trim(F.substring_index(before, h, -1)).alias("instruction"), F.trim(F.substring_index(chosen, a, -1)).alias("chosen"), F.trim(F.substring_index(rejected, a, -1)).alias("rejected"), (F.size(F.split(before, h)) - 2).alias("n_history"))


def ensure_marker(text: Column, mark: str = "<image>", mode: str = "prefix") -> Column:
    """``mark`` and a line feed before texts that do not start with it (or, mode "contains", do not have it)."""
    has = F.startswith(F.ltrim(text), F.lit(mark)) if mode == "prefix" else F.contains(text, F.lit(mark))
    return F.when(has, text).otherwise(F.concat(F.lit(f"{mark}\n"), text))


def media_consistent(messages: Column, mark: str, media: Column) -> Column:
    """Whether all contents together hold as many marks as there are media."""
    n = F.aggregate(messages, F.lit(0), lambda a, m: a + F.size(F.split(m["content"], mark)) - 1)
    return n == F.coalesce(F.size(media), F.lit(0))


def final_text(text: Column) -> Column:
    """Text after the last </think>, and in it after the last of the answer marks, in any case."""
    def after(out: Column) -> Column:
        for mark in (r"\[Final Answer\]:", "FINAL_ANSWER:", "Answer:"):
            out = strip(F.regexp_replace(out, f"(?is)^.*{mark}", ""))
        return out

    # all marks hold one word, and looking for that costs far less than a pattern
    return let(strip(F.substring_index(text, "</think>", -1)), lambda out: F.when(F.contains(F.lower(out), F.lit("answer")), after(out)).otherwise(out))


def answer_tag(text: Column) -> Column:
    """Inside of the last <answer> tag, else the last line that is not blank; quotes and spaces around go."""
    tags = F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    picked = F.when(F.size(tags) > 0, F.get(tags, F.size(tags) - 1)).otherwise(F.coalesce(F.get(lines, F.size(lines) - 1), F.lit("")))
    return F.regexp_replace(picked, "^[\\s\"']+|[\\s\"']+$", "")


def teacher_force(text: Column, gold: Column) -> Column:
    """The reasoning up to the last </think>, then the gold answer; null without gold or tag."""
    parts = F.split(text, "</think>")
    n = F.size(parts)
    head = F.array_join(F.slice(parts, 1, n - 1), "</think>")
    return F.when((n > 1) & (F.trim(gold) != ""), F.concat(head, F.lit("</think>\n"), F.trim(gold)))


def strip_thought(messages: Column, keep_last: bool = True) -> Column:
    """Reasoning blocks out of assistant messages: of all, or of all but the last message."""
    def clean(m: Column, i: Column) -> Column:
        out = message(m["role"], F.regexp_replace(m["content"], r"(?s)<think>.*?</think>\s*", ""))
        keep = (m["role"] != "assistant") | (i == F.size(messages) - 1 if keep_last else F.lit(False))
        return F.when(keep, message(m["role"], m["content"])).otherwise(out)

    return F.transform(messages, clean)


# The formats of three public chat layouts.
TEMPLATES = {
    "chatml": {"system": "<|im_start|>system\n{}<|im_end|>\n", "user": "<|im_start|>user\n{}<|im_end|>\n<|im_start|>assistant\n", "assistant": "{}<|im_end|>\n"},
    "llama3": {"system": "<|start_header_id|>system<|end_header_id|>\n\n{}<|eot_id|>", "user": "<|start_header_id|>user<|end_header_id|>\n\n{}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "assistant": "{}<|eot_id|>"},
    "plain": {"system": "{}\n", "user": "Human: {}\nAssistant: ", "assistant": "{}\n"},
}


def render_chat(messages: Column, template: str) -> Column:
    """All messages as one text in a template's formats."""
    t = TEMPLATES[template]
    around = lambda role, c: F.concat(F.lit(t[role].split("{}")[0]), c, F.lit(t[role].split("{}")[1]))
    one = lambda m: F.when(m["role"] == "system", around("system", m["content"])).when(m["role"] == "user", around("user", m["content"])).otherwise(around("assistant", m["content"]))
    return F.array_join(F.transform(messages, one), "")


def tool_calls(text: Column) -> Column:
    """Tool calls of an assistant message as (name, arguments JSON): "Action:" lines, or <tool_call> JSON; none if any
    of the JSON can't be read."""
    names = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)Action:\s*([^\n]+)\s*Action Input:\s*(.+?)(?=\s*Action:|\s*$)"), F.lit(1)), lambda x: F.trim(x))
    inputs = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)Action:\s*([^\n]+)\s*Action Input:\s*(.+?)(?=\s*Action:|\s*$)"), F.lit(2)), lambda x: F.trim(x))
    tagged = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1)), lambda x: F.trim(x))
    pair = lambda n, a: F.struct(n.alias("name"), a.alias("arguments"))
    none = F.array().cast("array<struct<name:string,arguments:string>>")
    lines = F.when(F.forall(inputs, lambda x: F.try_parse_json(x).isNotNull()), F.zip_with(names, inputs, pair)).otherwise(none)
    json = F.when(F.forall(tagged, lambda x: F.get_json_object(x, "$.name").isNotNull()), F.transform(tagged, lambda x: pair(F.get_json_object(x, "$.name"), F.get_json_object(x, "$.arguments")))).otherwise(none)
    return F.when(F.size(tagged) > 0, json).otherwise(lines)


def first_nonempty(df: DataFrame, *names: str) -> Column:
    """The first of the columns that is neither null nor an empty text or array; null if there is none."""
    some = lambda n: F.size(F.col(f"`{n}`")) > 0 if df.schema[n].dataType.typeName() == "array" else F.col(f"`{n}`").cast("string") != ""
    return F.coalesce(*[F.when(some(n), F.col(f"`{n}`")) for n in names])
