"""Chat templates as Column expressions over array<struct<role,content>>.

A template says how a turn, the request for a reply and a reply without reasoning are
written, with the fields {role} and {content}. It is compiled once into one expression, so
rendering stays in the JVM and needs no model files. A tokenizer that has a template of its
own is asked in Arrow batches instead (``render_with``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from string import Formatter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"


@dataclass(frozen=True)
class ChatTemplate:
    """How a conversation is written.

    turn: a message. roles: other ways for some roles. begin: what comes before all.
    request: the beginning of a reply that is asked for; no_thinking follows it where reasoning
    is off. reply: the last messages of the assistant, after the last of the user, whose
    reasoning may be shown; of earlier ones what stands up to the end mark of reasoning is cut.
    """

    turn: str
    request: str = ""
    begin: str = ""
    no_thinking: str = ""
    reply: str | None = None
    end_of_thinking: str | None = None
    roles: dict[str, str] = field(default_factory=dict)
    assistant: str = "assistant"
    user: str = "user"

    def __post_init__(self) -> None:
        for form in (self.turn, *self.roles.values(), *([self.reply] if self.reply else [])):
            names = {name for _, name, _, _ in Formatter().parse(form) if name is not None}
            if not names <= {"role", "content"}:
                raise ValueError(f"unknown fields in a chat template: {sorted(names - {'role', 'content'})}")


#: The marks of two public chat formats.
CHATML = ChatTemplate(
    turn="<|im_start|>{role}\n{content}<|im_end|>\n",
    request="<|im_start|>assistant\n",
    no_thinking="<think>\n\n</think>\n\n",
    reply="<|im_start|>{role}\n<think>\n\n</think>\n\n{content}<|im_end|>\n",
    end_of_thinking="</think>",
)
HEADERS = ChatTemplate(
    begin="<|begin_of_text|>",
    turn="<|start_header_id|>{role}<|end_header_id|>\n\n{content}<|eot_id|>",
    request="<|start_header_id|>assistant<|end_header_id|>\n\n",
)


def _filled(form: str, role: Column, content: Column) -> Column:
    fields = {"role": role, "content": content}
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(form):
        parts += [F.lit(literal)] if literal else []
        parts += [fields[name]] if name else []
    return F.concat(*parts) if parts else F.lit("")


def render_chat(messages: Column, template: ChatTemplate = CHATML, generation_prompt: bool = True, thinking: bool | Column = False) -> Column:
    """The text of a conversation. A null list is an empty one; null roles and contents are empty.

    thinking: whether a reply that is asked for may reason; may be a column.
    """
    said = F.coalesce(messages, F.array().cast(MESSAGES))
    places = F.transform(said, lambda m, k: F.when(m["role"] == template.user, k).otherwise(-1))
    last_user = F.coalesce(F.array_max(places), F.lit(-1))

    def turn(m: Column, k: Column, after: Column) -> Column:
        role, content = F.coalesce(m["role"], F.lit("")), F.coalesce(m["content"], F.lit(""))
        bare = content
        if template.end_of_thinking:
            bare = F.when(role == template.assistant, F.ltrim(F.substring_index(content, template.end_of_thinking, -1), F.lit("\n"))).otherwise(content)
        out = _filled(template.turn, role, bare)
        for name, form in template.roles.items():
            out = F.when(role == name, _filled(form, role, bare)).otherwise(out)
        if template.reply:
            open_reply = (role == template.assistant) & (k > after)
            out = F.when(open_reply, F.when(F.contains(content, F.lit(template.end_of_thinking or "\0")), _filled(template.turn, role, content)).otherwise(_filled(template.reply, role, content))).otherwise(out)
        return out

    # The last place of the user is bound to a lambda's variable, or it would be looked for once a message.
    body = F.transform(F.array(last_user), lambda after: F.array_join(F.transform(said, lambda m, k: turn(m, k, after)), ""))[0]
    tail = F.lit("")
    if generation_prompt:
        closed = F.lit(template.no_thinking)
        tail = F.concat(F.lit(template.request), F.when(thinking, F.lit("")).otherwise(closed) if isinstance(thinking, Column) else F.lit("") if thinking else closed)
    return F.concat(F.lit(template.begin), body, tail)


def user_prompt(prompt: Column, template: ChatTemplate = CHATML, thinking: bool | Column = False) -> Column:
    """A single request of the user, ready for a reply."""
    return render_chat(_messages(("user", prompt)), template, True, thinking)


def training_text(prompt: Column, answer: Column, template: ChatTemplate = CHATML) -> Column:
    """A request with its reply, as a model is trained on it."""
    return render_chat(_messages(("user", prompt), ("assistant", answer)), template, False)


def _messages(*turns: tuple[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns))


def conversations(df: DataFrame, key: str, turn: str, role: str, content: str) -> DataFrame:
    """key and messages: a conversation's rows by turn, then role and content."""
    items = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(content).alias("content"))))
    rows = df.groupBy(key).agg(items.alias("items"))
    return rows.select(key, F.transform("items", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def render_with(df: DataFrame, messages: str, load: Callable[[], object], out: str = "rendered", generation_prompt: bool = True, thinking: bool = False) -> DataFrame:
    """df with the text that a tokenizer's own template gives. load runs once a task; its result has apply_chat_template."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load()
        for b in batches:
            asked = ([{"role": m["role"], "content": m["content"]} for m in ([] if x is None else x)] for x in b[messages])
            yield b.assign(**{out: [tokenizer.apply_chat_template(x, tokenize=False, add_generation_prompt=generation_prompt, enable_thinking=thinking) for x in asked]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, `{out}` string")
