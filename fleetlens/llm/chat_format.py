"""Conversations as training text: a template whose marks the texts cannot forge, and a mask over what is learnt.

Column functions only. The rows of a conversation are collected, sorted and merged by array functions that look at each
turn a fixed number of times, so that work grows with the length of a conversation and not with its square."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.frames import let

#: Lengths are summed up in blocks of so many pieces.
BLOCK = 256


@dataclass(frozen=True)
class Template:
    """A message is `start` role `head` text `more` text ... `end`; `more` parts merged turns of one role.

    Texts and roles that hold a mark, or a string of `reserved` that tokenizers and other templates read as control,
    get a backslash after its first character, one more than it has there already, and lose it when read back."""

    start: str = "<|im_start|>"
    head: str = "<|im_sep|>"
    more: str = "<|im_more|>"
    end: str = "<|im_end|>"
    reserved: tuple[str, ...] = field(default=("<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]"))

    def __post_init__(self):
        for mark in self.marks:
            if len(mark) < 2 or mark[1] == "\\" or any(other[0] in mark[1:] for other in self.marks):
                raise ValueError(f"{mark!r}: a mark has two characters or more and holds the first one of a mark only at its start")

    @property
    def marks(self) -> tuple[str, ...]:
        return (self.start, self.head, self.more, self.end, *self.reserved)

    def _pattern(self, backslashes: str) -> str:
        by_first: dict[str, list[str]] = {}
        for mark in self.marks:
            by_first.setdefault(mark[0], []).append(re.escape(mark[1:]))
        return "|".join(f"(?<={re.escape(a)}){backslashes}(?={rests})" for a, rests in (
            (a, r"\\*+(?:" + "|".join(r) + ")") for a, r in by_first.items()))

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self._pattern("")), F.lit(r"\\"))

    def read(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self._pattern(r"\\")), F.lit(""))


def _places(start: Column, end: Column) -> Column:
    """start to end - 1; none where they are equal. Elements are fetched by place: cutting a slice goes through its whole array."""
    return F.when(end > start, F.sequence(start.cast("int"), end.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _all(array: Column) -> Column:
    return _places(F.lit(0), F.size(array))


def _merged(turns: Column) -> Column:
    """Adjacent turns of one role as one message: role, texts."""
    def of(starts: Column) -> Column:
        def message(a: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(turns))
            return F.struct(turns[a]["role"].alias("role"), F.transform(_places(a, end), lambda i: turns[i]["text"]).alias("texts"))

        return F.transform(starts, message)

    return let(F.filter(_all(turns), lambda i: (i == 0) | (turns[i]["role"] != turns[F.greatest(i - 1, F.lit(0))]["role"])), of)


def _pieces(messages: Column, template: Template, learnt: tuple[str, ...]) -> Column:
    """What is written for each turn: the marks before it, its escaped text, and whether it is learnt."""
    def of(m: Column, k: Column) -> Column:
        opening = F.concat(F.when(k > 0, F.lit(template.end)).otherwise(F.lit("")), F.lit(template.start), template.escaped(m["role"]), F.lit(template.head))
        return F.transform(m["texts"], lambda t, i: F.struct(
            F.when(i == 0, opening).otherwise(F.lit(template.more)).alias("lead"), template.escaped(t).alias("text"), m["role"].isin(*learnt).alias("learnt")))

    return F.flatten(F.transform(messages, of))


def _before(sizes: Column) -> Column:
    """For each place, the sum of all sizes before it. Blocks first, so that no place adds up all others."""
    def total(start: Column, end: Column) -> Column:
        return F.aggregate(_places(start, end), F.lit(0).cast("long"), lambda s, i: s + sizes[i])

    def with_blocks(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda s, x: F.array_append(s, F.element_at(s, -1) + x))
        return let(starts, lambda at: F.transform(_all(sizes), lambda i: at[F.floor(i / BLOCK).cast("int")] + total(i - i % BLOCK, i)))

    ends = F.transform(_places(F.lit(1), F.ceil(F.size(sizes) / BLOCK)), lambda b: total((b - 1) * BLOCK, b * BLOCK))
    return let(ends, with_blocks)


def _written(pieces: Column, template: Template) -> Column:
    """The whole text, and the learnt spans in bytes of its UTF-8, the end exclusive."""
    text = F.concat(F.array_join(F.transform(pieces, lambda p: F.concat(p["lead"], p["text"])), ""), F.lit(template.end))
    sizes = F.transform(pieces, lambda p: (F.octet_length(p["lead"]) + F.octet_length(p["text"])).cast("long"))

    def spans(before: Column) -> Column:
        def span(p: Column, start: Column) -> Column:
            return F.struct(start.alias("start"), (start + F.octet_length(p["text"])).alias("end"), p["learnt"].alias("learnt"))

        every = F.zip_with(pieces, before, lambda p, b: span(p, b + F.octet_length(p["lead"])))
        return F.transform(F.filter(every, lambda s: s["learnt"]), lambda s: F.struct(s["start"], s["end"]))

    return F.struct(text.alias("formatted"), let(let(sizes, _before), spans).alias("loss_spans"))


def format_conversations(turns: DataFrame, template: Template = Template(), learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans (start, end) and n_messages of every conversation. turns: conv_id, turn, role, text.

    Turns are ordered by turn, then role, then text, so that repeated or tied rows give one result, and each row
    is a turn. Adjacent turns of one role are one message. loss_spans cover the texts of `learnt` roles alone, in bytes of
    the formatted text's UTF-8, as tokenizers give offsets.

    A null text or role is empty; a null turn comes first; null ids are one conversation. Other columns are not read. An
    empty table gives an empty result. A conversation is one value, so Spark's 2 GB for a value bound it; conversations
    are dealt out by id, and each task first collects its own rows of an id."""
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("_turns"))
    rows = rows.select("conv_id", let(F.col("_turns"), _merged).alias("_messages"))
    written = let(F.col("_messages"), lambda m: let(_pieces(m, template, learnt), lambda p: _written(p, template)))
    return rows.select("conv_id", F.size("_messages").cast("long").alias("n_messages"), written.alias("_w")).select(
        "conv_id", F.col("_w.formatted").alias("formatted"), F.col("_w.loss_spans").alias("loss_spans"), "n_messages")


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted text, as they were before escaping. Null gives null."""
    def message(m: Column) -> Column:
        return let(F.split(m, F.lit(re.escape(template.head))), lambda x: let(template.read(x[0]), lambda role: F.transform(
            F.split(x[1], F.lit(re.escape(template.more))), lambda t: F.struct(role.alias("role"), template.read(t).alias("text")))))

    body = F.split(formatted, F.lit(re.escape(template.end)))
    return F.flatten(F.transform(F.slice(body, 1, F.size(body) - 1), lambda m: message(F.substring(m, F.lit(len(template.start) + 1), F.length(m)))))


def learnt_texts(formatted: Column, loss_spans: Column, template: Template = Template()) -> Column:
    """The texts that the mask covers, as they were before escaping."""
    return let(formatted.cast("binary"), lambda whole: F.transform(loss_spans, lambda s: template.read(
        F.substring(whole, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string"))))
