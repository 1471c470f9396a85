"""Chat formatting by event-sourced reconstruction.

A log has events ``(conv_id, seq, message_id, kind, role, text)``. Folding a message's events in
sequence gives its final text: ``message``, ``edit`` and ``regenerate`` set the text anew,
``delta`` appends to it, ``delete`` takes the message away. Messages are folded one by one
(events meet by conversation and message), so a conversation of any length never has to fit in
memory; a message's place is that of its first event. Each turn is rendered as

    ### role: text</turn>

and a line end. Backslash, ``#`` and ``<`` in texts, and also ``:`` in roles, are escaped by a
backslash, so no text can hold an unescaped control string, and reading back is exact.

Null roles and texts count as empty. Equal sequence numbers of a message are folded in order of
kind and text. A null conversation id is one conversation of its own. Unknown kinds are an error.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy

HEADER, CLOSE = "### ", "</turn>\n"
SETS = ("message", "edit", "regenerate")
TRAINED = "assistant"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(col, extra: str = ""):
    return F.regexp_replace(col, rf"([\\#<{extra}])", r"\\$1")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """``(role, text, start, end)`` of each turn; start and end are those of its escaped text."""
    out, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found[1]), unescape(found[2]), *found.span(2)))
        at = found.end()
    return out


def fold(events: DataFrame) -> DataFrame:
    """Events -> final messages ``(conv_id, place, message_id, role, text)``."""
    known = F.col("kind").isin(*SETS, "delta", "delete")
    e = events.select("conv_id", "seq", "message_id", F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null"))))).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    order = F.struct("seq", "kind", "text")
    start = F.max(F.when(F.col("kind") != "delta", order))
    by = e.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("place"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
        start.alias("start"),
        F.array_sort(F.collect_list(order)).alias("log"),
    )
    kept = F.filter("log", lambda x: F.col("start").isNull() | (x >= F.col("start")))
    text = F.array_join(F.transform(kept, lambda x: x["text"]), "")
    return by.where("start is null or start.kind <> 'delete'").select("conv_id", "place", "message_id", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """``(conv_id, place, message_id, formatted, loss_start, loss_end)`` for each turn; the loss span is null for turns that aren't trained on."""
    head = F.concat(F.lit(HEADER), escape(F.col("role"), ":"), F.lit(": "))
    body = escape(F.col("text"))
    out = messages.select("conv_id", "place", "message_id", "role", head.alias("head"), body.alias("body"))
    trained = F.col("role") == TRAINED
    return out.select("conv_id", "place", "message_id", F.concat("head", "body", F.lit(CLOSE)).alias("formatted"), F.when(trained, F.length("head")).alias("loss_start"), F.when(trained, F.length("head") + F.length("body")).alias("loss_end"))


def conversations(turns: DataFrame) -> DataFrame:
    """Rendered turns -> one row for each conversation with its whole text and loss spans, for those that fit in a row."""
    own = F.array_sort(F.collect_list(F.struct("place", "message_id", "formatted", "loss_start", "loss_end")))
    return turns.groupBy("conv_id").agg(own.alias("t")).select("conv_id", F.array_join(F.transform("t", lambda x: x["formatted"]), "").alias("formatted"), F.size("t").alias("n_turns"))


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its rendered turns in order; one turn is held at a time."""

    def run(batches):
        def row():
            return (conv, n, all_sha.hexdigest(), chars, loss_sha.hexdigest(), formatted_chars)

        conv, n, rows = None, 0, []
        for b in batches:
            for c, formatted, lo, hi in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if not n or c != conv:
                    if n:
                        rows.append(row())
                    conv, n, chars, formatted_chars, all_sha, loss_sha = c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text, _, _ in parse(formatted):
                    n += 1
                    all_sha.update(f"{role}\n{text}\n".encode())
                if lo is not None:
                    loss = unescape(formatted[lo:hi])
                    chars += len(loss)
                    loss_sha.update(loss.encode())
                formatted_chars += len(formatted)
            if rows:
                yield batch(rows)
                rows = []
        if n:
            yield batch([row()])

    def batch(rows):
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    by = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place", "message_id").select(F.col("conv_id").cast("bigint"), "formatted", "loss_start", "loss_end")
    return by.mapInArrow(tidy(run), "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def log_of_turns(rows: DataFrame) -> DataFrame:
    """A table of finished turns ``(conv_id, turn, role, text)`` as a log: each row opens with an empty message and streams its text in deltas of up to 512 code points.

    Rows of equal conversation and turn are messages of their own, in order of role and text.
    """
    tie = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")) - 1
    own = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("message_id", F.struct(F.col("turn"), tie.alias("tie")))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 512).cast("int")), lambda i: F.substring("text", i * 512 + 1, F.lit(512)))
    deltas = F.when(F.length("text") > 0, F.transform(pieces, lambda x, i: F.struct((i + 1).alias("step"), F.lit("delta").alias("kind"), x.alias("text")))).otherwise(F.array().cast("array<struct<step:int,kind:string,text:string>>"))
    opening = F.array(F.struct(F.lit(0).alias("step"), F.lit("message").alias("kind"), F.lit("").alias("text")))
    return own.select("conv_id", "message_id", "role", F.explode(F.concat(opening, deltas)).alias("e")).select("conv_id", F.struct("message_id", "e.step").alias("seq"), "message_id", "e.kind", "role", "e.text")
