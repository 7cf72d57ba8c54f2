r"""Chat formatting: conversations as one training string each, with a loss mask.

Relational, JVM-side only: turns are collected as structs, sorted, adjacent
turns of one role share a block, and the pieces are concatenated with array
functions.

Template of a conversation (``<`` starts every control string)::

    <|user|>text<|next|>text of the same role<|end|>\n
    <|assistant|>text<|end|>\n

Escaping inside texts and roles is reversible and leaves no ``<``: ``\``
becomes ``\0``, ``<`` becomes ``\1``; in roles ``|`` also becomes ``\2``.
So no text can forge a control string, whatever it holds.

``loss_runs`` is the loss mask as run lengths over the code points of
``formatted``: alternately ``skip`` code points without loss, then ``take``
code points under loss; one run per control string.

Defined cases: a null text is empty; a null role is the empty role; rows with
a null conversation id form one conversation; ties in ``turn`` are ordered by
role and text (null turns first); repeated rows are repeated turns; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\0")), F.lit("<"), F.lit("\\1"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\1"), F.lit("<")), F.lit("\\0"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("|"), F.lit("\\2"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\2"), F.lit("|")))


def format_chat(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """``conv_id, formatted, loss_runs`` of ``turns(conv_id, turn, role, text)``."""
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
                 F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        same = (i > 0) & (F.get(F.col("turns"), i - 1)["role"] == t["role"])
        last = F.coalesce(F.get(F.col("turns"), i + 1)["role"] != t["role"], F.lit(True))
        head = F.when(same, F.lit("<|next|>")).otherwise(
            F.concat(F.lit("<|role:"), escape_role(t["role"]), F.lit("|>")))
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"),
                        F.when(last, F.lit("<|end|>\n")).otherwise(F.lit("")).alias("tail"),
                        (t["role"] == F.lit(loss_role)).alias("loss"))

    def run(p: Column) -> Column:
        # the end marker is skipped by a run of its own
        body = F.length(p["body"])
        own = F.struct(
            (F.length(p["head"]) + F.when(p["loss"], 0).otherwise(body)).alias("skip"),
            F.when(p["loss"], body).otherwise(0).alias("take"))
        end = F.struct(F.length(p["tail"]).alias("skip"), F.lit(0).alias("take"))
        return F.when(p["tail"] == "", F.array(own)).otherwise(F.array(own, end))

    pieces = sorted_turns.select("conv_id", F.transform("turns", piece).alias("pieces"))
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.flatten(F.transform("pieces", run)).alias("loss_runs"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns array<struct<role,text>>, loss_text``, from the
    formatted string and its mask alone.  The string is cut at its control
    strings once; a ``next`` block takes the role of the block before it."""
    segments = F.slice(F.split("formatted", "<"), 2, F.size(F.split("formatted", "<")))
    cut = formatted.select("conv_id", "formatted", "loss_runs",
                           F.transform(segments, lambda s: F.concat(F.lit("<"), s)).alias("segments"))
    # the turns between two end markers share the role of their block
    blocks = F.filter(F.split("formatted", "<\\|end\\|>\n"), lambda b: b != F.lit(""))

    def turns_of(block: Column) -> Column:
        head = F.substring_index(block, "|>", 1)
        role = unescape_role(F.substring(head, F.lit(len("<|role:") + 1), F.length(head)))
        body = F.substring(block, F.length(head) + F.lit(3), F.length(block))
        return F.transform(F.split(body, "<\\|next\\|>"),
                           lambda text: F.struct(role.alias("role"), unescape(text).alias("text")))

    loss = F.array_join(
        F.zip_with("segments", "loss_runs",
                   lambda s, r: F.substring(s, r["skip"] + 1, r["take"])), "")
    return cut.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"),
                         unescape(loss).alias("loss_text"))
