"""Chat formatting (operator 5): relational, reversible, expressions only.

A conversation becomes blocks, one for each run of turns of the same role:

    <|role:user|>first text<|turn|>second text<|end|><|role:assistant|>...<|end|>

In texts a backslash is doubled and `<|` becomes `<\\|`, so no text can hold a
control string; roles are percent-escaped. The loss mask covers the texts of
blocks of the learned role and nothing else.

Turns are sorted by (turn, role, text), nulls first; null roles and texts are
empty; repeated rows are turns of their own; rows with a null conv_id form one
conversation; an empty table gives an empty result; extra columns are ignored.
A long conversation is put together in pieces of `PIECE` turn numbers, so no
task sorts it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 64
OPEN, CLOSE, TURN, END = "<|role:", "|>", "<|turn|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%7C"), F.lit("|")), F.lit("%25"), F.lit("%"))


def _opening(role: Column) -> Column:
    return F.concat(F.lit(OPEN), escape_role(role), F.lit(CLOSE))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted) from rows (conv_id, turn, role, text)."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # First pieces: turns in order, merged where the role goes on; the first turn's opening is left to the join of pieces.
    pieces = (
        rows.groupBy("conv_id", F.floor(F.col("turn") / PIECE).alias("piece"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
        .select("conv_id", "piece", F.col("t")[0]["role"].alias("first"), F.element_at("t", -1)["role"].alias("last"), F.array_join(F.transform("t", lambda x, i: F.concat(F.when(i == 0, "").when(x.role == F.get(F.col("t"), i - 1).role, TURN).otherwise(F.concat(F.lit(END), _opening(x.role))), escape(x.text))), "").alias("body"))
    )
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "first", "last", "body"))).alias("p"))
    between = F.transform("p", lambda x, i: F.concat(F.when(i == 0, _opening(x.first)).when(x.first == F.get(F.col("p"), i - 1).last, TURN).otherwise(F.concat(F.lit(END), _opening(x.first))), x.body))
    return whole.select("conv_id", F.concat(F.array_join(between, ""), F.lit(END)).alias("formatted"))


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), read from the string alone."""
    def turns(block: Column) -> Column:
        stop = F.locate(CLOSE, block)
        role = unescape_role(F.substr(block, F.lit(len(OPEN) + 1), stop - len(OPEN) - 1))
        return F.transform(F.split(F.substr(block, stop + len(CLOSE)), r"<\|turn\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != ""), turns))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t.role == role), lambda t: t.text), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the formatted strings."""
    parsed = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parse_chat(F.col("formatted")).alias("turns"))
    read = parsed.select("conv_id", "formatted_chars", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("all"), loss_text(F.col("turns")).alias("loss"))
    return read.select("conv_id", "n_turns", F.sha2("all", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
