"""Chat formatting as relations: sorted turns, merged blocks, marks, reversible escapes; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import require_columns

# The marks of this template, and what counts as a control string of it or of common others.
START, TEXT, NEXT, END = "<|im_start|>", "<|text|>", "<|turn|>", "<|im_end|>"
CONTROLS = r"/?s>|/?INST\]|</?SYS>>|\|[a-z_]+\|>"
ESCAPE = rf"([<\[])(\\*)({CONTROLS})"
UNESCAPE = rf"([<\[])\\(\\*)({CONTROLS})"


def escape(text: Column) -> Column:
    """Put one more backslash into every control string, with or without backslashes already, after its first sign."""
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """Take that backslash out again."""
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def format_chats(conversations: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, segments): one text per conversation, and its parts with a loss flag.

    Turns are sorted by turn, then role and text. Adjacent turns of one role form a block: its marks and role once,
    the texts in order with a mark between. Control strings in roles and texts are escaped, so only the template's
    own marks remain and the text can be read back whole. ``segments`` joined give ``formatted``; loss is set on the
    texts of ``learned_role``.

    Null roles and texts count as empty, a null turn sorts first, a null conv_id is a conversation of its own.
    Repeated rows are repeated turns. Other columns are ignored; an empty table gives no rows. A conversation becomes
    one row by definition; its work is linear in its length.
    """
    require_columns(conversations, "conv_id", "turn", "role", "text")
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    sorted_turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def parts(t: Column, i: Column) -> Column:
        before, after = F.get("turns", i - 1)["role"], F.get("turns", i + 1)["role"]
        opens, closes = ~before.eqNullSafe(t["role"]), ~after.eqNullSafe(t["role"])
        head = F.when(opens, F.concat(F.lit(START), escape(t["role"]), F.lit(TEXT))).otherwise(F.lit(NEXT))
        tail = F.when(closes, F.lit(END + "\n")).otherwise(empty)
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == learned_role).alias("loss")),
            F.struct(tail.alias("text"), F.lit(False).alias("loss")),
        )

    segmented = sorted_turns.select("conv_id", F.flatten(F.transform("turns", parts)).alias("segments"))
    return segmented.select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments")


def _quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def read_back(formatted: Column | str) -> Column:
    """The turns array<struct<role, text>> of a formatted text."""
    text = F.col(formatted) if isinstance(formatted, str) else formatted
    blocks = F.filter(F.split(text, _quoted(END + "\n"), -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        halves = F.split(block.substr(F.lit(len(START) + 1), F.length(block)), _quoted(TEXT), 2)
        return F.transform(
            F.split(F.get(halves, F.lit(1)), _quoted(NEXT), -1),
            lambda t: F.struct(unescape(F.get(halves, F.lit(0))).alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from formatted texts."""
    learned = F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), ""
    )
    read = formatted.select("conv_id", "formatted", read_back("formatted").alias("turns"), learned.alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
