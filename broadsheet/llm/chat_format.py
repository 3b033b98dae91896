"""Conversations as training text: turns sorted, neighbours of one role merged, marked and concatenated by Spark expressions.

The text of a conversation is a sequence of blocks. A block has the marks of its
role around one or more texts, and the texts of merged turns are divided by a mark
of their own, so that every turn can be read back:

    [INST] question [/INST]<s> answer [AND] more of the answer </s>

What looks like a mark inside a text gets one backslash behind its first character,
and one more if it has some already; reading takes one away. So no text holds a
mark, and every text comes back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.text import let

# Marks before and after a block, by role, and the role whose texts are learned.
USER, ASSISTANT = ("[INST] ", " [/INST]"), ("<s> ", " </s>")
OTHER = ("[ROLE", " [/ROLE]")  # followed by a space, the role and "] "; by "] " alone for a null role
AND = " [AND] "
LEARNED = "assistant"

_REST = r"(?=s>|/s>|/?INST\]|ROLE|/ROLE\]|AND\])"
_BLOCK = r"(?s)\[INST\] .*? \[/INST\]|<s> .*? </s>|\[ROLE(?: [^\]]*)?\] .*? \[/ROLE\]"
# Characters that a role's name must not show inside its mark, and what stands for them.
_NAME = (("\\", "\\b"), ("]", "\\c"), ("[", "\\o"), ("<", "\\l"))


def escape(text: Column) -> Column:
    """``text`` without anything that reads as a mark."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, r"$1$2")


def _name(role: Column) -> Column:
    for plain, shown in _NAME:
        role = F.replace(role, F.lit(plain), F.lit(shown))
    return role


def _role(name: Column) -> Column:
    for plain, shown in reversed(_NAME):
        name = F.replace(name, F.lit(shown), F.lit(plain))
    return name


def _marks(role: Column) -> tuple[Column, Column]:
    opening = (
        F.when(role == "user", USER[0]).when(role == "assistant", ASSISTANT[0])
        .when(role.isNull(), OTHER[0] + "] ")
        .otherwise(F.concat(F.lit(OTHER[0] + " "), _name(role), F.lit("] ")))
    )
    return opening, F.when(role == "user", USER[1]).when(role == "assistant", ASSISTANT[1]).otherwise(OTHER[1])


def _piece(text: Column, learned: Column) -> Column:
    return F.struct(text.alias("text"), learned.alias("learned"))


def _blocks(turns: Column) -> Column:
    """Runs of neighbours with one role: role, texts. ``turns`` is a sorted array.

    First the places where a run begins are listed, then each run is cut out, so
    the work is linear in the number of turns.
    """
    def begins(turn: Column, i: Column) -> Column:
        return F.when((i == 0) | ~turn["role"].eqNullSafe(F.get(turns, i - 1)["role"]), i)

    def cut(starts: Column) -> Column:
        def block(start: Column, i: Column) -> Column:
            stop = F.coalesce(F.get(starts, i + 1), F.size(turns))
            texts = F.transform(F.slice(turns, start + 1, stop - start), lambda t: t["text"])
            return F.struct(F.get(turns, start)["role"].alias("role"), texts.alias("texts"))

        return F.transform(starts, block)

    return let(F.filter(F.transform(turns, begins), lambda i: i.isNotNull()), cut)


def _pieces(blocks: Column) -> Column:
    """The text in pieces, each learned or not: marks, and the escaped texts of the turns."""
    def of_block(block: Column) -> Column:
        opening, closing = _marks(block["role"])
        learned = F.coalesce(block["role"] == LEARNED, F.lit(False))
        inner = F.flatten(F.transform(block["texts"], lambda text, i: F.array(
            _piece(F.when(i > 0, AND).otherwise(""), F.lit(False)), _piece(escape(text), learned))))
        return F.concat(F.array(_piece(opening, F.lit(False))), inner, F.array(_piece(closing, F.lit(False))))

    return F.filter(F.flatten(F.transform(blocks, of_block)), lambda p: p["learned"] | (p["text"] != ""))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_blocks, pieces, formatted: one row per conversation.

    ``turns``: conv_id, turn, role, text; other columns are not read. Turns go by
    ``turn``, those of equal number by role and text, nulls first; a row that repeats
    is a turn of its own. A null text is an empty one, a null role a role without a
    name, and rows without conv_id are one conversation with a null id. ``pieces``
    (text, learned) put together are ``formatted``; the learned ones are the loss
    mask, one for each text of the assistant. An empty table gives an empty one.

    The rows are dealt once, by conversation. A conversation is one row of the result,
    so it must fit one string; nothing is gathered beyond the texts of one conversation.
    """
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    gathered = turns.groupBy("conv_id").agg(F.collect_list(turn).alias("turns"))
    made = gathered.select("conv_id", let(F.array_sort("turns"), lambda t: let(_blocks(t), lambda b: F.struct(
        F.size(b).alias("n_blocks"), _pieces(b).alias("pieces")))).alias("made"))
    return made.select(
        "conv_id", "made.n_blocks", "made.pieces",
        F.array_join(F.transform("made.pieces", lambda p: p["text"]), "").alias("formatted"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role, text."""
    def of_block(block: Column) -> Column:
        user, assistant = F.startswith(block, F.lit(USER[0])), F.startswith(block, F.lit(ASSISTANT[0]))
        mark = F.substring_index(block, "] ", 1)  # a name shows no closing bracket
        role = F.when(user, "user").when(assistant, "assistant").when(
            F.length(mark) > len(OTHER[0]), _role(F.substr(mark, F.lit(len(OTHER[0]) + 2))))
        head = F.when(user, len(USER[0])).when(assistant, len(ASSISTANT[0])).otherwise(F.length(mark) + 2)
        tail = F.when(user, len(USER[1])).when(assistant, len(ASSISTANT[1])).otherwise(len(OTHER[1]))
        body = F.substr(block, head + 1, F.length(block) - head - tail)
        return let(role, lambda r: F.transform(
            F.split(body, r" \[AND\] ", -1), lambda text: F.struct(r.alias("role"), unescape(text).alias("text"))))

    return F.flatten(F.transform(F.regexp_extract_all(formatted, F.lit(_BLOCK), F.lit(0)), of_block))


def read_learned(pieces: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["learned"]), lambda p: unescape(p["text"])), "")
