"""Chat formatting by prefix-target expansion (DataFrame functions only).

Every assistant turn becomes one training example: all turns before it are
context, and only its own text is under the loss mask.  Turns after the last
assistant turn (or a conversation without one) become one more example with an
empty mask, so that no turn is lost.

Template: each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  In roles and
texts a backslash is doubled and a backslash is put behind the first character
of every control string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``);
removing one backslash before each character undoes it.  A line break in a
role is written ``<|nl|>``.

Defined cases: null text is empty, null role is an empty role; turns are
ordered by (turn, role, text), nulls first, so ties and repeated rows have a
fixed order; rows with a null conversation id form one conversation; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
CONTROL = r"<(?=\||/?s>)|\[(?=/?INST\])"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def format_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                    text_col: str = "text") -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_chars): ``loss_start``
    counts code points from 0; a tail example has ``loss_chars`` = 0 and a
    null ``loss_start``."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    head = F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))
    # Turns are formatted row by row before they meet in their conversation.
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), head.alias("head"),
                 escape(text).alias("body")).alias("t"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    conv = conv.select(
        "conv_id", F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))).alias("whole"),
        F.transform("t", lambda x: F.struct(x["head"].alias("head"), x["body"].alias("body"),
                                            (x["role"] == TRAINED_ROLE).alias("trained"))).alias("t"))
    # One entry per example: the index of its target; the tail's is the length.
    n = F.size("t")
    wanted = F.filter(F.sequence(F.lit(0), n), lambda i: F.when(i < n, F.get(F.col("t"), i)["trained"]).otherwise(
        ~F.element_at(F.col("t"), -1)["trained"]))
    ex = conv.select("conv_id", "t", "whole", F.posexplode(wanted).alias("example", "i"))
    target = F.get(F.col("t"), F.col("i"))
    context = F.array_join(F.slice("whole", 1, F.col("i")), "")
    ex = ex.select("conv_id", "example", context.alias("context"), target.alias("target"))
    return ex.select(
        "conv_id", F.col("example").cast("int").alias("example"),
        F.concat(F.col("context"), F.coalesce(F.concat(F.col("target.head"), F.col("target.body"), F.lit(END)), F.lit(""))
                 ).alias("formatted"),
        F.when(F.col("target").isNotNull(), F.length("context") + F.length("target.head")).alias("loss_start"),
        F.coalesce(F.length("target.body"), F.lit(0)).alias("loss_chars"))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted example."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))

    def piece(p):
        cut = F.instr(p, "\n")
        role = F.replace(F.substring(p, F.lit(1), cut - 1), F.lit(BREAK), F.lit("\n"))
        body = F.substring(p, cut + 1, F.length(p) - cut - len(END))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, piece)


def loss_text(formatted: Column, loss_start: Column, loss_chars: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return F.coalesce(unescape(F.substring(formatted, loss_start + 1, loss_chars)), F.lit(""))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars."""
    one = examples.select(
        "conv_id", "example", F.length("formatted").cast("bigint").alias("chars"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"), "formatted")
    # The last example holds every turn.
    conv = one.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.max_by("formatted", "example").alias("last"), F.sum("chars").alias("formatted_chars"))
    turns = parse_turns(F.col("last"))
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    conv = conv.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted_chars")
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return conv.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
