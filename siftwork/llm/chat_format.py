"""Chat formatting as Spark expressions only.

Turn structs of a conversation are collected and sorted, runs of one role are
merged by array functions, and blocks are joined to one string:

    <|im_start|>ROLE\\nTEXT[<|im_sep|>TEXT...]<|im_end|>\\n

``<|im_sep|>`` stands between turns merged into one block, so that reading back
gives the turns as they were.  Inside texts and roles one backslash is added
after each ``<`` of ``<|``, ``<\\|``, ``<\\\\|`` and so on; removing one restores
the text, and no control string can appear in an escaped text.  Roles escape
backslash and newline, too.

Defined cases: a null text or role is empty; turns with equal numbers follow the
order of role, then text; null turn numbers come first; repeated rows stay;
conversations without id are one conversation with a null id; an empty table
gives an empty result.  Other columns are ignored.  A conversation is one output
row, so its turns meet in one row by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # \\ and \n are undone in one pass: odd runs of backslashes before an n hold the newline
    undone = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(F.replace(undone, F.lit("\\\\"), F.lit("\\")))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: ``formatted`` and its mask ``loss_runs``, for each block
    the lengths in code points of alternating stretches without and with loss (first
    without); flattened, that is the mask of the whole."""
    turn_struct = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                           F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = (turns.select(F.col(conv_id).alias("conv_id"), turn_struct.alias("t"))
               .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    size = F.size("turns")

    def role_at(i: Column) -> Column:
        return F.get(F.col("turns"), i)["role"]

    starts = F.filter(F.sequence(F.lit(0), size - 1),
                      lambda i: (i == 0) | (role_at(i) != role_at(i - 1)))
    merged = grouped.withColumn("starts", starts).withColumn(
        "blocks", F.transform("starts", lambda s, k: F.struct(
            role_at(s).alias("role"),
            F.transform(F.slice(F.col("turns"), s + 1, F.coalesce(F.get(F.col("starts"), k + 1), size) - s),
                        lambda t: escape(t["text"])).alias("texts"))))
    parts = merged.withColumn("parts", F.transform("blocks", lambda b: F.struct(
        F.concat(F.lit(START), escape_role(b["role"]), F.lit("\n")).alias("head"),
        F.array_join(b["texts"], SEP).alias("body"),
        F.lit(END + "\n").alias("tail"), (b["role"] == loss_role).alias("loss"))))
    # with loss: head, text, separator, text, ..., text, end; a zero keeps the alternation
    runs = F.transform(F.arrays_zip("parts", "blocks"), lambda z: F.when(
        z["parts"]["loss"],
        F.concat(F.array(F.char_length(z["parts"]["head"])),
                 F.slice(F.flatten(F.transform(z["blocks"]["texts"],
                                               lambda x: F.array(F.char_length(x), F.lit(len(SEP))))),
                         F.lit(1), 2 * F.size(z["blocks"]["texts"]) - 1),
                 F.array(F.char_length(z["parts"]["tail"]), F.lit(0)))).otherwise(F.array(
                     F.char_length(F.concat(z["parts"]["head"], z["parts"]["body"], z["parts"]["tail"])), F.lit(0))))
    return parts.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.size("turns").cast("long").alias("source_turns"),
        F.size("blocks").cast("long").alias("n_blocks"),
        runs.alias("loss_runs"))


def read_back(formatted: DataFrame, column: str = "formatted") -> DataFrame:
    """Parses ``formatted`` alone: adds ``turns`` (role, text)."""
    chunks = F.split(F.col(column), r"<\|im_start\|>")
    # nothing stands before the first mark
    blocks = F.transform(F.slice(chunks, F.lit(2), F.size(chunks) - 1), lambda c: F.struct(
        unescape_role(F.substring_index(c, "\n", 1)).alias("role"),
        F.split(F.regexp_replace(F.regexp_replace(c, r"\A[^\n]*\n", ""), r"<\|im_end\|>\n\z", ""),
                r"<\|im_sep\|>").alias("texts")))
    with_blocks = formatted.withColumn("_blocks", blocks)
    turns = F.flatten(F.transform("_blocks", lambda b: F.transform(
        b["texts"], lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text")))))
    return with_blocks.withColumn("turns", turns).drop("_blocks")


def under_loss(formatted: DataFrame, column: str = "formatted", runs: str = "loss_runs") -> DataFrame:
    """Adds ``loss_texts``, what the mask alone cuts out of ``formatted``, unescaped.  Each
    block is cut by its own runs, so the cost grows with the text, not with its square."""
    blocks = F.split(F.col(column), r"(?=<\|im_start\|>)")

    def cut(z: Column) -> Column:
        ends = F.aggregate(z["r"], F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        stretches = F.transform(z["r"], lambda n, i: F.struct(n.alias("n"), i.alias("i"), F.get(ends, i).alias("at")))
        # each text has a mark or a separator before it, so the empty last stretch is none
        held = F.filter(stretches, lambda s: (s["i"] % 2 == 1) & (s["i"] < F.size(z["r"]) - 1))
        return F.transform(held, lambda s: unescape(F.substring(z["b"], s["at"] + 1, s["n"])))

    zipped = F.arrays_zip(F.filter(blocks, lambda b: b != "").alias("b"), F.col(runs).alias("r"))
    return formatted.withColumn("loss_texts", F.flatten(F.transform(zipped, cut)))


def digest(formatted: DataFrame) -> DataFrame:
    """The columns of the contract, from the formatted string."""
    back = under_loss(read_back(formatted))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "n_blocks")
