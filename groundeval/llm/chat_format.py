"""Chat formatting with Spark expressions only.

Template.  A conversation is ``<s>`` + its blocks + ``</s>``.  A block is a run of adjacent
turns of one role: ``[ROLE]`` role ``[/ROLE]`` + its texts joined by ``[TURN]`` +
``[/INST]`` after a role that is not trained on, ``[EOS]`` after one that is.  Inside roles
and texts the three characters that start control strings or escapes are written as
``\\\\`` -> ``\\\\e``, ``<`` -> ``\\\\l``, ``[`` -> ``\\\\b``; so ``<`` and ``[`` occur in the output
only where the template put them, and replacing the three codes backwards (``\\\\e`` last)
restores every text exactly.

The loss mask is a list of segments ``(text, loss)`` whose concatenation is the output: a
segment under the mask is one escaped text of a trained role, everything else is outside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, EOS, ROLE, ROLE_END, TURN, BLOCK_END = "<s>", "</s>", "[ROLE]", "[/ROLE]", "[TURN]", "[/INST]"
LOSS_END = "[EOS]"
ESCAPES = [("\\", "\\e"), ("<", "\\l"), ("[", "\\b")]


def escape(c: Column) -> Column:
    for raw, code in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def format_chats(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: ``(<conv_col>, formatted, segments)``.

    Rows are ordered by turn, then role, then text (ties and repeated rows stay, in that
    order; a null turn comes first).  A null text or role counts as empty; rows with a null
    conversation form one conversation.  An empty table gives an empty result, other columns
    are not read.  Neighbouring turns of one role share a block.  A conversation is one
    output row, so its turns do meet in one row; nothing larger is collected.
    """
    flat = turns.select(
        F.col(conv_col).alias("conv"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = flat.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # adjacent turns of one role: the positions where a role begins cut the list into blocks
    index = F.sequence(F.lit(1), F.size("turns"))
    begins = F.filter(index, lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    convs = convs.withColumn("begins", begins)
    after = F.concat(F.slice("begins", 2, F.greatest(F.size("begins") - 1, F.lit(0))), F.array(F.size("turns") + 1))
    convs = convs.withColumn("ends", after)
    blocks = F.zip_with(
        "begins",
        "ends",
        lambda b, e: F.struct(
            F.element_at("turns", b)["role"].alias("role"),
            F.transform(F.slice("turns", b, e - b), lambda t: escape(t["text"])).alias("texts"),
        ),
    )
    convs = convs.withColumn("blocks", blocks)

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def block_segments(b: Column) -> Column:
        loss = b["role"].isin(*loss_roles)
        texts = F.transform(
            b["texts"],
            lambda t, i: F.array(
                segment(F.when(i > 0, F.lit(TURN)).otherwise(F.concat(F.lit(ROLE), escape(b["role"]), F.lit(ROLE_END))), F.lit(False)),
                segment(t, loss),
            ),
        )
        end = F.array(segment(F.when(loss, F.lit(LOSS_END)).otherwise(F.lit(BLOCK_END)), F.lit(False)))
        return F.concat(F.flatten(texts), end)

    edge = lambda s: F.array(segment(F.lit(s), F.lit(False)))
    segments = F.concat(edge(BOS), F.flatten(F.transform("blocks", block_segments)), edge(EOS))
    return convs.select(F.col("conv").alias(conv_col), segments.alias("segments")).select(
        conv_col, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments"
    )


def parse_chat(formatted: Column) -> Column:
    """Back from the output: ``array<struct<role, text>>``, one per original turn."""
    inner = F.substring(formatted, F.lit(len(BOS) + 1), F.length(formatted) - len(BOS) - len(EOS))
    blocks = F.split(inner, r"\[/INST\]|\[EOS\]")
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)  # what follows the last block's end is empty

    def turns(block: Column) -> Column:
        role = F.substring_index(F.substring(block, len(ROLE) + 1, 1 << 30), ROLE_END, 1)
        body = F.substring(block, F.length(role) + (len(ROLE) + len(ROLE_END) + 1), F.lit(1 << 30))
        return F.transform(F.split(body, r"\[TURN\]"), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_back(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digest columns per conversation, all computed from ``formatted`` and ``segments``."""
    df = chats.withColumn("turns", parse_chat(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    df = df.select(conv_col, "turns", said.alias("said"), masked.alias("masked"), "formatted")
    return df.select(
        conv_col,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("masked").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
