"""Chat rendering over a long table with one row per turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbweave.functions.chat import IM_START, check_modes, labelled_turn, turn_block
from kbweave.functions.text import trim_blank
from kbweave.operators.ordered_text import PART_POSITIONS, assemble

def chat_text_parts(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    min_size: int = 10,
    positions: int = PART_POSITIONS,
) -> DataFrame:
    """``conv_id, part, text`` of every conversation whose text reaches the minimum size.

    The size is that of the whole text before trimming. Only the last part can
    end in blanks, since every turn starts with its label.
    """
    lines = turns.select(
        conv_id, turn, labelled_turn(F.col(role), F.coalesce(F.col(text), F.lit(""))).alias("_line")
    )
    whole = lines.groupBy(conv_id).agg(
        F.sum(F.length("_line")).alias("_size"),
        F.floor(F.max(turn) / positions).cast("long").alias("_last"),
    )
    parts = assemble(lines, [conv_id], turn, "_line", "text", positions)
    trimmed = F.when(F.col("part") == F.col("_last"), trim_blank(F.col("text"))).otherwise(F.col("text"))
    return (
        parts.join(whole.where(F.col("_size") >= min_size), conv_id)
        .select(conv_id, "part", trimmed.alias("text"))
    )


def chatml_parts(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    add_generation_prompt: bool = False,
    thinking: bool = True,
    continue_final: bool = False,
    positions: int = PART_POSITIONS,
) -> DataFrame:
    """``conv_id, part, text``: ChatML of a long table with one row per turn.

    The last turns come from a partially aggregated maximum that is joined
    back, instead of a window that would sort a whole conversation in one task.
    """
    check_modes(add_generation_prompt, continue_final)
    bounds = turns.groupBy(conv_id).agg(
        F.max(turn).alias("_last"), F.max(F.when(F.col(role) == "user", F.col(turn))).alias("_last_user")
    )
    marked = turns.join(bounds, conv_id)
    is_last = F.col(turn) == F.col("_last")
    block = turn_block(
        F.col(role),
        F.coalesce(F.col(text), F.lit("")),
        F.lit(not thinking) & F.coalesce(F.col(turn) == F.col("_last_user"), F.lit(False)),
        F.lit(continue_final) & is_last & (F.col(role) == "assistant"),
    )
    opener = F.when(F.lit(add_generation_prompt) & is_last, IM_START + "assistant\n").otherwise("")
    lines = marked.select(conv_id, turn, F.concat(block, opener).alias("_line"))
    return assemble(lines, [conv_id], turn, "_line", "text", positions)


def question_answer_pairs(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Each user turn with the assistant turn right after it, as an instruction item.

    The join key is (conversation, turn), which is unique, so one long
    conversation is spread over all tasks.
    """
    asked = turns.where(F.col(role) == "user").select(
        conv_id, (F.col(turn) + 1).alias(turn), F.col(text).alias("instruction")
    )
    answered = turns.where(F.col(role) == "assistant").select(conv_id, turn, F.col(text).alias("output"))
    return asked.join(answered, [conv_id, turn])
