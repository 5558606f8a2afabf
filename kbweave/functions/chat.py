"""Chat rendering of single turns and of message arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Role labels and ChatML marks.
LABELS = (("系统", ("system",)), ("用户", ("user", "human")), ("助手", ("assistant", "bot")))
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
NO_THINK = "/no_think"


def role_label(role: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, roles in LABELS:
        label = F.coalesce(label, F.when(F.lower(role).isin(*roles), F.lit(name)))
    return F.coalesce(label, role)


def labelled_turn(role: Column, content: Column) -> Column:
    return F.concat(role_label(role), F.lit(": "), content, F.lit("\n\n"))


def turn_block(role: Column, content: Column, no_think: Column, unfinished: Column) -> Column:
    """One turn between its marks; the last user turn may get the switch, an unfinished one no end mark."""
    opened = F.concat(F.lit(IM_START), role, F.lit("\n"), content, F.lit("\n"))
    switched = no_think & ~F.contains(content, F.lit(NO_THINK))
    return F.concat(
        opened,
        F.when(switched, "\n" + NO_THINK).otherwise(""),
        F.when(unfinished, "").otherwise(IM_END + "\n"),
    )


def check_modes(add_generation_prompt: bool, continue_final: bool) -> None:
    if add_generation_prompt and continue_final:
        raise ValueError("a generation prompt and a continued final message exclude each other")


def chatml(
    messages: Column,
    add_generation_prompt: bool = False,
    thinking: bool = True,
    continue_final: bool = False,
) -> Column:
    """ChatML of an ``array<struct<role, content>>``."""
    check_modes(add_generation_prompt, continue_final)
    last_user = F.size(messages) - F.array_position(
        F.transform(F.reverse(messages), lambda m: m["role"]), "user"
    )
    has_user = F.exists(messages, lambda m: m["role"] == "user")
    blocks = F.transform(
        messages,
        lambda m, i: turn_block(
            m["role"],
            m["content"],
            F.lit(not thinking) & has_user & (i == last_user),
            F.lit(continue_final) & (i == F.size(messages) - 1) & (m["role"] == "assistant"),
        ),
    )
    opener = IM_START + "assistant\n" if add_generation_prompt else ""
    return F.concat(F.array_join(blocks, ""), F.lit(opener))
