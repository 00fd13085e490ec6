"""Chat prompts as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the prompt texts and the completion format ---
SYSTEM_TEXT = (
    "You are a helpful assistant. You first think about the reasoning process in the mind "
    "and then provide the user with the answer."
)
USER_TEXT = (
    "Using the numbers %s, create an equation that equals %s. You can use basic arithmetic "
    "operations (+, -, *, /) and each number can only be used once. Show your work in "
    "<think> </think> tags. And return the final equation and answer in <answer> </answer> "
    "tags, for example <answer> (1 + 2) / 3 = 1 </answer>."
)
COMPLETION_TEXT = "<answer> %s </answer>"
# --- end of fixed values ---


@dataclass(frozen=True)
class ChatTemplate:
    """How a list of messages becomes one string.

    ``turn_start`` and ``turn_end`` surround a turn, ``role_end`` stands between
    role and text, ``answer_start`` opens the turn the model is to write.
    ``no_thinking`` is added to it when thinking is switched off. ``roles`` pairs
    role names with what the template calls them. With ``fold_system`` system
    texts have no turn; they open the first user turn, ``system_end`` behind each.
    """

    start: str = ""
    turn_start: str = "<|im_start|>"
    role_end: str = "\n"
    turn_end: str = "<|im_end|>\n"
    answer_start: str = "<|im_start|>assistant\n"
    no_thinking: str = "<think>\n\n</think>\n\n"
    roles: tuple[tuple[str, str], ...] = ()
    fold_system: bool = False
    system_end: str = "\n\n"


# A template without system turns, in which the assistant is called the model.
FOLDED = ChatTemplate(
    start="<bos>",
    turn_start="<start_of_turn>",
    turn_end="<end_of_turn>\n",
    answer_start="<start_of_turn>model\n",
    no_thinking="",
    roles=(("assistant", "model"),),
    fold_system=True,
)


def message(content: Column, role: str | Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(content.alias("content"), role.alias("role"))


def puzzle_messages(nums: Column, target: Column) -> Column:
    """The two-message prompt; the numbers print as ``[75, 80]``."""
    user = F.format_string(USER_TEXT, nums.cast("string"), target.cast("string"))
    return F.array(message(F.lit(SYSTEM_TEXT), "system"), message(user, "user"))


def build_prompt(df: DataFrame) -> Column:
    """The row's own ``prompt`` where the table has one, else the built prompt."""
    built = puzzle_messages(F.col("nums"), F.col("target"))
    return F.coalesce(F.col("prompt"), built) if "prompt" in df.columns else built


def render_chat(
    messages: Column,
    template: ChatTemplate = ChatTemplate(),
    add_generation_prompt: bool = True,
    enable_thinking: bool = True,
) -> Column:
    """One string for a list of messages. Where system texts fold but no user turn follows, they are left out."""
    if template.fold_system:
        messages = _folded(messages, template.system_end)

    def name(role: Column) -> Column:
        for own, called in template.roles:
            role = F.when(role == own, called).otherwise(role)
        return role

    turns = F.transform(
        messages,
        lambda m: F.concat(
            F.lit(template.turn_start),
            name(m["role"]),
            F.lit(template.role_end),
            m["content"],
            F.lit(template.turn_end),
        ),
    )
    tail = template.answer_start if add_generation_prompt else ""
    if add_generation_prompt and not enable_thinking:
        tail += template.no_thinking
    return F.concat(F.lit(template.start), F.array_join(turns, ""), F.lit(tail))


def _folded(messages: Column, end: str) -> Column:
    """Messages without system turns; their texts open the first user turn."""
    system = F.filter(messages, lambda m: m["role"] == "system")
    opening = F.array_join(F.transform(system, lambda m: F.concat(m["content"], F.lit(end))), "")
    rest = F.filter(messages, lambda m: m["role"] != "system")
    first_user = F.array_position(F.transform(rest, lambda m: m["role"]), "user") - 1
    return F.transform(
        rest,
        lambda m, i: message(F.when(i == first_user, F.concat(opening, m["content"])).otherwise(m["content"]), m["role"]),
    )


def conversations(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """``key, messages``: the turns of each conversation in order, from columns ``role`` and ``text``."""
    placed = F.struct(F.col(order), F.col("text").alias("content"), "role")
    listed = turns.groupBy(key).agg(F.array_sort(F.collect_list(placed)).alias("placed"))
    return listed.select(key, F.transform("placed", lambda m: message(m["content"], m["role"])).alias("messages"))


def completion(equation_norm: Column) -> Column:
    return F.format_string(COMPLETION_TEXT, equation_norm)


def with_eos(text: Column, eos: str) -> Column:
    """Append the end-of-sequence text unless the text already ends with it."""
    if not eos:
        return text
    return F.when(text.endswith(eos), text).otherwise(F.concat(text, F.lit(eos)))
