"""Prompt wording and chat rendering as column expressions."""

from pyspark.sql import Column, functions as F

from tallyloom.functions.fixed_values import (
    ANSWER_RULE,
    CHATML_CLOSE,
    CHATML_OPEN,
    CONTEXT_HEADER,
    EXPERT,
    INSTRUCTION_HEADER,
    SYSTEM_PROMPTS,
)
from tallyloom.functions.text import strip


def system_prompt(domain: str) -> Column:
    return F.lit(SYSTEM_PROMPTS[domain])


def user_prompt(instruction: Column, context: Column, domain: str, variant: str = "export") -> Column:
    """Instruction, optional context block and answer rule.

    The context block depends on ``context`` not being ``""`` before stripping,
    so a blank text still prints its header. Pass an already stripped text (as
    a training run does, whose records are normalised first) to leave it out.
    """
    block = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(CONTEXT_HEADER), strip(context)))
    return F.concat(
        F.lit(INSTRUCTION_HEADER),
        strip(F.coalesce(instruction, F.lit(""))),
        F.coalesce(block, F.lit("")),
        F.lit(ANSWER_RULE.format(expert=EXPERT[domain, variant])),
    )


def message(role: Column | str, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def render_plain(messages: Column) -> Column:
    """``role: content`` lines, the form used when there is no template."""
    return F.array_join(
        F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"], F.lit("\n"))), ""
    )


def render_chatml(messages: Column, generation_prompt: bool = False) -> Column:
    body = F.array_join(
        F.transform(
            messages,
            lambda m: F.concat(
                F.lit(CHATML_OPEN), m["role"], F.lit("\n"), m["content"], F.lit(CHATML_CLOSE + "\n")
            ),
        ),
        "",
    )
    return F.concat(body, F.lit(f"{CHATML_OPEN}assistant\n")) if generation_prompt else body


TEMPLATES = {
    "plain": lambda messages, generation_prompt=False: render_plain(messages),
    "chatml": render_chatml,
}


def render_chat(messages: Column, template: str = "chatml", generation_prompt: bool = False) -> Column:
    return TEMPLATES[template](messages, generation_prompt)
