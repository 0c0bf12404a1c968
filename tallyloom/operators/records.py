"""Heterogeneous instruction and chat records brought into fixed schemas."""

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.fixed_values import (
    ASSISTANT_ROLES,
    CALIBRATION_ERROR,
    CONTENT_KEYS,
    INPUT_KEYS,
    INSTRUCTION_KEYS,
    MESSAGE_KEYS,
    OUTPUT_KEYS,
    PART_SEPARATOR,
    ROLE_KEYS,
    USER_ROLES,
)
from tallyloom.functions.pretty import choose, exact_parts, exact_text
from tallyloom.functions.templates import message, system_prompt, user_prompt
from tallyloom.functions.text import (
    as_string,
    field,
    first_filled,
    first_truthy,
    is_empty,
    is_falsy,
    is_string,
    strip,
    to_text,
)
from tallyloom.operators.turns import ordered_join

MESSAGES = "array<struct<role:string,content:string>>"


# --- chat pairs --------------------------------------------------------------


def chat_parts(messages: Column, roles: tuple[str, ...]) -> Column:
    """Texts of the given roles in one VARIANT message list, joined by a blank line.

    Anything but a list gives ``""``; elements that are no objects are skipped.
    """
    elements = F.try_variant_get(messages, "$", "array<variant>")
    content = lambda m: to_text(first_truthy(m, CONTENT_KEYS))
    texts = F.transform(F.filter(elements, _spoken_by(roles)), content)
    return F.coalesce(F.array_join(F.filter(texts, lambda t: t != ""), PART_SEPARATOR), F.lit(""))


def _spoken_by(roles: tuple[str, ...]):
    return lambda m: F.lower(F.coalesce(as_string(first_truthy(m, ROLE_KEYS)), F.lit(""))).isin(*roles)


def exact_chat_parts(record: Column, raw: Column, roles: tuple[str, ...]) -> Column:
    """The same from a record and its JSON text; contents that are no strings are indented in the order written."""
    parts = lambda c: exact_parts(c, raw, CONTENT_KEYS, _spoken_by(roles))
    texts = F.get(F.transform(F.array(choose(record, MESSAGE_KEYS)), parts), F.lit(0))
    return F.coalesce(F.array_join(texts, PART_SEPARATOR), F.lit(""))


def chat_pairs(
    turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(instruction, output) per conversation from turn rows."""
    speaker = F.lower(F.col(role))
    said = strip(F.col(text))
    return ordered_join(
        turns,
        [key],
        order,
        {
            "instruction": (F.when(speaker.isin(*USER_ROLES), said), PART_SEPARATOR),
            "output": (F.when(speaker.isin(*ASSISTANT_ROLES), said), PART_SEPARATOR),
        },
    )


# --- normalised records ------------------------------------------------------


def resolve_alias(record: Column, keys: tuple[str, ...]) -> Column:
    """Text of the first non-empty alias; a blank text is not empty and still wins."""
    return to_text(first_filled(record, keys))


def normalize(
    df: DataFrame,
    record: str = "record",
    source: str = "source_file",
    keep: tuple[str, ...] = (),
    raw: str | None = None,
) -> DataFrame:
    """(instruction, input, output, source_file), four texts, never null.

    Instruction and output fall back to the chat list when their field is
    missing or falsy; input has no fallback. Values that are no strings become
    JSON text: compact with sorted keys, or, given the column ``raw`` with the
    record's own JSON text, indented in the order written, also inside chat lists.
    """
    rec = F.col(record)
    if raw:
        return _normalize_exact(df, rec, raw, source, keep)
    messages = first_filled(rec, MESSAGE_KEYS)

    def with_fallback(keys, roles):
        # A one-element list names the chosen value, so that it is looked up once.
        text = lambda v: F.when(is_falsy(v), chat_parts(messages, roles)).otherwise(to_text(v))
        return F.get(F.transform(F.array(first_filled(rec, keys)), text), F.lit(0))

    return df.select(
        *keep,
        with_fallback(INSTRUCTION_KEYS, USER_ROLES).alias("instruction"),
        resolve_alias(rec, INPUT_KEYS).alias("input"),
        with_fallback(OUTPUT_KEYS, ASSISTANT_ROLES).alias("output"),
        F.col(source).alias("source_file"),
    )


def _normalize_exact(df: DataFrame, rec: Column, raw: str, source: str, keep: tuple[str, ...]) -> DataFrame:
    fields = {"instruction": INSTRUCTION_KEYS, "input": INPUT_KEYS, "output": OUTPUT_KEYS}
    roles = {"instruction": USER_ROLES, "output": ASSISTANT_ROLES}
    chosen = df.select(
        *keep,
        source,
        raw,
        rec.alias("__record"),
        *[choose(rec, keys).alias(f"__{name}") for name, keys in fields.items()],
    )

    def text(name):
        own = exact_text(F.col(f"__{name}"), F.col(raw))
        if name not in roles:
            return own
        return F.when(is_falsy(F.col(f"__{name}.value")), exact_chat_parts(F.col("__record"), F.col(raw), roles[name])).otherwise(own)

    return chosen.select(*keep, *[text(name).alias(name) for name in fields], F.col(source).alias("source_file"))


# --- export formats ----------------------------------------------------------


def to_alpaca(df: DataFrame, record: str = "record", keep: tuple[str, ...] = (), raw: str | None = None) -> DataFrame:
    """(instruction, input, output) from the three canonical keys only; ``raw`` as in ``normalize``."""
    rec = F.col(record)

    def text(key: str) -> Column:
        value = field(rec, key)
        return exact_text(F.struct(F.lit(key).alias("key"), value.alias("value")), F.col(raw)) if raw else to_text(value)

    return df.select(
        *keep,
        text("instruction").alias("instruction"),
        F.when(is_empty(field(rec, "input")), F.lit("")).otherwise(text("input")).alias("input"),
        text("output").alias("output"),
    )


def as_string_only(value: Column) -> Column:
    """A string value as it stands, not stripped; null for any other."""
    return F.when(is_string(value), as_string(value))


def to_sharegpt(df: DataFrame, domain: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One ``conversations`` list (system, human, gpt) from (instruction, input, output) texts."""

    def said(who: str, value: Column) -> Column:
        return F.struct(F.lit(who).alias("from"), value.alias("value"))

    return df.select(
        *keep,
        F.array(
            said("system", system_prompt(domain)),
            said("human", user_prompt(F.col("instruction"), F.col("input"), domain, "export")),
            said("gpt", strip(F.coalesce(F.col("output"), F.lit("")))),
        ).alias("conversations"),
    )


def build_messages(
    domain: str,
    include_answer: bool = True,
    multimodal: bool = False,
    instruction: str = "instruction",
    context: str = "input",
    output: str = "output",
) -> Column:
    """Training messages (system, user and, if wanted, assistant) of one record."""
    wrap = as_parts if multimodal else (lambda text: text)
    items = [
        message("system", wrap(system_prompt(domain))),
        message("user", wrap(user_prompt(F.col(instruction), F.col(context), domain, "train"))),
    ]
    if include_answer:
        items.append(message("assistant", wrap(strip(F.coalesce(F.col(output), F.lit(""))))))
    return F.array(*items)


def as_parts(text: Column) -> Column:
    """Multimodal content: a list with one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))


# --- calibration records -----------------------------------------------------


def map_role(role: Column) -> Column:
    """human and user are the user; everybody else, system included, is the assistant."""
    return F.when(role.isin(*USER_ROLES), F.lit("user")).otherwise(F.lit("assistant"))


def _message_list(value: Column, role_key: str, content_key: str, role=lambda c: c) -> Column:
    elements = F.try_variant_get(value, "$", "array<variant>")
    no_list = F.raise_error(F.concat(F.lit(f"{CALIBRATION_ERROR}: "), F.to_json(value))).cast("array<variant>")
    return F.transform(
        F.when(elements.isNull(), no_list).otherwise(elements),
        lambda m: message(role(as_string(field(m, role_key))), as_string(field(m, content_key))),
    )


def calibration_messages(record: Column) -> Column:
    """Messages of a calibration record, chosen by which keys are present.

    Null for a plain ``text`` record. A record with none of the known keys, or
    without a list where one belongs, raises an error.
    """
    has = lambda key: field(record, key).isNotNull()
    answer = F.coalesce(
        F.when(has("output"), as_string(field(record, "output"))),
        F.when(~has("output") & has("response"), as_string(field(record, "response"))),
        F.lit(""),
    )
    return (
        F.when(
            has("input") & has("output"),
            F.concat(
                _message_list(field(record, "input"), "role", "content"),
                F.array(message("assistant", as_string(field(record, "output")))),
            ),
        )
        .when(has("messages"), _message_list(field(record, "messages"), "role", "content"))
        .when(has("conversations"), _message_list(field(record, "conversations"), "from", "value", map_role))
        .when(
            has("instruction"),
            F.array(
                message("user", as_string(field(record, "instruction"))),
                message("assistant", answer),
            ),
        )
        .when(has("text"), F.lit(None).cast(MESSAGES))
        .otherwise(
            F.raise_error(F.concat(F.lit(f"{CALIBRATION_ERROR}: "), F.to_json(record))).cast(MESSAGES)
        )
    )


def calibration_text(record: Column, render) -> Column:
    """Rendered messages, or the ``text`` field passed through."""
    messages = calibration_messages(record)
    return F.when(messages.isNotNull(), render(messages)).otherwise(as_string(field(record, "text")))
