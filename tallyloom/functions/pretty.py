"""Indented JSON text in source key order, for values that are no strings.

The raw text is cut into tokens, and one walk over them puts line breaks and
indents between; strings and numbers get the spelling that a parser and printer
would give them (shortest digits, no needless escapes). The least double of all
is spelled 4.9e-324, as the JVM does.
"""

from pyspark.sql import Column, functions as F

from tallyloom.functions.text import as_string, field, is_empty, is_falsy, is_string, strip

TOKEN = r'(?s)"(?:[^"\\]++|\\.)*+"|[\[\]{},:]|[^\s\[\]{},:"]++'


def _number(token: Column) -> Column:
    """A number with a fraction or exponent in its shortest digits, with an exponent below 1e-4 and from 1e16 on."""
    value = token.try_cast("double")
    text = value.cast("string")
    size = F.abs(value)
    plain = F.regexp_replace(value.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    mantissa = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", "")
    exponent = F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0"))
    scientific = F.concat(mantissa, F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")), digits)
    return F.when(~F.contains(text, F.lit("E")), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(scientific)


def _spelled(token: Column) -> Column:
    escaped = token.startswith('"') & (F.contains(token, F.lit("\\u")) | F.contains(token, F.lit("\\/")))
    real = F.rlike(token, F.lit(r"^-?\d+[.eE]"))
    return F.when(escaped, F.to_json(F.try_parse_json(token))).when(real, _number(token)).otherwise(token)


def pretty_json(text: Column) -> Column:
    """JSON text indented by two blanks; null stays null."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit("").alias("before"))

    def walk(acc: Column, token: Column) -> Column:
        opens, closes = token.isin("[", "{"), token.isin("]", "}")
        depth = acc["depth"] - closes.cast("int")
        line = F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth))
        after = acc["before"].isin("[", "{", ",")
        gap = (
            F.when(closes, F.when(acc["before"].isin("[", "{"), F.lit("")).otherwise(line))
            .when(token.isin(",", ":") | ~after, F.lit(""))
            .otherwise(line)
        )
        shown = F.when(token == ":", F.lit(": ")).when(opens | closes | (token == ","), token).otherwise(_spelled(token))
        return F.struct(
            F.concat(acc["out"], gap, shown).alias("out"),
            (depth + opens.cast("int")).alias("depth"),
            F.when(opens | token.isin(",", ":"), token).otherwise(F.lit("")).alias("before"),
        )

    return F.aggregate(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), start, walk, lambda acc: acc["out"])


def choose(record: Column, keys: tuple[str, ...], unwanted=is_empty) -> Column:
    """(key, value) of the first alias that is not empty; null if there is none."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), field(record, k).alias("value")) for k in keys])
    return F.get(F.filter(pairs, lambda p: ~unwanted(p["value"])), F.lit(0))


def raw_field(raw: Column, key: Column) -> Column:
    """JSON text of a field of an object's JSON text, in source order; of a string its value."""
    return F.call_function("get_json_object", raw, F.concat(F.lit("$['"), key, F.lit("']")))


def exact_text(choice: Column, raw: Column) -> Column:
    """Text of a chosen value; what is no string is indented, in the order of the record's JSON text ``raw``."""
    value = choice["value"]
    other = pretty_json(F.when(~is_string(value), raw_field(raw, choice["key"])))
    return F.coalesce(F.when(is_string(value), strip(as_string(value))), other, F.lit(""))


def exact_items(choice: Column, raw: Column) -> tuple[Column, Column]:
    """A chosen list's elements as VARIANT and their JSON texts, side by side; null if it is no list."""
    return F.try_variant_get(choice["value"], "$", "array<variant>"), F.from_json(raw_field(raw, choice["key"]), "array<string>")


def exact_parts(choice: Column, raw: Column, keys: tuple[str, ...], wanted) -> Column:
    """Texts of the first truthy of ``keys`` of those elements of a chosen list that ``wanted`` takes; null if it is no list."""
    elements, raws = exact_items(choice, raw)
    text = lambda m, i: F.get(F.transform(F.array(choose(m, keys, is_falsy)), lambda c: exact_text(c, F.get(raws, i))), F.lit(0))
    return F.filter(F.transform(elements, lambda m, i: F.when(wanted(m), text(m, i)).otherwise(F.lit(""))), lambda t: t != "")
