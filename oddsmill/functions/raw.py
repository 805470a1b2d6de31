"""Field access on loosely typed JSON documents held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from oddsmill.functions.scalars import MILLIS_ABOVE, list_items, once, to_bool, seconds_from_text

NUMBERS = ("BIGINT", "DOUBLE", "FLOAT")


def field(doc: Column, key: str) -> Column:
    return F.try_variant_get(doc, f"$.{key}", "variant")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def is_number(v: Column) -> Column:
    return kind(v).isin(*NUMBERS) | kind(v).startswith("DECIMAL")


def pick(doc: Column, *keys: str) -> Column:
    """First of several synonym fields that is neither absent, null nor an empty string."""
    return F.coalesce(*[F.when(text_at(doc, k) != "", field(doc, k)) for k in keys])


def pick_text(doc: Column, *keys: str) -> Column:
    return F.coalesce(*[F.nullif(text_at(doc, k), F.lit("")) for k in keys])


def text_at(doc: Column, key: str) -> Column:
    return F.try_variant_get(doc, f"$.{key}", "string")


def bool_of(v: Column) -> Column:
    return F.when(kind(v) == "STRING", to_bool(text(v))).otherwise(number(v) != 0)


def seconds_of(v: Column) -> Column:
    """Epoch seconds from a number (milliseconds above 10^10) or a timestamp text."""
    whole = number(v).cast("bigint")
    return F.when(kind(v) == "STRING", seconds_from_text(text(v))).otherwise(
        F.when(whole > MILLIS_ABOVE, F.floor(whole / 1000)).otherwise(whole)
    )


def float_of(v: Column) -> Column:
    """A number, or a text that reads as one."""
    return number(v)


def items(v: Column) -> Column:
    """array<variant> if the value is a JSON array, else null."""
    return F.try_variant_get(v, "$", "array<variant>")


def items_at(doc: Column, key: str) -> Column:
    """``items`` of a field, without a copy of the whole list."""
    return F.try_variant_get(doc, f"$.{key}", "array<variant>")


def is_object(v: Column) -> Column:
    # Cheaper than schema_of_variant, which types every nested value, and than a map, which copies every one.
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def strings_of(v: Column) -> Column:
    """array<string> from an array, JSON text, a comma list or a scalar text."""
    none = F.array().cast("array<string>")
    return once(v, lambda x: F.coalesce(F.try_variant_get(x, "$", "array<string>"), F.when(kind(x) == "STRING", list_items(text(x))), none))


# Keys a tag object is named by, in order.
TAG_KEYS = ("label", "name", "slug", "id")


def tags_of(v: Column) -> Column:
    """array<string>: a text becomes one tag, objects give the first of label, name, slug, id; blanks are dropped."""
    none = F.array().cast("array<string>")

    def one(x: Column) -> Column:
        named = F.coalesce(*[F.when(~text(field(x, k)).isin("", "0", "false"), text(field(x, k))) for k in TAG_KEYS])
        return F.when(kind(x) == "STRING", F.trim(text(x))).when(is_object(x), named)

    tags = F.filter(F.transform(items(v), one), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(tags, F.when(kind(v) == "STRING", F.array(text(v))), none)
