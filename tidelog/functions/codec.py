"""Messages as JSON text and as maps of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.schema import MESSAGE

#: Fields that only count as what they are when they come as text.
_LOOSE_TEXT = ("id", "topic", "channel", "orderKey", "payload", "addTime", "moodType")


def encode(message: Column) -> Column:
    return F.to_json(message)


def decode(text: Column) -> Column:
    """A message of JSON text; null where the text is no JSON object of a message."""
    return F.from_json(text, MESSAGE, {"mode": "PERMISSIVE", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX"})


def from_text_map(m: Column) -> Column:
    """A message of a map of text, by casts; what can't be cast is the type's zero, missing text is empty."""

    def text(name: str) -> Column:
        return F.coalesce(F.element_at(m, F.lit(name)), F.lit("")).alias(name)

    def number(name: str, kind: str) -> Column:
        return F.coalesce(F.element_at(m, F.lit(name)).try_cast(kind), F.lit(0).cast(kind)).alias(name)

    fields = [text(n) for n in (*_LOOSE_TEXT, "status", "level", "info")]
    return F.struct(*fields, number("retry", "int"), number("priority", "double"), number("maxLen", "bigint"), number("timeToRun", "bigint"))


def from_any_map(m: Column) -> Column:
    """A message as a consumer sees it: maxLen and executeTime come as text there, and so don't count."""
    whole = from_text_map(m)
    return F.struct(*(whole[n].alias(n) for n in (*_LOOSE_TEXT, "retry", "priority", "timeToRun")), F.lit(0).cast("bigint").alias("maxLen"))
