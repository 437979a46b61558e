"""Keys of queues: building and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.schema import DEFAULT_CHANNEL, DEFAULT_TOPIC


def _or(value: Column, default: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", default).otherwise(value)


def _tag(channel: Column, topic: Column) -> Column:
    return F.concat(F.lit("{"), channel, F.lit(":"), topic, F.lit("}"))


def stream_key(prefix: Column, mood: Column, channel: Column, topic: Column) -> Column:
    """prefix:{channel:topic}:<mood>_stream:stream; empty channels and topics are the defaults."""
    return F.concat_ws(":", prefix, _tag(_or(channel, DEFAULT_CHANNEL), _or(topic, DEFAULT_TOPIC)), F.concat(mood, F.lit("_stream")), F.lit("stream"))


def delay_key(prefix: Column, channel: Column, topic: Column) -> Column:
    return F.concat_ws(":", prefix, _tag(_or(channel, DEFAULT_CHANNEL), _or(topic, DEFAULT_TOPIC)), F.lit("zset"))


def status_key(prefix: Column, channel: Column, topic: Column, message_id: Column) -> Column:
    return F.concat_ws(":", prefix, _tag(channel, topic), F.lit("=-status-="), message_id)


def lock_key(prefix: Column, channel: Column, topic: Column, order_key: Column) -> Column:
    return F.concat_ws(":", prefix, _tag(channel, topic), F.lit("lock"), order_key)


def order_key(prefix: Column, channel: Column, topic: Column, message_id: Column) -> Column:
    return F.concat_ws(":", prefix, _tag(channel, topic), F.lit("order"), message_id)


def dynamic_key(prefix: Column, channel: Column) -> Column:
    return F.concat_ws(":", prefix, _or(channel, DEFAULT_CHANNEL), F.lit("dynamic"))


def log_key(prefix: Column) -> Column:
    return F.concat_ws(":", prefix, F.lit("logic-log"))


def raw_channel_topic(key: Column) -> tuple[Column, Column]:
    """Second and third part of a key with their braces, as they stand."""
    parts = F.split(key, ":", 4)
    return parts[1], parts[2]


def channel_topic(key: Column) -> tuple[Column, Column]:
    """Channel and topic of a stream key, null for keys with fewer than four parts."""
    parts = F.split(key, ":")
    has = F.size(parts) >= 4
    return F.when(has, F.replace(parts[1], F.lit("{"), F.lit(""))), F.when(has, F.replace(parts[2], F.lit("}"), F.lit("")))


def glob_pattern(glob: str) -> str:
    """The regular expression of a key glob: * any run, ? any one character."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c in "_ " else "\\" + c for c in glob) + "$"
