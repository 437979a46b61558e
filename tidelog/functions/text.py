"""Text of servers and pages: parsing and formatting with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of byte units, by powers of 1024.
BYTE_UNITS = ("Bytes", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")


def _last_wins(entries: Column) -> Column:
    """A map of an array of (key, value); of equal keys the last one counts."""
    keys = F.transform(entries, lambda e: e["k"])
    last = F.filter(F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), (F.array_position(F.reverse(keys), e["k"]) == F.size(keys) - i).alias("own"))), lambda e: e["own"])
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def _entries(lines: Column, mark: str, exact: bool) -> Column:
    """The (first, second) parts of lines that have the mark, or exactly one of it."""
    split = F.filter(F.transform(lines, lambda x: F.split(x, mark, -1)), lambda p: F.size(p) == 2 if exact else F.size(p) >= 2)
    return F.transform(split, lambda p: F.struct(p[0].alias("k"), p[1].alias("v")))


def info_map(text: Column) -> Column:
    """Server information as a map: first line passed over, key and the part after its colon, later lines win."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return _last_wins(_entries(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), ":", False))


def strict_info_map(text: Column) -> Column:
    """Server information with CRLF lines as a map; lines count that have exactly one colon."""
    return _last_wins(_entries(F.split(text, "\r\n", -1), ":", True))


def pair_map(text: Column, between: str, mark: str) -> Column:
    """``a=b,c=d`` as a map; parts without the mark are passed over, later ones win."""
    return _last_wins(_entries(F.split(text, between, -1), mark, False))


def object_map(line: Column) -> Column:
    """A debug line of an object as a map; its first words ``Value at`` are the key value_at."""
    return pair_map(F.regexp_replace(line, "^Value at", "value_at"), " ", ":")


def masked(text: Column, head: int = 3, tail: int = 4, most: int = 4) -> Column:
    """Head and tail of a text with at most so many stars between them."""
    middle = F.greatest(F.lit(0), F.least(F.lit(most), F.char_length(text) - head - tail))
    return F.concat(F.left(text, F.lit(head)), F.repeat(F.lit("*"), middle), F.right(text, F.lit(tail)))


def relative_time(seconds: Column, day: Column) -> Column:
    """How long ago: seconds, minutes, hours, days, weeks, and from four weeks on the day itself."""
    text = F.when(seconds < 0, "future time")
    for unit, size, under in (("seconds", 1, 60), ("minutes", 60, 3600), ("hours", 3600, 86400), ("days", 86400, 7 * 86400), ("weeks", 7 * 86400, 28 * 86400)):
        text = text.when(seconds < under, F.concat(F.floor(seconds / size).cast("string"), F.lit(f" {unit} ago")))
    return text.otherwise(day)


def byte_text(size: Column, decimals: int = 2) -> Column:
    """A size in the largest unit of 1024s that it reaches."""
    text = F.when(F.coalesce(size, F.lit(0)) == 0, "0 Bytes")
    for power in range(len(BYTE_UNITS) - 1, 0, -1):
        text = text.when(size >= 1024.0**power, F.concat(F.format_string(f"%.{decimals}f", size / 1024.0**power), F.lit(f" {BYTE_UNITS[power]}")))
    return text.otherwise(F.concat(F.format_string(f"%.{decimals}f", size.cast("double")), F.lit(" Bytes")))


def duration_seconds(text: Column) -> Column:
    """``10s``, ``5m``, ``2h`` in seconds; 10 for what is none of these."""
    n = F.regexp_extract(text, r"^(\d+)[smh]$", 1).try_cast("long")
    unit = F.right(text, F.lit(1))
    return F.coalesce(n * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600), F.lit(10)).cast("long")


def host_ports(hosts: Column, default_port: Column) -> Column:
    """Comma-separated hosts, each with a port."""
    return F.transform(F.split(hosts, ","), lambda h: F.when(F.contains(h, F.lit(":")), h).otherwise(F.concat_ws(":", h, default_port)))


def node_fields(line: Column) -> Column:
    """A line on a cluster node as a struct; null for lines of fewer than three parts."""
    parts = F.split(line, " ", -1)
    names = ("node_id", "ip", "master", "parent_or_skip", "ping", "pong", "flag", "link_state", "slot")
    fields = {n: F.get(parts, F.lit(k)) for k, n in enumerate(names)}
    fields["parent_or_skip"] = F.when(fields["master"] == "slave", fields["parent_or_skip"])
    return F.when(F.size(parts) >= 3, F.struct(*(v.alias("parent_node_id" if n == "parent_or_skip" else n) for n, v in fields.items())))


def fnv1a_bucket(text: Column, buckets: int) -> Column:
    """FNV-1a, 64 bits, of the text's bytes, modulo a number of buckets.

    The product is made in two halves, which wrap as 64-bit numbers do; the last step takes the unsigned remainder.
    """
    step = F.lit(1099511628211)
    spread = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    value = F.aggregate(spread, F.lit(-3750763034362895579), lambda h, b: _wrapping_product(h.bitwiseXOR(F.conv(b, 16, 10).cast("long")), step))
    low, high = value.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(value, 32)
    return (((high % buckets) * (2**32 % buckets) + low % buckets) % buckets).cast("long")


def _wrapping_product(x: Column, y: Column) -> Column:
    """The low 64 bits of a product, without overflow: of a decimal one."""
    whole = x.cast("decimal(20,0)") * y.cast("decimal(15,0)")
    rest = F.pmod(whole, F.lit(2**32).cast("decimal(20,0)"))
    high = F.pmod(F.floor((whole - rest) / F.lit(2**32).cast("decimal(20,0)")), F.lit(2**32).cast("decimal(20,0)")).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(rest.cast("long"))
