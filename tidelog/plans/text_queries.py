"""Queries of scalar functions, each over text that is made of the message log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import codec, keys, text
from tidelog.operators.admin import EMAIL
from tidelog.plans.registry import query
from tidelog.sources.views import MSG_SQL, TIME_FORMAT, messages

_KEY_SQL = "'q:{' || channel || ':' || topic || '}:' || moodType || '_stream:stream'"


def _stream_keys(spark, sf_dir):
    key = keys.stream_key(F.lit("q"), F.col("moodType"), F.col("channel"), F.col("topic"))
    return messages(spark, sf_dir).select("seq", key.alias("key"))


@query(
    f"""with {MSG_SQL} select seq, {_KEY_SQL} stream_key, 'q:{{' || channel || ':' || topic || '}}:zset' delay_key, 'q:{{' || channel || ':' || topic || '}}:=-status-=:' || id status_key,
    'q:{{' || channel || ':' || topic || '}}:order:' || id order_key, 'q:' || channel || ':dynamic' dynamic_key, 'q:logic-log' log_key from msg"""
)
def key_build(spark, sf_dir):
    p, c, t, i = F.lit("q"), F.col("channel"), F.col("topic"), F.col("id")
    return messages(spark, sf_dir).select(
        "seq",
        keys.stream_key(p, F.col("moodType"), c, t).alias("stream_key"),
        keys.delay_key(p, c, t).alias("delay_key"),
        keys.status_key(p, c, t, i).alias("status_key"),
        keys.order_key(p, c, t, i).alias("order_key"),
        keys.dynamic_key(p, c).alias("dynamic_key"),
        keys.log_key(p).alias("log_key"),
    )


@query(f"with {MSG_SQL} select seq, '{{' || channel raw_channel, topic || '}}' raw_topic, channel, topic from msg")
def key_parse(spark, sf_dir):
    raw_channel, raw_topic = keys.raw_channel_topic(F.col("key"))
    channel, topic = keys.channel_topic(F.col("key"))
    return _stream_keys(spark, sf_dir).select("seq", raw_channel.alias("raw_channel"), raw_topic.alias("raw_topic"), channel.alias("channel"), topic.alias("topic"))


@query(f"with {MSG_SQL} select seq, {_KEY_SQL} as key from msg where {_KEY_SQL} similar to 'q:\\{{ch1:.*\\}}:delay_.*'")
def key_scan(spark, sf_dir):
    return _stream_keys(spark, sf_dir).filter(F.col("key").rlike(keys.glob_pattern("q:{ch1:*}:delay_*")))


@query(f"with {MSG_SQL} select seq, {_KEY_SQL} as key from msg where {_KEY_SQL} <> 'q:{{ch1:view}}:normal_stream:stream'")
def delete_by_key(spark, sf_dir):
    return _stream_keys(spark, sf_dir).filter("key <> 'q:{ch1:view}:normal_stream:stream'")


def _info(line_end):
    lines = ("# Memory", F.concat(F.lit("used_memory:"), "priority"), "a:b:c", F.concat(F.lit("host:"), "hostName"), "no colon", F.concat(F.lit("host:"), "topic"))
    return F.concat_ws(line_end, *(F.lit(x) if isinstance(x, str) else x for x in lines))


@query(f"with {MSG_SQL} select seq, cast(priority as varchar) used_memory, 'b' a, topic host, 3 as n from msg")
def info_parse(spark, sf_dir):
    rows = messages(spark, sf_dir).select("seq", text.info_map(_info("\n")).alias("m"))
    return rows.select("seq", "m.used_memory", "m.a", "m.host", F.size("m").alias("n"))


@query(f"with {MSG_SQL} select seq, cast(priority as varchar) used_memory, cast(null as varchar) a, topic host, 2 as n from msg")
def info_parse_strict(spark, sf_dir):
    rows = messages(spark, sf_dir).select("seq", text.strict_info_map(_info("\r\n")).alias("m"))
    return rows.select("seq", "m.used_memory", "m.a", "m.host", F.size("m").alias("n"))


@query(f"with {MSG_SQL} select seq, 'db0' dbname, cast(seq as varchar) keys, cast(priority as varchar) expires, '0' avg_ttl from msg")
def keyspace_parse(spark, sf_dir):
    info = F.concat(F.lit("# Keyspace\ndb0:keys="), "seq", F.lit(",expires="), "priority", F.lit(",avg_ttl=0"))
    spaces = messages(spark, sf_dir).select("seq", F.explode(text.info_map(info)).alias("dbname", "v")).withColumn("m", text.pair_map(F.col("v"), ",", "="))
    return spaces.select("seq", "dbname", "m.keys", "m.expires", "m.avg_ttl")


@query(f"with {MSG_SQL}, s as (select topic, count(*) calls, sum(priority) usec from msg group by topic) select topic as command, calls, cast(round(usec / calls, 2) as double) as usec_per_call from s order by 3 desc")
def command_stats(spark, sf_dir):
    """Lines on commands, parsed and ranked by their time a call."""
    stats = messages(spark, sf_dir).groupBy("topic").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("priority") / F.count(F.lit(1)), 2).alias("each"))
    line = F.concat(F.lit("# Commandstats\r\ncmdstat_"), "topic", F.lit(":calls="), "calls", F.lit(",usec_per_call="), "each")
    parsed = stats.select(F.explode(text.info_map(line)).alias("name", "v")).withColumn("m", text.pair_map(F.col("v"), ",", "="))
    ranked = parsed.select(F.replace("name", F.lit("cmdstat_"), F.lit("")).alias("command"), F.col("m.calls").cast("long").alias("calls"), F.col("m.usec_per_call").cast("double").alias("usec_per_call"))
    return ranked.orderBy(F.desc("usec_per_call"))


@query(f"with {MSG_SQL} select seq, cast(seq as varchar) id, hostName as addr, case when priority = 0 then null else cast(priority as varchar) end age from msg")
def client_list(spark, sf_dir):
    """One row a client line; an age of 0 is left out."""
    line = F.concat(F.lit("id="), "seq", F.lit(" addr="), "hostName", F.lit(" age="), "priority", F.lit(" flag"))
    rows = messages(spark, sf_dir).select("seq", text.pair_map(line, " ", "=").alias("m"))
    return rows.select("seq", "m.id", "m.addr", F.when(F.col("m.age") != "0", F.col("m.age")).alias("age"))


@query(f"with {MSG_SQL} select seq, '0x7f' value_at, 1 refcount, topic as encoding, priority as serializedlength, seq as lru, 3 as lru_seconds_idle from msg")
def object_parse(spark, sf_dir):
    line = F.concat(F.lit("Value at:0x7f refcount:1 encoding:"), "topic", F.lit(" serializedlength:"), "priority", F.lit(" lru:"), "seq", F.lit(" lru_seconds_idle:3"))
    rows = messages(spark, sf_dir).select("seq", text.object_map(line).alias("m"))
    ints = [F.element_at("m", n).cast("int").alias(n) for n in ("refcount", "serializedlength", "lru_seconds_idle")]
    return rows.select("seq", "m.value_at", "m.encoding", F.element_at("m", "lru").cast("long").alias("lru"), *ints)


@query(
    f"""with {MSG_SQL} select seq, cast(seq as varchar) node_id, hostName || ':6379' ip, case when seq % 2 = 0 then 'slave' else 'master' end master,
    case when seq % 2 = 0 then 'parent' end parent_node_id, '0' ping, cast(priority as varchar) pong, '7' flag, 'connected' link_state, case when seq % 2 = 1 then '0-100' end slot from msg"""
)
def node_parse(spark, sf_dir):
    slave = F.col("seq") % 2 == 0
    line = F.concat_ws(" ", F.col("seq").cast("string"), F.concat("hostName", F.lit(":6379")), F.when(slave, "slave").otherwise("master"), F.when(slave, "parent").otherwise("-"), F.lit("0"), F.col("priority").cast("string"), F.lit("7"), F.lit("connected"), F.when(~slave, "0-100"))
    return messages(spark, sf_dir).select("seq", text.node_fields(line).alias("n")).select("seq", "n.*")


@query(f"with {MSG_SQL} select seq, hostName || ':6379,other:1' as hosts from msg")
def host_port(spark, sf_dir):
    hosts = text.host_ports(F.concat("hostName", F.lit(",other:1")), F.lit("6379"))
    return messages(spark, sf_dir).select("seq", F.array_join(hosts, ",").alias("hosts"))


@query(f"with {MSG_SQL} select seq, left(addTime, 3) || '****' || right(addTime, 4) long_text, left(topic, 3) || repeat('*', greatest(0, least(4, len(topic) - 7))) || right(topic, 4) short_text from msg")
def mask_string(spark, sf_dir):
    return messages(spark, sf_dir).select("seq", text.masked(F.col("addTime")).alias("long_text"), text.masked(F.col("topic")).alias("short_text"))


@query(
    f"""with {MSG_SQL}, t as (select seq, 1705276800 - us // 1000000 s, left(addTime, 10) d from msg)
    select seq, case when s < 0 then 'future time' when s < 60 then s || ' seconds ago' when s < 3600 then s // 60 || ' minutes ago' when s < 86400 then s // 3600 || ' hours ago'
    when s < 604800 then s // 86400 || ' days ago' when s < 2419200 then s // 604800 || ' weeks ago' else d end as age from t"""
)
def relative_time(spark, sf_dir):
    seconds = F.lit(1_705_276_800) - F.expr("us div 1000000")
    return messages(spark, sf_dir).select("seq", text.relative_time(seconds, F.left("addTime", F.lit(10))).alias("age"))


_BYTE_STEPS = "".join(f" when b >= {1024**k} then printf('%.2f', floor(b / {1024**k}.0 * 100 + 0.5) / 100) || ' {unit}'" for k, unit in reversed(list(enumerate(("KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB"), 1))))


@query(f"with {MSG_SQL}, t as (select seq, cast(seq as hugeint) * seq * priority b from msg) select seq, case when b = 0 then '0 Bytes'{_BYTE_STEPS} else printf('%.2f', b::double) || ' Bytes' end as size from t")
def byte_format(spark, sf_dir):
    """Sizes of all messages; a decimal, as a bigint product overflows from ids of 3.1e8 on."""
    seq = F.col("seq").cast("decimal(19,0)")
    rows = messages(spark, sf_dir).select("seq", (seq * seq * F.col("priority")).alias("b"))
    return rows.select("seq", text.byte_text(F.col("b")).alias("size"))


@query(f"with {MSG_SQL} select seq, printf('%.2f', (seq * 1000000000 // 1073741824)::double) total_gb, printf('%.2f', (seq * 3000000 // 1048576)::double) used_mb from msg")
def host_units(spark, sf_dir):
    """Bytes in whole GB and MB, written with two decimals."""
    total, used = F.expr("seq * 1000000000 div 1073741824"), F.expr("seq * 3000000 div 1048576")
    return messages(spark, sf_dir).select("seq", F.format_string("%.2f", total.cast("double")).alias("total_gb"), F.format_string("%.2f", used.cast("double")).alias("used_mb"))


@query(f"with {MSG_SQL} select seq, case seq % 4 when 0 then priority when 1 then priority * 60 when 2 then priority * 3600 else 10 end as seconds from msg")
def duration_parse(spark, sf_dir):
    unit = F.element_at(F.array(F.lit("s"), F.lit("m"), F.lit("h"), F.lit("?")), (F.col("seq") % 4 + 1).cast("int"))
    return messages(spark, sf_dir).select("seq", text.duration_seconds(F.concat(F.col("priority").cast("string"), unit)).alias("seconds"))


@query(f"with {MSG_SQL} select seq, addTime as at from msg")
def datetime_text(spark, sf_dir):
    return messages(spark, sf_dir).select("seq", F.date_format(F.timestamp_micros("us"), TIME_FORMAT).alias("at"))


@query(f"with {MSG_SQL} select seq, case when seq % 9 <> 0 then priority end as priority, seq % 9 <> 0 as whole from msg")
def json_decode(spark, sf_dir):
    member = F.when(F.col("seq") % 9 == 0, "{broken").otherwise(F.to_json(F.struct("id", "topic", F.col("priority").cast("double").alias("priority"))))
    rows = messages(spark, sf_dir).select("seq", codec.decode(member).alias("m"))
    return rows.select("seq", F.col("m.priority").cast("int").alias("priority"), F.col("m.id").isNotNull().alias("whole"))


@query(f"""with {MSG_SQL} select seq, '{{"id":"' || id || '","topic":"' || topic || '","priority":' || priority || '}}' as member from msg""")
def json_encode(spark, sf_dir):
    return messages(spark, sf_dir).select("seq", codec.encode(F.struct("id", "topic", "priority")).alias("member"))


def _text_map():
    retry = F.when(F.col("seq") % 5 == 0, "many").otherwise((F.col("seq") % 5).cast("string"))
    fields = {"id": F.col("id"), "topic": F.col("topic"), "retry": retry, "priority": F.col("priority").cast("string"), "maxLen": F.lit("50"), "payload": F.col("payload")}
    return F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v)))


_DECODED_SQL = f"with {MSG_SQL} select seq, id, topic, '' channel, cast(seq % 5 as int) retry, priority::double priority, {{most}} maxLen, payload from msg"


def _decoded(rows):
    return rows.select("seq", *(f"m.{n}" for n in ("id", "topic", "channel", "retry", "priority", "maxLen", "payload")))


@query(_DECODED_SQL.format(most="0::bigint"))
def message_decode_any(spark, sf_dir):
    return _decoded(messages(spark, sf_dir).select("seq", codec.from_any_map(_text_map()).alias("m")))


@query(_DECODED_SQL.format(most="50::bigint"))
def message_decode_str(spark, sf_dir):
    return _decoded(messages(spark, sf_dir).select("seq", codec.from_text_map(_text_map()).alias("m")))


@query(f"with {MSG_SQL}, e as (select seq, case seq % 3 when 0 then id || '@' || topic || '.org' when 1 then id || '@' || topic else id || ' x@' || topic || '.org' end email from msg) select seq, email, regexp_matches(email, '{EMAIL}') as valid from e")
def email_valid(spark, sf_dir):
    third = F.col("seq") % 3
    email = F.when(third == 0, F.concat("id", F.lit("@"), "topic", F.lit(".org"))).when(third == 1, F.concat("id", F.lit("@"), "topic")).otherwise(F.concat("id", F.lit(" x@"), "topic", F.lit(".org")))
    return messages(spark, sf_dir).select("seq", email.alias("email")).withColumn("valid", F.col("email").rlike(EMAIL))


@query()
def hash_bucket(spark, sf_dir):
    """Messages in 16 buckets by FNV-1a of their id; SQL has no such hash, tests hold it against known values."""
    return messages(spark, sf_dir).select("seq", text.fnv1a_bucket(F.col("id"), 16).alias("bucket"))
