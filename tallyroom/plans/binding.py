"""Logical tables derived from the given ones, and the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.functions import attendance as att
from tallyroom.operators.ordered import range_width
from tallyroom.sources.tables import read_table

# Which event records which action; the remaining kind asks for voiding.
ACTIONS = {"signup": 1, "purchase": 2, "view": 3, "click": 4}


def _action():
    action = F.lit(None).cast("int")
    for kind, number in ACTIONS.items():
        action = F.when(F.col("event_type") == kind, F.lit(number)).otherwise(action)
    return action


def swipes(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select(
        "event_id", F.col("user_id").cast("string").alias("tagId"), "ts", _action().alias("action"))


def reading_log(spark: SparkSession, d: str) -> DataFrame:
    """Readings and void requests together."""
    return swipes(spark, d).select(
        "event_id", "tagId", att.second_stamp(F.col("ts")).alias("time"), "action",
        F.col("action").isNull().alias("is_void"))


def readings(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").where(F.col("event_type") != "error").select(
        "event_id", F.col("user_id").cast("string").alias("tagId"),
        att.second_stamp(F.col("ts")).alias("time"), _action().alias("action"))


def cards(spark: SparkSession, d: str) -> DataFrame:
    """Tags 0..139 have cards, so that some tags have none; many tags have several."""
    return read_table(spark, d, "customer").select(
        (F.col("c_custkey") % 140).cast("string").alias("tagId"), F.col("c_custkey").alias("userId"))


def users(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.initcap("c_mktsegment").alias("surname"))


def _md5_byte(text, i: int):
    return F.conv(F.substring(F.md5(text), 2 * i + 1, 2), 16, 10).cast("int")


def uids(spark: SparkSession, d: str) -> DataFrame:
    """Byte arrays read from cards: three known cards, the rest by hash; some are damaged."""
    tag = F.col("user_id").cast("string")
    head = F.array(*[_md5_byte(tag, i) for i in range(4)])
    uid = F.concat(head, F.array(F.aggregate(head, F.lit(0), lambda a, b: a.bitwiseXOR(b))))
    for rest, (_, known) in enumerate(att.KNOWN_CARDS):
        uid = F.when(F.col("user_id") % 50 == rest, F.array(*[F.lit(b) for b in known])).otherwise(uid)
    wrong = F.concat(F.slice(uid, 1, 4), F.array((F.get(uid, 4) + 1) % 256))
    damaged = (F.when(F.col("event_id") % 7 == 0, wrong)
               .when(F.col("event_id") % 11 == 0, F.slice(uid, 1, 4)).otherwise(uid))
    return read_table(spark, d, "events").select(
        F.col("event_id").alias("reading_id"), damaged.alias("uid"))


READINGS_SQL = """
 readings_log as (select event_id, cast(user_id as varchar) as "tagId", ts,
   strftime(ts, '%Y%m%d%H%M%S') as time, epoch_us(ts) // 1000000 as sec,
   case event_type when 'signup' then 1 when 'purchase' then 2 when 'view' then 3
     when 'click' then 4 end as action, event_type = 'error' as is_void from events),
 readings as (select event_id, "tagId", time, sec, action from readings_log where not is_void),
 cards as (select cast(c_custkey % 140 as varchar) as "tagId", c_custkey as "userId" from customer),
 users as (select c_custkey as id, c_name as name,
   upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) as surname from customer),
 heads as (select event_id, user_id, list_transform(range(0, 4), lambda i:
     cast('0x' || substr(md5(cast(user_id as varchar)), cast(2 * i + 1 as bigint), 2) as int)) as h from events),
 whole as (select event_id, case user_id % 50 when 0 then [5, 74, 28, 185, 234]
     when 1 then [83, 164, 247, 164, 164] when 2 then [20, 38, 121, 207, 132]
     else list_append(h, xor(xor(h[1], h[2]), xor(h[3], h[4]))) end as u from heads),
 uids as (select event_id as reading_id, case when event_id % 7 = 0 then list_append(u[1:4], (u[5] + 1) % 256)
     when event_id % 11 = 0 then u[1:4] else u end as uid from whole)
"""


# Mail campaigns. A task mails the customers of one nation within a thousand customer
# keys, so a task's inline rows are bounded however many customers there are.
WAVE = 1000


def campaign_rows(spark: SparkSession, d: str) -> DataFrame:
    """``(taskId, c_custkey, copy, id, address)``: some without id, some listed twice."""
    key = F.col("c_custkey")
    row_id = F.when(key % 7 == 0, F.lit(None)).when(key % 11 == 0, F.lit("")).otherwise(key.cast("string"))
    twice = F.when((key % 5 == 0) & (key % 7 != 0) & (key % 11 != 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return read_table(spark, d, "customer").select(
        (F.floor(key / WAVE) * 25 + F.col("c_nationkey")).cast("int").alias("taskId"),
        key, F.explode(twice).alias("copy"), row_id.alias("id")).select(
        "taskId", "c_custkey", "copy", "id",
        F.concat(F.when(F.col("copy") == 1, F.lit("alt")).otherwise(F.lit("c")), key, F.lit("@example.org")).alias("address"))


def tasks(spark: SparkSession, d: str) -> DataFrame:
    listed = campaign_rows(spark, d).groupBy("taskId").agg(
        F.sort_array(F.collect_list(F.struct("c_custkey", "copy", "id", "address"))).alias("listed"))
    row = lambda r: F.map_filter(
        F.create_map(F.lit("id"), r["id"], F.lit("address"), r["address"]), lambda k, v: v.isNotNull())
    data = F.struct(
        F.struct(F.lit("inline").alias("kind"), F.transform("listed", row).alias("rows")).alias("dataset"),
        F.struct(F.lit("mock").alias("kind"), F.concat(F.lit("Task "), F.col("taskId")).alias("subject")).alias("template"))
    n = F.col("taskId")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (n * 7) % 30).cast("timestamp_ntz")
    return listed.select(
        n.alias("id"),
        F.element_at(F.array(F.lit("new"), F.lit("running"), F.lit("running"), F.lit("done")), n % 4 + 1).alias("state"),
        F.when(n % 4 != 0, day).alias("timeLastProcessed"),
        F.to_json(data).alias("data"),
        (n % 25).alias("_nation"),
    ).join(read_table(spark, d, "nation").select(F.col("n_nationkey").alias("_nation"), F.col("n_regionkey").alias("provider")),
           "_nation").drop("_nation")


def task_heads(spark: SparkSession, d: str) -> DataFrame:
    """Tasks without their data, for queries that do not read it."""
    return tasks(spark, d).drop("data")


def providers(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("r_regionkey")
    return read_table(spark, d, "region").select(
        key.alias("id"), F.col("r_name").alias("name"),
        F.to_json(F.struct(F.lit("mock").alias("kind"), F.concat(F.lit("mail"), key).alias("smtpHost"))).alias("config"),
        F.concat(F.lit("bot"), key, F.lit("@example.org")).alias("from"))


def mail_log(spark: SparkSession, d: str) -> DataFrame:
    """Orders as delivery attempts: F was queued, O failed, P has no result yet."""
    key = F.col("c_custkey")
    customer = read_table(spark, d, "customer").select(
        key.alias("o_custkey"),
        (F.floor(key / WAVE) * 25 + F.col("c_nationkey")).cast("int").alias("taskId"),
        F.when((key % 7 == 0) | (key % 11 == 0), F.concat(F.lit("c"), key, F.lit("@example.org")))
        .otherwise(key.cast("string")).alias("rowId"),
        F.concat(F.lit("c"), key, F.lit("@example.org")).alias("address"))
    state = F.when(F.col("o_orderstatus") == "F", "queued").when(F.col("o_orderstatus") == "O", "failed-to-send")
    return read_table(spark, d, "orders").join(customer, "o_custkey").select(
        F.col("o_orderkey").alias("id"), "taskId", "rowId", F.col("o_orderdate").alias("timeSent"),
        "address", state.alias("providerState"))


def results(spark: SparkSession, d: str) -> DataFrame:
    """What happened to each attempt, by order priority."""
    kind = F.substring("o_orderpriority", 1, 1)
    key = F.col("o_orderkey")
    return read_table(spark, d, "orders").select(
        key.alias("attempt_id"),
        F.when(kind == "1", F.concat(F.lit("250 OK id=1aB-"), key))
        .when(kind == "3", F.when(key % 2 == 0, F.lit("nope")).otherwise(F.lit("250 OK id==")))
        .when(kind == "5", F.lit("250 OK id= =x")).alias("response"),
        F.when(kind == "2", F.when(key % 3 == 0, F.lit("soft bounce"))).alias("error"),
        F.when(kind == "4", F.lit("Fail to send")).alias("exception"),
        F.when(kind == "4", F.when(key % 2 == 0, F.lit("provider")).otherwise(F.lit("worker"))).alias("raised_by"),
        F.when((kind == "2") & (key % 2 == 0), F.lit("sent")).alias("state"),
        F.concat(F.lit("mail "), key).alias("body"), (key % 5).cast("int").alias("provider"))


def failures(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").where(F.col("event_type") == "error").select(
        (F.col("user_id") % 5).cast("int").alias("provider"),
        F.date_trunc("second", F.col("ts")).cast("timestamp_ntz").alias("fail_ts"))


def config_snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """First and last properties per user; users 0 mod 10 are not held, 1 mod 10 are gone."""
    e = read_table(spark, d, "events").select(
        F.col("user_id").alias("id"), "event_id",
        F.from_json("props", "map<string,string>").alias("config"), F.col("event_type").alias("from"))
    entry = F.struct("config", "from")
    ends = e.select("id", "event_id", F.to_json("config").alias("config"), "from").groupBy("id").agg(
        F.min_by(entry, "event_id").alias("first"), F.max_by(entry, "event_id").alias("last"))
    as_map = lambda c: F.from_json(c, "map<string,string>")
    held = ends.where(F.col("id") % 10 != 0).select("id", as_map("first.config").alias("config"), F.col("first.from").alias("from"))
    still = F.col("id") % 3 == 0
    new = ends.where(F.col("id") % 10 != 1).select(
        "id",
        F.when(still, F.map_concat(as_map("first.config"), F.create_map(F.lit("extra"), F.lit("1"))))
        .otherwise(as_map("last.config")).alias("config"),
        F.when(still, F.col("first.from")).otherwise(F.col("last.from")).alias("from"))
    return held, new


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as messages, with zero to three attachments by document id."""
    n = F.col("doc_id")
    attachment = lambda i, related: F.struct(
        F.concat(F.lit("f"), n, F.lit("-"), F.lit(i)).alias("filename"), F.lit(None).cast("string").alias("cid"),
        F.lit("image/png" if related else "application/pdf").alias("mimeType"), F.lit(related).alias("isRelated"))
    some = [(n % 2 == 0, attachment(0, True)), (n % 3 == 0, attachment(1, False)), (n % 4 == 0, attachment(2, True))]
    none = F.lit(None).cast("struct<filename:string,cid:string,mimeType:string,isRelated:boolean>")
    attachments = F.filter(F.array(*[F.when(c, a).otherwise(none) for c, a in some]), lambda a: a.isNotNull())
    return read_table(spark, d, "documents").select(
        n.alias("msg_id"),
        F.when(n % 5 != 0, F.col("text")).alias("contentText"),
        F.when(n % 7 < 4, F.concat(F.lit("<p>"), F.col("text"))).alias("contentHtml"),
        attachments.alias("attachments"))


def inbox_raw(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    return read_table(spark, d, "documents").select(
        F.concat(F.lit("Document "), n).alias("subject"),
        F.array(F.concat("source", F.lit("@example.org")), F.lit("second@example.org")).alias("from"),
        F.array(F.concat("lang", F.lit("@example.org"))).alias("recipients"),
        (F.lit("2016-11-24 15:06:40").cast("timestamp_ntz") + F.make_dt_interval(secs=n)).alias("date"),
        F.encode("text", "utf-8").alias("raw"))


MAIL_SQL = """
 base as (select cast(c_custkey // 1000 * 25 + c_nationkey as int) as "taskId", c_custkey as k,
   (c_custkey % 7 = 0 or c_custkey % 11 = 0) as noid,
   case when c_custkey % 7 = 0 or c_custkey % 11 = 0 then 'c' || c_custkey || '@example.org'
     else cast(c_custkey as varchar) end as "rowId", 'c' || c_custkey || '@example.org' as address from customer),
 listed as (select "taskId", k, 0 as copy, "rowId", address from base
   union all select "taskId", k, 1, "rowId", 'alt' || k || '@example.org' from base where k % 5 = 0 and not noid),
 positions as (select *, cast(row_number() over (partition by "taskId" order by k, copy) - 1 as int) as pos from listed),
 kept as (select * from listed qualify row_number() over (partition by "taskId", "rowId" order by k desc, copy desc) = 1),
 tasks as (select distinct "taskId" as id,
   case "taskId" % 4 when 0 then 'new' when 3 then 'done' else 'running' end as state,
   case when "taskId" % 4 <> 0 then cast(date '2024-01-01' + cast("taskId" * 7 % 30 as int) as timestamp) end as "timeLastProcessed",
   n_regionkey as provider from base join nation on n_nationkey = "taskId" % 25),
 mail_log as (select o_orderkey as id, "taskId", "rowId", address,
   case o_orderstatus when 'F' then 'queued' when 'O' then 'failed-to-send' end as "providerState"
   from orders join base on k = o_custkey),
 sent as (select distinct "taskId", "rowId" from mail_log where "providerState" <> 'failed-to-send'),
 pending as (select p.* from kept p where not exists
   (select 1 from sent s where s."taskId" = p."taskId" and s."rowId" = p."rowId")),
 chunked as (select "taskId", "rowId", address, row_number() over
   (partition by "taskId" order by substr(md5("rowId"), 1, 3), "rowId") - 1 as n from pending),
 failures as (select cast(user_id % 5 as int) as provider, date_trunc('second', ts) as fail_ts
   from events where event_type = 'error')
"""


# Mail-server log. Lines arrive up to four minutes late; ``error`` events are junk lines.
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """``(namespace, seq, event_id, value)`` where ``seq`` is the arrival time in microseconds."""
    digest = F.md5(F.col("event_id").cast("string"))
    mail_id = F.concat_ws("-", F.substring(digest, 1, 6), F.substring(digest, 7, 6), F.substring(digest, 13, 2))
    jitter = F.conv(F.substring(digest, 15, 2), 16, 10).cast("bigint") % 240
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return read_table(spark, d, "events").select(
        (F.col("user_id") % 5).cast("string").alias("namespace"),
        (micros + jitter * 1000000).alias("seq"),
        "event_id",
        F.when(F.col("event_type") == "error", F.concat(F.lit("junk "), F.col("props")))
        .otherwise(F.concat_ws(" ", stamp, mail_id, F.col("event_type"))).alias("value"))


def log_range(lines: DataFrame):
    """Ranges of arrival time in which ordered operators cut a namespace, sized by the data."""
    return F.floor(F.col("seq") / F.lit(1000000 * range_width(lines, F.floor(F.col("seq") / 1000000)))).cast("bigint")


def log_segments(lines: DataFrame) -> DataFrame:
    """Lines with a segment, as a rotation by size would cut the log."""
    return lines.withColumn("segment", F.lpad(log_range(lines).cast("string"), 10, "0"))


def reading_width(log: DataFrame) -> int:
    """Width of time ranges for readings, never less than the longest lookback."""
    return range_width(log, att.stamp_seconds(F.col("time")), least=600)


EVENTS_SQL = """
 lines as (select cast(user_id % 5 as varchar) as namespace, event_id, event_type = 'error' as junk,
   epoch_us(ts) + cast('0x' || substr(md5(cast(event_id as varchar)), 15, 2) as bigint) % 240 * 1000000 as seq,
   strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp, event_type as message, props,
   substr(md5(cast(event_id as varchar)), 1, 6) || '-' || substr(md5(cast(event_id as varchar)), 7, 6) || '-'
     || substr(md5(cast(event_id as varchar)), 13, 2) as "mailId" from events),
 parsed as (select namespace, seq, event_id, "mailId", timestamp, message from lines where not junk),
 stored as (select * from parsed where timestamp < '2024-01-16'),
 last as (select namespace, max(timestamp) as last from stored group by 1)
"""
