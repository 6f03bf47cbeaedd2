"""Card reading queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.functions import attendance as fn
from tallyroom.operators import attendance as op
from tallyroom.plans import binding as b
from tallyroom.sources import tables
from tallyroom.workspace import new_folder

AS_OF = "2024-01-15 12:00:00"
# A day of look-back, so that the fixed moment finds readings of many tags.
DAY = 24 * 60


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def scan_all(spark: SparkSession, d: str) -> DataFrame:
    return tables.scan_all(tables.read_table(spark, d, "nation"))


def scan_filter_eq(spark: SparkSession, d: str) -> DataFrame:
    return tables.scan_filter_eq(tables.read_table(spark, d, "part"), "p_brand", "Brand#7").select(
        "p_partkey", "p_name", "p_brand")


def append_reading(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "readings")
    taken = b.swipes(spark, d).where(F.col("action").isNotNull())
    op.write_readings(op.append_reading(taken), path)
    return spark.read.schema("tagId string, time string, action int").parquet(path)


def reading_owner(spark: SparkSession, d: str) -> DataFrame:
    return op.reading_owner(b.readings(spark, d), b.cards(spark, d), b.users(spark, d))


def card_match(spark: SparkSession, d: str) -> DataFrame:
    return op.card_match(b.uids(spark, d)).select("reading_id", "card")


def last_reading(spark: SparkSession, d: str) -> DataFrame:
    rows = b.readings(spark, d)
    return op.previous_reading(rows, width=b.reading_width(rows)).select(
        "event_id", "tagId", "time", "action", "prev_time", "prev_action")


def last_reading_as_of(spark: SparkSession, d: str) -> DataFrame:
    return op.last_reading(b.readings(spark, d), _as_of(), DAY)


def void_last_reading(spark: SparkSession, d: str) -> DataFrame:
    log = b.reading_log(spark, d)
    return op.void_readings(log, width=b.reading_width(log)).select("event_id", "tagId", "time", "action")


def void_last_reading_once(spark: SparkSession, d: str) -> DataFrame:
    """One request per tag, at its latest void request."""
    requests = b.swipes(spark, d).where(F.col("action").isNull()).groupBy("tagId").agg(F.max("ts").alias("at"))
    return op.void_last_reading(b.readings(spark, d), requests, DAY)


def latest_one(spark: SparkSession, d: str) -> DataFrame:
    return op.latest_one(b.readings(spark, d))


def first_card(spark: SparkSession, d: str) -> DataFrame:
    return op.first_card(b.cards(spark, d))


def _uid(name):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return b.uids(spark, d).select("reading_id", getattr(fn, name)(F.col("uid")).alias(name))
    return query


def key_to_action(spark: SparkSession, d: str) -> DataFrame:
    """Key codes spread over readings: the five known keys and two unknown ones."""
    key = (F.lit(47) + 2 * (F.col("event_id") % 7)).cast("int")
    return tables.read_table(spark, d, "events").select(
        "event_id", key.alias("key"), fn.key_to_action(key).alias("action"),
        fn.is_void_request(key).alias("is_void"))


def second_stamp(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_table(spark, d, "events").select(
        "event_id", fn.second_stamp(F.col("ts")).alias("time"))


def lookback_bound(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_table(spark, d, "events").select(
        "event_id", fn.lookback_bound(F.col("ts"), op.LOOK_MINUTES).alias("look_from"),
        fn.lookback_bound(F.col("ts"), op.VOID_MINUTES).alias("void_from"))


def ascii_fold(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_table(spark, d, "documents").select(
        "doc_id", fn.ascii_fold(F.col("text")).alias("folded"))


QUERIES = {
    "scan_all": scan_all,
    "scan_filter_eq": scan_filter_eq,
    "append_reading": append_reading,
    "reading_owner": reading_owner,
    "card_match": card_match,
    "last_reading": last_reading,
    "last_reading_as_of": last_reading_as_of,
    "void_last_reading": void_last_reading,
    "void_last_reading_once": void_last_reading_once,
    "latest_one": latest_one,
    "first_card": first_card,
    "tag_id": _uid("tag_id"),
    "tag_label": _uid("tag_label"),
    "uid_checksum": _uid("uid_checksum"),
    "key_to_action": key_to_action,
    "second_stamp": second_stamp,
    "lookback_bound": lookback_bound,
    "ascii_fold": ascii_fold,
}


def _with(body: str, ctes: str = "") -> str:
    return f"with {b.READINGS_SQL}{ctes} {body}"


def _fold_sql(text: str) -> str:
    one, several = fn.fold_table()
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"translate({text}, {quote(''.join(one))}, {quote(''.join(one.values()))})"
    for letter, spelled in several.items():
        out = f"replace({out}, {quote(letter)}, {quote(spelled)})"
    return out


ORACLES = {
    "ascii_fold": f"select doc_id, {_fold_sql('text')} as folded from documents",
    "scan_all": "select * from nation",
    "scan_filter_eq": "select p_partkey, p_name, p_brand from part where p_brand = 'Brand#7'",
    "append_reading": _with('select "tagId", time, action from readings'),
    "reading_owner": _with("""
      select r.event_id, r."tagId", r.time, r.action,
        coalesce((select u.surname || ', ' || u.name from users u where u.id = c.u), 'Neznama karta') as owner
      from readings r left join (select "tagId", min("userId") as u from cards group by 1) c
        on c."tagId" = r."tagId" """),
    "card_match": _with("""
      select reading_id, case when uid = [5, 74, 28, 185, 234] then 'Card A'
        when uid = [83, 164, 247, 164, 164] then 'Card B'
        when uid = [20, 38, 121, 207, 132] then 'Card C' else 'wrong Card' end as card from uids"""),
    "last_reading": _with("""
      select event_id, "tagId", time, action,
        case when sec - lag(sec) over w < 300 then lag(time) over w end as prev_time,
        case when sec - lag(sec) over w < 300 then lag(action) over w end as prev_action
      from readings window w as (partition by "tagId" order by time, event_id)"""),
    "last_reading_as_of": _with("""
      select "tagId", time, action from readings
      where time > '20240114120000' and time <= '20240115120000'
      qualify row_number() over (partition by "tagId" order by time desc, event_id desc) = 1"""),
    "void_last_reading": _with("""
      select l.event_id, l."tagId", l.time, l.action from paired l
      where not is_void and not coalesce(next_sec - sec < 360, false)""", """,
      depths as (select *, sum(case when is_void then -1 else 1 end) over
          (partition by "tagId" order by time, event_id rows unbounded preceding)
          + case when is_void then 1 else 0 end as lvl from readings_log),
      paired as (select *, lead(sec) over (partition by "tagId", lvl order by time, event_id) as next_sec
        from depths)"""),
    "void_last_reading_once": _with("""
      select r.event_id, r."tagId", r.time, r.action from readings r
      where not exists (select 1 from dropped x where x.event_id = r.event_id)""", """,
      requests as (select "tagId", max(ts) as at from readings_log where is_void group by 1),
      dropped as (select r.event_id from readings r join requests q on q."tagId" = r."tagId"
        where r.time > strftime(q.at - interval 1440 minute, '%Y%m%d%H%M%S')
          and r.time <= strftime(q.at, '%Y%m%d%H%M%S')
        qualify row_number() over (partition by r."tagId" order by r.time desc, r.event_id desc) = 1)"""),
    "latest_one": _with("""
      select "tagId", time, action from readings
      qualify row_number() over (partition by "tagId" order by time desc, event_id desc) = 1"""),
    "first_card": _with('select "tagId", min("userId") as "userId" from cards group by 1'),
    "tag_id": _with("select reading_id, array_to_string(uid, '') as tag_id from uids"),
    "tag_label": _with("select reading_id, array_to_string(uid, ',') as tag_label from uids"),
    "uid_checksum": _with("""select reading_id, len(uid) = 5
        and xor(xor(uid[1], uid[2]), xor(uid[3], uid[4])) = uid[5] as uid_checksum from uids"""),
    "key_to_action": """
      select event_id, cast(47 + 2 * (event_id % 7) as int) as key,
        case 47 + 2 * (event_id % 7) when 55 then 1 when 57 then 2 when 49 then 3 when 51 then 4 end as action,
        47 + 2 * (event_id % 7) = 53 as is_void from events""",
    "second_stamp": "select event_id, strftime(ts, '%Y%m%d%H%M%S') as time from events",
    "lookback_bound": """
      select event_id, strftime(ts - interval 5 minute, '%Y%m%d%H%M%S') as look_from,
        strftime(ts - interval 6 minute, '%Y%m%d%H%M%S') as void_from from events""",
}
