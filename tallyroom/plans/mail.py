"""Mail campaign queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.functions import mail as fn
from tallyroom.operators import mail as op
from tallyroom.plans import binding as b
from tallyroom.sources import keyed, store
from tallyroom.sources.tables import read_table
from tallyroom.streaming import inbox
from tallyroom.workspace import new_folder

SENDER = "bot@example.org"


def _recipients(spark: SparkSession, d: str) -> DataFrame:
    return op.distinct_row_ids(op.inline_rows(b.tasks(spark, d)))


def _pending(spark: SparkSession, d: str) -> DataFrame:
    return op.pending_recipients(_recipients(spark, d), b.mail_log(spark, d))


def inline_rows(spark: SparkSession, d: str) -> DataFrame:
    return op.inline_rows(b.tasks(spark, d)).select("taskId", "pos", "rowId", F.col("row")["address"].alias("address"))


def row_key(spark: SparkSession, d: str) -> DataFrame:
    row = F.create_map(F.lit("id"), F.col("id"), F.lit("address"), F.col("address"))
    return b.campaign_rows(spark, d).select("c_custkey", "copy", fn.row_key(row).alias("rowId"))


def distinct_row_ids(spark: SparkSession, d: str) -> DataFrame:
    return _recipients(spark, d).select("taskId", "rowId", F.col("row")["address"].alias("address"))


def active_tasks(spark: SparkSession, d: str) -> DataFrame:
    return op.active_tasks(b.task_heads(spark, d)).select("id", "state", "provider")


def oldest_task_first(spark: SparkSession, d: str) -> DataFrame:
    return op.oldest_task_first(op.active_tasks(b.task_heads(spark, d))).select("id", "state", "timeLastProcessed")


def pending_recipients(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d).select("taskId", "rowId", F.col("row")["address"].alias("address"))


def ids_minus_sent(spark: SparkSession, d: str) -> DataFrame:
    ids = op.inline_rows(b.tasks(spark, d))
    return op.ids_minus_sent(ids, b.mail_log(spark, d).where(F.col("providerState") != fn.FAILED))


def rows_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """Full rows of the ids that were sent."""
    ids = op.sent_ids(b.mail_log(spark, d))
    return op.rows_by_ids(op.inline_rows(b.tasks(spark, d)), ids).select(
        "taskId", "rowId", F.col("row")["address"].alias("address"))


def batch_chunks(spark: SparkSession, d: str) -> DataFrame:
    return op.batch_chunks(_pending(spark, d).select("taskId", "rowId"))


def render_message(spark: SparkSession, d: str) -> DataFrame:
    sent = op.render_message(_pending(spark, d), b.tasks(spark, d), SENDER)
    return sent.select("taskId", "rowId", fn.join_recipients(F.col("recipients")).alias("recipients"),
                       "from", "subject", "contentText")


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    failed = F.substring(F.md5(F.concat(F.lit("try"), "rowId")), 1, 1).isin("0", "1")
    return op.batch_chunks(_pending(spark, d).select("taskId", "rowId")).withColumn("failed", failed)


def stop_batch_on_failure(spark: SparkSession, d: str) -> DataFrame:
    return op.stop_batch_on_failure(_attempts(spark, d))


def delivery_state(spark: SparkSession, d: str) -> DataFrame:
    return op.delivery_state(b.results(spark, d).drop("body", "provider")).withColumn("data", F.to_json("data"))


def delivery_log(spark: SparkSession, d: str) -> DataFrame:
    """Attempts noted first, results written into them in two turns; one in nine has none yet."""
    folder = new_folder(spark, "log")
    op.log_attempts(b.mail_log(spark, d).select("id", "taskId", "rowId", "address", F.col("timeSent").cast("timestamp_ntz")), folder)
    done = op.delivery_state(b.results(spark, d))
    for turn in (F.col("attempt_id") % 9 < 5, F.col("attempt_id") % 9 >= 5):
        op.log_results(done.where(turn & (F.col("attempt_id") % 9 != 0)), folder)
    return keyed.read(spark, folder, op.LOG).withColumn("data", F.to_json("data"))


def task_update(spark: SparkSession, d: str) -> DataFrame:
    """Tasks after today's attempts: those with any sent row are running, at their last attempt."""
    folder = new_folder(spark, "tasks")
    keyed.insert(b.tasks(spark, d).select("id", "state", F.col("timeLastProcessed").cast("timestamp_ntz"), "data", "provider"), folder, "id", op.TASK)
    changes = b.mail_log(spark, d).where(F.col("providerState") == fn.QUEUED).groupBy("taskId").agg(
        F.max("timeSent").cast("timestamp_ntz").alias("timeLastProcessed")).select(
        F.col("taskId").alias("id"), F.lit("running").alias("state"), "timeLastProcessed")
    op.task_update(changes, folder)
    return keyed.read(spark, folder, op.TASK).select("id", "state", "timeLastProcessed", "provider")


def task_progress(spark: SparkSession, d: str) -> DataFrame:
    return op.task_progress(b.task_heads(spark, d), _pending(spark, d), b.providers(spark, d))


def in_flight(spark: SparkSession, d: str) -> DataFrame:
    return op.in_flight(b.mail_log(spark, d))


def distinct_providers(spark: SparkSession, d: str) -> DataFrame:
    return op.distinct_providers(b.task_heads(spark, d))


def providers_in_use(spark: SparkSession, d: str) -> DataFrame:
    return op.providers_in_use(b.providers(spark, d), b.task_heads(spark, d)).select("id", "name", "from")


def _holders(spark: SparkSession, d: str) -> DataFrame:
    return b.providers(spark, d).where(F.col("id") != 4).withColumn(
        "holder_state", F.when(F.col("id") == 2, "STOPPING").otherwise("RUNNING"))


def tasks_with_provider(spark: SparkSession, d: str) -> DataFrame:
    return op.tasks_with_provider(b.task_heads(spark, d), _holders(spark, d)).select("id", "provider")


def provider_has_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Customers as providers of tasks by event: some have none."""
    customers = read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    used = read_table(spark, d, "events").select(F.col("user_id").alias("provider"))
    return op.provider_has_tasks(customers, used)


def providers_without_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Customers without events."""
    customers = read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    used = read_table(spark, d, "events").select(F.col("user_id").alias("provider"))
    return op.providers_without_tasks(customers, used)


def provider_ban(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as providers, failing at each returned line item, seen at a fixed moment."""
    as_of = F.lit("1997-06-01 00:00:30").cast("timestamp_ntz")
    failed = read_table(spark, d, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.col("l_suppkey").alias("provider"), F.col("l_shipdate").alias("fail_ts"))
    suppliers = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return op.provider_ban(suppliers, failed, as_of)


def banned_until(spark: SparkSession, d: str) -> DataFrame:
    return op.banned_until(b.failures(spark, d)).select(
        "provider", F.date_format("banned_until", "yyyy-MM-dd HH:mm:ss").alias("banned_until"))


def config_drift(spark: SparkSession, d: str) -> DataFrame:
    return op.config_drift(*b.config_snapshots(spark, d))


def nested_drift(spark: SparkSession, d: str) -> DataFrame:
    held, new = b.config_snapshots(spark, d)
    nested = lambda df, n: df.select(
        "id", F.to_json(F.struct(F.col("config").alias("c"), F.array(*n).alias("ports"))).alias("config"), "from")
    return op.nested_drift(nested(held, [F.lit(25), F.lit(587)]), nested(new, [F.lit(587), F.lit(25)]))


def require_body(spark: SparkSession, d: str) -> DataFrame:
    return op.require_body(b.messages(spark, d))


def mime_plan(spark: SparkSession, d: str) -> DataFrame:
    return op.mime_plan(b.messages(spark, d))


def mime_parts(spark: SparkSession, d: str) -> DataFrame:
    return op.mime_parts(b.messages(spark, d))


def inbox_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Message files of two deliveries, the second with every third message of the first again."""
    folder, archive, target, checkpoint = (new_folder(spark, n) for n in ("messages", "archive", "inbox", "checkpoint"))
    raw = b.inbox_raw(spark, d)
    late = F.element_at(F.split("subject", " "), -1).cast("long") % 2 == 1
    again = F.element_at(F.split("subject", " "), -1).cast("long") % 3 == 0
    for part in (~late, late | again):
        raw.where(part).write.mode("append").parquet(folder)
        inbox.ingest(spark, folder, archive, target, checkpoint)
    return store.read_batches(spark, target, inbox.INBOX).withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss")).withColumn("body", F.decode("body", "utf-8"))


def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select(
        "o_orderkey", fn.fingerprint(
            F.col("o_orderdate") - F.make_ym_interval(F.lit(26)), F.encode("o_orderpriority", "utf-8")).alias("fingerprint"))


def smtp_message_id(spark: SparkSession, d: str) -> DataFrame:
    return b.results(spark, d).select(
        "attempt_id", fn.smtp_message_id(F.col("response")).alias("message_id"),
        fn.response_parsed(F.col("response")).alias("parsed"))


def join_recipients(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of an order's two parties as one header."""
    to = F.array(F.concat(F.lit("c"), "o_custkey", F.lit("@example.org")), F.concat(F.lit("o"), "o_orderkey", F.lit("@example.org")))
    return read_table(spark, d, "orders").select("o_orderkey", fn.join_recipients(to).alias("recipients"))


def first_address(spark: SparkSession, d: str) -> DataFrame:
    raw = b.inbox_raw(spark, d)
    return raw.select("subject", fn.first_address(F.col("from")).alias("from"), fn.first_address(F.col("recipients")).alias("to"))


def content_id(spark: SparkSession, d: str) -> DataFrame:
    return b.messages(spark, d).select("msg_id", F.posexplode("attachments").alias("pos", "a")).select(
        "msg_id", "pos", fn.content_id(F.col("msg_id"), F.col("pos")).alias("cid"))


QUERIES = {f.__name__: f for f in [
    inline_rows, row_key, distinct_row_ids, active_tasks, oldest_task_first, pending_recipients,
    ids_minus_sent, rows_by_ids, batch_chunks, render_message, stop_batch_on_failure, delivery_state,
    delivery_log, task_update, task_progress, in_flight, distinct_providers, providers_in_use,
    tasks_with_provider, provider_has_tasks, providers_without_tasks, provider_ban, banned_until,
    config_drift, nested_drift, require_body, mime_plan, mime_parts, inbox_ingest, fingerprint,
    smtp_message_id, join_recipients, first_address, content_id,
]}
QUERIES["take_n"] = batch_chunks


def _with(body: str, ctes: str = "") -> str:
    return f"with {b.MAIL_SQL}{ctes} {body}"


_DELIVERY = """
 shaped as (select o_orderkey as attempt_id, substr(o_orderpriority, 1, 1) as kind, o_orderkey as k,
   case substr(o_orderpriority, 1, 1) when '1' then '250 OK id=1aB-' || o_orderkey
     when '3' then case when o_orderkey % 2 = 0 then 'nope' else '250 OK id==' end
     when '5' then '250 OK id= =x' end as response from orders),
 states as (select attempt_id, kind = '3' as response_unparsed,
   case kind when '1' then '1aB-' || k when '2' then '' when '5' then ' ' end as "providerMessageId",
   case when kind = '3' or kind = '4' and k % 2 = 0 then 'failed-to-send' when kind = '4' then 'exception'
     when kind = '1' then 'queued' when kind = '2' and k % 2 = 0 then 'sent' end as "providerState",
   case when kind = '4' then '{"exception":"Fail to send"}'
     when kind = '2' and k % 3 = 0 then '{"error":"soft bounce"}'
     when kind in ('1', '5') then '{"response":"' || response || '"}' else '{}' end as data from shaped)
"""

_MIME = """
 m as (select doc_id as msg_id, doc_id % 5 <> 0 as txt, doc_id % 7 < 4 as html,
   (case when doc_id % 2 = 0 then 1 else 0 end) + (case when doc_id % 4 = 0 then 1 else 0 end) as rel,
   case when doc_id % 3 = 0 then 1 else 0 end as loose, doc_id as n from documents)
"""

ORACLES = {
    "inline_rows": _with('select "taskId", pos, "rowId", address from positions'),
    "row_key": _with('select k as c_custkey, copy, "rowId" from listed'),
    "distinct_row_ids": _with('select "taskId", "rowId", address from kept'),
    "active_tasks": _with("select id, state, provider from tasks where state in ('new', 'running')"),
    "oldest_task_first": _with("""select id, state, "timeLastProcessed" from tasks
        where state in ('new', 'running') order by "timeLastProcessed" nulls first, id"""),
    "pending_recipients": _with('select "taskId", "rowId", address from pending'),
    "ids_minus_sent": _with('select "taskId", "rowId" from listed except select "taskId", "rowId" from sent'),
    "rows_by_ids": _with("""select k."taskId", k."rowId", k.address from kept k
        join sent s on s."taskId" = k."taskId" and s."rowId" = k."rowId" """),
    "batch_chunks": _with('select "taskId", "rowId", n // 10 as batch_no, n % 10 as seq from chunked'),
    "take_n": _with('select "taskId", "rowId", n // 10 as batch_no, n % 10 as seq from chunked'),
    "render_message": _with("""select "taskId", "rowId", address as recipients, 'bot@example.org' as "from",
        'Task ' || "taskId" as subject, 'Hello! привіт' as "contentText" from pending"""),
    "stop_batch_on_failure": _with("""
      select "taskId", "rowId", n // 10 as batch_no, n % 10 as seq, failed from tried
      qualify coalesce(max(case when failed then 1 else 0 end) over (partition by "taskId", n // 10 order by n
        rows between unbounded preceding and 1 preceding), 0) = 0""", """,
      tried as (select *, substr(md5('try' || "rowId"), 1, 1) in ('0', '1') as failed from chunked)"""),
    "delivery_state": f"with {_DELIVERY} select * from states",
    "delivery_log": _with("""
      select l.id, l."taskId", l."rowId", l.address, cast(o_orderdate as timestamp) as "timeSent", s."providerMessageId", s."providerState", s.data,
        case when kind in ('1', '2', '5') then 'mail ' || k end as body, cast(null as varchar) as error,
        case when kind <> '4' or k % 2 = 0 then cast(k % 5 as int) end as provider
      from mail_log l join orders on o_orderkey = l.id left join states s on s.attempt_id = l.id and l.id % 9 <> 0
        left join shaped on shaped.attempt_id = s.attempt_id""", "," + _DELIVERY),
    "task_update": _with("""
      select t.id, case when c.at is null then t.state else 'running' end as state,
        coalesce(c.at, t."timeLastProcessed") as "timeLastProcessed", t.provider
      from tasks t left join (select "taskId", max(o_orderdate) as at from orders join base on k = o_custkey
        where o_orderstatus = 'F' group by 1) c on c."taskId" = t.id"""),
    "task_progress": _with("""
      select t.id as "taskId", coalesce(p.n, 0) as n_pending,
        case when p.n is null then 'done' else 'running' end as state
      from tasks t left join (select "taskId", count(*) as n from pending group by 1) p on p."taskId" = t.id
      where t.state in ('new', 'running')"""),
    "in_flight": _with("""select "taskId", count(*) filter ("providerState" is null) as n_open,
        count(*) filter ("providerState" is null) > 0 as in_flight from mail_log group by 1"""),
    "distinct_providers": _with("select distinct provider from tasks"),
    "providers_in_use": _with("""select r_regionkey as id, r_name as name, 'bot' || r_regionkey || '@example.org' as "from"
        from region where r_regionkey in (select provider from tasks where state in ('new', 'running'))"""),
    "tasks_with_provider": _with("select id, provider from tasks where provider not in (2, 4)"),
    "provider_has_tasks": """select c_custkey as id, exists (select 1 from events
        where user_id = c_custkey) as has_tasks from customer""",
    "providers_without_tasks": """select c_custkey as id from customer where not exists
        (select 1 from events where user_id = c_custkey)""",
    "provider_ban": """select s_suppkey as id, s_name as name from supplier where not exists
        (select 1 from lineitem where l_suppkey = s_suppkey and l_returnflag = 'R'
          and l_shipdate <= timestamp '1997-06-01 00:00:30'
          and timestamp '1997-06-01 00:00:30' < l_shipdate + interval 60 second)""",
    "banned_until": _with("""select provider,
        strftime(max(fail_ts) + interval 60 second, '%Y-%m-%d %H:%M:%S') as banned_until from failures group by 1"""),
    "config_drift": """
      with e as (select user_id as id, props, event_type as f,
          row_number() over (partition by user_id order by event_id) as up,
          row_number() over (partition by user_id order by event_id desc) as down from events),
        held as (select id, json_extract_string(props, '$.k') as k, f from e where up = 1 and id % 10 <> 0),
        new as (select id, json_extract_string(props, '$.k') as k, f from e
          where (id % 3 = 0 and up = 1 or id % 3 <> 0 and down = 1) and id % 10 <> 1)
      select coalesce(h.id, n.id) as id, case when h.id is null then 'new' when n.id is null then 'gone'
        when h.k = n.k and h.f = n.f then 'same' else 'changed' end as drift
      from held h full join new n on h.id = n.id""",
    "nested_drift": """
      with e as (select user_id as id, props, event_type as f,
          row_number() over (partition by user_id order by event_id) as up,
          row_number() over (partition by user_id order by event_id desc) as down from events),
        held as (select id, json_extract_string(props, '$.k') as k, f from e where up = 1 and id % 10 <> 0),
        new as (select id, json_extract_string(props, '$.k') as k, f from e
          where (id % 3 = 0 and up = 1 or id % 3 <> 0 and down = 1) and id % 10 <> 1)
      select coalesce(h.id, n.id) as id, case when h.id is null then 'new' when n.id is null then 'gone'
        when h.k = n.k and h.f = n.f then 'same' else 'changed' end as drift
      from held h full join new n on h.id = n.id""",
    "require_body": """select doc_id as msg_id, 'Mail should have text or html' as error from documents
        where doc_id % 5 = 0 and doc_id % 7 >= 4""",
    "mime_plan": f"""
      with {_MIME}, h as (select *, case when html and rel > 0 then 'related[html' || repeat(', inline', rel) || ']'
          else 'html' end as hp from m where txt or html),
        body as (select *, case when txt and html then 'alternative[text, ' || hp || ']' when html then hp
          else 'text' end as bp from h)
      select msg_id, case when loose > 0 then 'mixed[' || bp || repeat(', file', loose + case when html then 0 else rel end)
        || ']' else bp end as plan from body""",
    "mime_parts": f"""
      with {_MIME}, c as (select *, case when loose > 0 then 'mixed/' else '' end as o,
          case when txt and html then 'alternative/' else '' end as a,
          case when html and rel > 0 then 'related/' else '' end as r from m where txt or html),
        parts as (
          select msg_id, 0 as ord, o || a as container, 'text' as kind, 'text/plain' as mime, null as att from c where txt
          union all select msg_id, 1, o || a || r, 'html', 'text/html', null from c where html
          union all select msg_id, 2, o || a || r, 'inline', 'image/png', 0 from c where html and n % 2 = 0
          union all select msg_id, 3, o || a || r, 'inline', 'image/png',
              case when n % 3 = 0 then 2 else 1 end from c where html and n % 4 = 0
          union all select msg_id, 4, o, 'file', 'image/png', 0 from c where loose > 0 and not html and n % 2 = 0
          union all select msg_id, 5, o, 'file', 'application/pdf', case when n % 2 = 0 then 1 else 0 end
            from c where loose > 0
          union all select msg_id, 6, o, 'file', 'image/png', 2 from c where loose > 0 and not html and n % 4 = 0)
      select msg_id, cast(row_number() over (partition by msg_id order by ord) - 1 as int) as part_no,
        container, kind, mime, cast(att as int) as attachment from parts""",
    "inbox_ingest": """select 'Document ' || doc_id as subject, source || '@example.org' as "from",
        lang || '@example.org' as "to", cast(octet_length(encode(text)) as int) as size, text as body,
        strftime(timestamp '2016-11-24 15:06:40' + to_seconds(doc_id), '%Y-%m-%d %H:%M:%S') as date,
        lower(to_base(1480000000 + doc_id, 36)) || ':' || sha1(text) as fingerprint from documents""",
    "fingerprint": """
      with e as (select o_orderkey, o_orderpriority, epoch_us(o_orderdate - interval 26 year) // 1000000 as s from orders)
      select o_orderkey, case when s < 0 then '-' else '' end || lower(to_base(abs(s), 36)) || ':' || sha1(o_orderpriority)
        as fingerprint from e""",
    "smtp_message_id": f"""with {_DELIVERY} select attempt_id, kind <> '3' as parsed,
        case kind when '1' then '1aB-' || k when '5' then ' ' when '3' then null else '' end as message_id from shaped""",
    "join_recipients": """select o_orderkey,
        'c' || o_custkey || '@example.org, o' || o_orderkey || '@example.org' as recipients from orders""",
    "first_address": """select 'Document ' || doc_id as subject, source || '@example.org' as "from",
        lang || '@example.org' as "to" from documents""",
    "content_id": f"""with {_MIME}, p as (select msg_id, unnest(range(0, rel + loose)) as pos from m)
      select msg_id, cast(pos as int) as pos, substr(sha256(msg_id || ':' || pos), 1, 16) || '@message' as cid from p""",
}
