"""Mail campaigns: recipients, batches, messages, results, providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.functions import mail as fn
from tallyroom.operators import registry
from tallyroom.operators.ordered import running
from tallyroom.sources import keyed

BATCH_ROWS = 10
BAN_SECONDS = 60


def active_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("state").isin("new", "running"))


def oldest_task_first(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy(F.col("timeLastProcessed").asc_nulls_first(), "id")


def inline_rows(tasks: DataFrame) -> DataFrame:
    """One record ``(taskId, pos, rowId, row)`` per dataset row stored in a task."""
    return registry.inline_dataset(tasks)


def distinct_row_ids(rows: DataFrame) -> DataFrame:
    """One record per task and row id; of equal ids the last row is kept."""
    return rows.groupBy("taskId", "rowId").agg(F.max_by("row", "pos").alias("row"))


def sent_ids(mail_log: DataFrame) -> DataFrame:
    """Ids that count as sent. A null state is neither equal nor unequal, so it does not."""
    return mail_log.where(F.col("providerState") != fn.FAILED).select("taskId", "rowId").distinct()


def pending_recipients(recipients: DataFrame, mail_log: DataFrame) -> DataFrame:
    """Recipients not yet sent. Sent ids are made distinct on the map side before the join."""
    return recipients.join(sent_ids(mail_log), ["taskId", "rowId"], "left_anti")


def rows_by_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return distinct_row_ids(rows.join(ids.select("taskId", "rowId"), ["taskId", "rowId"], "left_semi"))


def batch_chunks(pending: DataFrame, size: int = BATCH_ROWS, hash_digits: int = 3) -> DataFrame:
    """Number the pending rows of each task in batches of ``size``.

    Rows of a task have no order of their own; here it is the hash of the id, then the id.
    Leading hash digits cut a task into ``16**hash_digits`` ranges, so a task of any size is
    numbered by many tasks at once.
    """
    cut = pending.withColumn("_h", F.substring(F.md5("rowId"), 1, hash_digits))
    numbered = running(cut, ["taskId"], ["_h", "rowId"], F.col("_h"), sums={"_n": F.lit(1)}, once=True)
    place = F.col("_n") - 1
    return numbered.select(
        *pending.columns,
        F.floor(place / size).cast("bigint").alias("batch_no"),
        (place % size).cast("bigint").alias("seq"),
    )


def render_message(rows: DataFrame, tasks: DataFrame, sender: str) -> DataFrame:
    """Messages of ``rows(taskId, rowId, row)`` by the template of each row's task."""
    return registry.messages(rows, tasks, sender)


def stop_batch_on_failure(attempts: DataFrame) -> DataFrame:
    """Attempts of ``(taskId, batch_no, seq, failed)`` up to each batch's first failure.

    A window over a batch holds at most ``BATCH_ROWS`` rows.
    """
    earlier = (Window.partitionBy("taskId", "batch_no").orderBy("seq")
               .rowsBetween(Window.unboundedPreceding, -1))
    return (attempts.withColumn("_stop", F.max("failed").over(earlier))
            .where(~F.coalesce("_stop", F.lit(False))).drop("_stop"))


def delivery_state(results: DataFrame) -> DataFrame:
    """State, message id and data of each result.

    ``results(attempt_id, response, error, exception, raised_by, state)``: ``raised_by`` is
    ``provider`` or ``worker`` where there is an exception, ``state`` is what the provider said.
    ``body`` and ``provider``, where there are such columns, are kept as the worker notes them: the body
    of what was sent, and the provider unless the worker itself failed.
    """
    unparsed = F.col("exception").isNull() & ~fn.response_parsed(F.col("response"))
    raised = F.col("exception").isNotNull()
    by_provider = raised & (F.col("raised_by") == "provider")
    message_id = F.when(~raised & ~unparsed, fn.smtp_message_id(F.col("response")))
    kept = ~by_provider & ~unparsed
    noted = {"body": kept & ~raised, "provider": ~raised | by_provider}
    data = F.create_map(
        F.lit("error"), F.when(kept, F.col("error")),
        F.lit("response"), F.when(kept, F.col("response")),
        F.lit("exception"), F.col("exception"))
    return results.select(
        "attempt_id",
        message_id.alias("providerMessageId"),
        F.when(by_provider | unparsed, F.lit(fn.FAILED))
        .when(raised, F.lit(fn.EXCEPTION))
        .when(F.trim(message_id) != "", F.lit(fn.QUEUED))
        .otherwise(F.col("state")).alias("providerState"),
        unparsed.alias("response_unparsed"),
        F.map_filter(data, lambda k, v: v.isNotNull()).alias("data"),
        *[F.when(when, F.col(c)).alias(c) for c, when in noted.items() if c in results.columns],
    )


def delivery_log(attempts: DataFrame, states: DataFrame) -> DataFrame:
    """Log rows ``(id, taskId, rowId, address)`` completed with the results known so far."""
    done = states.select(
        F.col("attempt_id").alias("id"), "providerMessageId", "providerState", "data")
    return attempts.join(done, "id", "left")


LOG = ("id bigint, taskId int, rowId string, timeSent timestamp_ntz, body string, address string, data map<string,string>, "
       "provider int, providerMessageId string, providerState string, error string")
TASK = "id int, state string, timeLastProcessed timestamp_ntz, data string, provider int"


def log_attempts(attempts: DataFrame, folder: str) -> None:
    """Note in the delivery log that rows ``(id, taskId, rowId, address, timeSent)`` are being sent."""
    keyed.insert(attempts, folder, "id", LOG)


def log_results(states: DataFrame, folder: str) -> None:
    """Write the results of attempts into the rows that were noted for them."""
    named = states.withColumnRenamed("attempt_id", "id")
    keyed.update(named, folder, "id", LOG, ["body", "data", "provider", "providerMessageId", "providerState"])


def task_update(changes: DataFrame, folder: str) -> None:
    """Write the states and times given in ``changes(id, state, timeLastProcessed)`` into the tasks."""
    keyed.update(changes, folder, "id", TASK, ["state", "timeLastProcessed"])


def task_progress(tasks: DataFrame, pending: DataFrame, providers: DataFrame) -> DataFrame:
    """``running`` for tasks with pending rows, ``done`` for those without."""
    left = pending.groupBy("taskId").agg(F.count("*").alias("n_pending"))
    loaded = tasks_with_provider(active_tasks(tasks), providers)
    return loaded.select(F.col("id").alias("taskId")).join(left, "taskId", "left").select(
        "taskId", F.coalesce("n_pending", F.lit(0)).cast("bigint").alias("n_pending"),
        F.when(F.coalesce("n_pending", F.lit(0)) == 0, F.lit("done")).otherwise(F.lit("running")).alias("state"))


def in_flight(mail_log: DataFrame) -> DataFrame:
    """Attempts without a result, per task."""
    open_rows = F.count_if(F.col("providerState").isNull())
    return mail_log.groupBy("taskId").agg(open_rows.alias("n_open"), (open_rows > 0).alias("in_flight"))


def distinct_providers(tasks: DataFrame) -> DataFrame:
    return tasks.select("provider").distinct()


def providers_in_use(providers: DataFrame, tasks: DataFrame) -> DataFrame:
    used = distinct_providers(active_tasks(tasks)).withColumnRenamed("provider", "id")
    return providers.join(used, "id", "left_semi")


def tasks_with_provider(tasks: DataFrame, providers: DataFrame) -> DataFrame:
    """Tasks whose provider is loaded and not stopping."""
    live = providers
    if "holder_state" in providers.columns:
        live = providers.where(F.col("holder_state") != "STOPPING")
    return tasks.join(live.select(F.col("id").alias("provider")), "provider", "left_semi").select(*tasks.columns)


def provider_has_tasks(providers: DataFrame, tasks: DataFrame) -> DataFrame:
    used = distinct_providers(tasks).select(F.col("provider").alias("id"), F.lit(True).alias("_used"))
    return providers.join(used, "id", "left").select(
        "id", F.coalesce("_used", F.lit(False)).alias("has_tasks"))


def providers_without_tasks(providers: DataFrame, tasks: DataFrame) -> DataFrame:
    return providers.select("id").subtract(distinct_providers(tasks).withColumnRenamed("provider", "id"))


def ids_minus_sent(ids: DataFrame, sent: DataFrame) -> DataFrame:
    return ids.select("taskId", "rowId").subtract(sent.select("taskId", "rowId").distinct())


def banned_until(failures: DataFrame, seconds: int = BAN_SECONDS) -> DataFrame:
    """End of each provider's exclusion; a later failure moves it."""
    end = F.max("fail_ts") + F.make_dt_interval(secs=F.lit(seconds))
    return failures.groupBy("provider").agg(end.alias("banned_until"))


def provider_ban(providers: DataFrame, failures: DataFrame, as_of: Column, seconds: int = BAN_SECONDS) -> DataFrame:
    """Providers that may be used at ``as_of``, by the failures seen up to then."""
    seen = failures.where(F.col("fail_ts") <= as_of)
    out = banned_until(seen, seconds).where(as_of < F.col("banned_until"))
    return providers.join(out.select(F.col("provider").alias("id")), "id", "left_anti")


def holds(held: Column, held_from: Column, new: Column, new_from: Column) -> Column:
    """Whether a configuration keeps all held values and its sender; extra new fields are allowed."""
    kept = F.forall(F.map_entries(held), lambda e: F.try_element_at(new, e["key"]).eqNullSafe(e["value"]))
    return F.coalesce(kept, F.lit(False)) & held_from.eqNullSafe(new_from)


def config_drift(held: DataFrame, new: DataFrame) -> DataFrame:
    """``changed``, ``same``, ``new`` or ``gone`` for ``(id, config map, from)`` tables.

    A field of the held configuration must keep its value; extra new fields are allowed.
    """
    h = held.select("id", F.col("config").alias("_hc"), F.col("from").alias("_hf"), F.lit(True).alias("_h"))
    n = new.select("id", F.col("config").alias("_nc"), F.col("from").alias("_nf"), F.lit(True).alias("_n"))
    same = holds(F.col("_hc"), F.col("_hf"), F.col("_nc"), F.col("_nf"))
    return h.join(n, "id", "full").select(
        "id",
        F.when(F.col("_h").isNull(), F.lit("new"))
        .when(F.col("_n").isNull(), F.lit("gone"))
        .when(same, F.lit("same")).otherwise(F.lit("changed")).alias("drift"))


def nested_drift(held: DataFrame, new: DataFrame) -> DataFrame:
    """``config_drift`` for nested configurations given as JSON text.

    The four outcomes are the same. Two null configurations are equal, a null and another are not. Only different texts
    that are both there are compared in Python.
    """
    h = held.select("id", F.col("config").alias("_hc"), F.col("from").alias("_hf"), F.lit(True).alias("_h"))
    n = new.select("id", F.col("config").alias("_nc"), F.col("from").alias("_nf"), F.lit(True).alias("_n"))
    both = h.join(n, "id", "full")
    differ = F.coalesce(F.col("_hc") != F.col("_nc"), F.lit(False))
    plain = both.where(~differ).withColumn("_same", F.col("_hc").eqNullSafe(F.col("_nc")))
    judged = plain.unionByName(both.where(differ).withColumn("_same", fn.nested_json_holds("_hc", "_nc")))
    return judged.select(
        "id",
        F.when(F.col("_h").isNull(), F.lit("new"))
        .when(F.col("_n").isNull(), F.lit("gone"))
        .when(F.col("_same") & F.col("_hf").eqNullSafe(F.col("_nf")), F.lit("same")).otherwise(F.lit("changed")).alias("drift"))


def require_body(messages: DataFrame) -> DataFrame:
    """Messages that cannot be composed, with the reason."""
    return messages.where(~fn.has_body(F.col("contentText"), F.col("contentHtml"))).select(
        "msg_id", F.lit("Mail should have text or html").alias("error"))


def mime_layout(messages: DataFrame) -> DataFrame:
    """Which multiparts a message needs."""
    related = F.exists("attachments", lambda a: a["isRelated"])
    mixed = F.exists("attachments", lambda a: ~a["isRelated"])
    html, text = F.col("contentHtml").isNotNull(), F.col("contentText").isNotNull()
    return messages.where(fn.has_body(F.col("contentText"), F.col("contentHtml"))).select(
        "*", html.alias("_html"), text.alias("_text"), (html & related).alias("_related"),
        (html & text).alias("_alternative"), mixed.alias("_mixed"))


def mime_plan(messages: DataFrame) -> DataFrame:
    """Nesting of each message as text, such as ``mixed[alternative[text, html], file]``."""
    d = mime_layout(messages)
    inline = F.transform(F.filter("attachments", lambda a: a["isRelated"]), lambda a: F.lit("inline"))
    loose = F.filter("attachments", lambda a: ~a["isRelated"] | ~F.col("_html"))
    files = F.transform(loose, lambda a: F.lit("file"))

    def group(name: str, parts: Column) -> Column:
        return F.concat(F.lit(name + "["), F.array_join(parts, ", "), F.lit("]"))

    html = F.when(F.col("_related"), group("related", F.concat(F.array(F.lit("html")), inline))).otherwise(F.lit("html"))
    body = (F.when(F.col("_alternative"), group("alternative", F.array(F.lit("text"), html)))
            .when(F.col("_html"), html).otherwise(F.lit("text")))
    plan = F.when(F.col("_mixed"), group("mixed", F.concat(F.array(body), files))).otherwise(body)
    return d.select("msg_id", plan.alias("plan"))


def mime_parts(messages: DataFrame) -> DataFrame:
    """One row per leaf part: where it sits, what it is and which attachment it carries."""
    d = mime_layout(messages)
    on = F.when(F.col("_mixed"), F.lit("mixed/")).otherwise(F.lit(""))
    alt = F.concat(on, F.when(F.col("_alternative"), F.lit("alternative/")).otherwise(F.lit("")))
    rel = F.concat(alt, F.when(F.col("_related"), F.lit("related/")).otherwise(F.lit("")))
    indexed = F.transform("attachments", lambda a, i: F.struct(i.alias("i"), a["isRelated"].alias("r"), a["mimeType"].alias("m")))

    def part(container: Column, kind: Column, mime: Column, attachment: Column) -> Column:
        return F.struct(container.alias("container"), kind.alias("kind"), mime.alias("mime"),
                        attachment.cast("int").alias("attachment"))

    text = F.when(F.col("_text"), F.array(part(alt, F.lit("text"), F.lit("text/plain"), F.lit(None))))
    html = F.when(F.col("_html"), F.array(part(rel, F.lit("html"), F.lit("text/html"), F.lit(None))))
    inline = F.when(F.col("_related"), F.transform(
        F.filter(indexed, lambda a: a["r"]), lambda a: part(rel, F.lit("inline"), a["m"], a["i"])))
    files = F.when(F.col("_mixed"), F.transform(
        F.filter(indexed, lambda a: ~a["r"] | ~F.col("_html")), lambda a: part(on, F.lit("file"), a["m"], a["i"])))
    none = F.array().cast("array<struct<container:string,kind:string,mime:string,attachment:int>>")
    parts = F.concat(*[F.coalesce(p, none) for p in (text, html, inline, files)])
    return d.select("msg_id", F.posexplode(parts).alias("part_no", "_p")).select("msg_id", "part_no", "_p.*")


def inbox_ingest(raw: DataFrame) -> DataFrame:
    """Inbox rows of ``raw(subject, from, recipients, date, raw)``."""
    return raw.select(
        "subject",
        fn.first_address(F.col("from")).alias("from"),
        fn.first_address(F.col("recipients")).alias("to"),
        "date",
        F.octet_length("raw").alias("size"),
        fn.fingerprint(F.col("date"), F.col("raw")).alias("fingerprint"),
        F.col("raw").alias("body"),
    )
