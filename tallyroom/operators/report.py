"""Workbook results: duplicate ids, reports, modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.functions import cells as fn
from tallyroom.operators import questions as qs
from tallyroom.operators import sheets
from tallyroom.workspace import stage

# The text around a module. {notes} and {questions} are filled in.
MODULE_TEXT = """
 // GENERATED FROM EXCEL FILE
 // DO NOT MODIFY THIS FILE
 // CONSIDER MODIFYING ORIGINAL EXCEL FILE
 
 define(["require", "lib/GenericFormModel"], function (requirejs, GenericFormModel) {
   return function () {
       var qs = [];

       var model = new GenericFormModel();
       var alias = requirejs("lib/AliasPlugin").fromModel(model);

       {notes}

       {questions}

       var data = {
            "questions": qs
       };

       model.setData(data)
       return model;

    }
 });

    """
SECTIONS = ["FATAL ERRORS:", "ERRORS:", "WARNINGS:", "NOTIFICATIONS:"]
BETWEEN_QUESTIONS = "\r\n\r\n       "


def line_breaks(text: Column, extra: int = 0) -> Column:
    """Lines of a text set in by the depth of a module's body; trailing empty lines go."""
    return F.replace(F.regexp_replace(text, "\n+$", ""), F.lit("\n"), F.lit("\n" + " " * (7 + extra)))


def convert(cells: DataFrame) -> DataFrame:
    """Questions of all workbooks: ``(workbook_id, q_seq, qid, qtype, doc, code, fatal, errors, warnings)``.

    What several branches read is written once.
    """
    rows = sheets.split_questions(sheets.row_facts(cells), written=True)
    heads = stage(sheets.known_type(sheets.question_type(rows)).drop("rules"))
    placed = stage(qs.place_rows(stage(qs.match_fields(rows, heads))))
    marked = stage(qs.mark_duplicates(placed))
    tables = stage(qs.tables_of(placed, marked))
    items = stage(qs.row_fields(qs.content_rows(placed, tables)))

    lost = qs.table_fatals(tables)
    heads = heads.join(lost, qs.Q, "left").withColumn("fatal", F.coalesce("fatal", "table_fatal")).drop("table_fatal")
    docs = qs.fold_question(heads, qs.apply_fields(marked, items, tables))

    told = qs.question_errors(placed, marked, items, tables)
    errors = told.groupBy(*qs.Q).agg(F.sort_array(F.collect_list(F.struct("part", "seq", "sub", "error"))).alias("_e"))
    warned = qs.question_warnings(items).groupBy(*qs.Q).agg(F.sort_array(F.collect_list(F.struct("seq", "warning"))).alias("_w"))
    none = F.array().cast("array<string>")
    full = heads.select(*qs.Q, "fatal").join(docs, qs.Q, "left").join(errors, qs.Q, "left").join(warned, qs.Q, "left")
    sound = F.col("fatal").isNull()
    return full.select(
        *qs.Q, "qid", "qtype", "doc", "code", "fatal",
        F.when(sound, F.coalesce(F.transform("_e", lambda x: x["error"]), none)).otherwise(none).alias("errors"),
        F.when(sound, F.coalesce(F.transform("_w", lambda x: x["warning"]), none)).otherwise(none).alias("warnings"))


def duplicate_qids(questions: DataFrame) -> DataFrame:
    """Ids used by several sound questions of a workbook."""
    counted = questions.where(F.col("fatal").isNull() & F.col("qid").isNotNull()).groupBy("workbook_id", "qid").agg(
        F.count("*").alias("n"), F.min("q_seq").alias("q_seq"))
    return counted.where(F.col("n") > 1).select("workbook_id", "q_seq", F.concat(
        F.lit("Duplicate question id "), "qid", F.lit(": repeated "), F.col("n") - 1, F.lit(" times")).alias("note"))


def union_notifications(questions: DataFrame) -> DataFrame:
    """All messages ``(workbook_id, section, q_seq, pos, message)`` in the order of the report."""
    fatal = questions.where(F.col("fatal").isNotNull()).select("workbook_id", F.lit(0).alias("section"), "q_seq", F.lit(0).alias("pos"), F.col("fatal").alias("message"))
    each = lambda n, c: questions.select("workbook_id", F.lit(n).alias("section"), "q_seq", F.posexplode(c).alias("pos", "message"))
    notes = duplicate_qids(questions).select("workbook_id", F.lit(3).alias("section"), "q_seq", F.lit(0).alias("pos"), F.col("note").alias("message"))
    return fatal.unionByName(each(1, "errors")).unionByName(each(2, "warnings")).unionByName(notes)


def severity_report(questions: DataFrame) -> DataFrame:
    """Report per workbook: non-empty sections under headings, a blank line between them."""
    said = union_notifications(questions)
    line = F.struct("q_seq", "pos", "message")
    sections = said.groupBy("workbook_id", "section").agg(F.sort_array(F.collect_list(line)).alias("l"))
    text = F.concat_ws("\n", F.element_at(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section") + 1),
                       F.array_join(F.transform("l", lambda x: x["message"]), "\n"))
    joined = sections.select("workbook_id", F.struct("section", text.alias("t")).alias("s")).groupBy("workbook_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["t"]), "\n\n").alias("notifications"))
    return questions.select("workbook_id").distinct().join(joined, "workbook_id", "left").select(
        "workbook_id", F.coalesce("notifications", F.lit("")).alias("notifications"))


def question_text(questions: DataFrame) -> DataFrame:
    """Each question as it stands in the module."""
    comment = lambda t: F.concat(F.lit("/* "), t, F.lit(" */"))
    notes = F.array_join(F.transform("errors", lambda e: F.concat(comment(line_breaks(e, 2)), F.lit(" \n       "))), "")
    push = F.concat(notes, F.lit("qs.push("), line_breaks(F.col("doc")), F.lit(")"))
    return questions.select("workbook_id", "q_seq", F.when(F.col("fatal").isNotNull(), comment(F.col("fatal")))
                            .when(F.col("qtype") == "JsCode", line_breaks(F.coalesce("code", F.lit(""))))
                            .otherwise(push).alias("text"))


def render_module(questions: DataFrame) -> DataFrame:
    """Module text per workbook; a workbook is at most one sheet of rows."""
    body = question_text(questions).groupBy("workbook_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("q_seq", "text"))), lambda x: x["text"]), BETWEEN_QUESTIONS).alias("body"))
    notes = duplicate_qids(questions).groupBy("workbook_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("q_seq", "note"))), lambda x: F.concat(F.lit("/* "), x["note"], F.lit(" */"))), "").alias("notes"))
    head, rest = MODULE_TEXT.split("{notes}")
    middle, tail = rest.split("{questions}")
    js = F.concat(F.lit(head), F.coalesce("notes", F.lit("")), F.lit(middle), "body", F.lit(tail))
    return body.join(notes, "workbook_id", "left").select("workbook_id", fn.code_unquote(js).alias("js"))


def result_json(questions: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """``{js, notifications}`` per converted workbook, ``{error}`` per one that was not read."""
    kv = lambda k, c: F.struct(F.lit(k).alias("k"), fn.json_quote(F.col(c)).alias("v"))
    done = render_module(questions).join(severity_report(questions), "workbook_id").select(
        "workbook_id", fn.json_object(F.array(kv("js", "js"), kv("notifications", "notifications"))).alias("json"))
    if failed is None:
        return done
    return done.unionByName(failed.select("workbook_id", fn.json_object(F.array(kv("error", "error"))).alias("json")))


def write_results(results: DataFrame, folder: str) -> None:
    """One text file per workbook under ``workbook_id=…``."""
    results.repartition("workbook_id").select("workbook_id", F.col("json").alias("value")).write.mode(
        "overwrite").partitionBy("workbook_id").text(folder)
