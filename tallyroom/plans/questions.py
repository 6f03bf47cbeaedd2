"""Questionnaire queries over the cells derived from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.functions import cells as fn
from tallyroom.operators import questions as qs
from tallyroom.operators import report, sheets
from tallyroom.plans import grid
from tallyroom.plans.questions_sql import ORACLES  # noqa: F401
from tallyroom.sources.tables import read_table
from tallyroom.workspace import stage


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return sheets.split_questions(sheets.row_facts(grid.cells(spark, d)))


def _heads(rows: DataFrame) -> DataFrame:
    return sheets.known_type(sheets.question_type(rows)).drop("rules")


def _matched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = sheets.split_questions(sheets.row_facts(grid.cells(spark, d)), written=True)
    heads = stage(_heads(rows))
    return qs.match_fields(rows, heads), heads


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return stage(qs.place_rows(stage(_matched(spark, d)[0])))


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    placed = _placed(spark, d)
    return placed, stage(qs.tables_of(placed, qs.mark_duplicates(placed)))


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    placed, tables = _tables(spark, d)
    return qs.row_fields(qs.content_rows(placed, tables)), tables


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return stage(report.convert(grid.cells(spark, d)))


def sheet_rows(spark, d):
    return sheets.sheet_rows(grid.cells(spark, d))


def cell_at(spark, d):
    return sheets.cell_at(grid.cells(spark, d), 2)


def cell_slice(spark, d):
    return sheets.cell_slice(grid.cells(spark, d), 1, 4)


def cell_string(spark, d):
    return sheets.with_values(sheets.first_sheet(grid.cells(spark, d))).select("workbook_id", "row_idx", "col_idx", "text")


def cell_json(spark, d):
    return sheets.with_values(sheets.first_sheet(grid.cells(spark, d))).select("workbook_id", "row_idx", "col_idx", "literal")


def cell_bool(spark, d):
    c = sheets.with_values(sheets.first_sheet(grid.cells(spark, d)))
    return c.select("workbook_id", "row_idx", "col_idx", fn.cell_bool(F.col("text"), F.col("literal")).alias("truth"),
                    fn.cell_bool_error(F.col("text"), F.col("literal")).alias("error"))


def is_blank(spark, d):
    c = sheets.with_values(sheets.first_sheet(grid.cells(spark, d)))
    return c.select("workbook_id", "row_idx", "col_idx", fn.is_blank(F.col("text")).alias("blank"),
                    fn.is_commented(F.col("text")).alias("commented"))


def row_all_blank(spark, d):
    return sheets.row_all_blank(grid.cells(spark, d))


def skip_blank_comment(spark, d):
    return sheets.skip_blank_comment(sheets.row_facts(grid.cells(spark, d))).select("workbook_id", "row_idx", "first_text")


def split_questions(spark, d):
    return _rows(spark, d).select("workbook_id", "row_idx", "q_seq")


def segment_rows(spark, d):
    """Turns of conversations as rows: a user turn starts a segment, a system turn is a comment."""
    first = F.when(F.col("role") == "user", "u").when(F.col("role") == "system", "#").otherwise("")
    skipped = F.col("role") == "system"
    rows = read_table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("workbook_id"), F.col("turn").alias("row_idx"), first.alias("c0"),
        F.lit("x").alias("c1"), skipped.alias("skipped"))
    return sheets.split_questions(rows).select("workbook_id", "row_idx", "q_seq")


def drop_leading(spark, d):
    return sheets.drop_leading(_rows(spark, d)).select("workbook_id", "q_seq", "row_idx")


def question_type(spark, d):
    return sheets.question_type(_rows(spark, d)).select("workbook_id", "q_seq", "qid", "type_row", "qtype", "fatal")


def known_type(spark, d):
    return _heads(_rows(spark, d)).select("workbook_id", "q_seq", "qtype", "fatal")


def match_fields(spark, d):
    return _matched(spark, d)[0].select("workbook_id", "q_seq", "row_idx", "field", "kind", "target")


def label_predicates(spark, d):
    """Which kinds of predicate hold for each label, whatever the question's type."""
    c1 = F.col("text")
    labels = sheets.cell_at(grid.cells(spark, d), 1)
    holds = lambda kind, *p: fn.label_matches(c1, F.lit(kind), F.array(*[F.lit(x) for x in p]))
    return labels.where(c1.isNotNull()).select(
        "workbook_id", "row_idx", holds("pool", "optional", "cond").alias("pool"), holds("contains_any", "te", "oc").alias("contains"),
        holds("prefix", "js-").alias("prefix"), F.when(holds("prefix", "js-"), F.substr(c1, F.lit(4))).alias("rest"))


def table_extent(spark, d):
    return qs.table_extent(_placed(spark, d))


def merge_unrecognized(spark, d):
    return qs.merge_unrecognized(_placed(spark, d)).select("workbook_id", "q_seq", "row_idx", "last_row", "error")


def duplicate_field(spark, d):
    placed = _placed(spark, d)
    return qs.duplicate_field(placed, qs.mark_duplicates(placed))


def pair_value(spark, d):
    return qs.pair_values(qs.mark_duplicates(_placed(spark, d))).select("workbook_id", "q_seq", "seq", "k", "v")


def block_condition(spark, d):
    return sheets.cell_at(grid.cells(spark, d), 2).select(
        "workbook_id", "row_idx", fn.block_condition(F.coalesce("text", F.lit(""))).alias("cond"))


def and_conditions(spark, d):
    """All labels of a question as code of one property."""
    rows = _rows(spark, d).where(F.col("c1") != "").select(*qs.Q, "row_idx", F.lit("cond").alias("target"), F.col("c1").alias("code"))
    return qs.and_conditions(rows).select(*qs.Q, F.col("code").alias("cond"))


def table_columns(spark, d):
    return qs.table_columns(*_tables(spark, d))


def match_columns(spark, d):
    tables = _tables(spark, d)[1]
    return tables.select(*qs.TABLE, F.explode("columns").alias("c")).select(*qs.TABLE, "c.*")


def columns_by_kind(spark, d):
    return qs.columns_by_kind(_tables(spark, d)[1])


def drop_null_fields(spark, d):
    return qs.drop_null_fields(_items(spark, d)[0])


def project_fields(spark, d):
    rows = _items(spark, d)[0].where(F.col("field") == "groupItems")
    return rows.select(*qs.Q, "row_idx", fn.compact(fn.json_object(qs.project_fields(F.col("fields")))).alias("item"))


def image_cells(spark, d):
    rows = _items(spark, d)[0].where(F.col("field") == "conjointItems")
    return rows.select(*qs.Q, "row_idx", fn.compact(fn.json_object(qs.image_cells(F.col("fields")))).alias("item"))


def shuffle_summary(spark, d):
    return qs.shuffle_summary(_items(spark, d)[0]).withColumn("shuffleItems", fn.compact(F.col("shuffleItems")))


def build_rows(spark, d):
    return qs.build_rows(*_items(spark, d)).select(*qs.TABLE, "prop", fn.compact(F.col("items")).alias("items"))


def property_list(spark, d):
    return qs.property_list(qs.build_rows(*_items(spark, d)))


def group_items(spark, d):
    return qs.group_items(_items(spark, d)[0]).withColumn("items", fn.compact(F.col("items")))


def nest_items_in_groups(spark, d):
    return qs.nest_items_in_groups(_items(spark, d)[0]).withColumn("v", fn.compact(F.col("v")))


def alias_code(spark, d):
    return qs.alias_code(_items(spark, d)[0])


def row_text(spark, d):
    return sheets.row_facts(grid.cells(spark, d)).select("workbook_id", "row_idx", fn.row_text(F.col("cells")).alias("shown"))


def cell_coords(spark, d):
    return sheets.first_sheet(grid.cells(spark, d)).select(
        "workbook_id", "row_idx", "col_idx", fn.cell_coords(F.col("row_idx"), F.col("col_idx")).alias("coords"))


def row_range(spark, d):
    """Each question's rows as one place."""
    rows = _rows(spark, d).groupBy(*qs.Q).agg(F.min("row_idx").alias("a"), F.max("row_idx").alias("z"), F.min_by("cells", "row_idx").alias("cells"))
    return rows.select(*qs.Q, fn.row_range(F.col("a"), F.col("z"), fn.row_text(F.col("cells"))).alias("place"))


def error_text(spark, d):
    """An error per question with as much of its place as is known."""
    heads = sheets.question_type(_rows(spark, d))
    return heads.select(*qs.Q, fn.error_text(
        F.lit("Odd"), F.nullif("qid", F.lit("Q7")), F.nullif("qtype", F.lit("Info")), F.format_string("row %d", "type_row")).alias("error"))


def fold_question(spark, d):
    return report.convert(grid.cells(spark, d)).where(F.col("fatal").isNull()).select(*qs.Q, "qid", "qtype", fn.compact(F.col("doc")).alias("body"))


def question_errors(spark, d):
    return report.convert(grid.cells(spark, d)).select(*qs.Q, F.array_join("errors", "\n").alias("errors"), "fatal")


def duplicate_qids(spark, d):
    return report.duplicate_qids(_questions(spark, d)).select("workbook_id", "note")


def union_notifications(spark, d):
    return report.union_notifications(_questions(spark, d))


def severity_report(spark, d):
    return report.severity_report(_questions(spark, d))


def render_module(spark, d):
    return report.render_module(_questions(spark, d))


def _failed(spark, d):
    catalog = _catalog(spark, d)
    return catalog.where(F.col("error").isNotNull()).select(F.col("path").alias("workbook_id"), "error")


def result_json(spark, d):
    return report.result_json(_questions(spark, d), _failed(spark, d))


def code_unquote(spark, d):
    """Question documents with their code out of quotes."""
    return report.convert(grid.cells(spark, d)).where(F.col("fatal").isNull()).select(*qs.Q, fn.code_unquote(F.col("doc")).alias("code"))


def _catalog(spark, d):
    """Parts as paths: five kinds of extension, some files missing."""
    key = F.col("p_partkey")
    ext = F.element_at(F.array(*[F.lit(e) for e in ("xls", "xlsx", "csv", "XLS", "x%6Cs")]), (key % 5 + 1).cast("int"))
    path = F.concat(F.lit("/in/"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("."), key, F.lit("."), ext)
    return sheets.workbook_catalog(read_table(spark, d, "part").select(path.alias("path"), (key % 13 != 0).alias("found")))


def workbook_catalog(spark, d):
    return _catalog(spark, d)


QUERIES = {f.__name__: f for f in [
    sheet_rows, cell_at, cell_slice, cell_string, cell_json, cell_bool, is_blank, row_all_blank,
    skip_blank_comment, split_questions, segment_rows, drop_leading, question_type, known_type,
    match_fields, label_predicates, table_extent, merge_unrecognized, duplicate_field, pair_value,
    block_condition, and_conditions, table_columns, match_columns, columns_by_kind, drop_null_fields,
    project_fields, image_cells, shuffle_summary, build_rows, property_list, group_items,
    nest_items_in_groups, alias_code, row_text, cell_coords, row_range, error_text, fold_question,
    question_errors, duplicate_qids, union_notifications, severity_report, render_module,
    result_json, code_unquote, workbook_catalog,
]}
QUERIES["is_commented"] = is_blank
