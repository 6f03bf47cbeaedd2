"""Cells to rows to questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.functions import cells as fn
from tallyroom.operators.dictionary import types_table
from tallyroom.operators.ordered import running

# Rows of a sheet that one task orders at once; larger sheets are cut at this many.
ROWS_AT_ONCE = 4096


def row_bucket() -> Column:
    return F.floor(F.col("row_idx") / ROWS_AT_ONCE).cast("bigint")


def first_sheet(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("sheet_idx") == 0)


def with_values(cells: DataFrame) -> DataFrame:
    """Cells with their text and JSON literal."""
    parts = [F.col(c) for c in ("cell_type", "str", "num", "bool")]
    return cells.select("*", fn.cell_string(*parts).alias("text"), fn.cell_json(*parts, F.col("fmt")).alias("literal"))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """Every index from the first to the last row of the first sheet; gaps are absent rows.

    Rows of sheets meet by sorting: what cells unfold to is not in Spark's estimate, by which it would broadcast them.
    """
    present = first_sheet(cells).groupBy("workbook_id", "row_idx").agg(F.count("*").alias("n_cells"))
    extent = present.groupBy("workbook_id").agg(F.min("row_idx").alias("lo"), F.max("row_idx").alias("hi"))
    every = extent.select("workbook_id", F.explode(F.sequence("lo", "hi")).alias("row_idx"))
    return every.join(present.hint("merge"), ["workbook_id", "row_idx"], "left")


def cell_at(cells: DataFrame, col: int) -> DataFrame:
    """Text and literal at one column of every present row of the first sheet."""
    here = F.col("col_idx") == col
    return with_values(first_sheet(cells)).groupBy("workbook_id", "row_idx").agg(
        F.max(F.when(here, F.col("text"))).alias("text"), F.max(F.when(here, F.col("literal"))).alias("literal"))


def cell_slice(cells: DataFrame, begin: int, end: int) -> DataFrame:
    """Columns ``begin`` to ``end`` of every present row, padded with absent cells."""
    valued = with_values(first_sheet(cells))
    listed = F.collect_list(F.when(F.col("col_idx").between(begin, end), F.struct("col_idx", "text")))
    rows = valued.groupBy("workbook_id", "row_idx").agg(F.map_from_entries(listed).alias("m"))
    return rows.select("workbook_id", "row_idx", F.explode(F.sequence(F.lit(begin), F.lit(end))).alias("col_idx"), "m").select(
        "workbook_id", "row_idx", "col_idx", F.try_element_at("m", F.col("col_idx")).alias("text"))


def row_facts(cells: DataFrame) -> DataFrame:
    """One record per present row of the first sheet, with its cells in column order.

    A row holds at most the columns of the sheet format, so its cells fit in one record.
    Cells are spread by workbook and range of rows, which serves the ordered steps after it.
    """
    valued = with_values(first_sheet(cells)).withColumn("row_block", row_bucket()).repartition("workbook_id", "row_block")
    at = lambda i, what: F.max(F.when(F.col("col_idx") == i, F.col(what)))
    blank = fn.is_blank(F.col("text"))
    cell = F.struct("col_idx", "text", "literal")
    facts = valued.groupBy("workbook_id", "row_block", "row_idx").agg(
        F.coalesce(at(0, "text"), F.lit("")).alias("c0"),
        F.coalesce(at(1, "text"), F.lit("")).alias("c1"),
        F.coalesce(at(2, "text"), F.lit("")).alias("c2"),
        at(2, "literal").alias("literal2"),
        F.max(F.col("col_idx") == 2).alias("has_c2"),
        F.bool_and(blank).alias("all_blank"),
        F.min(F.when(~blank, F.struct("col_idx", "text")))["text"].alias("first_text"),
        F.min(F.when(fn.is_unreadable(F.col("cell_type")), F.col("col_idx"))).alias("unreadable"),
        F.sort_array(F.collect_list(cell)).alias("cells"))
    skipped = F.col("first_text").isNull() | fn.is_commented(F.col("first_text"))
    return facts.select("*", skipped.alias("skipped"))


def row_all_blank(cells: DataFrame) -> DataFrame:
    """Rows of the first sheet with whether they exist and are blank; absent rows are not blank."""
    facts = row_facts(cells).select("workbook_id", "row_idx", "all_blank")
    return sheet_rows(cells).join(facts.hint("merge"), ["workbook_id", "row_idx"], "left").select(
        "workbook_id", "row_idx", F.coalesce("all_blank", F.lit(False)).alias("all_blank"))


def skip_blank_comment(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("skipped"))


def starts_question(first_cell: Column) -> Column:
    return ~fn.is_blank(first_cell) & ~fn.is_commented(first_cell)


def split_questions(rows: DataFrame, written: bool = False) -> DataFrame:
    """Rows of ``row_facts`` with ``q_seq`` and ``island``.

    A question starts where the first cell is neither blank nor a comment. Leading blank and
    comment rows are dropped, and the first row left always starts one. ``island`` is equal
    for adjacent rows with a non-blank second cell and different across any gap.
    ``written`` evaluates the rows once, see ``running``.
    """
    flag = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0))
    starts = starts_question(F.col("c0"))
    counted = running(
        rows, ["workbook_id"], ["row_idx"], F.col("row_block") if "row_block" in rows.columns else row_bucket(),
        partitioned="row_block" in rows.columns, once=True, written=written,
        sums={"_kept": flag(~F.col("skipped")), "_starts": flag(starts), "_labelled": flag(F.col("c1") != "")},
        mins={"_lead": F.when(~F.col("skipped"), F.col("row_idx").cast("bigint") * 2 + flag(starts))})  # one number, which hash aggregation can hold
    orphan = F.when(F.col("_lead") % 2 == 0, F.lit(1)).otherwise(F.lit(0))
    return counted.where(F.col("_kept") > 0).select(
        *[c for c in rows.columns if c != "row_block"],
        (F.col("_starts") + orphan).alias("q_seq"),
        F.when(F.col("c1") != "", F.col("row_idx") - F.col("_labelled")).alias("island"))


def drop_leading(rows: DataFrame) -> DataFrame:
    """Rows of each question from the first one with a non-blank second cell."""
    first = F.min(F.when(F.col("c1") != "", F.col("row_idx")))
    heads = rows.groupBy("workbook_id", "q_seq").agg(first.alias("_from"))
    return rows.join(heads.hint("merge"), ["workbook_id", "q_seq"]).where(F.col("row_idx") >= F.col("_from")).drop("_from")


def question_type(rows: DataFrame) -> DataFrame:
    """One record per question: its id, its type and what is fatally wrong with it.

    Comment rows are not skipped here. Only aggregates, so any question size will do. A cell that cannot be read, outside comment
    rows, is fatal to its question before anything else; those before the first question belong to none.
    """
    label = F.struct("row_idx", "c1", "c2", "has_c2")
    unreadable = F.col("unreadable") if "unreadable" in rows.columns else F.lit(None).cast("int")
    lost = unreadable.isNotNull() & ~fn.is_commented(F.col("first_text")) if "unreadable" in rows.columns else F.lit(False)
    heads = rows.groupBy("workbook_id", "q_seq").agg(
        F.min_by("c0", "row_idx").alias("qid"),
        F.min(F.when(F.col("c1") != "", label)).alias("_t"),
        F.min(F.when(lost, F.struct("row_idx", unreadable.alias("col_idx")))).alias("_lost"))
    nowhere = fn.cell_place(F.col("_lost.row_idx"), F.col("_lost.col_idx"), F.lit(""), F.lit(True))
    labelled = F.lower("_t.c1") == "type"
    place = fn.cell_place(F.col("_t.row_idx"), F.lit(1), F.col("_t.c1"), F.lit(True))
    not_found = F.lit("Question type not found")
    return heads.select(
        "workbook_id", "q_seq", "qid", F.col("_t.row_idx").alias("type_row"),
        F.when(labelled, F.col("_t.c2")).alias("qtype"),
        F.coalesce("_t.has_c2", F.lit(False)).alias("has_type_cell"),
        F.when(F.col("_lost").isNotNull(), fn.error_text(F.lit("Unreadable cell"), F.col("qid"), place=nowhere))
        .when(F.col("_t").isNull(), fn.error_text(not_found, F.col("qid")))
        .when(~labelled, fn.error_text(not_found, F.col("qid"), place=place)).alias("fatal"))


def known_type(heads: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Heads with the rules of their type; an unknown type is fatal. Types are a fixed list."""
    types = types_table(heads.sparkSession) if types is None else types
    place = fn.cell_place(F.col("type_row"), F.lit(2), F.col("qtype"), F.col("has_type_cell"))
    unknown = F.col("fatal").isNull() & F.col("rules").isNull()
    text = fn.error_text(F.lit("Unrecognized question type"), F.col("qid"), place=place)
    return heads.join(F.broadcast(types), "qtype", "left").select(
        *[c for c in heads.columns if c != "fatal"], "rules",
        F.when(unknown, text).otherwise(F.col("fatal")).alias("fatal"))


def workbook_catalog(paths: DataFrame) -> DataFrame:
    """Route of each file of ``(path, found)``: read it, or the error text.

    The extension is taken before the path is decoded, and its case matters.
    """
    extension = F.element_at(F.split("path", "\\."), -1)
    decoded = F.url_decode("path")
    return paths.select(
        "path",
        F.when(F.col("found") & extension.isin("xls", "xlsx"), decoded).alias("read_from"),
        F.when(~F.col("found"), F.concat(F.lit("File Not Found: "), "path"))
        .when(~extension.isin("xls", "xlsx"), F.lit("Only xls and xlsx formats are supported")).alias("error"))
