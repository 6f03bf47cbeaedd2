"""Rows of questions to question documents with their errors.

Everything is keyed by ``(workbook_id, q_seq)`` or finer. Ordered steps use ``running``, the
rest are aggregates and equi-joins, sorted where a side grows with the rows, since written tables are estimated
by their packed size, by which Spark would broadcast millions of rows; only documents themselves are collected, each bounded
by the rows of one sheet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.functions import cells as fn
from tallyroom.operators import registry, sheets
from tallyroom.operators.dictionary import columns_table, types_table
from tallyroom.operators.ordered import running
from tallyroom.workspace import stage

Q = ["workbook_id", "q_seq"]
TABLE = [*Q, "title_row"]
ENTRY = "array<struct<seq:int,sub:int,k:string,v:string>>"


def first_match(label: Column, rules: Column) -> Column:
    """First rule of an ordered array whose predicate holds."""
    return F.get(F.filter(rules, lambda r: fn.label_matches(label, r["match_kind"], r["patterns"])), 0)


def match_fields(rows: DataFrame, heads: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Rows after the type row with the first field of their type that takes them.

    The rules of a type are one array on a broadcast row, so each row is matched in place.
    """
    types = types_table(rows.sparkSession) if types is None else types
    sound = heads.where(F.col("fatal").isNull()).select(*Q, "qid", "qtype", "type_row")
    content = rows.join(sound.hint("merge"), Q).where(F.col("row_idx") > F.col("type_row"))
    matched = content.join(F.broadcast(types), "qtype").withColumn("_m", first_match(F.col("c1"), F.col("rules")))
    target = F.coalesce("_m.target", F.when(F.col("_m.field") == "js", F.substr("c1", F.lit(4))))
    return matched.select(
        *rows.columns, "qid", "qtype", F.col("_m.field").alias("field"), F.col("_m.kind").alias("kind"), target.alias("target"))


def place_rows(matched: DataFrame) -> DataFrame:
    """Add ``status``: field, body, skipped or unmatched.

    A table runs from its title to the last row of the island of labelled rows, whatever
    the rows in between look like; the title is the island's first row that a table takes. Titles
    are few and found on the map side; the rows are read twice, so callers write them first.
    """
    run = F.coalesce("island", -F.col("row_idx") - 10)
    rows = matched.withColumn("run", run)
    titles = rows.where(~F.col("skipped") & (F.col("kind") == "table")).groupBy(*Q, "run").agg(F.min("row_idx").alias("_title"))
    placed = rows.join(titles.hint("merge"), [*Q, "run"], "left")
    in_body = F.coalesce(F.col("_title") < F.col("row_idx"), F.lit(False))
    return placed.select(
        *matched.columns, "run", F.when(F.col("_title") <= F.col("row_idx"), F.col("_title")).alias("title_row"),
        F.when(in_body, F.lit("body")).when(F.col("skipped"), F.lit("skipped"))
        .when(F.col("field").isNull(), F.lit("unmatched")).otherwise(F.lit("field")).alias("status"))


def table_extent(placed: DataFrame) -> DataFrame:
    """First and last row of each table, title included."""
    rows = placed.where(F.col("title_row").isNotNull() & ((F.col("status") == "body") | (F.col("row_idx") == F.col("title_row"))))
    return rows.groupBy(*TABLE).agg(F.max("row_idx").alias("last_row"))


def mark_duplicates(placed: DataFrame) -> DataFrame:
    """Field rows with the first row on which the question already used the field."""
    fields = placed.where(F.col("status") == "field")
    first = fields.groupBy(*Q, "field").agg(F.min("row_idx").alias("first_row"))
    return fields.join(first.hint("merge"), [*Q, "field"]).select(*fields.columns, "first_row")


def duplicate_field(placed: DataFrame, marked: DataFrame) -> DataFrame:
    """Errors for second and later matches of a field, naming the first place."""
    ends = table_extent(placed)
    spot = marked.join(ends.withColumnRenamed("title_row", "row_idx"), [*Q, "row_idx"], "left").select(
        *Q, "row_idx", "qid", "qtype", "first_row",
        fn.row_range(F.col("row_idx"), F.coalesce("last_row", "row_idx"), fn.row_text(F.col("cells"))).alias("place"))
    again = spot.where(F.col("first_row") < F.col("row_idx"))
    first = spot.select(*Q, F.col("row_idx").alias("first_row"), F.col("place").alias("first_place"))
    base = F.concat(F.lit("This field was already processed(here: "), "first_place", F.lit(")"))
    return again.join(first, [*Q, "first_row"]).select(
        *Q, "row_idx", fn.error_text(base, F.col("qid"), F.col("qtype"), F.col("place")).alias("error"))


def merge_unrecognized(placed: DataFrame) -> DataFrame:
    """One error per run of adjacent unmatched rows."""
    odd = placed.where(F.col("status") == "unmatched")
    counted = running(odd, Q, ["row_idx"], sheets.row_bucket(), sums={"_n": F.lit(1)})
    runs = counted.groupBy(*Q, (F.col("row_idx") - F.col("_n")).alias("_run")).agg(
        F.first("qid").alias("qid"), F.first("qtype").alias("qtype"), F.min("row_idx").alias("row_idx"),
        F.max("row_idx").alias("last_row"), F.min_by("cells", "row_idx").alias("cells"))
    place = fn.row_range(F.col("row_idx"), F.col("last_row"), fn.row_text(F.col("cells")))
    return runs.select(*Q, "row_idx", "last_row", fn.error_text(
        F.lit("Unrecognized field(s)"), F.col("qid"), F.col("qtype"), place).alias("error"))


def pair_values(marked: DataFrame, join_conditions: bool = False) -> DataFrame:
    """Properties of label-value rows; a blank value is a null property, code is marked.

    With ``join_conditions`` repeated code fields are joined by ``&&`` instead of refused.
    """
    single = F.col("first_row") == F.col("row_idx")
    take = single | (F.lit(join_conditions) & (F.col("kind") == "code"))
    code = registry.transform_value(F.col("field"), F.col("c2"))
    rows = marked.where((F.col("kind") != "table") & take).withColumn("code", F.when(F.col("kind") == "code", code))
    if join_conditions:
        rows = and_conditions(rows)
    value = F.coalesce(fn.json_quote(fn.code_mark(F.col("code"))), "literal2", F.lit("null"))
    return rows.select(*Q, F.col("row_idx").alias("seq"), F.lit(0).alias("sub"), F.col("target").alias("k"), value.alias("v"))


def and_conditions(rows: DataFrame) -> DataFrame:
    """Code of all rows of a question with the same property, joined in row order."""
    codes = F.transform(F.sort_array(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("row_idx", "code")))), lambda x: x["code"])
    first = F.min_by(F.struct(*[c for c in rows.columns if c not in (*Q, "target", "code")]), "row_idx")
    return rows.groupBy(*Q, "target", F.col("code").isNull().alias("_p")).agg(
        first.alias("_r"), F.array_join(codes, " && ").alias("_code")).select(
        *Q, "target", "_r.*", F.when(~F.col("_p"), F.col("_code")).alias("code"))


def match_columns(headers: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Header cells of each table with the first column rule that takes them.

    ``headers(…, field, cells)`` has one record per table; cells without a rule keep null.
    """
    columns = columns_table(headers.sparkSession) if columns is None else columns

    def column(c: Column) -> Column:
        rule = first_match(c["text"], F.col("columns"))
        prop = F.when(rule["kind"] == "item", F.coalesce(rule["target"], c["text"]))
        return F.struct(c["col_idx"], c["text"].alias("header"), rule["kind"].alias("kind"), prop.alias("prop"))

    labelled = F.filter("cells", lambda c: ~fn.is_blank(c["text"]))
    return headers.join(F.broadcast(columns), "field").select(
        *[c for c in headers.columns if c != "cells"], F.transform(labelled, column).alias("columns"))


def tables_of(placed: DataFrame, marked: DataFrame) -> DataFrame:
    """Tables to apply, with their matched columns; ``columns`` is null for an empty table."""
    titles = marked.where((F.col("kind") == "table") & (F.col("first_row") == F.col("row_idx"))).select(
        *Q, "title_row", "qid", "qtype", "field", F.col("target").alias("prop"), fn.row_text(F.col("cells")).alias("title_text"))
    head = placed.where((F.col("status") == "body") & (F.col("row_idx") == F.col("title_row") + 1)).select(*TABLE, "cells", F.lit(True).alias("_head"))
    headed = stage(titles.join(head.hint("merge"), TABLE, "left"))
    matched = match_columns(headed.where("_head").drop("_head"))
    empty = headed.where("_head is null").drop("cells", "_head").withColumn("columns", F.lit(None).cast(matched.schema["columns"].dataType))
    return matched.select(*empty.columns).unionByName(empty)


def columns_by_kind(tables: DataFrame) -> DataFrame:
    """How many columns of each table are items, shuffles or unknown, and their headers."""
    c = F.explode("columns").alias("c")
    long = tables.select(*TABLE, c)
    kind = F.coalesce("c.kind", F.lit("undefined"))
    return long.groupBy(*TABLE).agg(*[
        F.count_if(kind == k).alias(f"n_{k}") for k in ("item", "shuffle", "undefined")])


def table_columns(placed: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables turned on their side: each content cell under its header, comments dropped."""
    body = content_rows(placed, tables)
    cell = body.select(*TABLE, "row_idx", "columns", F.explode("cells").alias("c"))
    header = F.get(F.filter("columns", lambda h: h["col_idx"] == F.col("c.col_idx")), 0)["header"]
    return cell.where(~fn.is_commented(F.col("c.text")) & ~fn.is_blank(F.col("c.text"))).select(
        *TABLE, "row_idx", F.col("c.col_idx").alias("col_idx"), F.coalesce(header, F.lit("")).alias("header"), F.col("c.text").alias("text"))


def content_rows(placed: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows below each table's header, but for comment rows, with the table's columns."""
    body = placed.where((F.col("status") == "body") & (F.col("row_idx") > F.col("title_row") + 1) & ~F.col("skipped"))
    return body.select(*TABLE, "row_idx", "cells").join(
        tables.where(F.col("columns").isNotNull()).select(*TABLE, "field", "prop", "columns"), TABLE)


def _ends_with_image(text: Column) -> Column:
    return F.lower(F.right(text, F.lit(7))) == "(image)"


def _before_image(text: Column) -> Column:
    return F.trim(F.substr(text, F.lit(1), F.length(text) - 7))


def image_cells(fields: Column) -> Column:
    """``(image)`` at the end of a property name or of a text value makes an image object."""
    def convert(f: Column) -> Column:
        image = lambda v: fn.json_object(F.array(F.struct(F.lit("img").alias("k"), v.alias("v"))))
        by_value = f["v"].startswith('"') & _ends_with_image(f["t"])
        return (F.when(_ends_with_image(f["k"]), F.struct(_before_image(f["k"]).alias("k"), image(f["v"]).alias("v"), f["t"].alias("t")))
                .when(by_value, F.struct(f["k"], image(fn.json_quote(_before_image(f["t"]))).alias("v"), f["t"]))
                .otherwise(f))
    return F.transform(fields, convert)


def row_fields(content: DataFrame) -> DataFrame:
    """Content rows with the fields ``(k, v, t)`` of their item and the cells of shuffle columns."""
    by_col = F.map_from_entries(F.transform("columns", lambda c: F.struct(c["col_idx"], c)))
    rest = F.when(F.col("field") == "conjointItems", F.lit(""))
    row = content.withColumn("_by", by_col)

    def field(c: Column) -> Column:
        found = F.try_element_at(F.col("_by"), c["col_idx"])
        return F.struct(F.when(found.isNull(), rest).otherwise(found["prop"]).alias("k"), c["literal"].alias("v"), c["text"].alias("t"))

    said = F.filter("cells", lambda c: c["literal"].isNotNull() & ~fn.is_commented(c["text"]))
    fields = F.filter(F.transform(said, field), lambda f: f["k"].isNotNull())
    first_shuffle = F.get(F.filter("columns", lambda c: c["kind"] == "shuffle"), 0)["col_idx"]
    mark = F.get(F.filter(said, lambda c: c["col_idx"] == F.col("_shuffle")), 0)
    return row.withColumn("_shuffle", first_shuffle).select(
        *content.columns, fn.last_per_key(fields).alias("fields"),
        F.coalesce(fn.cell_bool(mark["text"], mark["literal"]), F.lit(False)).alias("shuffled"),
        fn.cell_bool_error(mark["text"], mark["literal"]).alias("bad_shuffle"))


def alias_line(fields: Column) -> Column:
    get = lambda k: F.get(F.filter(fields, lambda f: f["k"] == k), 0)["t"]
    cond = get("cond")
    told = F.when(F.ltrim(cond).startswith("function"), cond).otherwise(fn.json_quote(cond))
    return F.concat(F.lit("alias.defineOr('"), get("name"), F.lit("', "), told, F.lit(")"))


def alias_code(rows: DataFrame) -> DataFrame:
    """Code of each alias table, one line per row."""
    line = F.struct("row_idx", alias_line(F.col("fields")).alias("line"))
    return rows.where(F.col("field") == "aliases").groupBy(*TABLE).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("code"))


def shuffle_value(flags: Column) -> Column:
    """JSON of a column of truth values: null when all are false."""
    n = F.size(flags)
    places = F.filter(F.transform(flags, lambda x, i: F.when(~x, i)), lambda i: i.isNotNull())
    off = F.size(places)
    first = F.array_position(flags, True).cast("int") - 1
    last = n - F.array_position(F.reverse(flags), True).cast("int")
    one = lambda k, v: fn.json_object(F.array(F.struct(F.lit(k).alias("k"), v.alias("v"))))
    listed = fn.json_array(F.transform(places, lambda i: i.cast("string")))
    return (F.when(off == n, F.lit(None).cast("string")).when(off == 0, F.lit("true"))
            .when(off == first, one("exceptFirst", off.cast("string")))
            .when(off == n - 1 - last, one("exceptLast", off.cast("string")))
            .otherwise(one("except", listed)))


def shuffle_summary(rows: DataFrame) -> DataFrame:
    """Shuffle setting of each table that has a shuffle column."""
    marked = rows.where(F.exists("columns", lambda c: c["kind"] == "shuffle"))
    flags = F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "shuffled"))), lambda x: x["shuffled"])
    return marked.groupBy(*TABLE).agg(flags.alias("flags")).select(
        *TABLE, shuffle_value(F.col("flags")).alias("shuffleItems"))


def drop_null_fields(rows: DataFrame) -> DataFrame:
    """Items as JSON; cells without a value add no property."""
    return rows.select(*TABLE, "row_idx", fn.compact(fn.json_object(F.col("fields"))).alias("item"))


def build_rows(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """``(prop, items, keys)`` per table: the array of its row objects, and the first row's keys."""
    fields = F.when(F.col("field") == "conjointItems", image_cells(F.col("fields"))).otherwise(F.col("fields"))
    item = F.struct("row_idx", fn.json_object(fields).alias("v"), F.transform("fields", lambda f: f["k"]).alias("keys"))
    listed = rows.groupBy(*TABLE).agg(F.sort_array(F.collect_list(item)).alias("listed"))
    with_items = tables.where(F.exists("columns", lambda c: c["kind"] == "item")).select(*TABLE, "field", "prop")
    values = F.coalesce(F.transform("listed", lambda x: x["v"]), F.array().cast("array<string>"))
    return with_items.join(listed, TABLE, "left").select(
        *TABLE, "field", "prop", fn.json_array(values).alias("items"), F.get("listed", 0)["keys"].alias("keys"))


def property_list(built: DataFrame) -> DataFrame:
    """Names of the first item's properties in conjoint tables, image suffix stripped."""
    named = F.transform("keys", lambda k: F.when(_ends_with_image(k), _before_image(k)).otherwise(k))
    return built.where(F.col("field") == "conjointItems").select(
        *TABLE, fn.json_array(F.transform(F.coalesce(named, F.array().cast("array<string>")), fn.json_quote)).alias("properties"))


def project_fields(fields: Column, keep: tuple[str, ...] = ("id", "text")) -> Column:
    return F.filter(fields, lambda f: f["k"].isin(*keep))


def _field(name: str) -> Column:
    return F.get(F.filter("fields", lambda f: f["k"] == name), 0)["v"]


def group_items(rows: DataFrame) -> DataFrame:
    """Items of each group value, in row order, reduced to id and text."""
    item = F.struct("row_idx", fn.json_object(project_fields(F.col("fields"))).alias("v"))
    return rows.where(F.col("field") == "groupItems").select(*TABLE, "row_idx", _field("group").alias("group"), item.alias("item")) \
        .where(F.col("group").isNotNull()).groupBy(*Q, "group").agg(
        fn.json_array(F.transform(F.sort_array(F.collect_list("item")), lambda x: x["v"])).alias("items"), F.count("*").alias("n"))


def nest_items_in_groups(rows: DataFrame) -> DataFrame:
    """Groups of matrix questions with their items; ``n`` is 0 where a group has none."""
    group = rows.where(F.col("field") == "groups").select(
        *Q, "row_idx", _field("groupId").alias("group"), _field("header").alias("header"))
    joined = group.join(group_items(rows), [*Q, "group"], "left")
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    parts = F.array(entry("id", F.col("group")), entry("header", F.col("header")), entry("items", F.coalesce("items", F.lit("[]"))))
    return joined.select(*Q, "row_idx", "group", F.coalesce("n", F.lit(0)).alias("n"),
                         fn.json_object(F.filter(parts, lambda f: f["v"].isNotNull())).alias("v"))


def _entries(df: DataFrame, sub: int, k: Column, v: Column, seq: str = "title_row") -> DataFrame:
    return df.select(*Q, F.col(seq).alias("seq"), F.lit(sub).alias("sub"), k.alias("k"), v.alias("v"))


def conjoint_entries(rows: DataFrame, built: DataFrame) -> DataFrame:
    return _entries(property_list(built), 2, F.lit("properties"), F.col("properties"))


def matrix_entries(rows: DataFrame, built: DataFrame) -> DataFrame:
    groups = nest_items_in_groups(rows).groupBy(*Q).agg(
        fn.json_array(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "v"))), lambda x: x["v"])).alias("g"))
    items = built.where(F.col("field") == "groupItems").join(groups, Q, "left")
    return _entries(items, MATRIX, F.lit("items"), F.coalesce("g", F.lit("[]")))


def alias_entries(rows: DataFrame, built: DataFrame) -> DataFrame:
    tables = built.where(F.col("field") == "aliases").join(alias_code(rows), TABLE, "left")
    return _entries(tables, ALIASES, F.lit("code"), fn.json_quote(F.coalesce("code", F.lit(""))))


# What follows a table once it is applied: ``(rows, built tables) -> entries`` by table field.
MATRIX, ALIASES = 3, 4
POST_PROCESSORS = {"conjointItems": conjoint_entries, "groupItems": matrix_entries, "aliases": alias_entries}
# Tables whose own array does not stay in the document.
REPLACED = ["groupItems", "aliases"]


def post_process(rows: DataFrame, built: DataFrame, processors: dict | None = None) -> DataFrame:
    """Entries of all post-processors."""
    found = [p(rows, built) for p in (POST_PROCESSORS if processors is None else processors).values()]
    return reduce(DataFrame.unionByName, found)


def table_entries(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Properties that tables add to their questions, post-processing included."""
    built = stage(build_rows(rows, tables))
    plain = _entries(built.where(~F.col("field").isin(*REPLACED)), 0, F.col("prop"), F.col("items"))
    shuffle = _entries(shuffle_summary(rows).where(F.col("shuffleItems").isNotNull()), 1, F.lit("shuffleItems"), F.col("shuffleItems"))
    return plain.unionByName(shuffle).unionByName(post_process(rows, built))


# How a kind of field applies: ``(marked rows, item rows, tables) -> entries`` by kind. The
# matching half of a kind is its predicate, see ``first_match``.
FIELD_KINDS = {
    "pair": lambda marked, items, tables: pair_values(marked.where(F.col("kind") == "pair")),
    "code": lambda marked, items, tables: pair_values(marked.where(F.col("kind") == "code")),
    "table": lambda marked, items, tables: table_entries(items, tables),
}


def apply_fields(marked: DataFrame, items: DataFrame, tables: DataFrame, kinds: dict | None = None) -> DataFrame:
    """Entries of all kinds of fields."""
    return reduce(DataFrame.unionByName, [k(marked, items, tables) for k in (FIELD_KINDS if kinds is None else kinds).values()])


def fold_question(heads: DataFrame, entries: DataFrame) -> DataFrame:
    """Documents of sound questions: id, type and the properties in row order.

    A later value of a property replaces an earlier one in its place. A matrix loses its
    raw tables, and an alias table turns its question into code without an id. A question
    has one entry per field and table, so they are few.
    """
    listed = entries.groupBy(*Q).agg(F.sort_array(F.collect_list(F.struct("seq", "sub", "k", "v"))).alias("e"))
    kv = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    joined = heads.where(F.col("fatal").isNull()).join(listed, Q, "left").withColumn("e", F.coalesce("e", F.array().cast(ENTRY)))
    matrix = F.exists("e", lambda x: x["sub"] == MATRIX)
    alias_at = F.get(F.filter("e", lambda x: x["sub"] == ALIASES), 0)["seq"]
    kept = F.filter("e", lambda x: (~F.col("_matrix") | (x["k"] != "_groups")) & (F.col("_alias").isNull() | (x["seq"] >= F.col("_alias"))))
    fields = F.transform(kept, lambda x: F.struct(x["k"], x["v"]))
    opening = F.when(F.col("_alias").isNotNull(), F.array(kv("type", F.lit('"JsCode"')))).otherwise(
        F.array(kv("id", fn.json_quote(F.col("qid"))), kv("type", fn.json_quote(F.col("qtype")))))
    doc = fn.json_object(fn.last_per_key(F.concat(opening, fields)))
    return joined.withColumn("_matrix", matrix).withColumn("_alias", alias_at).select(
        *Q, F.when(F.col("_alias").isNull(), F.col("qid")).alias("qid"),
        F.when(F.col("_alias").isNull(), F.col("qtype")).otherwise(F.lit("JsCode")).alias("qtype"), doc.alias("doc"),
        fn.json_unquote(F.get(F.filter(F.reverse(fields), lambda f: f["k"] == "code"), 0)["v"]).alias("code"))


def question_errors(placed: DataFrame, marked: DataFrame, rows: DataFrame, tables: DataFrame,
                    report_columns: bool = False) -> DataFrame:
    """Errors in report order: what tables found first, then rows that matched badly."""
    def listed(df: DataFrame, part: int, seq: str = "title_row", sub: str = "row_idx") -> DataFrame:
        return df.select(*Q, F.lit(part).alias("part"), F.col(seq).alias("seq"), F.col(sub).alias("sub"), "error")

    cells = rows.where(F.col("bad_shuffle").isNotNull()).withColumn("error", F.concat(
        F.lit(f"Unexpected cell value. Expected: {fn.EXPECTED_BOOL}; actual: "), "bad_shuffle"))
    groups = nest_items_in_groups(rows).where(F.col("n") == 0).withColumn(
        "error", F.concat(F.lit("No items for group "), "group")).withColumn("title_row", F.col("row_idx"))
    matched = duplicate_field(placed, marked).unionByName(merge_unrecognized(placed).drop("last_row"))
    out = listed(cells, 0).unionByName(listed(groups, 0)).unionByName(listed(matched, 1, "row_idx"))
    if report_columns:
        unknown = tables.select(*TABLE, "qid", "qtype", F.explode("columns").alias("c")).where(F.col("c.kind").isNull())
        place = F.concat(F.lit("cell "), F.format_string("%d:%d", F.col("title_row") + 1, F.col("c.col_idx")), F.lit(" - '"), "c.header", F.lit("'"))
        out = out.unionByName(listed(unknown.select(*TABLE, F.col("c.col_idx").alias("row_idx"), fn.error_text(
            F.lit("Unrecognized column"), F.col("qid"), F.col("qtype"), place).alias("error")), 0))
    return out


def question_warnings(rows: DataFrame) -> DataFrame:
    """Tables with several shuffle columns; the first one counts."""
    several = rows.where(F.size(F.filter("columns", lambda c: c["kind"] == "shuffle")) > 1)
    spans = several.groupBy(*TABLE).agg(
        F.min("row_idx").alias("a"), F.max("row_idx").alias("z"), F.min_by("cells", "row_idx").alias("cells"))
    return spans.select(*Q, F.col("title_row").alias("seq"), fn.error_text(
        F.lit("Multiple shuffle columns found for one table"),
        place=fn.row_range(F.col("a"), F.col("z"), fn.row_text(F.col("cells")))).alias("warning"))


def table_fatals(tables: DataFrame, entries_of: DataFrame | None = None) -> DataFrame:
    """Questions that cannot be read: a table without rows, or matrix items without groups."""
    place = F.concat(F.lit("row "), "title_row", F.lit(": "), "title_text")
    empty = tables.where(F.col("columns").isNull()).select(*Q, "title_row", fn.error_text(
        F.lit("Empty table"), F.col("qid"), place=place).alias("fatal"))
    items = tables.where(F.col("field") == "groupItems")
    groups = tables.where(F.col("field") == "groups").select(*Q, F.col("title_row").alias("_g"))
    lost = items.join(groups, Q, "left").where(F.col("_g").isNull() | (F.col("_g") > F.col("title_row"))).select(
        *Q, "title_row", fn.error_text(F.lit("Groups not found"), F.col("qid"), place=place).alias("fatal"))
    return empty.unionByName(lost).groupBy(*Q).agg(F.min_by("fatal", "title_row").alias("table_fatal"))
