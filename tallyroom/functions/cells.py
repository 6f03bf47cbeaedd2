"""Expressions on spreadsheet cells ``(cell_type, str, num, bool, fmt)`` and on JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for true and false, and the mark of a comment.
TRUE_WORDS = ["+", "yes"]
FALSE_WORDS = ["-", "no"]
COMMENT = "#"
EXPECTED_BOOL = "+, -, Yes, No or empty cell"

INT_MIN, INT_MAX = -2147483648.0, 2147483647.0


# Kinds of cells that have no value to read; a question that holds one is lost, see ``sheets.question_type``.
UNREADABLE = ["formula", "error"]


def is_unreadable(kind: Column) -> Column:
    return F.coalesce(kind.isin(*UNREADABLE), F.lit(False))


def _int_text(num: Column) -> Column:
    return F.least(F.greatest(num, F.lit(INT_MIN)), F.lit(INT_MAX)).cast("int").cast("string")


def cell_string(kind: Column, text: Column, num: Column, flag: Column) -> Column:
    """Text of a cell: whole numbers without a fraction and within 32 bits, blank as empty."""
    return F.coalesce(
        F.when(kind == "string", text)
        .when(kind == "numeric", F.when(num % 1 == 0, _int_text(num)).otherwise(num.cast("string")))
        .when(kind == "boolean", flag.cast("string")),
        F.lit(""))


def json_quote(text: Column) -> Column:
    # A literal begins and ends with a quote, so what is trimmed are the array's brackets.
    return F.when(text.isNotNull(), F.btrim(F.to_json(F.array(text)), F.lit("[]")))


def json_unquote(literal: Column) -> Column:
    """Text inside a JSON string literal; other literals as they stand."""
    inner = F.get(F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>"), 0)
    return F.when(literal.startswith('"'), inner).otherwise(literal)


def cell_json(kind: Column, text: Column, num: Column, flag: Column, fmt: Column) -> Column:
    """JSON literal of a cell, null when blank. Number 1 and text "1" stay apart."""
    percent = F.concat(F.lit('"'), F.call_function("format_number", num * 100, F.lit("#.###")), F.lit('%"'))
    number = F.when(num % 1 == 0, _int_text(num)).otherwise(num.cast("string"))
    word = F.lower(text)
    return (
        F.when(kind == "numeric", F.when(fmt.contains("%"), percent).otherwise(number))
        .when(kind == "boolean", flag.cast("string"))
        .when((kind == "string") & word.isin(*TRUE_WORDS), F.lit("true"))
        .when((kind == "string") & word.isin(*FALSE_WORDS), F.lit("false"))
        .when(kind == "string", json_quote(text)))


def cell_bool(text: Column, literal: Column) -> Column:
    """Truth of a cell given its text and literal; empty is false, anything unclear is false."""
    return (text != "") & F.coalesce(literal == "true", F.lit(False))


def cell_bool_error(text: Column, literal: Column) -> Column:
    """The offending text where a cell is neither empty nor a truth value."""
    unclear = (text != "") & ~F.coalesce(literal.isin("true", "false"), F.lit(False))
    return F.when(unclear, text)


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def is_commented(text: Column) -> Column:
    return F.coalesce(text.startswith(COMMENT), F.lit(False))


def label_matches(label: Column, kind: Column, patterns: Column) -> Column:
    """Does a rule's predicate hold. Patterns are kept in lower case but for ``exact_case``."""
    low = F.lower(label)
    return (
        F.when(kind == "pool", F.array_contains(patterns, low))
        .when(kind == "contains_all", F.forall(patterns, lambda p: low.contains(p)))
        .when(kind == "contains_any", F.exists(patterns, lambda p: low.contains(p)))
        .when(kind == "prefix", low.startswith(F.get(patterns, 0)) & (F.length(label) > F.length(F.get(patterns, 0))))
        .when(kind == "exact_case", F.array_contains(patterns, label))
        .otherwise(kind == "any"))


def block_condition(value: Column) -> Column:
    return F.format_string("isBlock.bind(null, %s)", value)


def indent(text: Column, by: int = 2) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("\n" + " " * by))


def json_object(fields: Column) -> Column:
    """Object over several lines from ``array<struct<k, v>>``, ``v`` being JSON text."""
    lines = F.transform(fields, lambda f: F.concat(F.lit("\n  "), json_quote(f["k"]), F.lit(":"), indent(f["v"])))
    return F.when(F.size(fields) == 0, F.lit("{}")).otherwise(
        F.concat(F.lit("{"), F.array_join(lines, ","), F.lit("\n}")))


def json_array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def compact(json_text: Column) -> Column:
    """The same JSON on one line; strings hold no raw line breaks."""
    return F.regexp_replace(json_text, "\n *", "")


def last_per_key(fields: Column) -> Column:
    """Fields merged left to right: a key keeps its first place and takes its last value."""
    keys = F.array_distinct(F.transform(fields, lambda f: f["k"]))
    return F.transform(keys, lambda k: F.element_at(F.filter(fields, lambda f: f["k"] == k), -1))


CODE_OPEN, CODE_CLOSE = "##JS##", "##JS-END##"


def code_mark(code: Column) -> Column:
    return F.concat(F.lit(CODE_OPEN), code, F.lit(CODE_CLOSE))


def code_unquote(text: Column) -> Column:
    """Take code strings out of their quotes and markers and indent their lines; an empty one stays an empty string."""
    line_break = F.lit("\n" + " " * 9)
    pieces = F.split(text, f'"{CODE_OPEN}|{CODE_CLOSE}"')
    quoted = lambda p: F.concat(F.lit('["'), p, F.lit('"]'))
    opened = F.transform(pieces, lambda p, i: F.when((i % 2 == 1) & (p == ""), F.lit('""')).when(
        i % 2 == 1, F.replace(F.get(F.from_json(quoted(p), "array<string>"), 0), F.lit("\n"), line_break)).otherwise(p))
    plain = F.replace(F.replace(F.array_join(opened, ""), F.lit(CODE_OPEN), F.lit("")), F.lit(CODE_CLOSE), F.lit(""))
    return F.replace(plain, F.lit("\\n"), line_break)


def cell_coords(row: Column, col: Column) -> Column:
    return F.coalesce(F.format_string("%d:%d", row, col), F.lit("Undefined cell coords (Null cell)"))


def cell_place(row: Column, col: Column, text: Column, present: Column) -> Column:
    coords = F.when(present, F.format_string("%d:%d", row, col)).otherwise(F.lit("Undefined cell coords (Null cell)"))
    return F.concat(F.lit("cell "), coords, F.lit(" - '"), F.coalesce(text, F.lit("")), F.lit("'"))


def row_text(cells: Column) -> Column:
    """Cell texts from column 0 to one past the last cell, as the source library counts."""
    by_col = F.map_from_entries(F.transform(cells, lambda c: F.struct(c["col_idx"], c["text"])))
    last = F.array_max(F.transform(cells, lambda c: c["col_idx"])) + 1
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.try_element_at(by_col, i), F.lit(""))), " | ")


def row_range(first: Column, last: Column, head: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("row "), first, F.lit(": "), head)).otherwise(
        F.concat(F.lit("rows "), first, F.lit("-"), last, F.lit(": "), head, F.lit(" ...")))


def error_text(base: Column, qid: Column | None = None, qtype: Column | None = None, place: Column | None = None) -> Column:
    """Base text, then question, type and place where known, in that order."""
    parts = [base]
    if qid is not None:
        parts.append(F.coalesce(F.concat(F.lit(" for question '"), qid, F.lit("'")), F.lit("")))
    if qtype is not None:
        parts.append(F.coalesce(F.concat(F.lit(" ("), qtype, F.lit(")")), F.lit("")))
    if place is not None:
        parts.append(F.coalesce(F.concat(F.lit(" at "), place), F.lit("")))
    return F.concat(*parts)
