"""Spreadsheet cells derived from parts: one question per part, sixteen rows apart.

A workbook holds the parts of one brand within a thousand part keys, which keeps it inside
the rows of a sheet however many parts there are. A cell template says what stands where;
a placeholder in braces is filled from the part. Spark and the SQL twins read the same
template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyroom.operators.dictionary import TYPES
from tallyroom.sources.tables import fixed_rows, read_table

STRIDE = 16
SHARD = 1000
TYPE_NAMES = [*TYPES, "Nope"]
LAYOUTS = {"CheckGroupMatrix": "matrix", "RadioConjoint": "conjoint", "Aliases": "aliases",
           "RadioGroupImaged": "imaged", "CheckGroupImaged": "imaged", "BulkRadioImaged": "imaged"}

S, N = "string", "numeric"


def _cells() -> list[dict]:
    out = []

    def put(layout, row, col, kind, value, sixth=-1, fmt="General", sheet=0):
        out.append({"layout": layout, "r": row, "c": col, "kind": kind, "value": value, "sixth": sixth, "fmt": fmt, "sheet": sheet})

    for c, v in enumerate(["{qid}", "Type", "{qtype}"]):
        put("all", 0, c, S, v)
    put("all", 1, 1, S, "Question text")
    put("all", 1, 2, S, "{name}")
    put("all", 2, 1, S, "optional")
    put("all", 2, 2, S, "{even}")
    put("all", 0, 0, S, "not read", sheet=1)

    for c, v in enumerate(["Items"]):
        put("plain", 4, 1 + c, S, v)
    for c, v in enumerate(["Code", "Text", "Shuffle"]):
        put("plain", 5, 1 + c, S, v)
    for r, (code, text, mark) in enumerate([("1", "{type}", "+"), ("2", "{brand}", "{mark}")]):
        put("plain", 6 + r, 1, N, code)
        put("plain", 6 + r, 2, S, text)
        put("plain", 6 + r, 3, S, mark)
    for c, v in enumerate(["#", "9", "hidden", "+"]):
        put("plain", 8, c, S, v)
    put("plain", 9, 1, N, "3")
    put("plain", 9, 2, S, "#gone")
    put("plain", 9, 3, S, "YES")

    for r, (code, text) in enumerate([("ID", "Header"), ("1", "First"), ("2", "Second")]):
        put("matrix", 5 + r, 1, N if r else S, code)
        put("matrix", 5 + r, 2, S, text)
    put("matrix", 4, 1, S, "Groups")
    put("matrix", 9, 1, S, "Rows")
    for c, v in enumerate(["Code", "Group", "Item text"]):
        put("matrix", 10, 1 + c, S, v)
    for r, (code, group, text) in enumerate([("a", "1", "{type}"), ("b", "{group}", "{brand}")]):
        put("matrix", 11 + r, 1, S, code)
        put("matrix", 11 + r, 2, N, group)
        put("matrix", 11 + r, 3, S, text)

    put("conjoint", 4, 1, S, "Items")
    for c, v in enumerate(["Code", "Pic (image)", "Price"]):
        put("conjoint", 5, 1 + c, S, v)
    put("conjoint", 6, 1, N, "1")
    put("conjoint", 6, 2, S, "{name}")
    put("conjoint", 6, 3, N, "{price}")
    put("conjoint", 7, 1, N, "2")
    put("conjoint", 7, 3, S, "shown (image)")

    put("aliases", 4, 1, S, "Aliases")
    for c, v in enumerate(["Alias name", "Condition"]):
        put("aliases", 5, 1 + c, S, v)
    put("aliases", 6, 1, S, "big")
    put("aliases", 6, 2, S, 'size > "{size}"')
    put("aliases", 7, 1, S, "always")
    put("aliases", 7, 2, S, " function () { return 1 }")

    put("imaged", 4, 1, S, "Answers")
    for c, v in enumerate(["Code", "Text", "Image", "Shuffle", "Remark"]):
        put("imaged", 5, 1 + c, S, v)
    for r, (code, mark) in enumerate([("1", "{mark}"), ("2", "+"), ("3", "+")]):
        put("imaged", 6 + r, 1, N, code)
        put("imaged", 6 + r, 2, S, "{type}")
        put("imaged", 6 + r, 3, S, "pics/{name}.png")
        put("imaged", 6 + r, 4, S, mark)

    put("all", 14, 1, S, "Optional", 0)
    put("all", 14, 2, S, "No", 0)
    put("all", 14, 1, S, "Block", 1)
    put("all", 14, 2, N, "{size}", 1)
    put("all", 14, 1, S, "JS-extra", 2)
    put("all", 14, 2, S, 'x < "1"', 2)
    put("all", 14, 1, S, "Mystery", 3)
    put("all", 14, 2, S, "?", 3)
    put("all", 15, 2, S, "{name}", 3)
    put("all", 14, 0, S, "#", 4)
    put("all", 14, 1, S, "Hidden", 4)
    put("all", 14, 1, S, "Cond", 5)
    put("all", 14, 2, N, "0.12345", 5, "0.00%")
    return out


CELLS = _cells()


CELL = "r int, c int, kind string, value string, fmt string, sheet int"


def _templates() -> list[dict]:
    """The cells of every layout and remainder, so that parts meet them by equality."""
    return [{"_layout": layout, "sixth": sixth, "cells": [
        c for c in CELLS if c["layout"] in ("all", layout) and c["sixth"] in (-1, sixth)]}
        for layout in ["plain", *sorted(set(LAYOUTS.values()))] for sixth in range(6)]


def cells(spark: SparkSession, d: str) -> DataFrame:
    """``(workbook_id, sheet_idx, row_idx, col_idx, cell_type, str, num, bool, fmt)``."""
    key, size = F.col("p_partkey"), F.col("p_size")
    shard = F.floor(key / SHARD)
    within = Window.partitionBy("p_brand", "_shard").orderBy("p_partkey")
    qtype = F.element_at(F.array(*[F.lit(t) for t in TYPE_NAMES]), size % 18 + 1)
    layout = F.lit("plain")
    for name, other in LAYOUTS.items():
        layout = F.when(F.col("_qtype") == name, other).otherwise(layout)
    parts = read_table(spark, d, "part").withColumn("_shard", shard).select(
        "*", F.concat_ws("/", "p_brand", "_shard").alias("workbook_id"),
        (F.row_number().over(within) - 1).alias("_n"), qtype.alias("_qtype")).withColumn("_layout", layout)
    template = F.broadcast(fixed_rows(spark, _templates(), f"_layout string, sixth int, cells array<struct<{CELL}>>"))
    placed = parts.withColumn("sixth", size % 6).join(template, ["_layout", "sixth"]).select("*", F.inline("cells"))
    own_id = (F.col("value") == "{qid}") & (key % 10 != 0)
    mark = F.when(size % 10 == 9, "maybe").when(size % 3 == 0, "-").otherwise("+")
    value = F.col("value")
    fills = {"qid": F.when(key % 10 == 0, F.concat(F.lit("Q"), size)).otherwise(key.cast("string")), "qtype": F.col("_qtype"),
             "name": F.col("p_name"), "even": F.when(size % 2 == 0, "+").otherwise("-"), "type": F.col("p_type"),
             "brand": F.col("p_brand"), "mark": mark, "group": F.when(size % 4 == 0, "1").otherwise("2"),
             "price": (F.round(F.col("p_retailprice") * 4) / 4).cast("string"), "size": size.cast("string")}
    for name, fill in fills.items():
        value = F.when(F.col("value").contains("{" + name + "}"), F.replace(F.col("value"), F.lit("{" + name + "}"), fill)).otherwise(value)
    kind = F.when(own_id, F.lit(N)).otherwise(F.col("kind"))
    return placed.withColumn("_v", value).select(
        "workbook_id", F.col("sheet").alias("sheet_idx"), (F.col("_n") * STRIDE + F.col("r")).alias("row_idx"),
        F.col("c").alias("col_idx"), kind.alias("cell_type"),
        F.when(kind == S, F.col("_v")).alias("str"), F.when(kind == N, F.col("_v").try_cast("double")).alias("num"),
        F.lit(None).cast("boolean").alias("bool"), F.col("fmt"))


def _text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def cells_sql() -> str:
    """The same cells as CTEs ending in ``cells``."""
    rows = ",\n".join("({}, {}, {}, {}, {}, {}, {}, {})".format(
        _text(c["layout"]), c["r"], c["c"], _text(c["kind"]), _text(c["value"]), c["sixth"], _text(c["fmt"]), c["sheet"]) for c in CELLS)
    types = "[" + ", ".join(_text(t) for t in TYPE_NAMES) + "]"
    layouts = " ".join(f"when {_text(t)} then {_text(v)}" for t, v in LAYOUTS.items())
    return f"""
 template(layout, r, c, kind, value, sixth, fmt, sheet) as (values {rows}),
 parts as (select *, p_brand || '/' || p_partkey // {SHARD} as workbook_id,
   row_number() over (partition by p_brand, p_partkey // {SHARD} order by p_partkey) - 1 as n,
   {types}[p_size % 18 + 1] as qtype from part),
 laid as (select *, case qtype {layouts} else 'plain' end as own from parts),
 filled as (select p.workbook_id, t.sheet as sheet_idx, cast(p.n * {STRIDE} + t.r as int) as row_idx, t.c as col_idx,
   case when t.value = '{{qid}}' and p_partkey % 10 <> 0 then 'numeric' else t.kind end as cell_type, t.fmt,
   replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t.value,
     '{{qid}}', case when p_partkey % 10 = 0 then 'Q' || p_size else cast(p_partkey as varchar) end),
     '{{qtype}}', qtype), '{{name}}', p_name), '{{even}}', case when p_size % 2 = 0 then '+' else '-' end),
     '{{type}}', p_type), '{{brand}}', p_brand),
     '{{mark}}', case when p_size % 10 = 9 then 'maybe' when p_size % 3 = 0 then '-' else '+' end),
     '{{group}}', case when p_size % 4 = 0 then '1' else '2' end),
     '{{price}}', cast(round(p_retailprice * 4) / 4 as varchar)), '{{size}}', cast(p_size as varchar)) as v
   from laid p join template t on (t.layout = 'all' or t.layout = p.own) and (t.sixth = -1 or t.sixth = p.p_size % 6)),
 cells as (select workbook_id, sheet_idx, row_idx, col_idx, cell_type, fmt,
   case when cell_type = 'string' then v end as str,
   case when cell_type = 'numeric' then try_cast(v as double) end as num from filled),
 valued as (select *, case cell_type when 'string' then str else
     case when num % 1 = 0 then cast(cast(num as int) as varchar) else cast(num as varchar) end end as text,
   case when cell_type = 'numeric' and fmt like '%\\%%' escape '\\' then '"' || cast(round(num * 100, 3) as varchar) || '%"'
     when cell_type = 'numeric' then case when num % 1 = 0 then cast(cast(num as int) as varchar) else cast(num as varchar) end
     when lower(str) in ('+', 'yes') then 'true' when lower(str) in ('-', 'no') then 'false'
     else cast(to_json(str) as varchar) end as literal
   from cells where sheet_idx = 0)"""
