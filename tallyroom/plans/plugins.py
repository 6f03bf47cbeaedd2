"""Queries through the plug-in points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.functions import mail as mail_fn
from tallyroom.operators import questions as qs
from tallyroom.operators import registry, sheets
from tallyroom.plans import binding as b
from tallyroom.plans import grid, mail, questions, questions_sql
from tallyroom.workspace import stage


def _doubled(tasks: DataFrame) -> DataFrame:
    """A dataset of our own: every stored row a second time, under another id."""
    rows = registry.inline_dataset(tasks)
    return rows.unionByName(rows.withColumn("rowId", F.concat("rowId", F.lit("/2"))))


def _mixed_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Every third task names the second kind of dataset, every seventh an unknown one."""
    n = F.col("id")
    kind = F.when(n % 7 == 0, "other").when(n % 3 == 0, "doubled").otherwise("inline")
    named = F.concat(F.lit('"dataset":{"kind":"'), kind)
    return b.tasks(spark, d).withColumn("data", F.replace("data", F.lit('"dataset":{"kind":"inline'), named))


def dataset_plugin(spark: SparkSession, d: str) -> DataFrame:
    tasks = _mixed_tasks(spark, d)
    kinds = registry.DATASETS | {"doubled": _doubled}
    rows = registry.dataset_rows(tasks, kinds).select("taskId", "rowId", F.lit(None).cast("string").alias("error"))
    errors = registry.unknown_kinds(tasks, "dataset", kinds).select("taskId", F.lit(None).cast("string").alias("rowId"), "error")
    return rows.unionByName(errors)


def template_plugin(spark: SparkSession, d: str) -> DataFrame:
    tasks = b.tasks(spark, d)
    out = registry.messages(registry.dataset_rows(tasks), tasks, mail.SENDER)
    return out.select("taskId", "rowId", mail_fn.join_recipients(F.col("recipients")).alias("recipients"), "subject")


RULES = [
    {"match_kind": "pool", "patterns": ["optional", "cond"], "target": "known"},
    {"match_kind": "contains_all", "patterns": ["q", "text"], "target": "asked"},
    {"match_kind": "prefix", "patterns": ["js-"], "target": None},
]


def field_rule(spark: SparkSession, d: str) -> DataFrame:
    labels = sheets.cell_at(grid.cells(spark, d), 1).where(F.col("text").isNotNull())
    return labels.select("workbook_id", "row_idx", registry.apply_rules(F.col("text"), RULES).alias("target"))


def value_transform(spark: SparkSession, d: str) -> DataFrame:
    """Third cells transformed as the label in the second cell says."""
    rows = sheets.row_facts(grid.cells(spark, d))
    return rows.select("workbook_id", "row_idx", registry.transform_value(F.lower("c1"), F.col("c2")).alias("code"))


def post_processor(spark: SparkSession, d: str) -> DataFrame:
    rows, tables = questions._items(spark, d)
    rows = stage(rows)
    added = qs.post_process(rows, stage(qs.build_rows(rows, tables)))
    return added.select("workbook_id", "q_seq", "seq", "k", questions.fn.compact(F.col("v")).alias("v"))


def field_kind(spark: SparkSession, d: str) -> DataFrame:
    """Entries of fields by value and by code, without tables."""
    marked = stage(qs.mark_duplicates(questions._placed(spark, d)))
    kinds = {k: v for k, v in qs.FIELD_KINDS.items() if k != "table"}
    return qs.apply_fields(marked, None, None, kinds).select("workbook_id", "q_seq", "seq", "k", "v")


QUERIES = {f.__name__: f for f in [
    dataset_plugin, template_plugin, field_rule, value_transform, post_processor, field_kind]}

ORACLES = {
    "dataset_plugin": f"""with {b.MAIL_SQL}
      select "taskId", "rowId", cast(null as varchar) as error from listed where "taskId" % 7 <> 0
      union all select "taskId", "rowId" || '/2', null from listed where "taskId" % 7 <> 0 and "taskId" % 3 = 0
      union all select id, null, 'Unknown dataset: other' from tasks where id % 7 = 0""",
    "template_plugin": f"""with {b.MAIL_SQL}
      select "taskId", "rowId", address as recipients, 'Task ' || "taskId" as subject from listed""",
    "field_rule": f"""with {grid.cells_sql()}
      select workbook_id, row_idx, case when lower(text) in ('optional', 'cond') then 'known'
        when contains(lower(text), 'q') and contains(lower(text), 'text') then 'asked'
        when text ilike 'js-_%' then text end as target from valued where col_idx = 1""",
    "value_transform": f"""with {questions_sql._ROWS}
      select workbook_id, row_idx, case when lower(c1) = 'block' then 'isBlock.bind(null, ' || c2 || ')' else c2 end as code from facts""",
    "post_processor": f"""with {questions_sql._DOCS}
      select workbook_id, q_seq, seq, k, v from added where sub in (2, 3, 4)""",
    "field_kind": f"""with {questions_sql._MATCHED} select workbook_id, q_seq, seq, k, v from pairs""",
}
