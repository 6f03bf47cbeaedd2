"""Plug-in points: kinds of datasets and templates, label rules, value transforms.

A plug-in is a function from DataFrames to a DataFrame, or from a Column to a Column, found
by the kind named in a task's data. Kinds are few; each handles all its tasks at once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.functions import cells as cell_fn
from tallyroom.functions import mail as mail_fn

MOCK_TEXT = "Hello! привіт"
ROW_TYPE = "map<string,string>"


def kind_of(part: str) -> Column:
    return F.get_json_object("data", f"$.{part}.kind")


def inline_dataset(tasks: DataFrame) -> DataFrame:
    """``(taskId, pos, rowId, row)`` of rows stored in the task itself."""
    rows = F.from_json("data", f"dataset struct<rows:array<{ROW_TYPE}>>")["dataset"]["rows"]
    return tasks.select(F.col("id").alias("taskId"), F.posexplode(rows).alias("pos", "row")).select(
        "taskId", "pos", mail_fn.row_key(F.col("row")).alias("rowId"), "row")


def mock_template(rows: DataFrame, tasks: DataFrame, sender: str) -> DataFrame:
    """One message per row to its address, with the subject of its task."""
    subject = F.get_json_object("data", "$.template.subject")
    return rows.join(tasks.select(F.col("id").alias("taskId"), subject.alias("subject")), "taskId").select(
        "taskId", "rowId", F.array(F.col("row")["address"]).alias("recipients"), F.lit(sender).alias("from"),
        "subject", F.lit(MOCK_TEXT).alias("contentText"))


DATASETS: dict[str, Callable[[DataFrame], DataFrame]] = {"inline": inline_dataset}
TEMPLATES: dict[str, Callable[[DataFrame, DataFrame, str], DataFrame]] = {"mock": mock_template}
VALUE_TRANSFORMS: dict[str, Callable[[Column], Column]] = {"block": cell_fn.block_condition}


def unknown_kinds(tasks: DataFrame, part: str, known: dict) -> DataFrame:
    """Error rows for tasks whose kind is missing or not registered."""
    kind = kind_of(part)
    return tasks.where(kind.isNull() | ~kind.isin(*known)).select(
        F.col("id").alias("taskId"),
        F.concat(F.lit(f"Unknown {part}: "), F.coalesce(kind, F.lit("none"))).alias("error"))


def dataset_rows(tasks: DataFrame, datasets: dict | None = None) -> DataFrame:
    datasets = DATASETS if datasets is None else datasets
    found = [plugin(tasks.where(kind_of("dataset") == kind)) for kind, plugin in datasets.items()]
    return reduce(DataFrame.unionByName, found)


def messages(rows: DataFrame, tasks: DataFrame, sender: str, templates: dict | None = None) -> DataFrame:
    templates = TEMPLATES if templates is None else templates
    found = [plugin(rows, tasks.where(kind_of("template") == kind), sender) for kind, plugin in templates.items()]
    return reduce(DataFrame.unionByName, found)


def transform_value(name: Column, value: Column, transforms: dict | None = None) -> Column:
    """Value by the transform registered under ``name``, unchanged where there is none."""
    out = value
    for key, transform in (VALUE_TRANSFORMS if transforms is None else transforms).items():
        out = F.when(name == key, transform(value)).otherwise(out)
    return out


def apply_rules(label: Column, rules: list[dict]) -> Column:
    """Property given to a label by the first rule ``(match_kind, patterns, target)`` that holds."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        patterns = F.array(*[F.lit(p) for p in rule["patterns"]]).cast("array<string>")
        target = F.lit(rule["target"]) if rule["target"] is not None else label
        out = F.when(cell_fn.label_matches(label, F.lit(rule["match_kind"]), patterns), target).otherwise(out)
    return out
