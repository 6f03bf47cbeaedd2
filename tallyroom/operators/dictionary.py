"""Question types, their fields and table columns, as rows of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyroom.sources.tables import fixed_rows

# Fields by name as (kind, how the label matches, patterns, property).
FIELDS = {
    "cond": ("pair", "pool", ["Condition", "Cond"], "cond"),
    "block": ("code", "pool", ["Block"], "cond"),
    "js": ("code", "prefix", ["js-"], None),
    "text": ("pair", "pool", ["Question text", "text"], "text"),
    "optional": ("pair", "pool", ["Optional"], "optional"),
    "allowCustom": ("pair", "pool", ["Max custom options"], "allowCustom"),
    "customPlaceholder": ("pair", "pool", ["Custom options placeholders", "Custom option placeholder"], "customPlaceholder"),
    "minAnswersCount": ("pair", "contains_all", ["Min", "Answer"], "minAnswersCount"),
    "maxAnswersCount": ("pair", "contains_all", ["Max", "Answer"], "maxAnswersCount"),
    "code": ("code", "pool", ["Code"], "code"),
    "textarea": ("pair", "pool", ["Textarea"], "textarea"),
    "placeholder": ("pair", "pool", ["Placeholder"], "placeholder"),
    "maxBestCnt": ("pair", "pool", ["Max best cnt"], "maxBestCnt"),
    "maxWorstCnt": ("pair", "pool", ["Max worst cnt"], "maxWorstCnt"),
    "bigItems": ("pair", "pool", ["Big items"], "big-items"),
    "noAnswer": ("pair", "pool", ["Can have no answer", "No answer"], "no-answer"),
    "maxAnswersPerGroup": ("pair", "pool", ["Max Answers Per Group"], "maxAnswersPerGroup"),
    "singleColumn": ("pair", "pool", ["Single-column"], "single-column"),
    "items": ("table", "pool", ["Answers", "Rows", "Items"], "items"),
    "paramTitles": ("table", "pool", ["Columns", "Headers", "Legend"], "paramTitles"),
    "imagedTitles": ("table", "pool", ["Columns"], "paramTitles"),
    "imagedItems": ("table", "pool", ["Answers", "Rows"], "items"),
    "bestWorstTitles": ("table", "pool", ["Columns"], "paramTitles"),
    "groups": ("table", "pool", ["Groups"], "_groups"),
    "groupItems": ("table", "pool", ["Items", "Rows"], "_items"),
    "conjointItems": ("table", "pool", ["Items"], "items"),
    "aliases": ("table", "pool", ["Aliases"], "aliases"),
}

# The fields of each question type in the order in which they are tried,
# after the three that every type starts with.
FIRST_FIELDS = ["cond", "block", "js"]
TYPES = {
    "JsCode": ["code"],
    "Info": ["text"],
    "CheckGroup": ["text", "optional", "allowCustom", "customPlaceholder", "items", "minAnswersCount", "maxAnswersCount"],
    "RadioGroup": ["text", "optional", "allowCustom", "customPlaceholder", "items"],
    "BulkRadio": ["text", "optional", "items", "paramTitles"],
    "BulkCheck": ["text", "optional", "items", "paramTitles"],
    "RadioGroupImaged": ["text", "optional", "imagedItems"],
    "CheckGroupImaged": ["text", "optional", "imagedItems"],
    "BulkRadioImaged": ["text", "optional", "imagedTitles", "imagedItems"],
    "InputText": ["text", "optional", "textarea", "placeholder"],
    "BestWorst": ["text", "optional", "maxBestCnt", "maxWorstCnt", "bestWorstTitles", "items"],
    "Percent": ["text", "optional", "bigItems", "noAnswer", "items"],
    "CheckGroupMatrix": ["text", "optional", "maxAnswersPerGroup", "groups", "groupItems"],
    "DropDownGroup": ["text", "optional", "paramTitles", "items"],
    "Hierarchy": ["text", "optional", "singleColumn", "paramTitles", "items"],
    "RadioConjoint": ["text", "optional", "conjointItems"],
    "Aliases": ["aliases"],
}

# Columns of each table as (kind, how the header matches, patterns, property).
SHUFFLE = ("shuffle", "exact_case", ["Shuffle"], "shuffleItems")
COLUMNS = {
    "items": [("item", "pool", ["Code"], "id"), ("item", "pool", ["Text"], "text"),
              ("item", "contains_any", ["Alias", "Define"], "defineOr"), SHUFFLE],
    "paramTitles": [("item", "pool", ["Code"], "id"), ("item", "pool", ["Label", "Text"], "text"),
                    ("item", "pool", ["Legend"], "legend")],
    "imagedTitles": [("item", "pool", ["Code"], "id"), ("item", "pool", ["Legend"], "legend")],
    "imagedItems": [("item", "pool", ["Code"], "id"), ("item", "pool", ["Text"], "text"),
                    ("item", "pool", ["Image"], "img"), SHUFFLE],
    "bestWorstTitles": [("item", "pool", ["Code"], "id"), ("item", "pool", ["Legends"], "text")],
    "groups": [("item", "pool", ["ID"], "groupId"), ("item", "pool", ["Header"], "header")],
    "groupItems": [("item", "pool", ["Code"], "id"), ("item", "pool", ["Group"], "group"),
                   ("item", "pool", ["Item text"], "text")],
    "conjointItems": [("item", "pool", ["Code"], "id"), ("item", "any", [], None)],
    "aliases": [("item", "contains_any", ["Name"], "name"), ("item", "contains_any", ["Cond"], "cond")],
}


def _patterns(match_kind: str, patterns: list[str]) -> list[str]:
    return patterns if match_kind == "exact_case" else [p.lower() for p in patterns]


def field_rules() -> list[dict]:
    """One record per type and field."""
    return [
        {"qtype": qtype, "priority": i, "field": name, "kind": FIELDS[name][0], "match_kind": FIELDS[name][1],
         "patterns": _patterns(*FIELDS[name][1:3]), "target": FIELDS[name][3]}
        for qtype, names in TYPES.items() for i, name in enumerate(FIRST_FIELDS + names)]


def column_rules() -> list[dict]:
    """One record per table field and column."""
    return [
        {"field": field, "priority": i, "kind": kind, "match_kind": how, "patterns": _patterns(how, patterns), "target": target}
        for field, columns in COLUMNS.items() for i, (kind, how, patterns, target) in enumerate(columns)]


FIELD_RULE = "priority int, field string, kind string, match_kind string, patterns array<string>, target string"
COLUMN_RULE = "priority int, kind string, match_kind string, patterns array<string>, target string"


def types_table(spark: SparkSession, rules: list[dict] | None = None) -> DataFrame:
    """``(qtype, rules)``: one row per known type with its rules in order."""
    grouped: dict[str, list[dict]] = {}
    for rule in field_rules() if rules is None else rules:
        grouped.setdefault(rule["qtype"], []).append(rule)
    return fixed_rows(spark, [{"qtype": t, "rules": r} for t, r in grouped.items()],
                      f"qtype string, rules array<struct<{FIELD_RULE}>>")


def columns_table(spark: SparkSession, rules: list[dict] | None = None) -> DataFrame:
    """``(field, columns)``: one row per table field with its column rules in order."""
    grouped: dict[str, list[dict]] = {}
    for rule in column_rules() if rules is None else rules:
        grouped.setdefault(rule["field"], []).append(rule)
    return fixed_rows(spark, [{"field": f, "columns": r} for f, r in grouped.items()],
                      f"field string, columns array<struct<{COLUMN_RULE}>>")
