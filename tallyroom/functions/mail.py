"""Expressions on recipients, server responses and messages."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

FAILED = "failed-to-send"
EXCEPTION = "exception"
QUEUED = "queued"


def row_key(row: Column) -> Column:
    """Id of a dataset row; its address when the id is missing or empty."""
    return F.coalesce(F.nullif(row["id"], F.lit("")), row["address"])


def response_parsed(response: Column) -> Column:
    """False for a response in which nothing but ``=`` follows its first part."""
    return F.coalesce(F.rtrim(response, F.lit("=")).contains("="), F.lit(True))


def smtp_message_id(response: Column) -> Column:
    """Text between the first and second ``=``; empty without a response, null if unparsable."""
    second = F.get(F.split(F.rtrim(response, F.lit("=")), "=", -1), 1)
    return F.when(response.isNull(), F.lit("")).otherwise(second)


def join_recipients(recipients: Column) -> Column:
    return F.array_join(recipients, ", ")


def first_address(addresses: Column) -> Column:
    return F.get(addresses, 0)


def base36(number: Column) -> Column:
    """Lower-case base 36, with a sign for numbers below zero."""
    digits = F.lower(F.conv(F.abs(number).cast("string"), 10, 36))
    return F.concat(F.when(number < 0, F.lit("-")).otherwise(F.lit("")), digits)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-free timestamp, rounded toward zero."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", origin, ts.cast("timestamp_ntz"))
    return F.call_function("div", micros, F.lit(1000000))


def fingerprint(date: Column, body: Column) -> Column:
    return F.concat(base36(epoch_seconds(date)), F.lit(":"), F.sha1(body))


def content_id(message_id: Column, position: Column) -> Column:
    """Repeatable id of an attachment, unique within its message."""
    text = F.concat_ws(":", message_id.cast("string"), position.cast("string"))
    return F.concat(F.substring(F.sha2(text, 256), 1, 16), F.lit("@message"))


def has_body(text: Column, html: Column) -> Column:
    return text.isNotNull() | html.isNotNull()


def json_holds(expected: object, actual: object) -> bool:
    """Lenient comparison: extra fields are allowed, arrays match in any order."""
    if isinstance(expected, dict):
        return isinstance(actual, dict) and all(
            k in actual and json_holds(v, actual[k]) for k, v in expected.items())
    if isinstance(expected, list):
        if not isinstance(actual, list) or len(expected) != len(actual):
            return False
        left = list(actual)
        for item in expected:
            found = next((i for i, other in enumerate(left) if json_holds(item, other)), None)
            if found is None:
                return False
            left.pop(found)
        return True
    return isinstance(expected, bool) == isinstance(actual, bool) and expected == actual


@F.pandas_udf(BooleanType())
def nested_json_holds(held: pd.Series, new: pd.Series) -> pd.Series:
    """Lenient comparison of nested JSON texts, for which there is no built-in."""
    return pd.Series([json_holds(json.loads(h), json.loads(n)) for h, n in zip(held, new)])
