"""Expressions on mail-server log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a log line is a second-resolution time, a message id of 6-6-2 letters or
# digits and the rest, separated by single spaces.
LINE_PATTERN = r"(?i)^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} [a-z0-9]{6}-[a-z0-9]{6}-[a-z0-9]{2} .*$"
# All parts but the last have fixed widths, so one match and three slices are enough.
TIME_WIDTH, ID_START, ID_WIDTH, TEXT_START = 19, 21, 16, 38


def is_log_line(value: Column) -> Column:
    return value.rlike(LINE_PATTERN)


def line_time(value: Column) -> Column:
    return F.substring(value, 1, TIME_WIDTH)


def line_id(value: Column) -> Column:
    return F.substring(value, ID_START, ID_WIDTH)


def line_text(value: Column) -> Column:
    return F.substr(value, F.lit(TEXT_START))
