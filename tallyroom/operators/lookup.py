"""Joins with a table that is small by nature, such as one row for each namespace, whatever the other side holds.

A plain join shuffles the large side by the key as soon as the small one is above the broadcast limit, and then a key that holds a third
of the rows is one task. Here the small side is written and measured: up to ``BROADCAST_BYTES`` it is broadcast, which
its measure allows; beyond that its rows are repeated for ``SALTS`` salts and the large side is spread by key and salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.workspace import stage

BROADCAST_BYTES, ROW_BYTES = 32_000_000, 64
SALTS = 32


def lookup(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined with ``small`` on ``keys``: left, inner, left_semi or left_anti."""
    small = stage(small)
    width = F.coalesce(F.octet_length(F.to_json(F.struct("*"))), F.lit(0)) + ROW_BYTES
    size = small.agg(F.sum(width)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), keys, how)
    # The salt decides where rows go and never what they meet, so any number that differs among rows will do.
    spread = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")
