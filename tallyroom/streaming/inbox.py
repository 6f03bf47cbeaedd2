"""Mailbox messages as a stream that consumes its files after they are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.operators.mail import inbox_ingest
from tallyroom.sources import store
from tallyroom.streaming.logs import drain

MESSAGE = "subject string, `from` array<string>, recipients array<string>, date timestamp_ntz, raw binary"
INBOX = "subject string, `from` string, `to` string, date timestamp_ntz, size int, fingerprint string, body binary"


def new_messages(spark: SparkSession, rows: DataFrame, target: str) -> DataFrame:
    """Inbox rows whose fingerprints are not stored yet, one of each. A fingerprint tells the date, so only files of these dates are read."""
    low, high = rows.agg(F.min("date"), F.max("date")).first()
    once = rows.dropDuplicates(["fingerprint"])
    if low is None:
        return once
    stored = store.read_batches(spark, target, INBOX).where(F.col("date").between(F.lit(low), F.lit(high))).select("fingerprint")
    return once.join(stored, "fingerprint", "left_anti").select(*rows.columns)


def ingest(spark: SparkSession, folder: str, archive: str, target: str, checkpoint: str, run: str | None = None) -> None:
    """Store the messages in ``folder`` (parquet files of MESSAGE) and move each file to ``archive`` once its batch is committed.

    Rows are keyed by fingerprint: a message that is delivered again, in another file or after a loss of the checkpoint, adds nothing.
    Files of the last batch are moved when the query goes on.
    """
    run = run or store.run_of(checkpoint)
    files = (spark.readStream.schema(MESSAGE).option("cleanSource", "archive").option("sourceArchiveDir", archive).parquet(folder))

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if not store.is_committed(session, target, batch_id, run, checkpoint):
            store.write_batch({"rows": new_messages(session, inbox_ingest(batch), target)}, target, batch_id, run, checkpoint)

    drain(files.writeStream.foreachBatch(step), checkpoint)
