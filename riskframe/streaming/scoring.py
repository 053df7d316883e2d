"""Scoring of arriving rows with Structured Streaming."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.contract import ERRORS
from ..operators.score import Scorer


def scored_stream(stream: DataFrame, scorer: Scorer, threshold: float | None = None) -> DataFrame:
    """The scored valid rows of a stream (stateless: the batch plan under ``readStream``)."""
    return scorer.decide(scorer.contract.check(stream), threshold)


def start_scoring(
    stream: DataFrame,
    scorer: Scorer,
    output: str,
    quarantine: str,
    checkpoint: str,
    threshold: float | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score valid rows into one parquet table and set rejected rows aside in another.

    Each micro-batch replaces its own ``batch_id`` partition, so a batch that is run again
    after a failure leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = scorer.contract.check(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            scored = scorer.decide(checked, threshold)
            rejected = checked.where(F.size(ERRORS) > 0)
            for rows, path in ((scored, output), (rejected, quarantine)):
                rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        finally:
            checked.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
