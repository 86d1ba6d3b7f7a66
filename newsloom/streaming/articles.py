"""Arriving articles as a stream of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from newsloom.plans.runs import Run


def stream_articles(arriving: DataFrame, run: Run, checkpoint: str, now: Callable[[], str],
                    every: str | None = None, report: Callable[[int, dict], None] | None = None) -> StreamingQuery:
    """Feed every micro-batch of a streaming frame of article rows to
    `run.arrive`. Without `every` all available data is processed and the query
    ends; with it ('15 minutes') it keeps running. A new batch never starts
    before the last one is done."""

    def handle(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        counts = run.arrive(batch, now(), version=number + 1)
        if report:
            report(number, counts)

    writer = arriving.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
