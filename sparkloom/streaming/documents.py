"""Document changes as a stream: each micro-batch is one incremental synchronisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.operators.sync import latest


def follow(changes: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Applies a stream of ``source, markdown, deleted, ts`` rows batch by batch.

    Of several changes of a source in one batch the last counts. ``apply`` gets the documents to write and the sources to
    delete; it must commit atomically and be safe to repeat, as a batch that failed is sent again.
    """

    def run(batch: DataFrame, _: int) -> None:
        last = latest(batch, ["source"], F.col("ts"))
        apply(last.where("NOT deleted").select("source", "markdown"), last.where("deleted").select("source"))

    writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
