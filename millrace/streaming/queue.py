"""Messages that name a stage, consumed from a stream."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A message: the stage, and how many rows at most or from which on.
MESSAGE = "type string, limit int, offset int"
RETRIES, DELAY = 3, 60.0


def messages_of_firing(users: DataFrame) -> DataFrame:
    """``(type, offset, seq)``: what one firing of the schedule asks for, in order:
    crawl, embed, a match for every eligible user, notify. (``Pipeline.match``
    takes all users at once, so a consumer may run one match for all.)"""
    numbered = users.where("resume is not null and resume <> '' and vectorize_id is not null").agg(F.count("*").alias("n"))
    match = numbered.where("n > 0").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("offset")).select(F.lit("match").alias("type"), "offset", (F.col("offset") + 2).alias("seq"))
    fixed = numbered.select(F.explode(F.expr("array(struct('crawl', 0L), struct('embed', 1L), struct('notify', n + 2))")).alias("m")).select(F.col("m.col1").alias("type"), F.lit(None).cast("bigint").alias("offset"), F.col("m.col2").alias("seq"))
    return fixed.unionByName(match)


def consume(
    messages: DataFrame, handlers: Mapping[str, Callable[[int | None], object]], checkpoint: str, failed: Callable[[str, str], None] | None = None, trigger: dict | None = None, retries: int = RETRIES, delay: float = DELAY, wait: Callable[[float], None] = time.sleep
) -> StreamingQuery:
    """Runs the handler of every kind of message in each micro-batch.

    Equal messages of a batch are one run, as a stage does all that is open. A
    handler that fails is run again after ``delay`` seconds, ``retries`` times,
    and then reported to ``failed`` as (type, error), so that it can't block the
    queue; without ``failed`` the stream stops. ``trigger`` is that of
    ``DataStreamWriter.trigger``, by default all that is there.
    """

    def run(batch: DataFrame, _: int) -> None:
        kinds = batch.groupBy("type").agg(F.max("limit").alias("limit")).where(F.col("type").isin(*handlers)).collect()  # one row a kind
        order = list(handlers)
        for row in sorted(kinds, key=lambda r: order.index(r["type"])):
            for left in range(retries, -1, -1):
                try:
                    handlers[row["type"]](row["limit"])
                    break
                except Exception as e:
                    if left:
                        wait(delay)
                    elif failed is None:
                        raise
                    else:
                        failed(row["type"], f"{type(e).__name__}: {e}")

    return messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def events_from(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder (where an endpoint
    that takes calls writes them)."""
    return spark.readStream.schema(schema).parquet(folder)
