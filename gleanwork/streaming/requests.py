"""Commands as a stream, and requests handled once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanwork.functions.requests import command_argument, route_command
from gleanwork.model import MESSAGE_SCHEMA, TIMED_MESSAGE_SCHEMA
from gleanwork.operators.files import skip_existing
from gleanwork.sinks.tables import PARTS, part_of, read_table
from gleanwork.sources.requests import read_requests
from gleanwork.streaming.seen import seen_lately


def message_stream(
    spark: SparkSession, folder: str, files_per_batch: int = 1000, schema: str = MESSAGE_SCHEMA
) -> DataFrame:
    """Messages that arrive as files in a folder."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def route_stream(messages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Route messages to ``out`` as they arrive; stateless, stops when all are read."""
    return (
        read_requests(messages, ["msg_id"])
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .format("parquet")
        .start(out)
    )


def seen_stream(messages: DataFrame, out: str, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Append each (cmd, arg) the first time it is asked for.

    The table written is the memory of what was seen, so no state store grows with
    the stream. A batch that is run again finds its rows there and adds nothing.
    """

    def add_new(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        fresh = skip_existing(batch, read_table(session, out), ["cmd", "arg"], "msg_id")
        (
            fresh.withColumn("part", part_of(F.concat("cmd", "arg"), parts))
            .hint("rebalance", "part")
            .write.mode("append")
            .partitionBy("part")
            .parquet(out)
        )

    return (
        read_requests(messages, ["msg_id"])
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(add_new)
        .start()
    )


def requests_seen_lately(spark: SparkSession, folder: str, keep: str, delay: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of the (cmd, arg) that were not asked for within ``keep``, with their first message.

    Unlike ``seen_stream`` it remembers for a time only, so its state is bounded. Messages
    without a command are no requests, but their time counts as time that has passed.
    """
    messages = message_stream(spark, folder, files_per_batch, TIMED_MESSAGE_SCHEMA)
    routed = messages.select("msg_id", "sent_at", route_command("msg").alias("cmd"), command_argument("msg").alias("arg"))
    asked = routed.withColumn("arg", F.when(F.col("cmd").isNotNull(), F.col("arg")))
    return seen_lately(asked, ["cmd", "arg"], "msg_id", "sent_at", keep, delay)
