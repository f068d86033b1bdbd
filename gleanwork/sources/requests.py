"""Requests from chat messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.functions.requests import command_argument, route_command


def read_requests(messages: DataFrame, keys: list[str], msg: str = "msg") -> DataFrame:
    """Messages that carry a command, as ``keys, cmd, arg``; works on streams too."""
    return messages.select(
        *keys, route_command(msg).alias("cmd"), command_argument(msg).alias("arg")
    ).filter(F.col("cmd").isNotNull())
