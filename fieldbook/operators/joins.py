"""Joins with tables that are small by nature, checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(table: DataFrame, most: int = 10_000) -> DataFrame:
    """The table, to be broadcast if it has at most so many rows; a larger one is joined as Spark sees fit."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def kept(table: DataFrame) -> DataFrame:
    """The table, computed once and stored in the checkpoint folder; without such a folder, it is computed wherever it is used."""
    return table.checkpoint() if table.sparkSession.sparkContext.getCheckpointDir() else table
