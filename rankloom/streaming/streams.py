"""Structured Streaming forms of log ingestion, deduplication, budgets, upserts and windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rankloom.config import DEFAULT
from rankloom.streaming.ledger import ResultTable, run


def log_stream(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """An append-only JSON log as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).json(path)


def timed(df: DataFrame, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """The column as a zoned timestamp with a watermark."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def dedup(df: DataFrame, keys: list[str], column: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return timed(df, column, late).dropDuplicatesWithinWatermark(keys)


def tumbling_counts(df: DataFrame, keys: list[str], width: str = "1 day", column: str = "ts", late: str = "1 hour") -> DataFrame:
    """n and total of ``value`` per window and key."""
    return timed(df, column, late).groupBy(F.window(column, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_counts(df: DataFrame, keys: list[str], gap: str = "30 minutes", column: str = "ts", late: str = "1 hour") -> DataFrame:
    """n per session of each key."""
    return timed(df, column, late).groupBy(F.session_window(column, gap), *keys).agg(F.count("*").alias("n"))


def running_budget(df: DataFrame, limit: float = DEFAULT.budget_usd) -> DataFrame:
    """scope, spent, calls, stopped after each batch; stream columns: scope, cost_usd."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, calls = state.get if state.exists else (0.0, 0)
        for x in batches:
            spent, calls = spent + float(x["cost_usd"].sum()), calls + len(x)
        state.update((spent, calls))
        yield pd.DataFrame({"scope": [key[0]], "spent": [spent], "calls": [calls], "stopped": [spent >= limit]})

    return df.groupBy("scope").applyInPandasWithState(step, "scope string, spent double, calls long, stopped boolean", "spent double, calls long", "update", GroupStateTimeout.NoTimeout)


def upsert_into(path: str, keys: list[str], version: str):
    """A foreachBatch function: the newest row of each key is kept in the result table at ``path`` (``ledger.ResultTable``)."""
    return lambda batch, batch_id: ResultTable(batch.sparkSession, path, keys, version).write(batch, "upsert", batch_id)


def drain(df: DataFrame, keys: list[str], mode: str, where: str) -> DataFrame:
    """Runs a stream over what is there into a result table under ``where``, keyed by ``keys``, and gives its rows.

    Rows go from executors to the table; the driver holds none of them.
    """
    table = ResultTable(df.sparkSession, f"{where}/table", keys)
    run(df, table, "drain", f"{where}/checkpoint", mode)
    found = table.read()
    return df.sparkSession.createDataFrame([], df.schema) if found is None else found
