"""Structured Streaming twins of the telemetry operators.

Event time is ``ts``; rows later than the watermark (a day for day windows) are dropped, a choice of this library.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def window_counts(events: DataFrame, unit: str = "1 minute", late: str = "1 day") -> DataFrame:
    """Requests per key and fixed window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", unit), "key").count().select("key", F.col("window.start").alias("start"), "count")


def daily_usage(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """Calls and tokens per UTC day."""
    by = calls.withWatermark("ts", late).groupBy(F.window("ts", "1 day"))
    return by.agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens")).select(F.col("window.start").alias("day"), "calls", "tokens")


def once_per_request(requests: DataFrame, late: str = "1 day") -> DataFrame:
    """Each request id once within the watermark."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"])


def log_sink(requests: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Append requests to day partitions, each once; returns the writer, to be started by the caller."""
    rows = once_per_request(requests).withColumn("day", F.to_date("ts"))
    return rows.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


class RateState(StatefulProcessor):
    """Admits a key's requests while its minute and its day have room; a request its minute rejects leaves the day alone."""

    def __init__(self, per_minute: int, per_day: int):
        self.limits = per_minute, per_day

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("windows", "minute long, in_minute int, day long, in_day int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        minute, in_minute, day, in_day = self.state.get() or (-1, 0, -1, 0)
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for at, event_id in zip(pdf["ts"], pdf["event_id"], strict=True):
            second = int(at.timestamp())
            if second // 60 != minute:
                minute, in_minute = second // 60, 0
            if second // 86400 != day:
                day, in_day = second // 86400, 0
            in_minute += 1
            by = "minute" if in_minute > self.limits[0] else None
            if by is None:
                in_day += 1
                by = "day" if in_day > self.limits[1] else None
            out.append((key[0], event_id, by is None, by))
        self.state.update((minute, in_minute, day, in_day))
        yield pd.DataFrame(out, columns=["key", "event_id", "allowed", "rejected_by"])

    def close(self) -> None:
        pass


def rate_decisions(events: DataFrame, per_minute: int, per_day: int) -> DataFrame:
    """Per request of a stream (key, ts, event_id): allowed, rejected_by; a batch of a key is judged in (ts, event_id) order.

    Needs the RocksDB state store; input has to arrive in order between batches.
    """
    return events.groupBy("key").transformWithStateInPandas(
        RateState(per_minute, per_day), "key string, event_id long, allowed boolean, rejected_by string", "append", "None"
    )


def with_active_version(requests: DataFrame, versions_path: str, write):  # noqa: ANN001, ANN201
    """Join every micro-batch to the version table as it is then, and hand it to ``write(df, batch_id)``."""

    def batch(df: DataFrame, batch_id: int) -> None:
        active = df.sparkSession.read.parquet(versions_path).where("is_active").select("index_version_id").limit(1)
        write(df.join(F.broadcast(active), F.lit(True), "left"), batch_id)

    return requests.writeStream.foreachBatch(batch)
