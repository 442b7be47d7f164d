"""Event-time operators for Structured Streaming; on batch frames they give the same rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Keys = Sequence[str]


def _marked(df: DataFrame, at: str, delay: str | None) -> DataFrame:
    return df.withWatermark(at, delay) if df.isStreaming and delay else df


def tumbling(df: DataFrame, at: str, size: str, keys: Keys, value: str, slide: str | None = None, delay: str | None = "10 minutes") -> DataFrame:
    """Rows, sum and maximum per key and window (hopping with ``slide``); rows later than ``delay`` are dropped when streaming."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    g = _marked(df, at, delay).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("peak"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total", "peak")


def session_windows(df: DataFrame, at: str, gap: str, keys: Keys, delay: str | None = "10 minutes") -> DataFrame:
    """Runs of rows per key with pauses shorter than ``gap``."""
    g = _marked(df, at, delay).groupBy(*keys, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(df: DataFrame, at: str, ids: Keys, delay: str = "10 minutes") -> DataFrame:
    """First row of each id; state is kept for ``delay`` of event time."""
    return df.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(ids)) if df.isStreaming else df.dropDuplicates(list(ids))


def correlated(requests: DataFrame, responses: DataFrame, key: str, at: str, within: str, delay: str = "10 minutes") -> DataFrame:
    """Stream-stream band join: responses up to ``within`` after their request."""
    a = _marked(requests, at, delay).select(F.col(key), F.col(at).alias("request_at"))
    b = _marked(responses, at, delay).select(F.col(key).alias("_k"), F.col(at).alias("response_at"))
    return a.join(b, (F.col(key) == F.col("_k")) & (F.col("response_at") >= F.col("request_at")) & (F.col("response_at") <= F.col("request_at") + F.expr(f"INTERVAL {within}"))).drop("_k")


def rolling(df: DataFrame, key: str, at: str, value: str, size: int, delay: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """Count-window statistics per key with state: each row with the mean, minimum and maximum of the
    last ``size`` values of its key; the state is those values, and it ends when the watermark has passed
    it by ``idle_ms``."""
    kind = dict(df.dtypes)[key]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        for pdf in frames:
            rows = []
            for r in pdf.sort_values(at).itertuples():
                held = [*held, float(getattr(r, value))][-size:]
                rows.append((k[0], getattr(r, at), len(held), sum(held) / len(held), min(held), max(held)))
            yield pd.DataFrame(rows, columns=[key, at, "n", "mean", "low", "high"])
        state.update((held,))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + idle_ms)

    return df.select(key, at, value).withWatermark(at, delay).groupBy(key).applyInPandasWithState(
        run, f"`{key}` {kind}, `{at}` timestamp, n int, mean double, low double, high double", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that a source has now, into a memory table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
