"""Event streams: late data, duplicates, windows, token buckets.

Transformations take a batch or a streaming DataFrame; watermarks only matter for
the latter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.schema import EVENTS


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 24) -> DataFrame:
    """Stream of a folder to which hourly NDJSON files are added."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(path)


def parquet_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1, pattern: str = "*.parquet") -> DataFrame:
    """Stream of a folder's Parquet files shaped ``like`` a table."""
    options = {"maxFilesPerTrigger": str(files_per_trigger), "pathGlobFilter": pattern}
    return spark.readStream.schema(like.schema).options(**options).parquet(path)


def distinct_events(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each key once; in a stream its state is kept for as long as events may be ``late``."""
    if events.isStreaming:
        return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def tumbling(events: DataFrame, at: str, width: str, *by: str, late: str = "1 hour") -> DataFrame:
    """(window_start, by..., n) of fixed windows."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    counted = rows.groupBy(F.window(at, width).alias("_w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("_w.start").alias("window_start"), *by, "n")


def sliding(events: DataFrame, at: str, width: str, step: str, *by: str, late: str = "1 hour") -> DataFrame:
    """(window_start, by..., n) of overlapping windows."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    counted = rows.groupBy(F.window(at, width, step).alias("_w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("_w.start").alias("window_start"), *by, "n")


def sessions(events: DataFrame, at: str, gap: str, *by: str, late: str = "1 hour") -> DataFrame:
    """(by..., session_start, session_end, n): stretches without a pause of ``gap``."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    counted = rows.groupBy(F.session_window(at, gap).alias("_w"), *by).agg(F.count("*").alias("n"))
    return counted.select(*by, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "n")


def breaker(events: DataFrame, at: str, failed: Column, seconds: int = 600, limit: int = 5, *by: str, stretch: int = 20) -> DataFrame:
    """Add ``recent`` (failures in the last ``seconds``, itself included) and ``stop`` (at least ``limit``).

    Time is cut into stretches of ``stretch`` x ``seconds``; an event also goes to
    the next stretch as context if it lies in reach of it. A group that holds most
    events is thus spread over many tasks.
    """
    width = seconds * 1_000_000
    us = F.unix_micros(F.col(at).cast("timestamp"))
    own = F.floor(us / F.lit(width * stretch)).cast("bigint")
    near_end = F.floor((us + width) / F.lit(width * stretch)).cast("bigint") > own
    rows = events.withColumn("_us", us).withColumn("_f", failed.cast("int")).withColumn(
        "_s", F.explode(F.when(near_end, F.array(F.struct(own.alias("b"), F.lit(True).alias("own")), F.struct((own + 1).alias("b"), F.lit(False).alias("own"))))
                        .otherwise(F.array(F.struct(own.alias("b"), F.lit(True).alias("own"))))))
    spread = Window.partitionBy(*by, "_s.b").orderBy("_us").rangeBetween(-width, 0)
    counted = rows.withColumn("recent", F.sum("_f").over(spread)).filter("_s.own").drop("_us", "_f", "_s")
    return counted.withColumn("stop", F.col("recent") >= limit)


def cost(offset: Column, limit: Column) -> Column:
    """What a request costs: deep pages and long lists more."""
    return (F.lit(1.0) + offset / 200.0) * (1.0 + limit / 100.0)


def limited(events: DataFrame, client: str, at: str, price: str, rate: float, burst: float, late: str = "1 hour") -> DataFrame:
    """(client, at, price, allowed): a token bucket a client, in a stream or a batch.

    Tokens refill with ``rate`` a second up to ``burst``; a request is allowed if
    they cover its price. Requests of one client are taken in order of time. State
    is two numbers a client and goes once the watermark is an hour past its last request.
    """
    c_type = events.schema[client].dataType.simpleString()
    t_type = events.schema[at].dataType.simpleString()
    schema = f"`{client}` {c_type}, `{at}` {t_type}, `{price}` double, allowed boolean"

    def spend(frame: pd.DataFrame, tokens: float, last: float | None) -> tuple[pd.DataFrame, float, float | None]:
        allowed = []
        for t, p in zip(frame[at].map(lambda x: x.timestamp()), frame[price]):
            tokens = min(burst, tokens + (max(0.0, t - last) * rate if last is not None else 0.0))
            ok = tokens >= p
            tokens -= p if ok else 0.0
            last = t if last is None else max(last, t)
            allowed.append(bool(ok))
        return frame.assign(allowed=allowed)[[client, at, price, "allowed"]], tokens, last

    if not events.isStreaming:
        # Sorted by client and time, requests stream past two numbers; no client's requests are gathered.
        ordered = events.select(client, at, F.col(price).cast("double").alias(price)).repartition(client).sortWithinPartitions(client, at)

        def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, tokens, last = object(), burst, None
            for frame in frames:
                parts = []
                for who, part in frame.groupby(client, sort=False, dropna=False):
                    if not (who == now or (pd.isna(who) and now is None)):
                        now, tokens, last = (None if pd.isna(who) else who), burst, None
                    done, tokens, last = spend(part, tokens, last)
                    parts.append(done)
                if parts:
                    yield pd.concat(parts)

        return ordered.mapInPandas(walk, schema)

    def stateful(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (burst, None)
        got = [f for f in frames]
        if got:
            out, tokens, last = spend(pd.concat(got).sort_values(at, kind="stable"), tokens, last)
            state.update((float(tokens), float(last)))
            state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + 3_600_000)
            yield out

    rows = events.select(client, at, F.col(price).cast("double").alias(price)).withWatermark(at, late)
    return rows.groupBy(client).applyInPandasWithState(stateful, schema, "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def write_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; a later run goes on where this one ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
