"""Peaks closed as samples arrive: a peak is a stretch of samples above a level; state of our own keeps the open ones.

Samples may come in any order within the watermark: they wait until the watermark has passed them, then they are taken in
order of time, so the peaks are those of :func:`closed_peaks` over the same samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PEAK = "start timestamp, end timestamp, apex timestamp, height double, area double, samples long"
#: What the state stores need that hold more than one value a key.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def closed_peaks(samples: DataFrame, level: float) -> DataFrame:
    """sample_id, start, end, apex, height, area (trapezoids, minutes), samples of each stretch above ``level`` that has ended.

    samples: sample_id, time, y, one a time. A stretch ends with the first sample at or below the level; one without is open and
    not there. The apex is the first of equal samples.
    """
    w = Window.partitionBy("sample_id").orderBy("time")
    high = F.coalesce(F.col("y") > level, F.lit(False))
    marked = samples.select("sample_id", "time", "y", high.alias("high"), F.coalesce(F.lag(high).over(w), F.lit(False)).alias("before"), F.lag("time").over(w).alias("t0"), F.lag("y").over(w).alias("y0"))
    runs = marked.withColumn("run", F.sum(F.when(F.col("high") & ~F.col("before"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    step = (F.unix_micros("time") - F.unix_micros("t0")) / 6e7
    strip = F.when(F.col("before") & F.col("high"), step * (F.col("y") + F.col("y0")) / 2).otherwise(0.0)
    ended = F.bool_or(~F.col("high"))
    above = lambda c: F.when(F.col("high"), c)
    found = runs.filter("run > 0").groupBy("sample_id", "run").agg(
        F.min(above(F.col("time"))).alias("start"), F.max(above(F.col("time"))).alias("end"), F.max_by("time", above(F.struct("y", (-F.unix_micros("time")).alias("t")))).alias("apex"),
        F.max(above(F.col("y"))).alias("height"), F.sum(strip).alias("area"), F.count(above(F.lit(1))).alias("samples"), ended.alias("ended"),
    )
    return found.filter("ended").drop("ended", "run")


#: Groups that samples are dealt to: a call of the state costs as much for all samples of a group as for one.
GROUPS = 1024


class OpenPeaks(StatefulProcessor):
    """Per group of samples: the samples' values that the watermark has not passed, and the peaks that are open."""

    def __init__(self, level: float):
        self.level = level

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "sample_id string, time long, y double")
        self.open = handle.getListState("open", "sample_id string, start long, last long, last_y double, apex long, height double, area double, samples long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for part in rows:
            time = part["time"].to_numpy().astype("datetime64[us]").astype(np.int64)
            fresh += zip(part["sample_id"].tolist(), time.tolist(), part["y"].astype(float).tolist(), strict=True)
        return self._advance(fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._advance([], timerValues.getCurrentWatermarkInMs())

    def _advance(self, fresh: list, watermark: int) -> Iterator[pd.DataFrame]:
        """Takes what the watermark has passed, in order; a timer comes back for the rest."""
        every = sorted([*map(tuple, self.waiting.get()), *fresh], key=lambda r: r[1])
        ready = [r for r in every if r[1] < watermark * 1000]
        rest = every[len(ready) :]
        if rest:
            if fresh or ready:
                self.waiting.put(rest)
            # milliseconds round down: the next one is past the first sample that waits
            self.handle.registerTimer(max(watermark, rest[0][1] // 1000) + 1)
        else:
            self.waiting.clear()
        closed: list[tuple] = []
        if ready:
            held = {r[0]: tuple(r)[1:] for r in self.open.get()}
            for sample, t, y in ready:
                now = held.get(sample)
                if y is not None and y > self.level:
                    if now is None:
                        held[sample] = (t, t, y, t, y, 0.0, 1)
                    else:
                        start, last, last_y, apex, height, area, n = now
                        held[sample] = (start, t, y, *((t, y) if y > height else (apex, height)), area + (t - last) / 6e7 * (y + last_y) / 2, n + 1)
                elif now is not None:
                    del held[sample]
                    closed.append((sample, now[0], now[1], now[3], now[4], now[5], now[6]))
            if held:
                self.open.put([(k, *v) for k, v in held.items()])
            else:
                self.open.clear()
        found = pd.DataFrame(closed, columns=["sample_id", "start", "end", "apex", "height", "area", "samples"])
        yield found.assign(**{c: pd.to_datetime(found[c], unit="us") for c in ("start", "end", "apex")})

    def close(self) -> None:
        pass


def online_peaks(samples: DataFrame, level: float, late: str = "10 minutes") -> DataFrame:
    """:func:`closed_peaks` of a stream of samples (sample_id, time, y); samples later than ``late`` are dropped.

    A peak comes out when the watermark has passed the sample that ends it. The session needs the state store that
    :func:`with_state` sets.
    """
    kind = samples.schema["sample_id"].dataType.simpleString()
    timed = samples.select("sample_id", F.col("time").cast("timestamp").alias("time"), "y").withWatermark("time", late)
    dealt = timed.select(F.pmod(F.xxhash64("sample_id"), F.lit(GROUPS)).alias("group"), F.col("sample_id").cast("string").alias("sample_id"), "time", "y")
    found = dealt.groupBy("group").transformWithStateInPandas(OpenPeaks(level), f"sample_id string, {PEAK}", "Append", "EventTime")
    return found.withColumn("sample_id", F.col("sample_id").cast(kind))


def with_state(spark: SparkSession) -> SparkSession:
    """Lets a session keep state of our own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark
