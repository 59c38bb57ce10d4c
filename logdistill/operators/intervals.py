"""Elementary intervals of overlapping windows.

The bounds of all windows of a log group, in order, cut time into intervals that no
window begins or ends within.  An event lies in one interval however many windows hold
it, so it is redacted, parsed and counted once; windows then add up the counts of their
intervals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logdistill.operators.clusters import SIGNATURE_COLUMNS
from logdistill.operators.common import null_safe_join, stage
from logdistill.operators.retrieve import pick_bin_minutes, window_minutes
from logdistill.operators.windows import events_in_windows

INTERVAL = ("log_group", "interval_start", "interval_end")
MINUTE_US = 60_000_000


def sweep_windows(windows: DataFrame) -> DataFrame:
    """Disjoint intervals (``INTERVAL``) that together cover what the windows cover.

    Each bound opens or closes windows; where none is open there is no interval.
    """
    bounds = windows.where(F.col("window_end") > F.col("window_start")).select(
        "log_group",
        F.inline(
            F.array(
                F.struct(F.col("window_start").alias("interval_start"), F.lit(1).alias("step")),
                F.struct(F.col("window_end").alias("interval_start"), F.lit(-1).alias("step")),
            )
        ),
    )
    steps = bounds.groupBy("log_group", "interval_start").agg(F.sum("step").alias("step"))
    order = Window.partitionBy("log_group").orderBy("interval_start")
    return steps.select(
        "log_group",
        "interval_start",
        F.lead("interval_start").over(order).alias("interval_end"),
        F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("open"),
    ).where(F.col("open") > 0).drop("open")


def interval_members(intervals: DataFrame, windows: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Which windows (``scope``) hold an interval: those that hold its start."""
    at = intervals.withColumn("ts", F.col("interval_start"))
    bounds = ["log_group", "window_start", "window_end"]
    asked = windows.select(*dict.fromkeys([*scope, *bounds])).distinct()
    return events_in_windows(at, asked).select(*dict.fromkeys([*INTERVAL, *scope]))


def events_in_intervals(events: DataFrame, intervals: DataFrame) -> DataFrame:
    """Events with the one interval that holds them."""
    asked = intervals.withColumnsRenamed({"interval_start": "window_start", "interval_end": "window_end"})
    return events_in_windows(events, asked).withColumnsRenamed(
        {"window_start": "interval_start", "window_end": "interval_end"}
    )


def windows_of(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of intervals once for every window that holds the interval."""
    return null_safe_join(rows, members, INTERVAL).drop("interval_start", "interval_end")


def merge_signatures(partials: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Signature rows of parts added up: counts sum, first and last times extend."""
    return partials.groupBy(*scope, *SIGNATURE_COLUMNS).agg(
        F.sum("event_count").alias("event_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def window_signatures(partials: DataFrame, members: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The signatures of every window from those of its intervals."""
    return merge_signatures(windows_of(partials, members), scope)


def minute_counts(events: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Events per scope and minute, the part that every timeline bin is made of."""
    minute = F.unix_micros("ts") - F.pmod(F.unix_micros("ts"), F.lit(MINUTE_US))
    return events.groupBy(*scope, minute.alias("minute_us")).agg(F.count(F.lit(1)).alias("event_count"))


def window_timeline(minutes: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Volume per bin of every window; ``minutes`` has rows of ``minute_us`` in its scope.

    Bins are whole minutes wide, so a minute belongs to one bin of each window.
    """
    width = pick_bin_minutes(window_minutes()).cast("bigint") * MINUTE_US
    start = F.timestamp_micros(F.col("minute_us") - F.pmod("minute_us", width))
    return minutes.groupBy(*scope, start.alias("bin_start")).agg(F.sum("event_count").alias("event_count"))


def staged_sweep(windows: DataFrame, scope: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Intervals and members of a windows table, staged: small, and read several times."""
    asked = stage(windows.select(*dict.fromkeys([*scope, "log_group", "window_start", "window_end"])), "windows")
    intervals = stage(sweep_windows(asked), "intervals")
    return intervals, stage(interval_members(intervals, asked, scope), "members")
