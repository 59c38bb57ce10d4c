"""Tables of analysis windows and their join with events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logdistill.config import DEFAULTS, Config
from logdistill.operators.filters import is_allowed

MINUTE_US = 60_000_000
# Above this many (window, bucket) rows the windows are shuffled, not broadcast.
BROADCAST_WINDOW_ROWS = 200_000
# Up to this many group names go into the scan's filter.
PUSHED_GROUPS = 200


def check_windows(
    windows: DataFrame, cfg: Config = DEFAULTS, allowlist: Sequence[str] | None = None
) -> DataFrame:
    """Add ``invalid_reason`` (null when the window may run) and a clamped ``row_limit``."""
    start, end = F.col("window_start"), F.col("window_end")
    span = F.unix_micros(end) - F.unix_micros(start)
    reason = F.when(start.isNull() | end.isNull(), "missing bound")
    if allowlist is not None:
        reason = reason.when(~is_allowed(F.col("log_group"), allowlist), "log group not allowed")
    reason = reason.when(end <= start, "end not after start").when(
        span > cfg.max_window_minutes * MINUTE_US, "longer than the maximum"
    )
    out = windows.withColumn("invalid_reason", reason)
    if "requested_limit" in windows.columns:
        asked = F.col("requested_limit")
        limit = F.when(asked > 0, F.least(asked, F.lit(cfg.query_limit)))
        out = out.withColumn("row_limit", F.coalesce(limit, F.lit(cfg.query_limit)).cast("bigint"))
    return out


def valid_windows(
    windows: DataFrame, cfg: Config = DEFAULTS, allowlist: Sequence[str] | None = None
) -> DataFrame:
    checked = check_windows(windows, cfg, allowlist)
    return checked.where(F.col("invalid_reason").isNull()).drop("invalid_reason")


def trace_window(hint: Column, now: Column, cfg: Config = DEFAULTS) -> tuple[Column, Column]:
    """Start and end around a time hint, or the longest allowed window up to now."""
    whole = cfg.max_window_minutes * MINUTE_US
    hint_us, now_us = F.unix_micros(hint), F.unix_micros(now)
    start = F.coalesce(hint_us - whole // 2, now_us - whole)
    return F.timestamp_micros(start), F.timestamp_micros(start + whole)


def split_window(windows: DataFrame, pieces: Column | int) -> DataFrame:
    """Cut each window into equal, gap-free pieces; the last one ends exactly at the end."""
    n = (pieces if isinstance(pieces, Column) else F.lit(pieces)).cast("bigint")
    start, end = F.unix_micros("window_start"), F.unix_micros("window_end")
    piece = windows.withColumn("slices", n).withColumn(
        "slice_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1))
    )

    def bound(i: Column) -> Column:
        return F.timestamp_micros(start + F.ceil((end - start) * i / F.col("slices")))

    return piece.withColumns(
        {"slice_start": bound(F.col("slice_no")), "slice_end": bound(F.col("slice_no") + 1)}
    )


@dataclass(frozen=True)
class WindowFacts:
    """Bucket width near the mean span, rows the windows then take, and their extent."""

    width: int
    rows: int
    start: datetime | None
    end: datetime | None
    groups: list[str] | None


def window_facts(windows: DataFrame) -> WindowFacts:
    """What the join with events needs to know of the windows, in one aggregate row.

    With the mean span as bucket width the windows explode to at most three rows each on
    average, however long or short they are.  Group names come back only if they are few.
    """
    span = F.unix_micros("window_end") - F.unix_micros("window_start")
    row = windows.agg(
        F.count(F.lit(1)).alias("n"), F.avg(span).alias("span"),
        F.min("window_start").alias("start"), F.max("window_end").alias("end"),
        F.count_distinct("log_group").alias("groups"),
    ).first()
    groups = None
    if row["groups"] <= PUSHED_GROUPS:
        names = windows.select("log_group").where(F.col("log_group").isNotNull()).distinct()
        groups = sorted(r[0] for r in names.limit(PUSHED_GROUPS).collect())
    width = max(MINUTE_US, int(row["span"] or 0))
    return WindowFacts(width, 3 * int(row["n"]), row["start"], row["end"], groups)


def within(events: DataFrame, facts: WindowFacts) -> DataFrame:
    """Events in the extent of all windows, by literals that reach the scan.

    The time range prunes row groups, the group names prune partitions.
    """
    if facts.start is None or facts.end is None:
        return events.where(F.lit(False))
    inside = (F.col("ts") >= F.lit(facts.start)) & (F.col("ts") < F.lit(facts.end))
    if facts.groups is not None:
        inside = inside & F.col("log_group").isin(facts.groups)
    return events.where(inside)


def events_in_windows(
    events: DataFrame, windows: DataFrame, bucket_us: int | None = None
) -> DataFrame:
    """Every (event, window) pair with the same log group and ``start <= ts < end``.

    Windows are spread over time buckets so that the interval join has an equal key
    (group, bucket): many windows of one busy group do not have to be tried one by one,
    and a busy group is split over its buckets.  A small windows table is broadcast;
    a larger one goes through a sort-merge join, whose hot buckets the adaptive
    skew handling splits.
    """
    facts = window_facts(windows)
    width, rows = bucket_us or facts.width, None if bucket_us else facts.rows
    events = within(events, facts)
    first = F.floor(F.unix_micros("window_start") / width)
    last = F.floor((F.unix_micros("window_end") - 1) / width)
    spread = (
        windows.where(F.col("window_end") > F.col("window_start"))
        .withColumn("__bucket", F.explode(F.sequence(first, last)))
        .withColumnRenamed("log_group", "__group")
    )
    if rows is not None:
        spread = F.broadcast(spread) if rows <= BROADCAST_WINDOW_ROWS else spread.hint("merge")
    bucket = F.floor(F.unix_micros("ts") / width)
    on = (
        (F.col("log_group") == F.col("__group"))
        & (bucket == F.col("__bucket"))
        & (F.col("ts") >= F.col("window_start"))
        & (F.col("ts") < F.col("window_end"))
    )
    return events.join(spread, on).drop("__group", "__bucket")
