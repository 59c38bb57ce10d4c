"""Stored partial counts per log group and hour, and reports over any window from them.

A roll-up holds two tables under one path, partitioned by day: the signatures of every
hour and the number of events of every minute.  Both kinds of rows add up, so a window is
answered from its whole hours and a scan of the remainders at its two ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logdistill.config import DEFAULTS, Config
from logdistill.functions.traces import PARSERS, TraceParser
from logdistill.operators.clusters import signatures
from logdistill.operators.enrich import prepare
from logdistill.operators.intervals import merge_signatures, minute_counts, window_timeline
from logdistill.operators.retrieve import dedupe_events
from logdistill.operators.windows import events_in_windows, window_facts

HOUR_US = 3_600_000_000
HOURLY = ("log_group", "hour")


def update_rollup(
    events: DataFrame, path: str, cfg: Config = DEFAULTS, parsers: Sequence[TraceParser] = PARSERS
) -> None:
    """Add the days of ``events`` to the roll-up, replacing days that it already holds.

    ``events`` are the filtered events of whole days.  A day that is written again, after
    a failure or because events came late, takes the place of the earlier one.
    """
    base = events.select("log_group", "log_stream", "ts", "message").withColumn("hour", F.date_trunc("hour", "ts"))
    counted = signatures(prepare(dedupe_events(base, HOURLY), cfg, parsers), HOURLY)
    minutes = minute_counts(base, HOURLY)
    for name, table in (("signatures", counted), ("minutes", minutes)):
        dated = table.withColumn("day", F.to_date("hour"))
        dated.repartition("day", "log_group").write.mode("overwrite").partitionBy("day").option(
            "partitionOverwriteMode", "dynamic"
        ).parquet(f"{path}/{name}")


def read_rollup(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def split_at_hours(windows: DataFrame, scope: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Whole hours of every window, and what is left of it at both ends.

    Both tables have ``window_start`` and ``window_end`` of the part and ``asked``, the
    scope of the window.
    """
    start, end = F.unix_micros("window_start"), F.unix_micros("window_end")
    first = F.ceil(start / HOUR_US) * HOUR_US
    last = F.floor(end / HOUR_US) * HOUR_US
    has = first < last

    def part(a, b):
        return F.struct(F.timestamp_micros(a).alias("window_start"), F.timestamp_micros(b).alias("window_end"))

    base = windows.where(end > start).distinct().select(
        "log_group", F.struct(*scope).alias("asked"), part(first, last).alias("hours"), has.alias("has"),
        F.when(has, F.array(part(start, first), part(last, end))).otherwise(F.array(part(start, end))).alias("ends"),
    )
    hours = base.where("has").select("log_group", "asked", "hours.*")
    ends = base.select("log_group", "asked", F.inline("ends")).where(F.col("window_end") > F.col("window_start"))
    return hours, ends


def _asked(rows: DataFrame) -> DataFrame:
    """Rows with the scope of their window in place of the part that they matched."""
    return rows.drop("window_start", "window_end", "log_group").select("asked.*", "*").drop("asked")


def _stored(table: DataFrame, hours: DataFrame) -> DataFrame:
    """Stored rows of every window's whole hours; only the days in question are read."""
    facts = window_facts(hours)
    if facts.start is None:
        table = table.where(F.lit(False))
    else:
        table = table.where(F.col("day").between(F.lit(facts.start.date()), F.lit(facts.end.date())))
    timed = table.withColumnRenamed("hour", "ts").drop("day")
    return _asked(events_in_windows(timed, hours)).drop("ts")


def rollup_signatures(
    spark: SparkSession, path: str, events: DataFrame, windows: DataFrame, scope: Sequence[str],
    cfg: Config = DEFAULTS, parsers: Sequence[TraceParser] = PARSERS,
) -> DataFrame:
    """The signatures of every window, as a scan of all its events would count them.

    ``events`` are filtered like those of the roll-up; only the ends of windows are read.
    """
    hours, ends = split_at_hours(windows, scope)
    rest = events_in_windows(events.select("log_group", "log_stream", "ts", "message"), ends)
    rest = dedupe_events(_asked(rest), scope)
    counted = signatures(prepare(rest, cfg, parsers), scope)
    stored = _stored(read_rollup(spark, path, "signatures"), hours)
    return merge_signatures(stored.select(*counted.columns).unionByName(counted), scope)


def rollup_timeline(
    spark: SparkSession, path: str, events: DataFrame, windows: DataFrame, scope: Sequence[str]
) -> DataFrame:
    """Volume per bin of every window, from stored minutes and the ends of windows."""
    hours, ends = split_at_hours(windows, scope)
    rest = minute_counts(_asked(events_in_windows(events.select("log_group", "ts"), ends)), scope)
    stored = _stored(read_rollup(spark, path, "minutes"), hours)
    return window_timeline(stored.select(*rest.columns).unionByName(rest), scope)
