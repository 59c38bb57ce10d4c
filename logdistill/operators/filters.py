"""Row filters: literal level and substring tests, time, blanks, allowlists."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logdistill.functions import patterns as P
from logdistill.functions.text import glob_regex, not_blank


def level_filter(events: DataFrame, level: str | None = "ERROR") -> DataFrame:
    """Messages holding the level word all upper or all lower case, as plain text."""
    if not level:
        return events
    message = F.col("message")
    return events.where(message.contains(level.upper()) | message.contains(level.lower()))


def contains_filters(
    events: DataFrame,
    service: str | None = None,
    exception_type: str | None = None,
    status_code: int | None = None,
    request_id: str | None = None,
    text: str | None = None,
) -> DataFrame:
    """Messages holding every given value literally; each test can reach the scan."""
    code = None if status_code is None else str(int(status_code))
    for value in (service, exception_type, code, request_id, text):
        if value:
            events = events.where(F.col("message").contains(value))
    return events


def time_window(events: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """Events in ``[start, end)``: a range predicate that prunes Parquet row groups."""
    ts = F.col("ts")
    return events.where(
        (ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp"))
    )


def drop_blank(events: DataFrame) -> DataFrame:
    return events.where(not_blank(F.col("message")))


def drop_bad_time(events: DataFrame) -> DataFrame:
    return events.where(F.col("ts").isNotNull())


def errors_only(events: DataFrame) -> DataFrame:
    """Any-case error words, the filter for events assembled from raw files."""
    return events.where(F.col("message").rlike(P.RAW_ERROR_WORDS))


def is_allowed(name: Column, patterns: Sequence[str]) -> Column:
    """True when a name matches one of the globs; an empty allowlist rejects all."""
    tests = [name.rlike(glob_regex(p)) for p in patterns]
    return reduce(lambda a, b: a | b, tests, F.lit(False)) & name.isNotNull()


def allowed_only(events: DataFrame, patterns: Sequence[str], column: str = "log_group") -> DataFrame:
    return events.where(is_allowed(F.col(column), patterns))


def glob_match(groups: DataFrame, patterns: Sequence[str], column: str = "name") -> DataFrame:
    """Each name with every allowlist pattern it matches, one row per match.

    The allowlist is configuration, so it is folded into the plan as literals and
    the match stays a narrow projection instead of a join without an equal key.
    """
    if not patterns:
        return groups.withColumn("pattern", F.lit(None).cast("string")).limit(0)
    name = F.col(column)
    hits = F.array_compact(
        F.array(*[F.when(name.rlike(glob_regex(p)), F.lit(p)) for p in patterns])
    )
    return groups.withColumn("pattern", F.explode(hits))
