"""Whole jobs over many log groups and windows: analyze, search, compare, offline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logdistill.config import DEFAULTS, Config
from logdistill.functions import patterns as P
from logdistill.operators import compare as D
from logdistill.operators.common import null_safe_join, small_side, stage
from logdistill.operators.enrich import prepare
from logdistill.operators.evidence import build_comparison_evidence, build_evidence
from logdistill.operators.filters import contains_filters, level_filter
from logdistill.operators.intervals import (
    INTERVAL,
    events_in_intervals,
    minute_counts,
    staged_sweep,
    window_timeline,
    windows_of,
)
from logdistill.operators.retrieve import (
    dedupe_events,
    newest_of_slices,
    trace_requests,
    trace_totals,
    volume_timeline,
)
from logdistill.operators.rollups import rollup_signatures, rollup_timeline
from logdistill.operators.stats import window_profile
from logdistill.operators.windows import check_windows, events_in_windows
from logdistill.plans.reduce import Reduction, reduce_events, reduce_intervals

# More than any window spans, yet small enough to count in microseconds.
ANY_MINUTES = 10**11
WINDOW_SCOPE = ("window_id", "log_group", "window_start", "window_end")


@dataclass(frozen=True)
class IncidentReport:
    """Tables of a report: one ``overview`` row per window, clusters, timeline, reduction."""

    overview: DataFrame
    clusters: DataFrame
    timeline: DataFrame
    reduction: Reduction

    def evidence(self, service: str | None = None) -> DataFrame:
        r = self.reduction
        return build_evidence(
            r.clusters, r.endpoints, r.statuses, r.samples, r.stats, r.scope,
            self.timeline, service, r.cfg,
        )


def wanted_events(events: DataFrame, level: str | None = "ERROR", **filters) -> DataFrame:
    """The bare columns of the events that pass the filters."""
    base = events.select("log_group", "log_stream", "ts", "message")
    return contains_filters(level_filter(base, level), **filters)


def matching_events(
    events: DataFrame, windows: DataFrame, extra: Sequence[str] = (), level: str | None = "ERROR",
    **filters,
) -> DataFrame:
    """Filtered events of every window, with the window's columns."""
    wanted = wanted_events(events, level, **filters)
    return events_in_windows(wanted, windows.select(*WINDOW_SCOPE, *extra))


def checked_windows(
    windows: DataFrame, cfg: Config, allowlist: Sequence[str] | None, max_minutes: int | None
) -> DataFrame:
    """Windows with ``invalid_reason``; the span is bounded only where a bound is given."""
    longest = max_minutes if max_minutes is not None else ANY_MINUTES
    return check_windows(windows, replace(cfg, max_window_minutes=longest), allowlist)


def _report(
    events: DataFrame,
    windows: DataFrame,
    cfg: Config,
    top: int | None,
    status: str,
    allowlist: Sequence[str] | None = None,
    max_minutes: int | None = None,
    retrieval_limit: int | None = None,
    **filters,
) -> IncidentReport:
    checked = checked_windows(windows, cfg, allowlist, max_minutes)
    # Rejected windows are never joined with events.
    valid = checked.where(F.col("invalid_reason").isNull())
    if retrieval_limit is None:
        intervals, members = staged_sweep(valid, WINDOW_SCOPE)
        matched = events_in_intervals(wanted_events(events, **filters), intervals)
        minutes = windows_of(minute_counts(matched, INTERVAL), members)
        timeline = window_timeline(minutes, WINDOW_SCOPE)
        unique = dedupe_events(matched, INTERVAL)
        r = reduce_intervals(unique, members, WINDOW_SCOPE, F.col("window_end"), cfg)
    else:
        # A limit holds per window, so windows keep events of their own.
        matched = matching_events(events, valid, **filters)
        timeline = volume_timeline(matched, WINDOW_SCOPE)
        kept, covered = newest_of_slices(matched, WINDOW_SCOPE, cfg, retrieval_limit)
        unique = dedupe_events(kept, WINDOW_SCOPE)
        r = reduce_events(unique, WINDOW_SCOPE, F.col("window_end"), cfg, source_truncated=covered)
    # Windows without a matching event get the calm row.
    rejected = F.col("invalid_reason").isNotNull()
    none = F.col("events_after_filtering").isNull() | (F.col("clusters") == 0)
    calm = none & ~rejected
    asked = checked.select(*WINDOW_SCOPE, "invalid_reason")
    overview = null_safe_join(asked, r.stats, WINDOW_SCOPE, "left").withColumns(
        {
            "summary": F.when(calm, F.lit(P.CALM_SUMMARY)),
            "severity": F.when(calm, F.lit("low")),
            "status": F.when(rejected, "rejected").when(calm, "ok").otherwise(F.lit(status)),
        }
    )
    counts = [
        "events", "events_after_filtering", "logical_events", "clusters", "clusters_after_budget",
        "clusters_in_evidence", "events_in_evidence", "query_slices",
    ]
    overview = overview.fillna(0, counts[:-1]).fillna(1, ["query_slices"]).fillna(
        0.0, ["compression_ratio"]
    ).withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    return IncidentReport(overview, r.summaries(top), timeline, r)


def analyze(
    events: DataFrame,
    windows: DataFrame,
    cfg: Config = DEFAULTS,
    service: str | None = None,
    allowlist: Sequence[str] | None = None,
    max_minutes: int | None = None,
    retrieval_limit: int | None = None,
) -> IncidentReport:
    """The deterministic report of every window: filter, timeline, dedup, reduce, top clusters.

    No model runs here, so windows with clusters have status ``unavailable``; the
    evidence documents are what a model would be given.  Windows without bounds, with
    an end not after the start, of a log group outside ``allowlist`` or longer than
    ``max_minutes`` have status ``rejected`` and an ``invalid_reason``.

    With ``retrieval_limit`` a window is cut into slices of which each yields its newest
    events only; overview and documents then tell from when on events were looked at.
    """
    return _report(
        events, windows, cfg, cfg.report_clusters, "unavailable", allowlist, max_minutes,
        retrieval_limit, service=service,
    )


def search_errors(
    events: DataFrame,
    windows: DataFrame,
    cfg: Config = DEFAULTS,
    service: str | None = None,
    exception_type: str | None = None,
    status_code: int | None = None,
    text: str | None = None,
    allowlist: Sequence[str] | None = None,
    max_minutes: int | None = None,
) -> IncidentReport:
    """As ``analyze`` with more filters, listing every cluster within the budget."""
    return _report(
        events, windows, cfg, None, "ok", allowlist, max_minutes, service=service,
        exception_type=exception_type, status_code=status_code, text=text,
    )


def report_from_rollup(
    events: DataFrame, windows: DataFrame, path: str, cfg: Config = DEFAULTS, **filters
) -> tuple[Reduction, DataFrame]:
    """Reduction and timeline of every window from a roll-up and the ends of windows.

    ``path`` was written by ``update_rollup`` from events with the same filters.  Nothing
    but samples reads all events of a window.
    """
    wanted = wanted_events(events, **filters)
    asked = windows.select(*WINDOW_SCOPE)
    sigs = rollup_signatures(events.sparkSession, path, wanted, asked, WINDOW_SCOPE, cfg)
    full = prepare(dedupe_events(events_in_windows(wanted, asked), WINDOW_SCOPE), cfg)
    r = Reduction(full, stage(sigs, "signatures"), WINDOW_SCOPE, F.col("window_end"), cfg)
    return r, rollup_timeline(events.sparkSession, path, wanted, asked, WINDOW_SCOPE)


@dataclass(frozen=True)
class Traces:
    """First events and totals of requests per window, and the windows not looked at."""

    events: DataFrame
    totals: DataFrame
    rejected: DataFrame


def trace_in_windows(
    events: DataFrame,
    request_ids: DataFrame | Sequence[str],
    windows: DataFrame,
    cfg: Config = DEFAULTS,
    allowlist: Sequence[str] | None = None,
    max_minutes: int | None = None,
) -> Traces:
    """Follow requests inside windows; only the windows' time range is read."""
    checked = checked_windows(windows, cfg, allowlist, max_minutes)
    base = events.select("log_group", "log_stream", "ts", "message")
    valid = checked.where(F.col("invalid_reason").isNull()).select(*WINDOW_SCOPE)
    inside = events_in_windows(base, valid)
    return Traces(
        trace_requests(inside, request_ids, WINDOW_SCOPE, cfg),
        trace_totals(inside, request_ids, WINDOW_SCOPE, cfg),
        checked.where(F.col("invalid_reason").isNotNull()).select(*WINDOW_SCOPE, "invalid_reason"),
    )


def analyze_events(
    events: DataFrame, scope: Sequence[str] = ("log_group",), cfg: Config = DEFAULTS
) -> tuple[Reduction, DataFrame]:
    """Reduce already fetched events, one window per scope from its first to last event.

    The window ends one second after the last event.  No level filter and no dedup.
    Returns the reduction and the windows table.
    """
    found = events.groupBy(*scope).agg(
        F.min("ts").alias("window_start"),
        (F.max("ts") + F.expr("INTERVAL 1 SECOND")).alias("window_end"),
    )
    bounds = stage(found, "bounds")
    framed = null_safe_join(events, small_side(bounds), scope)
    full = [*scope, "window_start", "window_end"]
    return reduce_events(framed, full, F.col("window_end"), cfg), bounds


@dataclass(frozen=True)
class Comparison:
    deltas: DataFrame
    new_endpoints: DataFrame
    profiles: DataFrame
    reduction: Reduction
    scope: tuple[str, ...]
    cfg: Config
    rejected: DataFrame

    def evidence(self) -> DataFrame:
        bounds = ("window_start", "window_end")
        return build_comparison_evidence(
            self.profiles, self.deltas, self.reduction.endpoints.drop(*bounds),
            self.reduction.statuses.drop(*bounds), self.new_endpoints, self.scope, self.cfg,
        )


def compare_windows(
    events: DataFrame,
    windows: DataFrame,
    scope: Sequence[str] = ("log_group",),
    cfg: Config = DEFAULTS,
    service: str | None = None,
    allowlist: Sequence[str] | None = None,
    max_minutes: int | None = None,
) -> Comparison:
    """Compare the clusters of ``baseline`` and ``comparison`` windows of every scope.

    ``windows`` has one row per side (column ``side``).  Both sides come from one scan;
    an event may fall into both.  No dedup.  ``max_clusters=None`` in the configuration
    compares all clusters instead of each side's best.
    """
    checked = checked_windows(windows, cfg, allowlist, max_minutes)
    valid = checked.where(F.col("invalid_reason").isNull())
    full = [*scope, "side", "window_start", "window_end"]
    intervals, members = staged_sweep(valid, full)
    matched = events_in_intervals(wanted_events(events, service=service), intervals)
    r = reduce_intervals(matched, members, full, F.col("window_end"), cfg, keep_events=False)
    bounds = ("window_start", "window_end")
    ranked = r.clusters.drop(*bounds)
    sided = [*scope, "side"]
    profiles = window_profile(r.stats.drop(*bounds), ranked, sided, cfg.report_clusters)
    return Comparison(
        D.cluster_deltas(ranked, scope),
        D.new_endpoints(r.endpoints.drop(*bounds), ranked, scope),
        profiles,
        r,
        tuple(scope),
        cfg,
        checked.where(F.col("invalid_reason").isNotNull()).select(*WINDOW_SCOPE, "side", "invalid_reason"),
    )


def without_budget(cfg: Config = DEFAULTS) -> Config:
    return replace(cfg, max_clusters=None)
