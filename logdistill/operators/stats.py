"""Reduction statistics, window profiles and volume savings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logdistill.config import DEFAULTS, Config
from logdistill.operators.clusters import logical_events
from logdistill.operators.common import CLUSTER_KEY, null_safe_join


def reduction_stats(
    sigs: DataFrame,
    ranked: DataFrame,
    scope: Sequence[str],
    cfg: Config = DEFAULTS,
    source_truncated: DataFrame | None = None,
) -> DataFrame:
    """One row per scope: how far its events were reduced.

    ``source_truncated`` optionally gives (scope, truncated, covered_from, slices) of
    a capped retrieval.  Nothing here reads events: the signature table already counts
    blank ones separately.
    """
    visible = ~F.col("is_blank")
    totals = sigs.groupBy(*scope).agg(
        F.sum("event_count").alias("events"),
        F.sum(F.when(visible, F.col("event_count")).otherwise(0)).alias("events_after_filtering"),
    )
    distinct = (
        sigs.where(visible).select(*scope, *CLUSTER_KEY).distinct().groupBy(*scope)
        .agg(F.count(F.lit(1)).alias("clusters"))
    )
    shown = F.least(F.col("event_count"), F.lit(cfg.max_examples))
    sent = F.col("rank") <= cfg.evidence_clusters
    budget = ranked.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("clusters_after_budget"),
        F.count_if(sent).alias("clusters_in_evidence"),
        F.sum(F.when(sent, shown).otherwise(0)).alias("events_in_evidence"),
    )
    out = totals
    for part in (logical_events(sigs, scope), distinct, budget):
        out = null_safe_join(out, part, scope, "left")
    counted = [
        "logical_events", "clusters", "clusters_after_budget", "clusters_in_evidence",
        "events_in_evidence",
    ]
    out = out.fillna(0, counted)
    cut = F.col("clusters") > F.col("clusters_after_budget")
    if source_truncated is not None:
        facts = source_truncated.select(
            *scope, F.col("truncated").alias("__cut"), "covered_from", "slices"
        )
        out = null_safe_join(out, facts, scope, "left").withColumns(
            {
                "truncated": cut | F.coalesce("__cut", F.lit(False)),
                "query_slices": F.coalesce("slices", F.lit(1)).cast("bigint"),
            }
        ).drop("__cut", "slices")
    else:
        out = out.withColumns(
            {
                "truncated": cut,
                "covered_from": F.lit(None).cast("timestamp"),
                "query_slices": F.lit(1).cast("bigint"),
            }
        )
    return out.withColumn("compression_ratio", compression(F.col("events_in_evidence")))


def compression(sent: Column, events: Column | None = None) -> Column:
    events = F.col("events") if events is None else events
    return F.when(events == 0, F.lit(0.0)).otherwise(F.round(sent / events, 4))


def window_profile(
    stats: DataFrame, ranked: DataFrame, scope: Sequence[str], top: int = 10
) -> DataFrame:
    """Total events of every window with its best clusters, one row per cluster."""
    best = ranked.where(F.col("rank") <= top).select(
        *scope, "rank", "cluster_id", *CLUSTER_KEY, "event_count", "first_seen", "last_seen",
        "score",
    )
    totals = stats.select(*scope, F.col("events").alias("total_events"))
    return null_safe_join(totals, best, scope, "left").withColumn(
        "template", F.substring("template", 1, 300)
    )


def volume_reduction(events: DataFrame, report: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Characters of the raw dump against those of the report, with the share saved.

    A raw event is dumped as ``[time] message`` on a line of its own, its time with
    milliseconds; ``report`` has one ``evidence`` text per scope.  Tokens are
    characters / 4.
    """
    stamp = len("[2024-01-01 00:00:00.000] ")
    raw = events.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("events"),
        (F.sum(F.length("message") + (stamp + 1)) - 1).alias("raw_chars"),
    )
    size = report.select(*scope, F.length("evidence").cast("bigint").alias("report_chars"))
    return null_safe_join(raw, size, scope).withColumns(
        {
            "raw_tokens": F.floor(F.col("raw_chars") / 4),
            "report_tokens": F.floor(F.col("report_chars") / 4),
            "percent_saved": F.round(
                (F.lit(1.0) - F.col("report_chars") / F.col("raw_chars")) * 100, 2
            ),
        }
    )
