"""Failure clusters in two levels.

Level 1, ``signatures``, is the only pass over events: one hash aggregate whose
buffers are a count and two times, so every map task folds a dominant failure to
one row before the shuffle.  Everything else in this module reads that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logdistill.functions import patterns as P
from logdistill.functions.text import non_empty, not_blank
from logdistill.operators.common import CLUSTER_KEY, null_safe_join, numbered

SIGNATURE_COLUMNS = (
    "is_blank", "exception_type", "template", "fingerprint", "endpoint", "status_code", "level",
)


def cluster_template() -> Column:
    """The template, or the start of the message when there is none."""
    return F.coalesce(non_empty(F.col("template")), F.substring("message", 1, 200))


def signatures(enriched: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Events counted by everything clusters are told apart or described by.

    Blank messages keep a row of their own (``is_blank``) so that the reduction
    statistics need no second pass.
    """
    blank = ~not_blank(F.col("message"))
    shown = {
        "is_blank": blank,
        "template": F.when(~F.col("is_blank"), cluster_template()),
        "fingerprint": F.coalesce(non_empty(F.col("fingerprint")), F.lit("unfingerprinted")),
        "endpoint": non_empty(F.col("endpoint")),
    }
    marked = enriched.withColumn("is_blank", shown.pop("is_blank")).withColumns(shown)
    return marked.groupBy(*scope, *SIGNATURE_COLUMNS).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def _visible(sigs: DataFrame) -> DataFrame:
    return sigs.where(~F.col("is_blank"))


def logical_events(sigs: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Distinct fingerprints per scope."""
    return (
        _visible(sigs).groupBy(*scope).agg(F.count_distinct("fingerprint").alias("logical_events"))
    )


# Register bits of the sketches: the standard error is about 1.04 / sqrt(2 ** bits), 1.6 %.
SKETCH_BITS = 12


def logical_sketches(sigs: DataFrame, scope: Sequence[str]) -> DataFrame:
    """A mergeable sketch of the distinct fingerprints per scope, for example per hour."""
    return _visible(sigs).groupBy(*scope).agg(F.hll_sketch_agg("fingerprint", SKETCH_BITS).alias("sketch"))


def approximate_logical_events(sketches: DataFrame, scope: Sequence[str]) -> DataFrame:
    """About how many distinct fingerprints the sketches of each scope hold together."""
    return sketches.groupBy(*scope).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("logical_events")
    )


def cluster_events(sigs: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One row per (scope, exception type, template).

    The id is the most frequent fingerprint, ties to the larger one; the level is
    that of the earliest event, ties to the smaller one.
    """
    key = [*scope, *CLUSTER_KEY]
    by_fingerprint = (
        _visible(sigs)
        .groupBy(*key, "fingerprint")
        .agg(
            F.sum("event_count").alias("n"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.min(F.struct("first_seen", "level")).alias("earliest"),
            F.max(F.col("status_code").between(500, 599)).alias("has_5xx"),
        )
    )
    return (
        by_fingerprint.groupBy(*key)
        .agg(
            F.max(F.struct("n", "fingerprint"))["fingerprint"].alias("cluster_id"),
            F.sum("n").alias("event_count"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.min("earliest")["level"].alias("level"),
            F.coalesce(F.max("has_5xx"), F.lit(False)).alias("has_5xx"),
            F.count(F.lit(1)).alias("fingerprints"),
        )
    )


def cluster_endpoints(sigs: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Endpoint histogram in long form; a cluster may have any number of endpoints."""
    return (
        _visible(sigs)
        .where(F.col("endpoint").isNotNull())
        .groupBy(*scope, *CLUSTER_KEY, "endpoint")
        .agg(
            F.sum("event_count").alias("event_count"),
            F.min("first_seen").alias("first_seen"),
        )
    )


def cluster_statuses(sigs: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Status histogram in long form, with the code as text."""
    return (
        _visible(sigs)
        .where(F.col("status_code").isNotNull())
        .groupBy(*scope, *CLUSTER_KEY, F.col("status_code").cast("string").alias("status"))
        .agg(
            F.sum("event_count").alias("event_count"),
            F.min("first_seen").alias("first_seen"),
        )
    )


def score_clusters(clusters: DataFrame, scope: Sequence[str], window_end: Column) -> DataFrame:
    """Add ``score``: frequency, recency, severity, server errors and exceptions, weighted.

    The frequency denominator comes from a grouped maximum over all clusters of the
    scope (before any budget), joined back, so no scope is ranked in one piece for it.
    """
    top = clusters.groupBy(*scope).agg(
        F.max("event_count").alias("max_count"), F.count(F.lit(1)).alias("scope_clusters")
    )
    age_us = F.unix_micros(window_end) - F.unix_micros("last_seen")
    recency = F.when(age_us <= P.RECENT_SECONDS * 1_000_000, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - age_us / F.lit(1e6) / F.lit(P.RECENCY_SPAN_SECONDS))
    )
    name = F.upper(F.coalesce(non_empty(F.col("level")), F.lit("ERROR")))
    severity = F.lit(P.SEVERITY_OTHER)
    for word, weight in reversed(P.SEVERITY_WEIGHTS.items()):
        severity = F.when(name == word, F.lit(weight)).otherwise(severity)
    w = P.SCORE_WEIGHTS
    score = (
        F.lit(w["frequency"]) * (F.col("event_count") / F.col("max_count"))
        + F.lit(w["recency"]) * recency
        + F.lit(w["severity"]) * severity
        + F.when(F.col("has_5xx"), F.lit(w["server"])).otherwise(F.lit(0.0))
        + F.when(F.col("exception_type").isNotNull(), F.lit(w["exception"])).otherwise(F.lit(0.0))
    )
    return null_safe_join(clusters, top, scope).withColumn("score", F.round(score, 4))


def best_first() -> list[Column]:
    return [F.desc("score"), F.desc("event_count"), *[F.asc(c) for c in ("cluster_id", *CLUSTER_KEY)]]


def ranking(scope: Sequence[str]):
    return Window.partitionBy(*scope).orderBy(*best_first())


def rank_clusters(scored: DataFrame, scope: Sequence[str], budget: int | None) -> DataFrame:
    """Keep the ``budget`` best clusters of every scope with their ``rank``.

    The rank filter is applied per task before the shuffle, so a scope with very many
    clusters sends only its candidates.  Without a budget all clusters stay: they are
    numbered in range partitions, and the first number of each scope is taken off.
    """
    if budget is None:
        at = numbered(scored, [*[F.asc(c) for c in scope], *best_first()], "__number")
        first = at.groupBy(*scope).agg(F.min("__number").alias("__first"))
        return (
            null_safe_join(at, first, scope)
            .withColumn("rank", (F.col("__number") - F.col("__first") + 1).cast("int"))
            .drop("__number", "__first")
        )
    return scored.withColumn("rank", F.row_number().over(ranking(scope))).where(
        F.col("rank") <= budget
    )


def top_endpoints(endpoints: DataFrame, scope: Sequence[str], keep: int = 3) -> DataFrame:
    """The most frequent endpoints of every cluster as one text, e.g. ``/a (3), /b (1)``."""
    key = [*scope, *CLUSTER_KEY]
    order = Window.partitionBy(*key).orderBy(F.desc("event_count"), "first_seen", "endpoint")
    return (
        endpoints.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= keep)
        .groupBy(*key)
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("place", "endpoint", "event_count"))),
                    lambda e: F.format_string("%s (%d)", e["endpoint"], e["event_count"]),
                ),
                ", ",
            ).alias("top_endpoints")
        )
    )


def template_counts(
    enriched: DataFrame, scope: Sequence[str], template: str = "template"
) -> DataFrame:
    """Template mining: count, first and last time and share of the scope's events."""
    counts = enriched.groupBy(*scope, template).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )
    total = counts.groupBy(*scope).agg(F.sum("event_count").alias("scope_events"))
    return null_safe_join(counts, total, scope).withColumn(
        "share", F.round(F.col("event_count") / F.col("scope_events"), 6)
    )
