"""Differences between the clusters of two windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logdistill.operators.common import CLUSTER_KEY, null_safe_join

SIDES = ("baseline", "comparison")


def cluster_deltas(ranked: DataFrame, scope: Sequence[str], keep_stable: bool = False) -> DataFrame:
    """New, disappeared, increased and decreased clusters per scope.

    ``ranked`` holds both sides, told apart by ``side``; (scope, side, cluster key) is
    unique, so grouping by (scope, cluster key) is the full outer match, with null
    exception types equal to each other and each side read once.  A cluster pushed out
    of one side's budget counts as absent there; rank without a budget for exact deltas.
    """
    sided = {}
    for side in SIDES:
        here = F.col("side") == side
        sided[f"{side}_count"] = F.max(F.when(here, F.col("event_count")))
        sided[f"{side}_id"] = F.max(F.when(here, F.col("cluster_id")))
        sided[f"{side}_rank"] = F.max(F.when(here, F.col("rank")))
    both = ranked.groupBy(*scope, *CLUSTER_KEY).agg(*[e.alias(n) for n, e in sided.items()])
    before, after = F.col("baseline_count"), F.col("comparison_count")
    ratio = after / before
    change = (
        F.when(before.isNull(), "new")
        .when(after.isNull(), "disappeared")
        .when(ratio.between(0.5, 2.0), "stable")
        .when(ratio > 2.0, "increased")
        .otherwise("decreased")
    )
    out = both.withColumns(
        {
            "cluster_id": F.coalesce("comparison_id", "baseline_id"),
            "change": change,
            "ratio": F.round(ratio, 2),
            "baseline_count": F.coalesce(before, F.lit(0)),
            "comparison_count": F.coalesce(after, F.lit(0)),
        }
    ).drop("comparison_id", "baseline_id")
    return out if keep_stable else out.where(F.col("change") != "stable")


def new_endpoints(
    endpoints: DataFrame, ranked: DataFrame, scope: Sequence[str]
) -> DataFrame:
    """Endpoints that a changed cluster hits in the comparison window only, one row each.

    Long form, because a cluster may have any number of endpoints; only endpoints of
    clusters within each side's budget take part, and only clusters that are reported
    as new, increased or decreased.
    """
    key = [*scope, *CLUSTER_KEY]
    kept = ranked.select(*key, "side")
    mine = null_safe_join(endpoints, kept, [*key, "side"], "left_semi")
    sides = mine.groupBy(*key, "endpoint").agg(
        F.max(F.col("side") == "baseline").alias("before"),
        F.max(F.col("side") == "comparison").alias("after"),
    )
    fresh = sides.where(F.col("after") & ~F.col("before")).drop("before", "after")
    return null_safe_join(fresh, cluster_deltas(ranked, scope).select(*key), key, "left_semi")
