"""The reduction: events to ranked clusters, histograms, samples and statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logdistill.config import DEFAULTS, Config
from logdistill.functions.traces import PARSERS, TraceParser
from logdistill.operators import clusters as C
from logdistill.operators.common import null_safe_join, stage
from logdistill.operators.enrich import prepare
from logdistill.operators.intervals import INTERVAL, window_signatures, windows_of
from logdistill.operators.sampling import sample_events
from logdistill.operators.stats import reduction_stats


@dataclass(frozen=True)
class Reduction:
    """Result tables of one reduction; each is a DataFrame keyed by the scope columns."""

    enriched: DataFrame
    signatures: DataFrame
    scope: tuple[str, ...]
    window_end: Column
    cfg: Config
    source_truncated: DataFrame | None = None

    @cached_property
    def all_clusters(self) -> DataFrame:
        """Every cluster with its score, before any budget."""
        found = C.cluster_events(self.signatures, self.scope)
        return C.score_clusters(found, self.scope, self.window_end)

    @cached_property
    def clusters(self) -> DataFrame:
        """The ranked clusters within the budget, staged: small, and read many times."""
        ranked = C.rank_clusters(self.all_clusters, self.scope, self.cfg.max_clusters)
        return stage(ranked, "clusters")

    @cached_property
    def endpoints(self) -> DataFrame:
        return C.cluster_endpoints(self.signatures, self.scope)

    @cached_property
    def statuses(self) -> DataFrame:
        return C.cluster_statuses(self.signatures, self.scope)

    @cached_property
    def samples(self) -> DataFrame:
        """Examples of the clusters within the budget, staged like them."""
        found = sample_events(
            self.enriched, self.clusters, self.scope, self.cfg.max_examples, self.cfg.example_chars
        )
        return stage(found, "samples")

    @cached_property
    def stats(self) -> DataFrame:
        return reduction_stats(
            self.signatures, self.clusters, self.scope, self.cfg, self.source_truncated
        )

    def summaries(self, top: int | None = None) -> DataFrame:
        """Cluster facts of a report: template cut to 300, endpoints counted and the top three."""
        key = [*self.scope, *C.CLUSTER_KEY]
        ranked = self.clusters if top is None else self.clusters.where(F.col("rank") <= top)
        ends = null_safe_join(self.endpoints, ranked.select(*key), key, "left_semi")
        sizes = ends.groupBy(*key).agg(F.count(F.lit(1)).alias("endpoint_count"))
        out = null_safe_join(ranked, sizes, key, "left")
        out = null_safe_join(out, C.top_endpoints(ends, self.scope), key, "left")
        return out.withColumns(
            {
                "template": F.substring("template", 1, 300),
                "endpoint_count": F.coalesce("endpoint_count", F.lit(0)),
            }
        ).drop("max_count", "scope_clusters", "fingerprints")


def reduce_events(
    events: DataFrame,
    scope: Sequence[str],
    window_end: Column,
    cfg: Config = DEFAULTS,
    parsers: Sequence[TraceParser] = PARSERS,
    source_truncated: DataFrame | None = None,
    keep_events: bool = True,
) -> Reduction:
    """Redact, enrich and cluster every scope of an event table in one pass.

    ``window_end`` is a column of the scope or a literal.  With ``keep_events`` the
    enriched events are staged, because samples read them again; without it only the
    signature table is, and the events are streamed through once.
    """
    enriched = prepare(events, cfg, parsers)
    if keep_events:
        enriched = stage(enriched, "enriched")
    sigs = stage(C.signatures(enriched, scope), "signatures")
    return Reduction(enriched, sigs, tuple(scope), window_end, cfg, source_truncated)


def reduce_intervals(
    events: DataFrame,
    members: DataFrame,
    scope: Sequence[str],
    window_end: Column,
    cfg: Config = DEFAULTS,
    parsers: Sequence[TraceParser] = PARSERS,
    keep_events: bool = True,
) -> Reduction:
    """Reduce windows that may overlap from events that each lie in one interval.

    Events are redacted, enriched and counted by interval, so once each; ``members`` tells
    which windows an interval counts for.  Samples read the staged events by window.
    """
    enriched = prepare(events, cfg, parsers)
    if keep_events:
        enriched = stage(enriched, "enriched")
    partials = stage(C.signatures(enriched, INTERVAL), "interval-signatures")
    sigs = stage(window_signatures(partials, members, scope), "signatures")
    return Reduction(windows_of(enriched, members), sigs, tuple(scope), window_end, cfg)
