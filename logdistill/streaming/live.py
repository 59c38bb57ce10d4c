"""The row-wise passes on live event streams.

Extraction, redaction and enrichment are projections, so ``operators.enrich.prepare`` runs
unchanged on a streaming DataFrame; deduplication and volumes need a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from logdistill.config import DEFAULTS, Config
from logdistill.functions.traces import PARSERS, TraceParser
from logdistill.operators import clusters as C
from logdistill.operators.enrich import prepare
from logdistill.operators.retrieve import EVENT_KEY

BIN = ("window_start", "window_end")


def dedupe_stream(events: DataFrame, scope: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """Drop copies of an event that arrive within the allowed lateness."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([*scope, *EVENT_KEY])


def stream_timeline(
    events: DataFrame, scope: Sequence[str], bin_minutes: int = 5, late: str = "10 minutes"
) -> DataFrame:
    """Events per bin and scope; a bin is final once the watermark has passed it."""
    bins = F.window("ts", f"{bin_minutes} minutes")
    return (
        events.withWatermark("ts", late)
        .groupBy(*scope, bins.alias("bin"))
        .agg(F.count(F.lit(1)).alias("event_count"))
        .select(*scope, F.col("bin.start").alias("bin_start"), "event_count")
    )


def stream_signatures(
    events: DataFrame, scope: Sequence[str], bin_minutes: int = 60, late: str = "10 minutes",
    cfg: Config = DEFAULTS, parsers: Sequence[TraceParser] = PARSERS,
) -> DataFrame:
    """Signature rows per scope and time bin (``BIN``), copies of events counted once.

    The state holds one row per signature of the open bins, not events.  In append mode
    the rows of a bin come once, all in the batch in which the watermark passes its end.
    """
    named = prepare(dedupe_stream(events, scope, late), cfg, parsers)
    bins = F.window("ts", f"{bin_minutes} minutes")
    counted = C.signatures(named.withColumn("bin", bins), [*scope, "bin"])
    return counted.withColumns({"window_start": F.col("bin.start"), "window_end": F.col("bin.end")}).drop("bin")


def stream_clusters(
    events: DataFrame, scope: Sequence[str], sink: Callable[[DataFrame, int], None], bin_minutes: int = 60,
    late: str = "10 minutes", cfg: Config = DEFAULTS,
) -> DataStreamWriter:
    """A writer that hands the ranked clusters of every finished bin to ``sink(clusters, batch_id)``.

    They equal those of the batch job over the same events.  A batch that is repeated after
    a failure has the same number, so a sink that overwrites by number gets each bin once.
    """
    key = [*scope, *BIN]

    def rank(batch: DataFrame, number: int) -> None:
        found = C.score_clusters(C.cluster_events(batch, key), key, F.col("window_end"))
        sink(C.rank_clusters(found, key, cfg.max_clusters), number)

    signatures = stream_signatures(events, scope, bin_minutes, late, cfg)
    return signatures.writeStream.outputMode("append").foreachBatch(rank)
