"""Deduplication, searches, slicing, request traces and timelines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logdistill.config import DEFAULTS, Config
from logdistill.functions import patterns as P
from logdistill.operators.common import null_safe_join, numbered, stage
from logdistill.operators.enrich import extract_fields, redact
from logdistill.operators.idfilter import bloom_filter, filter_bits, gram_for, probe_hits, probes_of

# Id tables with more characters or rows than this are not broadcast by a trace.
BROADCAST_ID_CHARS = 64 << 20
BROADCAST_IDS = 1_000_000
EVENT_KEY = ("ts", "message", "log_stream")


def newest_first() -> list[Column]:
    return [F.desc("ts"), F.asc("log_stream"), F.asc("message")]


def oldest_first() -> list[Column]:
    return [F.asc("ts"), F.asc("log_stream"), F.asc("message")]


def dedupe_events(events: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One event per (scope, time, message, stream).

    Run it on the bare event columns: the distinct then has no payload to carry and
    folds copies on the map side.
    """
    key = [*scope, *EVENT_KEY]
    return events.select(*key).distinct() if set(events.columns) <= set(key) else (
        events.dropDuplicates(key)
    )


def union_slices(slices: Sequence[DataFrame]) -> DataFrame:
    """Rows of several sources or slices as one table; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), slices)


def search_events(
    events: DataFrame, limit: int | None = None, scope: Sequence[str] = ()
) -> DataFrame:
    """Newest events first: the top ``limit`` overall, or of every scope.

    Filter first (``level_filter``, ``contains_filters``, ``time_window``).
    """
    if not scope:
        ordered = events.orderBy(*newest_first())
        return ordered if limit is None else ordered.limit(limit)
    if limit is None:
        # All rows of a scope may not fit one task: number range partitions instead.
        at = numbered(events, [*[F.asc(c) for c in scope], *newest_first()], "__number")
        first = at.groupBy(*scope).agg(F.min("__number").alias("__first"))
        found = null_safe_join(at, first, scope)
        row_no = (F.col("__number") - F.col("__first") + 1).cast("int")
        return found.withColumn("row_no", row_no).drop("__number", "__first")
    order = Window.partitionBy(*scope).orderBy(*newest_first())
    return events.withColumn("row_no", F.row_number().over(order)).where(F.col("row_no") <= limit)


def coverage(events: DataFrame, scope: Sequence[str], limit: int) -> DataFrame:
    """Matched against returned events when each scope yields its newest ``limit``.

    ``truncated`` when something was left out; ``covered_from`` is then the earliest
    returned time, before which nothing was looked at.
    """
    matched = events.groupBy(*scope).agg(F.count(F.lit(1)).alias("matched"))
    kept = search_events(events, limit, scope).groupBy(*scope).agg(
        F.count(F.lit(1)).alias("returned"), F.min("ts").alias("earliest")
    )
    cut = (F.col("matched") > F.col("returned")) & (F.col("returned") > 0)
    return (
        null_safe_join(matched, kept, scope)
        .withColumn("truncated", cut)
        .withColumn("covered_from", F.when(F.col("truncated"), F.col("earliest")))
        .drop("earliest")
    )


def slice_counts(total: Column, limit: int, cfg: Config = DEFAULTS) -> Column:
    """How many slices a window with ``total`` matching events is cut into."""
    wanted = F.ceil(total / F.lit(limit))
    return F.greatest(F.lit(1), F.least(F.lit(cfg.max_slices), wanted)).cast("bigint")


def slice_capped(
    events: DataFrame, scope: Sequence[str], cfg: Config = DEFAULTS, limit: int | None = None
) -> DataFrame:
    """The newest ``limit`` events of every equal time slice of a dense window.

    ``scope`` has to include ``window_start`` and ``window_end``.  Adds ``slices``,
    ``slice_no`` and ``row_no``.
    """
    limit = cfg.query_limit if limit is None else limit
    totals = events.groupBy(*scope).agg(F.count(F.lit(1)).alias("scope_total"))
    sliced = null_safe_join(events, totals, scope).withColumn(
        "slices", slice_counts(F.col("scope_total"), limit, cfg)
    )
    start = F.unix_micros("window_start")
    span = F.unix_micros("window_end") - start
    at = F.floor((F.unix_micros("ts") - start) * F.col("slices") / span)
    sliced = sliced.withColumn("slice_no", F.least(at, F.col("slices") - 1)).drop("scope_total")
    return search_events(sliced, limit, [*scope, "slices", "slice_no"])


def slice_coverage(
    events: DataFrame, scope: Sequence[str], cfg: Config = DEFAULTS, limit: int | None = None
) -> DataFrame:
    """Slices, kept events, and whether any slice of the scope was cut short."""
    limit = cfg.query_limit if limit is None else limit
    matched = events.groupBy(*scope).agg(F.count(F.lit(1)).alias("matched"))
    kept = slice_capped(events, scope, cfg, limit).groupBy(*scope, "slices").agg(
        F.count(F.lit(1)).alias("returned"), F.min("ts").alias("earliest")
    )
    return (
        null_safe_join(matched, kept, scope)
        .withColumn("truncated", F.col("matched") > F.col("returned"))
        .withColumn("covered_from", F.when(F.col("truncated"), F.col("earliest")))
        .drop("earliest")
    )


# Time cells of a slice in which the place of its oldest kept event is found.
CELLS = 4096


def newest_of_slices(
    events: DataFrame, scope: Sequence[str], cfg: Config = DEFAULTS, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The newest ``limit`` events of every slice of a window, without ranking them all.

    A histogram of time cells tells in which cell a slice reaches the limit: events behind
    that cell stay as they are, and only those inside it are ranked for the places left.
    Also returns one row per window: ``matched``, ``returned``, ``slices``, ``truncated``
    and, where it is, ``covered_from``, the time of the oldest event kept.
    """
    limit = cfg.query_limit if limit is None else limit
    start = F.unix_micros("window_start")
    span = F.unix_micros("window_end") - start
    totals = events.groupBy(*scope).agg(F.count(F.lit(1)).alias("matched"))
    totals = stage(totals.withColumn("slices", slice_counts(F.col("matched"), limit, cfg)), "window-totals")
    at = F.least(F.floor((F.unix_micros("ts") - start) * F.col("slices") / span), F.col("slices") - 1)
    width = F.greatest(F.lit(1), F.ceil(span / (F.col("slices") * CELLS)))
    slice_start = start + F.ceil(span * F.col("slice_no") / F.col("slices"))
    sliced = (
        null_safe_join(events, totals.drop("matched"), scope)
        .withColumn("slice_no", at)
        .withColumn("cell", F.floor((F.unix_micros("ts") - slice_start) / width))
    )
    key = [*scope, "slice_no"]
    newer_first = Window.partitionBy(*key).orderBy(F.desc("cell"))
    newer = F.coalesce(F.sum("n").over(newer_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = (
        sliced.groupBy(*key, "cell").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("newer", newer)
        .groupBy(*key)
        .agg(
            F.min(F.when(F.col("newer") < limit, F.struct("cell", (F.lit(limit) - F.col("newer")).alias("room")))).alias("cut"),
            F.sum("n").alias("held"),
        )
    )
    cuts = stage(cuts.select(*key, "cut.*", "held").withColumnRenamed("cell", "cut_cell"), "slice-cuts")
    placed = null_safe_join(sliced, cuts, key)
    behind = placed.where(F.col("cell") > F.col("cut_cell"))
    order = Window.partitionBy(*key).orderBy(*newest_first())
    inside = (
        placed.where(F.col("cell") == F.col("cut_cell"))
        .withColumn("row_no", F.row_number().over(order))
        .where((F.col("row_no") <= limit) & (F.col("row_no") <= F.col("room")))
        .drop("row_no")
    )
    extra = ["slices", "slice_no", "cell", "cut_cell", "room", "held"]
    kept = stage(behind.unionByName(inside).drop(*extra), "newest-events")
    cut = cuts.groupBy(*scope).agg(
        F.sum(F.least("held", F.lit(limit))).alias("returned"), F.max(F.col("held") > limit).alias("truncated")
    )
    facts = null_safe_join(null_safe_join(totals, cut, scope), kept.groupBy(*scope).agg(F.min("ts").alias("earliest")), scope)
    return kept, facts.withColumn("covered_from", F.when(F.col("truncated"), F.col("earliest"))).drop("earliest")


# --- timelines ----------------------------------------------------------------


def pick_bin_minutes(window_minutes: Column) -> Column:
    """The smallest standard bin that keeps a window at 24 bins or fewer."""
    choice = F.lit(P.TIMELINE_WIDEST_BIN)
    for minutes in reversed(P.TIMELINE_BIN_MINUTES):
        fits = window_minutes / F.lit(minutes) <= P.TIMELINE_MAX_BINS
        choice = F.when(fits, F.lit(minutes)).otherwise(choice)
    return choice


def window_minutes() -> Column:
    span = F.unix_micros("window_end") - F.unix_micros("window_start")
    return F.greatest(F.lit(1), F.floor(span / 60_000_000))


def volume_timeline(
    events: DataFrame, scope: Sequence[str], bin_minutes: int | None = None
) -> DataFrame:
    """Events per time bin and scope, over every matching row; empty bins are absent.

    Without ``bin_minutes`` the bin follows from the row's ``window_start`` and
    ``window_end``, so windows of different length share one aggregate.
    """
    minutes = pick_bin_minutes(window_minutes()) if bin_minutes is None else F.lit(bin_minutes)
    us = F.unix_micros("ts")
    start = F.timestamp_micros(us - F.pmod(us, minutes.cast("bigint") * 60_000_000))
    return events.groupBy(*scope, start.alias("bin_start")).agg(
        F.count(F.lit(1)).alias("event_count")
    )


# --- request traces -----------------------------------------------------------


def _mark_requests(events: DataFrame, request_ids: DataFrame | Sequence[str]) -> DataFrame:
    """Events with each given id their message holds as a substring.

    A short list is folded into the projection.  For a table of ids, a Bloom filter of
    their rarest runs of characters is tested on every message in the projection; only
    runs that pass become rows, and an equal join finds their ids.  The ids are broadcast
    if their measured size allows it.
    """
    message = F.col("message")
    if not isinstance(request_ids, DataFrame):
        request_ids = [i for i in request_ids if i]
        if not request_ids:
            return events.withColumn("wanted_id", F.lit(None).cast("string")).where(F.lit(False))
        found = F.array_compact(
            F.array(*[F.when(message.contains(i), F.lit(i)) for i in dict.fromkeys(request_ids)])
        )
        any_hit = reduce(lambda a, b: a | b, [message.contains(i) for i in request_ids])
        return events.where(any_hit).withColumn("wanted_id", F.explode(found))
    ids = request_ids.select(F.col("request_id").alias("wanted_id")).where(
        F.length("wanted_id") > 0
    ).distinct()
    ids = stage(ids, "ids")
    probes = stage(probes_of(ids, gram_for(ids.count())), "id-probes")
    size = F.char_length("probe")
    facts = probes.agg(
        F.collect_set(size).alias("sizes"), F.count(F.lit(1)).alias("n"),
        F.sum(F.length("wanted_id") + size).alias("chars"),
        F.min("wanted_id").alias("lowest"), F.max("wanted_id").alias("highest"),
    ).first()
    if not facts["n"]:
        return events.withColumn("wanted_id", F.lit(None).cast("string")).where(F.lit(False))
    # What the lowest and the highest id start with, all do.
    prefix = commonprefix([facts["lowest"], facts["highest"]])
    if prefix:
        events = events.where(message.contains(prefix))
    bits = filter_bits(facts["n"])
    words = stage(bloom_filter(probes, bits), "id-filter").scalar()
    sizes = sorted(facts["sizes"])
    # The filter is read once, by the lambda, so it is folded into the projection and not
    # copied into every row; the outer explode keeps the tests out of a second filter.
    hits = F.flatten(F.transform(F.array("__words"), lambda w: probe_hits(message, w, bits, sizes)))
    pieces = (
        events.withColumn("__words", words)
        .withColumn("__hits", hits)
        .drop("__words")
        .withColumn("probe", F.explode_outer("__hits"))
        .drop("__hits")
        .where(F.col("probe").isNotNull())
    )
    probes = probes.select("wanted_id", F.xxhash64("probe").alias("probe"))
    if facts["chars"] <= BROADCAST_ID_CHARS and facts["n"] <= BROADCAST_IDS:
        probes = F.broadcast(probes)
    # An id has one probe, so each pair of event and id is met once.
    return pieces.join(probes, "probe").where(message.contains(F.col("wanted_id"))).drop("probe")


def _trace_matches(events, request_ids, scope, cfg) -> DataFrame:
    base = [c for c in dict.fromkeys([*scope, "ts", "log_stream", "message"]) if c in events.columns]
    hits = _mark_requests(events.select(*base), request_ids)
    if "request_id" in scope:
        raise ValueError("request_id is added by the trace and cannot be a scope column")
    return hits.withColumnRenamed("wanted_id", "traced_id")


def trace_requests(
    events: DataFrame,
    request_ids: DataFrame | Sequence[str],
    scope: Sequence[str] = ("log_group",),
    cfg: Config = DEFAULTS,
) -> DataFrame:
    """The first events of every request in time order, redacted and shortened.

    The level is the one a JSON message states itself, else empty.
    """
    hits = _trace_matches(events, request_ids, scope, cfg)
    order = Window.partitionBy(*scope, "traced_id").orderBy(*oldest_first())
    shown = hits.withColumn("seq", F.row_number().over(order)).where(
        F.col("seq") <= cfg.trace_events
    )
    told = redact(extract_fields(shown), ("message",), cfg)
    return told.select(
        *scope,
        F.col("traced_id").alias("request_id"),
        "seq",
        "ts",
        F.coalesce("level", F.lit("")).alias("level"),
        F.substring("message", 1, cfg.example_chars).alias("message"),
    )


def trace_totals(
    events: DataFrame,
    request_ids: DataFrame | Sequence[str],
    scope: Sequence[str] = ("log_group",),
    cfg: Config = DEFAULTS,
) -> DataFrame:
    """Events per request and whether the trace shows only part of them."""
    hits = _trace_matches(events, request_ids, scope, cfg)
    return hits.groupBy(*scope, F.col("traced_id").alias("request_id")).agg(
        F.count(F.lit(1)).alias("total_events")
    ).withColumn("truncated", F.col("total_events") > cfg.trace_events)
