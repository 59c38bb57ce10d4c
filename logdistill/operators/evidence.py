"""The evidence document of a scope: clusters, examples and timeline within a size budget.

Documents are compact JSON.  A document never holds more than the budget, so the
parts that could grow without bound (endpoints of a cluster, bins of a timeline) are
only gathered as far as the budget reaches: once one of them alone is longer, the
document is too long whatever else it holds, and the text behind that point would be
cut off anyway.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logdistill.config import DEFAULTS, Config
from logdistill.functions.text import WS
from logdistill.operators.common import CLUSTER_KEY, null_safe_join

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"


# A name of one character and the four around it.
LEAST_ENTRY = 5


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO)


def _bounded(df: DataFrame, group: Sequence[str], order: list[Column], size: Column, limit: int):
    """Leading rows of each group until their sizes pass the limit.

    Every size is at least ``LEAST_ENTRY``, so rows beyond a rank cannot be reached; the
    rank filter is applied per task before the shuffle, and the running sum sees few rows.
    """
    ranked = Window.partitionBy(*group).orderBy(*order)
    most = limit // LEAST_ENTRY + 1
    few = df.withColumn("__nth", F.row_number().over(ranked)).where(F.col("__nth") <= most)
    w = ranked.rowsBetween(Window.unboundedPreceding, -1)
    return few.drop("__nth").withColumn("__before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(
        F.col("__before") <= limit
    ).drop("__before")


def _histogram(df: DataFrame, group: list[str], name: str, limit: int, into: str) -> DataFrame:
    """A map from name to count in order of first appearance."""
    entry = F.struct("first_seen", name, "event_count")
    kept = _bounded(df, group, [F.col("first_seen"), F.col(name)], F.length(name) + 4, limit)
    pairs = F.transform(
        F.array_sort(F.collect_list(entry)), lambda e: F.struct(e[name], e["event_count"])
    )
    return kept.groupBy(*group).agg(F.map_from_entries(pairs).alias(into))


def build_evidence(
    ranked: DataFrame,
    endpoints: DataFrame,
    statuses: DataFrame,
    samples: DataFrame,
    stats: DataFrame,
    scope: Sequence[str],
    timeline: DataFrame | None = None,
    service: str | None = None,
    cfg: Config = DEFAULTS,
) -> DataFrame:
    """One document per scope, shrunk to ``cfg.evidence_chars``.

    While it is too long: drop the lowest cluster (never the first), then the last
    example of every cluster, then cut the text.
    """
    key, budget = [*scope, *CLUSTER_KEY], cfg.evidence_chars
    best = ranked.where(F.col("rank") <= cfg.evidence_clusters)
    chosen = best.select(*key)
    ends = null_safe_join(endpoints, chosen, key, "left_semi")
    codes = null_safe_join(statuses, chosen, key, "left_semi")
    examples = (
        null_safe_join(samples, chosen, key, "left_semi")
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("example_no", "message"))).alias("__ex"))
    )
    full = best
    for part in (
        _histogram(ends, key, "endpoint", budget, "affected_endpoints"),
        _histogram(codes, key, "status", budget, "status_codes"),
        examples,
    ):
        full = null_safe_join(full, part, key, "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    payload = F.struct(
        F.col("cluster_id"),
        F.col("exception_type"),
        F.substring("template", 1, 300).alias("normalized_message"),
        F.col("event_count").alias("count"),
        iso(F.col("first_seen")).alias("first_seen"),
        iso(F.col("last_seen")).alias("last_seen"),
        F.coalesce("affected_endpoints", none).alias("affected_endpoints"),
        F.coalesce("status_codes", none).alias("status_codes"),
        F.coalesce(
            F.transform("__ex", lambda e: e["message"]), F.array().cast("array<string>")
        ).alias("examples"),
    )
    grouped = full.groupBy(*scope).agg(
        F.transform(
            F.array_sort(
                F.collect_list(F.struct(F.col("rank"), payload.alias("payload"))),
                lambda a, b: (a["rank"] - b["rank"]).cast("int"),
            ),
            lambda c: c["payload"],
        ).alias("__clusters")
    )
    doc = null_safe_join(grouped, stats.select(*scope, "events", "clusters", "covered_from"), scope)
    if timeline is not None:
        point = F.struct(iso(F.col("bin_start")).alias("time"), F.col("event_count").alias("count"))
        bins = _bounded(timeline, scope, [F.col("bin_start")], F.lit(50), budget)
        bins = bins.groupBy(*scope).agg(F.array_sort(F.collect_list(point)).alias("__timeline"))
        doc = null_safe_join(doc, bins, scope, "left")
    else:
        doc = doc.withColumn("__timeline", F.lit(None).cast("array<struct<time:string,count:bigint>>"))
    cols = doc.columns

    def opt(name: str) -> Column:
        return F.col(name) if name in cols else F.lit(None).cast("string")

    note = F.when(
        F.col("covered_from").isNotNull(),
        F.concat(
            F.lit("retrieval stopped at its limit: examples start at "),
            iso(F.col("covered_from")),
            F.lit("; counts per time bin are complete"),
        ),
    )

    def text(clusters: Column, shrunk: Column) -> Column:
        return F.to_json(
            F.struct(
                F.lit(service).cast("string").alias("service"),
                opt("log_group").alias("log_group"),
                F.struct(
                    (iso(F.col("window_start")) if "window_start" in cols
                     else F.lit(None).cast("string")).alias("start"),
                    (iso(F.col("window_end")) if "window_end" in cols
                     else F.lit(None).cast("string")).alias("end"),
                ).alias("window"),
                F.col("events").alias("total_error_events"),
                F.col("clusters").alias("distinct_failure_clusters"),
                clusters.alias("clusters"),
                F.col("__timeline").alias("full_window_volume_timeline"),
                note.alias("note"),
                F.when(shrunk, F.lit(True)).alias("truncated_for_budget"),
            )
        )

    steps = F.concat(
        F.transform(
            F.reverse(F.sequence(F.lit(1), F.size("__clusters"))),
            lambda n: F.struct(n.alias("clusters"), F.lit(0).alias("dropped")),
        ),
        F.transform(
            F.sequence(F.lit(1), F.lit(cfg.max_examples)),
            lambda d: F.struct(F.lit(1).alias("clusters"), d.alias("dropped")),
        ),
    )

    def trimmed(step: Column) -> Column:
        kept = F.slice(F.col("__clusters"), 1, step["clusters"])
        return F.transform(
            kept,
            lambda c: c.withField(
                "examples",
                F.slice(c["examples"], F.lit(1), F.greatest(F.size(c["examples"]) - step["dropped"], F.lit(0))),
            ),
        )

    whole = F.size("__clusters")
    tries = F.transform(
        steps,
        lambda s: F.struct(
            s["clusters"].alias("clusters"),
            text(trimmed(s), (s["clusters"] < whole) | (s["dropped"] > 0)).alias("text"),
        ),
    )
    # Built step by step: the first text that fits ends the shrinking, the last is cut.
    first = F.aggregate(
        tries,
        F.struct(F.lit(0).alias("clusters"), F.lit(None).cast("string").alias("text")),
        lambda acc, t: F.when(
            acc["text"].isNotNull() & (F.length(acc["text"]) <= budget), acc
        ).otherwise(t),
    )
    done = doc.withColumn("__first", first)
    sent = F.aggregate(
        F.slice("__sizes", 1, F.greatest(F.col("clusters_sent"), F.lit(1))),
        F.lit(0), lambda a, n: a + n,
    )
    return done.select(
        *scope,
        F.substring(F.col("__first.text"), 1, budget).alias("evidence"),
        F.col("__first.clusters").alias("clusters_sent"),
        F.transform("__clusters", lambda c: F.size(c["examples"])).alias("__sizes"),
    ).withColumn("events_sent", sent).drop("__sizes")


def build_comparison_evidence(
    profiles: DataFrame,
    deltas: DataFrame,
    endpoints: DataFrame,
    statuses: DataFrame,
    new_endpoints: DataFrame,
    scope: Sequence[str],
    cfg: Config = DEFAULTS,
) -> DataFrame:
    """Both windows' profiles and their deltas as one JSON document per scope, cut to size.

    ``profiles`` has up to ten clusters for each ``side``, each shown with its endpoints and
    status codes; deltas are shown with the endpoints that only the comparison window hits.
    Deltas, endpoints and codes are gathered in order only as far as the budget reaches.
    """
    sided, budget = [*scope, "side", *CLUSTER_KEY], cfg.evidence_chars
    shown = profiles.where(F.col("rank").isNotNull()).select(*scope, "side", *CLUSTER_KEY)
    for table, name, into in ((endpoints, "endpoint", "affected_endpoints"), (statuses, "status", "status_codes")):
        mine = null_safe_join(table, shown, sided, "left_semi")
        profiles = null_safe_join(profiles, _histogram(mine, sided, name, budget, into), sided, "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    item = F.struct(
        "rank", "cluster_id", "exception_type", "template", "event_count",
        iso(F.col("first_seen")).alias("first_seen"), iso(F.col("last_seen")).alias("last_seen"),
        "score", *[F.coalesce(c, none).alias(c) for c in ("affected_endpoints", "status_codes")],
    )

    def side(name: str) -> Column:
        here = F.col("side") == name
        return F.struct(
            F.max(F.when(here, F.col("total_events"))).alias("total_events"),
            F.array_sort(
                F.collect_list(F.when(here & F.col("rank").isNotNull(), item)),
                lambda a, b: (a["rank"] - b["rank"]).cast("int"),
            ).alias("clusters"),
        ).alias(name)

    windows = profiles.groupBy(*scope).agg(side("baseline"), side("comparison"))
    place = F.coalesce("comparison_rank", "baseline_rank")
    group = F.when(F.col("change") == "new", 0).when(F.col("change") == "disappeared", 1).otherwise(2)
    key = [*scope, *CLUSTER_KEY]
    fresh = _bounded(new_endpoints, key, [F.col("endpoint")], F.length("endpoint") + 3, budget)
    fresh = fresh.groupBy(*key).agg(F.array_sort(F.collect_list("endpoint")).alias("new_endpoints"))
    ordered = null_safe_join(deltas, fresh, key, "left").withColumns(
        {
            "__group": group, "__place": place, "template": F.substring("template", 1, 200),
            "new_endpoints": F.coalesce("new_endpoints", F.array().cast("array<string>")),
        }
    )
    bounded = _bounded(
        ordered, scope, [F.col("__group"), F.col("__place"), F.col("cluster_id")],
        F.length("template") + 40, cfg.evidence_chars,
    )
    entry = F.struct(
        "__group", "__place", "cluster_id", "exception_type", "template", "baseline_count",
        "comparison_count", "change", "ratio", "new_endpoints",
    )
    listed = bounded.groupBy(*scope).agg(F.array_sort(F.collect_list(entry)).alias("__deltas"))

    def part(no: int, name: str) -> Column:
        mine = F.filter("__deltas", lambda d: d["__group"] == no)
        return F.transform(mine, lambda d: d.dropFields("__group", "__place")).alias(name)

    text = F.to_json(
        F.struct(
            "baseline",
            "comparison",
            F.struct(
                part(0, "new_clusters"), part(1, "disappeared_clusters"), part(2, "changed_clusters")
            ).alias("deltas"),
        )
    )
    return null_safe_join(windows, listed, scope, "left").select(
        *scope, F.substring(text, 1, cfg.evidence_chars).alias("evidence")
    )


def known_terms(
    ranked: DataFrame,
    endpoints: DataFrame,
    samples: DataFrame,
    scope: Sequence[str],
    extra: Sequence[str] = (),
) -> DataFrame:
    """Lower-cased vocabulary of each scope's evidence, one distinct term per row.

    Exception types and endpoints whole, words of more than three characters from
    templates and samples, and the ``extra`` columns (service, log group) whole.
    """
    key = [*scope, *CLUSTER_KEY]

    def words(df: DataFrame, text: str) -> DataFrame:
        split = F.split(F.col(text), WS + "+")
        return df.select(*scope, F.explode(split).alias("term")).where(F.length("term") > 3)

    mine = null_safe_join(endpoints, ranked.select(*key), key, "left_semi")
    parts = [
        ranked.where(F.col("exception_type") != "").select(*scope, F.col("exception_type").alias("term")),
        mine.select(*scope, F.col("endpoint").alias("term")),
        words(ranked, "template"),
        words(samples, "message"),
    ]
    for name in extra:
        parts.append(ranked.where(F.col(name) != "").select(*scope, F.col(name).alias("term")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*scope, F.lower("term").alias("term")).distinct()
