"""Representative events: first, evenly spaced and latest of every cluster, exactly.

A full sort of each cluster would put a dominant one into a single task.  Instead
the wanted ranks are narrowed down on histograms: counts over 4,096 time cells of
the cluster's life and, where a hit cell turns out to be large, over 4,096 cells
inside it, then (for pile-ups on one instant) over cells of a hash.  Only rows of the
finally hit cells are ordered.  The order is (time, hash of stream and message, stream, message).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logdistill.functions.text import not_blank
from logdistill.operators.clusters import cluster_template
from logdistill.operators.common import CLUSTER_KEY, null_safe_join, stage

CELLS = 4096


def positions(n: Column, k: int) -> Column:
    """Zero-based ranks to keep of ``n`` ordered events, at most ``k``."""
    if k == 1:
        return F.array(n - 1)
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.bround(i * (n - 1) / F.lit(k - 1), 0).cast("bigint"),
    )
    every = F.sequence(F.lit(0).cast("bigint"), n - 1)
    return F.array_distinct(F.when(n <= k, every).otherwise(spread))


def _hit_cells(rows: DataFrame, groups: DataFrame, key: list[str], cell: Column) -> DataFrame:
    """Cells of each group that hold a wanted rank.

    ``groups`` has the ranks wanted per group, relative to its first row; the result
    has those wanted per cell, relative to the cell's first row.
    """
    counts = rows.groupBy(*key, cell.alias("__cell")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*key).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    low, high = F.col("__before"), F.col("__before") + F.col("__n")
    inside = F.filter("__wanted", lambda r: (r >= low) & (r < high))
    return (
        null_safe_join(counts, groups.select(*key, "__wanted"), key)
        .withColumn("__wanted", inside)
        .where(F.size("__wanted") > 0)
        .select(*key, "__cell", "__n", F.transform("__wanted", lambda r: r - low).alias("__wanted"))
    )


def _in_cells(rows: DataFrame, hits: DataFrame, key: list[str], cell: Column) -> DataFrame:
    cells = [*key, "__cell"]
    return null_safe_join(rows.withColumn("__cell", cell), hits.select(*cells), cells, "left_semi")


def sample_events(
    enriched: DataFrame,
    clusters: DataFrame,
    scope: Sequence[str],
    max_examples: int = 3,
    max_chars: int | None = 800,
) -> DataFrame:
    """At most ``max_examples`` events of each given cluster.

    ``clusters`` is the ranked and budgeted table; events of other clusters are not
    touched after the join with it.  Output: scope, cluster key, ``cluster_id``,
    ``example_no`` in time order, ``ts``, ``log_stream``, ``message``.
    """
    key = [*scope, *CLUSTER_KEY]
    kept = clusters.select(
        *key,
        "cluster_id",
        F.unix_micros("first_seen").alias("__lo"),
        (F.unix_micros("last_seen") - F.unix_micros("first_seen")).alias("__span"),
        positions(F.col("event_count"), max_examples).alias("__wanted"),
    )
    stream = F.col("log_stream") if "log_stream" in enriched.columns else F.lit(None).cast("string")
    events = enriched.where(not_blank(F.col("message"))).select(
        *scope, "exception_type", cluster_template().alias("template"), "ts",
        stream.alias("log_stream"), "message",
    )
    rows = null_safe_join(events, kept.drop("__wanted"), key)
    offset = F.unix_micros("ts") - F.col("__lo")
    width = F.floor(F.col("__span") / CELLS) + 1
    coarse = F.floor(offset / width)
    hits = stage(_hit_cells(rows, kept.select(*key, "__wanted"), key, coarse), "sample-cells")
    rows = stage(_in_cells(rows, hits, key, coarse), "sample-candidates")

    cell = [*key, "__coarse"]
    rows, hits = (d.withColumnRenamed("__cell", "__coarse") for d in (rows, hits))
    tie = F.xxhash64(F.coalesce("log_stream", F.lit("")), "message")
    fine = F.floor((offset - F.col("__coarse") * width) / (F.floor(width / CELLS) + 1))
    instant = F.struct("ts", F.shiftright(tie, 52).alias("hash"))
    for name, expr in (("__fine", fine), ("__instant", instant)):
        hits = _hit_cells(rows, hits, cell, expr)
        rows = _in_cells(rows, hits, cell, expr)
        rows, hits = (d.withColumnRenamed("__cell", name) for d in (rows, hits))
        cell = [*cell, name]

    rows = null_safe_join(rows, hits.select(*cell, "__wanted"), cell)
    order = Window.partitionBy(*cell).orderBy("ts", tie, "log_stream", "message")
    picked = rows.withColumn("__rank", F.row_number().over(order) - 1).where(
        F.array_contains("__wanted", F.col("__rank").cast("bigint"))
    )
    example = Window.partitionBy(*key).orderBy("ts", tie, "log_stream", "message")
    message = F.col("message") if max_chars is None else F.substring("message", 1, max_chars)
    return picked.select(
        *key, "cluster_id", F.row_number().over(example).alias("example_no"),
        "ts", "log_stream", message.alias("message"),
    )
