"""Operational tables: telemetry rollups and scored analyses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logdistill.functions import patterns as P
from logdistill.operators.common import null_safe_join

CELLS = 4096


def exact_median(df: DataFrame, by: Sequence[str], value: Column, name: str) -> DataFrame:
    """The exact median of a value per group, without holding a group in memory.

    Counts over 4,096 cells of each group's value range find the cells with the middle
    ranks; only the distinct values of those cells are put in order.
    """
    rows = df.select(*by, value.cast("double").alias("__v")).where(F.col("__v").isNotNull())
    group = list(by)
    span = rows.groupBy(*group).agg(
        F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.count(F.lit(1)).alias("__n")
    )
    share = (F.col("__v") - F.col("__min")) / F.nullif(F.col("__max") - F.col("__min"), F.lit(0.0))
    placed = null_safe_join(rows, span, group).withColumn(
        "__cell", F.coalesce(F.floor(share * CELLS), F.lit(0))
    )
    low, high = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)

    def covering(counts: DataFrame, key: list[str], order: str) -> DataFrame:
        w = Window.partitionBy(*key).orderBy(order)
        upto = F.sum("__rows").over(w.rowsBetween(Window.unboundedPreceding, 0))
        first = F.col("__upto") - F.col("__rows") + F.col("__skip")
        last = F.col("__upto") + F.col("__skip")
        return counts.withColumn("__upto", upto).where(
            ((low >= first) & (low < last)) | ((high >= first) & (high < last))
        ).withColumn("__skip", first)

    cells = placed.groupBy(*group, "__n", "__cell").agg(F.count(F.lit(1)).alias("__rows"))
    hit = covering(cells.withColumn("__skip", F.lit(0)), group, "__cell")
    inside = null_safe_join(placed, hit.select(*group, "__cell", "__skip"), [*group, "__cell"])
    values = inside.groupBy(*group, "__n", "__cell", "__skip", "__v").agg(
        F.count(F.lit(1)).alias("__rows")
    )
    middle = covering(values, [*group, "__cell"], "__v")
    return middle.groupBy(*group).agg(((F.min("__v") + F.max("__v")) / 2).alias(name))


# Values that the last step of a selection may bring to the driver.
FEW = 4096


def overall_median(df: DataFrame, value: Column) -> float | None:
    """The exact median over all rows, by repeated histograms of a shrinking range.

    A pass counts the rows of 4,096 cells of the range and goes on with the cell of the
    wanted rank, until few rows or one value are left.  Each pass is a filter and a count
    that tasks fold to one row per cell; no row is shuffled or joined.
    """
    # NaN and infinite values have no place in a range.
    rows = df.select(value.cast("double").alias("v")).where(F.abs("v") < float("inf"))
    whole = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")).first()
    if not whole["n"]:
        return None

    def nth(rank: int) -> float:
        low, high, n = whole["low"], whole["high"], whole["n"]
        while low < high:
            inside = rows.where(F.col("v").between(low, high))
            if n <= FEW:
                return sorted(r["v"] for r in inside.collect())[rank]
            share = (F.col("v") - F.lit(low)) / F.lit(high - low)
            cells = inside.groupBy(F.floor(share * CELLS).alias("cell")).agg(
                F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
            )
            for cell in sorted(cells.collect()):
                if rank < cell["n"]:
                    low, high, n = cell["low"], cell["high"], cell["n"]
                    break
                rank -= cell["n"]
        return low

    middle = {(whole["n"] - 1) // 2, whole["n"] // 2}
    return sum(map(nth, middle)) / len(middle)


def telemetry_rollup(ops: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Operation and analysis counts, cache-hit rate, model latency and compression.

    ``ops`` has operation, duration_seconds, compression_ratio and cache_hit.
    """
    analysis = F.col("operation").isin(*P.ANALYSIS_OPERATIONS)
    model = F.col("operation") == P.MODEL_OPERATION
    hits = F.count_if(analysis & F.col("cache_hit"))
    analyses = F.count_if(analysis)
    rollup = ops.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("operations"),
        analyses.alias("analyses"),
        F.when(analyses > 0, hits / analyses).alias("cache_hit_rate"),
        F.avg(F.when(analysis, F.col("compression_ratio"))).alias("mean_compression_ratio"),
    )
    seconds = F.coalesce("duration_seconds", F.lit(0.0))
    if not scope:
        overall = F.lit(overall_median(ops.where(model), seconds)).cast("double")
        return rollup.withColumn("median_model_seconds", overall)
    median = exact_median(ops.where(model), scope, seconds, "median_model_seconds")
    return null_safe_join(rollup, median, scope, "left")


def recent_ops(ops: DataFrame, n: int = 50) -> DataFrame:
    """The latest telemetry rows."""
    rest = [c for c in ops.columns if c not in ("recorded_at", "operation")]
    return ops.orderBy(F.desc("recorded_at"), "operation", *rest).limit(n)


def score_analyses(analyses: DataFrame, expected: DataFrame) -> DataFrame:
    """Score analyses against known facts of their case, 0 to 1.

    ``expected`` has case_id, primary_exception, category_keywords, affected_endpoint
    and severities; both tables share ``case_id``.
    """
    causes = F.transform("root_causes", lambda c: c["cause"])
    text = F.lower(F.concat_ws(" ", F.array("summary"), causes, F.col("affected_components")))
    places = F.concat_ws(" ", F.col("affected_components"), F.array("summary"))
    found = analyses.join(expected, "case_id").withColumns({"__text": text, "__places": places})

    def points(hit, value: float):
        return F.when(hit, F.lit(value)).otherwise(F.lit(0.0))

    hits = {
        "exception_found": F.col("__text").contains(F.lower("primary_exception")),
        "category_found": F.exists("category_keywords", lambda k: F.col("__text").contains(k)),
        "endpoint_found": F.col("__places").contains(F.col("affected_endpoint")),
        "severity_found": F.array_contains("severities", F.col("severity")),
    }
    score = (
        points(F.col("exception_found"), 0.4)
        + points(F.col("category_found"), 0.3)
        + points(F.col("endpoint_found"), 0.2)
        + points(F.col("severity_found"), 0.1)
    )
    return found.withColumns(hits).withColumn("score", score).drop(
        "__text", "__places", *[c for c in expected.columns if c != "case_id"]
    )


def eval_summary(scored: DataFrame, by: str = "model") -> DataFrame:
    """Success rate, latency spread and mean score per model.

    ``scored`` has succeeded, latency_seconds and score; failed runs have no latency.
    """
    summary = scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("succeeded").alias("successes"),
        F.avg(F.col("succeeded").cast("double")).alias("success_rate"),
        F.min("latency_seconds").alias("min_latency"),
        F.max("latency_seconds").alias("max_latency"),
        F.avg("score").alias("mean_score"),
    )
    median = exact_median(scored, [by], F.col("latency_seconds"), "median_latency")
    return null_safe_join(summary, median, [by], "left")
