"""Mix sources to target weights.

Words are summed per source, targets found by sharing a total over weights with a
ceiling per source, and each document is emitted floor(rate) times plus one copy drawn
with the fraction as probability.  The draw is a hash of the document id and a seed, so
reruns and recomputed tasks agree.

Cases: a null text has size 0; null is a source of its own, ordered last; documents with
a null id draw by their text; repeated rows draw alike; an empty table gives no rows;
sources of size 0 have target 0 and emit each document once, as nothing is at stake.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logdistill.llm.common import BLANK, numbered, small_side, stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2.0
SEED = "mix-1"
TOKEN = BLANK.replace("[", "[^", 1) + "+"


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the document and the seed only."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
    ceiling: float = CEILING,
) -> DataFrame:
    """``sizes``: one row per source with ``source``, ``source_size``.  Adds ``target``.

    Sources take the weights in turn, by code point order, null last.  The excess above a
    ceiling is shared again by weight until none is above; each round reads one row.
    """
    ranked = numbered(
        sizes.withColumn("__null", F.col("source").isNull()), ["__null", "source"], "__i", "sources"
    ).drop("__null")
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    w = F.get(kinds, F.pmod("__i", F.lit(len(weights))).cast("int"))
    ranked = stage(ranked.withColumn("__w", w), "ranked-sources")
    top = F.col("source_size") * ceiling
    total = (ranked.agg(F.sum("source_size").alias("t")).first()["t"] or 0) * share
    level, full = 0.0, -1
    while True:
        # Sources whose ceiling lies at or below the current level keep the ceiling.
        at_top = top <= F.col("__w") * level
        got = ranked.agg(
            F.coalesce(F.sum(F.when(at_top, top)), F.lit(0.0)).alias("taken"),
            F.coalesce(F.sum(F.when(~at_top, F.col("__w"))), F.lit(0.0)).alias("open"),
            F.count(F.when(at_top, 1)).alias("full"),
        ).first()
        if got["full"] == full or got["open"] == 0:
            break
        full, level = got["full"], (total - got["taken"]) / got["open"]
    target = F.least(top.cast("double"), F.col("__w") * level)
    return ranked.select("source", "source_size", target.alias("target"))


def mix_plan(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
    ceiling: float = CEILING, seed: str = SEED,
) -> DataFrame:
    """Documents with ``size``, ``source_size``, ``target`` and ``copies`` to emit."""
    own = ("source_size", "target", "copies", "copy")
    sized = docs.drop(*own).withColumn("size", size_of(F.col("text")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stage(source_targets(sizes, weights, share, ceiling), "targets")
    right = small_side(targets.withColumnRenamed("source", "__source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    extra = draw(F.col("doc_id"), F.col("text"), seed) < rate - F.floor(rate)
    return (
        sized.join(right, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("copies", F.floor(rate) + extra.cast("long"))
        .drop("__source")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every document ``copies`` times, ``copy`` numbered from 1."""
    plan = mix_plan(docs, **options).where(F.col("copies") > 0)
    return plan.withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    ).drop("size", "source_size", "target", "copies")


def mixed_sizes(docs: DataFrame) -> DataFrame:
    return mix_plan(docs.select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS top,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
      WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM s),
-- The level at which weights are shared lies between the ceilings of two sources.
o AS (
  SELECT *, sum(top) OVER (ORDER BY top / weight, source ROWS UNBOUNDED PRECEDING) - top AS below,
    sum(weight) OVER () - (sum(weight) OVER (ORDER BY top / weight, source ROWS UNBOUNDED PRECEDING) - weight) AS open
  FROM w),
lv AS (
  SELECT arg_min(((SELECT 1.5::DOUBLE * sum(source_size) FROM s) - below) / open, top / weight) AS level FROM o
  WHERE ((SELECT 1.5::DOUBLE * sum(source_size) FROM s) - below) / open < top / weight),
t AS (SELECT source, source_size, least(top, weight * (SELECT level FROM lv))::DOUBLE AS target FROM w),
r AS (
  SELECT d.doc_id, d.text, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1.0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) +
    CASE WHEN ('0x' || md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), text, ''))[1:8])::BIGINT / 4294967296.0
      < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
