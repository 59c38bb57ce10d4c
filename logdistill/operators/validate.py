"""Checks of written incident analyses against the evidence they were based on.

An ``analyses`` table has ``analysis_id``, the scope columns, ``summary``,
``severity``, ``root_causes`` (array of cause, confidence and evidence, each
evidence with a statement and cluster ids) and ``affected_components``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logdistill.functions.text import WS
from logdistill.operators.common import null_safe_join, stage

GRAM = 4
ROOT_CAUSES = (
    "array<struct<cause:string,confidence:double,"
    "evidence:array<struct<statement:string,cluster_ids:array<string>>>>>"
)


def claimed_ids(analyses: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One row per claimed cluster id with its place in the analysis."""
    causes = analyses.select(
        "analysis_id", *scope, F.posexplode("root_causes").alias("cause_no", "c")
    )
    evidence = causes.select(
        "analysis_id", *scope, "cause_no", F.posexplode("c.evidence").alias("evidence_no", "e")
    )
    return evidence.select(
        "analysis_id", *scope, "cause_no", "evidence_no", F.col("e.statement").alias("statement"),
        F.posexplode("e.cluster_ids").alias("id_no", "cluster_id"),
    )


def _check_ids(analyses: DataFrame, clusters: DataFrame, scope: Sequence[str]) -> DataFrame:
    known = clusters.select(*scope, "cluster_id").distinct().withColumn("known", F.lit(True))
    return null_safe_join(
        claimed_ids(analyses, scope), known, [*scope, "cluster_id"], "left"
    ).withColumn("known", F.coalesce("known", F.lit(False)))


def unknown_ids(analyses: DataFrame, clusters: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Claimed ids that are not in the evidence of their scope."""
    known = clusters.select(*scope, "cluster_id")
    return null_safe_join(
        claimed_ids(analyses, scope), known, [*scope, "cluster_id"], "left_anti"
    )


def validate_refs(analyses: DataFrame, clusters: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Every cause with its valid ids, clamped confidence and whether any id is verifiable.

    One row per (analysis, cause, evidence); a cause without evidence keeps one row.
    ``kept_ids`` are in claimed order, ``dropped_ids`` sorted and distinct.
    """
    causes = analyses.select(
        "analysis_id", *scope, F.posexplode("root_causes").alias("cause_no", "c")
    )
    rows = causes.select(
        "analysis_id", *scope, "cause_no", F.col("c.cause").alias("cause"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c.confidence"))).alias("confidence"),
        F.posexplode_outer("c.evidence").alias("evidence_no", "e"),
    ).select("*", F.col("e.statement").alias("statement")).drop("e")
    place = ["analysis_id", *scope, "cause_no", "evidence_no"]
    checked = _check_ids(analyses, clusters, scope)
    entry = F.struct("id_no", "cluster_id")
    # The ids of one evidence statement come from one row, so these lists stay small.
    lists = checked.groupBy(*place).agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("known"), entry))), lambda x: x["cluster_id"]
        ).alias("kept_ids"),
        F.array_sort(F.collect_set(F.when(~F.col("known"), F.col("cluster_id")))).alias(
            "dropped_ids"
        ),
    )
    none = F.array().cast("array<string>")
    joined = null_safe_join(rows, lists, place, "left").withColumns(
        {"kept_ids": F.coalesce("kept_ids", none), "dropped_ids": F.coalesce("dropped_ids", none)}
    )
    verified = checked.groupBy("analysis_id", *scope, "cause_no").agg(
        F.max("known").alias("verified")
    )
    return null_safe_join(joined, verified, ["analysis_id", *scope, "cause_no"], "left").withColumn(
        "verified", F.coalesce("verified", F.lit(False))
    )


def term_pieces(terms: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Every run of ``GRAM`` characters of every term: ``gram`` and ``term``."""
    starts = F.sequence(F.lit(1), F.length("term") - (GRAM - 1))
    cut = F.transform(starts, lambda i: F.substring(F.col("term"), i, F.lit(GRAM)))
    return terms.where(F.length("term") >= GRAM).select(
        *scope, "term", F.explode_outer(F.array_distinct(cut)).alias("gram")
    )


def word_probes(words: DataFrame, pieces: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Distinct words with their ``gram`` that the fewest terms hold, and ``n_terms`` of it.

    A word with a run that no term holds occurs in none and is left out.
    """
    held = pieces.groupBy(*scope, "gram").agg(F.count(F.lit(1)).alias("n_terms"))
    starts = F.sequence(F.lit(1), F.length("word") - (GRAM - 1))
    cut = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("word"), i, F.lit(GRAM))))
    grams = words.select(*scope, "word").distinct().select(*scope, "word", F.size(cut).alias("n"), F.explode(cut).alias("gram"))
    found = null_safe_join(grams, held, [*scope, "gram"]).groupBy(*scope, "word", "n").agg(
        F.count(F.lit(1)).alias("found"), F.min(F.struct("n_terms", "gram")).alias("rarest")
    )
    return found.where(F.col("found") == F.col("n")).select(*scope, "word", "rarest.*")


def check_components(analyses: DataFrame, terms: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Every claimed component with ``supported``.

    A component counts if it is a known term, or if one of its words of more than three
    characters occurs inside a known term.  The substring test runs on an equal join over
    runs of four characters; each word is looked up by the one of its runs that occurs in
    the fewest terms, so beginnings that all terms share pair nothing.
    """
    parts = analyses.select(
        "analysis_id", *scope, F.posexplode("affected_components").alias("component_no", "component")
    ).withColumn("lowered", F.lower("component"))
    distinct = parts.select(*scope, "lowered").distinct()
    exact = null_safe_join(
        distinct, terms.select(*scope, F.col("term").alias("lowered")), [*scope, "lowered"],
        "left_semi",
    )
    split = F.split(F.replace("lowered", F.lit("/"), F.lit(" /")), WS + "+")
    words = distinct.select(*scope, "lowered", F.explode(split).alias("word")).where(
        F.length("word") >= GRAM
    )
    pieces = stage(term_pieces(terms, scope), "term-pieces")
    inside = null_safe_join(
        word_probes(words, pieces, scope), pieces, [*scope, "gram"], "left_semi",
        F.col("term").contains(F.col("word")),
    )
    by_word = null_safe_join(words, inside.select(*scope, "word"), [*scope, "word"], "left_semi")
    supported = (
        exact.select(*scope, "lowered")
        .unionByName(by_word.select(*scope, "lowered"))
        .distinct()
        .withColumn("supported", F.lit(True))
    )
    return (
        null_safe_join(parts, supported, [*scope, "lowered"], "left")
        .withColumn("supported", F.coalesce("supported", F.lit(False)))
        .drop("lowered")
    )


def validation_warnings(refs: DataFrame, components: DataFrame, scope: Sequence[str]) -> DataFrame:
    """What the validation took out or doubts: ``kind`` and ``detail`` per analysis."""
    place = ["analysis_id", *scope]
    unknown = refs.where(F.size("dropped_ids") > 0).select(
        *place,
        F.lit("unknown cluster reference").alias("kind"),
        F.concat(
            F.array_join("dropped_ids", ", "), F.lit(" in: "), F.substring("statement", 1, 80)
        ).alias("detail"),
    )
    unverified = refs.where(~F.col("verified")).select(
        *place,
        "cause_no",
        F.lit("unverified root cause").alias("kind"),
        F.substring("cause", 1, 100).alias("detail"),
    ).distinct().drop("cause_no")
    removed = components.where(~F.col("supported")).select(
        *place,
        F.lit("unsupported component").alias("kind"),
        F.col("component").alias("detail"),
    )
    return unknown.unionByName(unverified).unionByName(removed)


def validate_analyses(
    analyses: DataFrame, clusters: DataFrame, terms: DataFrame, scope: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Cleaned analyses with a ``status`` (ok or degraded), and the warnings table."""
    refs = stage(validate_refs(analyses, clusters, scope), "refs")
    components = stage(check_components(analyses, terms, scope), "components")
    warnings = validation_warnings(refs, components, scope)
    place = ["analysis_id", *scope]
    evidence = F.struct("evidence_no", "statement", "kept_ids")
    causes = refs.groupBy(*place, "cause_no", "cause", "confidence").agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("evidence_no").isNotNull(), evidence))),
            lambda e: F.struct(
                e["statement"].alias("statement"), e["kept_ids"].alias("cluster_ids")
            ),
        ).alias("evidence")
    ).groupBy(*place).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("cause_no", "cause", "confidence", "evidence"))),
            lambda c: c.dropFields("cause_no"),
        ).alias("root_causes")
    )
    kept = components.where(F.col("supported")).groupBy(*place).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("component_no", "component"))),
            lambda c: c["component"],
        ).alias("affected_components")
    )
    counted = warnings.groupBy(*place).agg(F.count(F.lit(1)).alias("warnings"))
    out = analyses.drop("root_causes", "affected_components")
    for part in (causes, kept, counted):
        out = null_safe_join(out, part, place, "left")
    out = out.withColumns(
        {
            "root_causes": F.coalesce("root_causes", F.array().cast(ROOT_CAUSES)),
            "affected_components": F.coalesce(
                "affected_components", F.array().cast("array<string>")
            ),
            "warnings": F.coalesce("warnings", F.lit(0)),
        }
    ).withColumn("status", F.when(F.col("warnings") > 0, "degraded").otherwise("ok"))
    return out, warnings
