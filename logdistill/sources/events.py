"""Event tables from result rows, other tables, and back to files."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logdistill.functions.fields import parse_utc
from logdistill.operators.common import null_safe_join, stage
from logdistill.operators.enrich import extract_fields

ROW_TYPE = "array<struct<field:string,value:string>>"


def rows_to_events(rows: DataFrame, column: str = "row", log_group: str | None = None) -> DataFrame:
    """Rows of ``{field, value}`` pairs to events; rows without a readable time are dropped.

    A field that occurs twice counts with its last value.
    """

    def field(name: str):
        hits = F.filter(F.col(column), lambda p: p["field"] == name)
        return F.try_element_at(hits, F.lit(-1))["value"]

    keep = [c for c in rows.columns if c != column]
    group = {} if log_group is None else {"log_group": F.lit(log_group)}
    return (
        rows.select(
            *keep,
            parse_utc(field("@timestamp")).alias("ts"),
            F.coalesce(field("@message"), F.lit("")).alias("message"),
            field("@logStream").alias("log_stream"),
        )
        .withColumns(group)
        .where(F.col("ts").isNotNull())
    )


def read_log_rows(
    spark: SparkSession, path: str | list[str], log_group: str | None = None,
    multiline: bool = True,
) -> DataFrame:
    """Events of JSON result files ``{"results": [[{field, value}, ...], ...]}``.

    A multi-line document cannot be split; write one document per line and pass
    ``multiline=False`` where files are large.
    """
    files = spark.read.schema(f"results array<{ROW_TYPE}>").json(path, multiLine=multiline)
    rows = files.select(F.explode("results").alias("row"))
    return extract_fields(rows_to_events(rows, log_group=log_group)).drop(
        "json_endpoint", "json_status"
    )


@dataclass(frozen=True)
class ResultFiles:
    """Events of result files, and one row per file on what it held."""

    events: DataFrame
    files: DataFrame


RESULT_SCHEMA = f"results array<{ROW_TYPE}>, statistics struct<recordsMatched:double>, broken string"


def read_result_files(
    spark: SparkSession, path: str | list[str], log_group: str | None = None, multiline: bool = False
) -> ResultFiles:
    """Result documents as a source that tells what it could not read.

    ``files`` has for each file (and its partition columns) ``documents``,
    ``broken_documents`` that are no such document, ``rows``, ``rejected_rows`` without a
    readable time, ``matched`` as the documents state it, and ``truncated`` where more rows
    matched than were returned.  The parsed rows are staged, so that text is read once.
    """
    schema = T.StructType.fromDDL(RESULT_SCHEMA)
    read = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken")
    found = read.json(path, multiLine=multiline).withColumn("file", F.input_file_name())
    parts = [c for c in found.columns if c not in schema.names]
    whole = F.col("results").isNotNull() & F.col("broken").isNull()
    documents = stage(
        found.select(
            *parts, whole.alias("whole"), F.when(whole, F.col("results")).alias("results"),
            F.col("statistics.recordsMatched").alias("matched"),
        ),
        "result-files",
    )
    rows = documents.select(*parts, F.explode("results").alias("row"))
    events = extract_fields(rows_to_events(rows, log_group=log_group)).drop("json_endpoint", "json_status")
    readable = events.groupBy(*parts).agg(F.count(F.lit(1)).alias("readable"))
    told = documents.groupBy(*parts).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(~F.col("whole")).alias("broken_documents"),
        F.sum(F.coalesce(F.size("results"), F.lit(0))).alias("rows"),
        F.sum("matched").alias("matched"),
    )
    files = null_safe_join(told, readable, parts, "left").fillna(0, ["readable"])
    files = files.withColumns(
        {
            "rejected_rows": F.col("rows") - F.col("readable"),
            "truncated": F.coalesce(F.col("matched") > F.col("readable"), F.lit(False)) & (F.col("readable") > 0),
        }
    ).drop("readable")
    return ResultFiles(events, files)


def from_table(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Any table as events: ``mapping`` gives the source column of each event column.

    Times are cast to timestamps, missing group and stream become null, and rows
    without a time are dropped; other columns are kept.
    """
    mapping = dict(mapping or {})
    df = df.withColumnsRenamed({src: name for name, src in mapping.items()})
    missing = {
        c: F.lit(None).cast("string") for c in ("log_group", "log_stream") if c not in df.columns
    }
    return df.withColumns(
        {**missing, "ts": F.col("ts").cast("timestamp"), "message": F.coalesce("message", F.lit(""))}
    ).where(F.col("ts").isNotNull())


def log_group_inventory(groups: DataFrame, patterns: list[str]) -> DataFrame:
    """All named log groups, allowed ones first, with size and retention."""
    from logdistill.operators.filters import is_allowed

    return (
        groups.where(F.col("name") != "")
        .select(
            "name", is_allowed(F.col("name"), patterns).alias("allowed"), "stored_bytes",
            "retention_days",
        )
        .orderBy(F.desc("allowed"), "name")
    )


def write_report(df: DataFrame, path: str, format: str = "json", mode: str = "errorifexists") -> None:
    df.write.format(format).mode(mode).save(path)
