"""Helpers shared by the corpus operators: staging, bounded broadcasts, words, row keys."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import logdistill.llm

# Functions of this package travel to executors by value, so nothing is installed there.
cloudpickle.register_pickle_by_value(logdistill.llm)

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Everything below U+0080 that is neither a digit nor a lower-case letter separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
BLANK = r"[\x20\x09-\x0D]"


# Folders of local sessions that set none, by application.
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a new local one only where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL.setdefault(app, "") or tempfile.mkdtemp(prefix="logdistill-")
        _LOCAL[app] = root
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table that several branches read once, as Parquet in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int | None = None, limit: int = 500_000) -> DataFrame:
    """Mark a staged table of narrow rows for broadcast, only if it has at most ``limit`` rows.

    Beyond that the join is left to Spark, which shuffles both sides and splits skewed
    partitions.  The result is the same either way.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z only; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def grams(words: Column, k: int) -> Column:
    """64-bit hashes of all k consecutive words, by position; empty when there are fewer."""
    n = F.size(words) - F.lit(k - 1)
    return F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
            lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]),
        ),
    ).otherwise(F.array().cast("array<long>"))


def text_key(text: Column) -> Column:
    """A 128-bit key of a text; null and empty texts share one."""
    return F.md5(F.coalesce(text, F.lit("")))


def same(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in pairs])


def documents_of(df: DataFrame) -> DataFrame:
    """The columns of ``documents`` only, whatever else the table holds; missing ones are null."""
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    have = set(df.columns)
    return df.select(
        *[
            (F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c)
            for c in DOCUMENT_COLUMNS
        ]
    )


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromDDL(schema))


def numbered(df: DataFrame, order: list[str], name: str, label: str) -> DataFrame:
    """Distributed row numbers from 0 in a total order.

    Rows are range-partitioned and numbered within each partition; the offsets are one
    row per partition.  No task sees more than its range.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = stage(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id()),
        label,
    )
    part = F.shiftright("__at", 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition, so this driver read is bounded by the number of partitions.
    offset, rows = 0, []
    for r in sorted(sizes.collect(), key=lambda r: r["__part"]):
        rows.append((r["__part"], offset))
        offset += r["__n"]
    offsets = spark.createDataFrame(rows, "__part long, __offset long")
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ranged.join(F.broadcast(offsets), part == F.col("__part"))
        .withColumn(name, F.col("__offset") + inside)
        .drop("__at", "__part", "__offset")
    )
