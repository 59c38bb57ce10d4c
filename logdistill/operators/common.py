"""Column names, null-safe joins and staging shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCOPE = ("log_group",)
CLUSTER_KEY = ("exception_type", "template")


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
    extra: Column | None = None,
) -> DataFrame:
    """Join on equal keys where null equals null; the right-hand keys are dropped.

    ``extra`` may add a residual condition over the remaining columns.
    """
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    if extra is not None:
        on = on & extra
    out = left.join(renamed, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__{k}" for k in keys])


# Folders of local sessions that set none, by application.
_LOCAL: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; local sessions without one get a folder of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL.get(app) or tempfile.mkdtemp(prefix="logdistill-")
        _LOCAL[app] = root
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_dir(spark)}/logdistill-{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table used by several branches once to the cluster's shared folder.

    Later branches then read only the columns they need from Parquet and do not
    depend on executors that may be gone.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows and characters up to which a staged table with one row per scope is broadcast.
BROADCAST_ROWS, BROADCAST_CHARS = 500_000, 32 << 20


def small_side(staged: DataFrame) -> DataFrame:
    """Mark a staged table for broadcast if its measured size allows it.

    Without the mark a join of events with few scopes shuffles the events into as many
    tasks as there are scopes: adaptive plans take a broadcast back where most partitions
    are empty.  A larger table is left to Spark, which splits skewed partitions.
    """
    chars = F.length(F.to_json(F.struct("*")))
    size = staged.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars")).first()
    return F.broadcast(staged) if size["n"] <= BROADCAST_ROWS and size["chars"] <= BROADCAST_CHARS else staged


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add row numbers from 0 in the given order without sorting in one task.

    Rows are range-partitioned and numbered within their partition; what reaches the
    driver is one count per partition.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = stage(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id()),
        "numbered",
    )
    part = F.shiftright("__at", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, before = [], 0
    for row in sorted(sizes, key=lambda r: r["part"]):
        offsets.append((row["part"], before))
        before += row["n"]
    table = spark.createDataFrame(offsets, "__part long, __before long")
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ranged.join(F.broadcast(table), part == F.col("__part"))
        .withColumn(name, F.col("__before") + inside)
        .drop("__at", "__part", "__before")
    )
