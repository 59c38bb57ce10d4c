"""Approximate nearest neighbours by a hash-prefix forest.

Every tree is a sorted array of long hash strings: ``BITS`` signs of random projections of
the centred vectors.  A query descends in all trees to its longest prefix matches, then
ascends in all of them together, one bit at a time, until the entries that share the
prefix, summed over the trees, reach the wanted number.  These candidates are ranked by
exact distance.

The arrays are cut into slices by their first bits (and by vector id where many rows share
these), so a query visits one prefix of every tree.  Slices hold their vectors: a slice
ranks its own candidates and passes on the nearest few per query only.

``SHARE`` is the number of entries, as a share of all rows, at which ascending stops.
Vectors without any structure, such as independent directions, need a large one: at 64
dimensions no short list holds the neighbours, which are hardly nearer than the rest.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do rows without an id; vectors of different length never meet; rows repeated
with the same id and vector count once; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logdistill.llm.common import small_side, stage

TREES = 64
BITS = 32
SHARE = 0.5
LEAST = 400
NEAREST = 10
SLICE_ROWS = 16_384
MOST_PREFIX_BITS = 5
SEED = 7


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, vec): distinct rows whose vectors take part; ``vec`` as doubles."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)))
        .select(
            F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"),
            F.col("embedding").cast("array<double>").alias("vec"),
        )
        .dropDuplicates()
    )


def centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """Mean vector by dimension, from sums per task."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                total = np.stack(part["vec"].to_numpy()).sum(axis=0)
                yield pd.DataFrame({"dim": [dim] * dim, "place": np.arange(dim), "s": total, "n": [len(part)] * dim})

    added = rows.select("dim", "vec").mapInPandas(sums, "dim int, place int, s double, n long")
    means = added.groupBy("dim", "place").agg((F.sum("s") / F.sum("n")).alias("m"))
    out: dict[int, np.ndarray] = {}
    # As many numbers as a vector has components.
    for r in means.collect():
        out.setdefault(r["dim"], np.zeros(r["dim"]))[r["place"]] = r["m"]
    return out


def hashed(rows: DataFrame, means: dict[int, np.ndarray], trees: int, bits: int) -> DataFrame:
    """(vec_id, dim, vec as bytes, hashes): the hash string of each tree as a number."""
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                dim = int(dim)
                if dim not in planes:
                    rng = np.random.default_rng([SEED, dim])
                    planes[dim] = rng.standard_normal((trees, dim, bits))
                x = np.stack(part["vec"].to_numpy())
                inner = x - means.get(dim, np.zeros(dim))
                h = np.stack([((inner @ planes[dim][t]) > 0) @ weights for t in range(trees)], axis=1)
                yield pd.DataFrame(
                    {
                        "vec_id": part["vec_id"].to_numpy(), "dim": dim,
                        "vec": [v.tobytes() for v in x], "hashes": list(h.astype(np.int64)),
                    }
                )

    return rows.mapInPandas(strings, "vec_id long, dim int, vec binary, hashes array<long>")


def _ranges(strings: np.ndarray, q: np.ndarray, level: np.ndarray | int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where entries begin and end that share the first ``level`` bits with each query."""
    shift = bits - np.asarray(level)
    low = (q >> shift) << shift
    return np.searchsorted(strings, low, "left"), np.searchsorted(strings, low + (np.int64(1) << shift), "left")


def _slices(index: DataFrame, trees: int, bits: int, prefix: int, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """Entries (dim, tree, top, salt, h, ...) and the number of salts of each slice."""
    entries = index.select(
        "vec_id", "dim", "vec", F.posexplode_outer("hashes").alias("tree", "h")
    ).withColumn("top", F.shiftright("h", bits - prefix))
    sizes = stage(
        entries.groupBy("dim", "tree", "top").agg(
            F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("salts")
        ),
        "slice-sizes",
    )
    # At most trees * 2^prefix rows for each dimension.
    salted = entries.join(small_side(sizes), ["dim", "tree", "top"]).withColumn(
        "salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int")
    ).drop("salts")
    return salted, sizes


def nearest(
    vectors: DataFrame, is_query, trees: int = TREES, bits: int = BITS, share: float = SHARE,
    k: int = NEAREST, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` where ``is_query`` holds."""
    rows = stage(usable(vectors), "vectors")
    n = rows.count()
    prefix = min(MOST_PREFIX_BITS, max(0, math.ceil(math.log2(max(n, 1) / slice_rows))))
    want = max(LEAST, share * n)
    index = stage(hashed(rows, centres(rows), trees, bits), "hashes")
    entries, sizes = _slices(index, trees, bits, prefix, slice_rows)
    asked = (
        index.where(is_query)
        .select(F.col("vec_id").alias("query_id"), "dim", F.col("vec").alias("qvec"), F.posexplode_outer("hashes").alias("tree", "qh"))
        .withColumn("top", F.shiftright("qh", bits - prefix))
        .join(small_side(sizes), ["dim", "tree", "top"])
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .drop("salts")
    )
    asked = stage(asked, "asked")
    keys = ["dim", "tree", "top", "salt"]
    levels = list(range(prefix, bits + 1))

    def count(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        strings = np.sort(data["h"].to_numpy(dtype=np.int64))
        q = queries["qh"].to_numpy(dtype=np.int64)
        counts = np.zeros((len(q), len(levels)), dtype=np.int64)
        for j, level in enumerate(levels):
            low, high = _ranges(strings, q, level, bits)
            counts[:, j] = high - low
        asking = queries["query_id"].to_numpy(dtype=np.int64)
        # Groups without a query give an empty column, which still holds lists.
        return pd.DataFrame({"query_id": asking, "counts": pd.Series(list(counts), dtype=object)})

    descended = (
        entries.select(*keys, "h").groupBy(*keys)
        .cogroup(asked.select(*keys, "query_id", "qh").groupBy(*keys))
        .applyInPandas(count, "query_id long, counts array<long>")
    )
    # Together: the deepest level at which all trees hold enough, or the shallowest one.
    totals = descended.groupBy("query_id").agg(
        *[F.sum(F.get("counts", j)).alias(f"c{j}") for j in range(len(levels))]
    )
    level = F.lit(levels[0])
    for j, at in enumerate(levels):
        level = F.when(F.col(f"c{j}") >= want, F.lit(at)).otherwise(level)
    ascended = stage(totals.select("query_id", level.alias("level")), "levels")

    def search(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        strings = data["h"].to_numpy(dtype=np.int64)
        order = np.argsort(strings, kind="stable")
        strings, ids = strings[order], data["vec_id"].to_numpy(dtype=np.int64)[order]
        found: list[tuple] = []
        if len(data) and len(queries):
            x = np.frombuffer(b"".join(data["vec"]), dtype=np.float64).reshape(len(data), -1)[order]
            low, high = _ranges(strings, queries["qh"].to_numpy(), queries["level"].to_numpy(), bits)
            own = queries["query_id"].to_numpy()
            for i, raw in enumerate(queries["qvec"]):
                near = slice(low[i], high[i])
                d = np.sqrt(((x[near] - np.frombuffer(raw, dtype=np.float64)) ** 2).sum(axis=1))
                name = ids[near]
                if len(d) > 4 * k:
                    # Keep all ties of the k-th place (the query itself may be among them).
                    some = d <= np.partition(d, k)[k]
                    d, name = d[some], name[some]
                other = name != own[i]
                d, name = d[other], name[other]
                best = np.lexsort((name, d))[:k]
                found += [(own[i], int(name[b]), float(d[b])) for b in best]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        )

    ready = asked.join(small_side(ascended), "query_id")
    hits = (
        entries.groupBy(*keys)
        .cogroup(ready.select(*keys, "query_id", "qh", "qvec", "level").groupBy(*keys))
        .applyInPandas(search, "query_id long, vec_id long, score double")
        .groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    )
    by_distance = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(by_distance))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def nearest_hundredth(vectors: DataFrame) -> DataFrame:
    """The ten nearest of every hundredth row by id."""
    return nearest(vectors.select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
