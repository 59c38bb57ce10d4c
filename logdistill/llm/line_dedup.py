"""Line dedup with levelled sorted runs of line hashes.

Documents come in batches.  Every batch first anti-joins the keys that earlier runs have
already settled (seen in enough documents), counts what is left and adds that as a run
sorted by key.  When a level holds ``fan_in`` runs they are merged into one run of the
next level, and keys that reach the bound leave the counting runs for the settled ones.
So a frequent line costs shuffle only until it is settled, and no run is rewritten more
than once per level.

Cases: a null text counts as one empty line and stays null when nothing is dropped; every
row is a document of its own, repeated rows too; keys shorter than ``min_chars`` never
count; an empty table gives no rows; columns besides ``doc_id`` and ``text`` are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logdistill.llm.common import UPPER, small_side, stage, text_key

MIN_CHARS = 1
MIN_DOCUMENTS = 10
BATCHES = 4
FAN_IN = 2
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def line_hashes(text: Column, min_chars: int) -> Column:
    """128-bit key hash of each line, null for keys that are too short."""

    def one(line: Column) -> Column:
        key = key_of(line)
        return F.when(F.char_length(key) >= min_chars, F.md5(key))

    return F.transform(lines_of(text), one)


class Runs:
    """The levels; each run is a staged table of (key, n), sorted by key."""

    def __init__(self, spark: SparkSession, bound: int, fan_in: int = FAN_IN):
        self.spark, self.bound, self.fan_in = spark, bound, fan_in
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    def _sorted(self, df: DataFrame, label: str) -> DataFrame:
        return stage(df.sortWithinPartitions("key"), label)

    def add(self, keys: DataFrame) -> None:
        """Merge-anti-join one batch of keys (one row per document and key), add the rest."""
        fresh = keys
        for run in self.settled:
            fresh = fresh.join(run, "key", "left_anti")
        counted = fresh.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        self.levels[0].append(self._sorted(counted, "run-0"))
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        merged = self._merge(self.levels[level])
        if level + 1 == len(self.levels):
            self.levels.append([])
        whole = self._sorted(merged, f"run-{level + 1}")
        self.levels[level] = []
        self.levels[level + 1].append(whole.where(F.col("n") < self.bound))
        self.settled.append(whole.where(F.col("n") >= self.bound).select("key"))

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        merged = runs[0]
        for run in runs[1:]:
            merged = merged.unionByName(run)
        return merged.groupBy("key").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        """All keys that reached the bound; a key may be settled once only."""
        rest = [run for level in self.levels for run in level]
        found = self._merge(rest).where(F.col("n") >= self.bound).select("key")
        for run in self.settled:
            found = found.unionByName(run)
        return found.distinct()


def frequent_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS,
    batches: int = BATCHES, fan_in: int = FAN_IN,
) -> DataFrame:
    """Keys (``key``) of at least ``min_chars`` code points in at least ``min_documents`` rows."""
    spark = docs.sparkSession
    keys = F.array_distinct(F.filter(line_hashes(F.col("text"), min_chars), lambda h: h.isNotNull()))
    hashed = docs.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"),
        F.explode_outer(keys).alias("key"),
    ).where(F.col("key").isNotNull())
    hashed = stage(hashed, "line-keys")
    runs = Runs(spark, min_documents, fan_in)
    for b in range(batches):
        runs.add(hashed.where(F.col("batch") == b).select("key"))
    return stage(runs.frequent(), "frequent-lines")


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS,
    batches: int = BATCHES, fan_in: int = FAN_IN,
) -> DataFrame:
    """Drop every line whose key is frequent; adds ``n_lines`` and ``n_dropped``.

    Lines travel as hashes; a text is shuffled once, together with the positions to drop.
    """
    drop = frequent_lines(docs, min_chars, min_documents, batches, fan_in)
    # Identical rows lose the same lines, so (doc_id, text) decides for all of them.
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__doc"),
        text_key(F.col("text")).alias("__text"),
        F.posexplode_outer(line_hashes(F.col("text"), min_chars)).alias("__pos", "key"),
    ).where(F.col("key").isNotNull())
    hits = (
        lines.join(small_side(drop), "key", "left_semi")
        .groupBy("__doc", "__text")
        .agg(F.collect_set("__pos").alias("__drop"))
    )
    keyed = docs.withColumn(
        "__doc", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    ).withColumn("__text", text_key(F.col("text")))
    none = F.array().cast("array<int>")
    split = lines_of(F.col("text"))
    kept = F.filter(split, lambda line, i: ~F.array_contains(F.col("__drop"), i))
    out = keyed.join(hits, ["__doc", "__text"], "left").withColumn(
        "__drop", F.coalesce(F.col("__drop"), none)
    )
    n_dropped = F.size("__drop").cast("long")
    return (
        out.withColumn("n_lines", F.size(split).cast("long"))
        .withColumn("n_dropped", n_dropped)
        .withColumn(
            "text",
            F.when(n_dropped == 0, F.col("text")).otherwise(F.array_join(kept, "\n")),
        )
        .drop("__doc", "__text", "__drop")
    )


def lean_documents(docs: DataFrame) -> DataFrame:
    """One row per document: counts and the digest of what is left."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, doc_id, string_split(text, chr(10)) AS ls FROM d),
l AS (SELECT r, unnest(range(len(ls))) AS p, unnest(ls) AS line FROM s),
k AS (
  SELECT r, p, line, translate(
    regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT r, p, line, key IN (SELECT key FROM f) AS gone FROM k),
g AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS kept
  FROM m GROUP BY r)
SELECT d.doc_id, g.n_lines, g.n_dropped, sha256(g.kept) AS kept_sha256
FROM d JOIN g USING (r)
"""
