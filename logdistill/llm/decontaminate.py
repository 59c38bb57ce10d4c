"""Benchmark decontamination by winnowed fingerprints.

Both sides keep, of every ``W`` consecutive k-gram hashes, the smallest (all positions on
ties).  A span of ``WINDOW = K + W - 1`` shared words therefore always shares a
fingerprint at the same place, so an equal join on fingerprints loses none.  Each hit is
extended to the windows around it, and only windows that agree with one of an item in all
words count.  Items shorter than a window are compared whole: their hash is joined with the
hashes of all document word runs of the same length, then verified the same way.

Joins carry hashes and places, never words, and every window of a document is looked up
once whatever the number of equal places on the other side, so texts of one repeated word
cost no more than their length.  Windows are compared by 128-bit digests of their words.

Cases: null and empty texts have no words and neither hit nor are hit; items with a null
id count as an item named by the empty string; repeated items count once by id; repeated
documents each get their row; columns of the
names added here are replaced; empty tables give clean documents or no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logdistill.llm.common import count_words, grams, small_side, stage, text_key, words_of

K = 5
W = 6
WINDOW = K + W - 1
# Measured bytes of fingerprint hits up to which they are broadcast to the texts.
HIT_BYTES = 64 << 20


def _minima(hashes: Column, w: int = W) -> Column:
    """The minimum of every window of ``w`` neighbouring hashes, by its first place.

    With fewer than ``w`` hashes there is none.
    """
    n = F.size(hashes)
    last = n - w
    return F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.least(*[F.get(hashes, i + j) for j in range(w)]),
        ),
    ).otherwise(F.array().cast("array<long>"))


def _chosen(hashes: Column, lows: Column, w: int = W) -> Column:
    return F.when(
        F.size(lows) > 0,
        F.filter(
            F.sequence(F.lit(0), F.greatest(F.size(hashes), F.lit(1)) - 1),
            # The largest minimum of the windows around a place is its own hash, or smaller.
            lambda p: F.get(hashes, p) == F.greatest(*[F.get(lows, p - j) for j in range(w)]),
        ),
    ).otherwise(F.array().cast("array<int>"))


def fingerprints(df: DataFrame, carry: list[str]) -> DataFrame:
    """Rows (carry..., at, print): the winnowed fingerprints of ``words``, without the words.

    Outer explode, here and below: for a plain one the optimizer adds a test of the array
    below the projections, which evaluates their nested expressions once more per use.
    """
    hashed = df.withColumn("__h", grams(F.col("words"), K))
    lows = hashed.withColumn("__m", _minima(F.col("__h")))
    chosen = lows.withColumn("__p", _chosen(F.col("__h"), F.col("__m")))
    prints = F.transform("__p", lambda p: F.struct(p.alias("at"), F.get("__h", p).alias("print")))
    return chosen.select(*carry, F.explode_outer(prints).alias("__f")).where(
        F.col("__f").isNotNull()
    ).select(*carry, "__f.at", "__f.print")


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        words_of(F.col("text")).alias("words"),
    ).where(F.size("words") > 0)


def _window(start: Column, n: Column) -> Column:
    """A 128-bit name of ``n`` words; words hold no blank, so no two runs read alike."""
    return F.md5(F.concat_ws(" ", F.slice("words", start + 1, n)))


def item_windows(items: DataFrame) -> DataFrame:
    """Distinct (item, window): all windows of all items."""
    n = F.least(F.size("words"), F.lit(WINDOW))
    names = F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: _window(i, n))
    return items.select("item", F.explode_outer(names).alias("window")).distinct()


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(__doc, __text, n, places): where a document shares a fingerprint with any item.

    ``n`` is the number of words of the window.  For whole windows the places are those of
    fingerprints; for items of fewer words they are starts.  Only hashes and places are
    joined, so neither words nor the number of an item's equal places travel along.
    """
    keys = ["__doc", "__text"]
    prints = stage(fingerprints(items.where(F.size("words") >= WINDOW), []).select("print").distinct(), "item-prints")
    met = [
        fingerprints(docs, keys).join(small_side(prints), "print", "left_semi")
        .select(*keys, F.lit(WINDOW).alias("n"), F.col("at").alias("place"))
    ]
    few = stage(
        items.where(F.size("words") < WINDOW)
        .select(F.size("words").alias("n"), F.xxhash64(F.concat_ws(" ", "words")).alias("print")).distinct(),
        "short-items",
    )

    def short_runs(n: int) -> DataFrame:
        runs = F.when(
            F.size("words") >= n,
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0))),
                lambda i: F.xxhash64(F.concat_ws(" ", F.slice("words", i + 1, n))),
            ),
        )
        return (
            docs.withColumn("__r", runs)
            .select(*keys, F.posexplode_outer("__r").alias("place", "print"))
            .join(small_side(few.where(F.col("n") == n).select("print")), "print", "left_semi")
            .select(*keys, F.lit(n).alias("n"), "place")
        )

    # At most WINDOW - 1 lengths.
    met += [short_runs(n) for n in sorted(r[0] for r in few.select("n").distinct().collect())]
    return reduce(DataFrame.unionByName, met).groupBy(*keys, "n").agg(F.collect_set("place").alias("places"))


def windows_hit(docs: DataFrame, windows: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (__doc, __text, start, n, window): where windows of items occur in documents.

    Hits are extended: every run of ``WINDOW`` words around a shared fingerprint is looked
    up among the items' windows, each run of a document once.
    """
    worded = docs.select("__doc", "__text", words_of(F.col("text")).alias("words"))
    found = stage(candidates(worded, items), "print-hits")
    # Places are as many as a long text has words, so the bytes are measured, not the rows.
    size = found.agg(F.sum(F.size("places") * 8 + 120)).first()[0] or 0
    near = docs.join(F.broadcast(found) if size <= HIT_BYTES else found, ["__doc", "__text"])
    last = F.size("words") - WINDOW
    around = F.array_distinct(
        F.flatten(
            F.transform(
                "places",
                lambda at: F.sequence(F.greatest(at - (W - 1), F.lit(0)), F.greatest(F.least(at, last), F.lit(0))),
            )
        )
    )
    starts = F.when(F.col("n") == WINDOW, around).otherwise(F.col("places"))
    runs = (
        near.select("__doc", "__text", "n", "places", words_of(F.col("text")).alias("words"))
        .withColumn("__s", starts)
        .select(
            "__doc", "__text", "n",
            F.explode_outer(
                F.transform("__s", lambda i: F.struct(i.alias("start"), _window(i, F.col("n")).alias("window")))
            ).alias("__w"),
        )
        .select("__doc", "__text", "n", "__w.start", "__w.window")
    )
    known = windows.select("window").distinct()
    return runs.join(small_side(stage(known, "window-names")), "window", "left_semi").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``."""
    own = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    keyed = docs.drop(*own).withColumn(
        "__doc", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    ).withColumn("__text", text_key(F.col("text")))
    items = stage(_items(benchmark), "items")
    windows = stage(item_windows(items), "item-windows")
    hit = stage(windows_hit(keyed, windows, items), "windows-hit")
    before = Window.partitionBy("__doc", "__text").orderBy("start", "n").rowsBetween(
        Window.unboundedPreceding, -1
    )
    end = F.col("start") + F.col("n")
    spans = hit.select("__doc", "__text", "start", "n").distinct()
    fresh = F.greatest(end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
    covered = spans.withColumn("__fresh", fresh).groupBy("__doc", "__text").agg(
        F.sum("__fresh").cast("long").alias("n_hit")
    )
    names = (
        hit.select("__doc", "__text", "window").distinct().join(windows, "window")
        .select("__doc", "__text", "item").distinct().groupBy("__doc", "__text").agg(
            F.count(F.lit(1)).alias("n_items"),
            F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("__names"),
        )
    )
    # One row of fixed width per contaminated document; where these are few, no text is shuffled.
    facts = small_side(stage(covered.join(names, ["__doc", "__text"]), "leak-facts"), limit=200_000)
    return (
        keyed.withColumn("n_words", count_words(F.col("text")))
        .join(facts, ["__doc", "__text"], "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
        .withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("long")))
        .withColumn("items_sha256", F.coalesce("__names", F.sha2(F.lit(""), 256)))
        .withColumn("contaminated", F.col("n_hit") > 0)
        .drop("__doc", "__text", "__names")
    )


def contaminated_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    narrow = docs.select("doc_id", "text")
    found = contamination(narrow, benchmark.select("item_id", "text"))
    return found.drop("text")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n)),
h AS (SELECT dw.r, dw.p, iw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM h GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit,
  coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.names, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
