"""Finding which of many ids a text holds, by probe grams and a Bloom filter.

Every id has one probe: of its runs of up to ``GRAM`` characters (``LONG_GRAM`` where ids
are many) the one that the fewest ids share, and of these the one with the fewest digits,
as logs are full of numbers.  A Bloom filter of all probes is tested on the runs of a message inside the
projection of the scan, so that only runs that may be a probe become rows, as hashes; an
equal join with the hashes of the probes and a final "contains" leave exactly the ids that the message holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 6
# Short runs of many ids occur in messages by chance; beyond ``MANY`` ids runs are longer.
LONG_GRAM, MANY = 8, 1_000
# Odds of a false hit per run of a message: about 1 in 40,000.
BITS_PER_PROBE = 32
HASHES = 6
# The filter never exceeds 8 MB; beyond that many ids it lets more runs through to the join.
MOST_BITS = 1 << 26
# Runs are cut from blocks of a message, as a cut counts characters from the start.
BLOCK = 64


def gram_for(n: int) -> int:
    """The longest run to take as a probe of ``n`` ids."""
    return GRAM if n <= MANY else LONG_GRAM


def probe_size(text: Column, gram: int = GRAM) -> Column:
    return F.least(F.char_length(text), F.lit(gram))


def runs(text: Column, size: Column | int, most: int | None = None, hashed: bool = False) -> Column:
    """All runs of ``size`` characters of a text or their hashes, the first ``most`` if given."""
    size = F.lit(size) if isinstance(size, int) else size
    n = F.char_length(text) - size + 1
    n = n if most is None else F.least(n, F.lit(most))

    def run(i: Column) -> Column:
        cut = F.substring(text, i, size)
        return F.xxhash64(cut) if hashed else cut

    every = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), run)
    return F.when(n > 0, every).otherwise(F.array().cast("array<long>" if hashed else "array<string>"))


def probes_of(ids: DataFrame, gram: int = GRAM) -> DataFrame:
    """``wanted_id`` with its ``probe``: the run that the fewest ids hold, ties to the one
    with the fewest digits and then to the smaller text."""
    text = F.col("wanted_id")
    grams = ids.select(text, F.explode(F.array_distinct(runs(text, probe_size(text, gram)))).alias("probe"))
    shared = grams.groupBy("probe").agg(F.count(F.lit(1)).alias("n"))
    digits = F.length("probe") - F.length(F.translate("probe", "0123456789", ""))
    least = F.min(F.struct("n", digits.alias("digits"), "probe"))["probe"].alias("probe")
    return grams.join(shared, "probe").groupBy("wanted_id").agg(least)


def filter_bits(n: int) -> int:
    """Bits of a filter for ``n`` probes, a power of two and at least one word of 64."""
    return min(MOST_BITS, max(64, 1 << (n * BITS_PER_PROBE - 1).bit_length()))


def bit_places(run_hash: Column, bits: int) -> list[Column]:
    """Places of a hash; the first costs next to nothing, as most runs fail there."""
    mask = F.lit(bits - 1).cast("long")
    first = run_hash.bitwiseAND(mask)
    step = F.shiftrightunsigned(run_hash, 32).bitwiseOR(F.lit(1).cast("long")).bitwiseAND(mask)
    return [first, *[(first + F.lit(j).cast("long") * step).bitwiseAND(mask) for j in range(1, HASHES)]]


def bloom_filter(probes: DataFrame, bits: int) -> DataFrame:
    """One row with ``words``, the filter as an array of longs; bits are set word by word."""
    words = bits // 64
    places = probes.select(F.explode(F.array(*bit_places(F.xxhash64("probe"), bits))).alias("place"))
    word = F.shiftright("place", 6).alias("word")
    bit = F.expr("shiftleft(1L, CAST(place % 64 AS INT))")
    held = places.groupBy(word).agg(F.bit_or(bit).alias("bits"))
    every = held.unionByName(probes.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")))
    filled = every.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return filled.agg(
        F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words")
    )


def may_hold(run_hash: Column, words: Column, bits: int) -> Column:
    """Whether the filter has all bits of a hash; tests stop at the first one missing."""

    def is_set(place: Column) -> Column:
        word = F.get(words, F.shiftright(place, 6).cast("int"))
        return F.getbit(word, place.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

    return reduce(lambda a, b: a & b, [is_set(p) for p in bit_places(run_hash, bits)])


def probe_hits(text: Column, words: Column, bits: int, sizes: list[int]) -> Column:
    """Distinct hashes of the runs of a text, of any of the sizes, that the filter lets through."""
    widest = max(sizes)
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - 1, F.lit(0)), F.lit(BLOCK))

    def passed(part: Column, most: int | None = None) -> Column:
        found = [F.filter(runs(part, n, most, hashed=True), lambda h: may_hold(h, words, bits)) for n in sizes]
        return found[0] if len(found) == 1 else F.concat(*found)

    # Blocks are cut once each: a lambda works its outer expressions out anew for every run.
    cut = F.transform(starts, lambda at: F.substring(text, at + 1, F.lit(BLOCK + widest - 1)))
    short = F.char_length(text) <= BLOCK
    return F.array_distinct(
        F.when(short, passed(text)).otherwise(F.flatten(F.transform(cut, lambda part: passed(part, BLOCK))))
    )
