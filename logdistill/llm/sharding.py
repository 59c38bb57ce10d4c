"""Shards by best-fit-decreasing bin packing of groups of equal texts.

Groups are indivisible: documents of equal text share a shard.  Groups are sorted by
size, largest first, and each enters the open shard with the tightest remaining capacity
that holds it, found in a balanced tree; where none does, a new shard is opened.

Groups may be many, so the packing works on runs.  Sizes fall into classes (exact below
4,096 bytes, 2,048 classes per doubling beyond it) and a group counts as the largest size
of its class.  Groups of one class fit alike, so best fit puts a run of them into one
shard at a time, and the whole packing is a list of runs (class, first rank, last rank,
shard).  Only the counts by class reach the driver; their number follows the range of
sizes, not the number of rows.  Groups get their rank by a distributed sort.

For a given number of shards the capacity is the smallest that still packs into them,
found by halving.

Cases: null counts as an empty text; repeated rows and null ids are rows of their own; a
group larger than an equal share of all bytes cannot stay whole without breaking the law,
so it is cut into pieces of whole documents of at most that share; a document larger than
it is a piece of its own; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logdistill.llm.common import empty, numbered, stage, text_key

SHARDS = 8
# Leading bits of a size that its class keeps.
BITS = 12
# Capacities are searched to this share of an equal share.
PRECISION = 1e-5

PLACED = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"
RUNS = "first_at long, last_at long, shard int"


class Tree:
    """A treap of (remaining capacity, shard): insert, and take the tightest that fits."""

    def __init__(self):
        self.root = None
        self.seed = 1

    def _heat(self) -> int:
        self.seed = self.seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        return self.seed >> 20

    @staticmethod
    def _split(node, key):
        """Nodes below the key, and the rest."""
        low = high = None
        path = []
        while node:
            path.append(node)
            node = node[3] if node[0] < key else node[2]
        for node in reversed(path):
            if node[0] < key:
                node[3] = low
                low = node
            else:
                node[2] = high
                high = node
        return low, high

    @staticmethod
    def _merge(low, high):
        head = [None, None, None, None]
        at, side = head, 3
        while low and high:
            if low[1] > high[1]:
                at[side] = low
                at, side, low = low, 3, low[3]
            else:
                at[side] = high
                at, side, high = high, 2, high[2]
        at[side] = low or high
        return head[3]

    def insert(self, remaining: int, shard: int) -> None:
        key = (remaining, shard)
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self._heat(), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove the least remaining capacity of at least ``size``."""
        found, node = None, self.root
        while node:
            if node[0] >= (size, -1):
                found, node = node[0], node[2]
            else:
                node = node[3]
        if found is None:
            return None
        low, rest = self._split(self.root, found)
        _, high = self._split(rest, (found[0], found[1] + 1))
        self.root = self._merge(low, high)
        return found


def pack(classes: list[tuple[int, int]], capacity: int, most: int | None = None):
    """Best fit of (size, count) classes, sizes descending: runs and the number of shards.

    None if more than ``most`` shards would be opened.
    """
    tree, runs, shards = Tree(), [], 0
    for size, count in classes:
        rank = 0
        while rank < count:
            found = tree.take(size)
            if found is None:
                if shards == most:
                    return None
                found = (max(capacity, size), shards)
                shards += 1
            many = min(count - rank, found[0] // size)
            runs.append((size, rank, rank + many - 1, found[1]))
            rank += many
            tree.insert(found[0] - many * size, found[1])
    return runs, shards


def tightest(classes: list[tuple[int, int]], shards: int, precision: float = PRECISION):
    """Runs at the smallest capacity found that packs into ``shards``."""
    total = sum(s * n for s, n in classes)
    low = max(-(-total // shards), classes[0][0]) if classes else 1
    found = pack(classes, low, shards)
    if found:
        return found[0]
    # Filling any shard up to a share plus one largest group always suffices.
    high = low + classes[0][0]
    best = pack(classes, high, shards)
    while high - low > max(1, precision * total / shards):
        middle = (low + high) // 2
        found = pack(classes, middle, shards)
        low, high, best = (low, middle, found) if found else (middle, high, best)
    return best[0]


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def class_of(size: Column) -> Column:
    """The size rounded up to a number of ``BITS`` leading bits."""
    step = F.pow(F.lit(2.0), F.greatest(F.char_length(F.bin(size)) - BITS, F.lit(0)))
    return (F.ceil(size / step) * step).cast("long")


def facts_of(docs: DataFrame) -> DataFrame:
    """Staged facts without texts: row number, group key, size, checksum."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return stage(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc_id").cast("long").alias("doc_id"),
            text_key(F.col("text")).alias("group"),
            size_of(F.col("text")).alias("size"),
            F.crc32(text).alias("text_crc32"),
        ),
        "shard-facts",
    )


def cut_groups(facts: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """Facts and groups with ``piece``: 0 but for groups above the share, which are cut.

    Fewer groups than shards can exceed an equal share, so they are broadcast.
    """
    groups = facts.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("each"))
    groups = stage(groups, "shard-groups").withColumn("per", F.greatest(F.floor(F.lit(share) / F.col("each")), F.lit(1)))
    large = F.col("n") * F.col("each") > share
    cut = groups.where(large & (F.col("n") > F.col("per"))).select("group", "per")
    whole = facts.join(F.broadcast(cut.select("group")), "group", "left_anti").withColumn("piece", F.lit(0).cast("long"))
    within = numbered(facts.join(F.broadcast(cut), "group"), ["group", "row"], "at", "cut-groups")
    starts = within.groupBy("group").agg(F.min("at").alias("start"))
    parts = (
        within.join(F.broadcast(starts), "group")
        .withColumn("piece", F.floor((F.col("at") - F.col("start")) / F.col("per")))
        .select(*whole.columns)
    )
    last = F.when(large, F.ceil(F.col("n") / F.col("per")) - 1).otherwise(F.lit(0)).cast("long")
    pieces = groups.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    count = F.when(large, F.least(F.col("per"), F.col("n") - F.col("piece") * F.col("per"))).otherwise(F.col("n"))
    return whole.unionByName(parts), pieces.select("group", "piece", (count * F.col("each")).alias("bytes"))


def ranked(pieces: DataFrame) -> DataFrame:
    """Pieces by class, largest first, with their rank within the class."""
    classed = pieces.withColumn("class", class_of(F.col("bytes"))).withColumn("down", -F.col("class"))
    return numbered(classed.select("group", "piece", "class", "down"), ["down", "group", "piece"], "at", "shard-order")


def shard_pieces(pieces: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """Pieces with ``shard``: as few shards of ``capacity`` bytes as best fit needs, or ``shards`` of equal size."""
    spark = pieces.sparkSession
    order = ranked(pieces)
    # One row per class of sizes: bounded by the range of sizes.
    counts = order.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start")).collect()
    classes = sorted(((r["class"], r["n"]) for r in counts), reverse=True)
    runs = pack(classes, capacity)[0] if capacity else tightest(classes, shards)
    start = {r["class"]: r["start"] for r in counts}
    rows = [(start[c] + first, start[c] + last, shard) for c, first, last, shard in runs]
    # Runs are disjoint ranges of places.  Cut into blocks, they meet places by an equal
    # join that compares each place with two runs on average.
    block = max(1, sum(n for _, n in classes) // len(rows))
    ends = [F.floor(F.col(c) / block) for c in ("first_at", "last_at")]
    plan = spark.createDataFrame(rows, RUNS).withColumn("block", F.explode(F.sequence(*ends)))
    held = (F.col("at") >= F.col("first_at")) & (F.col("at") <= F.col("last_at"))
    placed = order.withColumn("block", F.floor(F.col("at") / block)).join(plan, "block").where(held)
    return placed.select("group", "piece", "shard")


def shard_documents(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """One row per document: ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``."""
    facts = facts_of(docs)
    total = facts.agg(F.sum("size")).first()[0]
    if not total:
        return empty(docs.sparkSession, PLACED)
    share = capacity or -(-total // shards)
    facts, pieces = cut_groups(facts, share)
    placed = facts.join(shard_pieces(pieces, shards, capacity), ["group", "piece"])
    slots = numbered(
        placed.select("row", "doc_id", "size", "text_crc32", "shard"), ["shard", "row"], "at", "shard-slots"
    )
    starts = slots.groupBy("shard").agg(F.min("at").alias("start"))
    return slots.join(F.broadcast(starts) if capacity is None else starts, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("at") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
