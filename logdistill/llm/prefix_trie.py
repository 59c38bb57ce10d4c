"""Prefix trie of conversations by ternary search trees, one per range shard.

Turns are dictionary-encoded; a conversation is a sequence of turn ids.  Distinct
sequences are sorted into range shards, and each shard builds a ternary search tree by
inserting its sequences in median order, so that it is balanced.  An iterative traversal
accumulates members, leaves and savings.  Neighbouring shards share the common prefix of
the sequences at their border: these boundary nodes leave a shard as partial sums, and
are merged at the end; all other nodes are complete within their shard.

Texts are read once and never gathered: a conversation is one row of 16 bytes a turn, a
shard holds about ``SHARD_TURNS`` turns, and boundary nodes number at most two sequences
per shard.  Copies of a sequence travel as one row with a count.  Their ids are sorted and
streamed through the digest; as a digest is sequential, the ids of one sequence pass one
task, in bounded memory.

Cases: null role or text counts as empty; equal turns of a conversation go by role, then
by a digest of role and text; repeated rows are turns of their own; rows without a conv_id
belong to no conversation; a conversation without turns left is a member of the root; an
empty table has no nodes; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logdistill.llm.common import empty, numbered, small_side, stage
from logdistill.llm.mixing import size_of

SHARD_TURNS = 100_000
FAMILY = 20
HEADS = 4
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODES = (
    "key string, parent_key string, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def encoded_turns(conversations: DataFrame) -> DataFrame:
    """Turns with ``id``, a dense number of the distinct (role, text), and ``words``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    turns = stage(
        conversations.where(F.col("conv_id").isNotNull()).select(
            F.col("conv_id").cast("long"), F.col("turn"), role.alias("role"), key.alias("key"), size_of(text).alias("words")
        ),
        "turns",
    )
    known = numbered(turns.groupBy("key").agg(F.max("words").alias("words")), ["key"], "id", "turn-dictionary")
    return turns.drop("words").join(known, "key")


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """One row per conversation: ``ids`` and ``words`` of its turns, the first ones taken from the family's first.

    A family is dealt to one partition, so its conversations are gathered and given their
    first turns without a further shuffle.
    """
    first = F.col("conv_id") - F.col("conv_id") % F.lit(family)
    order = F.struct("turn", "role", "key", "id", "words")
    own = (
        turns.withColumn("family", first)
        .repartition("family")
        .groupBy("family", "conv_id")
        .agg(F.sort_array(F.collect_list(order)).alias("turns"))
        .withColumn("turns", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))))
    )
    head = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("turns", 1, heads - 1)))
    own = own.withColumn("head", head.over(Window.partitionBy("family")))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    none = F.slice("turns", 1, 0)
    taken = F.slice(F.coalesce("head", none), F.lit(1), h)
    whole = F.concat(taken, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0))))
    return own.select("conv_id", whole.alias("t")).select(
        "conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words")
    )


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Count, first id and digest of the sorted ids of every sequence, in one pass."""
    key, n, first, digest = None, 0, None, None

    def row():
        return (key, n, first, digest.hexdigest())

    for batch in batches:
        done = []
        for name, ids in batch.groupby("path_key", sort=False)["conv_id"]:
            if name != key:
                if n:
                    done.append(row())
                key, n, first, digest = name, 0, int(ids.iloc[0]), hashlib.sha256()
            digest.update(("," * (n > 0) + ",".join(map(str, ids.tolist()))).encode())
            n += len(ids)
        if done:
            yield pd.DataFrame(done, columns=["path_key", "n", "first_id", "ends"])
    if n:
        yield pd.DataFrame([row()], columns=["path_key", "n", "first_id", "ends"])


def distinct_paths(conversations: DataFrame) -> DataFrame:
    """Distinct sequences with ``n`` members that end there, the smallest, and the digest of all."""
    name = F.md5(F.array_join(F.col("ids").cast("array<string>"), ","))
    members = conversations.select("conv_id", name.alias("path_key"))
    ends = (
        members.repartition("path_key")
        .sortWithinPartitions("path_key", "conv_id")
        .mapInPandas(_digests, "path_key string, n long, first_id long, ends string")
    )
    return conversations.join(ends, F.col("conv_id") == F.col("first_id")).select("ids", "words", "n", "conv_id", "ends")


class TernaryTree:
    """Nodes in arrays; each stands for one prefix, node 0 for the empty one."""

    def __init__(self):
        self.symbol, self.words, self.depth, self.up = [-1], [0], [0], [-1]
        self.low, self.equal, self.high = [-1], [-1], [-1]
        self.n, self.conv, self.ends = [0], [None], [None]

    def _new(self, symbol: int, words: int, up: int) -> int:
        for column, value in (
            (self.symbol, symbol), (self.words, words), (self.depth, self.depth[up] + 1), (self.up, up),
            (self.low, -1), (self.equal, -1), (self.high, -1), (self.n, 0), (self.conv, None), (self.ends, None),
        ):
            column.append(value)
        return len(self.symbol) - 1

    def insert(self, ids: list[int], words: list[int], n: int, conv: int, ends: str) -> None:
        at = 0
        for symbol, size in zip(ids, words, strict=True):
            links, owner, node = self.equal, at, self.equal[at]
            while node >= 0 and self.symbol[node] != symbol:
                links = self.low if symbol < self.symbol[node] else self.high
                owner, node = node, links[node]
            if node < 0:
                node = self._new(symbol, size, at)
                links[owner] = node
            at = node
        self.n[at], self.conv[at], self.ends[at] = n, conv, ends

    def insert_sorted(self, paths: list[tuple]) -> None:
        """Median first, so that searches among the turns after a prefix stay short."""
        ranges = [(0, len(paths))]
        while ranges:
            start, stop = ranges.pop()
            if start < stop:
                middle = (start + stop) // 2
                self.insert(*paths[middle])
                ranges += [(start, middle), (middle + 1, stop)]

    def path_nodes(self, ids: list[int], length: int) -> list[int]:
        """The nodes of the first ``length`` turns of a sequence, the root first."""
        nodes = [0]
        for symbol in ids[:length]:
            node = self.equal[nodes[-1]]
            while self.symbol[node] != symbol:
                node = self.low[node] if symbol < self.symbol[node] else self.high[node]
            nodes.append(node)
        return nodes

    def order(self) -> list[int]:
        """All nodes, each after the node of its prefix."""
        found, stack = [], [0]
        while stack:
            node = stack.pop()
            found.append(node)
            stack += [x for x in (self.low[node], self.high[node], self.equal[node]) if x >= 0]
        return found


def common_length(a: list[int], b: list[int]) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _keys(tree: TernaryTree, nodes: list[int]) -> dict[int, str]:
    """Names of prefixes that are equal in all shards."""
    digest = hashlib.blake2b(digest_size=16)
    names = {}
    for node in nodes:
        if node:
            digest.update(tree.symbol[node].to_bytes(8, "big", signed=True))
        names[node] = digest.copy().hexdigest()
    return names


def shard_nodes(paths: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """All nodes of one shard, boundary nodes with their ``key`` and as partial sums."""
    rows = sorted(
        (list(map(int, r.ids)), list(map(int, r.words)), int(r.n), int(r.conv_id), r.ends)
        for r in paths.itertuples(index=False)
    )
    tree = TernaryTree()
    tree.insert_sorted(rows)
    before, after = edges["before"].iloc[0], edges["after"].iloc[0]
    keys: dict[int, str] = {}
    earlier: set[int] = set()
    if before is not None:
        first = rows[0][0]
        nodes = tree.path_nodes(first, common_length(first, list(map(int, before))))
        earlier = set(nodes)
        keys |= _keys(tree, nodes)
    if after is not None:
        last = rows[-1][0]
        keys |= _keys(tree, tree.path_nodes(last, common_length(last, list(map(int, after)))))

    order = tree.order()
    n, conv, size = list(tree.n), list(tree.conv), len(order)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for node in reversed(order):
        # A boundary node has further sequences in another shard, so it is no leaf; its
        # words and its place among its siblings count in the first shard that holds it.
        if not children[node] and node not in keys:
            leaves[node] = 1
        saved[node] += n[node] * tree.words[node] - tree.words[node] * (node not in earlier)
        up = tree.up[node]
        if up >= 0:
            n[up] += n[node]
            conv[up] = conv[node] if conv[up] is None else min(conv[up], conv[node])
            children[up] += node not in earlier
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    out = []
    for node in order:
        up = tree.up[node]
        shared = up in keys
        out.append(
            (
                keys.get(node), keys.get(up), conv[node], tree.depth[node], None if up < 0 or shared else conv[up],
                n[node], children[node], leaves[node], saved[node], tree.ends[node],
            )
        )
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])
    return frame.astype({"parent_conv_id": "Int64"})


def prefix_nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations."""
    spark = conversations.sparkSession
    paths = stage(rebuilt(encoded_turns(conversations)), "rebuilt")
    size = paths.agg(F.sum(F.size("ids") + 1).alias("n")).first()["n"]
    if not size:
        return empty(spark, NODES).select(*RESULT)
    ranged = stage(
        distinct_paths(paths)
        .repartitionByRange(max(1, -(-size // shard_turns)), "ids")
        .withColumn("shard", F.spark_partition_id()),
        "trie-shards",
    )
    # One row per shard.
    by_shard = Window.orderBy("shard")
    edges = (
        ranged.groupBy("shard")
        .agg(F.min("ids").alias("least"), F.max("ids").alias("most"))
        .select("shard", F.lag("most").over(by_shard).alias("before"), F.lead("least").over(by_shard).alias("after"))
    )
    nodes = stage(
        ranged.groupBy("shard").cogroup(edges.groupBy("shard")).applyInPandas(shard_nodes, NODES), "trie-nodes"
    )
    merged = (
        nodes.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(
            F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
            F.lit(None).cast("long").alias("parent_conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.max("ends_sha256").alias("ends_sha256"),
        )
    )
    merged = stage(merged, "boundary-nodes")
    names = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("named"))
    whole = nodes.where(F.col("key").isNull()).unionByName(merged)
    return (
        whole.join(small_side(names), "parent_key", "left")
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "named"))
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
        .select(*RESULT)
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS key
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key) AS p FROM t),
c AS (
  SELECT conv_id, xor(list_reduce(
    [4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT),
    lambda acc, x: list_reduce([xor(acc, x)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
      lambda a, i: xor(a // 2, CASE WHEN a % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))),
    4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o)),
b AS (
  SELECT c.conv_id, o.p, o.key, o.words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.p <= c.h
  UNION ALL SELECT c.conv_id, o.p, o.key, o.words FROM c JOIN o ON o.conv_id = c.conv_id AND o.p > c.h),
r AS (
  SELECT conv_id, words, row_number() OVER w AS depth, string_agg(key, ',') OVER w AS path FROM b
  WINDOW w AS (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT conv_id, arg_max(path, depth) AS path FROM r GROUP BY conv_id),
x AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM e GROUP BY path),
n AS (
  SELECT path, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs
  FROM r GROUP BY path),
-- Every node with each of its prefixes, itself too.
a AS (SELECT n.path AS node, r.path AS top, r.depth AS top_depth, n.depth, (n.n_convs - 1) * n.words AS own
  FROM n JOIN r ON r.conv_id = n.conv_id AND r.depth <= n.depth),
k AS (SELECT top AS path, count(*) AS n_children FROM a WHERE depth = top_depth + 1 GROUP BY top),
s AS (
  SELECT top AS path, sum(own) AS saved_tokens, count(*) FILTER (WHERE k.path IS NULL) AS n_leaves
  FROM a LEFT JOIN k ON k.path = a.node GROUP BY top),
u AS (SELECT a.node AS path, m.conv_id AS parent FROM a JOIN n m ON m.path = a.top WHERE a.depth = a.top_depth + 1)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, u.parent::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
  coalesce(k.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, coalesce(x.ends, sha256('')) AS ends_sha256
FROM n JOIN s USING (path) LEFT JOIN k USING (path) LEFT JOIN u USING (path) LEFT JOIN x USING (path)
"""
