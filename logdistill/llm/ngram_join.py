"""N-gram Jaccard join by chosen paths.

Texts become sets of word shingles; equal sets are one node.  Each set is embedded into
MinHash tokens, which two sets share with a probability equal to their similarity.  A run
splits all nodes on up to ``DEPTH`` tokens of its own and compares buckets pairwise: small
ones as lists, and those that are still large at the end in blocks, each block with each,
so no pair of a bucket is left out however many texts are alike.  Runs take different
tokens, so they are independent, and are repeated until a pair at the threshold is missed
by all with less than the allowed probability.  Candidate pairs are verified on the exact
sets.  In large buckets links are counted where they are verified and only a spanning
forest of them is passed on.

Cases: texts of 1 to 4 words have one shingle of all their words; texts without words
have no links and share a class with equal texts only, null counting as the empty text;
null ids never name a class unless no member has an id; repeated rows belong to the same class and each get their row; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logdistill.llm import shingles as S
from logdistill.llm.common import small_side, stage

WORDS = 5
SIMILARITY = 0.8
TOKENS = 64
# Levels of a run, one token each; buckets that are large after them are compared in blocks.
DEPTH = 3
SMALL = 12
# Members of a block, and shingles in all.
LEAST_BLOCK, MOST_BLOCK, BLOCK_ITEMS = 256, 1024, 4_000_000
RECALL = 0.9999
# Pairs below this share of equal tokens are far from the threshold: five deviations.
ESTIMATE = 0.55
SEED = 20240
PIECE = 2_000_000


def runs_for(recall: float = RECALL, similarity: float = SIMILARITY, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold, split ``depth`` times, is found with ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth))


def tokens_for(runs: int) -> int:
    """Tokens of a signature, so that every run has its own."""
    return max(TOKENS, runs * DEPTH)


def _signed(texts: pd.Series) -> list[str]:
    return ["" if t is None else t for t in texts]


def signatures(docs: DataFrame, words: int = WORDS, tokens: int = TOKENS) -> DataFrame:
    """(row, doc_id, n, node, sig): ``node`` names the shingle set, ``row`` the document row."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = _signed(batch["text"])
            for part in S.pieces(texts, PIECE):
                sets = S.shingle_sets(texts[part], words)
                sums = [S.mixed(s + np.uint64(7)).sum(dtype=np.uint64) for s in sets]
                node = S.mixed(np.array(sums, dtype=np.uint64) + np.array([len(s) for s in sets], np.uint64))
                for i, s in enumerate(sets):
                    if not len(s):
                        raw = texts[part][i].encode("utf-8", "surrogatepass")
                        node[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big")
                yield pd.DataFrame(
                    {
                        "row": batch["row"].to_numpy()[part],
                        "doc_id": batch["doc_id"].to_numpy()[part],
                        "n": [len(s) for s in sets],
                        "node": node.view(np.int64),
                        "sig": list(S.minhash(sets, tokens, SEED).view(np.int64)),
                    }
                )

    return docs.select(row_key().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        sign, "row long, doc_id string, n int, node long, sig array<long>"
    ).withColumn("doc_id", F.col("doc_id").cast("long"))


def row_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))


def shingle_rows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(row, items): the exact sets of some documents."""

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = _signed(batch["text"])
            for part in S.pieces(texts, PIECE):
                sets = S.shingle_sets(texts[part], words)
                yield pd.DataFrame(
                    {"row": batch["row"].to_numpy()[part], "items": [s.view(np.int64) for s in sets]}
                )

    return docs.mapInPandas(sets_of, "row long, items array<long>")


def _steps(runs: int, depth: int) -> np.ndarray:
    """[run, level]: the token a run takes at each level; no two runs share one."""
    return np.arange(runs * depth).reshape(runs, depth)


def buckets_of(nodes: DataFrame, runs: int, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a < b) of nodes that met in a small bucket, and the members
    (node, run, path, size) of buckets that are still large after all levels."""
    active = nodes.select(
        "node", "sig", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")
    ).select("node", "run", F.xxhash64("run", F.get("sig", F.col("run") * DEPTH)).alias("path"))
    found = []
    for level in range(DEPTH):
        active = stage(active, f"paths-{level}")
        buckets = active.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
        held = stage(active.join(buckets, "path"), f"buckets-{level}")
        few = held.where(F.col("size") <= small)
        # At most ``small`` members each, so the lists and their pairs are bounded.
        lists = few.groupBy("path").agg(F.array_sort(F.collect_set("node")).alias("ns"))
        tails = lists.select(F.posexplode("ns").alias("i", "a"), "ns")
        pairs = tails.select(
            "a", F.explode(F.slice("ns", F.col("i") + 2, F.size("ns"))).alias("b")
        )
        found.append(stage(pairs.distinct(), f"pairs-{level}"))
        many = held.where(F.col("size") > small)
        if level + 1 == DEPTH or many.isEmpty():
            break
        active = many.select("node", "run", "path").join(nodes.select("node", "sig"), "node").select(
            "node", "run", F.xxhash64("path", F.get("sig", F.col("run") * DEPTH + level + 1)).alias("path")
        )
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.distinct(), many


@dataclass(frozen=True)
class _Members:
    """The members of one block, or of two that meet; ``sig`` has one row per token."""

    node: np.ndarray
    n: np.ndarray
    block: np.ndarray
    sig: np.ndarray
    # [member, run]: whether the run holds the member in a large bucket.
    large: np.ndarray


def _unpacked(rows: pd.DataFrame, runs: int, tokens: int) -> _Members:
    node = np.concatenate(list(rows["nodes"]))
    large = np.zeros((len(node), runs), dtype=bool)
    large[np.repeat(np.arange(len(node)), np.concatenate(list(rows["n_runs"]))), np.concatenate(list(rows["runs"]))] = True
    return _Members(
        node=node, n=np.concatenate(list(rows["ns"])),
        block=np.repeat(rows["block"].to_numpy(), [len(x) for x in rows["nodes"]]),
        sig=np.ascontiguousarray(np.concatenate(list(rows["sigs"])).reshape(-1, tokens).T), large=large,
    )


def _near_pairs(
    m: _Members, i: int, j: int, run: int, runs: int, similarity: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of block ``i`` with block ``j`` that this run is the first to hold
    in a large bucket, and whose sizes and tokens are near enough."""
    tokens = len(m.sig)
    left, right = np.flatnonzero(m.block == i), np.flatnonzero(m.block == j)
    steps = _steps(runs, DEPTH)
    for at in range(0, len(left), 128):
        part = left[at : at + 128]
        equal = np.zeros((len(part), len(right)), dtype=np.int16)
        for t in range(tokens):
            equal += m.sig[t][part][:, None] == m.sig[t][right][None, :]
        fits = np.minimum(m.n[part][:, None], m.n[right]) >= np.maximum(m.n[part][:, None], m.n[right]) * similarity - 0.5
        good = (equal >= int(ESTIMATE * tokens)) & fits
        if i == j:
            good &= part[:, None] < right[None, :]
        x, y = np.nonzero(good)
        x, y = part[x], right[y]
        fresh = np.ones(len(x), dtype=bool)
        for r in range(run):
            fresh &= ~((m.sig[steps[r]][:, x] == m.sig[steps[r]][:, y]).all(axis=0) & m.large[x, r])
        yield x[fresh], y[fresh]


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs."""
    root = list(range(n))

    def top(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        s, t = top(x), top(y)
        if s != t:
            root[s] = t
            out.append((x, y))
    return out


def _dealt(members: DataFrame) -> DataFrame:
    """``members`` of buckets, each with its block and the number of blocks of its bucket."""
    sizes = stage(
        members.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")), "bucket-sizes"
    )
    wide = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.col("size") / 8))
    blocks = F.ceil(F.greatest(F.col("size") / wide, F.col("shingles") / BLOCK_ITEMS)).cast("int")
    return members.join(small_side(sizes), "path").select(
        *members.columns, blocks.alias("blocks"), F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int").alias("block")
    )


def _meetings(dealt: DataFrame, more: dict[str, Column]) -> DataFrame:
    """Blocks as single rows of arrays, each once for every block (i, j) it meets."""
    packed = dealt.groupBy("path", "run", "block", "blocks").agg(
        F.collect_list(F.struct(*[c for c in dealt.columns if c not in ("path", "run", "block", "blocks")])).alias("m")
    )
    sizes = F.transform("m.runs", F.size)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return packed.select(
        "path", "run", "block", F.col("m.node").alias("nodes"), F.col("m.n").alias("ns"),
        F.flatten("m.sig").alias("sigs"), sizes.alias("n_runs"), F.flatten("m.runs").alias("runs"),
        *[c.alias(name) for name, c in more.items()], other.alias("other"),
    ).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")


def block_links(
    many: DataFrame, nodes: DataFrame, marks: DataFrame, sets_of, runs: int, tokens: int, similarity: float,
) -> tuple[DataFrame, DataFrame]:
    """All links inside large buckets: (node, n_links) and spanning edges (a, b).

    Members are dealt into blocks, a block is one row of arrays, and every block meets
    every block of its bucket in a task of its own.  Tasks return counts and spanning edges,
    so rows grow with members and with meetings of blocks, not with links.  A pair counts in
    the first of its runs in a large bucket only.  The first pass names the nodes whose
    exact sets are needed, the second deals these anew and verifies.
    """
    keys = ["path", "i", "j"]
    # The low half of a token is compared: halves differ where tokens do, but for one in 2^32.
    half = F.transform("sig", lambda x: (x.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int"))
    signed = nodes.select("node", "n", half.alias("sig")).join(marks, "node")
    members = stage(many.select("node", "run", "path").join(signed, "node"), "block-members")

    def named(rows: pd.DataFrame) -> pd.DataFrame:
        i, j, run = (int(rows[c].iloc[0]) for c in ("i", "j", "run"))
        m = _unpacked(rows, runs, tokens)
        hit = np.zeros(len(m.node), dtype=bool)
        for x, y in _near_pairs(m, i, j, run, runs, similarity):
            hit[x] = True
            hit[y] = True
        needs = [m.node[hit & (m.block == b)] for b in sorted({i, j})]
        return pd.DataFrame(
            {"path": rows["path"].iloc[0], "run": run, "block": sorted({i, j}), "needs": needs}
        )

    needs = (
        _meetings(_dealt(members), {}).groupBy(*keys)
        .applyInPandas(named, "path long, run int, block int, needs array<long>")
        .groupBy("path", "run", "block")
        .agg(F.array_distinct(F.flatten(F.collect_list("needs"))).alias("needs"))
    )
    needed = stage(needs.select("path", "run", F.explode("needs").alias("node")), "block-needs")
    sets = sets_of(needed.select("node").distinct())

    def verified(rows: pd.DataFrame) -> pd.DataFrame:
        i, j, run = (int(rows[c].iloc[0]) for c in ("i", "j", "run"))
        m = _unpacked(rows, runs, tokens)
        _, flat = np.unique(np.concatenate(list(rows["items"])), return_inverse=True)
        ends = np.cumsum(m.n)
        own = [flat[e - n : e] for e, n in zip(ends, m.n, strict=True)]
        mark = np.zeros(int(flat.max()) + 1, dtype=bool)
        links, ones, twos = np.zeros(len(m.node), dtype=np.int64), [], []
        for x, y in _near_pairs(m, i, j, run, runs, similarity):
            for a in np.unique(x):
                mark[own[a]] = True
                for b in y[x == a]:
                    common = int(np.count_nonzero(mark[own[b]]))
                    if common / (len(own[a]) + len(own[b]) - common) >= similarity:
                        links[a] += 1
                        links[b] += 1
                        ones.append(a)
                        twos.append(b)
                mark[own[a]] = False
        forest = _spanning(np.array(ones, dtype=int), np.array(twos, dtype=int), len(m.node))
        linked = np.flatnonzero(links)
        # One row: the links of each member, and the edges.
        return pd.DataFrame(
            {
                "nodes": [m.node[linked]], "links": [links[linked]],
                "ones": [m.node[[x for x, _ in forest]]], "twos": [m.node[[y for _, y in forest]]],
            }
        )

    ready = needed.join(signed, "node").join(sets, "node")
    found = stage(
        _meetings(_dealt(ready), {"items": F.flatten("m.items")}).groupBy(*keys)
        .applyInPandas(verified, "nodes array<long>, links array<long>, ones array<long>, twos array<long>"),
        "block-links",
    )
    counts = found.select(F.inline(F.arrays_zip("nodes", "links"))).toDF("node", "n_links")
    return counts, found.select(F.inline(F.arrays_zip("ones", "twos"))).toDF("a", "b")


def links(
    docs: DataFrame, signed: DataFrame, similarity: float = SIMILARITY, words: int = WORDS,
    recall: float = RECALL,
) -> tuple[DataFrame, DataFrame]:
    """(node, n_links) of all linked nodes, and edges (a, b) that join what is linked."""
    runs = runs_for(recall, similarity)
    tokens = tokens_for(runs)
    nodes = stage(
        signed.where(F.col("n") > 0)
        .groupBy("node")
        .agg(F.first("sig").alias("sig"), F.min("row").alias("row"), F.max("n").alias("n")),
        "nodes",
    )

    def sets_of(some: DataFrame) -> DataFrame:
        wanted = stage(nodes.join(some, "node").select("node", "row"), "wanted")
        texts = docs.select(row_key().alias("row"), "text").join(
            small_side(wanted.select("row")), "row", "left_semi"
        )
        return stage(
            shingle_rows(texts, words).dropDuplicates(["row"]).join(small_side(wanted), "row").select("node", "items"),
            "sets",
        )

    pairs, many = buckets_of(nodes, runs)
    # The runs in which a node is in a large bucket.
    marks = stage(many.groupBy("node").agg(F.collect_set("run").alias("runs")), "large-runs")
    side = nodes.join(marks, "node", "left")
    right = side.select(F.col("node").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
    left = side.select(F.col("node").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"), F.coalesce("runs", F.array().cast("array<int>")).alias("runs"))
    same = F.zip_with("sa", "sb", lambda x, y: x == y)
    # Pairs that also met in a large bucket are counted there.
    both = F.exists("runs", lambda r: F.forall(F.slice(same, r * DEPTH + 1, DEPTH), lambda e: e))
    near = stage(
        pairs.join(left, "a")
        .join(right, "b")
        # Sets whose sizes differ too much cannot reach the threshold.
        .where(F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 0.5)
        .where(F.size(F.filter(same, lambda e: e)) >= int(ESTIMATE * tokens))
        .where(~both)
        .select("a", "b"),
        "near",
    )
    sets = sets_of(near.select(F.col("a").alias("node")).union(near.select("b")).distinct())
    common = F.size(F.array_intersect("ia", "ib"))
    value = common / (F.size("ia") + F.size("ib") - common)
    exact = stage(
        near.join(sets.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b")
        .select("a", "b", value.alias("similarity"))
        .where(F.col("similarity") >= similarity)
        .select("a", "b"),
        "links",
    )
    counts = exact.select(F.col("a").alias("node")).union(exact.select("b")).withColumn("n_links", F.lit(1).cast("long"))
    edges = exact
    if not marks.isEmpty():
        more, joined = block_links(many, nodes, marks, sets_of, runs, tokens, similarity)
        counts, edges = counts.unionByName(more), edges.unionByName(joined)
    return counts.groupBy("node").agg(F.sum("n_links").alias("n_links")), edges


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with an edge (a, b): root is the smallest of the component.

    Each round takes the smallest label next to a node and then the label of that label;
    labels and edges stay distributed, one number per round reaches the driver.
    """
    both = stage(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges"
    )
    labels = stage(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels-0"
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        hooked = labels.join(near, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root")
        )
        hooked = stage(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = stage(
            hooked.join(jump, "root", "left").select(
                "node", "old", F.least("root", F.coalesce("next", "root")).alias("root")
            ),
            "labels",
        )
        changed = after.where(F.col("root") != F.col("old")).limit(1).count()
        labels = after.select("node", "root")
        if not changed:
            return labels


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL
) -> DataFrame:
    """(row, doc_id, node, root, n_links) for every row of ``docs``."""
    signed = stage(signatures(docs, words, tokens_for(runs_for(recall, similarity))), "signed")
    degree, edges = links(docs, signed, similarity, words, recall)
    facts = components(edges).join(degree, "node")
    return (
        signed.select("row", "doc_id", "node")
        .join(facts, "node", "left")
        .select(
            "row", "doc_id", F.coalesce("root", "node").alias("root"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
    )


def classified(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """doc_id, class_id (smallest id of the class), n_links (other texts linked to this one)."""
    found = stage(near_duplicates(docs.select("doc_id", "text"), similarity, words), "classified")
    names = found.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return found.join(names, "root").select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """Keep the row with the smallest id of each class, whole; repeated rows once."""
    found = stage(near_duplicates(docs.select("doc_id", "text"), similarity, words), "classified")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))["row"]
    kept = stage(found.groupBy("root").agg(first.alias("__row")).select("__row").distinct(), "kept")
    # Rows that agree in id and text share a row key; only these need to be compared.
    twice = stage(
        found.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.col("row").alias("__row")),
        "repeated",
    )
    mine = docs.withColumn("__row", row_key()).join(small_side(kept), "__row", "left_semi")
    once = mine.join(small_side(twice), "__row", "left_anti")
    rest = mine.join(small_side(twice), "__row", "left_semi").dropDuplicates(["__row"])
    return once.unionByName(rest).drop("__row")
