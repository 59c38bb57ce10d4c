"""Align the tokens of two tokenizers by the bytes that they cover.

Texts are encoded by a byte-level tokenizer A and a piece tokenizer B, both over a blank
and the text.  Within an Arrow batch all steps are columnar: token lists are flattened
with their parents, ends are segmented cumulative sums of token lengths, a hash join of
both sides on (document, end) finds the offsets where tokens of both end, and grouped
counts give how often each pair of ids overlaps.  Spark merges the partial counts of all
batches and joins them back to the documents.

A text is encoded in segments: a single blank between a letter, digit or plain mark and a
letter or digit is a border for both tokenizers, so segments give the tokens of the whole
text.  Equal segments of a task are encoded once, and long texts need no memory beyond
their tokens.

Cases: null and empty texts, and texts that the tokens of either side do not spell, have
no tokens, so counts of 0 and an empty ``groups_sha256``; null ids and repeated rows are
rows of their own; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logdistill.llm.common import small_side, stage

TOKENIZERS = "/opt/tokenizers"
BYTES_MODEL = "byte_bpe_50k.json"
PIECES_MODEL = "piece_bpe_32k.model"
# Characters encoded together in a task; a longer text is a chunk of its own.
CHUNK = 1_000_000
# Distinct pairs that a task holds before it hands them on.
HELD = 1_000_000
# Characters of distinct segments that a task keeps encoded.
KNOWN = 4_000_000
# A pair of ids is one number: the id of A times this, plus the id of B.
WIDTH = 1 << 24
BORDER = re.compile(r"(?<=[0-9A-Za-z.,;:!?]) (?=[0-9A-Za-z])")

SCHEMA = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, links array<struct<pair:long,times:long>>"
)
LINKS = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))
ARROW = pa.schema(
    [(c, pa.int64()) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("links", LINKS)]
)


def byte_of_sign() -> dict[str, int]:
    """Bytes behind the signs of byte-level vocabularies: visible Latin-1 stands for itself."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of segments, bytes of ids, decimal ids with what follows them."""

    def __init__(self, encode, spelt: list[bytes], marks: list[bytes]):
        self.encode = encode
        self.spelt = pa.array(spelt, pa.large_binary())
        self.lengths = pa.array([len(s) for s in spelt], pa.int64())
        self.size = len(spelt)
        self.written = [b"%d%s" % (i, mark) for mark in marks for i in range(len(spelt))]
        self.forget()

    def forget(self) -> None:
        self.values, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, segments: list[str]) -> None:
        """Encode new segments and keep their ids behind those of earlier ones."""
        found = self.encode(segments)
        many = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(many.sum()))
        self.values = np.concatenate([self.values, ids])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(many)])

    def lists(self) -> pa.Array:
        return pa.LargeListArray.from_arrays(pa.array(self.offsets), pa.array(self.values))


class Segments:
    """Segments encoded so far by both sides, forgotten when they hold too many characters."""

    def __init__(self, sides: tuple[Side, Side], limit: int = KNOWN):
        self.sides, self.limit = sides, limit
        self.places: dict[str, int] = {}
        self.held = 0

    def places_of(self, segments: list[str]) -> np.ndarray:
        if self.held > self.limit:
            self.places, self.held = {}, 0
            for side in self.sides:
                side.forget()
        fresh = [s for s in segments if s not in self.places]
        for s in fresh:
            self.places[s] = len(self.places)
        self.held += sum(map(len, fresh))
        for side in self.sides:
            side.learn(fresh)
        return np.fromiter(map(self.places.__getitem__, segments), np.int64, len(segments))


def load_sides(folder: str) -> tuple[Side, Side]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{folder}/{BYTES_MODEL}")
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=f"{folder}/{PIECES_MODEL}")
    sign = byte_of_sign()
    spelt_a = [bytes(sign[c] for c in a.id_to_token(i)) for i in range(a.get_vocab_size())]

    def piece(i: int) -> bytes:
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()

    def encode_a(segments: list[str]) -> list[list[int]]:
        found = a.encode_batch_fast([f" {s}" for s in segments], add_special_tokens=False)
        return [e.ids for e in found]

    def encode_b(segments: list[str]) -> list[list[int]]:
        return b.encode(segments, num_threads=1)

    return (
        Side(encode_a, spelt_a, [b",", b"|"]),
        Side(encode_b, [piece(i) for i in range(b.get_piece_size())], [b",", b";", b""]),
    )


class Tokens:
    """The tokens of one side over a chunk: ids, documents, ends within documents."""

    def __init__(self, side: Side, places: pa.Array, parents: pa.Array, starts: pa.Array):
        taken = side.lists().take(places)
        self.ids = taken.flatten()
        self.doc = parents.take(pc.list_parent_indices(taken))
        self.lengths = side.lengths.take(self.ids)
        self.ends = pc.cumulative_sum(self.lengths)
        self.inner = pc.subtract(self.ends, starts.take(self.doc))
        self.n = len(self.ids)

    def table(self) -> pa.Table:
        return pa.table({"doc": self.doc, "end": self.inner, "at": pa.array(np.arange(self.n))})


def misspelt(side: Side, tokens: Tokens, raw: list[bytes]) -> set[int]:
    """Documents whose tokens do not spell the text."""
    spelt = side.spelt.take(tokens.ids)
    whole = b"".join(raw)
    size = pc.sum(tokens.lengths).as_py() or 0
    data = memoryview(spelt.buffers()[2]).cast("B")[:size] if size else memoryview(b"")
    if data == whole:
        return set()
    per_doc = np.bincount(tokens.doc.to_numpy(), weights=tokens.lengths.to_numpy(), minlength=len(raw)).astype(np.int64)
    stops = np.cumsum(per_doc)
    return {i for i, r in enumerate(raw) if data[stops[i] - per_doc[i] : stops[i]] != r}


def align(texts: list[str], known: Segments) -> dict[str, object]:
    """Facts of non-empty texts: counts, digests and a table (doc, pair, times).

    Texts that either side does not spell come back in ``bad``, with nothing else.
    """
    a_side, b_side = known.sides
    parts = pa.array([BORDER.split(t) for t in texts], pa.large_list(pa.large_string()))
    codes = parts.flatten().dictionary_encode()
    places = pa.array(known.places_of(codes.dictionary.to_pylist())).take(codes.indices)
    parents = pc.list_parent_indices(parts)
    raw = [b" " + t.encode() for t in texts]
    starts = pa.array(np.cumsum([0, *map(len, raw[:-1])]), pa.int64())
    a, b = (Tokens(side, places, parents, starts) for side in known.sides)
    bad = misspelt(a_side, a, raw) | misspelt(b_side, b, raw)
    if bad:
        return {"bad": bad}

    common = a.table().join(b.table(), ["doc", "end"], join_type="inner", right_suffix="_b")
    cut_a, cut_b = np.zeros(a.n, bool), np.zeros(b.n, bool)
    cut_a[common["at"].to_numpy()] = True
    cut_b[common["at_b"].to_numpy()] = True
    doc_a, doc_b = a.doc.to_numpy(), b.doc.to_numpy()
    n = len(texts)
    n_a, n_b = np.bincount(doc_a, minlength=n), np.bincount(doc_b, minlength=n)
    n_groups = np.bincount(doc_a[cut_a], minlength=n)

    # Between neighbouring ends of either side exactly one token of each overlaps: every A
    # token meets the B token that covers its last byte, and B tokens that end alone meet
    # the A token that covers theirs.
    ids_a, ids_b = a.ids.to_numpy().astype(np.int64), b.ids.to_numpy().astype(np.int64)
    ends_a, ends_b = a.ends.to_numpy(), b.ends.to_numpy()
    alone = np.flatnonzero(~cut_b)
    pair = np.concatenate(
        [
            ids_a * WIDTH + ids_b[np.searchsorted(ends_b, ends_a)],
            ids_a[np.searchsorted(ends_a, ends_b[alone])] * WIDTH + ids_b[alone],
        ]
    )
    links = pa.table({"doc": np.concatenate([doc_a, doc_b[alone]]), "pair": pair})
    counted = links.group_by(["doc", "pair"], use_threads=False).aggregate([("pair", "count")])
    counted = counted.rename_columns(["doc", "pair", "times"])

    # Written form of the groups: A ids, then B ids, group by group.
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    groups = int(n_groups.sum())
    many_a, many_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    until_a, until_b = np.cumsum(many_a), np.cumsum(many_b)
    last_b = np.zeros(b.n, bool)
    last_b[np.cumsum(n_b) - 1] = True
    form = np.empty(a.n + b.n, np.int64)
    form[np.arange(a.n) + (until_b - many_b)[group_a]] = ids_a + a_side.size * cut_a
    form[np.arange(b.n) + until_a[group_b]] = 2 * a_side.size + ids_b + b_side.size * (cut_b + last_b.astype(np.int64))
    table = pa.array(a_side.written + b_side.written, pa.large_binary())
    written = table.take(pa.array(form))
    offsets = np.frombuffer(written.buffers()[1], np.int64, len(written) + 1)
    data = memoryview(written.buffers()[2])
    stops = np.cumsum(n_a + n_b)
    spans = zip(offsets[stops - n_a - n_b], offsets[stops], strict=True)
    return {
        "bad": set(), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups,
        "digests": [hashlib.sha256(data[s:e]).hexdigest() for s, e in spans], "links": counted,
    }


def link_lists(counted: pa.Table, n: int) -> pa.Array:
    """One list of (pair, times) per document, in order of the documents."""
    ordered = counted.sort_by([("doc", "ascending"), ("pair", "ascending")]).combine_chunks()
    many = np.bincount(ordered["doc"].to_numpy(), minlength=n)
    offsets = pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32())
    fields = [ordered[c].combine_chunks().cast(pa.int64()) for c in ("pair", "times")]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["pair", "times"]))


def chunks_of(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about ``limit`` characters of text, one row at least."""
    sizes = pc.fill_null(pc.utf8_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def merge_counts(tables: list[pa.Table]) -> pa.Table:
    total = pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("times", "sum")])
    return total.rename_columns(["pair", "times"])


def count_rows(counts: pa.Table, piece: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Partial counts as rows without a row number, some thousand pairs each."""
    for at in range(0, counts.num_rows, piece):
        part = counts.slice(at, piece)
        whole = part.append_column("doc", pa.array(np.zeros(part.num_rows, np.int64)))
        nulls = [pa.nulls(1, f.type) for f in ARROW][:-1]
        yield pa.RecordBatch.from_arrays([*nulls, link_lists(whole, 1)], schema=ARROW)


def aligned_rows(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    known = Segments(load_sides(folder))
    held: list[pa.Table] = []
    for batch in batches:
        for chunk in chunks_of(batch, CHUNK):
            texts = chunk["text"].to_pylist()
            live = [i for i, t in enumerate(texts) if t]
            facts = align([texts[i] for i in live], known) if live else None
            if facts and facts["bad"]:
                live = [at for i, at in enumerate(live) if i not in facts["bad"]]
                facts = align([texts[i] for i in live], known) if live else None
            n = chunk.num_rows
            columns = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
            digests = np.full(n, "", object)
            counted = pa.table({c: pa.array([], pa.int64()) for c in ("doc", "pair", "times")})
            if facts:
                for name, column in columns.items():
                    column[live] = facts[name]
                digests[live] = facts["digests"]
                found = facts["links"]
                docs = pa.array(np.array(live)[found["doc"].to_numpy()], pa.int64())
                counted = pa.table({"doc": docs, "pair": found["pair"], "times": found["times"]})
                held.append(merge_counts([counted]))
                if sum(t.num_rows for t in held) > HELD:
                    held = [merge_counts(held)]
                    if held[0].num_rows > HELD // 2:
                        yield from count_rows(held.pop())
            yield pa.RecordBatch.from_arrays(
                [
                    chunk["row"], chunk["doc_id"], *map(pa.array, columns.values()),
                    pa.array(digests, pa.string()), link_lists(counted, n),
                ],
                schema=ARROW,
            )
    if held:
        yield from count_rows(merge_counts(held))


def aligned(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Staged facts: one row per document with its links by pair, and rows of partial counts.

    Rows of documents have a ``row`` number; rows without one hold counts of pairs over a
    part of the corpus, which sum up to the counts over all of it.
    """
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string")
    )
    return stage(numbered.mapInArrow(lambda batches: aligned_rows(batches, folder), SCHEMA), "aligned")


def pair_counts(facts: DataFrame) -> DataFrame:
    """Every pair of ids with its count of links in the corpus and whether it is the best of its B id."""
    counts = (
        facts.where(F.col("row").isNull())
        .select(F.explode("links").alias("l"))
        .groupBy(F.col("l.pair").alias("pair"))
        .agg(F.sum("l.times").alias("count"))
        .withColumn("b", F.pmod("pair", F.lit(WIDTH)))
    )
    counts = stage(counts, "pair-counts")
    # One row per id of B, so bounded by the vocabulary.
    highest = counts.groupBy("b").agg(F.max("count").alias("most"))
    return stage(
        counts.join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")),
        "best-pairs",
    )


def alignment_report(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """One row per document: tokens, groups, links, and how usual its links are in the corpus."""
    facts = aligned(docs, folder)
    counts = pair_counts(facts)
    documents = facts.where(F.col("row").isNotNull())
    times = F.col("l.times")
    sums = (
        documents.select("row", F.explode("links").alias("l"))
        .withColumn("pair", F.col("l.pair"))
        .join(small_side(counts), "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"),
            F.sum(times * F.col("count")).alias("count_sum"),
        )
    )
    zero = F.lit(0).cast("long")
    return documents.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256",
    )
