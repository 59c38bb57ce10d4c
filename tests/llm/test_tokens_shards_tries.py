"""Token alignment, sharding and the prefix trie against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from logdistill.llm import alignment, prefix_trie, sharding


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- alignment


def aligned_brute(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{alignment.TOKENIZERS}/{alignment.BYTES_MODEL}")
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/{alignment.PIECES_MODEL}")
    sign = alignment.byte_of_sign()

    def spans(ids, spell):
        at, out = 0, []
        for i in ids:
            size = len(spell(i))
            out.append((at, at + size))
            at += size
        return out

    spell_a = lambda i: bytes(sign[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    facts, corpus = [], Counter()
    for doc_id, text in rows:
        ids_a, ids_b = [], []
        if text:
            raw = f" {text}".encode()
            ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
            if b"".join(map(spell_a, ids_a)) != raw or b"".join(map(spell_b, ids_b)) != raw:
                ids_a, ids_b = [], []
        at_a, at_b = spans(ids_a, spell_a), spans(ids_b, spell_b)
        links, groups, i, j = [], [], 0, 0
        for cut in sorted({e for _, e in at_a} & {e for _, e in at_b}):
            i2, j2 = (next(k for k in range(s, len(at)) if at[k][1] == cut) + 1 for s, at in ((i, at_a), (j, at_b)))
            groups.append(",".join(map(str, ids_a[i:i2])) + "|" + ",".join(map(str, ids_b[j:j2])))
            for x in range(i, i2):
                links += [(ids_a[x], ids_b[y]) for y in range(j, j2) if max(at_a[x][0], at_b[y][0]) < min(at_a[x][1], at_b[y][1])]
            i, j = i2, j2
        corpus.update(links)
        facts.append((doc_id, len(ids_a), len(ids_b), len(groups), links, sha(";".join(groups)) if groups else ""))
    best = Counter()
    for (_, y), n in corpus.items():
        best[y] = max(best[y], n)
    return sorted(
        (
            (i, na, nb, g, len(links), sum(corpus[p] == best[p[1]] for p in links), sum(corpus[p] for p in links), s)
            for i, na, nb, g, links, s in facts
        ),
        key=repr,
    )


def test_alignment(docs):
    got = alignment.alignment_report(docs.withColumn("row", F.lit(1)))
    assert sorted(map(tuple, got.collect()), key=repr) == aligned_brute([(r.doc_id, r.text) for r in docs.collect()])


def test_alignment_odd(spark, odd):
    rows = [
        (1, None), (2, ""), (None, "x"), (3, " "), (4, "a▁b c"), (5, "<|endoftext|> <s> <0x0A> </s>"),
        (6, "\x00\n\n  a  b 日本語 😀"), (6, "\x00\n\n  a  b 日本語 😀"), (7, "don't we'll  x's 12 a1 2b. c, d"),
        (8, " lead and trail "), (9, "é ́a b"), (10, "A" * 5_000), (11, "ß1 2½ ² x. Y! z? ok"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, alignment.alignment_report(frame).collect()), key=repr)
    assert got == aligned_brute(rows)
    assert [r for r in got if r[0] == 4] == [(4, 0, 0, 0, 0, 0, 0, "")]
    assert alignment.alignment_report(odd).count() == 8
    assert alignment.alignment_report(frame.where("false")).count() == 0


def test_alignment_chunks(docs, monkeypatch):
    """Small chunks, few pairs held and few segments kept give the same rows."""
    want = sorted(map(tuple, alignment.alignment_report(docs).collect()))
    for name, value in (("CHUNK", 5_000), ("HELD", 50)):
        monkeypatch.setattr(alignment, name, value)
    monkeypatch.setattr(alignment.Segments.__init__, "__defaults__", (1_000,))
    assert sorted(map(tuple, alignment.alignment_report(docs).collect())) == want
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 10, "", "c" * 50]})
    assert [c.num_rows for c in alignment.chunks_of(batch, 20)] == [4, 1]


def test_segments_give_the_tokens_of_the_whole(docs):
    sides = alignment.load_sides(alignment.TOKENIZERS)
    for text in [r.text for r in docs.limit(20).collect() if r.text]:
        for side in sides:
            whole, parts = side.encode([text])[0], side.encode(alignment.BORDER.split(text))
            assert whole == [i for ids in parts for i in ids]


# ---- sharding


def plain_best_fit(sizes, capacity):
    left, out = [], []
    for size in sorted(sizes, reverse=True):
        fit = [(r, i) for i, r in enumerate(left) if r >= size]
        at = min(fit)[1] if fit else len(left)
        if not fit:
            left.append(max(capacity, size))
        left[at] -= size
        out.append((size, at))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_best_fit_decreasing(seed):
    draw = random.Random(seed)
    sizes = [draw.choice((draw.randint(1, 12), draw.randint(1, 90), 30)) for _ in range(draw.randint(1, 400))]
    runs, shards = sharding.pack(sorted(Counter(sizes).items(), reverse=True), 100)
    want = plain_best_fit(sizes, 100)
    assert Counter((s, shard) for s, a, z, shard in runs for _ in range(a, z + 1)) == Counter(want)
    assert shards == len({at for _, at in want})


def shards_of(frame, rows):
    text = defaultdict(set)
    for r in frame.collect():
        text[r.doc_id].add((r.text or "").encode())
    size, slots, places = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        (raw,) = [t for t in text[r.doc_id] if zlib.crc32(t) == r.text_crc32]
        assert r.size == len(raw) + 1 and r.law == "bytes" and r.grown_shard is None
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        places[raw].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return size, places


def test_sharding(docs):
    rows = sharding.shard_documents(docs.withColumn("shard", F.lit("x"))).collect()
    size, places = shards_of(docs, rows)
    assert len(rows) == docs.count() and set(size) == set(range(8))
    assert all(len(p) == 1 for p in places.values())
    assert max(size.values()) < 1.01 * min(size.values())
    again = sharding.shard_documents(docs.repartition(3)).select("doc_id", "shard").collect()
    assert sorted(again) == sorted((r.doc_id, r.shard) for r in rows)


def test_sharding_odd(spark, odd):
    size, places = shards_of(odd, sharding.shard_documents(odd).collect())
    assert all(len(p) == 1 for p in places.values()) and max(size.values()) > 100_000
    assert sharding.shard_documents(odd.where("false")).count() == 0
    hot = [(1, "x" * 100)] * 30 + [(2, "y" * 7), (None, None), (3, ""), (3, "")] + [(9, "z" * 5)] * 5
    frame = spark.createDataFrame(hot, "doc_id long, text string")
    # The copies of one text exceed a share: they are cut, all others stay whole.
    size, places = shards_of(frame, sharding.shard_documents(frame, 3).collect())
    assert max(size.values()) - min(size.values()) <= 101
    assert all(len(p) == 1 for t, p in places.items() if len(t) < 100)
    size, _ = shards_of(frame, sharding.shard_documents(frame, None, capacity=500).collect())
    assert max(size.values()) <= 500 and len(size) == -(-(30 * 101 + 41) // 404)


# ---- prefix trie


def nodes_brute(rows):
    count = lambda text: len([w for w in text.translate({i: 32 for i in range(9, 14)}).split(" ") if w])
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, role, key, text))
    own = {c: [(r[2], r[4]) for r in sorted(t)] for c, t in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members, children, ends = defaultdict(set), defaultdict(set), defaultdict(list)
    for c, path in paths.items():
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
            if d:
                children[path[: d - 1]].add(path[:d])
    out = []
    for node in members:
        below = [v for v in members if v[: len(node)] == node]
        out.append(
            (
                min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]),
                len(children[node]), sum(not children[v] for v in below),
                sum((len(members[v]) - 1) * (count(v[-1][1]) if v else 0) for v in below),
                sha(",".join(map(str, sorted(ends[node])))),
            )
        )
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_turns", [7, 60, 100_000])
def test_trie(spark, shard_turns):
    frame = spark.read.parquet(f"{SF}/conversations.parquet")
    got = prefix_trie.prefix_nodes(frame, shard_turns).collect()
    assert sorted(map(tuple, got), key=repr) == nodes_brute(frame.select("conv_id", "turn", "role", "text").collect())


@pytest.mark.parametrize("seed,shard_turns", [(1, 9), (2, 25), (3, 4)])
def test_trie_of_shared_prefixes(spark, seed, shard_turns):
    """Few distinct turns: copies, prefixes of others, long runs across many shards."""
    draw = random.Random(seed)
    rows = [(c, t, draw.choice("ab"), draw.choice(("hi", "hi there", ""))) for c in range(90) for t in range(draw.choice((0, 1, 2, 2, 9)))]
    rows += [(c, t, "a", "hi") for c in range(100, 130) for t in range(30)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, prefix_trie.prefix_nodes(frame, shard_turns).collect()), key=repr)
    assert got == nodes_brute(rows)


def test_trie_odd(spark):
    rows = [
        (0, None, None, None, 1), (0, 1, "u", "a  b\tc", 2), (0, 1, "u", "a  b\tc", 2), (0, 1, "s", "z", 3), (7, 0, "u", "x", 4),
        (None, 0, "u", "lost", 5), (27, 3, "", "", 6), (41, 0, None, "w" * 70_000, 7), (43, 0, "u", "y", 8), (-3, 0, "u", "x", 9),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key int")
    got = sorted(map(tuple, prefix_trie.prefix_nodes(frame).collect()), key=repr)
    # The base of -3 is 0: the remainder takes the sign of the id.
    plain = [r[:4] for r in rows if r[0] is None or r[0] >= 0]
    assert len(got) >= len(nodes_brute(plain))
    positive = frame.where("conv_id >= 0 or conv_id is null")
    assert sorted(map(tuple, prefix_trie.prefix_nodes(positive).collect()), key=repr) == nodes_brute(plain)
    assert prefix_trie.prefix_nodes(frame.where("false")).count() == 0
    assert [len(r) for r in prefix_trie.prefix_nodes(frame.where("conv_id is null")).collect()] == []
