"""Overlapping windows, traces of many ids, roll-ups and capped retrieval against brute force."""

from __future__ import annotations

import random
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from scenarios import SCHEMA, START, event

from logdistill.operators import idfilter as B
from logdistill.operators import intervals as V
from logdistill.operators import ops as O
from logdistill.operators import retrieve as R
from logdistill.operators import rollups as RU
from logdistill.operators import validate as VA
from logdistill.plans import incident as I
from logdistill.plans import reduce as P
from logdistill.sources import events as SE
from logdistill.sources import rawlog as RL
from logdistill.streaming import live

WINDOWS = "window_id string, log_group string, window_start timestamp, window_end timestamp"


def minutes(n):
    return START + timedelta(minutes=n)


def some_events(seed, n=300):
    draw = random.Random(seed)
    return [
        event(minutes(draw.randint(-5, 120)), f"ERROR GET /a/{draw.randint(1, 4)} Odd{draw.randint(1, 5)}Error: no {draw.randint(1, 9)}", group=draw.choice(("/app/x", "/app/y")))
        for _ in range(n)
    ]


def overlapping(seed, n=12):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        start = draw.randint(0, 90)
        rows.append((f"w{i}", draw.choice(("/app/x", "/app/y")), minutes(start), minutes(start + draw.choice((0, 1, 7, 30, 60)))))
    return rows + [rows[0], ("none", None, START, minutes(9)), ("open", "/app/x", None, minutes(9))]


@pytest.mark.parametrize("seed", [1, 2])
def test_sweep(spark, seed):
    rows = overlapping(seed)
    windows = spark.createDataFrame(rows, WINDOWS)
    intervals = V.sweep_windows(windows.where("window_start is not null"))
    utc = lambda t: t.replace(tzinfo=START.tzinfo)
    found = sorted((r[0], utc(r[1]), utc(r[2])) for r in intervals.where("log_group is not null").collect())
    want = []
    for group in ("/app/x", "/app/y"):
        own = [r for r in rows if r[1] == group and r[2] and r[2] < r[3]]
        cuts = sorted({t for r in own for t in r[2:4]})
        want += [(group, a, b) for a, b in zip(cuts, cuts[1:]) if any(r[2] <= a and b <= r[3] for r in own)]
    assert found == sorted(want)
    members = V.interval_members(intervals, windows.where("window_start is not null"), I.WINDOW_SCOPE)
    got = {(r.window_id, utc(r.interval_start)) for r in members.collect()}
    assert got == {(r[0], a) for r in rows if r[2] for g, a, b in want if g == r[1] and r[2] <= a and b <= r[3]}


def test_an_event_is_prepared_once_however_many_windows_hold_it(spark, monkeypatch):
    rows = some_events(3) + some_events(3)[:50]
    events = spark.createDataFrame(rows, SCHEMA)
    asked = overlapping(5)
    seen = []
    prepare = P.prepare
    monkeypatch.setattr(P, "prepare", lambda df, *more: seen.append(df.count()) or prepare(df, *more))
    report = I.analyze(events, spark.createDataFrame(asked, WINDOWS))
    got = {r.window_id: (r.events, r.clusters) for r in report.overview.where("status <> 'rejected'").collect()}
    held = {tuple(r): {w[0] for w in asked if w[2] and w[2] < w[3] and w[1] == r[0] and w[2] <= r[2] < w[3]} for r in rows}
    assert seen == [sum(1 for w in held.values() if w)] and sum(map(len, held.values())) > seen[0]
    counts = Counter(w for windows in held.values() for w in windows)
    assert {w: n for w, (n, _) in got.items() if n} == dict(counts)
    bins = report.timeline.groupBy("window_id").agg(F.sum("event_count").alias("n")).collect()
    every = Counter(w for r in rows for w in held[tuple(r)])
    assert {r.window_id: r.n for r in bins} == dict(every)
    samples = report.reduction.samples.select("window_id", "message").collect()
    assert {s.window_id for s in samples} == set(counts)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_traces_of_many_ids(spark, seed):
    """Ids of all lengths without a common beginning, in messages of all lengths."""
    draw = random.Random(seed)
    letters = "abcé-0"
    word = lambda n: "".join(draw.choice(letters) for _ in range(n))
    ids = [word(draw.choice((1, 2, 4, 5, 6, 9, 30))) for _ in range(60)] + [None, "", "a"]
    texts = [word(draw.choice((0, 1, 5, 40, 255, 256, 257, 900))) + draw.choice(ids[:60]) + word(draw.randint(0, 300)) for _ in range(60)]
    texts += ["", "a", "\x00a"]
    events = spark.createDataFrame([event(minutes(i), t) for i, t in enumerate(texts)], SCHEMA)
    wanted = spark.createDataFrame([(i,) for i in ids], "request_id string")
    got = R.trace_totals(events, wanted).collect()
    want = {i: sum(i in t for t in texts) for i in set(ids) if i}
    assert {r.request_id: r.total_events for r in got} == {i: n for i, n in want.items() if n}


def test_messages_without_a_hit_give_no_rows(spark):
    ids = spark.createDataFrame([(f"{i:08x}-{i * 7919:08x}",) for i in range(500)], "wanted_id string")
    probes = B.probes_of(ids)
    assert probes.count() == 500 and probes.select("probe").distinct().count() > 450
    bits = B.filter_bits(500)
    words = B.bloom_filter(probes, bits).first()["words"]
    assert len(words) == bits // 64 and 0 < sum(bin(w & (1 << 64) - 1).count("1") for w in words) <= 500 * B.HASHES
    texts = [(f"quiet line {i} " * 40,) for i in range(300)] + [("at 00000007-0000d889 it broke",)]
    hits = spark.createDataFrame(texts, "message string").withColumn("words", B.bloom_filter(probes, bits).scalar())
    rows = hits.select(F.explode(B.probe_hits(F.col("message"), F.col("words"), bits, [6]))).count()
    assert 1 <= rows <= 30


@pytest.mark.parametrize("gram", [B.GRAM, B.LONG_GRAM])
def test_numbers_in_messages_are_no_probes(spark, gram):
    """Ids of digits and letters are looked for by letters, as every message has numbers."""
    ids = [(f"{i * 2654435761 % 2**48:012x}",) for i in range(1, 400)]
    probes = [r.probe for r in B.probes_of(spark.createDataFrame(ids, "wanted_id string"), gram).collect()]
    assert all(any(p in i for i, in ids) and len(p) == gram for p in probes)
    assert sum(p.isdigit() for p in probes) < len(probes) / 20


def test_the_id_filter_is_no_column_of_the_events(spark):
    """A column would be copied into the row of every message, and it grows with the ids."""
    events = spark.createDataFrame([event(minutes(1), "at ab12 it broke")], SCHEMA)
    marked = R._mark_requests(events, spark.createDataFrame([("ab12",), ("zz",)], "request_id string"))
    text = marked._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in text and "__words" not in text
    assert [r.wanted_id for r in marked.collect()] == ["ab12"]


def test_traces_of_more_ids_than_short_runs_tell_apart(spark, monkeypatch):
    monkeypatch.setattr(B, "MANY", 30)
    test_traces_of_many_ids(spark, 4)


def signature_rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_rollup_answers_any_window(spark, tmp_path):
    """Windows inside an hour, over hours, on bounds and of no length; days written twice count once."""
    rows = some_events(7, 500) + some_events(7, 40)
    events = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "rollup")
    wanted = I.wanted_events(events)
    for _ in range(2):
        RU.update_rollup(wanted, path)
    spans = [(0, 120), (3, 119), (10, 20), (55, 65), (60, 60), (60, 120), (-9, 600), (61, 119)]
    asked = [(f"w{i}{g}", g, minutes(a) + timedelta(seconds=a % 7), minutes(b)) for i, (a, b) in enumerate(spans) for g in ("/app/x", "/app/y")]
    windows = spark.createDataFrame(asked, WINDOWS)
    r, timeline = I.report_from_rollup(events, windows, path)
    full = I.analyze(events, windows)
    assert signature_rows(r.signatures) == signature_rows(full.reduction.signatures)
    assert signature_rows(timeline) == signature_rows(full.timeline)
    assert signature_rows(r.samples) == signature_rows(full.reduction.samples)


@pytest.mark.parametrize("limit", [1, 7, 40, 1000])
def test_newest_of_slices(spark, limit):
    """As many rows of each slice as ranking all of them keeps, with many events at one instant."""
    rows = some_events(9, 250) + [event(minutes(30), f"ERROR x{i} failed", stream=str(i % 3)) for i in range(90)]
    windows = spark.createDataFrame([("a", "/app/x", minutes(0), minutes(60)), ("b", "/app/x", minutes(30), minutes(31)), ("c", "/app/y", minutes(0), minutes(120))], WINDOWS)
    matched = I.matching_events(spark.createDataFrame(rows, SCHEMA), windows)
    kept, facts = R.newest_of_slices(matched, I.WINDOW_SCOPE, limit=limit)
    ranked = R.slice_capped(matched, I.WINDOW_SCOPE, limit=limit)
    columns = ["window_id", "ts", "log_stream", "message"]
    assert sorted(map(tuple, kept.select(*columns).collect())) == sorted(map(tuple, ranked.select(*columns).collect()))
    told = R.slice_coverage(matched, I.WINDOW_SCOPE, limit=limit)
    some = ["window_id", "matched", "returned", "slices", "truncated", "covered_from"]
    assert sorted(map(tuple, facts.select(*some).collect())) == sorted(map(tuple, told.select(*some).collect()))


def test_capped_reports_say_from_when_on(spark):
    events = spark.createDataFrame(some_events(9, 250), SCHEMA)
    windows = spark.createDataFrame([("a", "/app/x", minutes(0), minutes(60)), ("q", "/app/z", minutes(0), minutes(60))], WINDOWS)
    report = I.analyze(events, windows, retrieval_limit=5)
    rows = {r.window_id: r for r in report.overview.collect()}
    assert rows["a"].truncated and rows["a"].covered_from and rows["a"].query_slices == 12 and rows["a"].events <= 60
    assert not rows["q"].truncated and rows["q"].query_slices == 1
    (doc,) = [r.evidence for r in report.evidence().collect()]
    assert "retrieval stopped at its limit" in doc
    assert "retrieval stopped" not in I.analyze(events, windows).evidence().first().evidence


def test_words_are_looked_up_by_their_rarest_run(spark):
    """Beginnings that all terms share pair nothing."""
    terms = spark.createDataFrame([("g", f"/api/v2/{i:05d}/x{i * 31 % 977}") for i in range(3000)] + [(None, "/api/only")], "log_group string, term string")
    named = [("g", f"/api/v2/{i:05d}") for i in range(0, 3000, 50)] + [("g", "/apx/99x99"), ("g", "api"), (None, "/only"), ("h", "/api/v2")]
    claims = spark.createDataFrame([(f"a{i}", g, [c]) for i, (g, c) in enumerate(named)], "analysis_id string, log_group string, affected_components array<string>")
    got = {(r.log_group, r.component): r.supported for r in VA.check_components(claims, terms, ("log_group",)).collect()}
    assert got == {(g, c): (g == "g" and c.startswith("/api/v2/")) or g is None for g, c in named}
    words = spark.createDataFrame(named, "log_group string, word string").where("length(word) > 3")
    probes = VA.word_probes(words, VA.term_pieces(terms, ("log_group",)), ("log_group",))
    assert probes.agg(F.sum("n_terms")).first()[0] < 60 * 40


@pytest.mark.parametrize("n", [0, 1, 2, 5000, 5001])
def test_overall_median(spark, n):
    import statistics

    draw = random.Random(n)
    values = [draw.choice((1.5, 1.5, draw.random() * 1e9, -draw.random())) for _ in range(n)]
    frame = spark.createDataFrame([(v,) for v in [*values, None, float("nan"), float("inf")]], "v double")
    got = O.overall_median(frame.repartition(3), F.col("v"))
    assert got == (statistics.median(values) if values else None)


def test_result_files_tell_what_they_could_not_read(spark, tmp_path):
    row = '[{"field":"@timestamp","value":"%s"},{"field":"@message","value":"%s"}]'
    lines = [
        '{"results":[%s,%s],"statistics":{"recordsMatched":9}}' % (row % ("2025-02-17 05:00:00.000", "ERROR a"), row % ("soon", "b")),
        '{"results":[' , "no json", '{"other":1}', '{"results":[]}',
    ]
    (tmp_path / "one.json").write_text("\n".join(lines))
    (tmp_path / "two.json").write_text('{"results":[%s]}' % (row % ("2025-02-17 06:00:00.000", "ok")))
    source = SE.read_result_files(spark, str(tmp_path), "/g")
    assert sorted(r.message for r in source.events.collect()) == ["ERROR a", "ok"]
    one, two = source.files.orderBy("file").collect()
    assert (one.documents, one.broken_documents, one.rows, one.rejected_rows, one.truncated) == (5, 3, 2, 1, True)
    assert (two.documents, two.broken_documents, two.rows, two.rejected_rows, two.truncated) == (1, 0, 1, 0, False)


def test_an_event_over_many_blocks_comes_in_parts(spark):
    """One event of 3,000 lines over five blocks, between two short ones."""
    lines = ["2025-02-17 05:00:00 ERROR first"] + ["2025-02-17 05:00:01 ERROR long"] + [f"  at frame {i}" for i in range(3000)] + ["2025-02-17 05:00:02 ERROR last"]
    rows = [("f", i // 700, i, 0, line) for i, line in enumerate(lines)]
    frame = spark.createDataFrame(rows, "file string, block long, row long, part int, line string").repartition(4)
    parts = RL.assemble_parts(frame, part_chars=500).collect()
    own = sorted((p.part_no, p.text) for p in parts if p.event_no == 2)
    assert [n for n, _ in own] == list(range(len(own))) and len(own) > 60
    assert "\n".join(t for _, t in own) == "\n".join(lines[1:-1]) and max(len(t) for _, t in own) < 530
    whole = {r.event_no: r.message for r in RL.assemble_events(frame).collect()}
    assert whole == {1: lines[0], 2: "\n".join(lines[1:-1]), 3: lines[-1]}
    heads = {r.event_no: (r.message, r.chars) for r in RL.fold_parts(RL.assemble_parts(frame, 500), 1200).collect()}
    assert heads[2] == (whole[2][:1200], len(whole[2])) and heads[3][0] == lines[-1]


def test_clusters_of_a_stream_equal_those_of_the_batch_job(spark, tmp_path):
    """Events in three deliveries, some twice; bins come when the watermark has passed them."""
    rows = some_events(11, 200)
    first = sorted(rows, key=lambda r: r[2])
    deliveries = [first[:80] + first[:20], first[80:] + first[70:90], [event(minutes(400), "ERROR end Odd9Error: end")], [event(minutes(401), "ERROR end Odd9Error: end")]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    found = []
    writer = live.stream_clusters(stream, ("log_group",), lambda c, n: found.extend(map(tuple, c.select(*columns).collect())), 60)
    columns = ["log_group", "window_start", "template", "event_count", "cluster_id", "level", "score", "rank"]
    for part in deliveries:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = writer.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    events = R.dedupe_events(spark.createDataFrame(rows, SCHEMA), ("log_group",))
    bins = F.window("ts", "60 minutes")
    framed = events.withColumns({"window_start": bins["start"], "window_end": bins["end"]})
    batch = P.reduce_events(framed, ("log_group", "window_start", "window_end"), F.col("window_end"), keep_events=False)
    assert sorted(found) == sorted(map(tuple, batch.clusters.select(*columns).collect())) and len(found) > 10
