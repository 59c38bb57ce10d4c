from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from scenarios import END, SCHEMA, START, event

from logdistill.config import Config
from logdistill.operators import filters as FL
from logdistill.operators import retrieve as R
from logdistill.operators import windows as W

WINDOWS = "window_id string, log_group string, window_start timestamp, window_end timestamp"


def minutes(n):
    return START + timedelta(minutes=n)


def test_filters_are_literal(spark):
    rows = [event(START, m) for m in ("ERROR a.b", "error axb", "Error a.b", "fatal x", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert FL.level_filter(df).count() == 2
    assert FL.contains_filters(FL.level_filter(df), text="a.b").count() == 1
    assert FL.errors_only(df).count() == 4
    assert FL.allowed_only(df, []).count() == 0 and FL.allowed_only(df, ["/app/?"]).count() == 5


@pytest.mark.parametrize(
    ("span", "bin_minutes"), [(20, 1), (30, 2), (60, 5), (120, 5), (240, 10), (10_000, 120)]
)
def test_bins(spark, span, bin_minutes):
    picked = spark.range(1).select(R.pick_bin_minutes(F.lit(span))).first()[0]
    assert picked == bin_minutes


def test_window_join_against_trying_all(spark, monkeypatch):
    rng = random.Random(5)
    events = [
        event(START + timedelta(seconds=rng.randint(0, 40_000)), f"m{i}", rng.choice(["/a", "/a", "/b"]))
        for i in range(400)
    ]
    spans = [
        (f"w{i}", rng.choice(["/a", "/b", "/c"]), rng.randint(0, 40_000), rng.choice([1, 60, 4000, 20_000]))
        for i in range(60)
    ]
    windows = [(w, g, START + timedelta(seconds=s), START + timedelta(seconds=s + n)) for w, g, s, n in spans]
    windows.append(("backward", "/a", minutes(9), minutes(3)))
    want = sorted(
        (w, e[3]) for w, g, a, b in windows for e in events if e[0] == g and a <= e[2] < b
    )
    edf = spark.createDataFrame(events, SCHEMA)
    wdf = spark.createDataFrame(windows, WINDOWS)
    for limit in (W.BROADCAST_WINDOW_ROWS, 1):
        monkeypatch.setattr(W, "BROADCAST_WINDOW_ROWS", limit)
        joined = W.events_in_windows(edf, wdf)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (limit > 1) and "NestedLoop" not in plan
        assert sorted((r.window_id, r.message) for r in joined.collect()) == want


def test_window_checks(spark):
    rows = [
        ("ok", "/app/a", minutes(0), minutes(30), 7), ("none", "/app/a", None, minutes(1), 0),
        ("back", "/app/a", minutes(1), minutes(1), 9000), ("long", "/app/a", minutes(0), minutes(121), None),
        ("group", "/x", minutes(0), minutes(1), -1),
    ]
    df = spark.createDataFrame(rows, WINDOWS + ", requested_limit bigint")
    got = {r.window_id: (r.invalid_reason, r.row_limit) for r in W.check_windows(df, allowlist=["/app/*"]).collect()}
    assert got == {
        "ok": (None, 7), "none": ("missing bound", 5000), "back": ("end not after start", 5000),
        "long": ("longer than the maximum", 5000), "group": ("log group not allowed", 5000),
    }
    pieces = W.split_window(df.where("window_id = 'ok'").drop("requested_limit"), 7).orderBy("slice_no").collect()
    assert pieces[0].slice_start == pieces[0].window_start and pieces[-1].slice_end == pieces[0].window_end
    assert all(a.slice_end == b.slice_start for a, b in zip(pieces, pieces[1:]))


def test_trace_window(spark):
    times = spark.createDataFrame([(START, END), (None, END)], "hint timestamp, now timestamp")
    a, b = W.trace_window(F.col("hint"), F.col("now"))
    (s1, e1), (s2, e2) = [tuple(r) for r in times.select(a, b).collect()]
    naive = START.replace(tzinfo=None)
    assert (s1, e1) == (naive - timedelta(hours=1), naive + timedelta(hours=1))
    assert (e2 - s2, e2) == (timedelta(hours=2), END.replace(tzinfo=None))


def test_dense_window_is_sliced(spark):
    rows = [event(START + timedelta(seconds=4 * i), f"ERROR {i}") for i in range(450)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {"window_start": F.lit(START), "window_end": F.lit(END)}
    )
    scope = ("log_group", "window_start", "window_end")
    kept = R.slice_capped(df, scope, Config(), 100)
    assert {r.slices for r in kept.collect()} == {5} and kept.count() == 450
    cut = R.slice_coverage(df, scope, Config(max_slices=2), 100).first()
    assert (cut.matched, cut.returned, cut.truncated, cut.slices) == (450, 200, True, 2)
    assert R.coverage(df, ("log_group",), 450).first().covered_from is None
    newest = R.search_events(df, 3).collect()
    assert [r.message for r in newest] == ["ERROR 449", "ERROR 448", "ERROR 447"]


def test_dedupe_keeps_one_of_each(spark):
    rows = [event(START, "a"), event(START, "a"), event(START, "a", stream=None), event(START, "a", stream=None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert R.dedupe_events(df, ("log_group",)).count() == 2
    assert R.dedupe_events(df.withColumn("n", F.lit(1)), ("log_group",)).count() == 2


TRACED = [
    ("r-50", 3), ("r-500 and r-7", 1), ("nothing", 0), ('{"level":"warn","id":"r-7"} ', 2),
    ("xr-5 password=hunter2secret", 5), ("r", 4),
]


@pytest.mark.parametrize("as_table", [True, False])
def test_request_traces(spark, as_table):
    df = spark.createDataFrame([event(minutes(m), t) for t, m in TRACED], SCHEMA)
    ids = ["r-5", "r-50", "r-7", "gone", "r-500 and r-7 and more text than any message has"]
    wanted = spark.createDataFrame([(i,) for i in ids], "request_id string") if as_table else ids
    rows = R.trace_requests(df, wanted).orderBy("request_id", "seq").collect()
    got = [(r.request_id, r.ts.minute, r.level) for r in rows]
    assert got == [
        ("r-5", 1, ""), ("r-5", 3, ""), ("r-5", 5, ""), ("r-50", 1, ""), ("r-50", 3, ""),
        ("r-7", 1, ""), ("r-7", 2, "WARN"),
    ]
    assert all("hunter2" not in r.message for r in rows)
    cut = R.trace_requests(df, wanted, cfg=Config(trace_events=1))
    assert cut.count() == 3
    totals = R.trace_totals(df, wanted, cfg=Config(trace_events=2)).collect()
    assert sorted((t.request_id, t.total_events, t.truncated) for t in totals) == [
        ("r-5", 3, True), ("r-50", 2, False), ("r-7", 2, False),
    ]


def test_scopes_are_numbered_newest_first(spark):
    rows = [event(START + timedelta(seconds=(7 * i) % 31), f"m{i}", f"/g{i % 3 % 2}") for i in range(60)]
    found = R.search_events(spark.createDataFrame(rows, SCHEMA), None, ("log_group",)).collect()
    for group in ("/g0", "/g1"):
        mine = sorted((r for r in found if r.log_group == group), key=lambda r: r.row_no)
        assert [r.row_no for r in mine] == list(range(1, len(mine) + 1))
        assert [(r.ts, r.message) for r in mine] == sorted(
            ((r.ts, r.message) for r in mine), key=lambda x: (-x[0].timestamp(), x[1])
        )
    assert len(found) == 60


def test_traces_of_nothing_are_empty(spark):
    df = spark.createDataFrame([event(START, "ERROR a trip-1")], SCHEMA)
    for ids in ([], [""], spark.createDataFrame([], "request_id string")):
        assert R.trace_requests(df, ids).count() == R.trace_totals(df, ids).count() == 0
