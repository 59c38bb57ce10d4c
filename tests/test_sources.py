from __future__ import annotations

import json
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from scenarios import JOURNAL_TRACE

from logdistill.functions import patterns as P
from logdistill.plans.incident import analyze_events
from logdistill.sources import events as SE
from logdistill.sources import rawlog as RL


def pair(name, value):
    return {"field": name, "value": value}


ROWS = [
    [pair("@timestamp", "2026-09-03 14:00:01.250"), pair("@message", '{"level":"error","request_id":"r1","service":"s"}'), pair("@logStream", "i-1")],
    [pair("@timestamp", "2026-09-03 14:00:02")],
    [pair("@timestamp", "soon"), pair("@message", "x")],
    [pair("@message", "no time")],
]


def test_result_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"results": ROWS}, indent=1))
    (tmp_path / "lines.jsonl").write_text(json.dumps({"results": ROWS[:1]}) + "\n" + json.dumps({"results": ROWS[1:]}))
    for name, multiline in (("one.json", True), ("lines.jsonl", False)):
        rows = SE.read_log_rows(spark, str(tmp_path / name), "/g", multiline).orderBy("ts").collect()
        assert [(r.message[:1], r.level, r.request_id, r.service, r.log_stream) for r in rows] == [
            ("{", "ERROR", "r1", "s", "i-1"), ("", None, None, None, None),
        ]
        assert rows[0].ts == datetime(2026, 9, 3, 14, 0, 1, 250_000)


def test_inventory_and_report(spark, tmp_path):
    groups = spark.createDataFrame(
        [("/z", 1, None), ("/app/b", None, 30), ("", 5, 5), (None, 5, 5), ("/app/a", 2, 7)],
        "name string, stored_bytes bigint, retention_days int",
    )
    out = SE.log_group_inventory(groups, ["/app/*"])
    assert [(r.name, r.allowed) for r in out.collect()] == [("/app/a", True), ("/app/b", True), ("/z", False)]
    assert SE.log_group_inventory(groups, []).where("allowed").count() == 0
    SE.write_report(out, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 3


def assemble(text: str):
    """What line assembly should give, one line after the other."""
    found, current = [], []
    for line in text.splitlines():
        if not line.strip():
            continue
        timed = re.search(P.RAW_ISO_TIME, line[:60]) or re.search(P.RAW_BRACKET_TIME, line[:60])
        follows = not timed and (re.match(P.RAW_CONTINUATION, line) or not re.search(P.RAW_LEVEL_WORD, line))
        if current and follows:
            current.append(line)
        else:
            if current:
                found.append("\n".join(current))
            current = [line]
    return [*found, "\n".join(current)] if current else found


def test_raw_files_across_splits(spark, tmp_path):
    lines = ["  leading continuation", "and more"]
    for i in range(120):
        stamp = f"2026-09-03 14:{i % 60:02d}:00,{i:03d}"
        lines.append(f"{stamp} ERROR job {i} failed")
        lines += JOURNAL_TRACE.split("\n") if i % 3 == 0 else []
        lines += [""] if i % 5 == 0 else ["plain text goes on", "INFO own event"]
    lines += ["[Sun Dec 04 06:01:30 2005] [error] late", "form\x0cfeed line", "x" * 3000, "tail"]
    text = "\n".join(lines) + "\n"
    (tmp_path / "a.log").write_text(text)
    (tmp_path / "b.log").write_bytes(b"\nINFO only\xff one\r\nnext\n")
    want = assemble(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        blocks = RL.read_lines(spark, str(tmp_path / "a.log")).select("block").distinct().count()
        rows = RL.read_raw_logs(spark, str(tmp_path)).orderBy("log_group", "event_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert blocks > 5
    a = [r for r in rows if r.log_group.endswith("a.log")]
    assert [r.message for r in a] == want
    assert [r.event_no for r in a] == list(range(1, len(want) + 1))
    assert a[0].ts == datetime(2000, 1, 1) and a[1].ts == datetime(2026, 9, 3, 14, 0)
    untimed = next(r for r in a if r.message == "INFO own event")
    assert untimed.ts == datetime(2000, 1, 1) + timedelta(seconds=untimed.event_no - 1)
    assert next(r for r in a if "late" in r.message).ts == datetime(2005, 12, 4, 6, 1, 30)
    b = [r for r in rows if r.log_group.endswith("b.log")]
    assert [r.message for r in b] == ["INFO only� one\nnext"]


def test_raw_times(spark):
    lines = [
        "2026-09-03T14:00:01.5 x", "2026-09-03 14:00:01.1234567 x", "2026-13-03 14:00:01 x",
        "[Foo Dec 04 06:01:30 2005] x", "[sun dec 4 06:01:30 2005] x", "x" * 55 + "2026-09-03 14:00:01",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(RL.line_time(F.col("t"))).collect()]
    assert got == [
        datetime(2026, 9, 3, 14, 0, 1, 500_000), None, None, None, datetime(2005, 12, 4, 6, 1, 30), None,
    ]


def test_offline_path(spark, tmp_path):
    (tmp_path / "app.log").write_text(f"2026-09-03 14:00:00 ERROR x\n{JOURNAL_TRACE}\n2026-09-03 14:05:00 INFO fine\n")
    reduction, windows = analyze_events(RL.read_raw_logs(spark, str(tmp_path / "app.log")))
    assert windows.first().window_end == datetime(2026, 9, 3, 14, 5, 1)
    assert {c.exception_type for c in reduction.clusters.collect()} == {"SegmentLockFailure", None}
