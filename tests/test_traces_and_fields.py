"""Stack traces, JSON fields, enrichment, fingerprints and times."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F
from scenarios import JOURNAL_TRACE, RELAY_TRACE, SCHEMA, START, event

from logdistill.functions import fields as X
from logdistill.functions.text import fingerprint
from logdistill.functions.traces import parse_trace
from logdistill.operators import enrich as E


def traces(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, m string").orderBy("i")
    return [r["t"] for r in df.select(parse_trace(F.col("m")).alias("t")).collect()]


def test_frames_of_both_kinds(spark):
    journal, relay = traces(spark, f"some words\n{JOURNAL_TRACE}", RELAY_TRACE)
    (only,) = journal
    assert (only["exception_type"], only["exception_message"]) == ("SegmentLockFailure", "day file is held by another writer")
    assert [(f["file"].rsplit("/")[-1], f["line"], f["function"]) for f in only["frames"]] == [
        ("uplink.py", 311, "flush"), ("journal.py", 77, "open_segment"), ("journal.py", 140, "_lock"),
    ]
    # The last raised exception stands first, the root cause last.
    assert [(t["exception_type"], len(t["frames"])) for t in relay] == [("RelayFailure", 1), ("CarrierFault", 1)]


@pytest.mark.parametrize(
    "text",
    [
        "",
        "ERROR SegmentLockFailure: no frames at all",
        JOURNAL_TRACE.replace("Traceback (most", "traceback (most"),
        JOURNAL_TRACE.replace("\n", "\n> ").replace("Traceback", "> Traceback"),
    ],
)
def test_no_trace(spark, text):
    assert traces(spark, text) == [None]


def test_loose_lines_inside_a_trace(spark):
    head = "Traceback (most recent call last):"
    text = "\n".join(
        [head, "EarlyFault: before any frame", '  File "tide.py", line 9', "MidFault", "note to self",
         '  File "moon.py", line 8, in pull', "LateFault: a: b"]
    )
    late, mid = traces(spark, text)[0]
    assert (late["exception_type"], late["exception_message"]) == ("LateFault", "a: b")
    assert (mid["exception_type"], mid["exception_message"], mid["frames"][0]["function"]) == ("MidFault", "", None)


def fields_of(spark, *objects):
    texts = [o if isinstance(o, str) else json.dumps(o) for o in objects]
    df = E.parse_json_message(spark.createDataFrame(list(enumerate(texts)), "i int, message string")).orderBy("i")
    return [
        tuple(r)
        for r in df.select(
            X.first_string("parsed_fields", ("severity", "level")),
            X.first_string("parsed_fields", ("trace", "trace_id")),
            X.json_endpoint("parsed_fields"), X.json_status("parsed_fields"),
        ).collect()
    ]


def test_json_fields(spark):
    got = fields_of(
        spark,
        {"severity": "", "level": "Notice", "trace": 12, "trace_id": "t-12"},
        {"path": "readings", "route": "/readings/7", "status": "0207"},
        {"status": 206.0, "statusCode": 507},
        {"status": False, "level": ["x"]},
        {"status": 600},
        '{"severity": "cut off"',
        '["severity"]',
        '{"severity":"x"} and more',
    )
    assert got[0] == ("Notice", "t-12", None, None)
    assert got[1] == (None, None, "/readings/7", 207)
    assert got[2] == (None, None, None, 507)
    assert got[3:] == [(None,) * 4] * 5


def test_redaction_of_parsed_fields(spark):
    text = json.dumps({"memo": "pwd=ebb12345", "n": 12, "inner": {"pwd": "pwd=flow6789"}})
    row = E.redact(E.parse_json_message(spark.createDataFrame([(text,)], "message string"))).select(
        F.to_json("parsed_fields").alias("kept"), "message"
    ).first()
    assert "ebb12345" not in row["kept"] + row["message"]
    assert "flow6789" in row["kept"] and '"n":12' in row["kept"]


def test_enrichment(spark):
    rows = [
        event(START, "FATAL PUT /readings/wave status=507 DiskFailure: 0 bytes"),
        event(START, json.dumps({"severity": "warning", "route": "/relays/31/on", "http_status": "409", "m": "Clash: x"})),
        event(START, "ERROR DELETE /readings/12\n" + RELAY_TRACE),
        event(START, "nothing to see"),
    ]
    got = {r.message[:6]: r for r in E.prepare(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got["FATAL "].endpoint, got["FATAL "].status_code, got["FATAL "].exception_type) == ("/readings/wave", 507, "DiskFailure")
    chained = got["ERROR "]
    assert (chained.endpoint, chained.exception_type) == ("/readings/<id>", "CarrierFault")
    assert chained.template == "CarrierFault: antenna below 9 dB"
    calm = got["nothin"]
    assert (calm.endpoint, calm.status_code, calm.exception_type) == (None, None, None)


def test_stated_fields_win_over_extracted_ones(spark):
    text = json.dumps({"level": "info", "service": "inside", "request_id": "r-in"})
    rows = [("/a", START, text, "warn", "outside", None), ("/a", START, text, None, "", "r-out")]
    df = spark.createDataFrame(
        rows, "log_group string, ts timestamp, message string, level string, service string, request_id string"
    )
    got = sorted((r.level, r.service, r.request_id) for r in E.extract_fields(df).collect())
    assert got == [("INFO", "inside", "r-out"), ("WARN", "outside", "r-in")]
    assert E.prepare(df).columns.count("level") == 1


def test_fingerprints_name_their_parts(spark):
    df = spark.createDataFrame([("tide", None, 31), ("tide", "31", None)], "x string, y string, z int")
    first, second = (r[0] for r in df.select(fingerprint(F.col("x"), F.col("y"), F.col("z"))).collect())
    assert first == hashlib.sha256(b"tide\n\n31").hexdigest()[:16] != second


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1987-06-05 04:03:02.1", datetime(1987, 6, 5, 4, 3, 2, 100_000, UTC)),
        ("1987-06-05T04:03:02-03:30", datetime(1987, 6, 5, 7, 33, 2, 0, UTC)),
        ("1987-06-05T04:03:02Z", datetime(1987, 6, 5, 4, 3, 2, 0, UTC)),
        ("1987-06-05", datetime(1987, 6, 5, tzinfo=UTC)),
        ("noon", None), ("1987", None), ("1987-06-31 00:00:00", None),
    ],
)
def test_times(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(F.unix_micros(X.parse_utc(F.col("t")))).first()[0]
    assert got == (None if want is None else int(want.timestamp() * 1_000_000))
