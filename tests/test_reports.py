from __future__ import annotations

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from scenarios import END, SCHEMA, START, event, locked

from logdistill.config import Config
from logdistill.operators import evidence as EV
from logdistill.operators import ops as O
from logdistill.operators import validate as VA
from logdistill.operators.clusters import CLUSTER_KEY
from logdistill.operators.stats import volume_reduction
from logdistill.plans import incident as I
from logdistill.plans.reduce import reduce_events

WINDOWS = "window_id string, log_group string, window_start timestamp, window_end timestamp"
SCOPE = ("log_group",)


def test_analyze_and_search(spark):
    rows = [event(START + timedelta(minutes=i), f"ERROR Kind{chr(97 + i)}Error: no {chr(97 + i)}") for i in range(26)]
    rows += rows[:3] + [event(START, "INFO all fine"), event(END, "ERROR after the end")]
    windows = spark.createDataFrame(
        [("w", "/app/x", START, END), ("quiet", "/app/q", START, END)], WINDOWS
    )
    events = spark.createDataFrame(rows, SCHEMA)
    report = I.analyze(events, windows)
    over = {r.window_id: r for r in report.overview.collect()}
    assert (over["w"].events, over["w"].clusters, over["w"].status) == (26, 26, "unavailable")
    assert (over["quiet"].events, over["quiet"].severity, over["quiet"].status) == (0, "low", "ok")
    assert report.clusters.count() == 10
    # Copies collapse in the events but not in the volume.
    assert report.timeline.agg(F.sum("event_count")).first()[0] == 29
    found = I.search_errors(events, windows, text="KindzError")
    assert found.clusters.count() == 1 and found.overview.where("window_id='w'").first().status == "ok"
    assert I.search_errors(events, windows).clusters.count() == 26


SIDES = WINDOWS + ", side string"


def test_compare(spark):
    def burst(kind, n, at, path="/a"):
        return [event(at + timedelta(seconds=i), f"ERROR GET {path} {kind}Error: bad") for i in range(n)]

    later = START + timedelta(minutes=30)
    rows = (
        burst("Up", 10, START) + burst("Up", 100, later) + burst("Down", 9, START) + burst("Down", 4, later)
        + burst("Same", 4, START) + burst("Same", 8, later) + burst("Gone", 2, START) + burst("Fresh", 3, later, "/n")
        + [event(START, "ERROR untyped")] + [event(later, "ERROR untyped")] * 3
    )
    windows = spark.createDataFrame(
        [("b", "/app/x", START, later, "baseline"), ("c", "/app/x", later, later + timedelta(minutes=30), "comparison")],
        SIDES,
    )
    found = I.compare_windows(spark.createDataFrame(rows, SCHEMA), windows)
    got = {(d.exception_type, d.change, d.baseline_count, d.comparison_count, d.ratio) for d in found.deltas.collect()}
    assert got == {
        ("UpError", "increased", 10, 100, 10.0), ("DownError", "decreased", 9, 4, 0.44),
        ("GoneError", "disappeared", 2, 0, None), ("FreshError", "new", 0, 3, None),
        (None, "increased", 1, 3, 3.0),
    }
    assert [(e.exception_type, e.endpoint) for e in found.new_endpoints.collect()] == [("FreshError", "/n")]
    totals = {(p.side, p.total_events) for p in found.profiles.collect()}
    assert totals == {("baseline", 26), ("comparison", 118)}
    text = found.evidence().first().evidence
    doc = json.loads(text)
    assert [d["exception_type"] for d in doc["deltas"]["new_clusters"]] == ["FreshError"]
    assert len(doc["deltas"]["changed_clusters"]) == 3
    short = I.compare_windows(spark.createDataFrame(rows, SCHEMA), windows, cfg=Config(evidence_chars=100))
    assert short.evidence().first().evidence == text[:100]


def shrink(doc: dict, budget: int, whole: int):
    """The shrinking rule, step by step on the full document."""

    def dump(d):
        return json.dumps(d, separators=(",", ":"), ensure_ascii=False)

    kept, text = whole, dump(doc)
    clusters = doc["clusters"]
    while len(text) > budget and kept > 1:
        kept -= 1
        doc["clusters"] = clusters[:kept]
        doc["truncated_for_budget"] = True
        text = dump(doc)
    while len(text) > budget and any(c["examples"] for c in doc["clusters"]):
        for c in doc["clusters"]:
            c["examples"] = c["examples"][:-1]
        doc["truncated_for_budget"] = True
        text = dump(doc)
    return text[:budget], kept


@pytest.fixture(scope="module")
def busy(spark):
    rows = [
        event(
            START + timedelta(seconds=10 * i + j),
            f"ERROR GET /p{chr(97 + j)}\nTraceback (most recent call last):\n"
            f'  File "a.py", line {j}, in f\nKind{chr(97 + i)}Error: text {chr(97 + i) * 60}',
        )
        for i in range(6) for j in range(5)
    ]
    r = reduce_events(spark.createDataFrame(rows, SCHEMA), SCOPE, F.lit(END))
    return r


def test_evidence_shrinks_like_the_rule(spark, busy):
    timeline = spark.createDataFrame([("/app/x", START, 30)], "log_group string, bin_start timestamp, event_count bigint")

    def build(budget):
        cfg = Config(evidence_chars=budget)
        return EV.build_evidence(
            busy.clusters, busy.endpoints, busy.statuses, busy.samples, busy.stats, SCOPE, timeline,
            "pay", cfg,
        ).first()

    whole = build(40_000)
    full = json.loads(whole.evidence)
    assert whole.clusters_sent == 6 and whole.events_sent == 18 and full["service"] == "pay"
    assert full["clusters"][0]["affected_endpoints"] == {f"/p{c}": 1 for c in "abcde"}
    assert list(full["clusters"][0]["affected_endpoints"]) == [f"/p{c}" for c in "abcde"]
    assert full["full_window_volume_timeline"][0]["count"] == 30
    for budget in (len(whole.evidence) - 1, 2000, 900, 700, 560, 430, 100):
        text, kept = shrink(json.loads(whole.evidence), budget, 6)
        got = build(budget)
        assert (got.evidence, got.clusters_sent) == (text, kept), budget


def test_long_endpoint_lists_stay_exact(spark, busy):
    top = busy.clusters.where("rank = 1").first()
    many = spark.range(3000).select(
        "id", *[F.lit(top[c]).alias(c) for c in (*SCOPE, *CLUSTER_KEY)],
        F.concat(F.lit("/very/long/path/"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("endpoint"),
        F.lit(1).cast("bigint").alias("event_count"),
        F.timestamp_seconds(F.col("id")).alias("first_seen"),
    ).drop("id")
    doc = EV.build_evidence(
        busy.clusters, many, busy.statuses, busy.samples, busy.stats, SCOPE, cfg=Config(evidence_chars=5000)
    ).first()
    assert len(doc.evidence) == 5000 and doc.clusters_sent == 1
    assert doc.evidence.endswith(doc.evidence[-1]) and '"/very/long/path/000100":1' in doc.evidence


def analyses(spark, components, ids, confidence=1.7):
    row = (
        "a1", "/app/x", "s", "high",
        [("cause one", confidence, [("st", ids)]), ("cause two", 0.5, [])], components,
    )
    return spark.createDataFrame(
        [row],
        "analysis_id string, log_group string, summary string, severity string,"
        f" root_causes {VA.ROOT_CAUSES}, affected_components array<string>",
    )


def test_validation(spark, busy):
    known = busy.clusters.orderBy("rank").first().cluster_id
    terms = EV.known_terms(busy.clusters, busy.endpoints, busy.samples, SCOPE, SCOPE)
    words = {t.term for t in terms.collect()}
    assert {"/pa", "kindaerror", "/app/x", "error"} <= words and "get" not in words
    given = analyses(
        spark, ["/PA", "kafka-broker-7", "the KINDA thing", "abc", "app/x"], [known, "ghost", known, "ghost"]
    )
    cleaned, warnings = VA.validate_analyses(given, busy.clusters, terms, SCOPE)
    row = cleaned.first()
    assert row.affected_components == ["/PA", "the KINDA thing"]
    assert [c.confidence for c in row.root_causes] == [1.0, 0.5]
    assert row.root_causes[0].evidence[0].cluster_ids == [known, known] and row.root_causes[1].evidence == []
    assert row.status == "degraded"
    kinds = sorted((w.kind, w.detail) for w in warnings.collect())
    assert kinds == [
        ("unknown cluster reference", "ghost in: st"),
        ("unsupported component", "abc"), ("unsupported component", "app/x"),
        ("unsupported component", "kafka-broker-7"), ("unverified root cause", "cause two"),
    ]
    assert VA.unknown_ids(given, busy.clusters, SCOPE).count() == 2


def test_component_words_against_trying_all(spark):
    terms = ["checkout-service", "/orders/<id>", "db", "a b", "pooltimeout", "straße"]
    components = ["checkout", "Orders/x", "service mesh", "outs", "time out", "a B", "db", "STRAS", "pool", "/"]

    def supported(component):
        low = component.lower()
        words = [w for w in low.replace("/", " /").split() if len(w) > 3]
        return low in terms or any(w in t for w in words for t in terms)

    tdf = spark.createDataFrame([("/app/x", t) for t in terms], "log_group string, term string")
    checked = VA.check_components(analyses(spark, components, []), tdf, SCOPE).collect()
    assert {c.component: c.supported for c in checked} == {c: supported(c) for c in components}


def test_scores_and_medians(spark):
    given = analyses(spark, ["/checkout"], []).withColumns(
        {"case_id": F.lit("c"), "summary": F.lit("PoolTimeout in the DATABASE")}
    )
    expected = spark.createDataFrame(
        [("c", "PoolTimeout", ["mongo", "database"], "/checkout", ["medium"])],
        "case_id string, primary_exception string, category_keywords array<string>,"
        " affected_endpoint string, severities array<string>",
    )
    assert O.score_analyses(given, expected).first().score == pytest.approx(0.9)
    values = [float(v) for v in (5, 1, 9, 9, 2, 7)]
    runs = [("odd", v) for v in values[:5]] + [("even", v) for v in values] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(runs, "m string, v double")
    got = {r.m: r.x for r in O.exact_median(df, ["m"], F.col("v"), "x").collect()}
    assert got == {"odd": 5.0, "even": 6.0, "one": 3.0}


def test_volume_reduction(spark, busy):
    events = spark.createDataFrame(locked(200), SCHEMA)
    report = spark.createDataFrame([("/app/x", "y" * 1000)], "log_group string, evidence string")
    row = volume_reduction(events, report, SCOPE).first()
    dump = "\n".join(f"[2025-02-17 05:00:00.000] {m}" for *_, m in locked(200))
    assert row.raw_chars == len(dump) and row.report_tokens == 250
    assert row.percent_saved == pytest.approx(round((1 - 1000 / len(dump)) * 100, 2))
