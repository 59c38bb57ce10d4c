from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from scenarios import END, SCHEMA, SENSORS, START, drizzle, event, locked

from logdistill.config import Config
from logdistill.operators import clusters as C
from logdistill.operators.sampling import sample_events
from logdistill.plans.reduce import reduce_events

SCOPE = ("log_group",)


def run(spark, rows, cfg=Config()):
    return reduce_events(spark.createDataFrame(rows, SCHEMA), SCOPE, F.lit(END), cfg)


def test_one_cause_is_one_cluster(spark):
    r = run(spark, locked(333))
    stats, cluster = r.stats.first(), r.clusters.collect()
    assert len(cluster) == stats.clusters == 1 and stats.logical_events == 1
    assert (cluster[0].exception_type, cluster[0].event_count) == ("SegmentLockFailure", 333)
    assert {(e.endpoint, e.event_count) for e in r.endpoints.collect()} == {(f"/readings/{s}", 111) for s in SENSORS}
    assert [(s.status, s.event_count) for s in r.statuses.collect()] == [("507", 333)]
    assert stats.events_in_evidence == r.samples.count() == 3
    assert stats.compression_ratio == pytest.approx(3 / 333, abs=1e-4)


def test_few_late_failures_outrank_many_warnings(spark):
    r = run(spark, drizzle())
    best, second = r.clusters.orderBy("rank").collect()
    # The root of the chain names the cluster.
    assert (best.exception_type, best.event_count, best.has_5xx) == ("CarrierFault", 25, True)
    assert (second.exception_type, second.event_count, second.level) == ("RangeError", 170, "WARNING")
    assert r.summaries(1).first().top_endpoints == "/relays/<id>/state (25)"


def test_budget_and_blank_messages(spark):
    kinds = [event(START, f"ERROR {'Q' * i}Fault: gauge {'z' * i}") for i in range(1, 13)]
    long = event(END, "ERROR GateError: client_secret=tidepool99 " + "~" * 700)
    rows = [*kinds, long, event(START, "\u2003\n"), event(START, "  ")]
    r = run(spark, rows, Config(max_clusters=4, example_chars=64))
    stats = r.stats.first()
    blank = stats.events - stats.events_after_filtering
    assert (stats.events, stats.clusters, stats.clusters_after_budget) == (15, 15 - blank, 4)
    assert stats.truncated and blank >= 1
    shown = [s.message for s in r.samples.collect()]
    assert len(shown) == 4 and max(map(len, shown)) <= 64
    assert not any("tidepool" in (c.template or "") for c in r.all_clusters.collect())


def test_everything_is_ranked_without_a_budget(spark):
    rows = [event(START, f"ERROR K{'k' * i}Fault: n", group=f"/g{i % 3}") for i in range(40)]
    r = run(spark, rows, Config(max_clusters=None, evidence_clusters=5))
    by_group: dict = {}
    for c in r.clusters.collect():
        by_group.setdefault(c.log_group, []).append(c)
    for found in by_group.values():
        found.sort(key=lambda c: c["rank"])
        assert [c["rank"] for c in found] == list(range(1, len(found) + 1))
        assert [c.score for c in found] == sorted((c.score for c in found), reverse=True)
    assert sum(map(len, by_group.values())) == 40
    assert all(s.clusters_in_evidence == 5 for s in r.stats.collect())


ENRICHED = (
    "log_group string, log_stream string, ts timestamp, message string, fingerprint string,"
    " exception_type string, template string, endpoint string, level string, status_code int"
)


def enriched(i, fp, exc="TimeoutError", template="TimeoutError: db", endpoint=None, level="ERROR", status=None):
    return ("/g", "s", START + timedelta(seconds=i), f"raw {i}", fp, exc, template, endpoint, level, status)


def test_two_levels_of_grouping(spark):
    rows = (
        [enriched(i, "fp-a", endpoint="/checkout", level="WARNING" if i == 0 else "ERROR") for i in range(10)]
        + [enriched(i + 1, "fp-b", endpoint="/order", status=502) for i in range(5)]
        + [enriched(i, "fp-c", None, "no type") for i in range(2)]
        + [enriched(i, "fp-d", None, "no type") for i in range(2)]
    )
    sigs = C.signatures(spark.createDataFrame(rows, ENRICHED), SCOPE)
    found = {c.template: c for c in C.cluster_events(sigs, SCOPE).collect()}
    timeout, untyped = found["TimeoutError: db"], found["no type"]
    assert (timeout.event_count, timeout.cluster_id, timeout.level, timeout.has_5xx) == (15, "fp-a", "WARNING", True)
    assert timeout.first_seen.second == 0 and timeout.last_seen.second == 9
    assert (untyped.event_count, untyped.cluster_id, untyped.exception_type) == (4, "fp-d", None)
    assert C.logical_events(sigs, SCOPE).first().logical_events == 4
    ends = {(e.endpoint, e.event_count) for e in C.cluster_endpoints(sigs, SCOPE).collect()}
    assert ends == {("/checkout", 10), ("/order", 5)}
    assert [(s.status, s.event_count) for s in C.cluster_statuses(sigs, SCOPE).collect()] == [("502", 5)]


@pytest.mark.parametrize(
    ("level", "age", "status", "exc", "score"),
    [
        ("ERROR", 0, 502, "E", 0.3 + 0.2 + 0.16 + 0.2 + 0.1),
        (None, 300, None, None, 0.3 + 0.2 + 0.16),
        ("warn", 1800, 404, None, 0.3 + 0.1 + 0.08),
        ("FATAL", 7200, None, "E", 0.3 + 0.2 + 0.1),
        ("INFO", -60, None, None, 0.3 + 0.2 + 0.1),
    ],
)
def test_score(spark, level, age, status, exc, score):
    row = enriched(0, "f", exc, "t", None, level, status)
    sigs = C.signatures(spark.createDataFrame([row], ENRICHED), SCOPE)
    end = F.lit(START + timedelta(seconds=age))
    scored = C.score_clusters(C.cluster_events(sigs, SCOPE), SCOPE, end).first()
    assert scored.score == pytest.approx(round(score, 4))


def expected_positions(n, k):
    if n <= k:
        return list(range(n))
    if k == 1:
        return [n - 1]
    return sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_samples_against_sorting_everything(spark, k):
    rng = random.Random(k)
    rows = []
    for t, n in (("a", 1), ("b", 2), ("c", 4), ("d", 397)):
        rows += [enriched(rng.randint(0, 90_000), t, None, t) for _ in range(n)]
    # A burst: most of one cluster within a few seconds, many at the very same instant.
    rows += [enriched(50 + i % 3, "e", "BurstError", "e") for i in range(600)]
    rows += [enriched(50_000, "e", "BurstError", "e"), enriched(0, "e", "BurstError", "e")]
    df = spark.createDataFrame(
        [(*r[:3], f"{r[3]} {i}", *r[4:]) for i, r in enumerate(rows)], ENRICHED
    )
    sigs = C.signatures(df, SCOPE)
    found = C.cluster_events(sigs, SCOPE)
    tie = F.xxhash64(F.coalesce("log_stream", F.lit("")), "message")
    ordered: dict = {}
    for r in df.withColumn("tie", tie).orderBy("ts", "tie").collect():
        ordered.setdefault(r.template, []).append(r.message)
    got: dict = {}
    for r in sample_events(df, found, SCOPE, k).orderBy("template", "example_no").collect():
        got.setdefault(r.template, []).append(r.message)
    for t, messages in ordered.items():
        assert got[t] == [messages[p] for p in expected_positions(len(messages), k)], t


def test_results_do_not_depend_on_partitioning(spark):
    rows = locked(120) + drizzle()
    random.Random(9).shuffle(rows)
    seen = []
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        r = reduce_events(
            spark.createDataFrame(rows, SCHEMA).repartition(parts), SCOPE, F.lit(END), Config()
        )
        seen.append(
            (sorted(map(str, r.clusters.collect())), sorted(map(str, r.samples.collect())))
        )
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]
