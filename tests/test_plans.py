"""What the physical plans must and must not hold, and the streaming passes."""

from __future__ import annotations

from datetime import timedelta

from conftest import SF
from pyspark.sql import functions as F
from scenarios import SCHEMA, START, event, locked

from logdistill.checks import registry as G
from logdistill.checks import views as V
from logdistill.operators import clusters as C
from logdistill.operators import common
from logdistill.operators.enrich import prepare
from logdistill.plans import incident as I
from logdistill.plans.reduce import reduce_events
from logdistill.streaming import live


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_events_are_folded_before_the_shuffle(spark):
    df = spark.read.parquet(f"{SF}/events.parquet").select(
        F.lit("/g").alias("log_group"), F.lit("s").alias("log_stream"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("message"),
    )
    text = plan(C.signatures(prepare(df), ("log_group",)))
    assert text.count("Exchange") == 1 and text.count("HashAggregate") == 2
    assert "SortAggregate" not in text
    assert text.index("Exchange") < text.rindex("HashAggregate")


def test_time_filter_and_columns_reach_the_scan(spark, tmp_path):
    from logdistill.operators.filters import contains_filters, level_filter, time_window

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    spark.createDataFrame(locked(10), SCHEMA).write.parquet(str(tmp_path / "e"))
    df = time_window(spark.read.parquet(str(tmp_path / "e")), "2025-02-17 05:00:00", "2025-02-17 06:00:00")
    text = plan(contains_filters(level_filter(df), text="boom").select("ts"))
    assert "GreaterThanOrEqual(ts" in text and "StringContains(message,boom)" in text
    assert "log_stream" not in text.split("ReadSchema")[1]


def test_few_scopes_do_not_gather_events_in_few_tasks(spark, monkeypatch):
    framed = []

    def seen(events, *args):
        framed.append(events)
        return reduce_events(events, *args)

    monkeypatch.setattr(I, "reduce_events", seen)
    rows = [("g", START, "ERROR a"), ("g", START + timedelta(seconds=9), "b"), (None, START, "c")]
    events = spark.createDataFrame(rows * 2, "log_group string, ts timestamp, message string")
    reduction, bounds = I.analyze_events(events.withColumn("log_stream", F.lit("s")))
    text = plan(framed[0])
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert {r.log_group: r.events for r in reduction.stats.collect()} == {"g": 4, None: 2}
    spans = {r.log_group: r.window_end - r.window_start for r in bounds.collect()}
    assert spans == {"g": timedelta(seconds=10), None: timedelta(seconds=1)}
    # Tables beyond the bound are joined without a broadcast, with the same rows.
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    assert {r.log_group: r.events for r in I.analyze_events(events.withColumn("log_stream", F.lit("s")))[0].stats.collect()} == {"g": 4, None: 2}
    assert "ResolvedHint" not in framed[1]._jdf.queryExecution().analyzed().toString()


def test_ranking_limits_each_task(spark):
    df = spark.createDataFrame([("g", "c", 1, 0.5, None, "t")], "log_group string, cluster_id string, event_count bigint, score double, exception_type string, template string")
    assert "WindowGroupLimit" in plan(C.rank_clusters(df, ("log_group",), 50))


def test_a_shared_folder_is_asked_for_on_clusters(spark, monkeypatch):
    class Context:
        master, applicationId = "yarn", "app"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    try:
        common.checkpoint_dir(Session())
        raise AssertionError("a cluster without a shared folder was accepted")
    except ValueError:
        pass
    Context.master = "local[2]"
    assert common.checkpoint_dir(Session()) == common.checkpoint_dir(Session())


def test_window_extent_reaches_the_scan(spark, tmp_path):
    from datetime import timedelta

    from logdistill.operators.windows import events_in_windows

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    path = str(tmp_path / "parts")
    spark.createDataFrame(locked(10), SCHEMA).write.partitionBy("log_group").parquet(path)
    windows = spark.createDataFrame(
        [("w", "/app/x", START, START + timedelta(hours=1))],
        "window_id string, log_group string, window_start timestamp, window_end timestamp",
    )
    text = plan(events_in_windows(spark.read.parquet(path), windows))
    assert "GreaterThanOrEqual(ts,2025-02-17" in text and "LessThan(ts,2025-02-17" in text
    assert "log_group" in text.split("PartitionFilters")[1].split("]")[0]


def test_cluster_counts_add_up(spark):
    r = G.reduced(spark, SF)
    kept = r.all_clusters.agg(F.sum("event_count")).first()[0]
    assert kept == G.errors(spark, SF).where("trim(message) <> ''").count()
    assert r.stats.agg(F.sum("events_after_filtering")).first()[0] == kept
    ends = r.endpoints.groupBy(*C.CLUSTER_KEY, "log_group").agg(F.sum("event_count").alias("e"))
    joined = common.null_safe_join(r.all_clusters, ends, ["log_group", *C.CLUSTER_KEY])
    assert joined.where("e > event_count").count() == 0


def test_streams(spark, tmp_path):
    rows = locked(60) + locked(60) + [event(START, "ERROR GET /a/1 XError: y")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))

    def drain(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option(
            "checkpointLocation", str(tmp_path / name)
        ).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    unique = live.dedupe_stream(stream, ("log_group",))
    seen = drain(prepare(unique), "enriched", "append")
    assert seen.count() == 61
    batch = prepare(spark.createDataFrame(rows, SCHEMA)).select("fingerprint").distinct()
    assert {r[0] for r in seen.select("fingerprint").distinct().collect()} == {r[0] for r in batch.collect()}
    bins = drain(live.stream_timeline(stream, ("log_group",)), "bins", "complete")
    assert bins.agg(F.sum("event_count")).first()[0] == 121


def test_log_view_is_built_once(spark):
    assert V.logs(spark, SF) is V.logs(spark, SF)
