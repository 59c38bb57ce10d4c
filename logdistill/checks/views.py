"""Derived test tables.  The same SQL text runs on Spark and on DuckDB."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logdistill.operators.common import stage

# Events of a harbour: gauges and relays on the water, a gate on land.  Every kind of text
# that the operators treat differently occurs; numbers come from the event's own columns.
LOGS_SQL = """
SELECT event_id, ts,
  CASE WHEN event_id % 10 < 5 THEN '/sea/north' WHEN event_id % 10 < 8 THEN '/sea/south' ELSE '/land/gate' END AS log_group,
  'unit-' || CAST((event_id + user_id) % 5 AS STRING) AS log_stream,
  CASE
    WHEN event_type = 'view' AND event_id % 40 = 3 THEN repeat(' ', 4)
    WHEN event_type = 'click' THEN 'DEBUG gauge ' || CAST(user_id AS STRING) || ' level ' || CAST(event_id % 700 AS STRING) || 'ms after the bell'
    WHEN event_type = 'view' THEN '{"msg":"tide table shown","level":"info","route":"/tables/' || CAST(user_id AS STRING) || '"}'
    WHEN event_type = 'signup' THEN 'INFO trip-' || CAST(event_id AS STRING) || ' POST /berths returned 201'
    WHEN event_type = 'purchase' THEN 'WARN trip-' || CAST(event_id AS STRING) || ' DELETE /berths/' || CAST(user_id % 90 AS STRING)
      || ' returned 409 BookingError: berth held, no error for the captain'
    WHEN (event_id + user_id) % 13 < 4 THEN
      'gate ' || CAST(event_id % 9 AS STRING) || ' ERROR PUT /gauges/' || CASE WHEN event_id % 3 = 0 THEN 'salt' ELSE 'level' END
      || ' status=507 trip-' || CAST(event_id AS STRING) || chr(10)
      || 'Traceback (most recent call last):' || chr(10)
      || '  File "/opt/gauge/sink.py", line ' || CAST(200 + event_id % 3 AS STRING) || ', in drain' || chr(10)
      || '  File "/opt/gauge/ring.py", line 31, in claim' || chr(10)
      || '    return self.slots[n]' || chr(10)
      || '  File "/opt/gauge/ring.py", line 9, in __getitem__' || chr(10)
      || 'RingFault: slot ' || CAST(event_id % 4 AS STRING) || ' is still being read'
    WHEN (event_id + user_id) % 13 < 6 THEN
      'CRITICAL ERROR relay trip-' || CAST(event_id AS STRING) || ' POST /relays/' || CAST(user_id AS STRING) || '/forward' || chr(10)
      || 'Traceback (most recent call last):' || chr(10)
      || '  File "/opt/relay/radio.py", line 64, in key_up' || chr(10)
      || 'CarrierTimeout: no echo in 40 s' || chr(10) || chr(10)
      || 'During handling of the above exception, another exception occurred:' || chr(10) || chr(10)
      || 'Traceback (most recent call last):' || chr(10)
      || '  File "/opt/relay/hop.py", line 18, in forward' || chr(10)
      || '  File "/opt/relay/hop.py", line 25, in next_station' || chr(10)
      || 'HopFailure: all stations silent (status: 521)'
    WHEN (event_id + user_id) % 13 < 8 THEN
      'ERROR GET /gauges/' || CAST(user_id AS STRING) || '/history?days=9 status: 504 TideTimeout: 172.20.' || CAST(event_id % 200 AS STRING)
      || '.9:7700 silent for ' || CAST(1000 + event_id % 500 AS STRING) || 'ms trip-' || CAST(event_id AS STRING)
    WHEN (event_id + user_id) % 13 < 10 THEN
      '{"severity":"error","correlation_id":"trip-' || CAST(event_id AS STRING) || '","app":"relays","uri":"/relays/' || CAST(user_id AS STRING)
      || '/log","status":"' || CASE WHEN event_id % 2 = 0 THEN '500' ELSE '423' END
      || '","msg":"QueueException: amqp://harbour:ebb' || CAST(event_id AS STRING) || '@mq.sea.example/q"}'
    WHEN (event_id + user_id) % 13 < 12 THEN
      'ERROR BadgeError: turned away skipper' || CAST(user_id AS STRING) || '@sea.example pwd=tide' || CAST(event_id AS STRING)
      || ' cookie: berth=' || CAST(event_id AS STRING) || chr(10) || 'status=403 trip-' || CAST(event_id AS STRING)
    ELSE
      'lamp error ' || CAST(event_id AS STRING) || ' code 530 since 2023-11-30T22:15:01Z on "' || CAST(event_id % 60 AS STRING)
      || '" ref 0x00c0ffee' || CAST(event_id % 8 AS STRING) || ' of 7c9e6679-7425-40de-944b-e07fc1f9' || CAST(1000 + event_id % 8000 AS STRING)
  END AS message
FROM events
"""

GROUPS = ("/sea/north", "/sea/south", "/land/gate")
ALLOWLIST = ["/sea/*", "/land/g?te", "/none"]

# One window per log group and day, and the two windows compare_windows works on.
_GROUP_ROWS = " UNION ALL ".join(f"SELECT '{g}' AS log_group" for g in GROUPS)
_SIDE_ROWS = " UNION ALL ".join(
    f"SELECT '{g}' AS log_group, '{side}' AS side" for g in GROUPS for side in ("baseline", "comparison")
)
DAYS_SQL = """
SELECT log_group || '#' || CAST(day AS STRING) AS window_id, log_group,
       day AS window_start, day + INTERVAL 1 DAY AS window_end
FROM (SELECT DISTINCT log_group, date_trunc('day', ts) AS day FROM logs) d
"""
HALF_DAYS_SQL = DAYS_SQL.replace("date_trunc('day', ts) AS day FROM logs", "half AS day FROM halves").replace(
    "FROM (SELECT", "FROM (WITH halves AS (SELECT log_group, date_trunc('day', ts) AS half FROM logs UNION ALL "
    "SELECT log_group, date_trunc('day', ts) + INTERVAL 12 HOURS FROM logs) SELECT"
)
# Windows of 29 hours and some minutes that begin and end within hours.
SHIFTED_SQL = DAYS_SQL.replace("day AS window_start", "day + INTERVAL 1050 SECONDS AS window_start").replace(
    "day + INTERVAL 1 DAY AS window_end", "day + INTERVAL 106890 SECONDS AS window_end"
)
# Bounds come from the data: its first and last day, and a day two weeks after the first.
FIRST = "(SELECT date_trunc('day', min(ts)) FROM logs)"
LAST = "(SELECT date_trunc('day', max(ts)) + INTERVAL 1 DAY FROM logs)"
MIDDLE = "(SELECT date_trunc('day', min(ts)) + INTERVAL 14 DAY FROM logs)"
SIDES_SQL = f"""
SELECT log_group || '#' || side AS window_id, log_group, side,
       CASE side WHEN 'baseline' THEN {FIRST} ELSE {MIDDLE} END AS window_start,
       CASE side WHEN 'baseline' THEN {MIDDLE} ELSE {LAST} END AS window_end
FROM ({_SIDE_ROWS}) g
"""
# The same two halves with the later one as the baseline.
BACKWARD_SQL = SIDES_SQL.replace("CASE side WHEN 'baseline'", "CASE side WHEN 'comparison'")
WHOLE_SQL = f"""
SELECT log_group || '#all' AS window_id, log_group, {FIRST} AS window_start, {LAST} AS window_end
FROM ({_GROUP_ROWS}) g
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_STAGED: dict[tuple[str, str], DataFrame] = {}


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log view with ``ts`` as a UTC timestamp.

    A log table would exist before any query runs, so the derived one is written once
    per session where a shared folder is configured.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STAGED:
        # Messages are much wider than the events they are made of.
        events = table(spark, sf_dir, "events").repartition("event_id")
        braces = LOGS_SQL.replace("{", "{{").replace("}", "}}")
        view = spark.sql(braces.replace("FROM events", "FROM {events}"), events=events)
        _STAGED[key] = stage(view.withColumn("ts", F.col("ts").cast("timestamp")), "logs")
    return _STAGED[key]


def end_of_data(spark: SparkSession, sf_dir: str) -> datetime:
    """The midnight after the last event."""
    return spark.sql(f"SELECT {LAST}".replace("FROM logs", "FROM {logs}"), logs=logs(spark, sf_dir)).first()[0]


def windows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A windows table; the day windows come from the days the log view covers."""
    if "FROM logs" in sql:
        return spark.sql(sql.replace("FROM logs", "FROM {logs}"), logs=logs(spark, sf_dir))
    return spark.sql(sql)
