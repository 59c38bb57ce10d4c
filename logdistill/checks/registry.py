"""The registered queries and, next to each, the DuckDB statement that checks it.

Every query reads whole tables.  Compared outputs hold no maps or arrays; times are
epoch microseconds, counts BIGINT and scores whole ten-thousandths.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logdistill.checks import duck as Q
from logdistill.checks import views as V
from logdistill.config import Config, Rule
from logdistill.functions import patterns as P
from logdistill.functions import traces as T
from logdistill.functions.text import LINE_BREAK, normalize_text, redact_text
from logdistill.operators import clusters as C
from logdistill.operators import enrich as E
from logdistill.operators import evidence as EV
from logdistill.operators import filters as FL
from logdistill.operators import ops as O
from logdistill.operators import retrieve as R
from logdistill.operators import rollups as RU
from logdistill.operators import sampling as S
from logdistill.operators import stats as ST
from logdistill.operators import validate as VA
from logdistill.operators import windows as W
from logdistill.operators.common import new_path, stage
from logdistill.plans import incident as I
from logdistill.plans.reduce import reduce_events
from logdistill.sources import events as SE
from logdistill.sources import rawlog as RL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ALL_PII = Config(redact_phones=True, redact_ips=True)
GROUP = ("log_group",)
END = V.LAST


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def us(column: str | Column) -> Column:
    return F.unix_micros(column)


def scaled(column: str, factor: int = 10_000) -> Column:
    return F.round(F.col(column) * factor).cast("bigint")


def end_of_data(spark: SparkSession, sf_dir: str) -> Column:
    return F.lit(V.end_of_data(spark, sf_dir))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.level_filter(V.logs(spark, sf_dir))


def reduced(spark: SparkSession, sf_dir: str, keep_events: bool = False):
    """The error events of every log group, reduced up to the end of the month."""
    return reduce_events(
        errors(spark, sf_dir), GROUP, end_of_data(spark, sf_dir), Config(), keep_events=keep_events
    )


WITH_ENRICHED = "WITH " + Q.enriched()
WITH_CLUSTERS = WITH_ENRICHED + ", " + Q.clusters("log_group", END)
LOGS = "WITH " + Q.LOGS

# --- sources and fields --------------------------------------------------------


@query(
    "s1_log_rows",
    LOGS + """ SELECT log_group, epoch_us(date_trunc('millisecond', ts)) AS ts_us, message, log_stream
    FROM logs WHERE NOT contains(message, '/berths/')""",
)
def s1_log_rows(spark, sf_dir):
    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), value.alias("value"))

    bad = F.col("message").contains("/berths/")
    stamp = F.when(bad, F.lit("yesterday")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    )
    rows = V.logs(spark, sf_dir).select(
        "log_group",
        F.array(
            pair("@timestamp", stamp), pair("@message", F.lit("overwritten")),
            pair("@message", F.col("message")), pair("@logStream", F.col("log_stream")),
        ).alias("row"),
    )
    return SE.rows_to_events(rows).select("log_group", us("ts").alias("ts_us"), "message", "log_stream")


@query(
    "s1_read_log_rows",
    "WITH " + Q.enriched() + """, r AS (SELECT *, event_id // 40 % 10 = 7 AS broken, event_id % 11 = 3 AS untimed FROM enr),
    d AS (SELECT log_group, count(DISTINCT event_id // 40) AS documents,
        count(DISTINCT CASE WHEN broken THEN event_id // 40 END) AS broken_documents FROM r GROUP BY log_group)
    SELECT log_group, d.documents, d.broken_documents, count(*) FILTER (NOT broken AND untimed) AS rejected_rows,
      count(*) FILTER (NOT broken AND NOT untimed) AS events,
      count(DISTINCT CASE WHEN NOT broken AND NOT untimed AND NOT is_blank THEN fingerprint END) AS logical_events,
      count(*) FILTER (NOT broken AND untimed) > 0 AS truncated
    FROM r JOIN d USING (log_group) GROUP BY log_group, d.documents, d.broken_documents""",
)
def s1_read_log_rows(spark, sf_dir):
    """Events written as result documents, a tenth of them cut off, read back and reduced."""

    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), value.alias("value"))

    stamp = F.when(F.col("event_id") % 11 == 3, F.lit("soon")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    )
    document = F.floor(F.col("event_id") / 40)
    row = F.array(pair("@timestamp", stamp), pair("@message", F.col("message")), pair("@logStream", F.col("log_stream")))
    text = F.to_json(
        F.struct(
            F.collect_list(row).alias("results"),
            F.struct(F.count(F.lit(1)).cast("double").alias("recordsMatched")).alias("statistics"),
        )
    )
    written = V.logs(spark, sf_dir).groupBy("log_group", document.alias("document")).agg(text.alias("value"))
    cut = F.when(F.col("document") % 10 == 7, F.expr("substring(value, 1, length(value) - 9)")).otherwise(F.col("value"))
    path = new_path(spark, "results")
    written.select("log_group", cut.alias("value")).write.partitionBy("log_group").text(path)
    source = SE.read_result_files(spark, path)
    reduction, _ = I.analyze_events(source.events)
    told = source.files.groupBy("log_group").agg(
        *[F.sum(c).alias(c) for c in ("documents", "broken_documents", "rejected_rows")], F.max("truncated").alias("truncated")
    )
    return reduction.stats.select("log_group", "events", "logical_events").join(told, "log_group")


@query(
    "s2_from_table",
    """SELECT doc_id AS id, CAST(NULL AS VARCHAR) AS log_group, source AS log_stream, length(text) AS chars
    FROM documents WHERE n_chars IS NOT NULL""",
)
def s2_from_table(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").withColumn(
        "at", F.timestamp_seconds(F.col("n_chars"))
    )
    events = SE.from_table(docs, {"ts": "at", "message": "text", "log_stream": "source"})
    return events.select(
        F.col("doc_id").alias("id"), "log_group", "log_stream",
        F.length("message").cast("bigint").alias("chars"),
    )


@query(
    "s4_log_group_inventory",
    LOGS + """ SELECT log_group AS name, log_group LIKE '/sea/%' OR log_group LIKE '/land/g_te' AS allowed,
      CAST(sum(length(message)) AS BIGINT) AS stored_bytes,
      CASE WHEN log_group = '/sea/south' THEN NULL ELSE 30 END AS retention_days
    FROM (SELECT log_group, message FROM logs
          UNION ALL SELECT '/vendor/' || p_brand, p_name FROM part) x GROUP BY log_group""",
)
def s4_log_group_inventory(spark, sf_dir):
    parts = V.table(spark, sf_dir, "part").select(
        F.concat(F.lit("/vendor/"), "p_brand").alias("log_group"), F.col("p_name").alias("message")
    )
    sizes = (
        V.logs(spark, sf_dir).select("log_group", "message").unionByName(parts)
        .groupBy(F.col("log_group").alias("name"))
        .agg(F.sum(F.length("message")).alias("stored_bytes"))
        .withColumn("retention_days", F.when(F.col("name") != "/sea/south", F.lit(30)))
    )
    return SE.log_group_inventory(sizes, V.ALLOWLIST)


@query(
    "p1_parse_json_message",
    "WITH " + Q.LOGS + ", " + Q.FIELDS + """ SELECT event_id, j IS NOT NULL AS parsed,
      len(json_keys(j)) AS key_count FROM fields""",
)
def p1_parse_json_message(spark, sf_dir):
    fields = F.col("parsed_fields")
    return E.parse_json_message(V.logs(spark, sf_dir)).select(
        "event_id",
        fields.isNotNull().alias("parsed"),
        F.when(fields.isNotNull(), F.size(F.map_keys(fields))).cast("bigint").alias("key_count"),
    )


@query(
    "p2_first_string",
    "WITH " + Q.LOGS + ", " + Q.FIELDS
    + " SELECT event_id, jlevel AS level, request_id, trace_id, service FROM fields",
)
def p2_first_string(spark, sf_dir):
    return E.extract_fields(V.logs(spark, sf_dir)).select(
        "event_id", "level", "request_id", "trace_id", "service"
    )


def _enriched_column(name: str):
    @query(name, WITH_ENRICHED + f" SELECT event_id, {name.split('_', 1)[1]} FROM enr")
    def run(spark, sf_dir):
        return E.prepare(V.logs(spark, sf_dir)).select("event_id", name.split("_", 1)[1])

    return run


p3_endpoint = _enriched_column("p3_endpoint")
p4_status_code = _enriched_column("p4_status_code")
p5_level = _enriched_column("p5_level")
p6_exception_type = _enriched_column("p6_exception_type")


@query(
    "p7_enrich",
    WITH_ENRICHED + """ SELECT event_id, endpoint, status_code, level, exception_type, template,
      fingerprint FROM enr""",
)
def p7_enrich(spark, sf_dir):
    return E.prepare(V.logs(spark, sf_dir)).select(
        "event_id", "endpoint", "status_code", "level", "exception_type", "template", "fingerprint"
    )


@query(
    "p3_page_endpoints",
    f"""SELECT endpoint, count(*) AS pages FROM (
      SELECT {Q.endpoint_normalized("regexp_extract(url, '://[^/]+(/[^?#]*)', 1)")} AS endpoint FROM pages) x
    GROUP BY endpoint""",
)
def p3_page_endpoints(spark, sf_dir):
    from logdistill.functions.text import normalize_endpoint

    path = F.regexp_extract("url", "://[^/]+(/[^?#]*)", 1)
    pages = V.table(spark, sf_dir, "pages").select(normalize_endpoint(path).alias("endpoint"))
    return pages.groupBy("endpoint").agg(F.count(F.lit(1)).alias("pages"))


# --- filters --------------------------------------------------------------------


@query(
    "f1_level_filter",
    LOGS + """ SELECT log_group, count(*) AS n FROM logs
    WHERE contains(message, 'ERROR') OR contains(message, 'error') GROUP BY log_group""",
)
def f1_level_filter(spark, sf_dir):
    return errors(spark, sf_dir).groupBy("log_group").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f2_contains_filters",
    LOGS + """ SELECT event_id FROM logs WHERE contains(message, 'gauges') AND contains(message, 'TideTimeout')
      AND contains(message, '504') AND contains(message, 'trip-1')""",
)
def f2_contains_filters(spark, sf_dir):
    hits = FL.contains_filters(
        V.logs(spark, sf_dir), service="gauges", exception_type="TideTimeout", status_code=504,
        request_id="trip-1",
    )
    return hits.select("event_id")


@query(
    "f3_time_window",
    LOGS + """ SELECT event_id FROM logs
    WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-19 18:30:00'""",
)
def f3_time_window(spark, sf_dir):
    hits = FL.time_window(V.logs(spark, sf_dir), "2024-01-05 06:00:00", "2024-01-19 18:30:00")
    return hits.select("event_id")


@query("f4_drop_blank", LOGS + " SELECT event_id FROM logs WHERE trim(message) <> ''")
def f4_drop_blank(spark, sf_dir):
    return FL.drop_blank(V.logs(spark, sf_dir)).select("event_id")


@query(
    "f5_drop_bad_time",
    "SELECT event_id FROM events WHERE event_type <> 'signup' AND ts IS NOT NULL",
)
def f5_drop_bad_time(spark, sf_dir):
    stamped = V.logs(spark, sf_dir).join(
        V.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id"
    ).withColumn("ts", F.when(F.col("event_type") != "signup", F.col("ts")))
    return FL.drop_bad_time(stamped).select("event_id")


@query(
    "f6_errors_only",
    LOGS + """ SELECT event_id FROM logs
    WHERE regexp_matches(message, '(?i)error|critical|fatal|traceback')""",
)
def f6_errors_only(spark, sf_dir):
    return FL.errors_only(V.logs(spark, sf_dir)).select("event_id")


@query(
    "f7_allowed_only",
    LOGS + """ SELECT log_group, count(*) AS n FROM logs
    WHERE log_group LIKE '/sea/%' OR log_group = '/land/store' GROUP BY log_group""",
)
def f7_allowed_only(spark, sf_dir):
    kept = FL.allowed_only(V.logs(spark, sf_dir), ["/sea/*", "/land/[!g]*"])
    return kept.groupBy("log_group").agg(F.count(F.lit(1)).alias("n"))


# --- redaction, templates, traces ----------------------------------------------


@query("r1_redact", "WITH " + Q.LOGS + ", " + Q.FIELDS + ", " + Q.red_cte() + " SELECT event_id, message FROM red")
def r1_redact(spark, sf_dir):
    return E.redact(V.logs(spark, sf_dir)).select("event_id", "message")


@query(
    "r1_redact_documents",
    f"SELECT doc_id, {Q.redacted('text', ALL_PII)} AS text FROM documents",
)
def r1_redact_documents(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    return E.redact(docs, ("text",), ALL_PII).select("doc_id", "text")


@query(
    "r1_redact_parsed_fields",
    "WITH " + Q.LOGS + ", " + Q.FIELDS + f""" SELECT event_id,
      {Q.redacted("json_extract_string(j, '$.msg')")} AS msg, jstatus AS status FROM fields WHERE j IS NOT NULL""",
)
def r1_redact_parsed_fields(spark, sf_dir):
    parsed = E.redact(E.parse_json_message(V.logs(spark, sf_dir)))
    fields = F.col("parsed_fields")
    return parsed.where(fields.isNotNull()).select(
        "event_id", fields["msg"].cast("string").alias("msg"), fields["status"].cast("int").alias("status")
    )


def _report_sql(table: str, scope: str, text: str, cfg: Config) -> str:
    """Hits per rule: matches of each rule in the text left by the rules before it."""
    ctes, rows, prev = [], [], f"SELECT {scope}, {text} AS t FROM {table}"
    from logdistill.functions.text import active_rules

    rules = active_rules(cfg)
    for i, rule in enumerate(rules):
        src = f"({prev}) x" if i == 0 else f"t{i - 1}"
        if rule.name == "phone":
            hits = f"CAST((length({Q.phone_steps('t')}) - length(replace({Q.phone_steps('t')}, '[PHONE]', ''))) / 7 AS BIGINT) - CAST((length(t) - length(replace(t, '[PHONE]', ''))) / 7 AS BIGINT)"
            after = Q.phone_steps("t")
        else:
            hits = f"len(regexp_extract_all(t, {Q.lit(rule.pattern)}))"
            after = Q.sub("t", rule.pattern, Q.backrefs(rule.replacement))
        carried = "".join(f", h{k}" for k in range(i))
        ctes.append(f"t{i} AS (SELECT {scope}{carried}, {hits} AS h{i}, {after} AS t FROM {src})")
        rows.append(
            f"SELECT {scope}, '{rule.name}' AS rule, CAST(sum(h{i}) AS BIGINT) AS hits,"
            f" count(*) FILTER (h{i} > 0) AS rows_hit FROM t{len(rules) - 1} GROUP BY {scope}"
        )
    return ", ".join(ctes) + " " + " UNION ALL ".join(rows)


@query("r2_redaction_report", LOGS + ", " + _report_sql("logs", "log_group", "message", Config()))
def r2_redaction_report(spark, sf_dir):
    return E.redaction_report(V.logs(spark, sf_dir), GROUP)


@query("r2_redaction_report_documents", "WITH " + _report_sql("documents", "source", "text", ALL_PII))
def r2_redaction_report_documents(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    return E.redaction_report(docs, ("source",), "text", ALL_PII)


@query(
    "v1_extra_rules",
    LOGS + f""" SELECT event_id, {Q.redacted("message", Config(redact_emails=False))} AS plain,
      {Q.sub(Q.sub(Q.redacted("message", Config(redact_emails=False)), "user_id=[0-9]+", "user_id=[USER]"),
             P.EMAIL_RULE.pattern, P.EMAIL_RULE.replacement)} AS message FROM logs""",
)
def v1_extra_rules(spark, sf_dir):
    extra = Config(extra_rules=(Rule("user_id", "user_id=[0-9]+", "user_id=[USER]"),))
    message = F.col("message")
    return V.logs(spark, sf_dir).select(
        "event_id",
        redact_text(message, Config(redact_emails=False)).alias("plain"),
        redact_text(message, extra).alias("message"),
    )


@query("n1_normalize", LOGS + f" SELECT event_id, {Q.normalized('message')} AS template FROM logs")
def n1_normalize(spark, sf_dir):
    return E.normalize(V.logs(spark, sf_dir)).select("event_id", "template")


@query("n1_normalize_documents", f"SELECT doc_id, {Q.normalized('text')} AS template FROM documents")
def n1_normalize_documents(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    return docs.select("doc_id", normalize_text(F.col("text")).alias("template"))


@query(
    "n2_template_counts",
    WITH_ENRICHED + """, tc AS (SELECT log_group, template, count(*) AS event_count, min(ts) AS a, max(ts) AS b
      FROM enr GROUP BY log_group, template)
    SELECT log_group, template, event_count, epoch_us(a) AS first_us, epoch_us(b) AS last_us,
      CAST(round(event_count * 1000000.0 / sum(event_count) OVER (PARTITION BY log_group)) AS BIGINT) AS share_ppm
    FROM tc""",
)
def n2_template_counts(spark, sf_dir):
    counts = C.template_counts(E.prepare(V.logs(spark, sf_dir)), GROUP)
    return counts.select(
        "log_group", "template", "event_count", us("first_seen").alias("first_us"),
        us("last_seen").alias("last_us"), scaled("share", 1_000_000).alias("share_ppm"),
    )


@query(
    "n2_document_templates",
    f"""WITH t AS (SELECT source, {Q.normalized(Q.redacted("text"))} AS template FROM documents)
    SELECT source, template, count(*) AS documents FROM t GROUP BY source, template""",
)
def n2_document_templates(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(
        "source", F.col("text").alias("message")
    )
    mined = E.normalize(E.redact(docs))
    return mined.groupBy("source", "template").agg(F.count(F.lit(1)).alias("documents"))


@query("h1_fingerprint", WITH_ENRICHED + " SELECT event_id, fingerprint FROM enr")
def h1_fingerprint(spark, sf_dir):
    return E.prepare(V.logs(spark, sf_dir)).select("event_id", "fingerprint")


@query(
    "t1_explode_traces",
    "WITH " + ", ".join([Q.LOGS, Q.FIELDS, Q.red_cte(), Q.TRACES]) + """,
    exs AS (SELECT event_id, eno, et, em, count(*) OVER (PARTITION BY event_id) AS n
            FROM parts WHERE e = 1)
    SELECT p.event_id, tr.chain, CAST(x.n AS BIGINT) AS chain_length, CAST(x.n - 1 - p.eno AS BIGINT) AS exception_no,
      CAST(p.eno AS BIGINT) AS from_root, x.et AS exception_type, x.em AS exception_message,
      row_number() OVER (PARTITION BY p.event_id, p.eno ORDER BY p.i) - 1 AS frame_no,
      p.f AS file, CAST(p.ln AS BIGINT) AS line, nullif(p.fn, '') AS function
    FROM parts p JOIN tr ON p.event_id = tr.event_id
    JOIN exs x ON p.event_id = x.event_id AND p.eno = x.eno WHERE p.f <> ''""",
)
def t1_explode_traces(spark, sf_dir):
    frames = E.explode_traces(E.redact(V.logs(spark, sf_dir)), ("event_id",))
    numbers = ("chain_length", "exception_no", "from_root", "frame_no")
    return frames.withColumns({c: F.col(c).cast("bigint") for c in numbers})


@query(
    "t2_hot_frames",
    "WITH " + ", ".join([Q.LOGS, Q.FIELDS, Q.red_cte(), Q.TRACES]) + """
    SELECT log_group, f AS file, nullif(fn, '') AS function, count(*) AS hits
    FROM parts p JOIN tr ON p.event_id = tr.event_id JOIN logs l ON l.event_id = p.event_id
    WHERE f <> '' AND p.eno < tr.n GROUP BY ALL""",
)
def t2_hot_frames(spark, sf_dir):
    return E.hot_frames(E.redact(V.logs(spark, sf_dir)), GROUP)


@query(
    "t2_chain_counts",
    "WITH " + ", ".join([Q.LOGS, Q.FIELDS, Q.red_cte(), Q.TRACES]) + """
    SELECT log_group, chain, count(*) AS events FROM tr JOIN logs USING (event_id) GROUP BY ALL""",
)
def t2_chain_counts(spark, sf_dir):
    return E.chain_counts(E.redact(V.logs(spark, sf_dir)), GROUP)


@query(
    "v2_trace_parsers",
    "WITH " + ", ".join([Q.LOGS, Q.FIELDS, Q.red_cte(), Q.TRACES]) + """
    SELECT event_id, chain FROM tr UNION ALL
    SELECT event_id, 'job' AS chain FROM red WHERE message LIKE 'error job %'""",
)
def v2_trace_parsers(spark, sf_dir):
    # A second parser that reads the one-line job failures as one exception without frames.
    jobs = T.TraceParser(
        "jobs",
        lambda m: m.startswith("error job "),
        lambda m: F.array(
            F.struct(
                F.lit("job").alias("exception_type"), m.alias("exception_message"),
                F.array().cast(f"array<{T.FRAME_TYPE}>").alias("frames"),
            )
        ),
    )
    events = E.redact(V.logs(spark, sf_dir))
    found = E.explode_exceptions(events, ("event_id",), (T.PYTHON, jobs))
    return found.where(F.col("exception_no") == 0).select("event_id", "chain")


# --- clusters -------------------------------------------------------------------


@query(
    "a1_logical_event_count",
    WITH_ENRICHED + """ SELECT log_group, count(DISTINCT fingerprint) AS logical_events
    FROM enr WHERE is_error AND NOT is_blank GROUP BY log_group""",
)
def a1_logical_event_count(spark, sf_dir):
    return C.logical_events(reduced(spark, sf_dir).signatures, GROUP)


@query(
    "a1_approximate_logical_events",
    "WITH " + Q.enriched() + f""", w AS ({V.DAYS_SQL})
    SELECT window_id, count(DISTINCT fingerprint) AS logical_events, true AS near FROM enr JOIN w ON enr.log_group = w.log_group
      AND ts >= window_start AND ts < window_end WHERE is_error AND NOT is_blank GROUP BY window_id""",
)
def a1_approximate_logical_events(spark, sf_dir):
    """Sketches of hours united over days, next to the exact numbers, off by a twentieth at most."""
    hourly = E.prepare(errors(spark, sf_dir)).withColumn("hour", F.date_trunc("hour", "ts"))
    sigs = stage(C.signatures(hourly, ("log_group", "hour")), "hourly")
    days = V.windows(spark, sf_dir, V.DAYS_SQL)

    def by_day(table: DataFrame) -> DataFrame:
        return W.events_in_windows(table.withColumnRenamed("hour", "ts"), days)

    sketches = by_day(C.logical_sketches(sigs, ("log_group", "hour")))
    about = C.approximate_logical_events(sketches, ("window_id",)).withColumnRenamed("logical_events", "about")
    exact = C.logical_events(by_day(sigs), ("window_id",))
    gap = F.abs(F.col("about") - F.col("logical_events"))
    return exact.join(about, "window_id").select(
        "window_id", "logical_events", (gap <= F.greatest(F.lit(1.0), F.col("logical_events") / 20)).alias("near")
    )


@query(
    "a2_cluster_events",
    WITH_CLUSTERS + """ SELECT log_group, cluster_id, exception_type, template, event_count,
      epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us FROM scored""",
)
def a2_cluster_events(spark, sf_dir):
    found = C.cluster_events(reduced(spark, sf_dir).signatures, GROUP)
    return found.select(
        "log_group", "cluster_id", "exception_type", "template", "event_count",
        us("first_seen").alias("first_us"), us("last_seen").alias("last_us"),
    )


@query(
    "a3_affected_endpoints",
    WITH_ENRICHED + """ SELECT log_group, exception_type, template, endpoint, count(*) AS n
    FROM enr WHERE is_error AND NOT is_blank AND endpoint <> '' GROUP BY ALL""",
)
def a3_affected_endpoints(spark, sf_dir):
    ends = reduced(spark, sf_dir).endpoints
    return ends.select(*GROUP, *C.CLUSTER_KEY, "endpoint", F.col("event_count").alias("n"))


@query(
    "a4_status_codes",
    WITH_ENRICHED + """ SELECT log_group, exception_type, template, CAST(status_code AS VARCHAR) AS status,
      count(*) AS n FROM enr WHERE is_error AND NOT is_blank AND status_code IS NOT NULL GROUP BY ALL""",
)
def a4_status_codes(spark, sf_dir):
    codes = reduced(spark, sf_dir).statuses
    return codes.select(*GROUP, *C.CLUSTER_KEY, "status", F.col("event_count").alias("n"))


@query(
    "a5_dominant_fingerprint",
    WITH_CLUSTERS + " SELECT log_group, exception_type, template, cluster_id FROM dom",
)
def a5_dominant_fingerprint(spark, sf_dir):
    found = C.cluster_events(reduced(spark, sf_dir).signatures, GROUP)
    return found.select(*GROUP, *C.CLUSTER_KEY, "cluster_id")


@query("a6_first_level", WITH_CLUSTERS + " SELECT log_group, exception_type, template, level FROM clu")
def a6_first_level(spark, sf_dir):
    found = C.cluster_events(reduced(spark, sf_dir).signatures, GROUP)
    return found.select(*GROUP, *C.CLUSTER_KEY, "level")


@query("a7_max_count", WITH_CLUSTERS + " SELECT log_group, max_count, scope_clusters FROM mx")
def a7_max_count(spark, sf_dir):
    return reduced(spark, sf_dir).all_clusters.select(
        "log_group", "max_count", "scope_clusters"
    ).distinct()


@query(
    "a8_volume_timeline",
    LOGS + f""", w AS ({V.DAYS_SQL}), m AS (
      SELECT w.*, ts FROM logs l JOIN w ON l.log_group = w.log_group AND ts >= window_start AND ts < window_end
      WHERE contains(message, 'ERROR') OR contains(message, 'error'))
    SELECT window_id, epoch_us(time_bucket(INTERVAL 60 MINUTES, ts)) AS bin_us, count(*) AS event_count
    FROM m GROUP BY ALL""",
)
def a8_volume_timeline(spark, sf_dir):
    logs = V.logs(spark, sf_dir)
    matched = I.matching_events(logs, V.windows(spark, sf_dir, V.DAYS_SQL))
    timeline = R.volume_timeline(matched, I.WINDOW_SCOPE)
    return timeline.select("window_id", us("bin_start").alias("bin_us"), "event_count")


STATS_SQL = """
  SELECT t.log_group, t.events, t.events_after_filtering, t.logical_events, c.clusters,
    least(c.clusters, 50) AS clusters_after_budget, b.clusters_in_evidence, b.events_in_evidence,
    c.clusters > 50 AS truncated, CAST(round(b.events_in_evidence * 10000.0 / t.events) AS BIGINT) AS ratio_e4
  FROM (SELECT log_group, count(*) AS events, count(*) FILTER (NOT is_blank) AS events_after_filtering,
          count(DISTINCT CASE WHEN NOT is_blank THEN fingerprint END) AS logical_events FROM src GROUP BY log_group) t
  JOIN (SELECT log_group, count(*) AS clusters FROM clu GROUP BY log_group) c ON t.log_group = c.log_group
  JOIN (SELECT log_group, count(*) AS clusters_in_evidence, CAST(sum(least(event_count, 3)) AS BIGINT) AS events_in_evidence
        FROM ranked WHERE rank <= 10 GROUP BY log_group) b ON t.log_group = b.log_group"""


@query(
    "a9_reduction_stats",
    WITH_ENRICHED + ", " + Q.clusters("log_group", END, "enr WHERE is_error OR is_blank") + STATS_SQL,
)
def a9_reduction_stats(spark, sf_dir):
    logs = V.logs(spark, sf_dir)
    message = F.col("message")
    events = logs.where(
        message.contains("ERROR") | message.contains("error") | (F.trim("message") == "")
    )
    stats = reduce_events(events, GROUP, end_of_data(spark, sf_dir), keep_events=False).stats
    return stats.select(
        "log_group", "events", "events_after_filtering", "logical_events", "clusters",
        F.col("clusters_after_budget").cast("bigint").alias("clusters_after_budget"),
        "clusters_in_evidence", "events_in_evidence", "truncated",
        scaled("compression_ratio").alias("ratio_e4"),
    )


@query(
    "a9_stats_no_budget",
    WITH_CLUSTERS + """ SELECT log_group, count(*) AS clusters, count(*) AS clusters_after_budget,
      count(*) FILTER (rank <= 3) AS clusters_in_evidence,
      CAST(sum(least(event_count, 3)) FILTER (rank <= 3) AS BIGINT) AS events_in_evidence, false AS truncated
    FROM ranked GROUP BY log_group""",
)
def a9_stats_no_budget(spark, sf_dir):
    cfg = I.without_budget(Config(evidence_clusters=3))
    stats = reduce_events(errors(spark, sf_dir), GROUP, end_of_data(spark, sf_dir), cfg, keep_events=False).stats
    return stats.select(
        "log_group", "clusters", F.col("clusters_after_budget").cast("bigint").alias("clusters_after_budget"),
        "clusters_in_evidence", "events_in_evidence", "truncated",
    )


@query(
    "a10_coverage",
    LOGS + """, m AS (SELECT *, row_number() OVER (PARTITION BY log_group ORDER BY ts DESC) AS k FROM logs
      WHERE contains(message, 'ERROR') OR contains(message, 'error'))
    SELECT log_group, count(*) AS matched, count(*) FILTER (k <= 500) AS returned, count(*) > 500 AS truncated,
      CASE WHEN count(*) > 500 THEN epoch_us(min(ts) FILTER (k <= 500)) END AS covered_from_us
    FROM m GROUP BY log_group""",
)
def a10_coverage(spark, sf_dir):
    found = R.coverage(errors(spark, sf_dir), GROUP, 500)
    return found.select(
        "log_group", "matched", "returned", "truncated", us("covered_from").alias("covered_from_us")
    )


def ops_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return V.table(spark, sf_dir, "events").select(
        F.col("event_id"),
        (us(F.col("ts").cast("timestamp")) / 1e6).alias("recorded_at"),
        (F.col("user_id") % 7).alias("host"),
        F.when(kind == "click", "analyze_incident").when(kind == "view", "search_errors")
        .when(kind == "error", "llm_analyze").otherwise(kind).alias("operation"),
        F.col("value").alias("duration_seconds"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 100 / 1000.0).alias("compression_ratio"),
        (F.col("event_id") % 5 == 0).alias("cache_hit"),
    )


OPS_SQL = """ops AS (SELECT event_id, epoch_us(ts) / 1e6 AS recorded_at, user_id % 7 AS host,
  CASE event_type WHEN 'click' THEN 'analyze_incident' WHEN 'view' THEN 'search_errors'
    WHEN 'error' THEN 'llm_analyze' ELSE event_type END AS operation, value AS duration_seconds,
  CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 100 AS DOUBLE) / 1000 END AS compression_ratio,
  event_id % 5 = 0 AS cache_hit FROM events)"""
_ROLLUP_SQL = """count(*) AS operations,
  count(*) FILTER (operation IN ('analyze_incident', 'search_errors')) AS analyses,
  CAST(round(10000.0 * count(*) FILTER (operation IN ('analyze_incident', 'search_errors') AND cache_hit)
    / count(*) FILTER (operation IN ('analyze_incident', 'search_errors'))) AS BIGINT) AS hit_rate_e4,
  CAST(round(median(duration_seconds) FILTER (operation = 'llm_analyze') * 10000) AS BIGINT) AS median_e4,
  CAST(round(avg(compression_ratio) FILTER (operation IN ('analyze_incident', 'search_errors')) * 1000000) AS BIGINT) AS ratio_ppm"""


def _rollup_columns(df: DataFrame, *scope: str) -> DataFrame:
    return df.select(
        *scope, "operations", "analyses", scaled("cache_hit_rate").alias("hit_rate_e4"),
        scaled("median_model_seconds").alias("median_e4"),
        scaled("mean_compression_ratio", 1_000_000).alias("ratio_ppm"),
    )


@query("a11_telemetry_rollup", f"WITH {OPS_SQL} SELECT {_ROLLUP_SQL} FROM ops")
def a11_telemetry_rollup(spark, sf_dir):
    return _rollup_columns(O.telemetry_rollup(ops_table(spark, sf_dir)))


@query("a11_telemetry_by_host", f"WITH {OPS_SQL} SELECT host, {_ROLLUP_SQL} FROM ops GROUP BY host")
def a11_telemetry_by_host(spark, sf_dir):
    return _rollup_columns(O.telemetry_rollup(ops_table(spark, sf_dir), ("host",)), "host")


@query(
    "k5_recent_ops",
    f"""WITH {OPS_SQL} SELECT event_id, operation, CAST(round(recorded_at * 1000000) AS BIGINT) AS recorded_us
    FROM ops ORDER BY recorded_at DESC LIMIT 50""",
)
def k5_recent_ops(spark, sf_dir):
    recent = O.recent_ops(ops_table(spark, sf_dir))
    return recent.select("event_id", "operation", F.round(F.col("recorded_at") * 1e6).cast("bigint").alias("recorded_us"))


@query(
    "a12_eval_summary",
    """SELECT CAST(c_nationkey AS VARCHAR) AS model, count(*) AS attempts,
      count(*) FILTER (c_acctbal >= 0) AS successes,
      CAST(round(avg(CASE WHEN c_acctbal >= 0 THEN 1.0 ELSE 0.0 END) * 10000) AS BIGINT) AS success_e4,
      CAST(round(min(c_acctbal) FILTER (c_acctbal >= 0) * 100) AS BIGINT) AS min_e2,
      CAST(round(max(c_acctbal) FILTER (c_acctbal >= 0) * 100) AS BIGINT) AS max_e2,
      CAST(round(median(c_acctbal) FILTER (c_acctbal >= 0) * 1000) AS BIGINT) AS median_e3,
      CAST(round(avg(CASE WHEN c_acctbal >= 0 THEN CAST(c_custkey % 11 AS DOUBLE) / 10 END) * 10000) AS BIGINT) AS score_e4
    FROM customer GROUP BY c_nationkey""",
)
def a12_eval_summary(spark, sf_dir):
    good = F.col("c_acctbal") >= 0
    runs = V.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("model"), good.alias("succeeded"),
        F.when(good, F.col("c_acctbal")).alias("latency_seconds"),
        F.when(good, F.col("c_custkey") % 11 / 10.0).alias("score"),
    )
    return O.eval_summary(runs).select(
        "model", "attempts", "successes", scaled("success_rate").alias("success_e4"),
        scaled("min_latency", 100).alias("min_e2"), scaled("max_latency", 100).alias("max_e2"),
        scaled("median_latency", 1000).alias("median_e3"), scaled("mean_score").alias("score_e4"),
    )


@query(
    "k3_rank_clusters",
    WITH_CLUSTERS + """ SELECT log_group, rank, cluster_id, event_count,
      CAST(round(score * 10000) AS BIGINT) AS score_e4 FROM ranked WHERE rank <= 50""",
)
def k3_rank_clusters(spark, sf_dir):
    return _ranks(reduce_events(errors(spark, sf_dir), GROUP, end_of_data(spark, sf_dir), keep_events=False))


@query(
    "k3_rank_all",
    WITH_CLUSTERS + """ SELECT log_group, rank, cluster_id, event_count,
      CAST(round(score * 10000) AS BIGINT) AS score_e4 FROM ranked""",
)
def k3_rank_all(spark, sf_dir):
    """Every cluster has its rank when there is no budget."""
    cfg = I.without_budget()
    return _ranks(reduce_events(errors(spark, sf_dir), GROUP, end_of_data(spark, sf_dir), cfg, keep_events=False))


def _ranks(r) -> DataFrame:
    return r.clusters.select(
        "log_group", F.col("rank").cast("bigint").alias("rank"), "cluster_id", "event_count",
        scaled("score").alias("score_e4"),
    )


@query(
    "k4_budget_clusters",
    WITH_CLUSTERS + """ SELECT log_group, rank, cluster_id, scope_clusters > 5 AS truncated
    FROM ranked WHERE rank <= 5""",
)
def k4_budget_clusters(spark, sf_dir):
    r = reduce_events(
        errors(spark, sf_dir), GROUP, end_of_data(spark, sf_dir), Config(max_clusters=5), keep_events=False
    )
    return r.clusters.select(
        "log_group", F.col("rank").cast("bigint").alias("rank"), "cluster_id",
        (F.col("scope_clusters") > 5).alias("truncated"),
    )


@query(
    "w4_top_endpoints",
    WITH_ENRICHED + """, en AS (SELECT log_group, exception_type, template, endpoint, count(*) AS n, min(ts) AS f
      FROM enr WHERE is_error AND NOT is_blank AND endpoint <> '' GROUP BY ALL),
    pl AS (SELECT *, row_number() OVER (PARTITION BY log_group, exception_type, template ORDER BY n DESC, f, endpoint) AS p FROM en)
    SELECT log_group, exception_type, template, string_agg(endpoint || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY p) AS top_endpoints
    FROM pl WHERE p <= 3 GROUP BY ALL""",
)
def w4_top_endpoints(spark, sf_dir):
    return C.top_endpoints(reduced(spark, sf_dir).endpoints, GROUP)


_SAMPLE_SQL = """, nr AS (
  SELECT v.*, k.cluster_id,
    row_number() OVER (PARTITION BY v.log_group, v.exception_type, v.template ORDER BY ts) - 1 AS r,
    count(*) OVER (PARTITION BY v.log_group, v.exception_type, v.template) AS n
  FROM vis v JOIN (SELECT * FROM ranked WHERE rank <= 50) k ON v.log_group = k.log_group AND v.template = k.template
    AND v.exception_type IS NOT DISTINCT FROM k.exception_type),
pick AS (
  SELECT * FROM nr WHERE n <= {k} OR r IN (SELECT round_even(CAST(i AS DOUBLE) * (nr.n - 1) / {k1}, 0) FROM range({k}) t(i)))"""


@query(
    "w1_sample_clusters",
    WITH_CLUSTERS + _SAMPLE_SQL.format(k=5, k1=4) + """
    SELECT log_group, cluster_id, exception_type, template,
      row_number() OVER (PARTITION BY log_group, exception_type, template ORDER BY ts) AS example_no,
      epoch_us(ts) AS ts_us, log_stream, substr(message, 1, 800) AS message FROM pick""",
)
def w1_sample_clusters(spark, sf_dir):
    r = reduce_events(errors(spark, sf_dir), GROUP, end_of_data(spark, sf_dir), Config(max_examples=5))
    return r.samples.select(
        "log_group", "cluster_id", *C.CLUSTER_KEY,
        F.col("example_no").cast("bigint").alias("example_no"), us("ts").alias("ts_us"),
        "log_stream", "message",
    )


# --- retrieval ------------------------------------------------------------------

_DAY_ERRORS = f""", w AS ({V.DAYS_SQL}), m AS (
  SELECT w.*, event_id, ts, log_stream, message FROM logs l
  JOIN w ON l.log_group = w.log_group AND ts >= window_start AND ts < window_end
  WHERE contains(message, 'ERROR') OR contains(message, 'error'))"""


@query("j4_glob_match", LOGS + """, n AS (SELECT DISTINCT log_group AS name FROM logs
      UNION ALL SELECT DISTINCT '/vendor/' || p_brand FROM part)
    SELECT name, '/sea/*' AS pattern FROM n WHERE name LIKE '/sea/%' UNION ALL
    SELECT name, '/land/g?te' FROM n WHERE name LIKE '/land/g_te' UNION ALL
    SELECT name, '/vendor/Brand#[1-3]?' FROM n WHERE regexp_full_match(name, '/vendor/Brand#[1-3].')""")
def j4_glob_match(spark, sf_dir):
    names = V.logs(spark, sf_dir).select(F.col("log_group").alias("name")).distinct()
    brands = V.table(spark, sf_dir, "part").select(F.concat(F.lit("/vendor/"), "p_brand").alias("name"))
    return FL.glob_match(
        names.unionByName(brands.distinct()), ["/sea/*", "/land/g?te", "/vendor/Brand#[1-3]?"]
    )


@query(
    "j5_events_in_windows",
    LOGS + f""", w AS ({V.DAYS_SQL} UNION ALL {V.WHOLE_SQL})
    SELECT window_id, event_id FROM logs l JOIN w ON l.log_group = w.log_group
      AND ts >= window_start AND ts < window_end""",
)
def j5_events_in_windows(spark, sf_dir):
    days = V.windows(spark, sf_dir, V.DAYS_SQL)
    both = days.unionByName(V.windows(spark, sf_dir, V.WHOLE_SQL))
    return W.events_in_windows(V.logs(spark, sf_dir), both).select("window_id", "event_id")


@query(
    "j5_check_windows",
    LOGS + f""", w AS ({V.DAYS_SQL} UNION ALL {V.WHOLE_SQL} UNION ALL
      SELECT 'doc' || CAST(doc_id AS VARCHAR), '/' || source, TIMESTAMP '2024-01-02 00:00:00',
        TIMESTAMP '2024-01-02 00:00:00' + to_minutes(n_chars - 500) FROM documents)
    SELECT window_id, CASE WHEN NOT (log_group LIKE '/sea/%' OR log_group LIKE '/land/g_te' OR log_group LIKE '/%s%')
        THEN 'log group not allowed' WHEN window_end <= window_start THEN 'end not after start'
        WHEN window_end - window_start > INTERVAL 1440 MINUTES THEN 'longer than the maximum' END AS invalid_reason,
      CASE WHEN length(window_id) % 4 = 0 THEN CAST(5000 AS BIGINT) ELSE least(CAST(length(window_id) * 400 AS BIGINT), 5000) END AS row_limit
    FROM w""",
)
def j5_check_windows(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("window_id"),
        F.concat(F.lit("/"), "source").alias("log_group"),
        F.lit("2024-01-02 00:00:00").cast("timestamp").alias("window_start"),
    )
    start = us("window_start")
    chars = V.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("window_id"), "n_chars"
    )
    docs = docs.join(chars, "window_id").withColumn(
        "window_end", F.timestamp_micros(start + (F.col("n_chars") - 500) * W.MINUTE_US)
    ).drop("n_chars")
    all_windows = (
        V.windows(spark, sf_dir, V.DAYS_SQL)
        .unionByName(V.windows(spark, sf_dir, V.WHOLE_SQL)).unionByName(docs)
    )
    length = F.length("window_id")
    asked = all_windows.withColumn("requested_limit", F.when(length % 4 != 0, length * 400))
    checked = W.check_windows(asked, Config(max_window_minutes=1440), [*V.ALLOWLIST, "/*s*"])
    return checked.select("window_id", "invalid_reason", "row_limit")


@query(
    "k1_search_events",
    LOGS + """ SELECT event_id, log_group, epoch_us(ts) AS ts_us FROM logs
    WHERE (contains(message, 'ERROR') OR contains(message, 'error')) AND contains(message, 'Timeout')
    ORDER BY ts DESC LIMIT 100""",
)
def k1_search_events(spark, sf_dir):
    hits = FL.contains_filters(errors(spark, sf_dir), text="Timeout")
    return R.search_events(hits, 100).select("event_id", "log_group", us("ts").alias("ts_us"))


@query(
    "k1_search_per_window",
    LOGS + _DAY_ERRORS + """, r AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY ts DESC) AS row_no FROM m)
    SELECT window_id, event_id, row_no FROM r WHERE row_no <= 10""",
)
def k1_search_per_window(spark, sf_dir):
    days = V.windows(spark, sf_dir, V.DAYS_SQL)
    matched = W.events_in_windows(errors(spark, sf_dir), days)
    found = R.search_events(matched, 10, ("window_id",))
    return found.select("window_id", "event_id", F.col("row_no").cast("bigint").alias("row_no"))


REQUEST_IDS = "SELECT DISTINCT 'trip-' || CAST(event_id AS VARCHAR) AS request_id FROM events WHERE event_type = 'signup'"


def request_ids(spark, sf_dir) -> DataFrame:
    """The ids of all signup events; the traces look for them in every message."""
    events = V.table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    return events.select(F.concat(F.lit("trip-"), F.col("event_id").cast("string")).alias("request_id"))


# "Contains" as the id at any place of the message: ids here are trip- and digits, so
# every prefix of a message's id token is a candidate.
_TRACE_SQL = (
    "WITH " + Q.LOGS + ", " + Q.FIELDS + ", " + Q.red_cte() + f""", ids AS ({REQUEST_IDS}),
tokens AS (SELECT DISTINCT event_id, unnest(regexp_extract_all(raw, 'trip-[0-9]+')) AS token FROM red),
cut AS (SELECT DISTINCT event_id, substr(token, 1, n) AS request_id FROM tokens, range(3, 20) t(n) WHERE n <= length(token)),
hit AS (SELECT ids.request_id, red.* FROM cut JOIN ids USING (request_id) JOIN (SELECT * EXCLUDE request_id FROM red) red ON cut.event_id = red.event_id)"""
)


@query(
    "k2_trace_requests",
    _TRACE_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY log_group, request_id ORDER BY ts) AS seq FROM hit)
    SELECT log_group, request_id, seq, epoch_us(ts) AS ts_us, coalesce(jlevel, '') AS level,
      substr(message, 1, 800) AS message FROM o WHERE seq <= 100""",
)
def k2_trace_requests(spark, sf_dir):
    traced = R.trace_requests(V.logs(spark, sf_dir), request_ids(spark, sf_dir))
    return traced.select(
        "log_group", "request_id", F.col("seq").cast("bigint").alias("seq"), us("ts").alias("ts_us"),
        "level", "message",
    )


@query(
    "k2_trace_totals",
    _TRACE_SQL + """ SELECT log_group, request_id, count(*) AS total_events, count(*) > 100 AS truncated
    FROM hit GROUP BY log_group, request_id""",
)
def k2_trace_totals(spark, sf_dir):
    return R.trace_totals(V.logs(spark, sf_dir), request_ids(spark, sf_dir))


@query(
    "k2_trace_in_windows",
    _TRACE_SQL + f""", w AS ({V.DAYS_SQL}) SELECT w.window_id, request_id, count(*) AS total_events
    FROM hit JOIN w ON hit.log_group = w.log_group AND hit.ts >= w.window_start AND hit.ts < w.window_end GROUP BY ALL""",
)
def k2_trace_in_windows(spark, sf_dir):
    days = V.windows(spark, sf_dir, V.DAYS_SQL)
    traced = I.trace_in_windows(V.logs(spark, sf_dir), request_ids(spark, sf_dir), days)
    return traced.totals.select("window_id", "request_id", "total_events")


@query(
    "k2_trace_mixed_ids",
    LOGS + """, ids AS (
      SELECT DISTINCT CASE event_id % 3 WHEN 0 THEN 'gauges/' || CAST(user_id AS VARCHAR) WHEN 1 THEN substr(md5(CAST(event_id AS VARCHAR)), 1, 12)
        ELSE '.' || CAST(event_id % 200 AS VARCHAR) || '.9' END AS request_id FROM events WHERE event_type = 'error')
    SELECT log_group, request_id, count(*) AS total_events, count(*) > 100 AS truncated
    FROM logs JOIN ids ON contains(message, request_id) GROUP BY log_group, request_id""",
)
def k2_trace_mixed_ids(spark, sf_dir):
    """Ids without a common beginning and of many lengths, most of which no message holds."""
    failed = V.table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    number = F.col("event_id").cast("string")
    ids = failed.select(
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("gauges/"), F.col("user_id").cast("string")))
        .when(F.col("event_id") % 3 == 1, F.substring(F.md5(number), 1, 12))
        .otherwise(F.concat(F.lit("."), (F.col("event_id") % 200).cast("string"), F.lit(".9")))
        .alias("request_id")
    )
    return R.trace_totals(V.logs(spark, sf_dir), ids)


@query(
    "k2_trace_conversation",
    """SELECT CAST(role AS VARCHAR) AS log_group, 'que' AS request_id, count(*) AS total_events, count(*) > 100 AS truncated
    FROM conversations WHERE contains(text, 'que') GROUP BY role UNION ALL
    SELECT role, 'the', count(*), count(*) > 100 FROM conversations WHERE contains(text, 'the') GROUP BY role""",
)
def k2_trace_conversation(spark, sf_dir):
    turns = V.table(spark, sf_dir, "conversations").select(
        F.col("role").alias("log_group"), F.timestamp_seconds(F.col("turn")).alias("ts"),
        F.col("conv_id").cast("string").alias("log_stream"), F.col("text").alias("message"),
    )
    return R.trace_totals(turns, ["que", "the"])


@query(
    "w2_slice_capped",
    LOGS + f""", w AS ({V.WHOLE_SQL}), m AS (SELECT w.*, event_id, ts FROM logs l JOIN w ON l.log_group = w.log_group
      AND ts >= window_start AND ts < window_end WHERE contains(message, 'ERROR') OR contains(message, 'error')),
    n AS (SELECT *, least(12, CAST(ceil(count(*) OVER (PARTITION BY window_id) / 200.0) AS BIGINT)) AS slices FROM m),
    s AS (SELECT *, least(slices - 1, (epoch_us(ts) - epoch_us(window_start)) * slices // (epoch_us(window_end) - epoch_us(window_start))) AS slice_no FROM n),
    r AS (SELECT *, row_number() OVER (PARTITION BY window_id, slice_no ORDER BY ts DESC) AS row_no FROM s)
    SELECT window_id, slices, slice_no, row_no, event_id FROM r WHERE row_no <= 200""",
)
def w2_slice_capped(spark, sf_dir):
    matched = W.events_in_windows(errors(spark, sf_dir), V.windows(spark, sf_dir, V.WHOLE_SQL))
    kept = R.slice_capped(matched, I.WINDOW_SCOPE, limit=200)
    return kept.select(
        "window_id", "slices", "slice_no", F.col("row_no").cast("bigint").alias("row_no"), "event_id"
    )


@query(
    "u1_union_slices",
    LOGS + """ SELECT log_group, count(*) AS n, epoch_us(min(ts)) AS first_us FROM logs GROUP BY log_group""",
)
def u1_union_slices(spark, sf_dir):
    logs = V.logs(spark, sf_dir)
    ends = logs.agg(F.min("ts"), F.max("ts") + F.expr("INTERVAL 1 SECOND")).first()
    bounds = [ends[0] + (ends[1] - ends[0]) * i / 4 for i in range(5)]
    slices = [FL.time_window(logs, F.lit(a), F.lit(b)) for a, b in zip(bounds, bounds[1:])]
    joined = R.union_slices(slices)
    return joined.groupBy("log_group").agg(
        F.count(F.lit(1)).alias("n"), us(F.min("ts")).alias("first_us")
    )


@query(
    "u2_dedupe_events",
    LOGS + """ SELECT log_group, log_stream, count(*) AS n FROM logs GROUP BY log_group, log_stream""",
)
def u2_dedupe_events(spark, sf_dir):
    logs = V.logs(spark, sf_dir).select("log_group", "log_stream", "ts", "message")
    twice = logs.unionByName(logs.where(F.col("message").contains("rror")))
    unique = R.dedupe_events(twice, GROUP)
    return unique.groupBy("log_group", "log_stream").agg(F.count(F.lit(1)).alias("n"))


# Message lines of the log view as a raw file: one file per log group, blocks of it by day.
_LINES_SQL = f"""ml AS (SELECT log_group AS file, date_trunc('day', ts) AS block, event_id,
    unnest(ls) AS l, generate_subscripts(ls, 1) AS part FROM (
    SELECT *, string_split_regex(CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' ' ELSE '' END || message, '\\n') AS ls FROM logs) x),
  nb AS (SELECT * FROM ml WHERE {Q.strip('l')} <> ''),
  st AS (SELECT *, regexp_matches(substr(l, 1, 60), '\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}') AS timed,
      row_number() OVER (PARTITION BY file ORDER BY event_id, part) AS k FROM nb),
  sf AS (SELECT *, CASE WHEN k = 1 OR timed OR (NOT regexp_matches(l, {Q.lit(P.RAW_CONTINUATION)})
      AND regexp_matches(l, {Q.lit(P.RAW_LEVEL_WORD)})) THEN 1 ELSE 0 END AS starts FROM st),
  ev AS (SELECT *, sum(starts) OVER (PARTITION BY file ORDER BY event_id, part ROWS UNBOUNDED PRECEDING) AS event_no FROM sf)"""


def message_lines(spark, sf_dir) -> DataFrame:
    stamp = F.when(
        F.col("event_id") % 3 == 0,
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" ")),
    ).otherwise(F.lit(""))
    lines = V.logs(spark, sf_dir).select(
        F.col("log_group").alias("file"),
        us(F.date_trunc("day", "ts")).alias("block"),
        F.col("event_id").alias("row"),
        F.posexplode(F.split(F.concat(stamp, "message"), LINE_BREAK)).alias("part", "line"),
    )
    from logdistill.functions.text import not_blank

    return lines.where(not_blank(F.col("line")))


@query(
    "w3_assemble_events",
    LOGS + ", " + _LINES_SQL + """
    SELECT file, CAST(event_no AS BIGINT) AS event_no, string_agg(l, chr(10) ORDER BY event_id, part) AS message,
      coalesce(epoch_us(min(CASE WHEN timed THEN try_cast(replace(regexp_extract(substr(l, 1, 60),
          '(\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}(?:[.,]\\d+)?)', 1), 'T', ' ') AS TIMESTAMP) END)),
        epoch_us(TIMESTAMP '2000-01-01 00:00:00') + (CAST(event_no AS BIGINT) - 1) * 1000000) AS ts_us
    FROM ev GROUP BY file, event_no""",
)
def w3_assemble_events(spark, sf_dir):
    events = RL.assemble_events(message_lines(spark, sf_dir))
    return events.select("file", "event_no", "message", us("ts").alias("ts_us"))


@query(
    "w3_assemble_parts",
    LOGS + ", " + _LINES_SQL + """
    , e AS (SELECT file, CAST(event_no AS BIGINT) AS event_no, string_agg(l, chr(10) ORDER BY event_id, part) AS message, max(length(l)) AS widest
      FROM ev GROUP BY file, event_no)
    SELECT file, event_no, CAST(length(message) AS BIGINT) AS chars, md5(message) AS digest, substr(message, 1, 120) AS head, true AS bounded FROM e""",
)
def w3_assemble_parts(spark, sf_dir):
    """Events in parts of a hundred characters: whole when folded, and no part longer than that and a line."""
    lines = stage(message_lines(spark, sf_dir), "lines")
    parts = stage(RL.assemble_parts(lines, part_chars=100), "parts")
    longest = lines.agg(F.max(F.length("line"))).first()[0]
    size = parts.groupBy("file", "event_no").agg((F.max(F.length("text")) <= 101 + longest).alias("bounded"))
    whole = RL.fold_parts(parts).select("file", "event_no", "chars", F.md5("message").alias("digest"))
    heads = RL.fold_parts(parts, max_chars=120).select("file", "event_no", F.col("message").alias("head"))
    return whole.join(heads, ["file", "event_no"]).join(size, ["file", "event_no"])


_FILE_SQL = _LINES_SQL.replace(
    "SELECT log_group AS file", "SELECT log_group || '#' || strftime(ts, '%Y-%m-%d') AS file"
)
_ASSEMBLED_SQL = ORACLES["w3_assemble_events"].split(_LINES_SQL)[1]


@query("s3_raw_logs", LOGS + ", " + _FILE_SQL + _ASSEMBLED_SQL)
def s3_raw_logs(spark, sf_dir):
    """The message lines as text files, one per log group and day, read back as events."""
    lines = message_lines(spark, sf_dir).withColumn(
        "name", F.concat("file", F.lit("#"), F.date_format(F.timestamp_micros("block"), "yyyy-MM-dd"))
    )
    path = new_path(spark, "raw")
    files = lines.withColumn("file", F.hex("name")).repartition("file")
    files = files.sortWithinPartitions("file", "row", "part")
    files.select("file", F.col("line").alias("value")).write.partitionBy("file").text(path)
    events = RL.read_raw_logs(spark, f"{path}/*/")
    name = F.decode(F.unhex(F.regexp_extract("log_group", "file=([0-9A-F]+)", 1)), "UTF-8")
    return events.select(name.alias("file"), "event_no", "message", us("ts").alias("ts_us"))


# --- comparison -----------------------------------------------------------------

_SIDES = f"""sw AS ({V.SIDES_SQL}), sev AS (SELECT enr.*, sw.side, sw.window_end FROM enr JOIN sw
  ON enr.log_group = sw.log_group AND enr.ts >= sw.window_start AND enr.ts < sw.window_end WHERE enr.is_error)"""


def _compare_sql(budget: str) -> str:
    return (
        WITH_ENRICHED + ", " + _SIDES + ", "
        + Q.clusters("log_group, side, window_end", "c.window_end", "sev")
        + f""", kept AS (SELECT * FROM ranked {budget}),
    b AS (SELECT * FROM kept WHERE side = 'baseline'), c AS (SELECT * FROM kept WHERE side = 'comparison'),
    d AS (SELECT coalesce(c.log_group, b.log_group) AS log_group, coalesce(c.exception_type, b.exception_type) AS exception_type,
        coalesce(c.template, b.template) AS template, coalesce(c.cluster_id, b.cluster_id) AS cluster_id,
        b.event_count AS bn, c.event_count AS cn, b.rank AS baseline_rank, c.rank AS comparison_rank
      FROM b FULL OUTER JOIN c ON b.log_group = c.log_group AND b.template = c.template
        AND b.exception_type IS NOT DISTINCT FROM c.exception_type),
    e AS (SELECT *, CASE WHEN bn IS NULL THEN 'new' WHEN cn IS NULL THEN 'disappeared'
        WHEN CAST(cn AS DOUBLE) / bn BETWEEN 0.5 AND 2.0 THEN 'stable'
        WHEN CAST(cn AS DOUBLE) / bn > 2.0 THEN 'increased' ELSE 'decreased' END AS change FROM d)"""
    )


_DELTA_COLUMNS = """ SELECT log_group, exception_type, template, cluster_id, change, coalesce(bn, 0) AS baseline_count,
  coalesce(cn, 0) AS comparison_count, CAST(round(round(CAST(cn AS DOUBLE) / bn, 2) * 100) AS BIGINT) AS ratio_e2
FROM e WHERE change <> 'stable'"""


def compared(spark, sf_dir, cfg: Config = Config(), sides: str = V.SIDES_SQL) -> I.Comparison:
    return I.compare_windows(V.logs(spark, sf_dir), V.windows(spark, sf_dir, sides), GROUP, cfg)


def _delta_rows(c: I.Comparison) -> DataFrame:
    return c.deltas.select(
        "log_group", *C.CLUSTER_KEY, "cluster_id", "change", "baseline_count", "comparison_count",
        scaled("ratio", 100).alias("ratio_e2"),
    )


@query("j1_compare_windows", _compare_sql("WHERE rank <= 50") + _DELTA_COLUMNS)
def j1_compare_windows(spark, sf_dir):
    return _delta_rows(compared(spark, sf_dir))


@query("j1_compare_windows_exact", _compare_sql("") + _DELTA_COLUMNS)
def j1_compare_windows_exact(spark, sf_dir):
    return _delta_rows(compared(spark, sf_dir, I.without_budget()))


@query(
    "u3_new_endpoints",
    _compare_sql("WHERE rank <= 50").replace(V.SIDES_SQL, V.BACKWARD_SQL) + """, en AS (SELECT DISTINCT log_group, side, exception_type, template, endpoint
      FROM sev WHERE NOT is_blank AND endpoint <> '')
    SELECT n.log_group, n.exception_type, n.template, n.endpoint FROM en n
    JOIN c ON n.log_group = c.log_group AND n.template = c.template AND n.exception_type IS NOT DISTINCT FROM c.exception_type
    WHERE n.side = 'comparison' AND NOT EXISTS (SELECT 1 FROM en o JOIN b ON o.log_group = b.log_group AND o.template = b.template
      AND o.exception_type IS NOT DISTINCT FROM b.exception_type WHERE o.side = 'baseline' AND o.log_group = n.log_group
      AND o.template = n.template AND o.exception_type IS NOT DISTINCT FROM n.exception_type AND o.endpoint = n.endpoint)
      AND EXISTS (SELECT 1 FROM e WHERE e.change <> 'stable' AND e.log_group = n.log_group AND e.template = n.template
        AND e.exception_type IS NOT DISTINCT FROM n.exception_type)""",
)
def u3_new_endpoints(spark, sf_dir):
    return compared(spark, sf_dir, sides=V.BACKWARD_SQL).new_endpoints


@query(
    "a14_window_profile",
    _compare_sql("WHERE rank <= 50") + """, tot AS (SELECT log_group, side, count(*) AS total_events FROM sev GROUP BY ALL)
    SELECT t.log_group, t.side, t.total_events, k.rank, k.cluster_id, k.event_count,
      CAST(round(k.score * 10000) AS BIGINT) AS score_e4
    FROM tot t JOIN kept k ON t.log_group = k.log_group AND t.side = k.side WHERE k.rank <= 10""",
)
def a14_window_profile(spark, sf_dir):
    profiles = compared(spark, sf_dir).profiles
    return profiles.select(
        "log_group", "side", "total_events", F.col("rank").cast("bigint").alias("rank"),
        "cluster_id", "event_count", scaled("score").alias("score_e4"),
    )


# --- reports and evidence -------------------------------------------------------


@query(
    "e7_reduce",
    WITH_CLUSTERS + """ SELECT log_group, rank, cluster_id, exception_type, substr(template, 1, 300) AS template,
      event_count, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, level, has_5xx,
      CAST(round(score * 10000) AS BIGINT) AS score_e4 FROM ranked WHERE rank <= 50""",
)
def e7_reduce(spark, sf_dir):
    return _cluster_rows(reduced(spark, sf_dir).summaries(), "log_group")


def _cluster_rows(summaries: DataFrame, *scope: str) -> DataFrame:
    return summaries.select(
        *scope, F.col("rank").cast("bigint").alias("rank"), "cluster_id", "exception_type",
        "template", "event_count", us("first_seen").alias("first_us"),
        us("last_seen").alias("last_us"), "level", "has_5xx", scaled("score").alias("score_e4"),
    )


@query("s5_write_report", ORACLES["e7_reduce"])
def s5_write_report(spark, sf_dir):
    """The report table as JSON files, read back."""
    report = _cluster_rows(reduced(spark, sf_dir).summaries(), "log_group")
    path = new_path(spark, "report")
    SE.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


_DAY_CLUSTERS = (
    WITH_ENRICHED + f""", w AS ({V.DAYS_SQL}), wev AS (
      SELECT DISTINCT enr.* EXCLUDE event_id, w.window_id, w.window_end FROM enr JOIN w ON enr.log_group = w.log_group
        AND enr.ts >= w.window_start AND enr.ts < w.window_end WHERE enr.is_error{{more}}), """
    + Q.clusters("log_group, window_id, window_end", "c.window_end", "wev").replace("{", "{{").replace("}", "}}")
)
_DAY_COLUMNS = """ SELECT window_id, rank, cluster_id, exception_type, substr(template, 1, 300) AS template, event_count,
  epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, level, has_5xx,
  CAST(round(score * 10000) AS BIGINT) AS score_e4 FROM ranked WHERE rank <= """


def _day_sql(more: str = "") -> str:
    head, tail = _DAY_CLUSTERS.split("{more}")
    return head + more + tail.replace("{{", "{").replace("}}", "}")


@query("e5_analyze", _day_sql() + _DAY_COLUMNS + "10")
def e5_analyze(spark, sf_dir):
    report = I.analyze(V.logs(spark, sf_dir), V.windows(spark, sf_dir, V.DAYS_SQL))
    return _cluster_rows(report.clusters, "window_id")


@query(
    "e5_overview",
    _day_sql() + """ SELECT w.window_id, coalesce(t.events, 0) AS events, coalesce(t.logical_events, 0) AS logical_events,
      CASE WHEN t.events IS NULL THEN 'low' END AS severity,
      CASE WHEN t.events IS NULL THEN 'ok' ELSE 'unavailable' END AS status
    FROM (SELECT window_id FROM w UNION ALL SELECT 'quiet#' || CAST(n_nationkey AS VARCHAR) FROM nation) w
    LEFT JOIN (SELECT window_id, count(*) AS events, count(DISTINCT fingerprint) AS logical_events FROM wev GROUP BY window_id) t
      ON w.window_id = t.window_id""",
)
def e5_overview(spark, sf_dir):
    days = V.windows(spark, sf_dir, V.DAYS_SQL)
    quiet = V.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("quiet#"), F.col("n_nationkey").cast("string")).alias("window_id"),
        F.concat(F.lit("/quiet/"), "n_name").alias("log_group"),
        F.lit("2024-01-05 00:00:00").cast("timestamp").alias("window_start"),
        F.lit("2024-01-06 00:00:00").cast("timestamp").alias("window_end"),
    )
    report = I.analyze(V.logs(spark, sf_dir), days.unionByName(quiet))
    return report.overview.select("window_id", "events", "logical_events", "severity", "status")


@query(
    "e5_rejected_windows",
    _day_sql() + f""", asked AS (SELECT window_id, log_group, 1 AS kind FROM w
      UNION ALL SELECT window_id || '#back', log_group, 2 FROM w
      UNION ALL SELECT window_id, log_group, 3 FROM ({V.WHOLE_SQL}) x)
    SELECT a.window_id, CASE WHEN a.log_group NOT LIKE '/sea/%' OR kind > 1 THEN 'rejected'
        WHEN t.window_id IS NULL THEN 'ok' ELSE 'unavailable' END AS status,
      CASE WHEN a.log_group NOT LIKE '/sea/%' THEN 'log group not allowed' WHEN kind = 2 THEN 'end not after start'
        WHEN kind = 3 THEN 'longer than the maximum' END AS invalid_reason
    FROM asked a LEFT JOIN (SELECT DISTINCT window_id FROM wev WHERE NOT is_blank) t ON a.window_id = t.window_id""",
)
def e5_rejected_windows(spark, sf_dir):
    """Windows that run backward, are too long or of a group not allowed are told apart from calm ones."""
    days = V.windows(spark, sf_dir, V.DAYS_SQL)
    back = days.select(
        F.concat("window_id", F.lit("#back")).alias("window_id"), "log_group",
        F.col("window_end").alias("window_start"), F.col("window_start").alias("window_end"),
    )
    asked = days.unionByName(back).unionByName(V.windows(spark, sf_dir, V.WHOLE_SQL))
    report = I.analyze(V.logs(spark, sf_dir), asked, allowlist=["/sea/*"], max_minutes=1440)
    return report.overview.select("window_id", "status", "invalid_reason")


@query(
    "e5_overlapping_windows",
    _day_sql().replace(V.DAYS_SQL, V.HALF_DAYS_SQL) + _DAY_COLUMNS + "10",
)
def e5_overlapping_windows(spark, sf_dir):
    """Windows of a day that begin every twelve hours, so that most events lie in two."""
    report = I.analyze(V.logs(spark, sf_dir), V.windows(spark, sf_dir, V.HALF_DAYS_SQL))
    return _cluster_rows(report.clusters, "window_id")


_SLICED_SQL = WITH_ENRICHED + f""", w AS ({V.DAYS_SQL}),
    m AS (SELECT w.*, event_id, ts, fingerprint, is_blank FROM enr JOIN w ON enr.log_group = w.log_group
      AND ts >= window_start AND ts < window_end WHERE is_error),
    n AS (SELECT *, least(12, CAST(ceil(count(*) OVER (PARTITION BY window_id) / 10.0) AS BIGINT)) AS slices FROM m),
    s AS (SELECT *, least(slices - 1, (epoch_us(ts) - epoch_us(window_start)) * slices // (epoch_us(window_end) - epoch_us(window_start))) AS slice_no FROM n),
    r AS (SELECT *, row_number() OVER (PARTITION BY window_id, slice_no ORDER BY ts DESC) AS row_no,
      count(*) OVER (PARTITION BY window_id, slice_no) > 10 AS cut FROM s),
    o AS (SELECT window_id, count(*) FILTER (row_no <= 10) AS events, any_value(slices) AS query_slices, bool_or(cut) AS truncated,
      count(DISTINCT CASE WHEN row_no <= 10 AND NOT is_blank THEN fingerprint END) AS logical_events,
      CASE WHEN bool_or(cut) THEN min(ts) FILTER (row_no <= 10) END AS covered_from FROM r GROUP BY window_id)"""


@query(
    "e5_sliced",
    _SLICED_SQL + """ SELECT w.window_id, coalesce(events, 0) AS events, coalesce(logical_events, 0) AS logical_events,
      coalesce(query_slices, 1) AS query_slices, coalesce(truncated, false) AS truncated, epoch_us(covered_from) AS covered_us
    FROM w LEFT JOIN o ON w.window_id = o.window_id""",
)
def e5_sliced(spark, sf_dir):
    """Reports over the newest ten events of each slice tell from when on they looked."""
    overview = sliced_report(spark, sf_dir).overview
    return overview.select(
        "window_id", "events", "logical_events", "query_slices", "truncated", us("covered_from").alias("covered_us")
    )


def sliced_report(spark, sf_dir) -> I.IncidentReport:
    days = V.windows(spark, sf_dir, V.DAYS_SQL)
    return I.analyze(V.logs(spark, sf_dir), days, retrieval_limit=10)


@query(
    "e1_truncation_note",
    _SLICED_SQL + """ SELECT window_id, events AS total, CASE WHEN truncated THEN 'retrieval stopped at its limit: examples start at '
      || strftime(covered_from, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00; counts per time bin are complete' END AS note FROM o""",
)
def e1_truncation_note(spark, sf_dir):
    doc = F.col("evidence")
    return sliced_report(spark, sf_dir).evidence().select(
        "window_id", F.get_json_object(doc, "$.total_error_events").cast("bigint").alias("total"),
        F.get_json_object(doc, "$.note").alias("note"),
    )


_ROLLUPS: dict[tuple[str, str], str] = {}


def rolled_up(spark, sf_dir):
    """Reports over windows that begin and end within hours, from a roll-up written in parts, one of them twice."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ROLLUPS:
        path, wanted = new_path(spark, "rollup"), I.wanted_events(V.logs(spark, sf_dir))
        even = F.pmod(F.unix_date(F.to_date("ts")), F.lit(2)) == 0
        for some in (even, ~even, even):
            RU.update_rollup(wanted.where(some), path)
        _ROLLUPS[key] = path
    path = _ROLLUPS[key]
    windows = V.windows(spark, sf_dir, V.SHIFTED_SQL)
    return I.report_from_rollup(V.logs(spark, sf_dir), windows, path)


@query("a2_from_rollup", _day_sql().replace(V.DAYS_SQL, V.SHIFTED_SQL) + _DAY_COLUMNS + "50")
def a2_from_rollup(spark, sf_dir):
    return _cluster_rows(rolled_up(spark, sf_dir)[0].summaries(), "window_id")


@query(
    "a9_from_rollup",
    _day_sql().replace(V.DAYS_SQL, V.SHIFTED_SQL)
    + """ SELECT window_id, count(*) AS events, count(*) FILTER (NOT is_blank) AS events_after_filtering,
      count(DISTINCT CASE WHEN NOT is_blank THEN fingerprint END) AS logical_events FROM wev GROUP BY window_id""",
)
def a9_from_rollup(spark, sf_dir):
    stats = rolled_up(spark, sf_dir)[0].stats
    return stats.select("window_id", "events", "events_after_filtering", "logical_events")


@query("a8_from_rollup", ORACLES["a8_volume_timeline"].replace(V.DAYS_SQL, V.SHIFTED_SQL).replace("INTERVAL 60 MINUTES", "INTERVAL 120 MINUTES"))
def a8_from_rollup(spark, sf_dir):
    timeline = rolled_up(spark, sf_dir)[1]
    return timeline.select("window_id", us("bin_start").alias("bin_us"), "event_count")


@query(
    "s2_analyze_events",
    WITH_ENRICHED + """ SELECT log_group, count(*) AS events, count(DISTINCT CASE WHEN NOT is_blank THEN fingerprint END) AS logical_events,
      'stated' AS service, 'NOTICE' AS level FROM enr GROUP BY log_group""",
)
def s2_analyze_events(spark, sf_dir):
    """A table that states its own level and service goes through the whole reduction."""
    stated = V.logs(spark, sf_dir).withColumns({"level": F.lit("notice"), "service": F.lit("stated")})
    reduction, _ = I.analyze_events(SE.from_table(stated))
    told = reduction.enriched.groupBy("log_group").agg(
        F.max("service").alias("service"), F.max("level").alias("level")
    )
    return reduction.stats.select("log_group", "events", "logical_events").join(told, "log_group")


@query(
    "e6_search_errors",
    _day_sql(" AND contains(enr.raw, 'gauges') AND contains(enr.raw, 'Timeout') AND contains(enr.raw, '504')")
    + _DAY_COLUMNS + "50",
)
def e6_search_errors(spark, sf_dir):
    report = I.search_errors(
        V.logs(spark, sf_dir), V.windows(spark, sf_dir, V.DAYS_SQL), service="gauges",
        exception_type="Timeout", status_code=504,
    )
    return _cluster_rows(report.clusters, "window_id")


def evidence_of(spark, sf_dir, cfg: Config = Config()) -> DataFrame:
    logs, whole = V.logs(spark, sf_dir), V.windows(spark, sf_dir, V.WHOLE_SQL)
    return I.analyze(logs, whole, cfg).evidence()


@query(
    "e1_build_evidence",
    WITH_CLUSTERS + """ SELECT log_group, count(*) AS clusters_sent, CAST(sum(least(event_count, 3)) AS BIGINT) AS events_sent,
      max(cluster_id) FILTER (rank = 1) AS first_cluster, CAST(max(event_count) FILTER (rank = 1) AS BIGINT) AS first_count,
      true AS fits FROM ranked WHERE rank <= 10 GROUP BY log_group""",
)
def e1_build_evidence(spark, sf_dir):
    doc = F.col("evidence")
    return evidence_of(spark, sf_dir).select(
        "log_group", F.col("clusters_sent").cast("bigint").alias("clusters_sent"),
        F.col("events_sent").cast("bigint").alias("events_sent"),
        F.get_json_object(doc, "$.clusters[0].cluster_id").alias("first_cluster"),
        F.get_json_object(doc, "$.clusters[0].count").cast("bigint").alias("first_count"),
        (F.length(doc) <= Config().evidence_chars).alias("fits"),
    )


_CHANGES = """, tot AS (SELECT log_group, count(*) FILTER (side = 'baseline') AS baseline_events,
        count(*) FILTER (side = 'comparison') AS comparison_events FROM sev GROUP BY ALL),
    ch AS (SELECT log_group, count(*) FILTER (change = 'new') AS new_clusters, count(*) FILTER (change = 'disappeared') AS disappeared,
        count(*) FILTER (change IN ('increased', 'decreased')) AS changed FROM e GROUP BY ALL)
    SELECT * FROM tot JOIN ch USING (log_group)"""


@query("e2_comparison_evidence", _compare_sql("WHERE rank <= 50") + _CHANGES)
def e2_comparison_evidence(spark, sf_dir):
    return _comparison_counts(spark, sf_dir, Config(evidence_chars=10_000_000))


@query("e2_exact", _compare_sql("") + _CHANGES)
def e2_exact(spark, sf_dir):
    """The comparison document over all clusters of both sides."""
    return _comparison_counts(spark, sf_dir, I.without_budget(Config(evidence_chars=10_000_000)))


_NEW_ENDPOINTS_SQL = ORACLES["u3_new_endpoints"].replace(
    "SELECT n.log_group, n.exception_type, n.template, n.endpoint FROM en n",
    "SELECT n.log_group, n.exception_type, substr(n.template, 1, 200) AS template, n.endpoint FROM en n",
)
_DELTA_TYPE = "array<struct<exception_type:string,template:string,new_endpoints:array<string>>>"


@query("e2_new_endpoints", _NEW_ENDPOINTS_SQL)
def e2_new_endpoints(spark, sf_dir):
    """New endpoints as the comparison documents list them."""
    doc = F.from_json(
        "evidence", f"deltas struct<new_clusters:{_DELTA_TYPE},disappeared_clusters:{_DELTA_TYPE},changed_clusters:{_DELTA_TYPE}>"
    )
    found = compared(spark, sf_dir, Config(evidence_chars=10_000_000), V.BACKWARD_SQL).evidence()
    listed = F.concat(*[F.col(f"d.deltas.{c}") for c in ("new_clusters", "disappeared_clusters", "changed_clusters")])
    rows = found.select("log_group", doc.alias("d")).select("log_group", F.inline(listed))
    return rows.select("log_group", "exception_type", "template", F.explode("new_endpoints").alias("endpoint"))


@query(
    "e2_statuses",
    _compare_sql("WHERE rank <= 50") + """ SELECT k.log_group, k.side, k.cluster_id, CAST(s.status_code AS VARCHAR) AS status, count(*) AS n
    FROM sev s JOIN kept k ON s.log_group = k.log_group AND s.side = k.side AND s.template = k.template
      AND s.exception_type IS NOT DISTINCT FROM k.exception_type
    WHERE NOT s.is_blank AND s.status_code IS NOT NULL AND k.rank <= 10 GROUP BY ALL""",
)
def e2_statuses(spark, sf_dir):
    """Status codes of both windows' clusters as the comparison documents list them."""
    side = "struct<clusters:array<struct<cluster_id:string,status_codes:map<string,bigint>>>>"
    doc = F.from_json("evidence", f"baseline {side}, comparison {side}")
    found = compared(spark, sf_dir, Config(evidence_chars=10_000_000)).evidence().select("log_group", doc.alias("d"))
    both = [found.select("log_group", F.lit(s).alias("side"), F.inline(f"d.{s}.clusters")) for s in ("baseline", "comparison")]
    return R.union_slices(both).select("log_group", "side", "cluster_id", F.explode("status_codes").alias("status", "n"))


def _comparison_counts(spark, sf_dir, cfg: Config) -> DataFrame:
    doc = F.from_json(
        "evidence",
        "baseline struct<total_events:bigint>, comparison struct<total_events:bigint>, deltas struct<"
        "new_clusters:array<struct<cluster_id:string>>, disappeared_clusters:array<struct<cluster_id:string>>,"
        "changed_clusters:array<struct<cluster_id:string>>>",
    )
    # The document has to stay whole to be read back here.
    found = compared(spark, sf_dir, cfg).evidence()
    parsed = found.select("log_group", doc.alias("d"))

    def size(name: str) -> Column:
        return F.size(F.col(f"d.deltas.{name}")).cast("bigint")

    return parsed.select(
        "log_group", F.col("d.baseline.total_events").alias("baseline_events"),
        F.col("d.comparison.total_events").alias("comparison_events"),
        size("new_clusters").alias("new_clusters"),
        size("disappeared_clusters").alias("disappeared"), size("changed_clusters").alias("changed"),
    )


_TERMS_SQL = WITH_CLUSTERS + _SAMPLE_SQL.format(k=3, k1=2) + """, k50 AS (SELECT * FROM ranked WHERE rank <= 50),
terms AS (
  SELECT log_group, lower(exception_type) AS term FROM k50 WHERE exception_type <> ''
  UNION SELECT DISTINCT v.log_group, lower(endpoint) FROM vis v JOIN k50 k ON v.log_group = k.log_group AND v.template = k.template
    AND v.exception_type IS NOT DISTINCT FROM k.exception_type WHERE endpoint <> ''
  UNION SELECT log_group, lower(w) FROM (SELECT log_group, unnest(string_split_regex(template, '\\s+')) AS w FROM k50) x WHERE length(w) > 3
  UNION SELECT log_group, lower(w) FROM (SELECT log_group, unnest(string_split_regex(substr(message, 1, 800), '\\s+')) AS w FROM pick) x WHERE length(w) > 3
  UNION SELECT log_group, lower(log_group) FROM k50)"""


def terms_of(r) -> DataFrame:
    return EV.known_terms(r.clusters, r.endpoints, r.samples, GROUP, GROUP)


@query("e3_known_terms", _TERMS_SQL + " SELECT log_group, term FROM terms")
def e3_known_terms(spark, sf_dir):
    return terms_of(reduced(spark, sf_dir, keep_events=True))


def analyses(clusters: DataFrame) -> DataFrame:
    """Claims about every kept cluster, some of them unfounded."""
    odd = F.col("rank") % 2 == 1
    ids = F.array(F.lit("ghost999"), F.col("cluster_id"), F.lit("ghost111"), F.lit("ghost999"))
    first = F.struct(
        F.concat(F.lit("statement "), "cluster_id").alias("statement"),
        F.when(odd, ids).otherwise(F.array(F.lit("ghost999"))).alias("cluster_ids"),
    )
    second = F.struct(
        F.lit("second").alias("statement"),
        F.when(F.col("rank") % 3 == 0, F.array("cluster_id")).otherwise(
            F.array().cast("array<string>")
        ).alias("cluster_ids"),
    )
    cause = F.struct(
        F.concat(F.lit("cause "), "cluster_id").alias("cause"),
        (F.col("rank") / 10.0 - 0.2).alias("confidence"),
        F.array(first, second).alias("evidence"),
    )
    empty = F.struct(
        F.lit("no evidence").alias("cause"), F.lit(0.5).alias("confidence"),
        F.array().cast("array<struct<statement:string,cluster_ids:array<string>>>").alias("evidence"),
    )
    return clusters.select(
        F.concat("log_group", F.lit("#"), F.col("rank").cast("string")).alias("analysis_id"),
        "log_group",
        F.concat(F.lit("summary "), F.coalesce("exception_type", F.lit("none"))).alias("summary"),
        F.when(odd, "high").otherwise("low").alias("severity"),
        F.array(cause, empty).cast(VA.ROOT_CAUSES).alias("root_causes"),
        F.array(
            F.lit("/Berths"), F.lit("beacon-7"), F.lit("mast north"), F.lit("the GAUGES/level"),
            F.lit("abc"), F.concat(F.lit("x "), F.coalesce("exception_type", F.lit("zzzz"))),
        ).alias("affected_components"),
    )


_CLAIMS_SQL = WITH_CLUSTERS + """, k50 AS (SELECT *, log_group || '#' || CAST(rank AS VARCHAR) AS analysis_id FROM ranked WHERE rank <= 50),
claims AS (
  SELECT analysis_id, log_group, 0 AS cause_no, 0 AS evidence_no, unnest(CASE WHEN rank % 2 = 1
      THEN ['ghost999', cluster_id, 'ghost111', 'ghost999'] ELSE ['ghost999'] END) AS cluster_id FROM k50
  UNION ALL SELECT analysis_id, log_group, 0, 1, cluster_id FROM k50 WHERE rank % 3 = 0)"""


@query(
    "u4_unknown_ids",
    _CLAIMS_SQL + """ SELECT analysis_id, cluster_id, count(*) AS n FROM claims c
    WHERE NOT EXISTS (SELECT 1 FROM k50 k WHERE k.log_group = c.log_group AND k.cluster_id = c.cluster_id) GROUP BY ALL""",
)
def u4_unknown_ids(spark, sf_dir):
    found = reduced(spark, sf_dir).clusters
    bad = VA.unknown_ids(analyses(found), found, GROUP)
    return bad.groupBy("analysis_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j2_validate_refs",
    _CLAIMS_SQL + """, rows AS (
      SELECT analysis_id, rank, cluster_id, 0 AS cause_no, 0 AS evidence_no, 'statement ' || cluster_id AS statement FROM k50
      UNION ALL SELECT analysis_id, rank, cluster_id, 0, 1, 'second' FROM k50
      UNION ALL SELECT analysis_id, rank, cluster_id, 1, NULL, NULL FROM k50)
    SELECT analysis_id, cause_no, evidence_no, statement,
      CASE WHEN cause_no = 0 AND ((evidence_no = 0 AND rank % 2 = 1) OR (evidence_no = 1 AND rank % 3 = 0)) THEN cluster_id ELSE '' END AS kept,
      CASE WHEN cause_no = 0 AND evidence_no = 0 THEN CASE WHEN rank % 2 = 1 THEN 'ghost111; ghost999' ELSE 'ghost999' END ELSE '' END AS dropped,
      cause_no = 0 AND (rank % 2 = 1 OR rank % 3 = 0) AS verified,
      CAST(round(CASE WHEN cause_no = 1 THEN 0.5 ELSE greatest(0.0, least(1.0, rank / 10.0 - 0.2)) END * 10000) AS BIGINT) AS confidence_e4
    FROM rows""",
)
def j2_validate_refs(spark, sf_dir):
    found = reduced(spark, sf_dir).clusters
    refs = VA.validate_refs(analyses(found), found, GROUP)
    return refs.select(
        "analysis_id", "cause_no", "evidence_no", "statement",
        F.array_join("kept_ids", "; ").alias("kept"), F.array_join("dropped_ids", "; ").alias("dropped"),
        "verified", scaled("confidence").alias("confidence_e4"),
    )


_COMPONENTS_SQL = _TERMS_SQL + """, comp AS (
  SELECT log_group || '#' || CAST(rank AS VARCHAR) AS analysis_id, log_group, unnest(['/Berths', 'beacon-7', 'mast north',
    'the GAUGES/level', 'abc', 'x ' || coalesce(exception_type, 'zzzz')]) AS component FROM k50),
dc AS (SELECT DISTINCT log_group, component, lower(component) AS low FROM comp),
wd AS (SELECT DISTINCT log_group, component, w FROM (
  SELECT log_group, component, unnest(string_split_regex(replace(low, '/', ' /'), '\\s+')) AS w FROM dc) x WHERE length(w) > 3),
okc AS (SELECT DISTINCT d.log_group, d.component FROM dc d JOIN terms t ON d.log_group = t.log_group AND d.low = t.term
  UNION SELECT DISTINCT d.log_group, d.component FROM wd d JOIN terms t ON d.log_group = t.log_group AND contains(t.term, d.w))"""


@query(
    "j3_validate_components",
    _COMPONENTS_SQL + """ SELECT c.analysis_id, c.component, o.component IS NOT NULL AS supported
    FROM comp c LEFT JOIN okc o ON c.log_group = o.log_group AND c.component = o.component""",
)
def j3_validate_components(spark, sf_dir):
    r = reduced(spark, sf_dir, keep_events=True)
    checked = VA.check_components(analyses(r.clusters), terms_of(r), GROUP)
    return checked.select("analysis_id", "component", "supported")


@query(
    "e4_validate_analyses",
    _COMPONENTS_SQL + """, cnt AS (SELECT c.analysis_id, count(*) FILTER (o.component IS NULL) AS bad,
        string_agg(c.component, '; ' ORDER BY CASE c.component WHEN '/Berths' THEN 1 WHEN 'beacon-7' THEN 2 WHEN 'mast north' THEN 3
          WHEN 'the GAUGES/level' THEN 4 WHEN 'abc' THEN 5 ELSE 6 END) FILTER (o.component IS NOT NULL) AS kept
      FROM comp c LEFT JOIN okc o ON c.log_group = o.log_group AND c.component = o.component GROUP BY c.analysis_id)
    SELECT n.analysis_id, n.bad + 2 + CASE WHEN k.rank % 2 = 1 OR k.rank % 3 = 0 THEN 0 ELSE 1 END AS warnings,
      'degraded' AS status, coalesce(n.kept, '') AS components, CAST(2 AS BIGINT) AS causes
    FROM cnt n JOIN k50 k ON n.analysis_id = k.log_group || '#' || CAST(k.rank AS VARCHAR)""",
)
def e4_validate_analyses(spark, sf_dir):
    r = reduced(spark, sf_dir, keep_events=True)
    cleaned, _ = VA.validate_analyses(analyses(r.clusters), r.clusters, terms_of(r), GROUP)
    return cleaned.select(
        "analysis_id", "warnings", "status",
        F.array_join("affected_components", "; ").alias("components"),
        F.size("root_causes").cast("bigint").alias("causes"),
    )


@query(
    "e4_validation_warnings",
    _CLAIMS_SQL + """ SELECT analysis_id, 'unknown cluster reference' AS kind, 'ghost' || rank || ' in: seen in ' || cluster_id AS detail,
      'degraded' AS status FROM k50 WHERE rank % 3 = 1
    UNION ALL SELECT analysis_id, 'unverified root cause', 'guess ' || rank, 'degraded' FROM k50 WHERE rank % 3 = 1
    UNION ALL SELECT analysis_id, 'unsupported component', 'qqzzxx' || rank, 'degraded' FROM k50 WHERE rank % 3 = 2
    UNION ALL SELECT analysis_id, NULL, NULL, 'ok' FROM k50 WHERE rank % 3 = 0""",
)
def e4_validation_warnings(spark, sf_dir):
    """Analyses that are sound, refer to unknown clusters, or name unknown components; and why."""
    r = reduced(spark, sf_dir, keep_events=True)
    kind, number = F.col("rank") % 3, F.col("rank").cast("string")

    def cause(name: Column, statement: Column, cluster: Column) -> Column:
        evidence = F.struct(statement.alias("statement"), F.array(cluster).alias("cluster_ids"))
        return F.struct(name.alias("cause"), F.lit(0.5).alias("confidence"), F.array(evidence).alias("evidence"))

    seen = F.concat(F.lit("seen in "), "cluster_id")
    sound = cause(F.lit("cause"), seen, F.col("cluster_id"))
    guess = cause(F.concat(F.lit("guess "), number), seen, F.concat(F.lit("ghost"), number))
    claims = r.clusters.select(
        F.concat("log_group", F.lit("#"), number).alias("analysis_id"), "log_group",
        F.when(kind == 1, F.array(sound, guess)).otherwise(F.array(sound)).cast(VA.ROOT_CAUSES).alias("root_causes"),
        F.when(kind == 2, F.array("log_group", F.concat(F.lit("qqzzxx"), number))).otherwise(F.array("log_group"))
        .alias("affected_components"),
    )
    cleaned, warnings = VA.validate_analyses(claims, r.clusters, terms_of(r), GROUP)
    told = warnings.select("analysis_id", "kind", "detail")
    return cleaned.select("analysis_id", "status").join(told, "analysis_id", "left")


@query(
    "e8_score_analyses",
    WITH_CLUSTERS + """ SELECT log_group || '#' || CAST(rank AS VARCHAR) AS analysis_id,
      CAST(round((CASE WHEN exception_type = 'TideTimeout' THEN 0.4 ELSE 0 END)
        + (CASE WHEN contains(lower(coalesce(exception_type, 'none')), 'fault') OR contains(lower(coalesce(exception_type, 'none')), 'timeout') THEN 0.3
             ELSE 0 END) + (CASE WHEN log_group = '/land/gate' THEN 0 ELSE 0.2 END)
        + (CASE WHEN rank % 2 = 1 THEN 0.1 ELSE 0 END), 4) * 10000 AS BIGINT) AS score_e4
    FROM ranked WHERE rank <= 50""",
)
def e8_score_analyses(spark, sf_dir):
    found = analyses(reduced(spark, sf_dir).clusters).withColumn("case_id", F.col("log_group"))
    expected = V.logs(spark, sf_dir).select(F.col("log_group").alias("case_id")).distinct().withColumns(
        {
            "primary_exception": F.lit("TideTimeout"),
            "category_keywords": F.array(F.lit("timeout"), F.lit("fault")),
            "affected_endpoint": F.when(F.col("case_id") == "/land/gate", "no/such").otherwise("GAUGES/level"),
            "severities": F.array(F.lit("medium"), F.lit("high")),
        }
    )
    scored = O.score_analyses(found, expected)
    return scored.select("analysis_id", scaled("score").alias("score_e4"))


@query(
    "a13_volume_reduction",
    WITH_CLUSTERS + """, lines AS (SELECT log_group, CAST(sum(length(cluster_id || ' ' || event_count || ' ' || level || ' '
        || coalesce(exception_type, '-') || ' ' || substr(template, 1, 300)) + 1) - 1 AS BIGINT) AS report_chars
      FROM ranked WHERE rank <= 10 GROUP BY log_group),
    dump AS (SELECT log_group, count(*) AS events, CAST(sum(length(message) + 27) - 1 AS BIGINT) AS raw_chars
      FROM logs WHERE contains(message, 'ERROR') OR contains(message, 'error') GROUP BY log_group)
    SELECT log_group, events, raw_chars, raw_chars // 4 AS raw_tokens, report_chars, report_chars // 4 AS report_tokens,
      CAST(round((1.0 - CAST(report_chars AS DOUBLE) / raw_chars) * 100, 2) * 100 AS BIGINT) AS saved_e2
    FROM dump JOIN lines USING (log_group)""",
)
def a13_volume_reduction(spark, sf_dir):
    """What the report of the ten best clusters saves against a dump of the events."""
    line = F.concat_ws(
        " ", "cluster_id", "event_count", "level", F.coalesce("exception_type", F.lit("-")), "template"
    )
    lines = reduced(spark, sf_dir).summaries(10).groupBy("log_group").agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines")
    )
    report = lines.select("log_group", F.array_join(F.col("lines.line"), "\n").alias("evidence"))
    saved = ST.volume_reduction(errors(spark, sf_dir), report, GROUP)
    return saved.select(
        "log_group", "events", "raw_chars", "raw_tokens", "report_chars", "report_tokens",
        scaled("percent_saved", 100).alias("saved_e2"),
    )
