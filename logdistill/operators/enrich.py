"""Field extraction, redaction and enrichment passes over event tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logdistill.config import DEFAULTS, Config
from logdistill.functions import fields as X
from logdistill.functions import patterns as P
from logdistill.functions.text import (
    active_rules,
    fingerprint,
    non_empty,
    normalize_text,
    redact_text,
)
from logdistill.functions.traces import (
    PARSERS,
    TraceParser,
    parse_trace,
    root_frames,
    trace_chain,
    trace_root,
)


def parse_json_message(events: DataFrame) -> DataFrame:
    """Add ``parsed_fields``: the message's JSON object as a map, else null."""
    return events.withColumn("parsed_fields", X.json_fields(F.col("message")))


def extract_fields(events: DataFrame) -> DataFrame:
    """Level, ids, service, endpoint and status candidates from JSON messages.

    Runs on the raw message.  The parsed object itself is not kept: the six values
    are all the later passes need.  Tables that already state a level, an id or a
    service keep their own value where there is one.
    """
    fields = "parsed_fields"
    values = {
        "level": F.upper(X.first_string(fields, P.LEVEL_KEYS)),
        "request_id": X.first_string(fields, P.REQUEST_ID_KEYS),
        "trace_id": X.first_string(fields, P.TRACE_ID_KEYS),
        "service": X.first_string(fields, P.SERVICE_KEYS),
        "json_endpoint": X.json_endpoint(fields),
        "json_status": X.json_status(fields),
    }
    # One branch for all keys, so that plain text messages skip them together.
    found = F.when(F.col(fields).isNotNull(), F.struct(*[v.alias(n) for n, v in values.items()]))
    stated = [n for n in values if n in events.columns]

    def value(name: str) -> Column:
        inside = F.col(f"__json.{name}")
        if name not in stated or name.startswith("json_"):
            return inside.alias(name)
        own = non_empty(F.col(name).cast("string"))
        return F.coalesce(F.upper(own) if name == "level" else own, inside).alias(name)

    return (
        parse_json_message(events)
        .withColumn("__json", found)
        .select(*[c for c in events.columns if c not in stated], *[value(n) for n in values])
    )


def redact(
    events: DataFrame, columns: Sequence[str] = ("message",), cfg: Config = DEFAULTS
) -> DataFrame:
    """Redact text columns and the top-level string values of ``parsed_fields``.

    Nested JSON values and every other column stay as they are.
    """
    changes = {c: redact_text(F.col(c), cfg) for c in columns if c in events.columns}
    if "parsed_fields" in events.columns:
        changes["parsed_fields"] = F.transform_values(
            "parsed_fields",
            lambda _, v: F.when(
                F.schema_of_variant(v) == "STRING",
                redact_text(v.cast("string"), cfg).cast("variant"),
            ).otherwise(v),
        )
    return events.withColumns(changes)


def redaction_report(
    events: DataFrame, scope: Sequence[str], text: str = "message", cfg: Config = DEFAULTS
) -> DataFrame:
    """Replacements per rule and scope, each rule counted on the text the earlier ones left.

    A rule runs on texts that hold what it cannot do without, and replaces where it counts.
    Words that replacements bring in count as held, so texts once changed are always read.
    """
    rules = active_rules(cfg)
    df = events.select(
        *scope, F.col(text).alias("__text"), F.lower(F.col(text)).alias("__lowered"), F.lit(False).alias("__changed")
    )
    for i, rule in enumerate(rules):
        hits = F.regexp_count("__text", F.lit(rule.pattern))
        if rule.pattern in P.RULE_TRIGGERS:
            held = [F.col("__lowered").contains(t) for t in P.RULE_TRIGGERS[rule.pattern]]
            hits = F.when(~(reduce(lambda a, b: a | b, held) | F.col("__changed")), 0).otherwise(hits)
        elif rule.pattern in P.RULE_PARTS:
            hits = F.when(~F.col("__text").rlike(P.RULE_PARTS[rule.pattern]), 0).otherwise(hits)
        hit = F.col(f"__hits_{i}") > 0
        df = df.withColumn(f"__hits_{i}", hits).withColumns(
            {
                "__text": F.when(hit, F.regexp_replace("__text", rule.pattern, rule.replacement)).otherwise(F.col("__text")),
                "__changed": F.col("__changed") | F.coalesce(hit, F.lit(False)),
            }
        )
    totals = df.groupBy(*scope).agg(
        *[F.sum(f"__hits_{i}").alias(f"__hits_{i}") for i in range(len(rules))],
        *[F.count_if(F.col(f"__hits_{i}") > 0).alias(f"__rows_{i}") for i in range(len(rules))],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule"),
                F.col(f"__hits_{i}").cast("bigint").alias("hits"),
                F.col(f"__rows_{i}").alias("rows_hit"),
            )
            for i, r in enumerate(rules)
        ]
    )
    return totals.select(*scope, F.inline(entries))


def normalize(events: DataFrame, text: str = "message", into: str = "template") -> DataFrame:
    return events.withColumn(into, normalize_text(F.col(text)))


def enrich(
    events: DataFrame, cfg: Config = DEFAULTS, parsers: Sequence[TraceParser] = PARSERS
) -> DataFrame:
    """Endpoint, status, level, exception, template and fingerprint of redacted events."""
    nothing = {"level": "string", "json_endpoint": "string", "json_status": "int"}
    missing = {c: F.lit(None).cast(t) for c, t in nothing.items() if c not in events.columns}
    message, trace = F.col("message"), F.col("__trace")
    root = trace_root(trace)
    traced = events.withColumns({**missing, "__trace": parse_trace(message, parsers)})
    named = traced.withColumns(
        {
            "endpoint": X.endpoint(message, F.col("json_endpoint")),
            "status_code": X.status_code(message, F.col("json_status")),
            "level": X.level(message, non_empty(F.col("level"))),
            "exception_type": F.coalesce(
                root["exception_type"],
                F.when(trace.isNull(), X.exception_in_text(message)),
            ),
            "template": normalize_text(
                F.when(
                    trace.isNotNull(),
                    F.concat(root["exception_type"], F.lit(": "), root["exception_message"]),
                ).otherwise(message)
            ),
        }
    )
    by_trace = fingerprint(trace_chain(trace), root_frames(trace), F.col("template"))
    by_message = fingerprint(
        F.col("exception_type"), F.col("template"), F.col("endpoint"), F.col("status_code")
    )
    return named.withColumn(
        "fingerprint", F.when(trace.isNotNull(), by_trace).otherwise(by_message)
    ).drop("__trace", "json_endpoint", "json_status")


def prepare(
    events: DataFrame, cfg: Config = DEFAULTS, parsers: Sequence[TraceParser] = PARSERS
) -> DataFrame:
    """Raw events to enriched ones: JSON fields, then redaction, then enrichment."""
    return enrich(redact(extract_fields(events), ("message", "json_endpoint"), cfg), cfg, parsers)


def explode_exceptions(
    events: DataFrame, keep: Sequence[str], parsers: Sequence[TraceParser] = PARSERS
) -> DataFrame:
    """One row per exception of every traceback.

    ``exception_no`` counts from the outermost exception, ``from_root`` from the root.
    The outer explode keeps the optimizer from parsing once more in a filter below.
    """
    parsed = events.select(*keep, parse_trace(F.col("message"), parsers).alias("__trace"))
    rows = parsed.select(
        *keep,
        trace_chain(F.col("__trace")).alias("chain"),
        F.size("__trace").alias("chain_length"),
        F.posexplode_outer("__trace").alias("exception_no", "e"),
    ).where(F.col("e").isNotNull())
    return rows.select(
        *keep,
        "chain",
        "chain_length",
        "exception_no",
        (F.col("chain_length") - 1 - F.col("exception_no")).alias("from_root"),
        "e.*",
    )


def explode_traces(
    events: DataFrame, keep: Sequence[str], parsers: Sequence[TraceParser] = PARSERS
) -> DataFrame:
    """One row per frame of every traceback; ``frame_no`` counts in printed order."""
    exceptions = explode_exceptions(events, keep, parsers)
    rest = [c for c in exceptions.columns if c != "frames"]
    return exceptions.select(*rest, F.posexplode("frames").alias("frame_no", "f")).select(
        "*", "f.file", "f.line", "f.function"
    ).drop("f")


def hot_frames(events: DataFrame, scope: Sequence[str], top: int | None = None) -> DataFrame:
    """How often each (file, function) occurs in tracebacks, most frequent first per scope."""
    frames = explode_traces(events, scope)
    counts = frames.groupBy(*scope, "file", "function").agg(F.count(F.lit(1)).alias("hits"))
    if top is None:
        return counts
    order = Window.partitionBy(*scope).orderBy(F.desc("hits"), "file", "function")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def chain_counts(
    events: DataFrame, scope: Sequence[str], parsers: Sequence[TraceParser] = PARSERS
) -> DataFrame:
    """How often each exception chain occurs per scope."""
    outermost = explode_exceptions(events, scope, parsers).where(F.col("exception_no") == 0)
    return outermost.groupBy(*scope, "chain").agg(F.count(F.lit(1)).alias("events"))
