"""Typed fields out of messages: JSON keys, endpoint, status, level, exception, times."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from logdistill.functions import patterns as P
from logdistill.functions.text import WS, first_match, normalize_endpoint, strip


def json_fields(message: Column) -> Column:
    """``map<string,variant>`` of a message that is one JSON object, else null.

    Variants keep the difference between "502" and 502, which the key rules need.
    """
    braces = message.rlike(f"^{WS}*\\{{") & message.rlike(f"\\}}{WS}*$")
    return F.when(braces, F.try_parse_json(strip(message)).try_cast("map<string,variant>"))


def _string(fields: str, key: str) -> str:
    """SQL for a field's value if it is a non-empty JSON string."""
    value = f"{fields}['{key}']"
    return f"if(schema_of_variant({value}) = 'STRING', nullif(cast({value} AS string), ''), null)"


def _coalesce(parts: Iterable[str]) -> Column:
    return F.expr(f"coalesce({', '.join(parts)})")


def first_string(fields: str, keys: Sequence[str]) -> Column:
    """The first non-empty string among the keys of a map column; numbers do not count."""
    return _coalesce(_string(fields, k) for k in keys)


def json_endpoint(fields: str) -> Column:
    """The first candidate key holding a path, not yet redacted or normalised."""
    paths = (_string(fields, k) for k in P.ENDPOINT_KEYS)
    return _coalesce(f"if(startswith({p}, '/'), {p}, null)" for p in paths)


def json_status(fields: str) -> Column:
    """The first candidate key holding an integer, or digits in a string, from 100 to 599."""

    def code(key: str) -> str:
        value = f"{fields}['{key}']"
        number = f"try_cast(try_cast({value} AS string) AS int)"
        whole = (
            f"schema_of_variant({value}) = 'BIGINT' OR (schema_of_variant({value}) = 'STRING'"
            f" AND cast({value} AS string) RLIKE '^[0-9]+$')"
        )
        return f"if(({whole}) AND {number} BETWEEN 100 AND 599, {number}, null)"

    return _coalesce(code(k) for k in P.STATUS_KEYS)


def text_endpoint(message: Column) -> Column:
    return first_match(message, P.ENDPOINT_IN_TEXT)


def endpoint(message: Column, from_json: Column) -> Column:
    return normalize_endpoint(F.coalesce(from_json, text_endpoint(message)))


def status_code(message: Column, from_json: Column) -> Column:
    return F.coalesce(from_json, first_match(message, P.STATUS_IN_TEXT).cast("int"))


def level(message: Column, from_json: Column) -> Column:
    word = first_match(message, P.LEVEL_IN_TEXT)
    return F.coalesce(from_json, F.when(word == "WARN", "WARNING").otherwise(word))


def exception_in_text(message: Column) -> Column:
    return first_match(message, P.EXCEPTION_IN_TEXT)


def parse_utc(text: Column) -> Column:
    """ISO-like text to a timestamp; times without an offset are UTC, bad ones null."""
    iso = text.rlike(
        r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    )
    dotted = F.regexp_replace(text, ",", ".")
    zoned = F.when(dotted.rlike(r"(Z|:\d{2}[.0-9]*[+-]\d{2}:?\d{2})$"), dotted).when(
        F.length(dotted) == 10, F.concat(dotted, F.lit("T00:00:00Z"))
    ).otherwise(F.concat(dotted, F.lit("Z")))
    return F.when(iso, zoned.try_cast("timestamp"))
