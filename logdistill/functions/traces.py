"""Stack traces as Column functions.

A parsed trace is ``array<struct<exception_type, exception_message,
frames:array<struct<file,line,function>>>>`` with the outermost exception first
and the root (the one printed first) last.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logdistill.functions import patterns as P
from logdistill.functions.text import LINE_BREAK, first_match, strip

FRAME_TYPE = "struct<file:string,line:bigint,function:string>"
EXCEPTION_TYPE = (
    f"struct<exception_type:string,exception_message:string,frames:array<{FRAME_TYPE}>>"
)
TRACE_TYPE = f"array<{EXCEPTION_TYPE}>"


@dataclass(frozen=True)
class TraceParser:
    """An extension point: a predicate on the message and a Column giving ``TRACE_TYPE``."""

    name: str
    matches: Callable[[Column], Column]
    parse: Callable[[Column], Column]


def _token(line: Column) -> Column:
    """A frame (file set) or an exception line (exception_type set); else both null."""
    text = strip(line)
    return F.struct(
        first_match(line, P.TRACE_FRAME, 1).alias("file"),
        first_match(line, P.TRACE_FRAME, 2).try_cast("bigint").alias("line"),
        first_match(line, P.TRACE_FRAME, 3).alias("function"),
        first_match(text, P.TRACE_EXCEPTION, 1).alias("exception_type"),
        strip(F.regexp_extract(text, P.TRACE_EXCEPTION, 2)).alias("exception_message"),
    )


def _close(state: Column, token: Column) -> Column:
    """An exception line ends the frames before it; without frames it is ordinary text."""
    frame = F.struct(token["file"], token["line"], token["function"]).cast(FRAME_TYPE)
    done = F.struct(
        token["exception_type"], token["exception_message"], state["frames"]
    ).cast(EXCEPTION_TYPE)
    none = F.array().cast(f"array<{FRAME_TYPE}>")
    return (
        F.when(
            token["file"].isNotNull(),
            F.struct(
                F.concat(state["frames"], F.array(frame)).alias("frames"),
                state["done"].alias("done"),
            ),
        )
        .when(
            F.size(state["frames"]) > 0,
            F.struct(none.alias("frames"), F.concat(state["done"], F.array(done)).alias("done")),
        )
        .otherwise(state)
    )


def parse_python_trace(message: Column) -> Column:
    lines = F.filter(F.split(message, LINE_BREAK), lambda line: line.rlike(P.TRACE_LINE))
    tokens = F.filter(
        F.transform(lines, _token),
        lambda t: t["file"].isNotNull() | t["exception_type"].isNotNull(),
    )
    start = F.struct(
        F.array().cast(f"array<{FRAME_TYPE}>").alias("frames"),
        F.array().cast(TRACE_TYPE).alias("done"),
    )
    printed = F.aggregate(tokens, start, _close, lambda s: F.reverse(s["done"]))
    return F.filter(printed, lambda e: e["exception_type"].isNotNull())


PYTHON = TraceParser(
    "python",
    lambda m: m.contains(P.TRACE_HEADER_LITERAL) & m.rlike(P.TRACE_HEADER),
    parse_python_trace,
)
PARSERS: tuple[TraceParser, ...] = (PYTHON,)


def parse_trace(message: Column, parsers: Sequence[TraceParser] = PARSERS) -> Column:
    """The first parser that matches and finds an exception decides; else null."""
    tries = []
    for parser in parsers:
        parsed = F.when(parser.matches(message), parser.parse(message)).cast(TRACE_TYPE)
        tries.append(F.nullif(parsed, F.array().cast(TRACE_TYPE)))
    return F.coalesce(*tries)


def trace_root(trace: Column) -> Column:
    return F.element_at(trace, -1)


def trace_chain(trace: Column) -> Column:
    """``Outermost>...>Root``."""
    return F.array_join(F.transform(trace, lambda e: e["exception_type"]), ">")


def root_frames(trace: Column, keep: int = P.FINGERPRINT_FRAMES) -> Column:
    """The last frames of the root exception as ``file:function``, without line numbers."""
    frames = trace_root(trace)["frames"]
    tail = F.slice(frames, F.greatest(F.size(frames) - (keep - 1), F.lit(1)), keep)
    names = F.transform(
        tail, lambda f: F.concat(f["file"], F.lit(":"), F.coalesce(f["function"], F.lit("?")))
    )
    return F.array_join(names, "|")
