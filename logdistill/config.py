"""Budgets and switches shared by every job."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """One text replacement: a Java regex and its ``$n`` style replacement."""

    name: str
    pattern: str
    replacement: str


@dataclass(frozen=True)
class Config:
    """Defaults a job starts from; override single fields with ``dataclasses.replace``.

    ``query_limit`` only applies where a capped retrieval is the point of the
    operator (search, slicing, coverage).  Clustering reads everything.
    """

    max_clusters: int | None = 50
    report_clusters: int = 10
    evidence_clusters: int = 10
    max_examples: int = 3
    example_chars: int = 800
    evidence_chars: int = 40_000
    trace_events: int = 100
    max_slices: int = 12
    query_limit: int = 5_000
    max_window_minutes: int = 120
    redact_emails: bool = True
    redact_phones: bool = False
    redact_ips: bool = False
    extra_rules: tuple[Rule, ...] = ()


DEFAULTS = Config()
