"""Text rules as Column functions: strip, redaction, templates, rule hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logdistill.config import DEFAULTS, Config, Rule
from logdistill.functions import patterns as P

# Everything that counts as blank when text is stripped, ASCII or not.
WS = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_NOT_WS = "[^" + WS[1:]
# Marks a protected status code while the other numbers are replaced.
_GUARD = "\ue000_"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def not_blank(text: Column) -> Column:
    return text.rlike(_NOT_WS)


def non_empty(text: Column) -> Column:
    """The text, or null when it is the empty string."""
    return F.nullif(text, F.lit(""))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match of a pattern, or null when there is none."""
    return non_empty(F.regexp_extract(text, pattern, group))


def active_rules(cfg: Config = DEFAULTS) -> list[Rule]:
    """Redaction rules in order: secrets, extra rules, then the optional personal data."""
    rules = [*P.SECRET_RULES, *cfg.extra_rules]
    if cfg.redact_emails:
        rules.append(P.EMAIL_RULE)
    if cfg.redact_phones:
        rules.append(P.PHONE_RULE)
    if cfg.redact_ips:
        rules.append(P.IP_RULE)
    return rules


def apply_rules(text: Column, rules: list[Rule] | tuple[Rule, ...]) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, r.pattern, r.replacement), rules, text)


def redact_text(text: Column, cfg: Config = DEFAULTS) -> Column:
    """Run the active rules; texts without any trigger word skip the whole chain.

    The shortcut only holds for the built-in secret and email rules, so it is
    switched off when number-shaped or user-defined rules take part.
    """
    rules = active_rules(cfg)
    chain = apply_rules(text, rules)
    if cfg.extra_rules or cfg.redact_phones or cfg.redact_ips:
        return chain
    lowered = F.lower(text)
    hit = reduce(lambda a, b: a | b, [lowered.contains(t) for t in P.REDACTION_TRIGGERS])
    return F.when(hit, chain).otherwise(text)


def normalize_text(text: Column) -> Column:
    """Collapse per-request values to placeholders, keeping status codes readable."""
    text = apply_rules(text, P.TEMPLATE_RULES)
    text = F.regexp_replace(text, P.STATUS_GUARD, "$1" + _GUARD + "$2")
    text = F.regexp_replace(text, P.REMAINING_NUMBER, "<ID>")
    text = F.replace(text, F.lit(_GUARD), F.lit(""))
    return strip(F.regexp_replace(text, P.BLANK_RUN, " "))


def normalize_endpoint(path: Column) -> Column:
    return F.regexp_replace(path, P.ENDPOINT_NUMBER, "<id>")


def glob_regex(pattern: str) -> str:
    """Anchored Java regex of a shell glob; ``*`` and ``?`` also match ``/``."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2 + pattern.startswith("[!", i)) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[")
            body = body.replace("&", "\\&").replace("^", "\\^")
            out.append("[^" + body[1:].replace("]", "\\]") + "]" if body[0] == "!"
                       else "[" + body.replace("]", "\\]") + "]")
            i = close
        else:
            out.append(ch if ch.isalnum() or ch in "_/ " else "\\" + ch)
        i += 1
    return "(?s)\\A" + "".join(out) + "\\z"


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts, one per line, null as empty."""
    joined = F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 16)
