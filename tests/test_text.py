"""Text rules: every rule with texts it takes and near misses it must leave alone."""

from __future__ import annotations

import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from logdistill.config import Config, Rule
from logdistill.functions import patterns as P
from logdistill.functions.text import active_rules, glob_regex, normalize_text, redact_text, strip
from logdistill.operators.enrich import redaction_report

PEM = "-----BEGIN EC PRIVATE KEY-----\nq0q0\nq1q1\n-----END EC PRIVATE KEY-----"

# rule, text it changes, the result, a near miss
REDACTED = [
    ("private_key_block", f"a {PEM} b", "a [REDACTED_PRIVATE_KEY] b", PEM.replace("PRIVATE", "PUBLIC")),
    ("aws_access_key", "use AROA" + "Q7" * 8, "use [REDACTED_AWS_KEY]", "use AROA" + "Q7" * 7),
    ("aws_secret_key_assignment", "SECRET_ACCESS_KEY: m/n+o", "SECRET_ACCESS_KEY: [REDACTED]", "secret_access_key m/n+o"),
    ("jwt", "(eyJ0123456789.mnop.)", "([REDACTED_JWT])", "(eyJ0123.mnop.)"),
    ("bearer_token", "BEARER q/w-e~r_t+y", "BEARER [REDACTED]", "bearer q/w-e~r"),
    ("authorization_header", "authorization='Digest abc', x", "authorization='[REDACTED]', x", "authorizations: 3"),
    ("url_credentials", "amqp://buoy:t1de@q:5672", "amqp://buoy:[REDACTED]@q:5672", "amqp://buoy@q:5672"),
    ("keyvalue_secret", "Client-Secret = tide;x=1", "Client-Secret = [REDACTED];x=1", "secretary = tide"),
    ("cookie_header", "Set-Cookie: a=1; b=2\nnext", "Set-Cookie: [REDACTED]\nnext", "cookies a=1"),
    ("github_token", "ghu_" + "Zz9" * 7, "[REDACTED_TOKEN]", "ghx_" + "Zz9" * 7),
    ("slack_token", "xoxp-" + "7-q" * 4, "[REDACTED_TOKEN]", "xoxp-7-q"),
]


def column(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_every_secret_rule_has_a_sample():
    assert [name for name, *_ in REDACTED] == [r.name for r in P.SECRET_RULES]


def test_secret_rules(spark):
    changed = column(spark, [t for _, t, _, _ in REDACTED], redact_text)
    assert changed == [want for _, _, want, _ in REDACTED]
    misses = [m for *_, m in REDACTED]
    assert column(spark, misses, redact_text) == misses
    assert column(spark, changed, redact_text) == changed


@pytest.mark.parametrize(
    ("switches", "want"),
    [
        ({}, "crew [EMAIL] via 172.16.0.9, tel +44 20 7946 0018"),
        ({"redact_emails": False}, "crew skipper@tide.example via 172.16.0.9, tel +44 20 7946 0018"),
        ({"redact_ips": True}, "crew [EMAIL] via [IP], tel +44 20 7946 0018"),
        ({"redact_phones": True}, "crew [EMAIL] via 172.16.0.9, tel [PHONE]"),
    ],
)
def test_personal_data(spark, switches, want):
    text = "crew skipper@tide.example via 172.16.0.9, tel +44 20 7946 0018"
    assert column(spark, [text], lambda c: redact_text(c, Config(**switches))) == [want]


def test_own_rules_come_before_personal_data(spark):
    cfg = Config(extra_rules=(Rule("call sign", "skipper@", "nobody@"),))
    assert column(spark, ["skipper@tide"], lambda c: redact_text(c, cfg)) == ["nobody@tide"]
    assert column(spark, ["skipper@tide.example"], lambda c: redact_text(c, cfg)) == ["[EMAIL]"]


# rule of the template, text, template
SLOTS = [
    ("iso_timestamp", "tide at 1999-12-31 23:59:59,5+0100", "tide at <TIMESTAMP>"),
    ("clock_time", "at 7:05:09.25 high", "at <TIME> high"),
    ("syslog_date", "Mon Feb 17 05:06:07 2025 low", "<TIMESTAMP> low"),
    ("uuid", "of 0A1b2C3d-0000-ffff-9999-0123456789aB", "of <UUID>"),
    ("hash", "sum 00ff00ff00ff", "sum <HASH>"),
    ("address", "ptr 0xBADC0DE", "ptr <ADDR>"),
    ("ip", "peer 192.0.2.33:70", "peer <IP>"),
    ("port", "buoy9:4711 [x]:99", "buoy9:<PORT> [x]:<PORT>"),
    ("quantity", "8.25 sec, 12KB", "<NUM> sec, <NUM>KB"),
    ("long_number", "seq 90210", "seq <ID>"),
    ("single_quoted_number", "bin '17'", "bin '<ID>'"),
    ("double_quoted_number", 'bin "0099"', 'bin "<ID>"'),
    ("path_segment", "PUT /buoys/12/tides?x", "PUT /buoys/<id>/tides?x"),
]
# Texts of which nothing, or only the marked part, may go.
PLAIN = {
    "bin '12345x' of 17 /v2/x": "bin '12345x' of 17 /v2/x",
    "status: 204, returned 301, code 599": "status: 204, returned 301, code 599",
    "status 604 code 99 returned 1234": "status <ID> code 99 returned <ID>",
    'HTTP/1.1" 418 of 419': 'HTTP/1.1" 418 of <ID>',
    "  ebb\t\tand   flow ": "ebb and flow",
}


def test_every_template_rule_has_a_sample():
    assert [name for name, *_ in SLOTS] == [r.name for r in P.TEMPLATE_RULES]


def test_templates(spark):
    out = column(spark, [t for _, t, _ in SLOTS], normalize_text)
    assert out == [want for _, _, want in SLOTS]
    assert column(spark, list(PLAIN), normalize_text) == list(PLAIN.values())


def by_another_engine(text: str, rules) -> str:
    for rule in rules:
        text = re.sub(rule.pattern, rule.replacement.replace("$", "\\"), text)
    return text


def test_rules_agree_with_another_regex_engine_on_real_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cfg = Config(redact_phones=True, redact_ips=True)
    rows = docs.select(
        "text", redact_text(F.col("text"), cfg), redact_text(F.col("text")), normalize_text(F.col("text")),
    ).collect()
    for text, everything, secrets, template in rows:
        assert everything == by_another_engine(text, active_rules(cfg))
        assert secrets == by_another_engine(text, active_rules())
        slotted = by_another_engine(text, P.TEMPLATE_RULES)
        # Numbers go piece by piece between the guarded status codes.
        out, at = [], 0
        for m in re.finditer(P.STATUS_GUARD, slotted):
            out += [slotted[at : m.start()], m[0]]
            at = m.end()
        out.append(slotted[at:])
        want = "".join(p if i % 2 else re.sub(P.REMAINING_NUMBER, "<ID>", p) for i, p in enumerate(out))
        assert template == re.sub(P.BLANK_RUN, " ", want).strip()


def test_strip_takes_every_blank(spark):
    assert column(spark, ["\x1d\t tide table \r\n", "", " "], strip) == ["tide table", "", ""]


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("/buoy/*", ["/buoy/", "/buoy/n/1"], ["/Buoy/n", "buoy/n"]),
        ("t?de", ["tide", "t.de"], ["tde", "tiide"]),
        ("v1.2", ["v1.2"], ["v1x2"]),
        ("[n-p]*", ["north", "p"], ["south", ""]),
        ("[!n]x", ["sx"], ["nx"]),
        ("open[", ["open["], ["open"]),
    ],
)
def test_globs(pattern, yes, no):
    regex = re.compile(glob_regex(pattern).replace(r"\A", "").replace(r"\z", ""))
    assert all(regex.fullmatch(x) for x in yes) and not any(regex.fullmatch(x) for x in no)


def test_the_report_reads_texts_only_where_a_rule_may_match(spark, monkeypatch):
    """The same counts as with every rule on every text, also where replacements bring in words."""
    texts = [
        "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----: 'a'", "AKIA" + "A1" * 8, "Aws_Secret_Access_KEY = zz",
        "eyJhbGciOiJI.eyJzdWIi.sig", "BEARER abcdefgh12", "Authorization: Basic zzz", "ftp://me:pw@host", "Session-ID=4; api_key: 'x'",
        "Set-Cookie: a=b\ntoken=1", "ghp_" + "a" * 24, "xoxb-1234567890", "me@sea.example", "+49 (30) 123 4567 or 10.0.0.7",
        "quiet", "", None, "secret" + "K" + "ey=1", "eyJhbGciOiJI.eyJzdWIi.sig=" + "AKIA" + "B2" * 8 + "] = 7",
    ]
    cfg = Config(redact_phones=True, redact_ips=True, extra_rules=(Rule("q", "qu(i)et", "$1"),))
    docs = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)] + [(9, None)], "scope int, message string")
    report = redaction_report(docs, ("scope",), "message", cfg)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, report.collect()), key=repr)
    monkeypatch.setattr(P, "RULE_TRIGGERS", {})
    monkeypatch.setattr(P, "RULE_PARTS", {})
    assert got == sorted(map(tuple, redaction_report(docs, ("scope",), "message", cfg).collect()), key=repr)
    assert {r[1] for r in got if r[2]} == {r.name for r in active_rules(cfg)}
    assert plan.count("Contains(") >= 11
