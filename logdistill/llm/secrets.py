"""Secret scans: fixed kinds by pattern, and windows of high entropy per character class.

Candidates of a class are maximal runs of its characters that hold the required kinds of
characters.  A window of fixed width slides over each; its Shannon entropy follows from
the sum of c*log2(c) over the counts c of its characters, and that sum changes only by
the count of the character that enters and of the one that leaves.  A candidate is
reported when its best window reaches the bound of the class, unless an allow-list
pattern matches it or it overlaps a span found by pattern.

All of it is column functions over one scan; nothing is shuffled, so hot documents do not
matter.  Cases: a null text is empty; offsets count code points, ends exclusive; rows
with equal ids each get their row; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the pattern kinds, in their order.
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# Runs shorter than the least length never count, and a maximal run starts no later match.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6


@dataclass(frozen=True)
class CharClass:
    """Runs of at least ``width`` characters; ``bits`` is the least entropy of a window."""

    name: str
    pattern: str
    width: int
    bits: float


# Digests announced as such are no secrets.
_NO_DIGEST = r"(?<!(?:sha1|sha256|sha384|sha512|md5):)"
CLASSES = (
    CharClass("hex", _NO_DIGEST + r"(?<![0-9A-Za-z])(?=[0-9A-F]*[0-9])(?=[0-9A-F]*[A-F])[0-9A-F]{20,}(?![0-9A-Za-z])", 20, 2.9),
    CharClass(
        "mixed",
        _NO_DIGEST + r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}",
        20, 3.6,
    ),
    CharClass(
        "lower",
        _NO_DIGEST + r"(?<![A-Za-z0-9_-])(?=[a-z_-]*[0-9])(?=[0-9_-]*[a-z])[a-z0-9_-]{20,}={0,2}(?![A-Za-z0-9_-])", 20, 3.5,
    ),
    CharClass(
        "upper",
        _NO_DIGEST + r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{20,}={0,6}(?![A-Za-z0-9])", 20, 3.5,
    ),
)
ALLOW = (
    r"(?i)^(sha(1|256|384|512)|md5)-",
    r"(?i)abcdefghij|0123456789|example|placeholder|lorem",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[A-Za-z/_-]+[0-9]{0,4}$",
    # Words with one or two short numbers between them, as in addresses of articles.
    r"^[a-z]+(?:[_-][a-z]+)*(?:[_-][0-9]{1,4}(?:[_-][a-z]+)*){1,2}$",
)
KINDS = ("assign", "access", "hex", "entropy")
SPAN = "struct<start:int,end:int,kind:int,text:string>"


def match_spans(text: Column, pattern: str, kind: int) -> Column:
    """Spans of all leftmost non-overlapping matches, in code points.

    The pieces between matches come from splitting at the same pattern, so places follow
    by adding up lengths.
    """
    none = F.array().cast(f"array<{SPAN}>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.char_length(pair["piece"])
        end = begin + F.char_length(pair["hit"])
        span = F.struct(
            begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), pair["hit"].alias("text")
        )
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    pairs = F.transform(
        matches, lambda m, i: F.struct(F.get(pieces, i).alias("piece"), m.alias("hit"))
    )
    return F.when(
        F.regexp_like(text, F.lit(pattern)), F.aggregate(pairs, start, step, lambda acc: acc["spans"])
    ).otherwise(none)


def _clog(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def best_entropy(run: Column, width: int) -> Column:
    """The largest entropy, in bits, of a window of ``width`` characters over ``run``."""

    def slide(chars: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            # The window without its first character, before the new one enters.
            kept = F.slice(chars, F.greatest(i - width + 2, F.lit(1)), F.least(i, F.lit(width - 1)))
            n_in = F.size(F.filter(kept, lambda c: c == F.get(chars, i)))
            n_out = F.size(F.filter(kept, lambda c: c == F.get(chars, i - width)))
            leaves = F.when(i >= width, _clog(n_out + 1) - _clog(n_out)).otherwise(F.lit(0.0))
            total = acc["sum"] - leaves + _clog(n_in + 1) - _clog(n_in)
            entropy = F.log2(F.lit(float(width))) - total / F.lit(float(width))
            best = F.when(i >= width - 1, F.greatest(acc["best"], entropy)).otherwise(acc["best"])
            return F.struct(total.alias("sum"), best.alias("best"))

        begin = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
        places = F.sequence(F.lit(0), F.greatest(F.size(chars), F.lit(1)) - 1)
        return F.aggregate(places, begin, step, lambda acc: acc["best"])

    # The one-element array binds the characters once for all steps.
    return F.get(F.transform(F.array(F.split(run, "")), slide), 0)


def _allowed(run: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOW:
        out = out | F.regexp_like(run, F.lit(pattern))
    return out


def entropy_spans(text: Column, base: Column, classes: tuple[CharClass, ...] = CLASSES) -> Column:
    def of(c: CharClass) -> Column:
        def secret(s: Column) -> Column:
            # Entropy is taken of runs that nothing allows only.
            best = F.when(~_allowed(s["text"]), best_entropy(s["text"], c.width))
            return F.coalesce(best >= c.bits, F.lit(False))

        return F.filter(match_spans(text, c.pattern, KINDS.index("entropy")), secret)

    # Several classes may find a secret or a part of it: the longest span stays.
    def longest(spans: Column) -> Column:
        def inside(s: Column, o: Column) -> Column:
            longer = (o["end"] - o["start"]) > (s["end"] - s["start"])
            return longer & (o["start"] <= s["start"]) & (s["end"] <= o["end"])

        return F.filter(spans, lambda s: ~F.exists(spans, lambda o: inside(s, o)))

    found = F.filter(
        F.array_distinct(F.concat(*[of(c) for c in classes])),
        lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    # The one-element array binds the spans once.
    return F.get(F.transform(F.array(found), longest), 0)


def find_secrets(docs: DataFrame, classes: tuple[CharClass, ...] = CLASSES) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: sorted arrays of (start, end, kind, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assigns = F.filter(
        match_spans(text, ASSIGN, 0),
        lambda s: F.char_length(F.regexp_extract(s["text"], ASSIGN, 2)) >= ASSIGN_VALUE,
    )
    base = F.array_sort(F.concat(assigns, match_spans(text, ACCESS, 1), match_spans(text, HEX, 2)), _order)
    found = docs.withColumn("base", base)
    more = entropy_spans(text, F.col("base"), classes)
    return found.withColumn("spans", F.array_sort(F.concat(F.col("base"), more), _order))


def _order(a: Column, b: Column) -> Column:
    def way(x: Column, y: Column, then: Column) -> Column:
        return F.when(x < y, -1).when(x > y, 1).otherwise(then)

    return way(a["start"], b["start"], way(a["kind"], b["kind"], way(a["end"], b["end"], F.lit(0))))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def secret_documents(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs.select("doc_id", "text"))

    def n_of(kind: int) -> Column:
        own = F.filter("base", lambda s: s["kind"] == kind)
        return F.size(own).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select(
        "doc_id", n_of(0), n_of(1), n_of(2), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
