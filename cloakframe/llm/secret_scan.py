"""Secret scanning by patterns and by sliding-window Shannon entropy.

Only DataFrame functions are used: every text is scanned inside the task that
reads it, without a shuffle and without Python workers.

Defined results: a null text counts as empty and has no spans; repeated rows are
scanned one by one; positions are code points, ends are exclusive; an empty
table gives an empty table.  The scan reads the two named columns only, so
further columns of the input cannot clash with what it returns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import apart, let, running, spliced

# The base patterns, in the order in which kinds are listed.
KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
ASSIGN_MIN = 8


@dataclass(frozen=True)
class EntropyClass:
    """A character class: candidates are its maximal runs of at least ``window``.

    ``need`` are patterns that a candidate must contain, ``allow`` patterns that
    suppress it however high its entropy is.
    """

    name: str
    alphabet: str
    pattern: str
    window: int
    threshold: float
    need: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()


UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
PLACEHOLDERS = (r"(?i)example|sample|placeholder|dummy|changeme|x{6}", r"(?i)0123456789|123456789|abcdefgh")
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"

CLASSES = (
    EntropyClass("base64", UPPER + LOWER + DIGITS + "+/_=-", "[A-Za-z0-9+/_=-]{20,}", 20, 3.76, ("[0-9]", "[A-Z]", "[a-z]"), (UUID, *PLACEHOLDERS)),
    EntropyClass("hexrun", DIGITS + "abcdefABCDEF", "[0-9A-Fa-f]{20,}", 20, 3.02, ("[0-9]", "[A-Fa-f]"), PLACEHOLDERS),
)


@dataclass(frozen=True)
class SecretRules:
    classes: tuple[EntropyClass, ...] = field(default=CLASSES)


def _located(text: Column, pattern: str) -> Column:
    """Non-overlapping matches with code-point positions: array of (start, end, value).

    The gaps between matches come from splitting by the same pattern, which
    finds the same leftmost matches.
    """
    def place(found: Column) -> Column:
        empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda g: F.char_length(g))

        def placed(gap: Column) -> Column:
            # where a gap begins: what all gaps and matches before it come to
            begin = running(F.zip_with(gap, found, lambda g, v: g + F.char_length(v)), 0, lambda a, b: a + b)
            start = F.zip_with(begin, gap, lambda b, g: b + g)
            return F.zip_with(start, found, lambda s, v: F.struct(s.alias("start"), (s + F.char_length(v)).alias("end"), v.alias("value")))

        return F.when(F.size(found) > 0, let(gaps, placed)).otherwise(empty)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _typed(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def base_spans(text: Column) -> Column:
    """Pattern spans as array of (start, rank, end, kind)."""
    value = lambda s: F.regexp_extract(s["value"], "^" + ASSIGN, 2)
    assign = F.filter(_located(text, ASSIGN), lambda s: F.char_length(value(s)) >= ASSIGN_MIN)
    return F.concat(_typed(assign, "assign", 0), _typed(_located(text, ACCESS), "access", 1), _typed(_located(text, HEX), "hex", 2))


def hot_range(value: Column, rule: EntropyClass) -> Column:
    """First and last start of a window whose entropy reaches the threshold (-1: none).

    One pass over the characters keeps the count of each symbol in the window
    and the sum of c*log2(c), which an entering and a leaving symbol change by
    one term each; the entropy is log2(w) - sum / w.
    """
    w, size = rule.window, len(rule.alphabet)
    term = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(w + 2)])

    def scan(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            entering = F.get(codes, i)
            leaving = F.when(i >= w, F.get(codes, i - w)).otherwise(F.lit(-1))
            more, less = F.get(state["counts"], entering), F.get(state["counts"], leaving)
            gain = F.get(term, more + 1) - F.get(term, more)
            loss = F.when(leaving >= 0, F.get(term, less) - F.get(term, less - 1)).otherwise(F.lit(0.0))
            total = F.when(entering == leaving, state["total"]).otherwise(state["total"] + gain - loss)
            counts = F.when(entering == leaving, state["counts"]).otherwise(F.transform(state["counts"], lambda c, j: c + F.when(j == entering, 1).otherwise(0) - F.when(j == leaving, 1).otherwise(0)))
            hot = (i >= w - 1) & (F.lit(math.log2(w)) - total / w >= rule.threshold)
            return F.struct(
                counts.alias("counts"),
                total.alias("total"),
                F.when(hot & (state["first"] < 0), i - w + 1).otherwise(state["first"]).alias("first"),
                F.when(hot, i - w + 1).otherwise(state["last"]).alias("last"),
            )

        start = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    return let(F.transform(F.split(value, ""), lambda c: F.instr(F.lit(rule.alphabet), c) - 1), scan)


def entropy_spans(text: Column, rule: EntropyClass, rank: int) -> Column:
    """Spans from the first to the last hot window of every candidate left by the lists."""

    def fit(s: Column) -> Column:
        ok = F.lit(True)
        for p in rule.need:
            ok = ok & s["value"].rlike(p)
        for p in rule.allow:
            ok = ok & ~s["value"].rlike(p)
        return ok

    ranges = F.transform(
        F.filter(_located(text, rule.pattern), fit),
        lambda s: let(hot_range(s["value"], rule), lambda h: F.struct((s["start"] + h["first"]).alias("start"), (s["start"] + h["last"] + rule.window).alias("end"), (h["first"] >= 0).alias("hot"))),
    )
    return _typed(F.filter(ranges, lambda s: s["hot"]), f"entropy_{rule.name}", rank)


def with_secret_spans(df: DataFrame, text_col: str = "text", name: str = "secret_spans", rules: SecretRules = SecretRules()) -> DataFrame:
    """``df`` with all spans of a text, sorted by start and kind: an array of (start, rank, end, kind).

    An entropy span that overlaps a pattern span, or one of an earlier class,
    reports nothing new and is left out.  A null text has no spans.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = df.withColumn(name, base_spans(text))
    for n, rule in enumerate(rules.classes):
        df = df.withColumn("__more", entropy_spans(text, rule, 3 + n)).withColumn(name, F.concat(name, apart(F.col(name), F.col("__more"))))
    return df.withColumn(name, F.array_sort(name)).drop("__more")


def with_redaction(df: DataFrame, name: str, text_col: str = "text", mark: str = "[SECRET]", rules: SecretRules = SecretRules()) -> DataFrame:
    """``df`` with ``name``: the text with every stretch of overlapping spans replaced by one mark."""
    df = with_secret_spans(df, text_col, "__spans", rules)
    ends = F.transform("__spans", lambda s: s["end"])
    df = df.withColumn("__reach", running(ends, 0, lambda a, b: F.greatest(a, b)))
    # the spans that begin beyond all before them; each stretch ends where the next such one finds the reach
    heads = F.filter(F.zip_with("__spans", "__reach", lambda s, r: F.struct(s["start"].alias("start"), r.alias("reach"))), lambda x: x["start"] >= x["reach"])
    df = df.withColumn("__last", F.array_max(ends)).withColumn("__heads", heads)
    df = df.withColumn("__heads", F.transform("__heads", lambda x, i: F.struct(x["start"].alias("start"), F.coalesce(F.get("__heads", i + 1)["reach"], F.col("__last")).alias("end"))))
    return df.withColumn(name, spliced(F.col(f"`{text_col}`"), F.col("__heads"), lambda _: F.lit(mark))).drop("__spans", "__reach", "__last", "__heads")


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: SecretRules = SecretRules()) -> DataFrame:
    """One row per input row: (id, secret_spans array of (start, rank, end, kind))."""
    return with_secret_spans(df.select(F.col(id_col), F.col(text_col).alias("__text")), "__text", rules=rules).drop("__text")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
