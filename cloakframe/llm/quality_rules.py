"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1), strongly bad (-2) or abstains (0).  A
document is good or has one of the defects that the rules name.  Expectation
maximisation over the counts of vote patterns estimates how common each is and
how every rule votes on it, that is its accuracy; a document's posterior
probability of being good replaces "all rules must pass".  No label is used.

Only DataFrame functions touch rows.  The statistics cover all rows: they are
counted by vote pattern, and the estimate is made from these counts, of which
there are at most 4 ** len(RULES) however large the corpus is.

Defined results: a null or blank text has no words and is failed by the hard
limits; repeated rows are judged alike; an empty table gives an empty table.
The operator reads the id and text columns only.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import checkpointed, let, quoted, words

SYMBOLS = r"[#*$%&|<>]"
LONE = r"(?<![^\x20\x09-\x0D])[#*$%&|<>]+(?![^\x20\x09-\x0D])"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def _covered(keys: Column, width: int) -> Column:
    """Positions inside windows whose key occurs twice or more, first one included."""

    def count(ordered: Column) -> Column:
        n = F.size(ordered)
        same = lambda i, j: F.get(ordered, i)["key"] == F.get(ordered, j)["key"]
        twice = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ((i > 0) & same(i, i - 1)) | ((i < n - 1) & same(i, i + 1)))
        starts = F.array_sort(F.transform(twice, lambda i: F.get(ordered, i)["at"]))
        step = lambda s, p: F.struct((s["total"] + F.least(F.lit(width), p - s["last"])).alias("total"), p.alias("last"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("total"), F.lit(-width).alias("last")), step, lambda s: s["total"])

    return let(F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("at")))), count)


def _window_hashes(tokens: Column, width: int) -> Column:
    """A hash of every window of ``width`` words, from those of half as many words."""

    def joined(hashes: Column, by: int) -> Column:
        """Hashes of pairs of elements that are ``by`` apart."""

        def zipped(x: Column) -> Column:
            n = F.greatest(F.size(x) - by, F.lit(0))
            return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))

        return let(hashes, zipped)

    out, size = F.transform(tokens, lambda t: F.xxhash64(t)), 1
    while 2 * size <= width:
        out, size = joined(out, size), 2 * size
    return out if size == width else joined(out, width - size)


def repeated_words(tokens: Column, width: int = WINDOW) -> Column:
    """Words that stand in a window of ``width`` words found twice or more.

    Window hashes decide quickly that nothing repeats (equal windows have equal
    hashes); where some hash repeats, the windows themselves are compared.
    """
    last = F.size(tokens) - width + 1
    hashed = _window_hashes(tokens, width)
    exact = _covered(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, width), " ")), width)
    some = let(hashed, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(last < 2, F.lit(0)).otherwise(F.when(some, exact).otherwise(F.lit(0)))


def features(df: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the counts that rules and hard limits read, one row per input row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    removed = lambda p: (F.char_length(text) - F.char_length(F.regexp_replace(text, p, ""))).cast("long")
    of_words = let(
        words(F.col(text_col)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.aggregate(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, same: n + F.coalesce(same, F.lit(0))).cast("long").alias("n_stutters"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    made = df.select(*keep, of_words.alias("__w"), of_lines.alias("__l"), removed(SYMBOLS + "+").alias("n_symbols"), removed(SYMBOLS + "{2,}").alias("n_symbol_runs"), removed(LONE).alias("n_lone_symbols"), removed(r"\p{L}+").alias("n_letters"), removed(r"\p{Lu}+").alias("n_upper"), removed("!+").alias("n_shouts"))
    return made.select(*[c for c in made.columns if c not in ("__w", "__l")], "__w.*", "__l.*")


STRONG, WEAK, NONE, GOOD = -2, -1, 0, 1
LEVELS = (STRONG, WEAK, NONE, GOOD)


@dataclass(frozen=True)
class Rule:
    """A share with limits: beyond ``strong`` and ``weak`` the rule votes bad, on the other side of ``good`` good.

    It abstains elsewhere, and where a limit is None.  ``defect`` names what a
    bad vote says; rules of one defect see the same thing and speak for one class.
    """

    name: str
    share: Callable[[], Column]
    defect: str | None
    weak: float | None = None
    strong: float | None = None
    good: float | None = None

    def vote(self) -> Column:
        x = self.share()
        low = self.strong is not None and self.strong < self.weak
        out = F.when(F.lit(False), NONE)
        for limit, vote in ((self.strong, STRONG), (self.weak, WEAK)):
            if limit is not None:
                out = out.when(x <= limit if low else x >= limit, vote)
        if self.good is not None:
            below = self.weak is not None and not low
            out = out.when(x <= self.good if below else x >= self.good, GOOD)
        return out.otherwise(NONE)


def _of(a: str, b: str) -> Callable[[], Column]:
    return lambda: F.col(a) / F.greatest(F.col(b), F.lit(1))


def _plain_chars() -> Column:
    return F.col("word_chars") - F.col("n_symbols")


#: Every defect has rules that see it in different ways: what one rule says alone
#: can't be told from its errors.
RULES = (
    Rule("symbols", _of("n_symbols", "n_words"), "symbols", 0.05, 0.2),
    Rule("symbol_runs", _of("n_symbol_runs", "n_words"), "symbols", 0.05, 0.2),
    Rule("lone_symbols", _of("n_lone_symbols", "n_words"), "symbols", 0.05, 0.2),
    Rule("duplicate_lines", _of("n_dup_lines", "n_lines"), "repetition", 0.25, 0.5),
    Rule("repetition", _of("n_repeat_words", "n_words"), "repetition", 0.1, 0.35),
    Rule("stutter", _of("n_stutters", "n_words"), "repetition", 0.1, 0.3),
    Rule("vocabulary", _of("n_distinct", "n_words"), "repetition", 0.35, 0.15, 0.5),
    Rule("capitals", _of("n_upper", "word_chars"), "casing", 0.15, 0.4),
    Rule("shouting", _of("n_shouts", "n_words"), "casing", 0.1, 0.5),
    # both without symbols, which have rules of their own
    Rule("long_words", lambda: _plain_chars() / F.greatest(F.col("n_words"), F.lit(1)), "form", 10.0, 14.0, 7.0),
    Rule("letters", lambda: F.col("n_letters") / F.greatest(_plain_chars(), F.lit(1)), "form", 0.6, 0.4, 0.8),
    Rule("length", lambda: F.col("n_words").cast("double"), None, good=60.0),
)

#: Where EM begins; it moves all of these.  Votes of a class by level, in the order of LEVELS.
START_GOOD, START_OWN, START_OTHER, START_PRIOR = (0.005, 0.03, 0.465, 0.5), (0.4, 0.3, 0.2, 0.1), (0.05, 0.1, 0.5, 0.35), 0.8
SMOOTHING = 0.5


@dataclass(frozen=True)
class LabelModel:
    """Class shares and, for each class and rule, how likely each vote is.

    Class 0 is good; the others are the defects that rules name.  A document can
    be of a defect only if one of the defect's rules votes bad, so rules that
    go together, or a large group of odd documents, never make up a class of
    their own and documents nobody votes against are good.
    """

    groups: tuple[tuple[int, ...], ...]  # rules of each defect
    prior: tuple[float, ...]
    chances: tuple[tuple[tuple[float, ...], ...], ...]  # class, rule, level

    @classmethod
    def start(cls, rules: tuple[Rule, ...]) -> LabelModel:
        defects = list(dict.fromkeys(r.defect for r in rules if r.defect))
        groups = tuple(tuple(i for i, r in enumerate(rules) if r.defect == d) for d in defects)
        prior = (START_PRIOR, *((1 - START_PRIOR) / len(groups) for _ in groups))
        return cls(groups, prior, ((START_GOOD,) * len(rules), *(tuple(START_OWN if i in g else START_OTHER for i in range(len(rules))) for g in groups)))

    def accuracies(self) -> list[tuple[float, float]]:
        """For each rule, how likely it votes bad on good documents, and on documents of some defect."""
        bad = lambda k, i: self.chances[k][i][0] + self.chances[k][i][1]
        rest = sum(self.prior[1:]) or 1.0
        return [(bad(0, i), sum(p * bad(k, i) for k, p in enumerate(self.prior) if k) / rest) for i in range(len(self.chances[0]))]

    def posterior(self, votes: Column) -> Column:
        """Probability that a document with these votes is good."""
        vote = lambda i: F.get(votes, F.lit(i))

        def against(k: int, group: tuple[int, ...]) -> Column:
            odds = F.lit(math.log(self.prior[k] / self.prior[0]))
            for i, (own, good) in enumerate(zip(self.chances[k], self.chances[0], strict=True)):
                odds = odds + F.get(F.array(*[F.lit(math.log(x / y)) for x, y in zip(own, good, strict=True)]), vote(i) + 2)
            blamed = reduce(lambda x, y: x | y, [vote(i) < 0 for i in group])
            return F.when(blamed, F.exp(odds)).otherwise(0.0)

        return 1.0 / (1.0 + sum((against(k, g) for k, g in enumerate(self.groups, 1)), F.lit(0.0)))

    def improved(self, patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
        """One step of expectation maximisation over vote patterns (levels by number) and their documents."""
        n_rules = patterns.shape[1]
        log = np.log(np.array(self.chances))
        score = np.log(np.array(self.prior)) + sum(log[:, i, patterns[:, i]].T for i in range(n_rules))
        for k, group in enumerate(self.groups, 1):
            score[~(patterns[:, group] < 2).any(axis=1), k] = -np.inf
        share = np.exp(score - score.max(axis=1, keepdims=True))
        share *= (counts / share.sum(axis=1))[:, None]
        seen = np.stack([[share[patterns[:, i] == v].sum(axis=0) for v in range(len(LEVELS))] for i in range(n_rules)]).transpose(2, 0, 1) + SMOOTHING
        chances = seen / seen.sum(axis=2, keepdims=True)
        prior = share.sum(axis=0) + SMOOTHING
        as_tuple = lambda x: tuple(tuple(map(float, row)) for row in x)
        return LabelModel(self.groups, tuple(map(float, prior / prior.sum())), tuple(map(as_tuple, chances)))


def fit_label_model(votes: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = 500, tolerance: float = 1e-7) -> LabelModel:
    """EM on all rows of ``votes`` (column ``votes``, an array of levels).

    Rows are counted by vote pattern first.  The driver sees these counts only:
    4 ** len(rules) at most, whatever the size of the table.
    """
    rows = votes.groupBy("votes").count().collect()
    model = LabelModel.start(rules)
    if not rows:
        return model
    patterns, counts = np.array([r["votes"] for r in rows]) + 2, np.array([r["count"] for r in rows], float)
    order = np.lexsort(patterns.T)
    for _ in range(rounds):
        before, model = model, model.improved(patterns[order], counts[order])
        if max(np.abs(np.array(model.prior) - before.prior).max(), np.abs(np.array(model.chances) - before.chances).max()) < tolerance:
            break
    return model


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _voted(df: DataFrame, keep: list[Column], text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    return checkpointed(features(df, keep, text_col).withColumn("votes", F.array(*[r.vote() for r in rules])))


def judge_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Counts, votes, posterior and verdict: one row per input row, id in ``id``."""
    voted = _voted(df, [F.col(id_col).alias("id")], text_col, rules)
    model = fit_label_model(voted, rules)
    return voted.withColumn("posterior", model.posterior(F.col("votes"))).withColumn("base_failed", _failed()).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns.

    Rows are written with their votes, so a text is analysed once.
    """
    voted = _voted(df, [F.struct(*quoted(df)).alias("__row")], text_col, rules)
    model = fit_label_model(voted, rules)
    return voted.filter(~_failed() & (model.posterior(F.col("votes")) >= threshold)).select("__row.*")
