"""Fill-in-middle examples: a text is cut in three and its middle put last.

Cuts are made between units.  ``Units`` says which: some ASCII characters change
the class of what follows (by default control characters of white space) and
are units by themselves; between them a unit is ``width`` code points, or all
up to the next such character.  One Aho-Corasick automaton finds these
characters and the sentinels in one scan.  Between two of these events units
are counted by arithmetic, and a rank is looked up among the events, so no list
of units is made however long the text is.

Two cuts and the form are drawn from the SHA-256 of key and id: the first four
groups of eight digits are h1 to h4; the cuts lie after h1 and h2 modulo n + 1
units.  A text is plain if it is empty, holds a sentinel or h3 modulo 100 is at
least ``Plan.moved``; otherwise h4 modulo 100 below ``Plan.suffix_first``
gives the form spm, else psm.

Defined results: a null text counts as empty; a text that holds a sentinel is
left as it is, so what is moved can always be put back; very long texts are
taken whole; repeated rows (same id) are cut alike; a null id counts as an empty
one; an empty table gives an empty table.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import let, small

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Units:
    width: int | None = 1  # code points in a unit; None: as far as the next break
    breaks: str = "\t\n\v\f\r"  # ASCII characters that are units by themselves

    def __post_init__(self) -> None:
        if not self.breaks.isascii() or (self.width is not None and self.width < 1):
            raise ValueError("breaks are ASCII characters, a unit is one code point wide at least")


CODE_POINTS = Units()
WORDS = Units(None, " \t\n\v\f\r")


@dataclass(frozen=True)
class Plan:
    key: str = "1"
    units: Units = field(default_factory=Units)
    moved: int = 90  # of 100 documents
    suffix_first: int = 20  # of 100 moved ones
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix_mark, self.suffix_mark, self.middle_mark


class Cutter:
    """Scans texts and gives the places of units by their rank."""

    def __init__(self, plan: Plan) -> None:
        import ahocorasick

        self.plan, self.automaton = plan, ahocorasick.Automaton()
        for c in plan.units.breaks:
            self.automaton.add_word(c, False)
        for mark in plan.marks:
            self.automaton.add_word(mark, True)
        self.automaton.make_automaton()

    def scan(self, text: str) -> Ranks:
        breaks, marked = [], False
        for at, mark in self.automaton.iter(text):
            if mark:
                marked = True
            else:
                breaks.append(at)
        return Ranks(len(text), breaks, self.plan.units.width, marked)


class Ranks:
    """Where units begin, known from the breaks alone."""

    def __init__(self, size: int, breaks: list[int], width: int | None, marked: bool) -> None:
        self.marked = marked
        self.width = width or max(size, 1)
        self.begin = np.append(0, np.array(breaks, np.int64) + 1)  # of each gap between breaks
        self.end = np.append(np.array(breaks, np.int64), size)
        counts = -(-(self.end - self.begin) // self.width)
        self.before = np.cumsum(counts) - counts + np.arange(len(counts))  # units ahead of each gap
        self.n = int(self.before[-1] + counts[-1])

    def offset(self, rank: int) -> int:
        """The code point behind the first ``rank`` units."""
        gap = int(np.searchsorted(self.before, rank, side="right")) - 1
        return int(min(self.begin[gap] + (rank - self.before[gap]) * self.width, self.end[gap]))


def draws(key: str, row_id: object) -> list[int]:
    digest = hashlib.sha256(f"{key}:{'' if row_id is None else row_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(cutter: Cutter, row_id: object, text: str) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output)."""
    plan, ranks = cutter.plan, cutter.scan(text)
    h1, h2, h3, h4 = draws(plan.key, row_id)
    if not text or ranks.marked or h3 % 100 >= plan.moved:
        return ranks.n, PLAIN, None, None, text
    first, last = sorted(ranks.offset(h % (ranks.n + 1)) for h in (h1, h2))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    p, s, m = plan.marks
    if h4 % 100 < plan.suffix_first:
        return ranks.n, SPM, first, last - first, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return ranks.n, PSM, first, last - first, f"{p}{prefix}{s}{suffix}{m}{middle}"


def _run(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(plan)
        for batch in small(batches):
            rows = [transform(cutter, i, t.as_py() or "") for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(df: DataFrame, plan: Plan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n units, form, prefix_chars, middle_chars, output): one row per input row."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(_run(plan or Plan()), schema)


def restored(output: Column, form: Column, plan: Plan | None = None) -> Column:
    """The text that an output was made of: its parts, found at the sentinels, in their first order."""
    marks = "|".join("\\Q" + m + "\\E" for m in (plan or Plan()).marks)
    in_order = lambda x, *places: F.concat(*[F.get(x, F.lit(i)) for i in places])
    back = let(F.split(output, marks, -1), lambda x: F.when(form == SPM, in_order(x, 2, 3, 1)).otherwise(in_order(x, 1, 3, 2)))
    return F.when(form == PLAIN, output).otherwise(back)
