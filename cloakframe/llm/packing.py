"""Hierarchical packing into several context sizes.

A document longer than the longest window gives whole windows; what is left is
routed to the smallest tier that holds it.  Tiers are packed from long to short:
a piece opens a window of its tier, and its gap is filled from shorter tiers,
the largest fitting piece first, the last one cut to fit.  Sequences of all
tiers are dealt evenly over step groups: all but a task's last are within one
long window of ``Plan.step_tokens``.

Every window but a task's last few has exactly its tier's length.  What is left
open when a task ends is joined and cut into windows again, so a task pads less
than one short window.

All work is local to the task that reads the documents: no shuffle, and no more
than ``Plan.block`` tokens and ``Plan.most_open`` open windows are held.  Ids of
sequences and steps carry the partition number, so a task that runs again gives
the same ids.

Defined results: a null or empty text has the closing id only; repeated rows are
packed one by one; null document ids are kept; an empty table gives an empty
table.  Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.token_ids import encoder

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_id bigint"
PARTITION_BITS = 33


@dataclass(frozen=True)
class Plan:
    tokenizer: str
    tiers: tuple[int, ...] = (2048, 1024, 512, 256)  # powers of two, long to short
    step_tokens: int = 8 * 2048
    closing_id: int = 1
    block: int = 1 << 20
    most_open: int = 32

    def tier(self, length: int) -> int:
        return next(t for t in reversed(self.tiers) if length <= t)


class Document:
    __slots__ = ("doc_id", "ids")

    def __init__(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_id, self.ids = doc_id, ids


#: (document, start, length)
Piece = tuple[Document, int, int]


class Pool:
    """Pieces by length, for best fit."""

    def __init__(self) -> None:
        self.items: list[tuple[int, int]] = []
        self.pieces: dict[int, Piece] = {}
        self.made = 0

    def add(self, piece: Piece) -> None:
        self.pieces[self.made] = piece
        insort(self.items, (piece[2], self.made))
        self.made += 1

    def take(self, most: int) -> Piece | None:
        """The longest piece of at most ``most`` ids, else the shortest of all."""
        if not self.items:
            return None
        at = bisect_right(self.items, (most, self.made)) - 1
        return self.pieces.pop(self.items.pop(max(at, 0))[1])

    def longest(self) -> int:
        return self.items[-1][0] if self.items else 0


class Window:
    def __init__(self, size: int) -> None:
        self.size, self.used, self.pieces = size, 0, []

    def put(self, piece: Piece, back: Pool) -> None:
        document, start, length = piece
        taken = min(length, self.size - self.used)
        self.pieces.append((document, start, taken))
        self.used += taken
        if taken < length:
            back.add((document, start + taken, length - taken))

    def fill(self, pool: Pool) -> bool:
        while self.used < self.size and (piece := pool.take(self.size - self.used)):
            self.put(piece, pool)
        return self.used == self.size


class Packer:
    def __init__(self, plan: Plan) -> None:
        self.plan, self.open = plan, []

    def add(self, documents: list[Document]) -> list[Window]:
        """Windows that are full once these documents are in."""
        plan, pool, full = self.plan, Pool(), []
        longest = plan.tiers[0]
        for d in documents:
            for start in range(0, len(d.ids), longest):
                piece = (d, start, min(longest, len(d.ids) - start))
                if piece[2] == longest:
                    full.append(whole := Window(longest))
                    whole.put(piece, pool)
                else:
                    pool.add(piece)
        waiting, self.open = self.open, []
        for tier in plan.tiers:
            opened = [w for w in waiting if w.size == tier]
            while pool.longest() > (tier // 2 if tier > plan.tiers[-1] else 0):
                opened.append(window := Window(tier))
                window.put(pool.take(tier), pool)
                if tier == plan.tiers[-1]:  # the shortest tier: pieces of any length share windows
                    window.fill(pool)
            for window in sorted(opened, key=lambda w: w.used - w.size):
                (full if window.fill(pool) else self.open).append(window)
        if len(self.open) > plan.most_open:
            full += self._join()
        return full

    def _join(self) -> list[Window]:
        """Cut what the open windows hold into full windows; one may stay open."""
        pool, full = Pool(), []
        pieces = [p for w in self.open for p in w.pieces]
        window = Window(self.plan.tiers[0])
        for piece in pieces:
            pool.add(piece)
            while pool.items:
                window.put(pool.take(window.size), pool)
                if window.used == window.size:
                    full.append(window)
                    window = Window(self.plan.tiers[0])
        self.open = [window] if window.used else []
        return full

    def close(self) -> list[Window]:
        """All that is left: full windows of any tier, then at most one that is not full."""
        full = self._join()
        pool = Pool()
        left = [p for w in self.open for p in w.pieces]
        self.open = []
        total = sum(p[2] for p in left)
        sizes = []
        for tier in self.plan.tiers:
            sizes += [tier] * (total // tier)
            total %= tier
        for size in [*sizes, *([total] if total else [])]:
            window = Window(size)
            while window.used < size:
                piece = left.pop(0)
                window.put(piece, pool)
                if pool.items:
                    left.insert(0, pool.take(size))
            full.append(window)
        return full


def _rows(plan: Plan, windows: list[Window], first: int, step: int, dealt: int) -> tuple[pa.RecordBatch, int]:
    """Rows of the pieces; the number of tokens dealt to steps with these.

    Windows of all tiers are dealt in turn, and a step takes those that begin
    within its share of the tokens: steps differ by less than one long window.
    """
    place: dict[int, int] = {}
    counts = {w.size: 0 for w in windows}
    for w in windows:
        counts[w.size] += 1
    seen = dict.fromkeys(counts, 0)
    order = []
    for n, w in enumerate(windows):
        order.append(((seen[w.size] + 0.5) / counts[w.size], n))
        seen[w.size] += 1
    total = dealt
    for _, n in sorted(order):
        place[n] = step + total // plan.step_tokens
        total += windows[n].used
    out: list[list] = [[] for _ in range(9)]
    for n, w in enumerate(windows):
        offset = 0
        for document, start, length in w.pieces:
            crc = zlib.crc32(document.ids[start : start + length].astype("<u4").tobytes())
            row = (document.doc_id, start, length, crc, len(document.ids), first + n, offset, plan.tier(w.used), place[n])
            for column, value in zip(out, row, strict=True):
                column.append(value)
            offset += length
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names), total


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[tuple[list[int | None], list[str]]]:
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        ids.append(i)
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _pack(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        first = step = (context.partitionId() if context else 0) << PARTITION_BITS
        dealt = 0
        tokens, packer = encoder(plan.tokenizer), Packer(plan)

        def out(windows: list[Window]) -> Iterator[pa.RecordBatch]:
            nonlocal first, dealt
            if windows:
                batch, dealt = _rows(plan, windows, first, step, dealt)
                first += len(windows)
                yield batch

        for batch in batches:
            for ids, texts in _slices(batch, plan.block):
                flat, counts = tokens.encode(texts)
                ends = np.cumsum(counts)
                # each document owns its ids: one that waits does not hold the block
                documents = [Document(i, np.append(flat[e - c : e], np.uint32(plan.closing_id))) for i, e, c in zip(ids, ends, counts, strict=True)]
                yield from out(packer.add(documents))
        yield from out(packer.close())

    return run


def pack_documents(df: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document, in the columns of ``SCHEMA``."""
    return df.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(_pack(plan), SCHEMA)
