"""Alignment of two tokenizers over a corpus, with counts of linked id pairs.

A is a byte-level BPE file, read over a space and the text; B is a piece model
that puts the space itself.  Their tokens cover the same bytes.  Between two
neighbouring token ends lies a piece of exactly one A and one B token, and two
tokens overlap in one such piece, so links are these pieces: one pass over the
ends, no pairs of tokens.  A link is an int64: A's id above B's, and two bits
that say whether an A or a B token begins there, from which all ids and groups
can be read again.

Links of all texts are written once, compressed row by row.  Their pair keys are counted by
``np.unique`` a task, the partial counts sorted by key in range partitions and
equal neighbours summed, and each partition writes a shard: sorted keys and
counts, two files in the shared folder.  Texts are then looked up by binary
search in the shards, memory-mapped, of which only touched pages are read; a
shared folder that is no file system here is read a shard at a time.  The
highest count of each B id is one number for each entry of B's vocabulary.

Defined results: a null or empty text, or one that either tokenizer doesn't give
back byte by byte, has no tokens: zeros and an empty string of groups; repeated
rows count each time; very long texts are taken whole; null ids of rows are kept;
an empty table gives an empty table.  Only the id and text columns are read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import checkpointed, shared_folder
from cloakframe.llm.token_ids import Encoder

ABOVE = 32
A_BEGINS, B_BEGINS = 1 << 61, 1 << 60
KEY = B_BEGINS - 1
LOW = (1 << ABOVE) - 1
BLOCK = 1 << 19
MOST_COUNTED = 1 << 20
MOST_REMEMBERED = 150_000
_CODEC = pa.Codec("zstd", compression_level=1)
MARK = "▁"  # fixed value: how pieces write a blank
_sides: dict[tuple[str, str], tuple[Side, Side]] = {}
_opened: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class Pair:
    a: str  # a byte-level BPE file
    b: str  # a piece model


class Bytes:
    """The bytes of each id of a vocabulary."""

    def __init__(self, words: list[bytes]) -> None:
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(words), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        shift = np.repeat(self.start[ids] - (np.cumsum(length) - length), length)
        return self.flat[shift + np.arange(len(shift))]


class Side(Bytes):
    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another, and the number of each."""
        raise NotImplementedError


class ByteLevel(Side):
    """Ids over a space and the text."""

    def __init__(self, path: str) -> None:
        self.encoder = Encoder(path)
        self.encoder.of.most = MOST_REMEMBERED
        hidden = {ord(c): b for b, c in self.encoder.of.visible.items()}
        vocabulary = self.encoder.tokenizer.get_vocab(with_added_tokens=True)
        words = [b""] * (max(vocabulary.values()) + 1)
        for word, i in vocabulary.items():
            words[i] = bytes(hidden[ord(c)] for c in word) if all(ord(c) in hidden for c in word) else word.encode()
        super().__init__(words)

    def encode(self, texts):
        return self.encoder.encode([" " + t for t in texts])


class Pieces(Side):
    """Ids of a piece model, which puts a space ahead itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)])

    def encode(self, texts):
        made = self.model.encode(texts, num_threads=1)
        counts = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.int64, int(counts.sum())), counts


def sides(pair: Pair) -> tuple[Side, Side]:
    """The worker's tokenizers."""
    key = (pair.a, pair.b)
    if key not in _sides:
        _sides[key] = (ByteLevel(pair.a), Pieces(pair.b))
    return _sides[key]


def _fits(side: Side, ids: np.ndarray, counts: np.ndarray, expected: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which texts their tokens give back byte by byte."""
    ends = np.append(0, np.cumsum(side.length[ids]))[np.cumsum(counts)]
    good = np.diff(ends, prepend=0) == sizes
    if good.all():
        wrong = np.flatnonzero(side.joined(ids) != expected)
        good[np.searchsorted(np.cumsum(sizes), wrong, side="right")] = False
        return good
    of_token, of_byte = np.repeat(good, counts), np.repeat(good, sizes)
    if good.any():
        good[good] = _fits(side, ids[of_token], counts[good], expected[of_byte], sizes[good])
    return good


def links_of(pair: Pair, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Links of all texts behind one another, and the number of each."""
    out = np.zeros(len(texts), np.int64)
    kept = np.array([bool(t) and MARK not in t for t in texts], bool)
    some = [t for t, k in zip(texts, kept.tolist(), strict=True) if k]
    if not some:
        return np.empty(0, np.int64), out
    found = [(side, *side.encode(some)) for side in sides(pair)]
    raw = [b" " + t.encode() for t in some]
    expected, sizes = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))
    good = np.ones(len(some), bool)
    for side, ids, counts in found:
        good &= _fits(side, ids, counts, expected, sizes)
    ids = [ids[np.repeat(good, counts)].astype(np.int64) for _, ids, counts in found]
    sizes = sizes[good]
    ends = np.zeros(int(sizes.sum()) + 1, np.uint8)
    for n, ((side, _, _), i) in enumerate(zip(found, ids, strict=True)):
        ends[np.cumsum(side.length[i])] |= 1 << n
    at = np.flatnonzero(ends)
    ended = ends[at]
    links = np.zeros(len(at), np.int64)
    for n, (i, shift, mark) in enumerate(zip(ids, (ABOVE, 0), (A_BEGINS, B_BEGINS), strict=True)):
        last = (ended >> n) & 1
        begins = np.append(1, last[:-1]) if len(last) else last
        links |= i[np.cumsum(last, dtype=np.int64) - last] << shift
        links |= begins.astype(np.int64) * mark
    kept[kept] = good
    out[kept] = np.diff(np.searchsorted(at, np.cumsum(sizes), side="right"), prepend=0)
    return links, out


def _blocks(batch: pa.RecordBatch, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of about ``BLOCK`` weight; a row is never parted."""
    block = np.cumsum(weights) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a)


def _weight(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _packed(links: np.ndarray) -> bytes:
    return _CODEC.compress(links.astype("<i8").tobytes(), asbytes=True)


def _unpacked(counts: np.ndarray, packed: pa.Array) -> np.ndarray:
    """Links of all rows behind one another."""
    parts = [_CODEC.decompress(x.as_buffer(), decompressed_size=8 * n, asbytes=True) for n, x in zip(counts.tolist(), packed, strict=True)]
    return np.frombuffer(b"".join(parts), "<i8")


def _link(pair: Pair):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _blocks(whole, _weight(whole.column(1))):
                links, counts = links_of(pair, batch.column(1).to_pylist())
                packed = pa.array([_packed(x) for x in np.split(links, np.cumsum(counts)[:-1])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), packed], names=["id", "n_links", "links"])

    return run


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over runs of equal keys."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of a task's links (n_links, links); many are given out in between."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def together() -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys, kind="stable")
        return _summed(keys[order], counts[order])

    size = 0
    for batch in (b for whole in batches for b in _blocks(whole, whole.column(0).to_numpy())):
        links = _unpacked(batch.column(0).to_numpy(), batch.column(1))
        held.append(np.unique(links & KEY, return_counts=True))
        size += len(held[-1][0])
        if size > MOST_COUNTED:
            held = [together()]
            size = len(held[0][0])
            if size > MOST_COUNTED // 2:
                yield from _counted(*held.pop())
                size = 0
    if held:
        yield from _counted(*together())


def _counted(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 1 << 16):
        part = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(counts[part].astype(np.int64))], names=["key", "n"])


def _place(uri: str) -> tuple[pa.fs.FileSystem, str, bool]:
    """(file system, path there, whether it is mounted here)."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path, True
    found, path = fs.FileSystem.from_uri(uri)
    return found, path, False


@contextmanager
def _written(uri: str) -> Iterator[Callable[[np.ndarray], None]]:
    """Write arrays of int64 to a file that is there as a whole or not at all."""
    system, path, mounted = _place(uri)
    own = f"{path}.{uuid.uuid4().hex}" if mounted else path
    with system.open_output_stream(own) as out:
        yield lambda x: out.write(np.ascontiguousarray(x, "<i8").tobytes())
    if mounted:
        os.replace(own, path)


def _read(uri: str) -> np.ndarray:
    if uri not in _opened:
        system, path, mounted = _place(uri)
        if mounted:
            _opened[uri] = np.memmap(path, "<i8", "r")
        else:
            with system.open_input_file(path) as f:
                return np.frombuffer(f.readall(), "<i8")
    return _opened[uri]


SHARD = "shard int, first bigint, last bigint, pairs bigint, b array<bigint>, best array<bigint>"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums of sorted (key, n) by key; a key that goes on in the next batch waits for it."""
    key, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        keys, counts = (np.append(x, c.to_numpy(zero_copy_only=False)) for x, c in zip((key, n), batch.columns, strict=True))
        keys, counts = _summed(keys, counts)
        key, n = keys[-1:], counts[-1:]
        if len(keys) > 1:
            yield keys[:-1], counts[:-1]
    if len(key):
        yield key, n


def _shard(folder: str, size_b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs = _runs(batches)
        if (ahead := next(runs, None)) is None:
            return
        number, best, pairs, first, last = TaskContext.get().partitionId(), np.zeros(size_b, np.int64), 0, int(ahead[0][0]), 0
        with _written(f"{folder}/{number}.keys") as write_keys, _written(f"{folder}/{number}.counts") as write_counts:
            for keys, counts in chain([ahead], runs):
                write_keys(keys)
                write_counts(counts)
                np.maximum.at(best, keys & LOW, counts)
                pairs, last = pairs + len(keys), int(keys[-1])
        of = np.flatnonzero(best)
        row = [[number], [first], [last], [pairs], [of.tolist()], [best[of].tolist()]]
        kinds = [pa.int32(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 2]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["shard", "first", "last", "pairs", "b", "best"])

    return run


@dataclass(frozen=True)
class Counts:
    """Sorted counts of id pairs over a corpus, in shards, and the highest of each B id."""

    folder: str
    shards: tuple[tuple[int, int, int], ...]  # number, first and last key
    best: np.ndarray

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys that all occur."""
        out = np.zeros(len(keys), np.int64)
        for number, first, last in self.shards:
            a, b = np.searchsorted(keys, [first, last + 1])
            if a < b:
                at = np.searchsorted(_read(f"{self.folder}/{number}.keys"), keys[a:b])
                out[a:b] = _read(f"{self.folder}/{number}.counts")[at]
        return out


def count_pairs(links: DataFrame, folder: str, size_b: int) -> Counts:
    """Counts of all pairs in ``links`` (id, n_links, links); the shards are written in ``folder``."""
    partial = checkpointed(links.select("n_links", "links").mapInArrow(_partial, "key bigint, n bigint"))
    sorted_counts = partial.repartitionByRange("key").sortWithinPartitions("key")
    system, path, _ = _place(folder)
    system.create_dir(path, recursive=True)
    shards = checkpointed(sorted_counts.mapInArrow(_shard(folder, size_b), SHARD))
    of_b = shards.select(F.explode(F.arrays_zip("b", "best")).alias("x")).groupBy("x.b").agg(F.max("x.best").alias("best")).collect()
    best = np.zeros(size_b, np.int64)
    for r in of_b:
        best[r["b"]] = r["best"]
    found = shards.select("shard", "first", "last").orderBy("first").collect()
    return Counts(folder, tuple(tuple(r) for r in found), best)


def _numbers(size_a: int, size_b: int) -> list[str]:
    """Texts of an id and the sign behind it: of A within and at the end of a group, then of B."""
    return [f"{i}{sign}" for size, within, end in ((size_a, ",", "|"), (size_b, ",", ";")) for i in range(size) for sign in (within, end)]


def _groups(links: np.ndarray, counts: np.ndarray, numbers: list[str], size_a: int) -> tuple[list[str], list[np.ndarray]]:
    """Each text's groups, written out, and its numbers of A tokens, B tokens and groups."""
    begins = [(links & mark) != 0 for mark in (A_BEGINS, B_BEGINS)]
    both = begins[0] & begins[1]
    group = np.cumsum(both)
    a, b = (group[x] for x in begins)
    codes = np.empty(len(a) + len(b), np.int64)
    last = lambda x: np.append(x[1:] != x[:-1], True)[: len(x)]
    codes[np.arange(len(a)) + np.searchsorted(b, a, side="left")] = 2 * ((links[begins[0]] & KEY) >> ABOVE) + last(a)
    codes[np.arange(len(b)) + np.searchsorted(a, b, side="right")] = 2 * (size_a + (links[begins[1]] & LOW)) + last(b)
    ends = np.cumsum(counts)
    per_text = [np.diff(np.append(0, np.cumsum(x))[ends], prepend=0) for x in (*begins, both)]
    texts, at = [], 0
    for n in (per_text[0] + per_text[1]).tolist():
        texts.append("".join(map(numbers.__getitem__, codes[at : at + n].tolist()))[:-1])
        at += n
    return texts, per_text


RESULT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"


def _look_up(pair: Pair, counts: Counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a, size_b = (len(s.length) for s in sides(pair))
        numbers = _numbers(size_a, size_b)
        for whole in batches:
            for batch in _blocks(whole, 4 * whole.column(1).to_numpy()):
                sizes = batch.column(1).to_numpy()
                links = _unpacked(sizes, batch.column(2))
                keys, where = np.unique(links & KEY, return_inverse=True)
                count = counts.of(keys)
                high = count == counts.best[keys & LOW]
                ends = np.cumsum(sizes)
                summed = [np.diff(np.append(0, np.cumsum(x[where], dtype=np.int64))[ends], prepend=0) for x in (high, count)]
                groups, per_text = _groups(links, sizes, numbers, size_a)
                columns = [pa.array(x, pa.int64()) for x in (*per_text, sizes, *summed)]
                names = ["id", *(x.split()[0] for x in RESULT.split(", "))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(groups, pa.string())], names=names)

    return run


def align(df: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Counts]:
    """One row per input row (id and the columns of ``RESULT``), and the counts of all pairs.

    ``n_best``: links whose count is the highest of their B id, ``count_sum``:
    the sum of all links' counts, ``groups``: ids of A and B between common
    token ends, "a1,a2|b1;a3|b2,b3".
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    folder = f"{shared_folder(spark)}/aligned-{uuid.uuid4().hex}"
    df.select(F.col(id_col), F.col(text_col)).mapInArrow(_link(pair), f"id {kind}, n_links bigint, links binary").write.parquet(f"{folder}/links")
    links = spark.read.parquet(f"{folder}/links")
    counts = count_pairs(links, f"{folder}/counts", len(sides(pair)[1].length))
    return links.mapInArrow(_look_up(pair, counts), f"id {kind}, {RESULT}"), counts
