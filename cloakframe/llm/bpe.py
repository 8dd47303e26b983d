"""Byte-pair encoding by a queue of merges, and decoding.

A pretoken's symbols form a doubly linked list.  A heap holds the merges that
its neighbours allow, by rank and place; the least one is taken, its right
symbol leaves the list, and the merges with the new neighbours join the heap.
An entry whose symbols have changed meanwhile is stale and skipped.  That takes
n log n steps for a pretoken of n symbols, however long it is.

A text is cut at the strings of special tokens, each part is normalised
(composed, white space, lower case) and cut into pretokens by the file's
pattern.  Code points whose case or class this Python sees differently from the
tokenizer's own tables, found by asking it for each distinct one, and marks
that combine send their text through the tokenizer's normaliser and
pretokeniser instead; merging is done here for all.  A worker remembers what
short pretokens come to.

Decoding puts vocabulary strings together: with a blank between them where the
file names no decoder, as bytes where it names the byte-level one.

Defined results: a null or empty text, or one of white space only, has no ids
and decodes to an empty text; very long texts and pretokens are taken whole;
repeated rows are encoded one by one; null ids of rows are kept; an empty table
gives an empty table.  Only the id and text columns are read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import batched

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import small
from cloakframe.llm.token_ids import _visible_bytes

MOST_REMEMBERED, LONGEST_REMEMBERED = 500_000, 64
PARTS = 1 << 16
_codecs: dict[str, Codec] = {}


class Merges:
    """The vocabulary and the ranked merges of a tokenizer file's model."""

    def __init__(self, model: dict) -> None:
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.of = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}

    def symbols(self, shown: str) -> list[int]:
        """The ids of a pretoken's characters, the last one with the mark of a word's end."""
        return [self.ids[c] for c in (*shown[:-1], shown[-1:] + self.end) if c in self.ids]

    def merged(self, symbols: list[int]) -> list[int]:
        """The ids left when no merge applies any more; -1 marks symbols that have left the list."""
        of, at = self.of, list(symbols)
        before, after = list(range(-1, len(at) - 1)), [*range(1, len(at)), -1]
        queue = [(*of[pair], i) for i, pair in enumerate(zip(at, at[1:], strict=False)) if pair in of]
        queue = [(rank, i, new) for rank, new, i in queue]
        heapify(queue)
        while queue:
            rank, i, new = heappop(queue)
            j = after[i]
            if at[i] < 0 or j < 0 or of.get((at[i], at[j])) != (rank, new):
                continue
            at[i], at[j] = new, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (found := of.get((at[left], at[right]))):
                    heappush(queue, (found[0], left, found[1]))
        return [s for s in at if s >= 0]


class Remembered(dict):
    """What ``make`` gives for a pretoken, kept for short ones."""

    def __init__(self, make: Callable[[str], bytes | str]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, pretoken: str) -> bytes | str:
        found = self.make(pretoken)
        if len(pretoken) <= LONGEST_REMEMBERED:
            if len(self) >= MOST_REMEMBERED:
                self.clear()
            self[pretoken] = found
        return found


class Codec:
    """Encodes and decodes as a tokenizer file says.

    Files with byte-level BPE whose pretokens are the matches of one pattern.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.merges = Merges(spec["model"])
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.word = {i: w for w, i in {**self.merges.ids, **added}.items()}
        self.bytewise = bool(spec.get("decoder"))
        self.gap = "" if self.bytewise else " "
        self.visible = _visible_bytes()
        self.invisible = {ord(c): b for b, c in self.visible.items()}
        self.special = {w: (array("I", [i]).tobytes(), w) for w, i in added.items()}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", ())]
        self.folds = steps == ["NFC", "Replace", "Lowercase"]
        cut = spec["pre_tokenizer"]["pretokenizers"][0]
        if cut["type"] != "Split" or cut["behavior"] != "Removed" or not cut["invert"]:
            raise ValueError("pretokens must be the matches of a pattern")
        pattern = cut["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.unicode = regex.compile(pattern)
        within_ascii = pattern.replace(r"\p{White_Space}", r" \t-\r").replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
        self.ascii = self.unicode if r"\p" in within_ascii else re.compile(within_ascii)
        self.ids = Remembered(lambda w: self.merged(self._shown(w)))
        self.words = Remembered(lambda w: self.spelt(self.ids[w]))
        self.alike: set[str] = set()
        self.plain_ascii = all(self._same(chr(c)) for c in range(128))

    def _same(self, c: str) -> bool:
        """Whether a code point is folded and cut here as the tokenizer does it."""
        if not self.folds or unicodedata.combining(c):
            return False
        low = c.lower()
        library = lambda t: ["".join(w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(x)) for x in t]
        around = [low, f"a{low}", f"1{low}", f"!{low}", f"{low}a", f"{low}!"]
        mine = ["".join(self._shown(w) for w in self.unicode.findall(x)) for x in around]
        sizes = [len(self.library.pre_tokenizer.pre_tokenize_str(x)) for x in around] == [len(self.unicode.findall(x)) for x in around]
        folded = self.library.normalizer.normalize_str(c)
        return (folded == low or (folded == " " and not self.unicode.findall(low))) and sizes and mine == library(around)

    def _shown(self, pretoken: str) -> str:
        return pretoken.encode().decode("latin-1").translate(self.visible)

    def _alike(self, text: str) -> bool:
        if text.isascii():
            return self.plain_ascii
        new = set(text) - self.alike
        if not all(map(self._same, new)):
            return False
        self.alike |= new
        return unicodedata.is_normalized("NFC", text)

    def merged(self, shown: str) -> bytes:
        """Ids of a pretoken in printable characters."""
        return array("I", self.merges.merged(self.merges.symbols(shown))).tobytes()

    def spelt(self, ids: bytes) -> str:
        """Vocabulary strings of ids."""
        return self.gap.join(map(self.word.__getitem__, array("I", ids)))

    def _found(self, text: str) -> Iterator[tuple[bytes, str]]:
        """(ids, their strings) of each pretoken and special token of a text."""
        for part in self.cut_special.split(text) if self.cut_special else [text]:
            if part in self.special:
                yield self.special[part]
            elif not part:
                continue
            elif self._alike(part):
                yield from ((self.ids[w], self.words[w]) for w in self._pretokens(part))
            else:
                cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                yield from ((ids := self.merged(w), self.spelt(ids)) for w, _ in cut)

    def _pretokens(self, part: str) -> Iterable[str]:
        low = part.replace("Σ", "σ").lower()  # a capital sigma folds the same at a word's end
        if len(low) < PARTS:
            return (self.ascii if low.isascii() else self.unicode).findall(low)
        return (m.group() for m in self.unicode.finditer(low))

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids of a text as little-endian bytes, four each, and the text that they decode to."""
        if len(text) < PARTS and not (self.cut_special and self.cut_special.search(text)) and self._alike(text):
            found = self._pretokens(text)
            return b"".join(map(self.ids.__getitem__, found)), self._text(self.gap.join(filter(None, map(self.words.__getitem__, found))))
        ids, words = [], []
        for some in batched(self._found(text), PARTS):
            ids.append(b"".join([x[0] for x in some]))
            words.append(self.gap.join([x[1] for x in some if x[0]]))
        return b"".join(ids), self._text(self.gap.join(filter(None, words)))

    def _text(self, words: str) -> str:
        return bytes(self.invisible[ord(c)] for c in words).decode("utf-8", "replace") if self.bytewise else words

    def decode(self, ids: bytes) -> str:
        return self._text(self.spelt(ids))


def codec(path: str) -> Codec:
    """The worker's codec for a tokenizer file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode
        for batch in small(batches):
            found = [encode(t.as_py() or "") for t in batch.column(1)]
            ids, words = pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())
            sizes = pa.array([len(x[0]) // 4 for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, ids, words], names=["id", "n_tokens", "ids", "decoded"])

    return run


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded): one row per input row.

    ``path``: a tokenizer file; ``ids``: little-endian, four bytes to an id;
    ``decoded``: what these ids stand for.
    """
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(_encode(path), f"id {kind}, n_tokens bigint, ids binary, decoded string")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for batch in small(batches):
            words = pa.array([decode(x.as_py() or b"") for x in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), words], names=["id", "decoded"])

    return run


def decode_ids(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) of ids as ``encode_documents`` gives them; null ids decode to an empty text."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(_decode(path), f"id {kind}, decoded string")
