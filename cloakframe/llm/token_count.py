"""Token counts by a linear longest-match automaton.

The vocabulary's trie gets failure links: where a node has no edge for the next
symbol, the pieces that greedy longest match would have cut off so far are
popped and matching goes on at the link.  Each node knows how many pieces it
pops, so counting never builds a piece and never looks back; the work is linear
in the text.

Words are runs of other than white space, A-Z in lower case, as UTF-8 bytes and
an end mark that word-final pieces carry.  A word without an own end piece ends
without one.  A byte that no piece starts with counts as one piece.

A worker remembers the counts of short words that it has met.

Defined results: a null or blank text has no words and no tokens; very long
words and texts are read whole; repeated rows are counted one by one; an empty
table gives an empty table.  Only the id and text columns are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = 256
SYMBOLS = 257
MOST_REMEMBERED, LONGEST_REMEMBERED = 1_000_000, 64
LONG_TEXT = 1 << 24
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_counts: dict[str, Counts] = {}


class Automaton:
    def __init__(self, pieces: Iterable[tuple[int, ...]]) -> None:
        """``pieces``: sequences of bytes, word-final ones with END behind."""
        edges: list[dict[int, int]] = [{}]
        final = [False]
        for piece in [*pieces, *((b,) for b in range(256))]:
            at = 0
            for symbol in piece:
                if symbol not in edges[at]:
                    edges[at][symbol] = len(edges)
                    edges.append({})
                    final.append(False)
                at = edges[at][symbol]
            final[at] = at > 0
        edges[0].setdefault(END, 0)  # an end mark alone is no piece
        fail, pops = [-1] * len(edges), [0] * len(edges)
        queue = [(0, s, v) for s, v in edges[0].items() if v]
        for parent, symbol, node in queue:
            if final[node]:
                fail[node], pops[node] = 0, 1
            else:
                link, popped = fail[parent], pops[parent]
                while link >= 0 and symbol not in edges[link]:
                    link, popped = fail[link], popped + pops[link]
                fail[node], pops[node] = (edges[link][symbol], popped) if link >= 0 else (-1, popped)
            queue += [(node, s, v) for s, v in edges[node].items()]
        self.edges = {u * SYMBOLS + s: v for u, out in enumerate(edges) for s, v in out.items()}
        self.fail, self.pops = fail, pops

    def count(self, word: bytes) -> int:
        """Pieces of a word."""
        edges, fail, pops = self.edges, self.fail, self.pops
        state = total = 0
        for symbol in chain(word, (END,)):
            while (to := edges.get(state * SYMBOLS + symbol)) is None:
                total += pops[state]
                state = fail[state]
            state = to
        while state > 0:
            total += pops[state]
            state = fail[state]
        return total


class Counts(dict):
    """word -> its number of pieces, remembered by the word itself."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= MOST_REMEMBERED:
                self.clear()
            self[word] = n
        return n


def vocabulary(path: str, end: str = "</w>") -> list[tuple[int, ...]]:
    """Pieces of a BPE tokenizer file that writes bytes as printable characters."""
    from cloakframe.llm.token_ids import _visible_bytes

    byte = {c: b for b, c in _visible_bytes().items()}
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    out = []
    for piece in entries:
        stem = piece[: -len(end)] if piece.endswith(end) else piece
        if stem and all(c in byte for c in stem):
            out.append(tuple(byte[c] for c in stem) + ((END,) if stem != piece else ()))
    return out


def count_text(text: str, counts: Counts) -> tuple[int, int]:
    """Words and tokens of a text."""
    data = text.encode("utf-8", "surrogatepass").lower()  # A-Z only, and split() parts at ASCII white space
    of = counts.__getitem__
    if len(data) < LONG_TEXT:
        words = data.split()
        return len(words), sum(map(of, words))
    n_words = n_tokens = 0
    for m in _WORD.finditer(data):
        n_words, n_tokens = n_words + 1, n_tokens + of(m.group())
    return n_words, n_tokens


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counts:
            _counts[path] = Counts(Automaton(vocabulary(path)))
        for batch in batches:
            found = [count_text(t.as_py() or "", _counts[path]) for t in batch.column(1)]
            words, tokens = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["id", "n_words", "n_tokens"])

    return run


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens): one row per input row.  ``path``: a tokenizer file."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(_count(path), f"id {kind}, n_words bigint, n_tokens bigint")
