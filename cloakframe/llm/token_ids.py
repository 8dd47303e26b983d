"""Token ids of many texts by a byte-level BPE tokenizer file.

Texts are cut into pretokens as the tokenizer cuts them: contractions, an
optional space before letters, numbers or other signs, and runs of white space.
Each distinct pretoken is encoded once by the tokenizer's own merges and
remembered by its text.

Texts without apostrophes, odd blanks and rare code points are cut together by
array operations, and equal pretokens are found by a hash whose groups are then
compared code point by code point; a group that is not of one text sends its
texts the other way.  The others are cut by a pattern one by one.  Texts with code
points that this Python does not know as assigned, for which the tokenizer's
tables may differ, go to the tokenizer as a whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import batched

import numpy as np
import regex

MOST_REMEMBERED, LONGEST_REMEMBERED = 1_000_000, 64
LONG_TEXT = 1 << 22
ODD, SPACE, LINE, LETTER, NUMBER, SIGN = range(6)
_encoders: dict[str, Encoder] = {}

# Fixed value: white space and the cut of byte-level BPE.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PRETOKEN = regex.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


def _classes() -> np.ndarray:
    """What the cut by arrays knows of the code points of the basic plane."""
    kinds = {"L": LETTER, "N": NUMBER, "P": SIGN, "S": SIGN, "M": SIGN}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], ODD) for c in range(1 << 16)), np.uint8, 1 << 16)
    table[ord(" ")], table[ord("\n")], table[ord("'")], table[0xFFFF] = SPACE, LINE, ODD, ODD
    return table


def _visible_bytes() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: itself, or one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (chr(0x100 + n) for n in range(256))
    return {b: chr(b) if b in shown else next(hidden) for b in range(256)}


class Pretokens(dict):
    """pretoken -> its ids as bytes, four to an id."""

    def __init__(self, model) -> None:
        super().__init__()
        self.merge, self.visible, self.most = model.tokenize, _visible_bytes(), MOST_REMEMBERED

    def __missing__(self, pretoken: str) -> bytes:
        shown = pretoken.encode().decode("latin-1").translate(self.visible)
        ids = np.fromiter((t.id for t in self.merge(shown)), "<u4").tobytes()
        if len(pretoken) <= LONGEST_REMEMBERED:
            if len(self) >= self.most:
                self.clear()
            self[pretoken] = ids
        return ids


class Encoder:
    """``encode`` returns the ids of all texts in one array, and the number of ids of each."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.of = Pretokens(self.tokenizer.model)
        self.assigned: set[str] = set()
        self.classes = _classes()
        draw = np.random.default_rng(7)
        self.letters = draw.integers(0, 1 << 63, 1 << 16, dtype=np.uint64)
        self.base = int(draw.integers(1 << 62, 1 << 63)) | 1
        self.powers = self.inverses = np.empty(0, np.uint64)

    def _odd(self, text: str) -> bool:
        """Whether some code point has no category here."""
        if text.isascii():
            return False
        new = set(text) - self.assigned
        if any(unicodedata.category(c) in ("Cn", "Cs") for c in new):
            return True
        self.assigned |= new
        return False

    def ids(self, text: str) -> bytes:
        """The ids of one text as bytes."""
        if self._odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        of = self.of.__getitem__
        if len(text) < LONG_TEXT:
            return b"".join(map(of, _PRETOKEN.findall(text)))
        found: Iterator[str] = (m.group() for m in _PRETOKEN.finditer(text))
        return b"".join(b"".join(map(of, some)) for some in batched(found, 1 << 16))

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [self.ids(t) for t in texts]
        return np.frombuffer(b"".join(made), "<u4"), np.fromiter(map(len, made), np.int64, len(made)) // 4

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", self.base), ("inverses", pow(self.base, -1, 1 << 64))):
                out = np.full(max(n, 1 << 16), base, np.uint64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))

    def _together(self, texts: list[str], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts, which begin at ``starts`` when they stand behind each other."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-16-le"), np.uint16)
        kind = self.classes[codes]
        before = kind[:-1]
        cut = np.ones(len(codes), bool)
        cut[1:] = (kind[1:] <= LINE) | (before == LINE) | ((kind[1:] != before) & (before != SPACE))
        cut[starts[starts < len(codes)]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(codes))
        self._grow(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self.letters[codes] * self.powers[: len(codes)], out=sums[1:])
        _, first, of = np.unique((sums[end] - sums[begin]) * self.inverses[begin], return_index=True, return_inverse=True)
        length = end - begin
        if (length != length[first][of]).any() or (codes != codes[np.arange(len(codes)) + np.repeat(begin[first][of] - begin, length)]).any():
            return self._each(texts)
        made = [self.of[joined[b:e]] for b, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        at, counts = (np.cumsum(sizes) - sizes)[of], sizes[of]
        total = np.append(0, np.cumsum(counts))
        ids = np.frombuffer(b"".join(made), "<u4")[np.repeat(at - total[:-1], counts) + np.arange(total[-1])]
        # ids before each text: those before the first pretoken at or after its start
        return ids, np.diff(total[np.searchsorted(begin, np.append(starts, len(codes)))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind, ends = self.classes[np.minimum(codes, 0xFFFF)], np.cumsum(sizes)
        gap, bad = (kind == SPACE) | (kind == LINE), kind == ODD
        double = gap[1:] & gap[:-1]
        double[ends[(ends > 0) & (ends < len(codes))] - 1] = False
        bad[1:] |= double
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(ends, np.flatnonzero(bad), side="right")] = True
        plain, lengths = [t for t, o in zip(texts, odd, strict=True) if not o], sizes[~odd]
        counts = np.zeros(len(texts), np.int64)
        ids, counts[~odd] = self._together(plain, np.cumsum(lengths) - lengths) if lengths.sum() else (np.empty(0, "<u4"), np.zeros(len(plain), np.int64))
        if not odd.any():
            return ids, counts
        rest, counts[odd] = self._each([t for t, o in zip(texts, odd, strict=True) if o])
        out, of_odd = np.empty(int(counts.sum()), "<u4"), np.repeat(odd, counts)
        out[of_odd], out[~of_odd] = rest, ids
        return out, counts


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]
