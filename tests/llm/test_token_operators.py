"""Encoding, alignment and fill-in-middle against plain versions."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import alignment, bpe, fill_middle, oracles, queries
from cloakframe.llm.fill_middle import Cutter, Plan, Units

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
MORE = ", id string, links int, key string, n string, ids int, form int, `b.c` int, output map<string,int>"
WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))

ODD = [
    None, "", " ", " \n\t", "Hello WORLD's <|endoftext|>café ΣΑΣ don't we'LL", "<|startoftext|><|endoftext|><|start <s> </s> <unk> <0x41>",
    "é ﬁ İstanbul ǅ \x1c\x1d a\x00b \x85   ½ Ⅷ ٣ 一二三 😀👍🏽 ́x", "a​c　d ﻿abc \U000e0001 ͸", "가각 가 à̕b",
    "x" * 5000, "ab" * 40_000, "a  b", "trail   ", "▁a b", "a <P> b", "<S>", "<M", "<P", ">", "1234 5.6", "𝄞" * 9,
]


def texts():
    draw = random.Random(7)
    kinds = [(32, 127), (0xA0, 0x600), (0x300, 0x370), (0x3040, 0x3100), (0x4E00, 0x5000), (0xAC00, 0xAD00), (0x1F300, 0x1F700), (9, 14)]
    made = ["".join(chr(draw.randrange(*draw.choice(kinds))) for _ in range(draw.randint(1, 60))) for _ in range(200)]
    words = ["".join(draw.choice("etaoinshrdlucmfé") for _ in range(draw.randint(1, 9))) for _ in range(300)]
    made += [" ".join(draw.choice(words) for _ in range(draw.randint(1, 200))) + draw.choice(["", "\n", " end. "]) for _ in range(60)]
    return [*ODD, *made, "same text twice", "same text twice"]


def documents(spark, some, more=False):
    rows = [(None if i == 3 else i, t, "en", "s", len(t or "")) + ((None,) * 8 if more else ()) for i, t in enumerate(some)]
    return spark.createDataFrame(rows, DOCS + (MORE if more else "")).repartition(5)


def on_disk(spark, tmp_path, some):
    documents(spark, some).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# -- encoding -----------------------------------------------------------------
def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_encoding_query_equals_the_library(spark, tmp_path):
    some, plain = texts(), library(WORD)
    got = collections.Counter(tuple(r) for r in queries.op11_bpe(spark, on_disk(spark, tmp_path, some)).collect())
    expected = collections.Counter()
    for i, t in enumerate(some):
        ids = plain.encode(t or "", add_special_tokens=False).ids
        expected[(None if i == 3 else i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(plain.decode(ids, skip_special_tokens=False)))] += 1
    assert got == expected


def test_encoding_round_trip_and_odd_tables(spark):
    some = texts()
    done = bpe.encode_documents(documents(spark, some, True), WORD)
    back = bpe.decode_ids(done, WORD)
    assert sorted((r["decoded"] for r in done.collect())) == sorted(r["decoded"] for r in back.collect())
    assert bpe.encode_documents(documents(spark, some).limit(0), WORD).collect() == []
    assert bpe.decode_ids(spark.createDataFrame([(1, None)], "id bigint, ids binary"), WORD).first()["decoded"] == ""


def test_merges_by_least_rank_first():
    merges = bpe.codec(WORD).merges
    draw = random.Random(3)

    def plain(symbols):
        at = list(symbols)
        while found := [(*merges.of[p], i) for i, p in enumerate(zip(at, at[1:], strict=False)) if p in merges.of]:
            _, new, i = min(found, key=lambda x: (x[0], x[2]))
            at[i : i + 2] = [new]
        return at

    for _ in range(300):
        symbols = merges.symbols("".join(draw.choice("etaoinsh") for _ in range(draw.randint(1, 40))))
        assert merges.merged(symbols) == plain(symbols)


# -- alignment ----------------------------------------------------------------
def plain_alignment(some):
    """Each text's tokens, groups and links by comparing all token ranges."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a_model.encode_special_tokens = True
    visible = {c: b for b, c in __import__("cloakframe.llm.token_ids", fromlist=["x"])._visible_bytes().items()}
    out, total = [], collections.Counter()
    for t in some:
        if not t:
            out.append(None)
            continue
        a = [(i, bytes(visible[c] for c in a_model.id_to_token(i))) for i in a_model.encode(" " + t, add_special_tokens=False).ids]
        b = []
        for i in b_model.encode(t):
            p = b_model.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()))
        whole = (" " + t).encode()
        if b"".join(w for _, w in a) != whole or b"".join(w for _, w in b) != whole:
            out.append(None)
            continue
        ranges = []
        for side in (a, b):
            at, found = 0, []
            for i, w in side:
                found.append((at, at + len(w), i))
                at += len(w)
            ranges.append(found)
        links = [(x[2], y[2]) for x in ranges[0] for y in ranges[1] if x[0] < y[1] and y[0] < x[1]]
        total.update(links)
        cuts = sorted({x[1] for x in ranges[0]} & {y[1] for y in ranges[1]})
        groups = [[[i for s, e, i in side if lo <= s and e <= hi] for side in ranges] for lo, hi in zip([0, *cuts], cuts, strict=False)]
        out.append((len(a), len(b), groups, links))
    best = collections.defaultdict(int)
    for (_, j), n in total.items():
        best[j] = max(best[j], n)
    rows = []
    for found in out:
        if found is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = found
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        rows.append((n_a, n_b, len(groups), len(links), sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links), sha(text)))
    return rows, total


def test_alignment_query_against_plain(spark, tmp_path):
    some = [t for t in texts() if not t or len(t) < 1000]
    got = collections.Counter(tuple(r) for r in queries.op12_token_alignment(spark, on_disk(spark, tmp_path, some)).collect())
    rows, _ = plain_alignment(some)
    assert got == collections.Counter((None if i == 3 else i, *r) for i, r in enumerate(rows))


def test_alignment_counts_and_blocks(spark, monkeypatch):
    """Small blocks and early partial counts give the same; very long texts, empty tables and clashing names work."""
    some = [*texts(), "the cat " * 20_000]
    monkeypatch.setattr(alignment, "BLOCK", 500)
    monkeypatch.setattr(alignment, "MOST_COUNTED", 50)
    pair = alignment.Pair(BYTE, PIECE)
    short = [t for t in some if not t or len(t) < 1000]
    links, counts = alignment.links_of(pair, short)
    rows, total = plain_alignment(short)
    assert counts.tolist() == [r[3] for r in rows]
    parts = pa_batches(links, 37)
    summed = collections.Counter()
    for batch in alignment._partial(parts):
        for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            summed[(k >> alignment.ABOVE, k & alignment.LOW)] += n
    assert summed == total
    done, _ = alignment.align(documents(spark, some, True), pair)
    assert done.count() == len(some)
    long = done.filter(F.col("id") == len(some) - 1).first()
    assert long["n_links"] >= max(long["n_a"], long["n_b"]) > 20_000
    empty, none = alignment.align(documents(spark, some).limit(0), pair)
    assert empty.collect() == [] and none.shards == ()


def pa_batches(links, n):
    import pyarrow as pa

    for at in range(0, len(links), n):
        part = links[at : at + n]
        yield pa.RecordBatch.from_arrays([pa.array([len(part)]), pa.array([alignment._packed(part)], pa.binary())], names=["n_links", "links"])


def test_shards_are_found_in_a_shared_folder(spark, tmp_path):
    done, counts = alignment.align(documents(spark, texts()), alignment.Pair(BYTE, PIECE))
    keys = np.concatenate([np.fromfile(alignment._place(f"{counts.folder}/{n}.keys")[1], "<i8") for n, _, _ in counts.shards])
    assert (np.diff(keys) > 0).all()
    assert counts.of(keys).sum() == done.agg(F.sum("n_links")).first()[0]
    assert counts.best.max() == counts.of(keys).max()


def test_texts_that_do_not_fit():
    side = alignment.Bytes([b"a", b"bc", b"d"])
    ids, counts = np.array([0, 1, 2, 2, 0, 1]), np.array([2, 1, 0, 2, 1])
    raw = [b"abc", b"x", b"", b"dd", b"bc"]
    sizes = np.array([len(r) for r in raw])
    assert alignment._fits(side, ids, counts, np.frombuffer(b"".join(raw), np.uint8), sizes).tolist() == [True, False, True, False, True]


# -- fill in middle -----------------------------------------------------------
def test_fill_in_middle_query_equals_its_sql(spark, tmp_path):
    some = texts() + [f"text number {i} of many " * (i % 7) for i in range(300)]
    folder = on_disk(spark, tmp_path, some)
    df = queries.op13_fill_middle(spark, folder)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = connection.execute(oracles.ORACLES["op13_fill_middle"])
    assert [d[0] for d in found.description] == df.columns
    got = df.collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(found.fetchall())
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert all(r["restored_sha256"] == sha(some[3 if r["doc_id"] is None else r["doc_id"]] or "") for r in got)


@pytest.mark.parametrize("units", [Units(), Units(3), Units(None, " \n"), Units(4, ".\n "), Units(None, ""), Units(2, "")])
def test_units_by_arithmetic(units):
    def plain(text):
        out, gap = [], ""
        for c in text:
            if c in units.breaks:
                out += ([gap] if gap else []) + [c]
                gap = ""
            else:
                gap += c
                if units.width and len(gap) == units.width:
                    out.append(gap)
                    gap = ""
        return out + ([gap] if gap else [])

    cutter = Cutter(Plan(units=units))
    for t in [t or "" for t in texts() if not t or len(t) < 500]:
        ranks, expected = cutter.scan(t), plain(t)
        assert ranks.n == len(expected)
        assert [ranks.offset(k) for k in range(len(expected) + 1)] == [len("".join(expected[:k])) for k in range(len(expected) + 1)]
        assert ranks.marked == any(m in t for m in ("<P>", "<S>", "<M>"))


def test_fill_in_middle_of_words_and_own_marks(spark):
    plan = Plan(key="k", units=fill_middle.WORDS, moved=100, suffix_first=50, prefix_mark="<|pre|>", suffix_mark="<|suf|>", middle_mark="<|mid|>")
    some = texts()
    done = fill_middle.fill_in_middle(documents(spark, some, True), plan)
    rows = done.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), plan)).collect()
    assert len(rows) == len(some)
    for r in rows:
        text = some[3 if r["id"] is None else r["id"]] or ""
        assert r["back"] == text
        if r["form"] != "plain":
            for cut in (r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]):
                assert cut in (0, len(text)) or text[cut - 1] in " \t\n\v\f\r" or text[cut] in " \t\n\v\f\r"
    assert fill_middle.fill_in_middle(documents(spark, some).limit(0), plan).collect() == []
