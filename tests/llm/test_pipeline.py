import importlib
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
corpus_pipeline = importlib.import_module("corpus_pipeline")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, votes int"


def table(spark, tmp_path, rows):
    spark.createDataFrame([(*r, None) for r in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def rows():
    draw = random.Random(12)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(900)]
    out = []
    for i in range(80):
        text = " ".join(draw.choice(words) for _ in range(draw.randint(60, 200)))
        if i % 10 == 0:
            text += ' token = "0123456789abcdef0123456789abcdef"'
        out.append((i, text, "en", None if i % 7 == 0 else f"s{i % 3}", len(text)))
    out += [(100 + i, out[i][1], "en", "s0", out[i][4]) for i in range(10)]
    out += [(200 + i, " ".join(draw.choice(words) + "###" for _ in range(80)), "en", "s1", 0) for i in range(10)]
    return [*out, (300, None, None, None, None), (301, "", "en", "s1", 0)]


def test_stages(spark, tmp_path):
    sf_dir = table(spark, tmp_path, rows())
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf_dir)
        assert out.columns == df.columns
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        seen.append({r["doc_id"]: r for r in df.collect()})
    clean = set(range(80))
    assert set(seen[0]) == clean | set(range(100, 110))
    assert set(seen[1]) == clean == set(seen[2]) == set(seen[3])
    for i in clean:
        assert ("[SECRET]" in seen[2][i]["text"]) == (i % 10 == 0)
        assert seen[2][i]["n_chars"] == len(seen[2][i]["text"])
        assert seen[2][i]["n_chars"] == seen[1][i]["n_chars"] or i % 10 == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == clean
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == clean


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, table(spark, tmp_path, [])).count() == 0


def test_odd_rows_and_columns(spark, tmp_path):
    """Different texts under one id, very long texts, columns whose names operators use or that hold signs."""
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    rows = [(i, text(80), "en", f"s{i % 2}", 0) for i in range(30)] + [(7, text(90), "en", "s0", 0), (None, text(70), None, None, None), (50, text(60_000) + " token = 'abcdef0123456789'", "en", "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in ("a.b", "q`r", "__key", "__place", "__row", "votes", "spans", "row", "label", "id"):
        df = df.withColumn(name, F.lit(name))
    found = []
    for parts in (1, 5):
        at = df.repartition(parts)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, at, "")
            assert out.columns == df.columns
            path = str(tmp_path / f"{name}{parts}")
            out.write.parquet(path)
            at = spark.read.parquet(path)
        kept = at.collect()
        assert all(r[c] == c for r in kept for c in df.columns[5:])
        assert sorted(str(r["doc_id"]) for r in kept) == sorted(map(str, [*range(30), None, 50]))
        assert [r["text"] for r in kept if r["doc_id"] == 50][0].endswith("[SECRET]'")
        found.append({r["doc_id"]: r["text"] for r in kept})
        assert corpus_pipeline.STAGES[-1][1](spark, at, "").select("doc_id").distinct().count() == 32
    assert found[0] == found[1]


def test_any_kinds_and_names_of_columns(spark, tmp_path):
    """Maps, arrays and structs, and every name that a stage might use itself, pass through unchanged."""
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(900)]
    made = [(i, " ".join(draw.choice(words) for _ in range(80)), "en", f"s{i % 2}", 0) for i in range(20)]
    df = spark.createDataFrame([*made, made[3], (40, *made[5][1:])], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    names = ["__gone", "__id", "__source", "__crc", "__position", "gone", "place", "part", "position", "crc", "of_id", "of_source", "of_crc", "p1", "p2", "row", "clean", "id", "slot", "block", "component_id"]
    for name in names:
        df = df.withColumn(name, F.lit(f"{name}!"))
    df = df.withColumns({"m": F.create_map(F.lit("a"), F.col("doc_id")), "deep": F.array(F.struct(F.create_map(F.lit(1), F.lit("x")).alias("m"))), "s": F.struct(F.lit(1).alias("a.b"), F.lit(None).cast("string").alias("c"))})
    at = df
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, "")
        assert out.columns == df.columns
        out.write.parquet(str(tmp_path / str(n)))
        at = spark.read.parquet(str(tmp_path / str(n)))
    kept = at.collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(20))
    for r in kept:
        assert all(r[c] == f"{c}!" for c in names)
        assert r["m"] == {"a": r["doc_id"]} and r["deep"][0]["m"] == {1: "x"} and r["s"]["a.b"] == 1
    assert corpus_pipeline.STAGES[-1][1](spark, at, "").select("doc_id").distinct().count() == 20


def test_stage_files_go_when_a_stage_fails(spark, tmp_path, monkeypatch):
    sf_dir, place = table(spark, tmp_path, rows()), tmp_path / "shared"
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda _: str(place))

    def fails(spark, docs, sf_dir):
        raise RuntimeError("no")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:1], ("fails", fails)])
    with pytest.raises(RuntimeError, match="no"):
        corpus_pipeline.run(spark, sf_dir)
    assert not list(place.glob("*"))
