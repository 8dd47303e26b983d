import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import near_dedup, nearest
from cloakframe.llm.graph import components

DOCS = "doc_id bigint, text string, id bigint, n bigint, kept boolean"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)


def shingles(text, width):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def plain_components(texts, width):
    sets = [shingles(t, width) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def corpus():
    draw = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    fresh = lambda n: [draw.choice(words) for _ in range(n)]

    def changed(base, k):
        out = list(base)
        for at in draw.sample(range(len(base)), k):
            out[at] = draw.choice(words)
        return out

    texts = [None, "", " \n", "one", "One", "one two", "one two three"]
    for n in (30, 80, 200, 400):
        base = fresh(n)
        texts += [" ".join(base), " ".join(base).upper(), "\n".join(base)]
        texts += [" ".join(changed(base, max(1, n // 40))) for _ in range(6)] + [" ".join(changed(base, n // 6)) for _ in range(3)]
    common = fresh(60)  # a passage that unlike texts share
    texts += [" ".join(fresh(40) + common + fresh(40)) for _ in range(60)]
    chain = fresh(120)  # each near the one before, the last far from the first
    for _ in range(8):
        texts.append(" ".join(chain))
        chain = changed(chain, 5)
    base = fresh(100)  # a large group of near copies
    texts += [" ".join(changed(base, 4)) for _ in range(150)]
    return texts


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_all_pairs(spark, width):
    texts = corpus()
    sizes, roots = plain_components(texts, width)
    got = {r["id"]: r for r in near_dedup.near_duplicates(docs(spark, texts), forest=near_dedup.Forest(width=width)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == roots
    assert all(got[i]["kept"] == (roots[i] == i) for i in range(len(texts)))


def test_dedup_keeps_columns_and_one_of_each(spark):
    texts = ["a b c d e f g", "x y z u v w", "A b c d e f g", None]
    df = docs(spark, texts).unionByName(docs(spark, texts[:2])).unionByName(docs(spark, ["a b c d e f g"]).withColumn("doc_id", F.lit(None).cast("bigint")))
    out = near_dedup.one_of_each(df)
    assert out.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["0", "1", "3", "None"]
    got = near_dedup.near_duplicates(df).filter("id is null").first()
    assert got["component_id"] is None and got["kept"]
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    assert near_dedup.one_of_each(docs(spark, [])).count() == 0


def test_pairs_far_apart_in_a_crowd(spark):
    draw = random.Random(8)
    template = [f"t{i}" for i in range(160)]
    own = lambda i, k: [f"d{i}x{j}" for j in range(k)]
    texts = [" ".join(template + own(i, 40)) for i in range(3000)]
    pairs = {i: i + 1500 for i in draw.sample(range(1500), 40)}
    for i, j in pairs.items():  # 186 of 214 shingles are common to both
        texts[j] = " ".join(template + own(i, 26) + own(j, 14))
    few = near_dedup.Forest(width=1, trees=2, depth=2, shallow=1, reach=4, offers=2, least_alike=0.0)
    got = {r["id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(spark, texts), forest=few).collect()}
    root = {j: i for i, j in pairs.items()}
    assert got == {i: root.get(i, i) for i in range(len(texts))}


def test_windows_over_several_small_partitions(spark):
    draw = np.random.default_rng(3)
    forest = near_dedup.Forest(trees=2, depth=2, shallow=1, reach=12, offers=99, least_alike=0.0)
    rows = [(i, 10, near_dedup._path(draw.integers(0, 3, 4).astype(np.uint32)).tobytes(), bytes(8)) for i in range(60)]
    classes = spark.createDataFrame(rows, "id bigint, n bigint, orders binary, sketch binary")
    names, found = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"), {}
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[1], "false")
        for parts in (1, 40):
            spark.conf.set(names[0], str(parts))
            found[parts] = {(r["a"], r["b"]) for r in near_dedup.candidates(classes, forest).collect() if r["a"] < r["b"]}
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert len(found[1]) > 300 and found[1] <= found[40]


def test_components(spark):
    draw = random.Random(1)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(70)] + [(9, 9)]
    root = list(range(500))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in {x for link in links for x in link}}


# -- nearest neighbours -------------------------------------------------------
def plain_nearest(rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for n, i in enumerate(ids):
        if i % 20 == 0:
            s = x @ x[n]
            order = [m for m in np.lexsort((ids, -s)) if ids[m] != i][:k]
            out[int(i)] = [(int(ids[m]), float(s[m])) for m in order]
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_against_all_pairs(spark, scaled):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scaled:
        x *= draw.uniform(0.2, 3, (1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("r", F.lit(1)).withColumn("h1", F.lit(2))
    got = collections.defaultdict(list)
    for r in nearest.nearest_neighbours(df, F.col("id") % 20 == 0, nearest=10).orderBy("query_id", "rank").collect():
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), abs=1e-12)
        got[r["query_id"]].append(r["vec_id"])
    truth = plain_nearest(rows, 10)
    hits = sum(len({i for i, _ in truth[q]} & set(got[q])) for q in truth)
    assert hits >= 0.9 * 10 * len(truth)


def share_found(index, x, asked, near):
    """(share of the true nearest in visited buckets, share of the table visited)."""
    score = asked @ x.T
    score[score > 1 - 1e-9] = -9
    true = np.argpartition(-score, near, axis=1)[:, :near]
    setting = nearest.choose(index, x[: index.sample].astype(float), asked[: index.sample_queries].astype(float), near, len(x), 1.0)
    hasher, seen = nearest.Hasher(index, setting, len(x), x.shape[1], 1.0), np.zeros(score.shape, bool)
    lifted, q = hasher.lifted(x.astype(float), False), hasher.lifted(asked.astype(float), True)
    for t in range(setting.tables):
        buckets = hasher.bucket(np.floor(hasher.cells(t, lifted)))
        seen |= np.array([np.isin(buckets, p) for p in hasher.probes(t, q)])
    return np.take_along_axis(seen, true, 1).mean(), seen.mean(), setting


@pytest.mark.parametrize("n", [2_000, 50_000, 200_000])
def test_recall_in_large_tables_of_random_vectors(n):
    x = np.random.default_rng(1).normal(size=(n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, _, _ = share_found(nearest.Index(), x, x[-60:], 20)
    assert found >= 0.93


def test_selective_where_vectors_have_neighbours():
    draw = np.random.default_rng(3)
    centre = draw.normal(size=(800, 48))
    x = centre[draw.integers(0, 800, 40_000)] + 0.35 * draw.normal(size=(40_000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, visited, _ = share_found(nearest.Index(), x, x[-60:], 20)
    assert found >= 0.93 and visited < 0.4


def test_equal_bad_and_few_vectors(spark):
    nan = float("nan")
    rows = [(i, [1.0, 0.0]) for i in range(0, 60)] + [(100, [0.0, 1.0]), (101, None), (102, [0.0, 0.0]), (103, [1.0, None]), (104, [1.0, nan]), (105, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (120, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(list)
    for r in nearest.nearest_neighbours(df, F.col("id") % 20 == 0, nearest=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) >= {0, 20, 40} and 120 not in got
    for q in (0, 20, 40):
        assert got[q] == [(n + 1, i, 1.0) for n, i in enumerate([i for i in range(60) if i != q][:20])]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id bigint, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in nearest.nearest_neighbours(few, F.col("id") % 20 == 0).collect()] == [(1, 0.5)]
    assert nearest.nearest_neighbours(few.limit(0), F.col("id") % 20 == 0).count() == 0


def test_large_buckets_are_cut(spark):
    draw = np.random.default_rng(5)
    x = np.concatenate([np.array([1.0, 0, 0, 0]) + draw.normal(size=(400, 4)) * 1e-4, draw.normal(size=(100, 4))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    small = nearest.Index(most_in_bucket=60, group=200)
    got = {(r["query_id"], r["vec_id"]) for r in nearest.nearest_neighbours(df, F.col("id") % 20 == 0, nearest=5, index=small).collect()}
    truth = {(q, i) for q, found in plain_nearest(rows, 5).items() for i, _ in found}
    assert len(got & truth) >= 0.9 * len(truth)


@pytest.mark.parametrize("sigma", [0, 1, 2, 3])
def test_neighbours_of_vectors_of_any_length(spark, sigma):
    """Log-normal lengths: every query gets all its rows, nine of ten of them right, scores summed component by component."""
    draw, n = np.random.default_rng(sigma), 3000
    x = draw.normal(size=(n, 24))
    x *= np.exp(sigma * draw.normal(size=(n, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(5)
    got = nearest.nearest_neighbours(df, F.col("id") % 20 == 0).collect()
    asked = np.arange(0, n, 20)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    true = {(q, int(i)) for q, row in zip(asked.tolist(), np.argsort(-score, axis=1)[:, :20], strict=True) for i in row}
    assert len(got) == 20 * len(asked)
    assert len({(r["query_id"], r["vec_id"]) for r in got} & true) >= 0.9 * len(true)
    for r in got[:200]:
        total = 0.0
        for a, b in zip(x[r["query_id"]].tolist(), x[r["vec_id"]].tolist(), strict=True):
            total += a * b
        assert r["score"] == total
