import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.operators.anonymiser import Anonymiser
from cloakframe.operators.clustering import Clustering, Points, fmdav, mdav, random_choice
from cloakframe.operators.components import PrincipalComponents
from cloakframe.operators.images import KSame
from cloakframe.operators.models import EARTH_MOVER, MAX_DISTANCE, Distance, DistinctLDiversity, KAnonymity, PrivacyModel, TCloseness, check
from cloakframe.operators.mondrian import Mondrian, numbered, searched_medians
from cloakframe.operators.republication import MInvariance, buckets_for
from cloakframe.plans.roles import GROUP, RID, with_row_id


def people(spark, n=600, seed=3):
    draw = np.random.default_rng(seed)
    rows = [(i, int(draw.integers(0, 80)), float(draw.normal()), "abcde"[draw.integers(5)], "xyz"[draw.integers(3)]) for i in range(n)]
    return spark.createDataFrame(rows, f"{RID} bigint, age int, w double, job string, s string")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r[GROUP], set()).add(r[RID])
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("models", [(KAnonymity(10),), (KAnonymity(5), DistinctLDiversity(3, "s")), (KAnonymity(20), TCloseness(0.2, "s")), (KAnonymity(20), TCloseness(0.2, "s", EARTH_MOVER))])
def test_mondrian_distributed_equals_local(spark, models):
    df = people(spark)
    features = ("age", "job", "w")
    apart = Mondrian(models, features, local_rows=50).partition(df)
    whole = Mondrian(models, features, local_rows=10**6).partition(df)
    assert groups(apart) == groups(whole)
    assert sorted(i for g in groups(whole) for i in g) == list(range(600))
    assert check(df.join(whole, RID), GROUP, list(models)).filter(~F.col("ok")).isEmpty()
    assert len(groups(whole)) > 3


def test_searched_medians(spark):
    draw = np.random.default_rng(8)
    rows = [("odd", float(x), 1.0) for x in draw.normal(size=301)] + [("even", float(x), float(x) ** 9) for x in draw.integers(-3, 4, 200)] + [("one", 5.0, -1e300), ("wide", -1e300, 2.0), ("wide", 1e300, 2.0), ("wide", 1e-300, 3.0)]
    df = spark.createDataFrame(rows, "pid string, n0 double, n1 double")
    sizes = df.groupBy("pid").agg(F.count(F.lit(1)).alias("rows"))
    got = {r["pid"]: (r["m_n0"], r["m_n1"]) for r in searched_medians(df, sizes, ["n0", "n1"], buckets=4).collect()}
    for p in ("odd", "even", "one", "wide"):
        assert got[p] == (np.median([x for q, x, _ in rows if q == p]), np.median([y for q, _, y in rows if q == p]))
    people_ = people(spark, 300)
    plain, searched = (groups(Mondrian((KAnonymity(40),), ("age", "w"), local_rows=0, median_rows=n).partition(people_)) for n in (10**6, 90))
    assert plain == searched


def test_mondrian_rejects_null_numbers(spark):
    df = spark.createDataFrame([(0, None), (1, 2)], f"{RID} bigint, a int")
    with pytest.raises(ValueError, match="null"):
        Mondrian((KAnonymity(1),), ("a",)).partition(df)


def test_mondrian_numbers_are_breadth_first(spark):
    found = numbered(Mondrian((KAnonymity(100),), ("age",)).partition(people(spark)))
    assert {r[GROUP] for r in found.collect()} == set(range(found.select(GROUP).distinct().count()))


def test_empty_table(spark):
    empty = people(spark).limit(0)
    assert Mondrian((KAnonymity(3),), ("age",)).partition(empty).count() == 0
    assert Clustering(3, ("age",)).partition(empty).count() == 0


def test_models_at_their_limits(spark):
    df = spark.createDataFrame([("a", v) for v in "112334"], "g string, s string")
    part = df.filter(F.col("s").isin("1", "2")).limit(2)
    assert KAnonymity(6).holds(df, "g").first()["ok"]
    assert not KAnonymity(7).holds(df, "g").first()["ok"]
    assert DistinctLDiversity(4, "s").holds(df, "g").first()["ok"]
    assert not DistinctLDiversity(5, "s").holds(df, "g").first()["ok"]
    local = spark.createDataFrame([("a", "1"), ("a", "2")], "g string, s string")
    for distance, far in ((MAX_DISTANCE, 2 / 6), (EARTH_MOVER, 0.5)):
        got = TCloseness(0.1, "s", distance).distances(local, "g", whole=df).first()["distance"]
        assert got == pytest.approx(far)
    assert part.count() == 2


def test_mdav_clusters():
    x = np.array([[0, 0], [1, 1], [10, 10], [11, 11], [50, 50], [51, 52.0]])
    sets = lambda c: sorted(tuple(np.flatnonzero(c == k)) for k in set(c))
    points = Points(x, np.empty((6, 0), int), True)
    assert sets(mdav(points, 2)) == [(0, 1), (2, 3), (4, 5)]
    assert sets(fmdav(points, 2)) == [(0, 1), (2, 3), (4, 5)]


def test_mdav_categories(spark):
    rows = [(0, "a", "x"), (1, "a", "x"), (2, "b", "y"), (3, "b", "y"), (4, "c", "z"), (5, "c", "z")]
    df = spark.createDataFrame(rows, f"{RID} bigint, p string, q string")
    assert groups(Clustering(2, ("p", "q")).partition(df)) == [[0, 1], [2, 3], [4, 5]]


@pytest.mark.parametrize("algorithm", ["mdav", "fmdav", "random"])
def test_cluster_sizes(spark, algorithm):
    found = groups(Clustering(7, ("age", "w"), algorithm).partition(people(spark, 200)))
    assert all(7 <= len(g) <= 13 for g in found)
    assert sum(map(len, found)) == 200


def test_blocks_of_a_large_table(spark):
    found = groups(Clustering(5, ("age", "w"), block_rows=100).partition(people(spark, 400)))
    assert all(5 <= len(g) <= 9 for g in found)
    assert sum(map(len, found)) == 400


def test_k_same_of_many_images(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 6))
    images = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "image_id bigint, pixels array<double>")
    got = KSame(5, "pixel", "mdav", block_rows=100).anonymise(images).toPandas()
    assert sorted(got["image_id"]) == list(range(300)) and got["cluster"].str.split(":").str[0].nunique() > 2
    for _, g in got.groupby("cluster"):
        assert len(g) >= 5 and np.allclose(np.array(g["pixels"].tolist()), x[g["image_id"]].mean(axis=0))


def test_k_same(spark):
    images = spark.createDataFrame([(0, [0.0, 1.0, 2.0]), (1, [2.0, 3.0, 4.0]), (2, [90.0, 80.0, 70.0]), (3, [92.0, 82.0, 72.0])], "image_id bigint, pixels array<double>")
    for variant in ("pixel", "eigen"):
        got = {r["image_id"]: r["pixels"] for r in KSame(2, variant, "mdav").anonymise(images).collect()}
        assert got[0] == pytest.approx([1, 2, 3]) and got[1] == got[0]
        assert got[2] == pytest.approx([91, 81, 71]) and got[3] == got[2]


def release(spark, rows):
    return spark.createDataFrame(rows, "ID bigint, QI1 string, QI2 int, S int")


FIRST = [(0, "A", 10, 1), (1, "A", 12, 2), (2, "B", 20, 3), (3, "B", 21, 4)]


def invariant(spark, rows):
    model = MInvariance(2, ("QI1", "QI2"), "S")
    last = release(spark, FIRST)
    before, fakes = model.partition(last)
    assert fakes.isEmpty()
    found, fakes = model.partition(release(spark, rows), last, before)
    classes = {}
    for r in found.collect():
        classes.setdefault(r[GROUP], set()).add(r["ID"])
    made = {}
    for r in fakes.collect():
        made.setdefault(r[GROUP], {})[int(r["S"])] = r["n"]
    return sorted(map(sorted, classes.values())), {tuple(sorted(classes.get(g, ()))): v for g, v in made.items()}


def test_m_invariance(spark):
    assert invariant(spark, FIRST) == ([[0, 1], [2, 3]], {})
    assert invariant(spark, [*FIRST, (4, "C", 20, 5), (5, "A", 10, 1)]) == ([[0, 1], [2, 3], [4, 5]], {})
    assert invariant(spark, [FIRST[0], *FIRST[2:]]) == ([[0], [2, 3]], {(0,): {2: 1}})
    assert invariant(spark, [*FIRST[:3], (4, "C", 20, 4)]) == ([[0, 1], [2, 4]], {})
    found, fakes = invariant(spark, [*FIRST[:3], (4, "C", 20, 5)])
    assert found == [[0, 1], [2], [4]]
    assert fakes[(2,)] == {4: 1}
    assert len(fakes[(4,)]) == 1 and 5 not in fakes[(4,)]


def test_anonymiser_end_to_end(spark):
    df = spark.createDataFrame(
        [(28, "M", "4711", "flu"), (30, "F", "4711", "cold"), (31, "F", "4711", "flu"), (50, "M", "4999", "flu"), (54, "F", "4999", "cold"), (57, "F", "4999", "cough")],
        "age int, sex string, `zip code` string, diagnosis string",
    )
    out = Anonymiser(df, "diagnosis", ["age", "sex", "zip code"], "human-readable", k=3, l=2, row_key=["age"]).anonymise()
    assert out.columns == ["age", "sex", "zip code", "diagnosis", "count"]
    assert {(r["age"], r["zip code"]) for r in out.collect()} == {("28-31", "4711"), ("50-57", "4999")}
    assert out.agg(F.sum("count")).first()[0] == 6


@pytest.mark.parametrize(
    ("options", "error"),
    [
        ({"k": 0}, ValueError), ({"k": 7}, ValueError), ({"k": 2.0}, TypeError), ({"l": 0}, ValueError), ({"t": 1}, TypeError), ({"t": 1.5}, ValueError),
        ({"sensitive_column": "no"}, ValueError), ({"feature_columns": ["no"]}, ValueError), ({"generalisation_strategy": "no"}, TypeError), ({"algorithm": "no"}, ValueError),
        ({"l": 2, "diversity_definition": "entropy"}, NotImplementedError), ({"l": 2, "diversity_definition": "no"}, ValueError), ({"t": 0.5, "closeness_metric": "no"}, ValueError),
        ({"l": 2, "algorithm": "MDAV-generic"}, ValueError), ({"l": 2, "sensitive_column": None}, ValueError), ({"t": 0.5, "closeness_metric": "earth mover's distance", "sensitive_column": "age"}, NotImplementedError),
    ],
)
def test_anonymiser_rejects(spark, options, error):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "age int, s string")
    with pytest.raises(error):
        Anonymiser(df, **({"sensitive_column": "s", "feature_columns": ["age"]} | options))


def test_row_ids(spark):
    df = with_row_id(spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "n int, v string"), ["n"])
    assert sorted((r[RID], r["n"]) for r in df.collect()) == [(0, 1), (1, 2), (2, 3)]


def test_row_ids_of_wide_rows_under_adaptive_execution(spark):
    """Partitions that adaptive execution merges keep every row, numbered once."""
    df = spark.range(60_000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("a"), F.xxhash64("id").alias("b"), F.repeat(F.lit("x"), 400).alias("wide"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = with_row_id(df, ["a", "b"]).select(RID, "a", "b").orderBy("a", "b").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[RID].tolist() == list(range(60_000))


def test_models_metrics_and_partitioners_of_ones_own(spark):
    class MostHalf(PrivacyModel):
        """A model of one's own: no sensitive value makes up more than half of a class."""

        sensitive = "s"

        def holds(self, df, group):
            return df.groupBy(group, "s").count().groupBy(group).agg((2 * F.max("count") <= F.sum("count")).alias("ok"))

        def holds_class(self, ranks, counts, shares, whole):
            return 2 * counts.max() <= counts.sum()

    rows = [(i, float(i * 37 % 101), f"c{i % 3}", f"s{i % 2 if i % 5 else 2}") for i in range(120)]
    df = spark.createDataFrame(rows, f"{RID} bigint, x double, c string, s string")
    own = Distance("largest square", lambda p, q: float(((p - q) ** 2).max()))
    for models in ((KAnonymity(15), MostHalf()), (KAnonymity(15), TCloseness(0.02, "s", own))):
        found = [{r[RID]: r[GROUP] for r in Mondrian(models, ("x", "c"), local_rows=n).partition(df).collect()} for n in (60, 1000)]
        assert found[0] == found[1] and len(set(found[0].values())) > 2
        parts = df.join(Mondrian(models, ("x", "c")).partition(df), RID)
        assert check(parts, GROUP, list(models)).filter("not ok").isEmpty()

    class Tens:
        def partition(self, df):
            return df.select(RID, F.floor(F.col("x") / 10).alias(GROUP))

    release = Anonymiser(df.select(RID, "x", "s"), "s", ["x"], "microaggregation", k=2, algorithm=Tens()).anonymise()
    assert release.agg(F.sum("count")).first()[0] == 120 and release.select("x").distinct().count() == 11
    with pytest.raises(ValueError, match="unknown algorithm"):
        Anonymiser(df, "s", ["x"], algorithm="none")


@pytest.mark.parametrize("values", [
    [float(i) for i in range(50)] + [float("inf")] * 3,
    [float("-inf")] * 4 + [1e308, -1e308, 0.0, -0.0, 5e-324, 1e-300] * 3 + [float("inf")] * 5,
    [10.0**k for k in range(-300, 300, 7)] + [-(3.0**k) for k in range(-600, 600, 13)],
    [float("inf")] * 30 + [1.0] * 31,
])
def test_any_numbers_are_parted_alike_in_every_way(spark, values):
    """Infinite and very large numbers: medians searched or gathered, partitions finished locally or not."""
    import random

    draw = random.Random(1)
    rows = [(i, v, draw.randint(0, 9), draw.choice("abcd")) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "_rid bigint, x double, y int, s string")
    found = []
    for local_rows, median_rows in ((0, 5), (20, 1_000_000), (10_000, 1_000_000)):
        models = (KAnonymity(8), DistinctLDiversity(2, "s"))
        parts = Mondrian(models, ("x", "y"), local_rows=local_rows, median_rows=median_rows).partition(df).collect()
        found.append(sorted((r["_rid"], r["group_id"]) for r in parts))
    assert all(f == found[0] for f in found)
    assert len({g for _, g in found[0]}) > 1


def test_numbers_that_are_none_are_refused(spark):
    for bad in (None, float("nan")):
        df = spark.createDataFrame([(i, float(i) if i else bad) for i in range(20)], "_rid bigint, x double")
        for local_rows in (0, 1000):
            with pytest.raises(ValueError, match="NaN"):
                Mondrian((KAnonymity(2),), ("x",), local_rows=local_rows).partition(df)


def test_medians_in_few_passes(spark, monkeypatch):
    from cloakframe.operators import mondrian

    passes = []
    real = mondrian.cut
    monkeypatch.setattr(mondrian, "cut", lambda df: passes.append(1) or real(df))
    values = [(2.0**k) * (1 + j / 7) * s for k in range(-1000, 1000, 50) for j in range(6) for s in (1, -1)] + [float("inf")] * 9
    rows = spark.createDataFrame([("R", v) for v in values], "pid string, n0 double")
    got = mondrian.searched_medians(rows, spark.createDataFrame([("R", len(values))], "pid string, rows bigint"), ["n0"], 64).first()
    import statistics

    assert got["m_n0"] == statistics.median(values) and len(passes) <= 1 + 9


def pictures(spark, x, parts=5):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "image_id bigint, pixels array<double>").repartition(parts)


def plain_components(x):
    centred = x - x.mean(axis=0)
    _, s, axes = np.linalg.svd(centred, full_matrices=False)
    kept = s > 1e-6 * max(1.0, s.max())
    return axes[kept], s[kept] ** 2 / (len(x) - 1)


@pytest.mark.parametrize("widest", [2048, 40])
def test_principal_components_equal_a_plain_decomposition(spark, widest, monkeypatch):
    """Up to signs, in strips, with fewer rows than numbers as well (the subspace holds all rows)."""
    monkeypatch.setattr("cloakframe.operators.components.STRIP", 100)
    draw = np.random.default_rng(5)
    for x in (draw.normal(size=(200, 12)) @ np.diag(1.5 ** np.arange(12)) + 1000, draw.normal(size=(30, 50)), np.outer(np.arange(9.0), [1.0, 2, 3])):
        axes, variances = plain_components(x)
        got = PrincipalComponents.fit(pictures(spark, x), "pixels", widest=widest)
        assert np.allclose(got.variances, variances) and np.allclose(np.abs((got.axes * axes).sum(axis=1)), 1)
        inner = np.array([r["components"] for r in got.project(pictures(spark, x), "image_id", "pixels").orderBy("image_id").collect()])
        assert np.allclose(got.restore(inner), x)


def test_principal_components_of_wide_rows(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(120, 4)) * [40, 20, 10, 5] @ draw.normal(size=(4, 90)) + 0.01 * draw.normal(size=(120, 90))
    axes, variances = plain_components(x)
    got = PrincipalComponents.fit(pictures(spark, x), "pixels", n_components=3, widest=50)
    assert got.axes.shape == (3, 90) and np.allclose(got.variances, variances[:3])
    assert np.allclose(np.abs((got.axes * axes[:3]).sum(axis=1)), 1)
    with pytest.raises(ValueError, match="n_components"):
        PrincipalComponents.fit(pictures(spark, x), "pixels", widest=50)
    with pytest.raises(ValueError, match="most_numbers"):
        PrincipalComponents.fit(pictures(spark, x), "pixels", n_components=3, widest=50, most_numbers=1000)


@pytest.mark.parametrize("rows", [[[1.0], [1.0, 2.0]], [None, [1.0]], [[float("nan")]], [[float("-inf")]], [[None, 1.0]]])
def test_components_of_finite_arrays_of_one_length_only(spark, rows):
    with pytest.raises(ValueError, match="finite"):
        PrincipalComponents.fit(spark.createDataFrame([(r,) for r in rows], "v array<double>"), "v")


@pytest.mark.parametrize("algorithm", ["mdav", "random"])
@pytest.mark.parametrize("kept", [None, 2])
def test_k_same_equals_a_plain_version(spark, algorithm, kept):
    x = np.random.default_rng(7).normal(size=(90, 5)) @ np.random.default_rng(8).normal(size=(5, 5))
    axes, _ = plain_components(x)
    axes = axes[:kept]
    inner = (x - x.mean(axis=0)) @ axes.T
    points = Points(inner, np.empty((len(x), 0), int), algorithm == "mdav")
    want = mdav(points, 4) if algorithm == "mdav" else random_choice(points, 4, 0)
    for variant in ("pixel", "eigen"):
        got = KSame(4, variant, algorithm, kept).anonymise(pictures(spark, x)).orderBy("image_id").toPandas()
        assert got["cluster"].tolist() == [f"all:{c}" for c in want]
        means = np.array([(x if variant == "pixel" else inner @ axes + x.mean(axis=0))[want == c].mean(axis=0) for c in want])
        assert np.allclose(np.array(got["pixels"].tolist()), means)


def test_k_same_of_no_images_and_of_equal_ones(spark):
    form = "image_id bigint, pixels array<double>"
    for variant in ("pixel", "eigen"):
        assert KSame(3, variant, "mdav").anonymise(spark.createDataFrame([], form)).count() == 0
        same = KSame(3, variant, "mdav").anonymise(spark.createDataFrame([(i, [0.1, 0.7]) for i in range(10)], form), None).toPandas()
        assert sorted(same["cluster"].value_counts()) == [3, 3, 4] and all(np.allclose(p, [0.1, 0.7]) for p in same["pixels"])


def plain_buckets(counts, domain, m):
    """The same plan by trying every number of rows."""
    left, out = {v: n for v, n in counts.items() if n}, []
    eligible = lambda c: max(c, default=0) * m <= sum(c)
    while left:
        ordered = sorted(left, key=lambda v: (-left[v], v))
        if not eligible(left.values()) or len(left) < m:
            more = [v for v in sorted(domain, key=lambda v: (counts.get(v, 0), v)) if v not in left]
            values = (ordered + more)[: max(m, len(ordered))]
            return [*out, ([(v, left.get(v, 0)) for v in values], max(left.values()))]
        options = ((size, rows) for size in range(m, len(ordered) + 1) for rows in range(left[ordered[size - 1]], 0, -1) if (size < len(ordered) or rows == left[ordered[-1]]) and eligible([left[v] - rows * (v in ordered[:size]) for v in left]))
        size, rows = next(options, (len(ordered), max(left.values())))
        out.append(([(v, min(rows, left[v])) for v in ordered[:size]], rows))
        left = {v: n - min(rows, n) * (v in ordered[:size]) for v, n in left.items()}
        left = {v: n for v, n in left.items() if n}
    return out


def test_buckets_equal_a_plain_search():
    draw = np.random.default_rng(9)
    for _ in range(300):
        m, values = int(draw.integers(2, 5)), [f"v{i}" for i in range(draw.integers(5, 9))]
        counts = {v: int(n) for v, n in zip(values, draw.integers(0, 15, len(values)), strict=True)}
        assert buckets_for(counts, values, m) == plain_buckets(counts, values, m)


def test_buckets_of_many_rows_and_values():
    draw = np.random.default_rng(10)
    values = [f"v{i:04d}" for i in range(2_000)]
    counts = {v: int(n) for v, n in zip(values, draw.integers(1, 1_000_000, len(values)), strict=True)}
    plan = buckets_for(counts, values, 3)
    placed = dict.fromkeys(values, 0)
    for parts, _ in plan:
        for v, n in parts:
            placed[v] += n
    assert placed == counts and all(len(parts) >= 3 for parts, _ in plan)


def plain_releases(tables, m):
    """Classes {ID: (class, members' values)} and counterfeits of each release, row by row."""
    from collections import Counter, defaultdict

    before, out = {}, []
    for table in tables:
        rows = {r[0]: (r[1], (*r[2:], r[0])) for r in table}
        held, need, buckets = defaultdict(lambda: defaultdict(list)), {}, {}
        for i, (s, _) in rows.items():
            if i in before and before[i][0] == s:
                held[before[i][1]][s].append(i)
        new = defaultdict(list)
        for i in sorted((i for i in rows if not (i in before and before[i][0] == rows[i][0])), key=lambda i: rows[i][1]):
            new[rows[i][0]].append(i)
        for sig, by in held.items():
            need[sig] = max(map(len, by.values()))
        for s in {s for sig in held for s in sig}:
            for sig in sorted((sig for sig in held if s in sig), key=lambda sig: "[" + ",".join(f'"{v}"' for v in sig) + "]"):
                gap = need[sig] - len(held[sig][s])
                held[sig][s] += new[s][:gap]
                new[s] = new[s][gap:]
        domain = sorted({s for s, _ in rows.values()} | {s for s, _ in before.values()})
        for n, (parts, size) in enumerate(plain_buckets({s: len(x) for s, x in new.items()}, domain, m)):
            buckets[n] = ({s: new[s][:real] for s, real in parts}, size)
            for s, real in parts:
                new[s] = new[s][real:]
        members, fakes, signature = {}, Counter(), {}
        for by, size in [*(({s: held[sig][s] for s in sig}, need[sig]) for sig in held), *buckets.values()]:
            for j in range(size):
                real = {s: sorted(ids, key=lambda i: rows[i][1])[j] if j < len(ids) else None for s, ids in by.items()}
                ids = tuple(sorted(i for i in real.values() if i is not None))
                for s, i in real.items():
                    if i is None:
                        fakes[(ids, s)] += 1
                    else:
                        members[i], signature[i] = ids, tuple(sorted(by))
        before = {i: (rows[i][0], signature[i]) for i in rows}
        out.append((members, dict(fakes)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_m_invariance_equals_a_plain_version(spark, seed):
    """Every row's class and every counterfeit, over three releases."""
    draw = np.random.default_rng(seed)
    everyone = [(i, f"s{draw.choice(6, p=[0.3, 0.25, 0.2, 0.1, 0.1, 0.05])}", int(draw.integers(5)), int(draw.integers(3))) for i in range(120)]
    tables = [[r for r in everyone if low <= r[0] < high] for low, high in ((0, 80), (25, 110), (40, 120))]
    model, last = MInvariance(3, ("QI1", "QI2"), "S"), (None, None, None)
    for table, (members, fakes) in zip(tables, plain_releases(tables, 3), strict=True):
        df = spark.createDataFrame(table, "ID bigint, S string, QI1 int, QI2 int")
        partition, counterfeits = model.partition(df, *last)
        last = (df, partition, counterfeits)
        classes = {}
        for r in partition.collect():
            classes.setdefault(r[GROUP], []).append(r["ID"])
        ids = {g: tuple(sorted(x)) for g, x in classes.items()}
        assert {i: x for x in ids.values() for i in x} == members
        assert {(ids.get(r[GROUP], ()), r["S"]): r["n"] for r in counterfeits.collect()} == fakes


@pytest.mark.parametrize("models", [(KAnonymity(2), DistinctLDiversity(1, "s")), (KAnonymity(2), TCloseness(1.0, "s"))])
def test_estimated_sizes_do_not_grow_with_levels(spark, monkeypatch, models):
    seen = []
    split = Mondrian._split

    def watched(me, active, bounds, *rest):
        seen.append([int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in (active, bounds)])
        return split(me, active, bounds, *rest)

    monkeypatch.setattr(Mondrian, "_split", watched)
    df = spark.range(128).select(F.col("id").alias("_rid"), F.col("id").alias("x"), (F.col("id") % 3).cast("string").alias("s"))
    found = Mondrian(models, ("x",), local_rows=3).partition(df)
    assert found.count() == 128
    assert len(seen) >= 5 and max(max(x) for x in seen) < 1 << 40


@pytest.mark.parametrize("algorithm", ["random", "mdav"])
def test_blocks_leave_over_what_one_block_would(spark, algorithm):
    found = groups(Clustering(3, ("age", "w"), algorithm, block_rows=50).partition(people(spark, 400)))
    assert sorted(map(len, found)) == [3] * 132 + [4]
