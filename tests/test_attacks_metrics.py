import random

import pytest
from pyspark.sql import functions as F

from cloakframe.operators.attackers import IntersectionAttacker, split_columns
from cloakframe.operators.cover import SearchBudgetError, cover_rows, rows_in_solutions
from cloakframe.operators.metrics import CountingQueryGenerator, DrawnValues, PreparedRelease, ValueDomain, counting_query, counting_query_error, discernibility_penalty, normalise_prediction, percentage_of_vulnerable_population
from cloakframe.operators.overlap import overlap_join
from cloakframe.operators.recoding import GlobalRecoding, Taxonomy, TaxonomyTable
from cloakframe.operators.schemas import HumanReadable, MachineReadable, RawData
from cloakframe.operators.trajectories import TrajectoryAttacker
from cloakframe.plans.roles import of
from cloakframe.streaming.releases import observe_stream

MR = MachineReadable({"QI2": ("A", "B")}, ("QI1",), ("S",))
KNOWLEDGE = "ID bigint, QI1_min int, QI1_max int, QI2_A boolean, QI2_B boolean"
RELEASE = "QI1_min int, QI1_max int, QI2_A boolean, QI2_B boolean, S int, count bigint"


@pytest.mark.parametrize(
    ("target", "rows", "expected"),
    [
        ({0: 1, 1: 1}, {0: [0], 1: [1], 2: [0, 1]}, {0, 1, 2}),
        ({0: 2, 1: 1}, {0: [0], 1: [0, 1], 2: [1]}, {0, 1}),
        ({0: 2}, {0: [0]}, set()),
        ({0: 1, 1: 1, 2: 1}, {0: [0, 1], 1: [2], 2: [1, 2], 3: [0, 2]}, {0, 1}),
        ({0: 2, 1: 2}, {0: [0], 1: [0], 2: [1], 3: [1], 4: [0, 1]}, {0, 1, 2, 3, 4}),
    ],
)
def test_cover(spark, target, rows, expected):
    assert rows_in_solutions(target, rows) == expected
    r = spark.createDataFrame([(i, c) for i, cs in rows.items() for c in cs], "row_id bigint, col_id bigint")
    t = spark.createDataFrame(list(target.items()), "col_id bigint, mult bigint")
    assert {x["row_id"] for x in cover_rows(r, t).collect()} == expected


def test_cover_against_all_subsets():
    import itertools
    import random

    draw = random.Random(5)
    for _ in range(150):
        m, n = draw.randint(1, 4), draw.randint(1, 7)
        target = {c: draw.randint(1, 2) for c in range(m)}
        rows = {r: sorted(draw.sample(range(m), draw.randint(1, m))) for r in range(n)}
        expected = set()
        for size in range(n + 1):
            for chosen in itertools.combinations(range(n), size):
                if all(sum(c in rows[r] for r in chosen) == k for c, k in target.items()):
                    expected |= set(chosen)
        assert rows_in_solutions(target, rows) == expected


def test_cover_limits():
    with pytest.raises(ValueError, match="positive"):
        rows_in_solutions({0: 0}, {0: [0]})
    two = {r: [r % 12, (r * 5 + 1) % 12] if r % 12 != (r * 5 + 1) % 12 else [r % 12] for r in range(80)}
    three = {r: [*c, 12 + r % 5] for r, c in two.items()}
    with pytest.raises(SearchBudgetError, match="steps"):
        rows_in_solutions({c: 3 if c < 12 else 4 for c in range(17)}, three, budget=20)
    # rows of two kinds of columns are a matching and need no search
    assert rows_in_solutions({c: 3 for c in range(12)}, two, budget=20) == rows_in_solutions({c: 3 for c in range(12)}, two)


def test_component_without_solution_empties_all(spark):
    rows = spark.createDataFrame([(0, 0), (1, 1)], "row_id bigint, col_id bigint")
    target = spark.createDataFrame([(0, 1), (1, 2)], "col_id bigint, mult bigint")
    assert cover_rows(rows, target).isEmpty()


def targets(spark):
    return spark.createDataFrame([(0, 1, 1, True, False), (1, 4, 4, False, True)], KNOWLEDGE)


def first(spark):
    return spark.createDataFrame([(1, 2, True, False, 1, 1), (1, 2, True, False, 2, 1), (3, 5, True, True, 3, 1), (3, 5, True, True, 4, 1)], RELEASE)


def second(spark):
    return spark.createDataFrame([(1, 3, True, False, 1, 1), (4, 6, True, True, 3, 1), (4, 6, True, True, 4, 1)], RELEASE)


@pytest.mark.parametrize("kind", ["intersection", "trajectory"])
def test_attack(spark, kind):
    attacker = IntersectionAttacker(targets(spark), ["QI1", "QI2"], "S", MR) if kind == "intersection" else TrajectoryAttacker(targets(spark), ["QI1", "QI2"], MR)
    attacker.observe(first(spark), ["QI1", "QI2", "S"], [0, 1])
    assert attacker.predict(0, "S") == {1: 1.0, 2: 1.0}
    assert attacker.predict(1, "S") == {3: 1.0, 4: 1.0}
    attacker.observe(second(spark), ["QI1", "QI2", "S"], [0, 1])
    assert attacker.predict(0, "S") == {1: 1.0}
    assert attacker.predict(1, "S") == {3: 1.0, 4: 1.0}


def test_absent_targets(spark):
    attacker = IntersectionAttacker(targets(spark), ["QI1", "QI2"], "S", MR)
    attacker.observe(first(spark), ["QI1", "QI2", "S"], [1])
    assert attacker.predict(0, "S") is None
    attacker.observe(second(spark), ["QI1", "QI2", "S"], [0, 1])
    assert attacker.predict(0, "S") == {1: 1.0}
    path = TrajectoryAttacker(targets(spark), ["QI1", "QI2"], MR)
    path.observe(first(spark), ["QI1", "QI2", "S"], [1])
    assert path.predict(0, "S") is None
    assert path.predict(0, "QI1") == {1: 1.0}


def test_intersection_against_plain(spark):
    """Shared and alternative knowledge, nulls, repeated rows, absent targets, releases that lack a column."""
    draw = random.Random(3)
    shapes = [(lo, lo + draw.randint(0, 2), draw.random() < 0.6, draw.random() < 0.6) for lo in range(6)] + [(None, 3, True, True)]
    know = [(i, *draw.choice(shapes)) for i in range(24) for _ in range(draw.choice((1, 1, 2)))] + [(0, *shapes[0])] * 2
    releases = []
    for _ in range(3):
        rows = []
        for _ in range(10):
            lo = draw.randint(0, 7)
            rows.append((lo, lo + draw.randint(0, 2), draw.random() < 0.7, draw.random() < 0.7, draw.randint(1, 6), 1))
        releases.append((rows + rows[:2], draw.choice((["QI1", "QI2", "S"], ["QI1", "S"])), {i for i in range(24) if draw.random() < 0.7}))
    releases.append(([(0, 9, True, True, 1, 1)], ["QI1", "QI2", "S"], {2, 3, 99}))
    attacker, expected = IntersectionAttacker(spark.createDataFrame(know, KNOWLEDGE), ["QI1", "QI2"], "S", MR), {}
    for rows, columns, present in releases:
        attacker.observe(spark.createDataFrame(rows, RELEASE), columns, sorted(present))
        for i in present:
            met = {
                r[4]
                for r in rows
                for k in know
                if k[0] == i and None not in k and k[1] <= r[1] and r[0] <= k[2] and ("QI2" not in columns or (k[3] and r[2]) or (k[4] and r[3]))
            }
            expected[i] = expected[i] & met if i in expected else met
    found = [(r["ID"], r["value"]) for r in attacker.predict_all("S").collect()]
    assert sorted(found) == sorted((i, v) for i, values in expected.items() for v in values)


def test_finalise_uses_counts(spark):
    who = spark.createDataFrame([(0, 1, 1, True, False), (1, 1, 2, True, False)], KNOWLEDGE)
    seen = spark.createDataFrame([(1, 1, True, False, 7, 1), (2, 2, True, False, 8, 1)], RELEASE)
    attacker = TrajectoryAttacker(who, ["QI1", "QI2"], MR)
    attacker.observe(seen, ["QI1", "QI2", "S"], [0, 1])
    assert attacker.predict(1, "S") == {7: 1.0, 8: 1.0}
    attacker.finalise()
    assert attacker.predict(0, "S") == {7: 1.0}
    assert attacker.predict(1, "S") == {8: 1.0}


def plainly(know, rel, schema, on):
    meets = schema.overlaps(of("a"), of("b"), on)
    return sorted(((r["i"], r["j"]) for r in know.alias("a").join(rel.alias("b"), meets).select("a.ID", "b.S").toDF("i", "j").collect()), key=str)


def paired(know, rel, schema, on):
    return sorted(((r["k"]["ID"], r["r"]["S"]) for r in overlap_join(know, rel, schema, on).collect()), key=str)


def test_overlap_join_equals_plain(spark):
    know = spark.createDataFrame([(i, i * 3 % 50 - 9, i * 3 % 50 - 9 + i % 4, i % 2 == 0, True) for i in range(40)] + [(90, -1000, 10**9, True, True), (91, 5, 4, True, True)], KNOWLEDGE)
    rel = spark.createDataFrame([(i * 7 % 60, i * 7 % 60 + (i % 9 if i % 20 else 40), True, i % 3 == 0, i, 1) for i in range(60)], RELEASE)
    for on in (["QI1", "QI2"], ["QI1"], ["QI2"]):
        assert paired(know, rel, MR, on) == plainly(know, rel, MR, on)
    assert paired(know, rel.limit(0), MR, ["QI1"]) == [] == paired(know.limit(0), rel, MR, ["QI1"])
    real = spark.createDataFrame([(i, i * 0.37, i * 0.37 + 0.2 * (i % 3), True, True) for i in range(30)], KNOWLEDGE.replace("QI1_min int, QI1_max int", "QI1_min double, QI1_max double"))
    seen = spark.createDataFrame([(i * 0.21, i * 0.21 + 0.15 * (i % 4), True, True, i, 1) for i in range(50)], RELEASE.replace("QI1_min int, QI1_max int", "QI1_min double, QI1_max double"))
    assert paired(real, seen, MR, ["QI1"]) == plainly(real, seen, MR, ["QI1"])


def test_overlap_join_of_other_schemas(spark):
    text = HumanReadable(("QI2",), ("QI1",), ("S",))
    know = spark.createDataFrame([(0, "-3--1", "a"), (1, "2", "a,b"), (2, "1-40", "c"), (3, "7-9", "")], "ID bigint, QI1 string, QI2 string")
    rel = spark.createDataFrame([("-2-2", "a", 0, 1), ("3-8", "b,c", 1, 1), ("40", "a,b,c", 2, 1)], "QI1 string, QI2 string, S int, count bigint")
    for on in (["QI1", "QI2"], ["QI2"], ["QI1"]):
        assert paired(know, rel, text, on) == plainly(know, rel, text, on)
    raw = RawData(("QI2",), ("QI1",), ("QI1", "QI2"))
    assert paired(know.withColumn("QI1", F.col("ID")), rel.withColumn("QI1", F.col("S")), raw, ["QI1"]) == [(0, 0), (1, 1), (2, 2)]
    tree = Taxonomy("any").add_generalised(Taxonomy("low").add_raw_values([1, 2])).add_generalised(Taxonomy("high").add_raw_values([3]))
    coded = GlobalRecoding({"QI1": tree}, ("S",))
    know = spark.createDataFrame([(0, "1"), (1, "low"), (2, "3"), (3, "any")], "ID bigint, QI1 string")
    rel = spark.createDataFrame([("low", 0, 1), ("2", 1, 1), ("any", 2, 1), ("3", 3, 1)], "QI1 string, S int, count bigint")
    assert paired(know, rel, coded, ["QI1"]) == plainly(know, rel, coded, ["QI1"])


def test_split_columns():
    assert split_columns(["a", "b"], ["b", "c"]) == (["a"], ["b"], ["c"])


def test_releases_from_a_stream(spark, tmp_path):
    first(spark).write.parquet(str(tmp_path / "in"))
    attacker = IntersectionAttacker(targets(spark), ["QI1", "QI2"], "S", MR)
    stream = spark.readStream.schema(RELEASE).parquet(str(tmp_path / "in"))
    observe_stream(stream, attacker, ["QI1", "QI2", "S"], lambda n: [0, 1], str(tmp_path / "state")).awaitTermination()
    assert attacker.predict(0, "S") == {1: 1.0, 2: 1.0}
    with pytest.raises(ValueError, match="has not seen"):
        observe_stream(stream, IntersectionAttacker(targets(spark), ["QI1", "QI2"], "S", MR), ["QI1"], lambda n: [0], str(tmp_path / "state"))


def test_counting_queries(spark):
    raw = spark.createDataFrame([(0, "A", 1, 5), (1, "A", 1, 5), (2, "B", 3, 6), (3, "B", 4, 6)], "ID bigint, QI2 string, QI1 int, S int")
    original = PreparedRelease.from_raw_data(raw, ("QI1", "QI2"))
    assert counting_query({"QI1": (1, 3)}, original).first()[0] == 3.0
    release = spark.createDataFrame([(1, 1, True, False, 5, 2), (3, 4, False, True, 6, 2)], RELEASE)
    prepared = PreparedRelease(release, MR, ("QI1", "QI2"))
    assert counting_query({"QI1": (1, 3)}, prepared).first()[0] == 3.0
    assert counting_query({"QI1": (3, 3), "S": {5}}, prepared).first()[0] == 0.0
    assert counting_query_error({"QI1": (3, 3)}, original, prepared).first()["error"] == 0.0
    with pytest.raises(Exception, match="no record"):
        counting_query_error({"QI1": (9, 9)}, original, prepared).collect()
    assert discernibility_penalty(prepared).first()[0] == 8
    assert prepared.num_groups() == 2
    assert sorted(r["group_size"] for r in prepared.df().collect()) == [2, 2]
    gid = prepared.classes.first()
    assert prepared.group_size(gid["group_id"]) == gid["group_size"]


def test_query_generator(spark):
    raw = spark.createDataFrame([(i, "ABCD"[i % 4], i, i % 3) for i in range(40)], "ID bigint, QI2 string, QI1 int, S int")
    generator = CountingQueryGenerator(PreparedRelease.from_raw_data(raw, ("QI1", "QI2")), seed=4)
    whole = generator.generate(3, 1.0)
    assert whole["QI1"] == (0, 39) and whole["QI2"] == set("ABCD") and whole["S"] == (0, 2)
    assert generator.generate(0, 0.5) == {}
    assert "S" not in generator.generate(2, 0.5, use_sensitive=False)
    with pytest.raises(ValueError):
        generator.generate(9, 0.5)


def test_vulnerable_population(spark):
    truth = spark.createDataFrame([(i, i + 1) for i in range(4)], "ID bigint, S int")
    wide = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0), (1, 1.0, 1.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0, 0.0), (3, 1.0, 1.0, 1.0, 1.0)], "ID bigint, `1` double, `2` double, `3` double, `4` double")
    scores = [percentage_of_vulnerable_population(truth, normalise_prediction(wide), 1 / c, "S").first()["pvp"] for c in (1, 2, 3, 4)]
    assert scores == [0.25, 0.5, 0.75, 1.0]


def test_all_zero_prediction_is_null(spark):
    wide = spark.createDataFrame([(0, 0.0, 0.0)], "ID bigint, a double, b double")
    assert [r["confidence"] for r in normalise_prediction(wide).collect()] == [None, None]


@pytest.mark.parametrize("wide", [0, 1, 10, 200])
@pytest.mark.parametrize("kind", ["int", "double"])
def test_overlap_candidates_are_few(spark, wide, kind):
    """n targets and n regions, some as wide as all: what is compared stays near the results."""
    import math

    from cloakframe.operators import overlap

    n = 2000
    spread = 7 if kind == "int" else 1e9  # far outliers make no difference
    know = spark.range(n).select(F.struct((F.col("id") * 3 + F.when(F.col("id") == 5, spread).otherwise(0)).cast(kind).alias("QI1_min"), (F.col("id") * 3 + 1 + F.when(F.col("id") == 5, spread).otherwise(0)).cast(kind).alias("QI1_max")).alias("k"), F.col("id").alias("k_id"))
    last = F.when(F.col("id") < wide, 3 * n).otherwise(F.col("id") * 3 + 2)
    seen = spark.range(n).select(F.struct(F.when(F.col("id") < wide, 0).otherwise(F.col("id") * 3).cast(kind).alias("QI1_min"), (last + F.col("id") % 2).cast(kind).alias("QI1_max")).alias("g"), F.col("id").alias("g_id"))
    candidates = overlap.candidate_regions(know, seen, MR, ["QI1"])
    results = overlap.region_pairs(know, seen, MR, ["QI1"]).count()
    assert candidates.count() <= 4 * results + n * math.log2(n)
    pairs = {(r["k_id"], r["g_id"]) for r in overlap.region_pairs(know, seen, MR, ["QI1"]).collect()}
    assert len(pairs) == results
    plain = know.join(seen, (F.col("k.QI1_min") <= F.col("g.QI1_max")) & (F.col("g.QI1_min") <= F.col("k.QI1_max"))).select("k_id", "g_id").collect()
    assert pairs == {tuple(r) for r in plain}


def test_overlap_join_in_tiles(spark, monkeypatch):
    from cloakframe.operators import overlap

    know = spark.createDataFrame([(i, i % 60 - 1, i % 60 + 1, i % 2 == 0, i % 3 == 0) for i in range(200)], KNOWLEDGE)
    rel = spark.createDataFrame([(0 if i % 3 else i % 50, 60 if i % 3 else i % 50 + 3, i % 2 == 0, i % 5 == 0, i, 1) for i in range(150)], RELEASE)
    whole = {tuple(on): plainly(know, rel, MR, on) for on in (["QI1"], ["QI2"], ["QI1", "QI2"])}
    monkeypatch.setattr(overlap, "MOST_PAIRS", 40)
    for most in (100_000, 0):
        monkeypatch.setattr(overlap, "MOST_TILED", most)
        for on, expected in whole.items():
            assert paired(know, rel, MR, list(on)) == expected


def test_overlap_join_with_odd_ends(spark):
    """Infinity, NaN and nulls as ends: as a comparison of all pairs has it."""
    inf, nan = float("inf"), float("nan")
    ends = [(-inf, 0.5), (0.5, inf), (nan, nan), (None, 3.0), (1e300, 1e308), (-0.0, 0.0), (2.0, 2.0), (-inf, inf)]
    real = KNOWLEDGE.replace("QI1_min int, QI1_max int", "QI1_min double, QI1_max double")
    know = spark.createDataFrame([(i, a, b, True, True) for i, (a, b) in enumerate(ends)], real)
    rel = spark.createDataFrame([(a, b, True, True, i, 1) for i, (a, b) in enumerate(ends)], RELEASE.replace("QI1_min int, QI1_max int", "QI1_min double, QI1_max double"))
    assert paired(know, rel, MR, ["QI1"]) == plainly(know, rel, MR, ["QI1"])


def test_equal_columns_are_part_of_the_key(spark):
    know = spark.createDataFrame([(i, i, i + 2, True, False, i % 4 if i % 5 else None) for i in range(40)], KNOWLEDGE + ", S bigint")
    rel = spark.createDataFrame([(i, i + 1, True, False, i % 4 if i % 7 else None, 1) for i in range(40)], RELEASE)
    assert paired(know, rel, MR, ["QI1", "S"]) == plainly(know, rel, MR, ["QI1", "S"])
    assert paired(know, rel, MR, ["S"]) == plainly(know, rel, MR, ["S"])


def plain_trajectories(know, releases, known, schema_columns):
    """Every path of every target: (records, one per release or None where absent), interval and value learnt."""
    out = []
    for i, lo, hi in know:
        paths = [((), lo, hi, None, 1)]
        for rows, present in releases:
            if i not in present:
                paths = [(p + (None,), a, b, s, w) for p, a, b, s, w in paths]
                continue
            paths = [(p + (j,), max(a, c), min(b, d), v, w * n) for p, a, b, s, w in paths for j, (c, d, v, n) in enumerate(rows) if a <= d and c <= b and s in (None, v)]
        out += [(i, *p) for p in paths]
    return out


def plain_finalised(paths, releases, ids):
    """Paths in some choice of one path a target that uses every record as often as its count says."""
    import itertools

    by = [[p for p in paths if p[0] == i] for i in ids]
    live = set()
    for chosen in itertools.product(*by):
        used = [[p[1][t] for p in chosen] for t in range(len(releases))]
        if all(used[t].count(j) == n for t, (rows, _) in enumerate(releases) for j, (_, _, _, n) in enumerate(rows)):
            live |= set(chosen)
    return live


def attacked(spark, know, releases):
    schema = MachineReadable({}, ("QI1",), ("S",))
    attacker = TrajectoryAttacker(spark.createDataFrame(know, "ID bigint, QI1_min int, QI1_max int"), ["QI1"], schema)
    for rows, present in releases:
        attacker.observe(spark.createDataFrame(rows, "QI1_min int, QI1_max int, S int, count bigint"), ["QI1", "S"], sorted(present))
    return attacker


def compared(attacker, paths, ids):
    import collections

    ways, numbers, values = collections.Counter(), collections.Counter(), set()
    for i, _, _, _, s, w in paths:
        ways[i] += w
        numbers[i] += 1
        if s is not None:
            values.add((i, s))
    assert {r["ID"]: (int(r["paths"]), int(r["ways"])) for r in attacker.trajectories().collect()} == {i: (numbers[i], ways[i]) for i in ids if numbers[i]}
    assert {(r["ID"], r["value"]) for r in attacker.predict_all("S").collect()} == values


@pytest.mark.parametrize("seed", range(4))
def test_trajectories_against_all_paths(spark, seed):
    """Several releases, targets that are away from some, alternatives: numbers of paths, values, and what finalise leaves."""
    import random

    draw = random.Random(seed)
    n = 5
    own = [(draw.randint(0, 6), draw.randint(1, 3)) for _ in range(n)]
    know = [(i, max(0, q - draw.randint(0, 1)), q + draw.randint(0, 2)) for i, (q, _) in enumerate(own)] + [(0, 20, 21)] * (seed % 2)
    releases = []
    for t in range(1 + seed % 3):
        present = set(range(n)) if t == 0 and seed < 3 else set(draw.sample(range(n), n - 1))
        rows = {}
        for i in present:
            q, s = own[i]
            key = (q // 2 * 2, q // 2 * 2 + 1, s)
            rows[key] = rows.get(key, 0) + 1
        releases.append(([(*k, c) for k, c in sorted(rows.items())], present))
    paths = plain_trajectories(know, releases, ["QI1"], None)
    attacker = attacked(spark, know, releases)
    compared(attacker, paths, range(n))
    attacker.finalise()
    left = plain_finalised(paths, releases, range(n))
    assert left
    compared(attacker, [p for p in paths if p in left], range(n))


def test_observing_after_finalise(spark):
    know = [(0, 1, 1), (1, 1, 2)]
    releases = [([(1, 1, 7, 1), (2, 2, 8, 1)], {0, 1})]
    attacker = attacked(spark, know, releases)
    attacker.finalise()
    assert attacker.predict(1, "S") == {8: 1.0}
    attacker.observe(spark.createDataFrame([(1, 1, 7, 1), (1, 3, 8, 1)], "QI1_min int, QI1_max int, S int, count bigint"), ["QI1", "S"], [0, 1])
    assert attacker.predict(0, "S") == {7: 1.0} and attacker.predict(1, "S") == {8: 1.0}
    attacker.finalise()
    assert attacker.predict(0, "S") == {7: 1.0} and attacker.predict(1, "S") == {8: 1.0}
    attacker.observe(spark.createDataFrame([], "QI1_min int, QI1_max int, S int, count bigint"), ["QI1", "S"], [0, 1])
    assert attacker.predict(0, "S") is None


def test_target_learns_only_where_it_was(spark):
    """Who is away from the first release knows no value of it and may meet any in the second."""
    releases = [([(1, 1, 7, 1)], {0}), ([(1, 1, 7, 1), (2, 2, 9, 1)], {0, 1})]
    attacker = attacked(spark, [(0, 1, 1), (1, 2, 2)], releases)
    assert attacker.predict(1, "S") == {9: 1.0} and attacker.predict(0, "S") == {7: 1.0}


def test_matchings_against_all_choices():
    import itertools
    import random

    from cloakframe.operators.cover import edges_in_matchings

    draw = random.Random(8)
    solved = 0
    for _ in range(900):
        a, b = draw.randint(1, 3), draw.randint(1, 3)
        left, right = list(range(a)), list(range(10, 10 + b))
        edges = [(x, y) for x in left for y in right if draw.random() < 0.7]
        most = [draw.randint(1, 3) for _ in edges]
        target = {c: draw.randint(1, 3) for c in left + right}
        expected = set()
        for used in itertools.product(*(range(m + 1) for m in most)):
            if all(sum(n for n, e in zip(used, edges, strict=True) if c in e) == k for c, k in target.items()):
                expected |= {e for n, e in zip(used, edges, strict=True) if n}
        assert edges_in_matchings(target, set(left), edges, most) == expected
        solved += bool(expected)
    assert solved > 30


def test_long_chain_needs_no_budget():
    n = 20_000
    rows = {2 * i: [i, n + i] for i in range(n)} | {2 * i + 1: [i, n + i + 1] for i in range(n - 1)}
    target = dict.fromkeys(range(2 * n), 3)
    assert rows_in_solutions(target, rows, budget=1, times=dict.fromkeys(rows, 3)) == {2 * i for i in range(n)}


def test_components_of_chains_and_stars(spark):
    import random

    from cloakframe.operators.cover import components

    draw = random.Random(2)
    names = draw.sample(range(10_000), 600)
    edges = [(names[i], names[i + 1]) for i in range(299)] + [(names[300], names[i]) for i in range(301, 500)]
    rows = spark.createDataFrame([(n, c) for n, e in enumerate(edges) for c in e], "row_id bigint, col_id bigint")
    target = spark.createDataFrame([(c,) for c in names], "col_id bigint")
    got = {r["col_id"]: r["part"] for r in components(rows, target).collect()}
    assert got == {**dict.fromkeys(names[:300], min(names[:300])), **dict.fromkeys(names[300:500], min(names[300:500])), **{c: c for c in names[500:]}}


def test_drawn_values_are_those_of_a_plain_draw(spark):
    """By rank in the order of values; nulls are no values."""
    import random

    values = [None, *(f"v{(i * 7919) % 5000}" for i in range(9000))]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    domain = ValueDomain.of(df, "v")
    plain = sorted({v for v in values if v is not None})
    assert domain.size == len(plain)
    assert [r["value"] for r in domain.table.orderBy("rank").collect()] == plain
    assert domain.draw(1200, random.Random(4)) == set(random.Random(4).sample(plain, 1200))
    assert domain.draw(0, random.Random(4)) == set()
    assert domain.draw(len(plain), random.Random(4)) == set(plain)
    assert ValueDomain.of(df.limit(0), "v").size == 0


def test_many_drawn_values_are_a_table(spark):
    raw = RawData(("v",), (), ("v",))
    df = spark.range(6000).select(F.concat(F.lit("v"), "id").alias("v"))
    prepared = PreparedRelease(raw.generalise(df.union(df.limit(0))), raw, ("v",))
    wanted = CountingQueryGenerator(prepared, seed=5).generate(1, 0.25)["v"]
    assert isinstance(wanted, DrawnValues) and len(wanted) == 1500
    values = {r["value"] for r in wanted.table.collect()}
    assert len(values) == 1500 and values != {r["value"] for r in CountingQueryGenerator(prepared, seed=6).generate(1, 0.25)["v"].table.collect()}
    found = counting_query({"v": wanted}, prepared)
    assert found.first()["estimate"] == 1500 and "v123" not in found._jdf.queryExecution().logical().toString()


def test_intervals_are_held_against_no_level_above_the_widest(spark):
    from cloakframe.operators import overlap

    a = spark.range(500).select(F.col("id").alias("ID"), (F.col("id") * 10**7).alias("x_min"), (F.col("id") * 10**7 + 1).alias("x_max"))
    b = spark.range(500).select((F.col("id") * 10**7 + F.col("id") % 3).alias("x_min"), (F.col("id") * 10**7 + F.col("id") % 3).alias("x_max"))
    schema = MachineReadable({}, ("x",))
    tops = []
    points = overlap._points
    overlap._points = lambda df, at, top: tops.append(top) or points(df, at, top)
    try:
        pairs = overlap_join(a, b, schema, ["x"]).select("k.ID").collect()
    finally:
        overlap._points = points
    assert sorted(r["ID"] for r in pairs) == [i for i in range(500) if i % 3 < 2]
    assert tops and max(tops) <= 1


def test_recoding_by_a_table_of_the_taxonomy(spark):
    tree = Taxonomy("any").add_generalised(Taxonomy("low").add_raw_values([1, 2])).add_generalised(Taxonomy("high").add_raw_values([3, 4]))
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 1), (4, 2)], "v int, group_id int")
    want, got = (GlobalRecoding({"v": t}).generalise(df) for t in (tree, TaxonomyTable(tree.table(spark))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_what_is_shared_is_found_by_region(spark):
    from cloakframe.operators.overlap import overlap_shared

    k = spark.createDataFrame([(1, 0, 5), (2, 0, 5), (3, 9, 9)], "ID int, x_min int, x_max int")
    r = spark.createDataFrame([(4, 7, "a"), (5, 5, "b"), (8, 8, "c")], "x_min int, x_max int, s string")
    found = overlap_shared(k, r, MachineReadable({}, ("x",), ("s",)), ["x"], ["ID"], ["s"])
    assert found.columns == ["ID", "x_min", "x_max", "s"]
    assert sorted(map(tuple, found.collect())) == [(1, 4, 5, "a"), (1, 5, 5, "b"), (2, 4, 5, "a"), (2, 5, 5, "b")]
