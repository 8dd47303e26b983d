import pytest
from pyspark.sql import functions as F

from cloakframe.functions.sets import parse_interval, parse_set
from cloakframe.operators.recoding import GlobalRecoding, Taxonomy
from cloakframe.operators.schemas import HumanReadable, MachineReadable, Microaggregation, RawData
from cloakframe.plans.roles import column_roles, literal
from cloakframe.sources.schema_files import load_schema, save_schema

MR = MachineReadable({"QI2": ("A", "B", "C")}, ("QI1",), ("S",))
HR = HumanReadable(("QI2",), ("QI1",), ("S",))
RAW = RawData(("QI2",), ("QI1", "S"), ("QI1", "QI2"))


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(101, "A", 10, 0), (102, "B", 10, 0), (103, "A", 20, 0), (7, "C", 30, 1)], "QI1 int, QI2 string, S int, group_id int")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_roles(rows):
    roles = column_roles(rows, ["QI1", "QI2"])
    assert (roles.categorical, roles.numeric, roles.unaltered) == (("QI2",), ("QI1",), ("S",))
    with pytest.raises(ValueError):
        column_roles(rows, ["nothing"])


def test_machine_readable_release(rows):
    schema = MachineReadable.create_for_data(rows, ["QI1", "QI2"])
    out = schema.generalise(rows)
    assert out.columns == ["QI1_min", "QI1_max", "QI2_A", "QI2_B", "QI2_C", "S", "count"]
    assert found(out, *out.columns) == [(7, 7, False, False, True, 30, 1), (101, 103, True, True, False, 10, 2), (101, 103, True, True, False, 20, 1)]


def test_human_readable_release(rows):
    assert found(HR.generalise(rows), "QI1", "QI2", "S", "count") == [("101-103", "A,B", 10, 2), ("101-103", "A,B", 20, 1), ("7", "C", 30, 1)]


def test_means(rows):
    out = Microaggregation(("QI1",), ("S",)).generalise(rows)
    assert found(out, "QI1", "S", "count") == [(7.0, 30, 1), (102.0, 10, 2), (102.0, 20, 1)]
    with pytest.raises(NotImplementedError):
        Microaggregation(("QI1",), ()).select(out, {})
    with pytest.raises(ValueError):
        Microaggregation.create_for_data(rows, ["QI2"])


def test_raw_release_counts_equal_rows(spark):
    df = spark.createDataFrame([(1, "A", 5), (1, "A", 5), (2, "B", 5)], "QI1 int, QI2 string, S int")
    assert found(RAW.generalise(df), "QI1", "QI2", "S", "count") == [(1, "A", 5, 2), (2, "B", 5, 1)]


def test_release_keeps_null_unaltered_values(spark):
    df = spark.createDataFrame([(1, "A", None, 0), (2, "A", 4, 0)], "QI1 int, QI2 string, S int, group_id int")
    assert HR.generalise(df).agg(F.sum("count")).first()[0] == 2


def test_select(rows):
    out = MR.generalise(rows)
    assert MR.select(out, {"QI1": (100, 101)}).count() == 2
    assert MR.select(out, {"QI2": {"C"}}).count() == 1
    assert MR.select(out, {"QI2": {"D"}}).count() == 0
    assert MR.select(out, {"S": (20, 22)}).count() == 1
    assert MR.select(out, {}).count() == 3
    assert HR.select(HR.generalise(rows), {"QI1": (7, 8), "QI2": {"C", "x"}}).count() == 1
    assert RAW.select(RAW.generalise(rows.drop("group_id")), {"QI1": (102, 103), "S": {10}}).count() == 1


def test_match_returns_rows(rows):
    out = MR.match(MR.generalise(rows), {"QI1_min": 103, "QI1_max": 120, "QI2_A": True, "QI2_B": False, "QI2_C": False}, ["QI1", "QI2"])
    assert found(out, "S") == [(10,), (20,)]
    human = HR.generalise(rows)
    assert HR.match(human, {"QI1": "0-50", "QI2": "C,D"}, ["QI1", "QI2"]).count() == 1
    assert HR.match(human, {}, []).count() == 3
    assert HR.match(human, {"QI1": "-5--3"}, ["QI1"]).count() == 0


def test_intersection_cardinality_overlap(spark):
    a = literal({"QI1_min": 101, "QI1_max": 103, "QI2_A": True, "QI2_B": True, "QI2_C": False, "S": 5})
    b = literal({"QI1_min": 102, "QI1_max": 110, "QI2_A": False, "QI2_B": True, "QI2_C": True, "S": 5})
    ok, columns = MR.intersect(a, b, ["QI1", "QI2", "S"])
    got = spark.range(1).select(ok.alias("ok"), *columns).first().asDict()
    assert got == {"ok": True, "QI1_min": 102, "QI1_max": 103, "QI2_A": False, "QI2_B": True, "QI2_C": False, "S": 5}
    assert value(spark, MR.set_cardinality(a, ["QI1", "QI2", "S"])) == 6
    assert value(spark, MR.query_overlap(a, {"QI1": (103, 200), "QI2": {"A", "C"}})) == 1
    assert value(spark, MR.query_overlap(a, {"S": {6}})) == 0
    assert value(spark, MR.values_for(a, "QI2")) == ["A", "B"]
    assert value(spark, MR.values_for(a, "QI1")) == [101, 102, 103]
    x, y = literal({"QI1": "101-103", "QI2": "A,B", "S": 1}), literal({"QI1": "102-110", "QI2": "B,C", "S": 1})
    _, columns = HR.intersect(x, y, ["QI1", "QI2"], take_left=["S"])
    assert spark.range(1).select(*columns).first().asDict() == {"QI1": "102-103", "QI2": "B", "S": 1}
    assert value(spark, HR.set_cardinality(x, ["QI1", "QI2"])) == 6
    assert value(spark, HR.query_overlap(literal({"QI1": "-5--3", "QI2": "A", "S": 1}), {"QI1": (-6, -4)})) == 2
    assert value(spark, RAW.set_cardinality(x, ["QI1"])) == 1


def test_text_forms(spark):
    low, high = parse_interval(F.lit("-5--3"))
    assert (value(spark, low), value(spark, high)) == (-5, -3)
    assert value(spark, parse_set(F.lit(""))) == []
    with pytest.raises(Exception, match="not an interval"):
        value(spark, parse_interval(F.lit("abc"))[0])


def taxonomies():
    age = Taxonomy("any age").add_generalised(Taxonomy("child").add_raw_values(range(13))).add_generalised(Taxonomy("teenager").add_raw_values(range(13, 20)))
    adult = Taxonomy("adult").add_generalised(Taxonomy("young").add_raw_values(range(20, 40))).add_generalised(Taxonomy("older").add_raw_values(range(40, 150)))
    sex = Taxonomy("any sex").add_generalised(Taxonomy("binary").add_raw_values(["female", "male"])).add_generalised(Taxonomy("other").add_raw_values(["nonbinary"]))
    return {"age": age.add_generalised(adult), "sex": sex}


def test_global_recoding(spark):
    df = spark.createDataFrame([(13, "female", 1, 0), (19, "male", 2, 0), (20, "male", 3, 1), (69, "female", 3, 1)], "age int, sex string, S int, group_id int")
    schema = GlobalRecoding(taxonomies(), ("S",))
    out = schema.generalise(df)
    assert found(out, "age", "sex", "S", "count") == [("adult", "binary", 3, 2), ("teenager", "binary", 1, 1), ("teenager", "binary", 2, 1)]
    assert schema.select(out, {"age": (15, 25)}).count() == 3
    assert schema.select(out, {"sex": {"nonbinary"}}).count() == 0
    assert schema.match(out, {"age": "14", "sex": "male"}, ["age", "sex"]).count() == 2
    record = literal({"age": "teenager", "sex": "binary", "S": 1})
    assert value(spark, schema.set_cardinality(record, ["age", "sex", "S"])) == 14
    assert value(spark, schema.query_overlap(record, {"age": (12, 15), "sex": {"male"}})) == 3
    # raw values are nodes of their own: siblings do not meet
    assert not value(spark, schema.overlaps(literal({"sex": "female"}), literal({"sex": "male"}), ["sex"]))


def test_recoding_lifts_to_what_is_present(spark):
    df = spark.createDataFrame([(25, "x", 0), (26, "x", 0), (30, "x", 1), (50, "x", 1)], "age int, S string, group_id int")
    schema = GlobalRecoding({"age": taxonomies()["age"]}, ("S",))
    assert {r["age"] for r in schema.generalise(df).collect()} == {"adult"}


@pytest.mark.parametrize("schema", [MR, HR, RAW, Microaggregation(("a",), ("b",)), GlobalRecoding(taxonomies(), ("S",))])
def test_schema_files(spark, schema, tmp_path):
    for through in (None, spark):
        save_schema(schema, str(tmp_path / "s.json"), through)
        again = load_schema(str(tmp_path / "s.json"), through)
        assert type(again) is type(schema)
        assert again.to_json_dict() == schema.to_json_dict()
