import pytest
from pyspark.sql import functions as F

from fleetlens.functions import predicates as P
from fleetlens.functions import text as X


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_zone_limits(spark):
    texts = [None, "", "   ", "DAL/1,DID/1", "DAL/1, DID/1", "DAL/1 ,DID/1", "ZONE_A,DAL_8G/1,ZONE_B,DID_8G/1", "A/",
             "A/1,A/2", "A/1,,", ","]
    both, eights = {"DAL": 1, "DID": 1}, {"DAL_8G": 1, "DID_8G": 1}
    assert values(spark, texts, X.parse_zone_limits) == [{}, {}, {}, both, both, both, eights, {}, {"A": 2}, {"A": 1}, {}]


@pytest.mark.parametrize("bad", ["A/1/2", "/", "A/x"])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_bad_zone_limits(spark, bad, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="invalid zone limits"):
            values(spark, [bad], X.parse_zone_limits)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_format_zone_limits(spark):
    df = spark.createDataFrame([({"b": 2, "a": 1},), ({},), (None,)], "m map<string,int>")
    assert [r[0] for r in df.select(X.format_zone_limits(F.col("m"))).collect()] == ["a/1,b/2", None, None]
    assert df.select(X.format_zone_limits(F.col("m"), True)).first()[0] == "1/a,2/b"


def test_durations(spark):
    texts = ["PT30S", "P1D", "PT1H30M", "-PT1.5S", "pt0.000001s", "P2DT-3H", None, "PT-1.5S"]
    expected = [30_000_000, 86_400_000_000, 5_400_000_000, -1_500_000, 1, (48 - 3) * 3_600_000_000, None, -1_500_000]
    assert values(spark, texts, X.duration_micros) == expected
    assert values(spark, ["P1DT1H"], X.parse_duration)[0].total_seconds() == 90000


@pytest.mark.parametrize("bad", ["", "P", "PT", "1h", "P1Y", "P1DT"])
def test_bad_durations(spark, bad):
    with pytest.raises(Exception):
        values(spark, [bad], X.duration_micros)


def test_jvm_args(spark):
    text = "${OPTIONS} -Xms1g  -Dzones=A,B \t -Xmx2g "
    assert values(spark, [text, ""], lambda t: X.filter_jvm_args(t, "${OPTIONS}")) == ["-Xms1g -Dzones=A,B -Xmx2g", ""]


def test_padding_keeps_long_text(spark):
    assert values(spark, ["12", "1234567"], lambda t: X.pad_left(t, 5)) == ["   12", "1234567"]
    assert values(spark, ["12", "1234567"], lambda t: X.pad_right(t, 5)) == ["12   ", "1234567"]


def test_rounding_and_text(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (1.4,)], "x double")
    assert [r[0] for r in df.select(X.round_half_up(F.col("x"))).collect()] == [3, -2, 1]
    assert values(spark, ["a", None], X.text_of) == ["a", "null"]
    df = spark.createDataFrame([({"b": "2", "a": None}, ["x", "password=y"])], "m map<string,string>, o array<string>")
    row = df.select(X.map_listing(F.col("m")), X.without_passwords(F.col("o"))).first()
    assert row[0] == "a : null\nb : 2" and row[1] == ["x"]


def test_labels(spark):
    df = spark.createDataFrame(
        [("p", 0, True, True, True), ("p", 1, True, False, True), ("p", 1, True, False, False), ("p", 1, False, True, True)],
        "pu string, part int, stateful boolean, prim boolean, has boolean")
    got = df.select(X.instance_label(F.col("pu"), F.col("part"), F.col("stateful"), F.col("prim"), F.col("has")))
    assert [r[0] for r in got.collect()] == ["p (#1P)", "p (#2B)", "p", "p"]


def test_zone_filter_null_and_empty_lists(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "zones array<string>")

    def kept(**kw):
        return [r[0] for r in df.select(P.in_zones(F.col("zones"), **kw)).collect()]

    assert kept() == [True, True, True]
    assert kept(include=[]) == [False, False, False]
    assert kept(include=["b", "x"]) == [True, False, False]
    assert kept(exclude=["b"]) == [False, True, True]
    assert kept(exclude=[]) == [True, True, True]
    assert kept(include=["a"], exclude=["b"]) == [False, False, False]


def test_machine_filter_matches_name_or_address(spark):
    df = spark.createDataFrame([("h1", "10.0.0.1"), ("h2", "10.0.0.2")], "host string, addr string")
    host, addr = F.col("host"), F.col("addr")
    assert [r.host for r in df.where(P.on_machines(host, addr, ["10.0.0.2"])).collect()] == ["h2"]
    assert [r.host for r in df.where(P.on_machines(host, addr, None, ["h2"])).collect()] == ["h1"]
    assert [r.host for r in df.where(P.is_machine(host, addr, "h1")).collect()] == ["h1"]
    assert df.where(P.on_machines(host, addr, [])).count() == 0
    assert [r.host for r in df.where(P.same_machine(host, "h1")).collect()] == ["h1"]
    assert [r.host for r in df.where(P.different_machine(host, "h1")).collect()] == ["h2"]


def test_conjunction_and_negation(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert df.where(P.all_of()).count() == 3
    assert df.where(P.negate(F.col("b"))).count() == 2


def test_space_roles(spark):
    schema = "embedded boolean, ids array<string>, spaces array<struct<id:string,mode:string>>"
    rows = [
        (True, ["space"], [("s", "PRIMARY")]),
        (True, ["My-MIRROR"], [("s", "BACKUP")]),
        (False, ["space"], [("s", "NONE"), ("t", None)]),
        (True, ["mirror", "space"], []),
    ]
    df = spark.createDataFrame(rows, schema)
    e, i, s = F.col("embedded"), F.col("ids"), F.col("spaces")
    got = df.select(
        P.is_stateful(e, i), P.is_stateless(e, i), P.has_primary(s), P.has_backup(s),
        P.is_stateful_primary(e, i, s), P.is_stateful_backup(e, i, s)).collect()
    assert [tuple(r) for r in got] == [
        (True, False, True, False, True, False), (False, True, False, True, False, False),
        (False, True, False, False, False, False), (True, False, False, False, False, False)]
    with pytest.raises(Exception):
        spark.createDataFrame([(True, ["a"], None)], schema).select(P.has_primary(s)).collect()


def test_zone_requirement_and_isolation(spark):
    df = spark.createDataFrame([([], ["a"]), (["a", "x"], ["a"]), (["x"], ["a"]), (["x"], None)],
                               "req array<string>, zones array<string>")
    assert [r[0] for r in df.select(P.satisfies_zones(F.col("req"), F.col("zones"))).collect()] == [True, True, False, False]
    df = spark.createDataFrame([(True, 0), (True, 1), (False, 1), (None, 1)], "iso boolean, n int")
    assert [r[0] for r in df.select(P.isolation_ok(F.col("iso"), F.col("n"))).collect()] == [True, False, True, True]
