import json

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.layers import LAYERS, effective_config, shown_config
from fleetlens.plans.config import config_layers, descriptor_of, overlaid_settings
from fleetlens.sources import files as S


# fixed values: the field names of a descriptor file
CORE = {
    "name": "core", "resource": "core.jar",
    "topology": {"schema": "partitioned", "partitions": 2, "backupsPerPartition": 1},
    "sla": {"requiresIsolation": False, "zones": ["A"], "maxInstancesPerVM": 1, "maxInstancesPerMachine": 1,
            "maxInstancesPerZone": "A/1,B/2"},
    "contextProperties": {"url": "x", "size": 3, "on": True, "text": "3", "none": None},
}
IO = {"name": "io", "topology": {"instances": 4}, "contextProperties": {}}
MIRROR = {"name": "mirror", "resource": "m.jar", "sla": {"zones": ["A", "B"]}}


@pytest.fixture
def folder(tmp_path):
    for d in (CORE, IO, MIRROR):
        (tmp_path / f"{d['name']}.json").write_text(json.dumps(d, indent=2))
    return tmp_path


def test_read_descriptors(spark, folder):
    rows = {r.pu: r for r in S.read_descriptors(spark, str(folder)).collect()}
    assert rows["core"].descriptor.topology.partitions == 2
    assert rows["core"].descriptor.sla.zones == ["A"]
    assert {(e.key, e.value, e.value_type) for e in rows["core"].context} == {
        ("url", "x", "STRING"), ("size", "3", "BIGINT"), ("on", "true", "BOOLEAN"), ("text", "3", "STRING"),
        ("none", None, "VOID")}
    assert rows["io"].descriptor.sla is None and rows["io"].descriptor.topology.instances == 4
    pu = spark.createDataFrame([("core",), ("lost",)], "pu string")
    joined = {r.pu: r for r in S.descriptors_of(pu, S.read_descriptors(spark, str(folder))).collect()}
    assert joined["lost"].descriptor is None and joined["lost"].problem == "no descriptor file"
    layers = S.descriptor_layers(S.read_descriptors(spark, str(folder)))
    assert layers.count() == 5


def test_bad_descriptors(spark, folder):
    (folder / "odd.json").write_text(json.dumps({"name": "odd", "extra": 1, "sla": {"zone": []}}))
    (folder / "broken.json").write_text("{")
    rows = {r.pu: r for r in S.read_descriptors(spark, str(folder), strict=False).collect()}
    assert rows["odd"].problem == "unknown fields: $.extra, $.sla.zone" and rows["odd"].descriptor is None
    assert rows["broken"].problem == "not valid JSON"
    with pytest.raises(Exception):
        S.read_descriptors(spark, str(folder)).collect()


def test_descriptor_round_trip(spark, folder):
    d = S.read_descriptors(spark, str(folder))
    text = d.where("pu = 'core'").select(S.descriptor_json(F.col("descriptor"), F.col("context")).alias("t")).first().t
    assert json.loads(text) == CORE and text.endswith("}\r\n") and "\n  " in text
    plain = d.where("pu = 'mirror'").select(S.descriptor_json(F.col("descriptor"), F.col("context")).alias("t")).first().t
    assert json.loads(plain) == MIRROR


@pytest.mark.parametrize("text, problem", [
    ({"topology": {"instances": "two"}}, "wrong types: $.topology.instances is STRING"),
    ({"topology": 5}, "wrong types: $.topology is BIGINT"),
    ([1], "wrong types: $ is ARRAY<BIGINT>"),
    (None, "wrong types: $ is VOID"),
    ({"sla": {"zones": "A", "maxInstancesPerVM": True}}, "wrong types: $.sla.zones is STRING, $.sla.maxInstancesPerVM is BOOLEAN"),
    ({"sla": {"zones": [["A"]]}}, "wrong types: $.sla.zones is ARRAY<ARRAY<STRING>>"),
    ({"topology": {"instances": 3000000000}, "x": 1}, "wrong types: $.topology.instances is BIGINT; unknown fields: $.x"),
])
def test_mistyped_descriptors(spark, text, problem):
    df = spark.createDataFrame([(json.dumps(text),)], "text string")
    row = S.parse_descriptors(df, strict=False).first()
    assert row.problem == problem and row.descriptor is None and row.context is None
    with pytest.raises(Exception):
        S.parse_descriptors(df).collect()


def test_coerced_descriptors(spark):
    text = {"name": 7, "topology": {"instances": "4", "partitions": None, "backupsPerPartition": ""},
            "sla": {"requiresIsolation": "true", "zones": ["A", 1, None], "maxInstancesPerVM": 1.5}}
    d = S.parse_descriptors(spark.createDataFrame([(json.dumps(text),)], "text string")).first().descriptor
    assert d.name == "7" and tuple(d.topology) == (None, 4, None, None)
    assert tuple(d.sla) == (True, ["A", "1", None], 1, None, None)


BASE = ("pu string, cluster_schema string, instances int, backups int, requires_isolation boolean, max_per_vm int,"
        " max_per_machine int, zones array<string>, zone_limits map<string,int>")


def test_overlay(spark, folder):
    base = spark.createDataFrame([
        ("core", "default", 9, 0, True, 7, 7, ["Z"], {"Z": 9}), ("io", "default", 9, 3, True, 7, 7, ["Z"], {"Z": 9}),
        ("mirror", "default", 9, 3, True, 7, 7, ["Z"], {"Z": 9}), ("lost", "default", 9, 3, True, 7, 7, ["Z"], {"Z": 9}),
    ], BASE)
    got = {r.pu: r for r in overlaid_settings(base, S.read_descriptors(spark, str(folder))).collect()}
    assert tuple(got["core"])[1:] == ("partitioned", 2, 1, False, 1, 1, ["A"], {"A": 1, "B": 2}, "core.jar")
    assert tuple(got["io"])[1:] == (None, 4, None, True, 7, 7, ["Z"], {"Z": 9}, None)
    assert tuple(got["mirror"])[1:] == ("default", 9, 3, None, None, None, ["A", "B"], {"Z": 9}, "m.jar")
    assert tuple(got["lost"])[1:] == ("default", 9, 3, True, 7, 7, ["Z"], {"Z": 9}, "lost.jar")


def test_descriptor_of_settings(spark):
    df = spark.createDataFrame([
        ("a", "partitioned", 2, 1, None, None, 3, [], {"A": 1}, "a.jar"),
        ("b", None, 5, None, None, None, None, None, None, "b.jar"),
        ("c", None, None, None, None, None, None, [], {}, "c.jar"),
    ], BASE + ", resource string")
    got = {r.pu: r.descriptor for r in descriptor_of(df).collect()}
    assert got["a"].topology.asDict() == {"schema": "partitioned", "instances": None, "partitions": 2,
                                          "backupsPerPartition": 1}
    assert got["a"].sla.asDict() == {"requiresIsolation": None, "zones": None, "maxInstancesPerVM": None,
                                     "maxInstancesPerMachine": 3, "maxInstancesPerZone": "A/1"}
    assert got["b"].topology.instances == 5 and got["b"].sla is None
    assert got["c"].topology is None and got["c"].sla is None
    assert {r.pu: r.descriptor for r in descriptor_of(df, True).collect()}["a"].sla.maxInstancesPerZone == "1/A"


def test_properties(spark):
    text = (
        "# comment \\\nplain=1\n! other\n\n  spaced   value with  spaces \r\nkey\\:with\\=signs : v\\tTab\n"
        "long = first, \\\n   second, \\\n\tthird\nempty\nplain=2\nuni=\\u0041\\\\n\\z \"quoted\"\npath=c:\\\\dir\n"
        "joined=a\\\n#b\nlast=end\\"
    )
    df = spark.createDataFrame([("f", text)], "file string, text string")
    got = {r.key: r.value for r in S.parse_properties(df).collect()}
    assert got == {
        "plain": "2", "spaced": "value with  spaces ", "key:with=signs": "v\tTab", "long": "first, second, third",
        "empty": "", "uni": "A\\nz \"quoted\"", "path": "c:\\dir", "joined": "a#b", "last": "end"}
    with pytest.raises(Exception):
        S.parse_properties(spark.createDataFrame([("f", "a=\\u00")], "file string, text string")).collect()


def test_shared_properties(spark, tmp_path):
    for d, names in {"one": ("shared-public", "shared-secrets", "other"), "two": ("shared-public",)}.items():
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / f"{n}.properties").write_text(f"from={n}\n")
    rows = S.read_shared_properties(spark, str(tmp_path)).collect()
    assert sorted((r.directory.split("/")[-1], r.layer_name, r.value, r.is_secret) for r in rows) == [
        ("one", "shared_config", "shared-public", False), ("one", "shared_secrets", "shared-secrets", True),
        ("two", "shared_config", "shared-public", False)]
    assert {r.layer_name for r in rows} <= set(LAYERS)


def test_typed_values_are_distinct(spark):
    layers = spark.createDataFrame(
        [("e", 0, "k", "1", "STRING"), ("e", 1, "k", "1", "BIGINT"), ("e", 2, "k", "1", "STRING"), ("e", 0, "n", None, "VOID")],
        "entity string, layer int, key string, value string, value_type string")
    got = {r.key: r.value for r in effective_config(layers).collect()}
    assert got == {"k": "1", "n": "null"}


def test_process_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<process><script><environment>${OPTIONS} -Xmx1g  -Dzones=A,B</environment></script></process>")
    (tmp_path / "b.xml").write_text("<process><vm/></process>")
    got = {r.file_name: (r.environment, r.jvm_args) for r in S.read_process_files(spark, str(tmp_path), "${OPTIONS}").collect()}
    assert got == {"a.xml": ("${OPTIONS} -Xmx1g  -Dzones=A,B", "-Xmx1g -Dzones=A,B"), "b.xml": ("", "")}


def test_layers_of_a_deployment(spark):
    pu = spark.createDataFrame([("a", "d1"), ("b", "d2")], "pu string, directory string")
    original = spark.createDataFrame([("a", "k", "0"), ("a", "only", "o"), ("b", "k", "b")], "pu string, key string, value string")
    shared = spark.createDataFrame(
        [("d1", "shared_config", "k", "1", False), ("d1", "shared_secrets", "pw", "s", True)],
        "directory string, layer_name string, key string, value string, is_secret boolean")
    descriptors = spark.createDataFrame(
        [("a", "k", "0", "STRING", False), ("a", "pw", "t", "STRING", True), ("b", "k", "7", "BIGINT", False)],
        "entity string, key string, value string, value_type string, is_secret boolean")
    layers = config_layers(pu, original, shared, descriptors)
    got = {(r.entity, r.key): r.value for r in effective_config(layers).collect()}
    # the descriptor repeats the original value of k, so the shared one stays
    assert got == {("a", "k"): "1", ("a", "only"): "o", ("a", "pw"): "t", ("b", "k"): "7"}
    assert {(r.entity, r.key): r.value for r in shown_config(layers).collect()}[("a", "pw")] == "****"


def test_plain_descriptors_are_judged_as_field_by_field(spark, monkeypatch):
    texts = ['{}', '{"name":"a"}', '{"name":null,"sla":null}', '{"sla":{}}', '{"contextProperties":{},"name":"x"}', '[1]', 'null', '"x"', '{"name":{}}',
             '{"contextProperties":{"a":1,"b":"x","c":null}}', '{"contextProperties":{"a":{"b":1}}}', '{"contextProperties":{"a":1},"extra":{"x":1}}',
             '{"contextProperties":{"a":1},"zone":1}', '{"sla":{"zones":["x"],"maxInstancesPerVM":3},"topology":{"instances":4,"schema":"s"}}',
             '{"sla":{"zones":["x",null]}}', '{"sla":{"zones":[1]}}', '{"sla":{"zones":[]}}', '{"topology":{"instances":12345678901}}',
             '{"topology":{"instances":"12"}}', '{"topology":{"instances":2.5}}', '{"topology":{"instances":true}}', '{"topology":{"more":1}}',
             '{"name":"OBJECT<x: STRING>"}', '{"a>, name":"x"}', '{"sla":{"requiresIsolation":true}}', '{"sla":{"requiresIsolation":1}}', None, '{']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")

    def rows():
        parsed = S.parse_descriptors(df, strict=False)
        return sorted(map(str, parsed.select("i", "problem", "descriptor", "context").collect()))

    fast = rows()
    monkeypatch.setattr(S, "_plain_shape", lambda: "(?!)")
    assert fast == rows()
