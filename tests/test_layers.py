import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallymill.operators.layers import (
    OWN_LAYER,
    layered_merge,
    merge_once,
    merge_switch,
    order_layers,
    precedence_stack,
    resolve_layers,
    stack_layers,
)

DOC = (
    "app string, layer int, name string, main_application_file string, main_class string, "
    "spark_conf map<string,string>, args array<string>, "
    "deps struct<requirements:array<string>>"
)


def golden(spark):
    rows = [
        ("job", 0, "a", "local:///placeholder.jar", "com.example.Job",
         {"spark.executor.memory": "4g"}, ["--verbose"], (["numpy==1.21"],)),
        ("job", 1, "b", "local:///placeholder.jar", None,
         {"spark.executor.memory": "8g", "spark.executor.cores": "4"},
         ["--output", "/tmp/out"], (["pandas==2.0"],)),
        ("job", OWN_LAYER, None, "local:///app.jar", None,
         {"spark.driver.memory": "2g"}, ["--app-arg"], (["scipy==1.9"],)),
    ]
    return spark.createDataFrame(rows, DOC)


RULES = {
    "main_application_file": "last",
    "main_class": "last_set",
    "spark_conf": "union",
    "args": "concat",
    "deps.requirements": "concat",
}


def test_three_layers(spark):
    row = layered_merge(golden(spark), "app", "layer", RULES).first()
    assert row.main_application_file == "local:///app.jar"
    assert row.main_class == "com.example.Job"
    assert row.spark_conf == {
        "spark.executor.memory": "8g",
        "spark.executor.cores": "4",
        "spark.driver.memory": "2g",
    }
    assert row.args == ["--verbose", "--output", "/tmp/out", "--app-arg"]
    assert row["deps.requirements"] == ["numpy==1.21", "pandas==2.0", "scipy==1.9"]


def test_merging_does_not_depend_on_row_order(spark):
    forward = layered_merge(golden(spark), "app", "layer", RULES).collect()
    backward = golden(spark).repartition(3).orderBy(F.col("layer").desc())
    assert layered_merge(backward, "app", "layer", RULES).collect() == forward


def test_required_scalar_may_end_null(spark):
    df = spark.createDataFrame([(1, 0, "x"), (1, 1, None)], "k int, layer int, v string")
    assert layered_merge(df, "k", "layer", {"v": "last"}).first().v is None
    assert layered_merge(df, "k", "layer", {"v": "last_set"}).first().v == "x"


def test_map_is_null_only_if_all_layers_are(spark):
    rows = [(1, 0, None), (1, 1, None), (2, 0, None), (2, 1, {}), (3, 0, {"a": "1"}), (3, 1, None),
            (4, 0, {"a": "1"}), (4, 1, {"a": None})]
    df = spark.createDataFrame(rows, "k int, layer int, m map<string,string>")
    merged = layered_merge(df, "k", "layer", {"m": "union"})
    assert {r.k: r.m for r in merged.collect()} == {1: None, 2: {}, 3: {"a": "1"}, 4: {"a": None}}


def test_maps_of_different_types(spark):
    df = spark.createDataFrame(
        [(1, 0, {"a": "x"}, {"n": 1}), (1, 1, None, {"n": 2})],
        "k int, layer int, s map<string,string>, n map<string,int>",
    )
    row = layered_merge(df, "k", "layer", {"s": "union", "n": "union"}).first()
    assert row.s == {"a": "x"} and row.n == {"n": 2}


def test_container_resources_are_merged_by_name_and_key(spark):
    schema = (
        "app string, layer int, containers array<struct<name:string,image:string,"
        "requests:map<string,string>,limits:map<string,string>>>"
    )
    base = [("spark-submit", "one", {"cpu": "500m", "memory": "512Mi"}, None), ("side", None, None, None)]
    overlay = [("extra", None, {}, None), ("spark-submit", None, {"cpu": "1500m"}, {"memory": "2Gi"})]
    df = spark.createDataFrame([("a", 0, base), ("a", 1, overlay)], schema)
    found = layered_merge(df, "app", "layer", {"containers": "named"}).first().containers
    assert [c.name for c in found] == ["spark-submit", "side", "extra"]
    assert found[0].requests == {"cpu": "1500m", "memory": "512Mi"}
    assert found[0].limits == {"memory": "2Gi"} and found[0].image == "one"
    assert found[1].requests is None and found[2].requests == {}


def test_fragments(spark):
    schema = "k int, layer int, c struct<a:int,b:int>"
    rows = [(1, 0, (1, None)), (1, 1, (2, 3)), (2, 0, None), (2, 1, (5, 6)), (3, 0, None)]
    df = spark.createDataFrame(rows, schema)

    def merged(rule):
        return {r.k: r.c and tuple(r.c) for r in layered_merge(df, "k", "layer", {"c": rule}).collect()}

    assert merged("fragment") == {1: (2, 3), 2: (5, 6), 3: None}
    assert merged("fragment_base") == {1: (1, 3), 2: (5, 6), 3: None}


def test_nested_resources_are_merged_by_leaf(spark):
    inner = "resources:struct<requests:map<string,string>,limits:map<string,string>,class:struct<a:int,b:int>>"
    schema = f"app string, layer int, containers array<struct<name:string,{inner}>>, pod struct<{inner}>"
    base = ({"cpu": "500m", "memory": "512Mi"}, None, (1, None))
    overlay = ({"cpu": "1500m"}, {"memory": "2Gi"}, (None, 2))
    rows = [("a", 0, [("spark-submit", base)], (base,)), ("a", 1, [("spark-submit", overlay)], (overlay,)), ("b", 0, [("x", None)], None)]
    df = spark.createDataFrame(rows, schema).withColumn("first", F.col("pod"))
    rules = {"containers": "named", "pod": "fragment", "first": "fragment_base"}
    found = {r.app: r for r in layered_merge(df, "app", "layer", rules).collect()}
    want = ({"cpu": "1500m", "memory": "512Mi"}, {"memory": "2Gi"}, (1, 2))
    for resources in (found["a"].containers[0].resources, found["a"].pod.resources):
        assert (resources.requests, resources.limits, tuple(resources["class"])) == want
    assert found["a"]["first"].resources.requests == {"cpu": "500m", "memory": "512Mi"}
    assert found["b"].containers[0].resources is None and found["b"].pod is None


def test_environment_is_replaced_by_name_and_sorted(spark):
    schema = "k int, layer int, env array<struct<name:string,value:string>>"
    df = spark.createDataFrame([(1, 0, [("Z", "1"), ("A", "1")]), (1, 1, [("Z", "2"), ("B", None)])], schema)
    env = layered_merge(df, "k", "layer", {"env": "env"}).first().env
    assert [tuple(e) for e in env] == [("A", "1"), ("B", None), ("Z", "2")]


def test_key_without_any_list_is_kept(spark):
    schema = "k int, layer int, v int, env array<struct<name:string,value:string>>"
    df = spark.createDataFrame([(1, 0, 7, None)], schema)
    row = layered_merge(df, "k", "layer", {"v": "last", "env": "env"}).first()
    assert row.v == 7 and row.env is None


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        layered_merge(golden(spark), "app", "layer", {"args": "newest"})


def annotated(spark, annotations):
    return spark.createDataFrame([("x", annotations)], "app string, annotations map<string,string>")


def test_layers_in_numeric_order(spark):
    df = annotated(spark, {
        "spark-application.template.10.name": "ten",
        "spark-application.template.9.name": "nine",
        "spark-application.template.merge": "true",
        "x.spark-application.template.1.name": "no",
        "spark-application.template.merge": "true",
        "spark-application.template.255.name": "last",
    })
    assert df.select(order_layers("annotations")).first()[0] == ["nine", "ten", "last"]
    assert annotated(spark, {}).select(order_layers("annotations")).first()[0] == []


@pytest.mark.parametrize("index", ["256", "99999999999999999999"])
def test_index_out_of_range(spark, index):
    df = annotated(spark, {f"spark-application.template.{index}.name": "x"})
    with pytest.raises(PySparkException, match="invalid layer index"):
        df.select(order_layers("annotations")).collect()


@pytest.mark.parametrize("switch, layers", [("true", ["one"]), ("false", []), (None, [])])
def test_merge_switch(spark, switch, layers):
    annotations = {"spark-application.template.1.name": "one"}
    if switch:
        annotations["spark-application.template.merge"] = switch
    df = annotated(spark, annotations)
    assert df.select(order_layers("annotations")).first()[0] == layers
    assert df.select(merge_switch("annotations")).first()[0] == (switch == "true")


@pytest.mark.parametrize("switch", ["True", "yes", "", " true"])
def test_a_bad_merge_switch(spark, switch):
    df = annotated(spark, {"spark-application.template.1.name": "one", "spark-application.template.merge": switch})
    with pytest.raises(PySparkException, match="must be true or false"):
        df.select(order_layers("annotations")).collect()


def test_no_merge_without_the_switch(spark):
    schema = "app string, annotations map<string,string>, conf map<string,string>"
    name = {"spark-application.template.1.name": "a"}
    rows = [
        ("on", {**name, "spark-application.template.merge": "true"}, {"k": "own"}),
        ("off", {**name, "spark-application.template.merge": "false"}, {"k": "own"}),
        ("none", name, {"k": "own"}),
        ("null", None, {"k": "own"}),
        ("gone", {"spark-application.template.1.name": "?", "spark-application.template.merge": "true"}, {"k": "own"}),
    ]
    specs = spark.createDataFrame(rows, schema)
    templates = spark.createDataFrame([("a", {"k": "t", "more": "t"})], "name string, conf map<string,string>")
    docs = stack_layers(resolve_layers(specs, templates, "app", order_layers("annotations")), specs.select("app", "conf"))
    none = spark.createDataFrame([], "app string, phase string")
    merged = merge_once(docs, none, "app", "layer", {"conf": "union"})
    found = {r.app: (r.conf, r.applied) for r in merged.collect()}
    assert found.pop("on") == ({"k": "own", "more": "t"}, ["a"])
    assert found == {app: ({"k": "own"}, []) for app in ("off", "none", "null", "gone")}


def test_elements_without_a_name_are_not_those_with_an_empty_one(spark):
    schema = "app string, layer int, boxes array<struct<name:string,image:string,port:int>>"
    rows = [
        ("x", 1, [(None, "base", 1), ("", "empty", 2)]),
        ("x", 2, [("", None, 3), (None, "over", None), ("b", "new", None)]),
        ("y", 1, []), ("z", 1, None),
    ]
    merged = layered_merge(spark.createDataFrame(rows, schema), "app", "layer", {"boxes": "named"})
    found = {r.app: None if r.boxes is None else [tuple(b) for b in r.boxes] for r in merged.collect()}
    assert found == {"x": [(None, "over", 1), ("", "empty", 3), ("b", "new", None)], "y": [], "z": None}


def test_missing_layers(spark):
    specs = spark.createDataFrame([("x", ["a", "gone", "b"])], "app string, refs array<string>")
    templates = spark.createDataFrame([("a", 1), ("b", 2)], "name string, v int")
    found = resolve_layers(specs, templates, "app", "refs").orderBy("layer").collect()
    assert [(r.layer, r.name, r.v) for r in found] == [(0, "a", 1), (2, "b", 2)]
    with pytest.raises(PySparkException, match="no such layer: gone"):
        resolve_layers(specs, templates, "app", "refs", strict=True).collect()


def test_own_document_is_on_top(spark):
    specs = spark.createDataFrame([("x", ["a"], 9)], "app string, refs array<string>, v int")
    templates = spark.createDataFrame([("a", 1)], "name string, v int")
    stacked = stack_layers(
        resolve_layers(specs, templates, "app", "refs"), specs.select("app", "v")
    )
    assert layered_merge(stacked, "app", "layer", {"v": "last"}).first().v == 9


def test_precedence(spark):
    def conf(values):
        return spark.createDataFrame([("x", values)], "app string, conf map<string,string>")

    merged = precedence_stack(
        [conf({"a": "0", "b": "0", "c": "0"}), conf({"b": "1", "c": "1"}), conf({"c": "2"})],
        "app", "conf",
    )
    assert merged.first().conf == {"a": "0", "b": "1", "c": "2"}


def test_merging_once(spark):
    docs = golden(spark)
    empty = spark.createDataFrame([], "app string, phase string")
    row = merge_once(docs, empty, "app", "layer", {"args": "concat"}).first()
    assert row.applied == ["a", "b"]
    waiting = spark.createDataFrame([("job", "")], "app string, phase string")
    assert merge_once(docs, waiting, "app", "layer", {"args": "concat"}).count() == 1
    done = spark.createDataFrame([("job", "Unknown")], "app string, phase string")
    assert merge_once(docs, done, "app", "layer", {"args": "concat"}).count() == 0
