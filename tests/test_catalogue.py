from __future__ import annotations

import pytest

from graphloom.errors import NotFound
from graphloom.operators import derive, infer
from graphloom.operators.update import GraphStore
from graphloom.plans import catalogue
from graphloom.plans.pattern import Solutions, TripleGraph
from graphloom.plans.storage import new_path

CLASSES = [
    derive.ContextClass("Trip", [derive.Attribute("at", "Station", key=True), derive.Attribute("dist", "double", unit="km")], derive.PUBLIC),
    derive.ContextClass("Station", [derive.Attribute("name", "string"), derive.Attribute("area", "Area")]),
    derive.ContextClass("Area", [derive.Attribute("code", "string")]),
    derive.ContextClass("Use", [derive.Attribute("n", "bigint", derived=derive.Derivation([derive.Binding("at", "Trip", "t")], "COUNT(?t)"))]),
    derive.ContextClass("Empty", []),
]


@pytest.fixture
def store(spark):
    s = GraphStore(spark, new_path(spark, "catalogue"))
    catalogue.replace_schemas(s, CLASSES)
    return s


def graph(store):
    return TripleGraph(store.triples())


def test_schemas(store):
    out = catalogue.fetch_schemas(graph(store), ["Trip"]).collect()
    assert {(r["cls"], r["property"]) for r in out} == {("Trip", "at"), ("Trip", "dist"), ("Station", "name"), ("Station", "area"), ("Area", "code")}
    assert {r["unit"] for r in out if r["property"] == "dist"} == {"km"} and all(r["is_key"] == (r["property"] == "at") for r in out)
    assert {r["visibility"] for r in out if r["cls"] == "Trip"} == {"Public"}
    for missing in ("Nothing", "Empty"):
        with pytest.raises(NotFound, match=missing):
            catalogue.fetch_schemas(graph(store), ["Trip", missing])


def test_schemas_are_replaced(store):
    before = store.version()
    catalogue.replace_schemas(store, [])
    assert store.version() == before
    catalogue.replace_schemas(store, [derive.ContextClass("Trip", [derive.Attribute("only", "string")])])
    assert [(r["property"], r["visibility"]) for r in catalogue.fetch_schemas(graph(store), ["Trip"]).collect()] == [("only", "Private")]


def test_nodes(store):
    catalogue.register_node(store, "e1", "EdgeNode", ["Trip", "Area"], ["algo"])
    catalogue.register_node(store, "e2", "EdgeNode", ["Trip"], ["algo"])
    catalogue.register_node(store, "e3", "EdgeNode", ["Trip", "Area"], ["other"])
    catalogue.register_node(store, "f1", "FogNode", address="10.0.0.1:80")
    names = lambda df: sorted(r["node"] for r in df.collect())
    assert names(catalogue.compatible_nodes(graph(store), "algo", ["Trip", "Area"])) == ["e1"]
    assert names(catalogue.compatible_nodes(graph(store), "algo", [])) == ["e1", "e2"]
    catalogue.register_node(store, "algo", "Algorithm", ["Area"])
    assert names(catalogue.compatible_nodes(graph(store), "algo", ["Trip", "Area"])) == ["e1", "e2"]
    assert {r["cls"] for r in catalogue.fetch_schemas(graph(store), ["Trip"], ["algo"]).collect()} == {"Trip", "Station", "Area"}
    catalogue.register_node(store, "e1", "EdgeNode", ["Station"], [])
    assert not store.contains("e1", "acquires", "Trip") and store.contains("e1", "acquires", "Station")


def test_tasks(store):
    catalogue.start_task(store, "t1", "Class1")
    assert catalogue.task_status(graph(store), "t1") == {"task_class": "Class1", "status": "Running", "message": None}
    catalogue.finish_task(store, "t1", "Error", "not enough clients")
    assert catalogue.task_status(graph(store), "t1") == {"task_class": "Class1", "status": "Error", "message": "not enough clients"}
    catalogue.finish_task(store, "t1", "Ok")
    assert catalogue.task_status(graph(store), "t1")["message"] is None
    with pytest.raises(NotFound):
        catalogue.task_status(graph(store), "t2")


def test_records(spark):
    rows = [("r1", "represents", "i1"), ("r1", "category", "glass"), ("r1", "acquiredBy", "n1"), ("r2", "represents", "i1"), ("r2", "category", "glass"), ("r2", "acquiredBy", "n1")]
    rows += [("r3", "represents", "i2"), ("r3", "category", "paper"), ("r3", "acquiredBy", "n1"), ("r3", "predictProb", "0.75"), ("r4", "represents", "i3"), ("r4", "category", "paper"), ("r4", "acquiredBy", "n2")]
    rows += [(f"r{i}", "a", "CategorizedItem") for i in range(1, 5)]
    rows += [("f1", "a", "FogNode"), ("f1", "locatedAt", "p1"), ("p1", "x", "1.5"), ("p1", "y", "2"), ("f2", "a", "FogNode"), ("f2", "locatedAt", "p2"), ("p2", "x", "far"), ("p2", "y", "2")]
    for m, at in (("m1", "2026-01-01T00:00:00Z"), ("m2", "2026-01-02T00:00:00Z"), ("m3", "2026-01-02T00:00:00Z")):
        rows += [(m, "a", "ModelEntry"), (m, "forLayout", "l1"), (m, "acquiredAt", at)]
    g = TripleGraph(infer.inverse(spark.createDataFrame(rows, catalogue.TRIPLES), [("acquired", "acquiredBy")]))
    assert {tuple(r) for r in catalogue.category_counts(g, "n1").df.collect()} == {("glass", 1), ("paper", 1)}
    assert catalogue.predictions(g).df.collect() == [("i2", "paper", 0.75)]
    assert catalogue.node_positions(g, "FogNode").collect() == [("f1", 1.5, 2.0)]
    assert {r["model"] for r in catalogue.latest_models(g).collect()} == {"m2", "m3"}


def test_seed(spark, store):
    one = spark.createDataFrame([("a", "b", "c")], catalogue.TRIPLES)
    store.seed(one, one, spark.createDataFrame([("d", "e", "f")], catalogue.TRIPLES))
    assert sorted(tuple(r) for r in store.triples().collect()) == [("a", "b", "c"), ("d", "e", "f")]


def test_models_and_attributes_never_multiply(spark, monkeypatch):
    """A layout's equally new models and its contexts' attributes are each said once, not as pairs; so are tasks and attributes."""
    n, rows = 30, [("l", "hasFeature", "c"), ("l", "hasTarget", "c"), ("l", "hasTarget", "none"), ("l", "a", "LearningTaskLayout"), ("c", "a", "Class"), ("none", "a", "Class")]
    for i in range(n):
        rows += [(f"m{i}", "a", "ModelEntry"), (f"m{i}", "forLayout", "l"), (f"m{i}", "acquiredAt", "2024"), (f"m{i}", "fromAlgorithm", "x"), (f"m{i}", "forTask", "t")]
        rows += [("c", "hasAttribute", f"a{i}"), ("c", "subClassOf", f"a{i}"), (f"a{i}", "a", "WithAttribute")]
        rows += [(f"a{i}", "onProperty", "p"), (f"a{i}", "isKey", "true"), (f"a{i}", "onRange", "r")]
        rows += [(f"k{i}", "a", "LearningTaskLayout"), (f"k{i}", "hasFeature", "c")]
    graph, counts, construct = TripleGraph(spark.createDataFrame(rows, "s string, p string, o string")), [], Solutions.construct

    def counted(found, *more, **options):
        counts.append(found.df.count())
        return construct(found, *more, **options)

    monkeypatch.setattr(Solutions, "construct", counted)
    models = {tuple(r) for r in catalogue.model_entries(graph).collect()}
    said = {(f"m{i}", p, o) for i in range(n) for p, o in (("a", "ModelEntry"), ("forLayout", "l"), ("fromAlgorithm", "x"), ("forTask", "t"))}
    said |= {(s, p, o) for i in range(n) for s, p, o in (("c", "hasAttribute", f"a{i}"), (f"a{i}", "onProperty", "p"), (f"a{i}", "isKey", "true"), (f"a{i}", "onRange", "r"))}
    assert models == said | {("l", "a", "LearningTaskLayout"), ("l", "hasFeature", "c"), ("l", "hasTarget", "c")}
    assert max(counts) <= 2 * n
    counts.clear()
    assert catalogue.task_dependencies(graph, "x").count() == 3 * (n + 1) + 2 + 3 * n + n  # l's target too; c's class; attributes with key and range
    assert max(counts) <= 2 * n + 4
