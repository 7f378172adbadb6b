"""The standing questions and updates of a context graph, as patterns over a triples table.

Predicates and classes are plain names: a, subClassOf, WithAttribute, onProperty, onRange, isKey, unit,
visibility, acquires, implements, acquired, hasStatus, and so on.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import NotFound
from graphloom.operators.closure import path_closure
from graphloom.operators.derive import ContextClass
from graphloom.operators.joins import division
from graphloom.operators.update import GraphStore
from graphloom.plans.pattern import Solutions, TripleGraph, bgp, construct_all, semi_join
from graphloom.plans.storage import small, table

TRIPLES = "s string, p string, o string"


def encode_schema(spark: SparkSession, classes: Sequence[ContextClass]) -> DataFrame:
    """The triples of context classes: each attribute is a node above its class."""
    rows: list[tuple[str, str, str]] = []
    for c in classes:
        rows += [(c.name, "a", "Class"), (c.name, "visibility", c.visibility)]
        rows += [(c.name, "subClassOf", p) for p in c.parents]
        for i, a in enumerate(c.attributes):
            node = f"#{c.name}-Attr{i}"
            rows += [(c.name, "subClassOf", node), (node, "a", "WithAttribute"), (node, "onProperty", a.name), (node, "onRange", a.type)]
            rows += [(node, "isKey", "true")] if a.key else []
            rows += [(node, "unit", a.unit)] if a.unit else []
            if a.derived:
                derived = f"{node}-derived"
                rows.append((node, "derived", derived))
                rows += [(derived, "fromExpression", a.derived.expression)] if a.derived.expression else []
                for k, b in enumerate(a.derived.bindings):
                    rows += [(derived, "fromAttribute", f"{derived}{k}"), (f"{derived}{k}", "onProperty", b.attribute), (f"{derived}{k}", "label", b.name)]
                    rows += [(f"{derived}{k}", "onDomain", b.domain)] if b.domain else []
    return spark.createDataFrame(rows, TRIPLES)


def replace_schemas(store: GraphStore, classes: Sequence[ContextClass]) -> None:
    """The classes anew, with all their attribute nodes; none is no update."""
    if not classes:
        return
    triples = store.triples()
    own = F.col("s").isin([c.name for c in classes]) & F.col("p").isin("a", "visibility", "subClassOf")
    node = F.regexp_extract("s", r"^#(.*)-Attr\d+", 1).isin([c.name for c in classes])
    store.update(triples.where(own | node), encode_schema(store.spark, classes))


def register_node(store: GraphStore, node: str, kind: str, classes: Sequence[str] = (), algorithms: Sequence[str] = (), address: str | None = None) -> None:
    """What a node is, acquires and implements, in place of what it said before."""
    rows = [(node, "a", kind)] + [(node, "acquires", c) for c in classes] + [(node, "implements", a) for a in algorithms]
    rows += [(node, "address", address)] if address else []
    store.replace([node], ["a", "acquires", "implements", "address"], store.spark.createDataFrame(rows, TRIPLES))


def start_task(store: GraphStore, task: str, task_class: str) -> None:
    rows = [(task, "a", "LearningTask"), (task, "instanceOf", task_class), (task, "hasStatus", "Running")]
    store.insert(store.spark.createDataFrame(rows, TRIPLES))


def finish_task(store: GraphStore, task: str, status: str, message: str | None = None) -> None:
    """The task's status and message in place of the old ones."""
    rows = [(task, "hasStatus", status)] + ([(task, "message", message)] if message else [])
    store.replace([task], ["hasStatus", "message"], store.spark.createDataFrame(rows, TRIPLES))


def task_status(graph: TripleGraph, task: str) -> dict[str, str | None]:
    """task_class, status and message of a task; an unknown task is an error."""
    known = bgp(graph, ("?task", "a", "LearningTask"), ("?task", "instanceOf", "?task_class"), ("?task", "hasStatus", "?status")).filter(F.col("task") == task)
    row = known.optional(bgp(graph, ("?task", "message", "?message"))).project("task_class", "status", "message").df.first()
    if row is None:
        raise NotFound(f"no task {task}")
    return row.asDict()


def class_dependencies(graph: TripleGraph) -> DataFrame:
    """cls and dep: the classes that a class's attributes range over, and theirs in turn, as far as they have attributes."""
    attributes = bgp(graph, ("?c", "subClassOf", "?att"), ("?att", "a", "WithAttribute"))
    hops = attributes.join(bgp(graph, ("?att", "onRange", "?r")))
    closed = path_closure(hops.df.select(F.col("c").alias("s"), F.col("r").alias("o")))
    have = attributes.df.select(F.col("c").alias("dep")).distinct()
    return closed.select(F.col("s").alias("cls"), F.col("o").alias("dep")).join(have, "dep", "left_semi").select("cls", "dep")


def fetch_schemas(graph: TripleGraph, classes: Sequence[str], algorithms: Sequence[str] = ()) -> DataFrame:
    """cls, property, range, is_key, unit and visibility of the classes, those the algorithms acquire, and all they depend on.

    A requested class without attributes is an error; attributes without a range are left out.
    """
    spark = graph.triples.sparkSession
    wanted = spark.createDataFrame([(c,) for c in classes], "cls string")
    if algorithms:
        wanted = wanted.unionByName(bgp(graph, ("?a", "acquires", "?cls")).values("a", list(algorithms)).project("cls").df).distinct()
    needed = wanted.unionByName(class_dependencies(graph).join(wanted, "cls", "left_semi").select(F.col("dep").alias("cls"))).distinct()
    star = bgp(graph, ("?cls", "subClassOf", "?att"), ("?att", "a", "WithAttribute"), ("?att", "onProperty", "?property"), ("?att", "onRange", "?range"))
    found = star.optional(bgp(graph, ("?cls", "visibility", "?v"))).optional(bgp(graph, ("?att", "isKey", "?k"))).optional(bgp(graph, ("?att", "unit", "?unit")))
    out = found.df.join(needed, "cls", "left_semi").select(
        "cls", "property", "range", F.coalesce(F.col("k") == "true", F.lit(False)).alias("is_key"), "unit", F.coalesce("v", F.lit("Private")).alias("visibility")
    )
    missing = spark.createDataFrame([(c,) for c in classes], "cls string").join(out, "cls", "left_anti")
    names = sorted(r["cls"] for r in missing.collect())
    if names:
        raise NotFound(f"no such class: {names}")
    return out


def _derivations(graph: TripleGraph) -> Solutions:
    """How attributes are derived: att, derivation, dvAttr, dvDomain, dvProp; maybe dvLabel, dvExpr, and the derivation of the property itself."""
    found = bgp(graph, ("?att", "derived", "?derivation"), ("?derivation", "fromAttribute", "?dvAttr"), ("?dvAttr", "onDomain", "?dvDomain"), ("?dvAttr", "onProperty", "?dvProp"))
    of_property = bgp(
        graph,
        ("?dvProp", "derived", "?propDerivation"),
        ("?propDerivation", "fromExpression", "?propDvExpr"),
        ("?propDerivation", "fromAttribute", "?propDvAttr"),
        ("?propDvAttr", "onProperty", "?propDvProp"),
    ).optional(bgp(graph, ("?propDvAttr", "label", "?propDvLabel")))
    labelled = found.optional(bgp(graph, ("?dvAttr", "label", "?dvLabel"))).optional(bgp(graph, ("?derivation", "fromExpression", "?dvExpr")))
    return labelled.optional(of_property.bind("dvPropType", F.lit("DerivedProperty")))


#: What is said of attributes and their derivations.
_ATTRIBUTES = [
    ("?ctx", "hasAttribute", "?att"),
    ("?att", "onProperty", "?prop"),
    ("?att", "isKey", "?key"),
    ("?att", "onRange", "?range"),
    ("?att", "derived", "?derivation"),
    ("?derivation", "fromAttribute", "?dvAttr"),
    ("?derivation", "fromExpression", "?dvExpr"),
    ("?dvAttr", "onDomain", "?dvDomain"),
    ("?dvAttr", "onProperty", "?dvProp"),
    ("?dvAttr", "label", "?dvLabel"),
    ("?dvProp", "a", "?dvPropType"),
    ("?dvProp", "derived", "?propDerivation"),
    ("?propDerivation", "fromExpression", "?propDvExpr"),
    ("?propDerivation", "fromAttribute", "?propDvAttr"),
    ("?propDvAttr", "onProperty", "?propDvProp"),
    ("?propDvAttr", "label", "?propDvLabel"),
]


def _contexts(graph: TripleGraph, layout: str) -> Solutions:
    """A layout's features and targets, each as feature or target, and as ctx."""
    features = bgp(graph, (f"?{layout}", "hasFeature", "?feature")).bind("ctx", "feature")
    return features.union(bgp(graph, (f"?{layout}", "hasTarget", "?target")).bind("ctx", "target"))


def _written(found: Solutions, name: str) -> Solutions:
    """found, written once, as several parts of an answer use it."""
    return Solutions(table(found.df, name), found.maybe)


def task_dependencies(graph: TripleGraph, algorithm: str, tasks: Sequence[str] | None = None, default: str = "SupervisedLearning") -> DataFrame:
    """The graph that tasks (by default all) need: layout and paradigm, features and targets with their attributes and
    derivations, the classes they depend on, and what the algorithm acquires, if it is of a task's paradigm.

    A task without a paradigm has the default one; a context without attributes gives nothing.
    Tasks, contexts and attributes are each said by themselves: their joined solutions would grow as the product of them.
    """
    task = bgp(graph, ("?task", "a", "LearningTaskLayout"))
    task = (task.values("task", tasks) if tasks is not None else task).optional(bgp(graph, ("?task", "requiresParadigm", "?p")))
    layout = task.bind("paradigm", F.coalesce("p", F.lit(default))).join(_contexts(graph, "task"))
    typed = layout.join(bgp(graph, ("?ctx", "a", "Class"))).optional(bgp(graph, ("?ctx", "visibility", "?vis")))
    typed = _written(typed, "task-contexts")
    attributes = bgp(graph, ("?ctx", "subClassOf", "?att"), ("?att", "a", "WithAttribute"), ("?att", "onProperty", "?prop"))
    attributes = semi_join(attributes, typed.project("ctx")).optional(bgp(graph, ("?att", "onRange", "?range"))).optional(bgp(graph, ("?att", "isKey", "?key")))
    attributes = _written(attributes.optional(_derivations(graph)), "task-attributes")
    known = bgp(graph, ("?algo", "a", "MlAlgorithm"), ("?algo", "inParadigm", "?paradigm")).values("algo", [algorithm])
    known = known.optional(bgp(graph, ("?algo", "acquires", "?mlCtx")))
    found = _written(semi_join(typed, attributes.project("ctx")), "task-contexts")
    about_task = [
        ("?task", "a", "LearningTaskLayout"),
        ("?task", "hasFeature", "?feature"),
        ("?task", "hasTarget", "?target"),
        ("?task", "requiresParadigm", "?paradigm"),
        ("?ctx", "a", "ContextClass"),
        ("?ctx", "visibility", "?vis"),
    ]
    needs = found.project("task", "ctx").distinct().join(attributes.project("ctx", "dvDomain").distinct())
    about_algorithm = [("?algo", "a", "MlAlgorithm"), ("?algo", "acquires", "?mlCtx")]
    return construct_all(
        (found, about_task),
        (needs, [("?task", "dependsOn", "?dvDomain")]),
        (semi_join(known, found.project("paradigm")), about_algorithm),
        (attributes, _ATTRIBUTES),
    )


def model_entries(graph: TripleGraph) -> DataFrame:
    """The newest model of each layout, with the layout's contexts, their attributes and derivations.

    Attributes without a range or key mark do not count; a layout without such attributes gives no entry.
    Models, layouts and attributes are each said by themselves: a layout's models and its attributes never meet.
    """
    newest = _written(Solutions(latest_models(graph).select("layout", "model")), "newest-models")
    about = [semi_join(bgp(graph, ("?model", p, v)), newest.project("model")) for p, v in (("fromAlgorithm", "?algo"), ("forTask", "?task"))]
    newest = _written(reduce(Solutions.join, about, newest), "newest-models")
    attributes = bgp(graph, ("?ctx", "hasAttribute", "?att"), ("?att", "onProperty", "?prop"), ("?att", "isKey", "?key"), ("?att", "onRange", "?range"))
    attributes = _written(semi_join(attributes, _contexts(graph, "layout").project("ctx")).optional(_derivations(graph)), "model-attributes")
    contexts = semi_join(semi_join(_contexts(graph, "layout"), newest.project("layout")), attributes.project("ctx"))
    contexts = _written(contexts, "model-contexts")
    about_model = [
        ("?model", "a", "ModelEntry"),
        ("?model", "fromAlgorithm", "?algo"),
        ("?model", "forTask", "?task"),
        ("?model", "forLayout", "?layout"),
    ]
    about_layout = [("?layout", "a", "LearningTaskLayout"), ("?layout", "hasTarget", "?target"), ("?layout", "hasFeature", "?feature")]
    models = semi_join(newest, contexts.project("layout"))
    return construct_all((models, about_model), (contexts, about_layout), (semi_join(attributes, contexts.project("ctx")), _ATTRIBUTES))


def compatible_nodes(graph: TripleGraph, algorithm: str, classes: Sequence[str]) -> DataFrame:
    """The edge nodes that implement the algorithm and acquire every class that it does not acquire itself."""
    given = {r["c"] for r in bgp(graph, (algorithm, "acquires", "?c")).df.collect()}  # an algorithm's own classes are few
    able = bgp(graph, ("?node", "a", "EdgeNode"), ("?node", "implements", algorithm)).df
    rest = [c for c in classes if c not in given]
    if not rest:
        return able
    return able.join(division(bgp(graph, ("?node", "acquires", "?c")).df, "node", "c", rest), "node", "left_semi")


def node_positions(graph: TripleGraph, kind: str) -> DataFrame:
    """node, x and y of the nodes of a kind; nodes whose position is no number are left out."""
    at = bgp(graph, ("?node", "a", kind), ("?node", "locatedAt", "?place"), ("?place", "x", "?x"), ("?place", "y", "?y")).df
    return at.select("node", F.col("x").try_cast("double").alias("x"), F.col("y").try_cast("double").alias("y")).dropna()


def category_counts(graph: TripleGraph, node: str) -> Solutions:
    """category and n: the distinct items of each category that a node has acquired."""
    found = bgp(graph, (node, "acquired", "?r"), ("?r", "a", "CategorizedItem"), ("?r", "represents", "?item"), ("?r", "category", "?category"))
    return found.group(["category"], n=F.countDistinct("item"))


def predictions(graph: TripleGraph) -> Solutions:
    """item, predicted and prob of the records with a probability; labels have none."""
    found = bgp(graph, ("?r", "a", "CategorizedItem"), ("?r", "represents", "?item"), ("?r", "category", "?predicted"), ("?r", "predictProb", "?p"))
    return Solutions(found.df.select("item", "predicted", F.col("p").try_cast("double").alias("prob")))


def latest_models(graph: TripleGraph) -> DataFrame:
    """layout, model and at of each layout's newest model; equally new ones all stay."""
    found = bgp(graph, ("?model", "a", "ModelEntry"), ("?model", "forLayout", "?layout"), ("?model", "acquiredAt", "?at")).df
    models = table(found.select("layout", "model", "at"), "models")
    return models.join(small(models.groupBy("layout").agg(F.max("at").alias("at"))), ["layout", "at"], "left_semi")
