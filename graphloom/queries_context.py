"""Registered queries on derivation graphs, rounds on streams, optional blocks and updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators.derivation import DerivationGraph
from graphloom.operators.derive import Attribute, Binding, ContextClass, Derivation, Schema, union_all
from graphloom.operators.infer import Axioms
from graphloom.operators.maintain import Maintained, rules_of
from graphloom.operators.update import GraphStore
from graphloom.plans import catalogue, rounds
from graphloom.plans.pattern import TripleGraph
from graphloom.plans.storage import new_path, table
from graphloom.registry import query, t
from graphloom.sources.mapping import KEYS
from graphloom.streaming import context, gather

# ---- derivation graphs


def _from(domain: str, attribute: str, expression: str | None = None, label: str | None = None) -> Derivation:
    return Derivation([Binding(attribute, domain, label)], expression)


#: Slots are derived from a record's time wherever a class has a time.
SLOTS = {
    "hourSlot": Derivation([Binding("acquiredAt")], "TIMESLOT('HOUR', ?acquiredAt)"),
    "daySlot": Derivation([Binding("hourSlot")], "TIMESLOT('DAY', ?hourSlot)"),
}
VISITS = Schema(
    [
        ContextClass(
            "VisitKey",
            [
                Attribute("hourSlot", "timestamp", key=True, derived=_from("Click", "hourSlot")),
                Attribute("locatedAt", "bigint", key=True, derived=_from("Click", "locatedAt")),
            ],
        ),
        ContextClass(
            "VisitAggregate",
            [
                Attribute("demand", "bigint", derived=_from("Click", "acquiredAt", "COUNT(?acquiredAt)")),
                Attribute("avgViewed", "double", derived=_from("View", "value", "AVG(?v)", "v")),
                Attribute("avgPaid", "double", derived=_from("Purchase", "value", "AVG(?paid)", "paid")),
                Attribute("maxPaid", "double", derived=_from("Purchase", "value", "MAX(?value)")),
            ],
            parents=["VisitKey"],
        ),
        ContextClass(
            "DailyAggregate",
            [
                Attribute("daySlot", "timestamp", key=True, derived=_from("VisitAggregate", "daySlot")),
                Attribute("hours", "bigint", derived=_from("VisitAggregate", "hourSlot", "COUNT(?hourSlot)")),
                Attribute("demand", "bigint", derived=_from("VisitAggregate", "demand", "SUM(?demand)")),
                Attribute("avgViewed", "double", derived=_from("VisitAggregate", "avgViewed", "AVG(?avgViewed)")),
                Attribute("ordered", "double", derived=_from("Order", "value", "SUM(?value)")),
            ],
        ),
    ]
)


def visit_graph(spark, sf_dir) -> DerivationGraph:
    """Events by kind as classes of their own, and orders on days of the same calendar."""
    events = t(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("acquiredAt"), F.col("user_id").alias("locatedAt"), "value")
    kinds = {c: events.where(F.col("event_type") == k).drop("event_type") for c, k in (("Click", "click"), ("View", "view"), ("Purchase", "purchase"))}
    orders = t(spark, sf_dir, "orders")
    at = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("o_orderkey"), F.lit(40)) * 86400)  # days from 2024-01-01 on
    kinds["Order"] = orders.select(at.alias("hourSlot"), F.col("o_totalprice").alias("value"))
    return DerivationGraph(VISITS, kinds, SLOTS)


@query(
    "derived_several_classes",
    """
    WITH e AS (SELECT date_trunc('hour', ts) AS h, user_id, event_type, value FROM events),
    c AS (SELECT h, user_id, count(*) AS demand FROM e WHERE event_type = 'click' GROUP BY h, user_id),
    v AS (SELECT h, user_id, avg(value) AS v FROM e WHERE event_type = 'view' GROUP BY h, user_id),
    p AS (SELECT h, user_id, avg(value) AS p, max(value) AS m FROM e WHERE event_type = 'purchase' GROUP BY h, user_id)
    SELECT strftime(c.h, '%Y-%m-%d %H') AS hour, c.user_id, demand::BIGINT AS demand, round(v, 6) AS viewed, round(p, 6) AS paid, m AS max_paid
    FROM c LEFT JOIN v USING (h, user_id) LEFT JOIN p USING (h, user_id)
    """,
)
def derived_several_classes(spark, sf_dir):
    out = visit_graph(spark, sf_dir).derive("VisitAggregate")
    return out.select(
        F.date_format("hourSlot", "yyyy-MM-dd HH").alias("hour"),
        F.col("locatedAt").alias("user_id"),
        "demand",
        F.round("avgViewed", 6).alias("viewed"),
        F.round("avgPaid", 6).alias("paid"),
        F.col("maxPaid").alias("max_paid"),
    )


@query(
    "derived_from_derived",
    """
    WITH e AS (SELECT date_trunc('hour', ts) AS h, user_id, event_type, value FROM events),
    c AS (SELECT h, user_id, count(*) AS demand FROM e WHERE event_type = 'click' GROUP BY h, user_id),
    v AS (SELECT h, user_id, sum(value) AS s, count(value) AS n FROM e WHERE event_type = 'view' GROUP BY h, user_id),
    d AS (SELECT date_trunc('day', h) AS day, count(*) AS hours, sum(demand) AS demand, sum(s) / sum(n) AS viewed FROM c LEFT JOIN v USING (h, user_id) GROUP BY 1),
    o AS (SELECT TIMESTAMP '2024-01-01' + (o_orderkey % 40) * INTERVAL 1 DAY AS day, sum(o_totalprice) AS ordered FROM orders GROUP BY 1)
    SELECT strftime(d.day, '%Y-%m-%d') AS day, hours::BIGINT AS hours, demand::BIGINT AS demand, round(viewed, 6) AS viewed, round(ordered, 2) AS ordered
    FROM d LEFT JOIN o USING (day)
    """,
)
def derived_from_derived(spark, sf_dir):
    """Days over hours over events: sums of counts, and the average of all views of the hours with a click."""
    out = visit_graph(spark, sf_dir).derive("DailyAggregate")
    return out.select(
        F.date_format("daySlot", "yyyy-MM-dd").alias("day"), "hours", "demand", F.round("avgViewed", 6).alias("viewed"), F.round("ordered", 2).alias("ordered")
    )


@query(
    "derivation_domains",
    """
    WITH RECURSIVE b AS (
      SELECT 'class/' || n_regionkey AS cls, 'nation/' || n_nationkey AS dep FROM nation
      UNION SELECT 'nation/' || c_nationkey, 'segment/' || c_mktsegment FROM customer
    ), r AS (
      SELECT cls, dep FROM b UNION SELECT r.cls, b.dep FROM r JOIN b ON r.dep = b.cls
    ) SELECT cls, dep FROM r
    """,
)
def derivation_domains(spark, sf_dir):
    """All classes that a derived class rests on, from bindings held in tables."""
    from graphloom.operators.closure import path_closure

    nations = t(spark, sf_dir, "nation").select(F.concat(F.lit("class/"), "n_regionkey").alias("s"), F.concat(F.lit("nation/"), "n_nationkey").alias("o"))
    segments = t(spark, sf_dir, "customer").select(F.concat(F.lit("nation/"), "c_nationkey").alias("s"), F.concat(F.lit("segment/"), "c_mktsegment").alias("o"))
    return path_closure(nations.unionByName(segments).distinct()).select(F.col("s").alias("cls"), F.col("o").alias("dep"))


# ---- task dependencies and models: optional blocks over a schema graph


#: The triples that the tables give: subject, predicate, object and the condition, per table.
SCHEMA_TRIPLES = {
    "nation": [
        ("'task/' || n_nationkey", "a", "'LearningTaskLayout'", "true"),
        ("'task/' || n_nationkey", "requiresParadigm", "'paradigm/' || (n_nationkey % 3)", "n_nationkey % 2 = 1"),
        ("'task/' || n_nationkey", "hasFeature", "'ctx/' || (n_nationkey % 20)", "n_nationkey % 6 <> 5"),
        ("'task/' || n_nationkey", "hasTarget", "'ctx/' || ((n_nationkey * 7 + 3) % 20)", "true"),
    ],
    "supplier": [
        ("'algo/' || s_suppkey", "a", "'MlAlgorithm'", "true"),
        ("'algo/' || s_suppkey", "inParadigm", "'paradigm/' || (s_suppkey % 3)", "true"),
        ("'algo/' || s_suppkey", "acquires", "'ctx/' || (s_nationkey % 20)", "true"),
        ("'algo/' || s_suppkey", "acquires", "'ctx/' || ((s_nationkey + 1) % 20)", "true"),
    ],
    "customer": [
        ("'edge/' || c_custkey", "a", "'EdgeNode'", "c_custkey % 9 <> 0"),
        ("'edge/' || c_custkey", "implements", "'algo/' || (c_custkey % 7)", "true"),
        ("'edge/' || c_custkey", "acquires", "'ctx/' || (c_nationkey % 20)", "true"),
        ("'edge/' || c_custkey", "acquires", "'ctx/' || (c_custkey % 5)", "true"),
        ("'edge/' || c_custkey", "acquires", "'ctx/' || (c_custkey % 3)", "true"),
    ],
    "part": [
        ("'ctx/' || (p_partkey % 20)", "a", "'Class'", "p_partkey % 20 <> 13"),
        ("'ctx/' || (p_partkey % 20)", "visibility", "'Public'", "p_partkey % 20 < 9"),
        ("'ctx/' || (p_partkey % 20)", "subClassOf", "'att/' || p_partkey", "true"),
        ("'ctx/' || (p_partkey % 20)", "hasAttribute", "'att/' || p_partkey", "true"),
        ("'att/' || p_partkey", "a", "'WithAttribute'", "p_partkey % 11 <> 0"),
        ("'att/' || p_partkey", "onProperty", "'prop/' || p_size", "true"),
        ("'att/' || p_partkey", "onRange", "p_type", "p_partkey % 4 <> 0"),
        ("'att/' || p_partkey", "isKey", "'true'", "p_partkey % 3 = 0"),
        ("'att/' || p_partkey", "derived", "'der/' || p_partkey", "p_partkey % 2 = 0"),
        ("'der/' || p_partkey", "fromAttribute", "'dva/' || p_partkey", "true"),
        ("'der/' || p_partkey", "fromExpression", "'AVG(?' || p_brand || ')'", "p_partkey % 5 = 0"),
        ("'dva/' || p_partkey", "onDomain", "'ctx/' || ((p_partkey * 3) % 20)", "p_partkey % 7 <> 0"),
        ("'dva/' || p_partkey", "onProperty", "'prop/' || p_size", "true"),
        ("'dva/' || p_partkey", "label", "p_brand", "p_partkey % 9 = 0"),
        ("'prop/' || p_size", "derived", "'pd/' || p_size", "p_size % 2 = 0"),
        ("'pd/' || p_size", "fromExpression", "'TIMESLOT(HOUR)'", "p_size % 3 <> 0"),
        ("'pd/' || p_size", "fromAttribute", "'pda/' || p_size", "true"),
        ("'pda/' || p_size", "onProperty", "'prop/' || (p_size + 100)", "true"),
        ("'pda/' || p_size", "label", "'l' || p_size", "p_size % 4 = 0"),
    ],
    "orders": [
        ("'model/' || o_orderkey", "a", "'ModelEntry'", "true"),
        ("'model/' || o_orderkey", "forLayout", "'task/' || (o_custkey % 25)", "true"),
        ("'model/' || o_orderkey", "forTask", "'run/' || o_custkey", "true"),
        ("'model/' || o_orderkey", "fromAlgorithm", "'algo/' || (o_orderkey % 7)", "o_orderkey % 10 <> 0"),
        ("'model/' || o_orderkey", "acquiredAt", "{date}(o_orderdate, '{format}')", "true"),
    ],
}


def schema_graph(spark, sf_dir) -> TripleGraph:
    """The triples of SCHEMA_TRIPLES, written once, in order of predicate: patterns scan them many times, each for one predicate.

    What a row says of a subject named by the row's own key is shuffled as one row, by the subject; the rest is made distinct before its shuffle.
    No two subject expressions give one subject.
    """
    parts = []
    for name, rules in SCHEMA_TRIPLES.items():
        for subject in dict.fromkeys(s for s, *_ in rules):
            said = [
                F.struct(F.lit(p).alias("p"), F.expr(o.format(date="date_format", format="yyyy-MM-dd HH:mm:ss")).alias("o"), F.expr(c).alias("holds"))
                for s, p, o, c in rules
                if s == subject
            ]
            rows = t(spark, sf_dir, name).select(F.expr(subject).alias("s"), F.array(*said).alias("said"))
            dealt = rows.repartition("s") if subject.endswith(f"|| {KEYS[name]}") else rows
            parts.append(dealt.select("s", F.explode("said").alias("r")).where("r.holds").select("s", "r.p", "r.o").distinct())
    return TripleGraph(table(union_all(parts).sortWithinPartitions("p"), "schema-graph"))


def _triples_sql() -> str:
    selects = [
        f"SELECT {s} AS s, '{p}' AS p, {o.format(date='strftime', format='%Y-%m-%d %H:%M:%S')} AS o FROM {name} WHERE {c}"
        for name, rules in SCHEMA_TRIPLES.items()
        for s, p, o, c in rules
    ]
    return " UNION ".join(selects)


#: An attribute's derivations, left-joined block by block.
_DERIVED_SQL = """
d0 AS (
  SELECT a.s AS att, a.o AS derivation, b.o AS dvattr, c.o AS dvdomain, e.o AS dvprop, l.o AS dvlabel, x.o AS dvexpr
  FROM g a JOIN g b ON b.s = a.o AND b.p = 'fromAttribute' JOIN g c ON c.s = b.o AND c.p = 'onDomain' JOIN g e ON e.s = b.o AND e.p = 'onProperty'
  LEFT JOIN g l ON l.s = b.o AND l.p = 'label' LEFT JOIN g x ON x.s = a.o AND x.p = 'fromExpression' WHERE a.p = 'derived'
), pd AS (
  SELECT a.s AS dvprop, a.o AS pderivation, x.o AS pexpr, b.o AS pattr, e.o AS pprop, l.o AS plabel
  FROM g a JOIN g x ON x.s = a.o AND x.p = 'fromExpression' JOIN g b ON b.s = a.o AND b.p = 'fromAttribute' JOIN g e ON e.s = b.o AND e.p = 'onProperty'
  LEFT JOIN g l ON l.s = b.o AND l.p = 'label' WHERE a.p = 'derived'
), dv AS (
  SELECT d0.*, pderivation, pexpr, pattr, pprop, plabel FROM d0 LEFT JOIN pd USING (dvprop)
)"""
_ATTRIBUTES_SQL = """
  SELECT ctx AS s, 'hasAttribute' AS p, att AS o FROM f UNION SELECT att, 'onProperty', prop FROM f UNION SELECT att, 'isKey', key FROM f UNION SELECT att, 'onRange', range FROM f
  UNION SELECT att, 'derived', derivation FROM f UNION SELECT derivation, 'fromAttribute', dvattr FROM f UNION SELECT derivation, 'fromExpression', dvexpr FROM f
  UNION SELECT dvattr, 'onDomain', dvdomain FROM f UNION SELECT dvattr, 'onProperty', dvprop FROM f UNION SELECT dvattr, 'label', dvlabel FROM f
  UNION SELECT dvprop, 'a', CASE WHEN pderivation IS NOT NULL THEN 'DerivedProperty' END FROM f UNION SELECT dvprop, 'derived', pderivation FROM f
  UNION SELECT pderivation, 'fromExpression', pexpr FROM f UNION SELECT pderivation, 'fromAttribute', pattr FROM f
  UNION SELECT pattr, 'onProperty', pprop FROM f UNION SELECT pattr, 'label', plabel FROM f"""
_CONTEXTS_SQL = "SELECT s AS task, o AS feature, NULL AS target, o AS ctx FROM g WHERE p = 'hasFeature' UNION ALL SELECT s, NULL, o, o FROM g WHERE p = 'hasTarget'"


@query(
    "task_dependencies",
    f"""
    WITH g AS ({_triples_sql()}), c AS ({_CONTEXTS_SQL}), {_DERIVED_SQL}, f AS (
      SELECT t.s AS task, coalesce(q.o, 'SupervisedLearning') AS paradigm, feature, target, ctx, v.o AS vis, att.o AS att, pr.o AS prop, ra.o AS range, k.o AS key,
             derivation, dvattr, dvdomain, dvprop, dvlabel, dvexpr, pderivation, pexpr, pattr, pprop, plabel
      FROM g t LEFT JOIN g q ON q.s = t.s AND q.p = 'requiresParadigm' JOIN c ON c.task = t.s
      JOIN g cl ON cl.s = ctx AND cl.p = 'a' AND cl.o = 'Class' LEFT JOIN g v ON v.s = ctx AND v.p = 'visibility'
      JOIN g att ON att.s = ctx AND att.p = 'subClassOf' JOIN g wa ON wa.s = att.o AND wa.p = 'a' AND wa.o = 'WithAttribute'
      JOIN g pr ON pr.s = att.o AND pr.p = 'onProperty' LEFT JOIN g ra ON ra.s = att.o AND ra.p = 'onRange' LEFT JOIN g k ON k.s = att.o AND k.p = 'isKey'
      LEFT JOIN dv ON dv.att = att.o WHERE t.p = 'a' AND t.o = 'LearningTaskLayout'
    ), al AS (
      SELECT i.s AS algo, i.o AS paradigm, ac.o AS mlctx FROM g i JOIN g y ON y.s = i.s AND y.p = 'a' AND y.o = 'MlAlgorithm'
      LEFT JOIN g ac ON ac.s = i.s AND ac.p = 'acquires' WHERE i.p = 'inParadigm' AND i.s = 'algo/2' AND i.o IN (SELECT paradigm FROM f)
    )
    SELECT * FROM (
      SELECT task AS s, 'a' AS p, 'LearningTaskLayout' AS o FROM f UNION SELECT task, 'hasFeature', feature FROM f UNION SELECT task, 'hasTarget', target FROM f
      UNION SELECT task, 'requiresParadigm', paradigm FROM f UNION SELECT task, 'dependsOn', dvdomain FROM f UNION SELECT algo, 'a', 'MlAlgorithm' FROM al
      UNION SELECT algo, 'acquires', mlctx FROM al UNION SELECT ctx, 'a', 'ContextClass' FROM f UNION SELECT ctx, 'visibility', vis FROM f
      UNION {_ATTRIBUTES_SQL}
    ) WHERE s IS NOT NULL AND o IS NOT NULL
    """,
)
def task_dependencies(spark, sf_dir):
    return catalogue.task_dependencies(schema_graph(spark, sf_dir), "algo/2")


@query(
    "model_entries",
    f"""
    WITH g AS ({_triples_sql()}), c AS ({_CONTEXTS_SQL}), {_DERIVED_SQL}, m AS (
      SELECT l.s AS model, l.o AS layout, a.o AS stamp, max(a.o) OVER (PARTITION BY l.o) AS newest
      FROM g y JOIN g l ON l.s = y.s AND l.p = 'forLayout' JOIN g a ON a.s = y.s AND a.p = 'acquiredAt' WHERE y.p = 'a' AND y.o = 'ModelEntry'
    ), f AS (
      SELECT model, layout, al.o AS algo, ta.o AS task, feature, target, ctx, att.o AS att, pr.o AS prop, ra.o AS range, k.o AS key,
             derivation, dvattr, dvdomain, dvprop, dvlabel, dvexpr, pderivation, pexpr, pattr, pprop, plabel
      FROM m JOIN g al ON al.s = model AND al.p = 'fromAlgorithm' JOIN g ta ON ta.s = model AND ta.p = 'forTask' JOIN c ON c.task = layout
      JOIN g att ON att.s = ctx AND att.p = 'hasAttribute' JOIN g pr ON pr.s = att.o AND pr.p = 'onProperty'
      JOIN g ra ON ra.s = att.o AND ra.p = 'onRange' JOIN g k ON k.s = att.o AND k.p = 'isKey' LEFT JOIN dv ON dv.att = att.o WHERE stamp = newest
    )
    SELECT * FROM (
      SELECT model AS s, 'a' AS p, 'ModelEntry' AS o FROM f UNION SELECT model, 'fromAlgorithm', algo FROM f UNION SELECT model, 'forTask', task FROM f
      UNION SELECT model, 'forLayout', layout FROM f UNION SELECT layout, 'a', 'LearningTaskLayout' FROM f
      UNION SELECT layout, 'hasTarget', target FROM f UNION SELECT layout, 'hasFeature', feature FROM f UNION {_ATTRIBUTES_SQL}
    ) WHERE s IS NOT NULL AND o IS NOT NULL
    """,
)
def model_entries(spark, sf_dir):
    return catalogue.model_entries(schema_graph(spark, sf_dir))


CLASSES = ["ctx/1", "ctx/2"]


@query(
    "fetch_schemas",
    f"""
    WITH g AS ({_triples_sql()})
    SELECT a.s AS cls, pr.o AS property, ra.o AS range, coalesce(k.o = 'true', false) AS is_key, NULL::VARCHAR AS unit, coalesce(v.o, 'Private') AS visibility
    FROM g a JOIN g wa ON wa.s = a.o AND wa.p = 'a' AND wa.o = 'WithAttribute' JOIN g pr ON pr.s = a.o AND pr.p = 'onProperty' JOIN g ra ON ra.s = a.o AND ra.p = 'onRange'
    LEFT JOIN g k ON k.s = a.o AND k.p = 'isKey' LEFT JOIN g v ON v.s = a.s AND v.p = 'visibility' WHERE a.p = 'subClassOf' AND a.s IN ('ctx/1', 'ctx/2')
    """,
)
def fetch_schemas(spark, sf_dir):
    """The schemas of two classes and of what they depend on, from the whole graph."""
    return catalogue.fetch_schemas(schema_graph(spark, sf_dir), CLASSES)


@query(
    "compatible_clients",
    f"""
    WITH g AS ({_triples_sql()}), need AS (SELECT unnest(['ctx/1', 'ctx/2', 'ctx/4']) AS c EXCEPT SELECT o FROM g WHERE s = 'algo/2' AND p = 'acquires')
    SELECT n.s AS node FROM g n JOIN g i ON i.s = n.s AND i.p = 'implements' AND i.o = 'algo/2' WHERE n.p = 'a' AND n.o = 'EdgeNode'
    AND NOT EXISTS (SELECT 1 FROM need WHERE c NOT IN (SELECT o FROM g q WHERE q.s = n.s AND q.p = 'acquires'))
    """,
)
def compatible_clients(spark, sf_dir):
    """The edge nodes that can take part in a task: they have the algorithm and every class that it does not bring."""
    return catalogue.compatible_nodes(schema_graph(spark, sf_dir), "algo/2", ["ctx/1", "ctx/2", "ctx/4"])


# ---- steps of a learning round


@query(
    "predictions_export",
    "SELECT 'item/' || event_id AS item, 'class/' || event_type AS predicted, value AS prob FROM events WHERE event_id % 4 <> 0",
)
def predictions_export(spark, sf_dir):
    """Records with a probability are predictions; those without are labels."""
    rec = F.concat(F.lit("rec/"), "event_id")
    said = [
        (F.lit("a"), F.lit("CategorizedItem")),
        (F.lit("represents"), F.concat(F.lit("item/"), "event_id")),
        (F.lit("category"), F.concat(F.lit("class/"), "event_type")),
        (F.lit("predictProb"), F.when(F.col("event_id") % 4 != 0, F.col("value").cast("string"))),
    ]
    rows = t(spark, sf_dir, "events").select(F.explode(F.array(*[F.struct(rec.alias("s"), p.alias("p"), o.alias("o")) for p, o in said])).alias("r")).select("r.*")
    return catalogue.predictions(TripleGraph(rows.where("o is not null"))).df


@query(
    "round_clients",
    """
    WITH c AS (SELECT c_nationkey, c_custkey, c_acctbal, count(*) OVER (PARTITION BY c_nationkey) AS n, CASE WHEN c_acctbal > 0
               THEN -ln((('0x' || substr(md5('42:' || c_custkey), 1, 8))::BIGINT + 0.5) / 4294967296.0) / c_acctbal END AS draw FROM customer)
    SELECT c_custkey AS node FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY draw NULLS LAST, c_custkey) AS r FROM c)
    WHERE draw IS NOT NULL AND r <= greatest(floor(n * 0.3), 2)
    """,
)
def round_clients(spark, sf_dir):
    """Each aggregator's clients for a round, drawn by the size of their data."""
    customers = t(spark, sf_dir, "customer")
    clients = customers.select(F.col("c_nationkey").alias("aggregator"), F.col("c_custkey").alias("node"))
    sizes = customers.select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("value"))
    return rounds.FedAvg(client_fraction=0.3, min_clients_per_aggregator=2).select_train(clients, sizes)


def _aggregations(spark, sf_dir):
    """Each nation aggregates its customers, in one of three rounds."""
    customers = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("node"), (F.col("c_custkey") % 3).alias("round"), F.col("c_custkey").alias("c"))
    return customers.groupBy("node", "round").agg(F.collect_list("c").alias("on_node")).withColumn("task", F.lit("t"))


@query(
    "round_workload",
    "SELECT c_nationkey AS node, sum(o_orderkey % 1000)::BIGINT AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 3 = 1 GROUP BY c_nationkey",
)
def round_workload(spark, sf_dir):
    """The bytes that each aggregator takes in in a round, from the updates of those it aggregates."""
    sent = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    columns = [F.col("c_nationkey").alias("node"), F.lit("t").alias("task"), (F.col("c_custkey") % 3).alias("round"), F.col("c_custkey").alias("from_node")]
    return rounds.workload(_aggregations(spark, sf_dir), sent.select(*columns, (F.col("o_orderkey") % 1000).alias("total_size")), "t", 1)


@query(
    "model_sizes",
    """
    WITH own AS (SELECT o_custkey AS c, count(*) AS value FROM orders GROUP BY o_custkey)
    SELECT c_nationkey::BIGINT AS node, sum(value)::BIGINT AS size FROM customer JOIN own ON c = c_custkey GROUP BY c_nationkey
    """,
)
def model_sizes(spark, sf_dir):
    """An aggregator's weight: the data of all it has aggregated."""
    aggregator = (-F.col("node") - 1).alias("node")  # below zero, so that no customer has its number
    sizes = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.count(F.lit(1)).alias("value"))
    nodes = t(spark, sf_dir, "customer").join(sizes, F.col("c_custkey") == F.col("node")).select(F.col("c_nationkey").cast("long").alias("node")).distinct()
    aggregations = _aggregations(spark, sf_dir).select(aggregator, "on_node")
    return rounds.model_sizes(nodes.select(aggregator), sizes, aggregations).select(aggregator.cast("long").alias("node"), "size")


@query(
    "assign_clients",
    """
    SELECT s_suppkey AS aggregator, c_custkey AS client FROM (
      SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY (c_acctbal - s_acctbal) ** 2 + (c_nationkey - s_nationkey) ** 2, s_suppkey) AS r FROM customer, supplier
    ) WHERE r = 1
    """,
)
def assign_clients(spark, sf_dir):
    """Each client with its nearest aggregator."""
    fogs = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    clients = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return rounds.FedAvg().map_nodes(fogs, clients)


# ---- rounds on streams

#: A round is a user's day: the first three events until 18:00.
ROUND_SECONDS, ROUND_ANSWERS = 64_800, 3


def _rounds(spark, sf_dir, running: bool):
    events = t(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    until = F.lit("2100-01-01 00:00:00").cast("timestamp")  # after all events: every round comes to its end
    source = gather.replay(events, "ts", 4, "rounds-source", until)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "4").parquet(source).withColumn("day", F.to_date("ts"))
    out = gather.gather(stream, ["user_id", "day"], ROUND_ANSWERS, ROUND_SECONDS, F.col("day"), "ts", "event_id", "10 days", running)
    path = new_path(spark, "rounds-sink")
    gather.sink(out, path, new_path(spark, "rounds-state")).awaitTermination()
    return gather.read_sink(spark, path, out.schema)


@query(
    "rounds_first_answers",
    """
    WITH a AS (SELECT user_id, ts::DATE AS day, event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id::VARCHAR) AS r
               FROM events WHERE ts <= ts::DATE + INTERVAL 18 HOUR)
    SELECT user_id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN count(*) = 3 THEN 'Complete' ELSE 'TimedOut' END AS status, count(*)::BIGINT AS n,
           string_agg(event_id::VARCHAR, ',' ORDER BY r) AS answers FROM a WHERE r <= 3 GROUP BY user_id, day
    """,
)
def rounds_first_answers(spark, sf_dir):
    """Of each user and day the first three events, or those until the deadline, from a stateful stream."""
    out = _rounds(spark, sf_dir, running=False)
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "status", F.size("answers").cast("long").alias("n"), F.concat_ws(",", "answers.id").alias("answers"))


@query(
    "round_status_log",
    """
    WITH n AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events WHERE ts <= ts::DATE + INTERVAL 18 HOUR GROUP BY user_id, day),
    s AS (SELECT day, unnest(['Running', CASE WHEN n >= 3 THEN 'Complete' ELSE 'TimedOut' END]) AS status FROM n)
    SELECT strftime(day, '%Y-%m-%d') AS day, status, count(*)::BIGINT AS n FROM s GROUP BY day, status
    """,
)
def round_status_log(spark, sf_dir):
    """How many rounds of each day were begun, completed, and ended by their deadline."""
    return _rounds(spark, sf_dir, running=True).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "status").agg(F.count(F.lit(1)).alias("n"))


# ---- entailments under updates


@query(
    "maintained_updates",
    """
    WITH o AS (SELECT 'order/' || o_orderkey AS o, 'cust/' || o_custkey AS c FROM orders WHERE (o_orderkey % 10 < 8 AND o_orderkey % 7 <> 3) OR o_orderkey % 10 >= 8),
    c AS (SELECT 'cust/' || c_custkey AS c, CASE WHEN c_custkey % 20 = 1 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS n FROM customer),
    n AS (SELECT n_nationkey AS n, 'nation/' || n_nationkey AS nation, 'region/' || n_regionkey AS region FROM nation)
    SELECT o AS s, 'placedBy' AS p, c AS o FROM o UNION SELECT c, 'placed', o FROM o UNION SELECT o, 'placedIn', nation FROM o JOIN c USING (c) JOIN n USING (n)
    UNION SELECT c, unnest(['livesIn', 'partOf']), nation FROM c JOIN n USING (n) UNION SELECT c, 'partOf', region FROM c JOIN n USING (n) UNION SELECT nation, 'partOf', region FROM n
    """,
)
def maintained_updates(spark, sf_dir):
    """A graph and what it entails, after orders and then homes have changed, from what changed alone."""
    axioms = Axioms(inverse=[("placedBy", "placed")], sub_property=[("livesIn", "partOf")], transitive=["partOf"], chains={"placedIn": ["placedBy", "livesIn"]})
    graph = Maintained(GraphStore(spark, new_path(spark, "maintained")), rules_of(axioms, types=False))

    def said(df, s, p, o):
        return df.select(F.concat(F.lit(s[0]), s[1]).alias("s"), F.lit(p).alias("p"), F.concat(F.lit(o[0]), o[1]).alias("o"))

    orders, customers, nations = (t(spark, sf_dir, name) for name in ("orders", "customer", "nation"))
    placed = said(orders, ("order/", "o_orderkey"), "placedBy", ("cust/", "o_custkey"))
    key = F.substring_index("s", "/", -1).cast("bigint")
    homes = said(customers, ("cust/", "c_custkey"), "livesIn", ("nation/", "c_nationkey"))
    graph.update(None, placed.where(key % 10 < 8).unionByName(homes).unionByName(said(nations, ("nation/", "n_nationkey"), "partOf", ("region/", "n_regionkey"))))
    graph.store.compact()
    graph.update(placed.where(key % 7 == 3), placed.where(key % 10 >= 8))
    moved = customers.where("c_custkey % 20 = 1")
    graph.update(homes.where(key % 20 == 1), said(moved.withColumn("to", (F.col("c_nationkey") + 1) % 25), ("cust/", "c_custkey"), "livesIn", ("nation/", "to")))
    return graph.triples()


# ---- relayed context


@query("relayed_view", "SELECT event_id, user_id, event_type FROM events")
def relayed_view(spark, sf_dir):
    """Events that a stream brings by two routes, the second in other batches than the first: each once."""
    events = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    routes = []
    for slices in (4, 3):
        folder = gather.replay(events, "ts", slices, "relayed-source")
        routes.append(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "4").parquet(folder))
    out = context.relayed_view(routes, ["event_id", "user_id", "event_type"], "ts", "15 days")
    path = new_path(spark, "relayed-sink")
    gather.sink(out, path, new_path(spark, "relayed-state")).awaitTermination()
    return gather.read_sink(spark, path, out.schema).select("event_id", "user_id", "event_type")
