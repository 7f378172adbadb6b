"""The registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import queries_context  # noqa: F401  registers its queries
from graphloom.functions import scalar
from graphloom.functions.terms import PrefixMap, compact_space, file_stem, fragment, local_name
from graphloom.operators import derive, infer, joins, sampling, update, vectors
from graphloom.operators.closure import path_closure
from graphloom.operators.records import Field, RecordSpec, decode, lookup
from graphloom.operators.telemetry import accuracy_by, bin_mean
from graphloom.plans.pattern import bgp, path, semi_join, values
from graphloom.plans.rounds import in_time, node_counts
from graphloom.plans.storage import new_path, small
from graphloom.registry import ORACLES, QUERIES, query, t
from graphloom.sources.mapping import mapped_graph
from graphloom.streaming import context

PREFIXES = PrefixMap(
    {"en": "http://m.ththth.example.net/en/", "net": "http://m.ththth.example.net/", "s": "https://", "h": "http://"}
)
EVENT_TYPES = ("click", "view", "purchase", "login", "logout")


# ---- patterns and joins


@query("flagship_category_counts", "SELECT event_type, count(DISTINCT user_id)::BIGINT AS n_users FROM events GROUP BY event_type")
def flagship_category_counts(spark, sf_dir):
    g = mapped_graph(spark, sf_dir, "events")
    found = bgp(g, ("?e", "a", "events"), ("?e", "events.event_type", "?event_type"), ("?e", "events.user_id", "?user"))
    return found.group(["event_type"], n_users=F.countDistinct("user")).df


@query("bgp_star_orders", "SELECT o_orderkey AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def bgp_star_orders(spark, sf_dir):
    g = mapped_graph(spark, sf_dir, "orders")
    found = bgp(g, ("?o", "orders.o_orderkey", "?key"), ("?o", "orders.o_orderstatus", "?status"), ("?o", "orders.o_orderpriority", "?priority"))
    return found.project("key", "status", "priority").df


@query(
    "bgp_chain_nation",
    "SELECT n_name AS nation, count(DISTINCT o_orderkey)::BIGINT AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
)
def bgp_chain_nation(spark, sf_dir):
    g = mapped_graph(spark, sf_dir, "orders", "customer", "nation")
    found = bgp(g, ("?o", "orders.o_custkey", "?c"), ("?c", "customer.c_nationkey", "?n"), ("?n", "nation.n_name", "?nation"))
    return found.group(["nation"], n_orders=F.countDistinct("o")).df


@query(
    "multi_star_join",
    "SELECT s_name AS supplier, o_orderpriority AS priority, round(sum(l_quantity), 6) AS quantity FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name, o_orderpriority",
)
def multi_star_join(spark, sf_dir):
    g = mapped_graph(spark, sf_dir, "lineitem", "orders", "supplier")
    found = bgp(
        g,
        ("?l", "lineitem.l_orderkey", "?o"),
        ("?l", "lineitem.l_suppkey", "?s"),
        ("?l", "lineitem.l_quantity", "?q"),
        ("?o", "orders.o_orderpriority", "?priority"),
        ("?s", "supplier.s_name", "?supplier"),
    )
    return found.group(["supplier", "priority"], quantity=F.round(F.sum("q"), 6)).df


@query("optional_labels", "SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def optional_labels(spark, sf_dir):
    g = mapped_graph(spark, sf_dir, "documents", "labels")
    found = bgp(g, ("?doc_id", "documents.lang", "?lang")).optional(bgp(g, ("?doc_id", "labels.quality", "?quality")))
    return found.project("doc_id", "lang", "quality").df


@query(
    "optional_nested",
    "SELECT c_custkey AS c, o_orderkey AS o, count(l_orderkey)::BIGINT AS n_lines FROM customer LEFT JOIN (orders LEFT JOIN lineitem ON o_orderkey = l_orderkey) "
    "ON c_custkey = o_custkey GROUP BY c_custkey, o_orderkey",
)
def optional_nested(spark, sf_dir):
    g = mapped_graph(spark, sf_dir, "customer", "orders", "lineitem")
    inner = bgp(g, ("?o", "orders.o_custkey", "?c")).optional(bgp(g, ("?l", "lineitem.l_orderkey", "?o"), ("?l", "lineitem.l_linenumber", "?line")))
    found = bgp(g, ("?c", "customer.c_name", "?name")).optional(inner)
    return found.group(["c", "o"], n_lines=F.count("line")).df


@query("values_semi", "SELECT n_name AS name, n_regionkey AS region FROM nation WHERE n_nationkey IN (1, 3, 5, 8)")
def values_semi(spark, sf_dir):
    g = mapped_graph(spark, sf_dir, "nation")
    found = semi_join(bgp(g, ("?n", "nation.n_name", "?name"), ("?n", "nation.n_regionkey", "?region")), values(spark, "n", [1, 3, 5, 8], "int"))
    return found.project("name", "region").df


@query("not_exists_unlabelled", "SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def not_exists_unlabelled(spark, sf_dir):
    return joins.unmatched(t(spark, sf_dir, "documents").select("doc_id", "source"), t(spark, sf_dir, "labels"), ["doc_id"])


@query("training_set_join", "SELECT d.doc_id, lang, n_chars, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def training_set_join(spark, sf_dir):
    return joins.key_join(t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), t(spark, sf_dir, "labels"), ["doc_id"])


@query("exists_distinct", "SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def exists_distinct(spark, sf_dir):
    g = mapped_graph(spark, sf_dir, "customer", "orders")
    found = bgp(g, ("?c", "customer.c_mktsegment", "?segment"), ("?c", "customer.c_nationkey", "?nation"))
    return found.exists(bgp(g, ("?o", "orders.o_custkey", "?c"))).project("segment", "nation").distinct().df


@query(
    "division_all_types",
    "SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)",
)
def division_all_types(spark, sf_dir):
    events = t(spark, sf_dir, "events")
    return joins.division(events, "user_id", "event_type", events)


@query(
    "nearest_supplier",
    "SELECT c_custkey, s_suppkey, round(d, 6) AS distance2 FROM (SELECT c_custkey, s_suppkey, (c_acctbal - s_acctbal) * (c_acctbal - s_acctbal) AS d, "
    "row_number() OVER (PARTITION BY c_custkey ORDER BY (c_acctbal - s_acctbal) * (c_acctbal - s_acctbal), s_suppkey) AS r FROM customer, supplier) WHERE r = 1",
)
def nearest_supplier(spark, sf_dir):
    out = joins.nearest(t(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal"], t(spark, sf_dir, "supplier"), "s_suppkey", ["s_acctbal"])
    return out.select("c_custkey", "s_suppkey", F.round("distance2", 6).alias("distance2"))


@query("latest_per_user", "SELECT user_id, event_id, event_type FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1")
def latest_per_user(spark, sf_dir):
    return joins.latest(t(spark, sf_dir, "events"), ["user_id"], "ts").select("user_id", "event_id", "event_type")


@query(
    "closure_region",
    "WITH RECURSIVE e AS (SELECT 'nation/' || n_nationkey AS s, 'region/' || n_regionkey AS o FROM nation UNION ALL SELECT 'region/' || r_regionkey, 'world' FROM region), "
    "c AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON c.o = e.s) SELECT s, o FROM c",
)
def closure_region(spark, sf_dir):
    return path_closure(_hierarchy(spark, sf_dir))


def _hierarchy(spark, sf_dir):
    nations = t(spark, sf_dir, "nation").select(F.concat(F.lit("nation/"), "n_nationkey").alias("s"), F.concat(F.lit("region/"), "n_regionkey").alias("o"))
    regions = t(spark, sf_dir, "region").select(F.concat(F.lit("region/"), "r_regionkey").alias("s"), F.lit("world").alias("o"))
    return nations.unionByName(regions)


@query(
    "path_plus",
    "SELECT 'nation/' || n_nationkey AS s, 'region/' || n_regionkey AS o FROM nation UNION SELECT 'nation/' || n_nationkey, 'nation/' || n_nationkey FROM nation "
    "UNION SELECT DISTINCT 'region/' || n_regionkey, 'region/' || n_regionkey FROM nation",
)
def path_plus(spark, sf_dir):
    """(nation.n_regionkey)*: each nation to its region, and every node to itself."""
    return path(mapped_graph(spark, sf_dir, "nation"), "?s", ["nation.n_regionkey"], "?o", zero=True).df


@query(
    "union_bag_sum",
    "SELECT k, round(sum(v), 2) AS total FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT l_orderkey, l_extendedprice FROM lineitem) GROUP BY k",
)
def union_bag_sum(spark, sf_dir):
    g = mapped_graph(spark, sf_dir, "orders", "lineitem")
    direct = bgp(g, ("?k", "orders.o_totalprice", "?v"))
    lines = bgp(g, ("?l", "lineitem.l_orderkey", "?k"), ("?l", "lineitem.l_extendedprice", "?v")).project("k", "v")
    return direct.union(lines).group(["k"], total=F.round(F.sum("v"), 2)).df


@query(
    "having_argmin",
    "SELECT s AS supplier, round(q, 6) AS total FROM (SELECT l_suppkey AS s, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) <= 1e9) ORDER BY q, s LIMIT 1",
)
def having_argmin(spark, sf_dir):
    sums = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.sum("l_quantity").alias("q")).where(joins.bounded(F.col("q"), 1e9))
    best = sums.agg(F.min_by(F.struct("s", "q"), F.struct("q", "s")).alias("b"))
    return best.select(F.col("b.s").alias("supplier"), F.round("b.q", 6).alias("total"))


@query("weighted_mean_global", "SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem")
def weighted_mean_global(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").agg(F.round(vectors.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 6).alias("mean"))


# ---- vectors


@query(
    "fedavg_vectors",
    "SELECT label, pos::INTEGER AS pos, round(sum(v * w) / sum(w), 5) AS value FROM (SELECT label, (vec_id % 7 + 1)::DOUBLE AS w, unnest(embedding)::DOUBLE AS v, "
    "unnest(range(0, len(embedding))) AS pos FROM embeddings) GROUP BY label, pos",
)
def fedavg_vectors(spark, sf_dir):
    out = vectors.average_positions(t(spark, sf_dir, "embeddings"), ["label"], "embedding", F.col("vec_id") % 7 + 1)
    return out.select("label", "pos", F.round("value", 5).alias("value"))


@query(
    "fedavg_two_level",
    "SELECT pos::INTEGER AS pos, round(avg(v), 5) AS value FROM (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS pos FROM embeddings) GROUP BY pos",
)
def fedavg_two_level(spark, sf_dir):
    """Averages of the labels, averaged again by their sizes: the flat average."""
    df = t(spark, sf_dir, "embeddings")
    local = vectors.average_positions(df, ["label"], "embedding")
    sizes = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    out = local.join(small(sizes), "label").groupBy("pos").agg(vectors.weighted_mean(F.col("value"), F.col("n").cast("double")).alias("value"))
    return out.select("pos", F.round("value", 5).alias("value"))


@query("update_bytes", "SELECT vec_id, (len(embedding) * 4)::BIGINT AS bytes FROM embeddings")
def update_bytes(spark, sf_dir):
    model = F.create_map(F.lit("head"), F.col("embedding"))
    return t(spark, sf_dir, "embeddings").select("vec_id", scalar.weights_bytes(model).alias("bytes"))


@query("map_lengths", "SELECT vec_id, len(embedding)::INTEGER AS n FROM embeddings")
def map_lengths(spark, sf_dir):
    sizes = F.transform_values(F.create_map(F.lit("head"), F.col("embedding")), lambda k, v: F.size(v))
    return t(spark, sf_dir, "embeddings").select("vec_id", F.element_at(sizes, "head").alias("n"))


@query("softmax_argmax", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best, (list_max(embedding) IS NOT NULL) AS scored FROM embeddings")
def softmax_argmax(spark, sf_dir):
    p = t(spark, sf_dir, "embeddings").select("vec_id", "embedding", scalar.softmax(F.col("embedding")).alias("p"))
    return p.select("vec_id", scalar.argmax(F.col("embedding")).alias("best"), (F.array_max("p") > 0).alias("scored"))


# ---- accuracies, bins, derived attributes


@query(
    "confusion_accuracy",
    "SELECT sum((quality = 1 AND toxic = 0)::INT)::BIGINT AS tp, sum((quality = 0 AND toxic = 1)::INT)::BIGINT AS tn, sum((quality = 1 AND toxic = 1)::INT)::BIGINT AS fp, "
    "sum((quality = 0 AND toxic = 0)::INT)::BIGINT AS fn, round(avg((quality <> toxic)::INT), 6) AS accuracy FROM labels",
)
def confusion_accuracy(spark, sf_dir):
    def n(q, x):
        return F.count_if((F.col("quality") == q) & (F.col("toxic") == x))

    out = t(spark, sf_dir, "labels").agg(n(1, 0).alias("tp"), n(0, 1).alias("tn"), n(1, 1).alias("fp"), n(0, 0).alias("fn"))
    return out.select("*", F.round(scalar.confusion_accuracy(*[F.col(c) for c in ("tp", "tn", "fp", "fn")]), 6).alias("accuracy"))


@query("accuracy_group", "SELECT lang, round(avg((quality = 1 - toxic)::INT), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def accuracy_group(spark, sf_dir):
    both = t(spark, sf_dir, "documents").select("doc_id", "lang").join(t(spark, sf_dir, "labels"), "doc_id")
    out = accuracy_by(both.withColumn("predicted", 1 - F.col("toxic")), ["lang"], "quality")
    return out.select("lang", F.round("accuracy", 6).alias("accuracy"))


@query("batch_accuracy", "SELECT round(avg((quality = 1 - toxic)::INT), 6) AS accuracy, count(*)::BIGINT AS n FROM labels")
def batch_accuracy(spark, sf_dir):
    hit = (F.col("quality") == 1 - F.col("toxic")).cast("int")
    return t(spark, sf_dir, "labels").agg(F.round(F.avg(hit), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query("dataset_size", "SELECT quality, count(*)::BIGINT AS n FROM labels GROUP BY quality")
def dataset_size(spark, sf_dir):
    return t(spark, sf_dir, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@query("bin5_mean", "SELECT (floor(epoch_us(ts) / 1e6 / 5) * 5)::BIGINT AS bin, event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def bin5_mean(spark, sf_dir):
    events = t(spark, sf_dir, "events").withColumn("t", scalar.epoch_seconds(F.col("ts")))
    return bin_mean(events, "t", "value", 5, ["event_type"]).select(F.col("bin").cast("bigint").alias("bin"), "event_type", F.round("mean", 6).alias("mean"))


EVENT_SCHEMA = derive.Schema(
    [
        derive.ContextClass("Event", [derive.Attribute("event_id", "bigint", key=True), derive.Attribute("value", "double")], derive.PUBLIC),
        derive.ContextClass(
            "HourlyUse",
            [
                derive.Attribute("hour", "timestamp", key=True, derived=derive.Derivation([derive.Binding("ts", "events", "t")], "TIMESLOT('HOUR', ?t)")),
                derive.Attribute("event_type", key=True, derived=derive.Derivation([derive.Binding("event_type", "events")])),
                derive.Attribute("n", "bigint", derived=derive.Derivation([derive.Binding("event_id", "events", "e")], "COUNT(?e)")),
                derive.Attribute("mean", "double", derived=derive.Derivation([derive.Binding("value", "events")], "AVG(?value)")),
            ],
        ),
        derive.ContextClass(
            "EventCopy",
            [
                derive.Attribute("event", "bigint", key=True, derived=derive.Derivation([derive.Binding("event_id", "events")])),
                derive.Attribute("kind", derived=derive.Derivation([derive.Binding("event_type", "events", "k")], "?k")),
            ],
        ),
    ]
)


@query(
    "hourly_derived",
    "SELECT (epoch_us(date_trunc('hour', ts)) / 1000000)::BIGINT AS hour, event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
)
def hourly_derived(spark, sf_dir):
    out = derive.derive(EVENT_SCHEMA, "HourlyUse", {"events": t(spark, sf_dir, "events")})
    return out.select(scalar.epoch_seconds(F.col("hour")).cast("bigint").alias("hour"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("derived_copy", "SELECT event_id AS event, event_type AS kind FROM events")
def derived_copy(spark, sf_dir):
    return derive.derive(EVENT_SCHEMA, "EventCopy", {"events": t(spark, sf_dir, "events")})


@query("dependency_domains", "SELECT 'HourlyUse' AS cls, 'events' AS domain UNION ALL SELECT 'EventCopy', 'events'")
def dependency_domains(spark, sf_dir):
    pairs = [(c, d) for c in EVENT_SCHEMA.classes for d in EVENT_SCHEMA.depends_on(c)]
    return spark.createDataFrame(pairs, "cls string, domain string")


@query(
    "inherited_attributes",
    "SELECT 'nation/' || n_nationkey AS cls, 'nation.name' AS attribute FROM nation UNION SELECT 'nation/' || n_nationkey, 'region.name' FROM nation "
    "UNION SELECT 'region/' || r_regionkey, 'region.name' FROM region",
)
def inherited_attributes(spark, sf_dir):
    edges = _hierarchy(spark, sf_dir)
    own = edges.select(F.col("s").alias("cls"), F.when(F.col("s").startswith("nation/"), "nation.name").otherwise("region.name").alias("attribute"))
    return derive.inherited_rows(path_closure(edges), own)


@query(
    "seconds_since_start",
    "SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 AS t, strftime(ts + INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S') AS later FROM events",
)
def seconds_since_start(spark, sf_dir):
    later = scalar.offset_clock(F.col("ts").cast("timestamp"), F.lit(90))
    return t(spark, sf_dir, "events").select(
        "event_id", F.floor(scalar.seconds_since(F.col("ts"), "2024-01-01")).alias("t"), F.date_format(later, "yyyy-MM-dd HH:mm:ss").alias("later")
    )


# ---- order, splits, samples


@query(
    "split_ordered",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > count(*) OVER (PARTITION BY user_id) - floor(count(*) OVER (PARTITION BY user_id) * 0.2) AS is_test FROM events",
)
def split_ordered(spark, sf_dir):
    return sampling.split_ordered(t(spark, sf_dir, "events"), ["user_id"], ["event_id"], 0.2).select("event_id", "is_test")


@query(
    "split_hash",
    "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) <= floor(count(*) OVER (PARTITION BY source) * 0.2) AS is_test FROM documents",
)
def split_hash(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.split_hashed(docs, "doc_id", ["source"], 0.2).select("doc_id", "is_test")


@query(
    "weighted_sample",
    "SELECT c_custkey, round(-ln((('0x' || substr(md5('42:' || c_custkey), 1, 8))::BIGINT + 0.5) / 4294967296.0) / c_acctbal, 9) AS draw FROM customer WHERE c_acctbal > 0 "
    "ORDER BY -ln((('0x' || substr(md5('42:' || c_custkey), 1, 8))::BIGINT + 0.5) / 4294967296.0) / c_acctbal, c_custkey LIMIT greatest(floor((SELECT count(*) FROM customer) * 0.05)::BIGINT, 10)",
)
def weighted_sample(spark, sf_dir):
    out = sampling.weighted_sample(t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal", 0.05, 10)
    return out.select("c_custkey", F.round("draw", 9).alias("draw"))


@query("per_class_limit", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 100 // 4")
def per_class_limit(spark, sf_dir):
    return sampling.per_class_limit(t(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 100, 4)


@query("hash_assign_node", "SELECT doc_id, (('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 20)::BIGINT AS by_node FROM documents")
def hash_assign_node(spark, sf_dir):
    return sampling.assign_nodes(t(spark, sf_dir, "documents").select("doc_id"), "doc_id", 20)


@query("topk_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def topk_orders(spark, sf_dir):
    g = mapped_graph(spark, sf_dir, "orders")
    found = bgp(g, ("?o_orderkey", "orders.o_totalprice", "?o_totalprice"))
    return found.order(F.desc("o_totalprice"), "o_orderkey").limit(10, offset=5).df


@query("distinct_sorted", "SELECT DISTINCT event_type FROM events ORDER BY event_type")
def distinct_sorted(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type")


# ---- graphs, records, updates


@query(
    "construct_triples",
    "SELECT 'nation/' || n_nationkey AS s, 'name' AS p, n_name AS o FROM nation UNION SELECT 'nation/' || n_nationkey, 'in', 'region/' || n_regionkey FROM nation",
)
def construct_triples(spark, sf_dir):
    g = mapped_graph(spark, sf_dir, "nation")
    found = bgp(g, ("?n", "nation.n_name", "?name"), ("?n", "nation.n_regionkey", "?r"))
    subject = F.concat(F.lit("nation/"), F.col("n").cast("string"))
    return found.construct([(subject, "name", "?name"), (subject, "in", F.concat(F.lit("region/"), F.col("r").cast("string")))])


@query("ask_exists", "SELECT (count(*) > 0) AS found FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)")
def ask_exists(spark, sf_dir):
    nation = t(spark, sf_dir, "nation")
    first = nation.agg(F.min("n_name")).first()[0]
    found = bgp(mapped_graph(spark, sf_dir, "nation"), ("?n", "nation.n_name", first)).ask()
    return spark.createDataFrame([(found,)], "found boolean")


@query(
    "decode_required_errors",
    "SELECT 'events/' || event_id AS subject, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS note "
    "FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL",
)
def decode_required_errors(spark, sf_dir):
    events = t(spark, sf_dir, "events")
    s = F.concat(F.lit("events/"), F.col("event_id").cast("string"))
    pairs = F.array(
        F.struct(F.lit("a").alias("p"), F.lit("Event").alias("o")),
        F.struct(F.lit("k").alias("p"), F.get_json_object("props", "$.k").alias("o")),
        F.struct(F.lit("note").alias("p"), F.get_json_object("props", "$.missing").alias("o")),
    )
    triples = events.select(s.alias("s"), F.explode(pairs).alias("t")).select("s", "t.p", "t.o").where("o is not null")
    records, _ = decode(triples, RecordSpec("Event", [Field("k", "k", "bigint"), Field("note", "note", default="none")]))
    return records


@query("decode_enum", "SELECT 'orders/' || o_orderkey AS subject, CASE o_orderstatus WHEN 'F' THEN 'Ok' WHEN 'O' THEN 'Running' WHEN 'P' THEN 'Error' END AS status FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')")
def decode_enum(spark, sf_dir):
    triples = mapped_graph(spark, sf_dir, "orders").triples("orders", predicates=["a", "orders.o_orderstatus"])
    status = {"F": "Ok", "O": "Running", "P": "Error"}
    records, _ = decode(triples, RecordSpec("orders", [Field("status", "orders.o_orderstatus", enum=status)]))
    return records


@query(
    "decode_nested",
    "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
)
def decode_nested(spark, sf_dir):
    g = mapped_graph(spark, sf_dir, "orders", "customer", "nation")
    wanted = ["a", "orders.o_custkey", "customer.c_name", "customer.c_nationkey", "nation.n_name"]
    triples = g.triples(predicates=wanted)
    nation = RecordSpec("nation", [Field("n_name", "nation.n_name")])
    customer = RecordSpec("customer", [Field("c_name", "customer.c_name"), Field("nation", "customer.c_nationkey", nested=nation)])
    records, _ = decode(triples, RecordSpec("orders", [Field("customer", "orders.o_custkey", nested=customer)]))
    key = F.regexp_extract("subject", r"(\d+)$", 1).cast("bigint")
    return records.select(key.alias("o_orderkey"), "customer.c_name", "customer.nation.n_name")


@query("pattern_by_object", "SELECT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
def pattern_by_object(spark, sf_dir):
    return bgp(mapped_graph(spark, sf_dir, "customer"), ("?c", "customer.c_mktsegment", "BUILDING")).df


@query("multi_value_flat", "SELECT o_custkey AS s, count(DISTINCT o_orderkey)::BIGINT AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY o_custkey")
def multi_value_flat(spark, sf_dir):
    links = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("s"), F.lit("order").alias("p"), F.col("o_orderkey").alias("o"))
    sets = lookup(links, links, "order", many=True)
    return sets.select("s", F.size("value").cast("bigint").alias("n"), F.get("value", 0).alias("first"), F.array_max("value").alias("last"))


@query(
    "cast_lexical",
    "SELECT event_id, TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) IS NOT NULL AS is_number, TRY_CAST(event_type AS BIGINT) IS NULL AS not_integer, (event_type = 'true') AS flag FROM events",
)
def cast_lexical(spark, sf_dir):
    def cast(kind: str, text: Column) -> Column:
        return Field("x", "x", kind).cast(text)

    kind = F.col("event_type")
    return t(spark, sf_dir, "events").select(
        "event_id",
        cast("double", F.col("value").cast("string")).isNotNull().alias("is_number"),
        cast("bigint", kind).isNull().alias("not_integer"),
        F.when(kind.isNotNull(), F.coalesce(cast("boolean", kind), F.lit(False))).alias("flag"),
    )


@query("bind_coalesce", "SELECT d.doc_id, coalesce(quality, 0) AS quality, 'Supervised' AS paradigm FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def bind_coalesce(spark, sf_dir):
    g = mapped_graph(spark, sf_dir, "documents", "labels")
    found = bgp(g, ("?doc_id", "documents.lang", "?lang")).optional(bgp(g, ("?doc_id", "labels.quality", "?q")))
    return found.bind("quality", F.coalesce("q", F.lit(0))).bind("paradigm", F.lit("Supervised")).project("doc_id", "quality", "paradigm").df


@query("bind_in_optional", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 1 END AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def bind_in_optional(spark, sf_dir):
    g = mapped_graph(spark, sf_dir, "documents", "labels")
    marked = bgp(g, ("?doc_id", "a", "labels")).bind("labelled", F.lit(1))
    return bgp(g, ("?doc_id", "a", "documents")).optional(marked).df


@query("positional_rows", "SELECT n_nationkey AS c0, n_name AS c1, n_regionkey AS c2 FROM nation")
def positional_rows(spark, sf_dir):
    found = bgp(mapped_graph(spark, sf_dir, "nation"), ("?n", "nation.n_name", "?name"), ("?n", "nation.n_regionkey", "?r"))
    rows = list(found.project("n", "name", "r").tuples())  # nations are few by definition
    return spark.createDataFrame(rows, t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").toDF("c0", "c1", "c2").schema)


@query("anonymous_star", "SELECT user_id AS u, event_type AS c, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def anonymous_star(spark, sf_dir):
    found = bgp(mapped_graph(spark, sf_dir, "events"), ("?_e", "events.user_id", "?u"), ("?_e", "events.event_type", "?c"))
    return found.project("u", "c").group(["u", "c"], n=F.count(F.lit(1))).df


@query("type_dispatch", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'categorized' WHEN event_type IN ('click', 'view') THEN 'image' ELSE 'other' END AS kind FROM events")
def type_dispatch(spark, sf_dir):
    e = F.col("event_type")
    return t(spark, sf_dir, "events").select("event_id", F.when(e == "purchase", "categorized").when(e.isin("click", "view"), "image").otherwise("other").alias("kind"))


@query("missing_context_rows", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def missing_context_rows(spark, sf_dir):
    known = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf_dir, "customer").select("c_custkey").join(known, "c_custkey", "left_anti")


@query(
    "nodemap_counts",
    "SELECT count(DISTINCT c_nationkey)::BIGINT AS n_aggregators, count(*)::BIGINT AS n_clients, (count(DISTINCT c_nationkey) + count(*))::BIGINT AS n_nodes FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)",
)
def nodemap_counts(spark, sf_dir):
    kept = t(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("aggregator"))
    mapping = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("aggregator"), F.col("c_custkey").alias("client"))
    return node_counts(mapping.join(kept, "aggregator", "left_semi"))


@query("replace_upsert", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'renamed' ELSE n_name END AS n_name, n_regionkey FROM nation")
def replace_upsert(spark, sf_dir):
    nation = t(spark, sf_dir, "nation")
    new = nation.where("n_nationkey < 5").withColumn("n_name", F.lit("renamed"))
    return update.upsert(nation, ["n_nationkey"], new)


@query(
    "update_delete_insert",
    "SELECT 'nation/' || n_nationkey AS s, 'nation.n_name' AS p, n_name AS o FROM nation WHERE n_regionkey <> 1 UNION SELECT 'nation/' || n_nationkey, 'status', 'moved' FROM nation WHERE n_regionkey = 1",
)
def update_delete_insert(spark, sf_dir):
    g = mapped_graph(spark, sf_dir, "nation")
    triples = g.triples("nation", predicates=["nation.n_name"])
    where = bgp(g, ("?n", "nation.n_regionkey", 1), ("?n", "nation.n_name", "?name"))
    s = F.concat(F.lit("nation/"), F.col("n").cast("string"))
    return update.apply_update(triples, where.construct([(s, "nation.n_name", "?name")]), where.construct([(s, "status", "moved")]))


# ---- inference


@query("inverse_property", "SELECT c_custkey AS c, o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey")
def inverse_property(spark, sf_dir):
    links = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s"), F.lit("placedBy").alias("p"), F.col("o_custkey").alias("o"))
    both = infer.inverse(links, [("placedBy", "placed")])
    return both.where("p = 'placed'").select(F.col("s").alias("c"), "o")


@query("property_chain", "SELECT DISTINCT l_orderkey AS s, p_brand AS o FROM lineitem JOIN part ON l_partkey = p_partkey")
def property_chain(spark, sf_dir):
    lines = t(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("s"), F.lit("holds").alias("p"), F.concat(F.lit("p"), "l_partkey").alias("o"))
    parts = t(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("s"), F.lit("brand").alias("p"), F.col("p_brand").alias("o"))
    out = infer.chain(lines.unionByName(parts), ["holds", "brand"], "holdsBrand").where("p = 'holdsBrand'")
    return out.select(F.substring("s", 2, 20).cast("bigint").alias("s"), "o")


@query(
    "transitive_property",
    "WITH RECURSIVE e AS (SELECT 'nation/' || n_nationkey AS s, 'region/' || n_regionkey AS o FROM nation UNION ALL SELECT 'region/' || r_regionkey, 'world' FROM region), "
    "c AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON c.o = e.s) SELECT s, 'within' AS p, o FROM c",
)
def transitive_property(spark, sf_dir):
    graph = _hierarchy(spark, sf_dir).select("s", F.lit("within").alias("p"), "o")
    return infer.materialize(graph, infer.Axioms(transitive=["within"]), ["transitive"])


@query(
    "subproperty_rewrite",
    "SELECT DISTINCT o_orderkey::VARCHAR AS s, 'about' AS p, o_orderstatus AS o FROM orders UNION SELECT o_orderkey::VARCHAR, 'about', o_orderpriority FROM orders",
)
def subproperty_rewrite(spark, sf_dir):
    pairs = F.array(F.struct(F.lit("status").alias("p"), F.col("o_orderstatus").alias("o")), F.struct(F.lit("priority").alias("p"), F.col("o_orderpriority").alias("o")))
    graph = t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("s"), F.explode(pairs).alias("t")).select("s", "t.p", "t.o")
    return infer.sub_properties(graph, [("status", "about"), ("priority", "about")]).where("p = 'about'")


@query("equivalent_class", "SELECT 'customer/' || c_custkey AS s FROM customer UNION SELECT 'supplier/' || s_suppkey FROM supplier")
def equivalent_class(spark, sf_dir):
    graph = mapped_graph(spark, sf_dir, "customer", "supplier").triples(predicates=["a"])
    out = infer.materialize(graph, infer.Axioms(equivalent_class=[("customer", "supplier")]), ["equivalent_class"])
    return out.where("p = 'a' and o = 'supplier'").select("s")


# ---- sets


@query("set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey").subtract(t(spark, sf_dir, "orders").select("o_custkey"))


@query("set_intersect_distinct", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect_distinct(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(t(spark, sf_dir, "supplier").select("s_nationkey"))


@query("set_union_keys", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_keys(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).union(t(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("concat_frames", "SELECT upper(substr(c_name, 1, 1)) || substr(c_name, 2) AS name, c_acctbal AS balance, 'customer' AS kind FROM customer UNION ALL SELECT upper(substr(s_name, 1, 1)) || substr(s_name, 2), s_acctbal, 'supplier' FROM supplier")
def concat_frames(spark, sf_dir):
    def part(name, n, b):
        return t(spark, sf_dir, name).select(scalar.capitalize(F.col(n)).alias("name"), F.col(b).alias("balance"), F.lit(name).alias("kind"))

    return derive.union_all([part("customer", "c_name", "c_acctbal"), part("supplier", "s_name", "s_acctbal")])


# ---- names and text


@query("json_props", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("regex_url", r"SELECT page_id, regexp_extract(url, '\w+:([a-z/.]+)', 1) AS part, regexp_matches(url, '(?i)EXAMPLE') AS hit FROM pages")
def regex_url(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"\w+:([a-z/.]+)", 1).alias("part"), F.col("url").rlike("(?i)EXAMPLE").alias("hit"))


@query(
    "prefix_compact",
    "SELECT page_id, CASE WHEN starts_with(url, 'http://m.ththth.example.net/en/') THEN 'en:' || substr(url, 32) WHEN starts_with(url, 'http://m.ththth.example.net/') THEN 'net:' || substr(url, 29) "
    "WHEN starts_with(url, 'https://') THEN 's:' || substr(url, 9) WHEN starts_with(url, 'http://') THEN 'h:' || substr(url, 8) END AS name FROM pages",
)
def prefix_compact(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", PREFIXES.compact_column(F.col("url")).alias("name"))


@query("resolve_name", "SELECT page_id, url AS iri, CASE WHEN contains(url, '#') THEN split_part(url, '#', -1) END AS fragment, regexp_extract(url, '([^#/]*)$', 1) AS local FROM pages")
def resolve_name(spark, sf_dir):
    pages = t(spark, sf_dir, "pages").select("page_id", "url", PREFIXES.compact_column(F.col("url")).alias("name"))
    return pages.select("page_id", PREFIXES.resolve_column(F.col("name")).alias("iri"), fragment(F.col("url")).alias("fragment"), local_name(F.col("url")).alias("local"))


@query("classify_prefix", "SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN 'mobile' WHEN starts_with(url, 'https://blog.') THEN 'blog' WHEN starts_with(url, 'https://') THEN 'secure' ELSE 'other' END AS class FROM pages")
def classify_prefix(spark, sf_dir):
    classes = (("https://m.", "mobile"), ("https://blog.", "blog"), ("https://", "secure"))
    return t(spark, sf_dir, "pages").select("page_id", scalar.classify_prefix(F.col("url"), classes).alias("class"))


@query("compact_ws", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_md5 FROM documents")
def compact_ws(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(compact_space(F.col("text"))).alias("text_md5"))


@query("entity_from_path", r"SELECT page_id, regexp_extract(url, '([^/]+?)(?:\.[^./]*)?$', 1) AS stem, regexp_replace(lower(url), '^https?://', '') AS plain FROM pages")
def entity_from_path(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", file_stem(F.col("url")).alias("stem"), F.regexp_replace(F.lower("url"), "^https?://", "").alias("plain"))


@query("label_index", "SELECT event_id, (list_position(['click', 'view', 'purchase'], event_type) - 1)::BIGINT AS label FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def label_index(spark, sf_dir):
    out = t(spark, sf_dir, "events").select("event_id", scalar.label_index(F.col("event_type"), EVENT_TYPES[:3]).alias("label"))
    return out.where("label is not null")


@query(
    "clamp_floor",
    "SELECT p_partkey, least(greatest(p_size, 10), 40)::INTEGER AS size, floor(p_retailprice)::BIGINT AS price, greatest(p_size - 25, 0)::INTEGER AS over, (p_partkey % 7)::BIGINT AS slot FROM part",
)
def clamp_floor(spark, sf_dir):
    size = F.col("p_size")
    return t(spark, sf_dir, "part").select(
        "p_partkey",
        scalar.clamp(size, 10, 40).alias("size"),
        F.floor("p_retailprice").alias("price"),
        scalar.saturating_sub(size, F.lit(25)).alias("over"),
        (F.col("p_partkey") % 7).alias("slot"),
    )


@query(
    "unit_convert",
    "SELECT l_orderkey, l_linenumber, round(CASE l_returnflag WHEN 'A' THEN l_quantity * 8000 WHEN 'N' THEN l_quantity * 8 WHEN 'R' THEN NULL END, 6) AS bits, l_quantity, l_extendedprice FROM lineitem",
)
def unit_convert(spark, sf_dir):
    units = spark.createDataFrame(
        [("bit", None, 1.0), ("byte", "bit", 8.0), ("kilobyte", "byte", 1000.0), ("second", None, 1.0)], "unit string, reference_unit string, factor double"
    )
    unit = F.when(F.col("l_returnflag") == "A", "kilobyte").when(F.col("l_returnflag") == "N", "byte").otherwise("second")
    df = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", unit.alias("unit"))
    return joins.convert_units(df, "l_quantity", "unit", "bit", units).select("l_orderkey", "l_linenumber", F.round("converted", 6).alias("bits"), "l_quantity", "l_extendedprice")


# ---- context on streams


VISIBILITY = [("click", "Public"), ("purchase", "Private"), ("view", "Public")]


@query(
    "routing_visibility",
    "WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'edge' WHEN 1 THEN 'fog' ELSE 'cloud' END AS layer, event_type IN ('click', 'view') AS pub FROM events) "
    "SELECT event_id, layer, 'internal' AS target FROM r UNION ALL SELECT event_id, layer, 'external' FROM r WHERE layer = 'fog' OR (layer = 'edge' AND pub)",
)
def routing_visibility(spark, sf_dir):
    layer = F.when(F.col("event_id") % 3 == 0, "edge").when(F.col("event_id") % 3 == 1, "fog").otherwise("cloud")
    records = t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("cls"), layer.alias("layer"))
    schema = spark.createDataFrame(VISIBILITY, "cls string, visibility string")
    return context.route(records, schema).select("event_id", "layer", "target")


@query("stale_round_filter", "SELECT event_id FROM events WHERE event_id % 10 = 4")
def stale_round_filter(spark, sf_dir):
    messages = t(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 10).alias("round"))
    return context.current_round(messages, 4).select("event_id")


@query("global_view_dedupe", "SELECT event_id, user_id, event_type FROM events")
def global_view_dedupe(spark, sf_dir):
    events = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    copies = context.fan_out(events, ["fog", "cloud"]).drop("owner")
    return context.global_view([events, copies], ["event_id", "user_id", "event_type"]).drop("subject")


@query("event_time_default", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE '2026-01-01 00:00:00' END AS acquired_at, 'edge1' AS acquired_by FROM events")
def event_time_default(spark, sf_dir):
    events = t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("ts").cast("timestamp")).alias("acquired_at"))
    out = context.stamp(events, F.lit("edge1"), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return out.select("event_id", F.date_format("acquired_at", "yyyy-MM-dd HH:mm:ss").alias("acquired_at"), "acquired_by")


@query("straggler_drop", "SELECT event_type, count(*)::BIGINT AS n_in_time FROM events WHERE value <= 50 GROUP BY event_type")
def straggler_drop(spark, sf_dir):
    return in_time(t(spark, sf_dir, "events"), "value", 50).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_in_time"))


@query("latest_status", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_status(spark, sf_dir):
    log = t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return update.latest_status(log, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("broadcast_run_count", "SELECT event_id, (SELECT count(*) FROM events WHERE event_type = 'login')::BIGINT AS n_logins FROM events")
def broadcast_run_count(spark, sf_dir):
    events = t(spark, sf_dir, "events")
    total = events.agg(F.count_if(F.col("event_type") == "login").alias("n_logins"))  # one row
    return events.select("event_id").crossJoin(F.broadcast(total))


@query("stream_bin_counts", "SELECT (epoch_us(ts) // 3600000000 * 3600)::BIGINT AS bin, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_bin_counts(spark, sf_dir):
    """Counts of a stream that reads the events file by file until there are no more."""
    source = t(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", "2").parquet(f"{sf_dir}/events.parque[t]")  # a pattern may match a file
    out = new_path(spark, "stream-sink")

    def keep(batch: DataFrame, batch_id: int) -> None:
        # complete mode: each batch holds all counts so far and takes the place of the one before
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id:06d}")

    run = context.binned(stream, "ts", 3600, ["event_type"]).writeStream.outputMode("complete").foreachBatch(keep)
    job = run.option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True).start()
    job.awaitTermination()
    counts = spark.read.parquet(out)
    last = counts.agg(F.max("batch")).first()[0]
    return counts.where(F.col("batch") == last).select("bin", "event_type", "n")
