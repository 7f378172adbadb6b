from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.errors import MissingContext, ModelMismatch, NotEnough, QueryError
from graphloom.functions import scalar
from graphloom.operators import derive, sampling, telemetry, vectors
from graphloom.plans import learning, rounds
from graphloom.plans.storage import new_path
from graphloom.streaming import context

WEIGHTS = "map<string,array<float>>"


def models(spark, rows):
    return spark.createDataFrame(rows, f"group string, weights {WEIGHTS}, size bigint")


def test_federated_average(spark):
    df = models(spark, [("g", {"w": [1.0, 2.0], "b": [0.0]}, 1), ("g", {"w": [3.0, 6.0], "b": [4.0]}, 3)])
    row = vectors.federated_average(df, "weights", "size").first()
    assert row["weights"] == {"w": [2.5, 5.0], "b": [3.0]} and row["size"] == 4
    assert vectors.federated_average(df, "weights", "size", ["group"]).first()["group"] == "g"
    zero = vectors.federated_average(df.withColumn("size", F.lit(0)), "weights", "size").first()
    assert zero["weights"] == {"w": [None, None], "b": [None]}
    for bad in ([("g", {"w": [1.0]}, 1), ("g", {"v": [1.0]}, 1)], [("g", {"w": [1.0]}, 1), ("g", {"w": [1.0, 2.0]}, 1)]):
        with pytest.raises(ModelMismatch):
            vectors.federated_average(models(spark, bad), "weights", "size")
    with pytest.raises(NotEnough):
        vectors.check_models(models(spark, []), "weights")
    assert vectors.average_vectors(spark.createDataFrame([([1.0, 3.0],), ([3.0, 5.0],)], "v array<float>"), [], "v").first()["v"] == [2.0, 4.0]
    assert df.select(scalar.weights_bytes(F.col("weights"))).first()[0] == 12


def test_parameters():
    a = rounds.create_algorithm("fedavg", {"rounds": 0, "client_fraction": 7, "global_period": 2})
    assert (a.rounds, a.client_fraction) == (1, 1.0) and not a.should_aggregate_globally(0) and a.should_aggregate_globally(1)
    assert rounds.create_algorithm("none", {}) is None
    with pytest.raises(TypeError):
        rounds.create_algorithm("fedavg", {"no": 1})


def test_map_nodes(spark):
    fogs = spark.createDataFrame([("f1", 0.0, 0.0), ("f2", 10.0, 0.0), ("f3", 99.0, 99.0)], "node string, x double, y double")
    clients = spark.createDataFrame([("c1", 1.0, 0.0), ("c2", 9.0, 1.0), ("c3", 5.0, 0.0)], "node string, x double, y double")
    got = {r["client"]: r["aggregator"] for r in rounds.FedAvg().map_nodes(fogs, clients).collect()}
    assert got == {"c1": "f1", "c2": "f2", "c3": "f1"}
    for a, what in ((rounds.FedAvg(min_aggregators=4), "aggregators"), (rounds.FedAvg(min_clients=9), "clients"), (rounds.FedAvg(min_clients_per_aggregator=2), "clients of")):
        with pytest.raises(NotEnough, match=what):
            a.map_nodes(fogs, clients)


def test_sizes_and_workload(spark):
    sizes = spark.createDataFrame([("a", 5), ("b", 7), ("f", 1)], "node string, value bigint")
    aggregations = spark.createDataFrame([("t", 1, "f", ["a", "b"])], "task string, round bigint, node string, on_node array<string>")
    nodes = spark.createDataFrame([("f",), ("a",)], "node string")
    assert {r["node"]: r["size"] for r in rounds.model_sizes(nodes, sizes, aggregations).collect()} == {"f": 13, "a": 5}
    with pytest.raises(MissingContext):
        rounds.model_sizes(spark.createDataFrame([("zz",)], "node string"), sizes, aggregations)
    updates = spark.createDataFrame([("t", 1, "f", "a", 10), ("t", 1, "f", "b", 20), ("t", 2, "f", "a", 99)], "task string, round bigint, node string, from_node string, total_size bigint")
    load = rounds.workload(aggregations, updates, "t", 1)
    assert load.collect() == [("f", 30)]
    assert rounds.FedAvg().select_global(load) == "f" and rounds.FedAvg(max_workload=5).select_global(load) is None


def test_answers(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 9.0)], "n int, latency double")
    assert rounds.in_time(df, "latency", 1.0).count() == 1
    assert rounds.all_answered(df, 2) is df
    with pytest.raises(NotEnough):
        rounds.all_answered(df, 3)


@pytest.fixture(scope="module")
def scenario(spark):
    rng = np.random.default_rng(0)
    centers = {"glass": [2.0, 0.0], "paper": [0.0, 2.0], "metal": [-2.0, -2.0]}
    rows = [(f"e{i % 6}", (np.array(c) + rng.normal(0, 0.5, 2)).tolist(), name) for i in range(40) for name, c in centers.items()]
    data = spark.createDataFrame([*rows, ("e0", [0.0, 0.0], "unknown")], "node string, features array<double>, category string")
    mapping = spark.createDataFrame([("f1" if i < 3 else "f2", f"e{i}") for i in range(6)], "aggregator string, client string")
    sizes = data.groupBy("node").agg(F.count("*").alias("value"))
    return data, mapping, sizes


def test_learning_task_end_to_end(spark, scenario):
    data, mapping, sizes = scenario
    learner = learning.SoftmaxRegression(["glass", "paper", "metal"], epochs=20)

    def train(clients, weights, round_no):
        layers = None if weights is None else learning.as_layers(weights)
        own = learner.train(data.join(clients, "node", "left_semi"), layers, round_no)
        stale = own.limit(1).withColumn("round", F.lit(-1).cast("bigint"))
        return own.unionByName(stale)

    def evaluate(clients, weights):
        return learner.evaluate(data.where("category != 'unknown'").join(clients, "node", "left_semi"), learning.as_layers(weights))

    told = []
    result = rounds.run_task("t", rounds.FedAvg(rounds=2), mapping, sizes, train, evaluate, [lambda step, n, about: told.append((step, n))])
    assert told == [(s, n) for n in (0, 1) for s in ("train", "local aggregation", "global aggregation", "evaluation")]
    assert result.status == "Ok" and [r for r, _ in result.history] == [0, 1] and result.history[-1][1] > 0.9
    path = new_path(spark, "model")
    learning.save_model(result.weights, path, "t", 1)
    loaded = learning.load_model(spark.read.parquet(path).where("round = 1"))
    assert {k: pytest.approx(v) for k, v in learning.as_layers(result.weights).items()} == loaded
    scored = learner.predict(data, loaded).first()
    assert scored["predicted"] in ("glass", "paper", "metal") and 1 / 3 <= scored["prob"] <= 1


def test_task_ends_with_its_error(spark, scenario):
    _, mapping, sizes = scenario

    def train(clients, weights, round_no):
        raise NotEnough("answers", 0, 1)

    result = rounds.run_task("t", rounds.FedAvg(), mapping, sizes, train, lambda c, w: c)
    assert result.status == "Error" and "answers" in result.message


def test_aggregators_train_on_from_their_own_weights(spark):
    mapping = spark.createDataFrame([("f1", "a"), ("f1", "b"), ("f2", "c")], "aggregator string, client string")
    sizes = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "node string, value bigint")
    step = F.when(F.col("node") == "c", 10.0).otherwise(1.0)
    before, seen = {}, []

    def train(clients, weights, round_no):
        started = clients.withColumn("weights", F.lit(None).cast(WEIGHTS)) if weights is None else clients.join(weights, "node", "left")
        before[round_no] = {r["node"]: r["weights"] and r["weights"]["w"][0] for r in started.collect()}
        value = F.coalesce(F.get(F.col("weights")["w"], F.lit(0)).cast("double"), F.lit(0.0)) + step
        return started.select("node", F.create_map(F.lit("w"), F.array(value.cast("float"))).alias("weights"), F.lit(round_no).cast("bigint").alias("round"))

    def evaluate(clients, weights):
        out = weights.select("node", F.get(F.col("weights")["w"], F.lit(0)).cast("double").alias("value"), F.lit(1).alias("size"))
        seen.append({r["node"]: r["value"] for r in out.collect()})
        return out

    result = rounds.run_task("t", rounds.FedAvg(rounds=3, global_period=2), mapping, sizes, train, evaluate)
    assert (result.status, result.message) == ("Ok", None)
    assert before == {0: {"a": None, "b": None, "c": None}, 1: {"a": 1.0, "b": 1.0, "c": 10.0}, 2: {"a": 11.0, "b": 11.0, "c": 11.0}}
    assert seen == [{"a": 1.0, "b": 1.0, "c": 10.0}, {"a": 11.0, "b": 11.0, "c": 11.0}, {"a": 12.0, "b": 12.0, "c": 21.0}]
    assert {r["group"]: r["weights"]["w"] for r in result.models.collect()} == {"f1": [12.0], "f2": [21.0]}


def test_every_aggregator_draws(spark):
    rows = [(f"f{i % 5}", f"c{i}") for i in range(50)]
    clients = spark.createDataFrame(rows, "aggregator string, node string")
    sizes = clients.select("node", F.when(F.col("aggregator") == "f0", 10**6).otherwise(1).cast("bigint").alias("value"))
    drawn = rounds.FedAvg(client_fraction=0.2).select_train(clients, sizes)
    assert {r["aggregator"]: r["count"] for r in clients.join(drawn, "node").groupBy("aggregator").count().collect()} == {f"f{i}": 2 for i in range(5)}


def test_a_learner_takes_each_node_with_its_own_weights(spark, scenario):
    data, mapping, sizes = scenario
    learner = learning.SoftmaxRegression(["glass", "paper", "metal"], epochs=5)
    own = learner.train(data, None, 0).select("node", "weights").cache()
    one = learning.as_layers(own.where("node = 'e1'"))
    again = learner.train(data, own, 1).where("node = 'e1'").first()["weights"]
    assert again == learner.train(data.where("node = 'e1'"), one, 1).first()["weights"]
    key = ["node", "value", "size"]
    assert learner.evaluate(data, own).where("node = 'e1'").select(key).collect() == learner.evaluate(data.where("node = 'e1'"), one).select(key).collect()
    with pytest.raises(ModelMismatch):
        learning.as_layers(own)


# ---- sampling


def test_weighted_sample_follows_the_weights(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    got = sampling.weighted_sample(df, "id", "w", 0.1, 5)
    even = got.where("id % 2 = 0").count()
    assert got.count() == 400 and 0.68 < even / 400 < 0.82
    assert sampling.weighted_sample(df.withColumn("w", F.lit(0.0)), "id", "w", 0.1, 5).count() == 0
    assert sampling.weighted_sample(df.limit(3), "id", "w", 0.1, 2).count() == 2


def test_weighted_sample_narrows_the_band(spark, monkeypatch):
    df = spark.range(4000).select("id", F.lit(1.0).alias("w"))
    whole = {r["id"] for r in sampling.weighted_sample(df, "id", "w", 0.25, 5).collect()}
    monkeypatch.setattr(sampling, "NARROW", 50)
    assert {r["id"] for r in sampling.weighted_sample(df, "id", "w", 0.25, 5).collect()} == whole and len(whole) == 1000


def test_splits(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)], "g string, i int")
    ordered = sampling.split_ordered(df, ["g"], ["i"], 0.35)
    assert {(r["g"], r["i"]) for r in ordered.where("is_test").collect()} == {("a", 7), ("a", 8), ("a", 9), ("b", 2)}
    assert sampling.split_hashed(df, "i", ["g"], 0.35).where("is_test").count() == 4
    assert sampling.per_class_limit(df, "g", ["i"], 5).groupBy("g").count().where("count = 2").count() == 2
    nodes = sampling.assign_nodes(df, "i", 4).select("by_node").distinct()
    assert all(0 <= r[0] < 4 for r in nodes.collect())


# ---- derivations


def test_schema():
    s = derive.Schema(
        [
            derive.ContextClass("Base", [derive.Attribute("id", "bigint", key=True), derive.Attribute("v", "double", unit="byte")]),
            derive.ContextClass("Sub", [derive.Attribute("v", "float")], derive.PUBLIC, ["Base"]),
        ]
    )
    assert [a.type for a in s.attributes("Sub")] == ["float", "bigint"] and s.classes["Sub"].public and not s.classes["Base"].public
    assert s.struct("Base")["v"].metadata == {"key": False, "derived": False, "unit": "byte"} and not s.struct("Base")["id"].nullable
    assert derive.Binding("urn:x#temp").name == "temp" and derive.Binding("urn:x#temp", label="t").name == "t"
    with pytest.raises(QueryError):
        derive.compile_expression("NOPE(?y)", {})


# ---- telemetry


LINES = [
    "[2026-01-01 00:00:03.5 UTC] [metrics/Connection][peer=10.42.0.1:5683] sent bytes: 1500",
    "[2026-01-01 00:00:04 UTC] [metrics/Connection][peer=7.0.0.2:5683] RECEIVED bytes: 500",
    "node 3: [2026-01-01 00:00:07 UTC] [metrics/Connection][peer=192.168.0.2:5683] latency (s): 0.25",
    "[2026-01-01 00:00:09 UTC] [FlAlgorithm] round #3 global accuracy: 0.875",
    "[2026-01-01 00:00:00 UTC] [EdgeApp] start",
    "noise",
]


def test_logs(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "run.log").write_text("\n".join(LINES))
    lines = telemetry.read_logs(spark, str(tmp_path))
    rows = {(r["kind"], r["t"]): r for r in telemetry.parse_logs(lines).collect()}
    assert set(rows) == {("bytes", 3.5), ("bytes", 4.0), ("latency", 7.0), ("accuracy", 9.0)}
    assert (rows["bytes", 3.5]["layer"], rows["bytes", 3.5]["bytes"], rows["bytes", 3.5]["direction"]) == ("cloud", 1500, "sent")
    assert rows["bytes", 4.0]["layer"] == "edge" and rows["latency", 7.0]["layer"] == "other" and rows["latency", 7.0]["latency"] == 0.25
    assert (rows["accuracy", 9.0]["round"], rows["accuracy", 9.0]["accuracy"]) == (3, 0.875)
    (tmp_path / "x" / "other.log").write_text("\n".join([LINES[4], LINES[4]]))
    sized = telemetry.with_run_size(telemetry.read_logs(spark, str(tmp_path)))
    assert {(r["path"].rsplit("/", 1)[1], r["n_edges"]) for r in sized.collect()} == {("run.log", 1), ("other.log", 2)}
    rate = telemetry.bin_rate(telemetry.parse_logs(lines).where("kind = 'bytes'"), "t", "bytes", 5, ["direction"])
    assert {(r["bin"], r["direction"], r["amount"]) for r in rate.collect()} == {(0, "sent", 1.5), (0, "received", 0.5)}


def test_predictions(spark, tmp_path):
    df = spark.createDataFrame([("a", "a", 0.9), ("a", "b", 0.6)], "actual string, predicted string, prob double")
    telemetry.write_predictions(df, str(tmp_path / "out"))
    import glob
    import shutil

    (tmp_path / "in").mkdir()
    for i, f in enumerate(glob.glob(str(tmp_path / "out" / "*.csv"))):
        shutil.copy(f, tmp_path / "in" / f"part{i}-run-40.csv")
    back = telemetry.read_predictions(spark, str(tmp_path / "in"))
    assert back.count() == 2 and back.select("n").distinct().collect() == [(40,)]
    assert telemetry.accuracy_by(back, ["n"]).first()["accuracy"] == 0.5


def test_scalars(spark):
    df = spark.createDataFrame([([1000.0, 1001.0, 999.0], "2024-05-06T07:08:09Z")], "l array<double>, t string")
    row = df.select(scalar.softmax(F.col("l")).alias("p"), scalar.argmax(F.col("l")).alias("a"), scalar.format_rfc3339(scalar.parse_rfc3339(F.col("t"))).alias("t")).first()
    assert sum(row["p"]) == pytest.approx(1) and row["a"] == 1 and row["t"] == "2024-05-06T07:08:09.000000Z"
    assert df.select(scalar.parse_rfc3339(F.lit("6 May 2024"))).first()[0] is None
    assert df.select(scalar.confusion_accuracy(F.lit(0), F.lit(0), F.lit(0), F.lit(0))).first()[0] is None


# ---- streams


SCHEMA = [("pub", "Public"), ("priv", "Private")]


def _records(spark):
    return spark.createDataFrame([(1, "pub", "edge"), (2, "priv", "edge"), (3, "priv", "fog"), (4, "pub", "cloud"), (5, "none", "edge")], "id int, cls string, layer string")


def test_routing(spark):
    out = context.route(_records(spark), spark.createDataFrame(SCHEMA, "cls string, visibility string"))
    external = {r["id"] for r in out.where("target = 'external'").collect()}
    assert external == {1, 3} and out.where("target = 'internal'").count() == 5


def test_acquire_stream(spark):
    source, sink = new_path(spark, "in"), new_path(spark, "out")
    _records(spark).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(_records(spark).schema).option("maxFilesPerTrigger", "1").parquet(source)
    query = context.acquire(stream, spark.createDataFrame(SCHEMA, "cls string, visibility string"), "node1", context.batch_writer(sink), new_path(spark, "state"))
    query.awaitTermination()
    inside = spark.read.parquet(f"{sink}/internal")
    assert inside.count() == 5 and inside.select("acquired_by").distinct().collect() == [("node1",)]
    assert {r["id"] for r in spark.read.parquet(f"{sink}/external").collect()} == {1, 3}


def test_windows_with_watermark(spark):
    source = new_path(spark, "events")
    rows = [(f"2024-01-01 00:00:{s:02d}", "a") for s in (1, 2, 7, 8)] + [("2024-01-01 01:00:00", "a")]
    spark.createDataFrame(rows, "ts string, k string").select(F.col("ts").cast("timestamp").alias("ts"), "k").write.parquet(source)
    for make, name in ((lambda s: context.binned(s, "ts", 5, ["k"], "10 seconds"), "bins"), (lambda s: context.sessions(s, "ts", "10 seconds", ["k"], "10 seconds"), "sessions")):
        stream = spark.readStream.schema("ts timestamp, k string").parquet(source)
        query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(r["n"] for r in spark.table("bins").collect())[:2] == [2, 2]
    assert 4 in {r["n"] for r in spark.table("sessions").collect()}


def test_rescore(spark):
    features = spark.createDataFrame([(1,), (2,)], "k int")
    labels = spark.createDataFrame([(1,)], "k int")
    model_rows = spark.createDataFrame([("good",), ("bad",)], "m string")

    def score(todo, model):
        if model["m"] == "bad":
            raise ValueError("missing model")
        return todo.withColumn("model", F.lit(model["m"]))

    results, faults = context.rescore(features, labels, ["k"], model_rows, score)
    assert [r.collect() for r in results] == [[(2, "good")]] and len(faults) == 1
    assert context.rescore(features, features, ["k"], model_rows, score) == ([], [])


def test_global_view(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "i int, v string")
    copies = context.fan_out(df, ["fog1", "cloud"])
    assert copies.count() == 4 and context.global_view([df, copies.drop("owner")], ["i", "v"]).count() == 2
    stamped = context.stamp(df.withColumn("acquired_at", F.when(F.col("i") == 1, F.lit("2020-01-01").cast("timestamp"))), F.lit("n"))
    assert str(stamped.where("i = 1").first()["acquired_at"]).startswith("2020-01-01") and stamped.where("acquired_at is null").count() == 0


def test_json_results(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert json.loads(df.select(F.to_json(F.struct("*"))).first()[0]) == {"a": 1}
