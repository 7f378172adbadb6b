from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from graphloom.errors import QueryError
from graphloom.operators.derivation import DerivationGraph
from graphloom.operators.derive import Attribute, Binding, ContextClass, Derivation, Schema
from graphloom.operators import ranking, sampling
from graphloom.operators.ranking import ranked
from graphloom.plans.storage import new_path, table
from graphloom.queries_context import SLOTS, VISITS, _from
from graphloom.streaming import context, gather

# ---- derivation graphs


def times(*hours):
    return [dt.datetime(2024, 1, 1, h, 30) for h in hours]


def visits(spark):
    schema = "acquiredAt timestamp, locatedAt long, value double"
    click = spark.createDataFrame([(t, 1, 0.0) for t in times(1, 1, 2)] + [(times(2)[0], None, 0.0)], schema)
    view = spark.createDataFrame([(t, 1, v) for t, v in zip(times(1, 1, 1, 5), (2.0, 4.0, None, 9.0))] + [(times(2)[0], 1, 30.0)], schema)
    purchase = spark.createDataFrame([], schema)
    order = spark.createDataFrame([(times(0)[0], 5.0), (times(3)[0], 7.0)], "hourSlot timestamp, value double")
    return DerivationGraph(VISITS, {"Click": click, "View": view, "Purchase": purchase, "Order": order}, SLOTS)


def test_sources_align_on_keys(spark):
    out = {(r["hourSlot"].hour, r["locatedAt"]): r for r in visits(spark).derive("VisitAggregate").collect()}
    assert set(out) == {(1, 1), (2, 1), (2, None)}  # a view at 5 has no click, so no record
    assert out[1, 1]["demand"] == 2 and out[1, 1]["avgViewed"] == 3.0 and out[1, 1]["avgPaid"] is None
    assert out[2, None]["demand"] == 1 and out[2, None]["avgViewed"] is None


def test_averages_of_averages_weigh_records(spark):
    (day,) = visits(spark).derive("DailyAggregate").collect()
    assert (day["hours"], day["demand"], day["ordered"]) == (3, 4, 12.0)
    assert day["avgViewed"] == pytest.approx((2 + 4 + 30) / 3)


def test_dependencies_and_order(spark):
    g = visits(spark)
    assert g.order("DailyAggregate") == ["VisitAggregate", "DailyAggregate"]
    assert g.depends_on("DailyAggregate") == ["Click", "Order", "Purchase", "View", "VisitAggregate"]


def test_circles_and_gaps_are_errors(spark):
    def one(name, source, expression="SUM(?v)", key=False):
        return ContextClass(name, [Attribute("v", "double", key=key, derived=_from(source, "v", expression))])

    circle = DerivationGraph(Schema([one("A", "B"), one("B", "A")]), {})
    with pytest.raises(QueryError, match="derive from each other"):
        circle.derive("A")
    with pytest.raises(QueryError, match="no class C"):
        DerivationGraph(Schema([one("A", "C")]), {}).derive("A")
    table = spark.createDataFrame([(1.0,)], "w double")
    with pytest.raises(QueryError, match="neither an attribute nor derived"):
        DerivationGraph(Schema([one("A", "T")]), {"T": table}).derive("A")
    loop = {"v": Derivation([Binding("u")]), "u": Derivation([Binding("v")])}
    with pytest.raises(QueryError, match="neither an attribute nor derived"):
        DerivationGraph(Schema([one("A", "T")]), {"T": table}, loop).derive("A")


def test_property_derivations_serve_every_class(spark):
    """A property without a domain is evaluated on whatever class it is asked of."""
    double = {"twice": Derivation([Binding("v")], None)}
    schema = Schema([ContextClass("A", [Attribute("t", "double", derived=_from("T", "twice"))]), ContextClass("B", [Attribute("n", "long", derived=_from("U", "twice", "COUNT(?twice)"))])])
    tables = {"T": spark.createDataFrame([(1.0,), (2.0,)], "v double"), "U": spark.createDataFrame([("x",), (None,)], "v string")}
    g = DerivationGraph(schema, tables, double)
    assert sorted(r["t"] for r in g.derive("A").collect()) == [1.0, 2.0]
    assert [r["n"] for r in g.derive("B").collect()] == [1]


# ---- rounds


def answers(spark):
    """Users' days with none, too few, exactly enough and too many answers, ties, some after the deadline."""
    rows = []
    for user in range(6):
        for day in range(4):
            for k in range((user * 3 + day * 2) % 6):
                hour = (5 * k + user) % 24
                rows.append((len(rows), user, dt.datetime(2024, 1, 1 + day, hour, 0 if k % 2 else 15)))
    rows += [(len(rows), 1, rows[5][2]), (len(rows) + 1, None, dt.datetime(2024, 1, 2)), (len(rows) + 2, 3, None)]
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")


def expected(df, n, seconds):
    held = {}
    for r in df.collect():
        if r["ts"] is None or r["user_id"] is None:
            continue
        day = dt.datetime.combine(r["ts"].date(), dt.time())
        if (r["ts"] - day).total_seconds() <= seconds:
            held.setdefault((r["user_id"], day.date()), []).append((r["ts"], str(r["event_id"])))
    return {k: ("Complete" if len(v) >= n else "TimedOut", [i for _, i in sorted(v)[:n]]) for k, v in held.items()}


def rounds(spark, folder, schema, files=1, running=False, delay="2 days"):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files)).parquet(folder).withColumn("day", F.to_date("ts"))
    return gather.gather(stream, ["user_id", "day"], 3, 64_800, F.col("day"), "ts", "event_id", delay, running)


def found(spark, out, path):
    rows = gather.read_sink(spark, path, out.schema).collect()
    got = {(r["user_id"], r["day"]): (r["status"], [a["id"] for a in r["answers"]]) for r in rows}
    assert len(got) == len(rows)  # each round once
    return got


def end():
    return F.lit("2030-01-01").cast("timestamp")


def test_rounds_equal_a_batch(spark):
    df = answers(spark)
    out = rounds(spark, gather.replay(df, "ts", 5, "t-rounds", end()), df.schema, 2)
    path = new_path(spark, "t-sink")
    gather.sink(out, path, new_path(spark, "t-state")).awaitTermination()
    assert found(spark, out, path) == expected(df, 3, 64_800)


def test_rounds_go_on_after_a_stop(spark):
    df = answers(spark)
    folder, path, state = gather.replay(df, "ts", 5, "t-rounds", end()), new_path(spark, "t-sink"), new_path(spark, "t-state")
    out = rounds(spark, folder, df.schema)
    first = gather.sink(out, path, state, {"processingTime": "0 seconds"})
    until = time.time() + 60
    while not any(p["batchId"] >= 1 for p in first.recentProgress) and time.time() < until:
        time.sleep(0.1)
    first.stop()
    again = rounds(spark, folder, df.schema)
    gather.sink(again, path, state).awaitTermination()
    assert found(spark, again, path) == expected(df, 3, 64_800)


def test_answers_out_of_order_within_the_watermark(spark):
    df = answers(spark)
    folder = new_path(spark, "t-late")
    for k in (2, 0, 1):  # by remainder, so times go back and forth
        df.where(F.col("event_id") % 3 == k).write.mode("append").parquet(folder)
    df.limit(1).select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"), end().alias("ts")).write.mode("append").parquet(folder)
    out = rounds(spark, folder, df.schema, delay="10 days")
    path = new_path(spark, "t-sink")
    gather.sink(out, path, new_path(spark, "t-state")).awaitTermination()
    assert found(spark, out, path) == expected(df, 3, 64_800)


# ---- ranks


def test_ranks_of_one_large_group_are_spread(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ranking, "table", lambda df, name: written.append(table(df, name)) or written[-1])
    df = spark.range(20_000).select(F.lit("all").alias("g"), (F.col("id") % 5000).alias("v"), "id")
    out = ranked(df, ["g"], ["v"])
    assert [(r["v"], r["rank"]) for r in out.where("rank in (1, 4, 5, 20000)").orderBy("rank").collect()] == [(0, 1), (0, 4), (1, 5), (4999, 20000)]
    assert out.select("rank").distinct().count() == 20_000 and out.select("group_rows").distinct().collect()[0][0] == 20_000
    # a task sorts a range, not the group
    ranges = written[0].groupBy("_rank_range").count().agg(F.max("count"), F.count("*")).first()
    assert ranges[1] > 1 and ranges[0] <= 2 * 20_000 / ranges[1]


def test_ranks_of_many_groups_and_nulls(spark):
    rows = [(g, v) for g in ("a", "b", None) for v in (3, 1, None, 2)]
    got = ranked(spark.createDataFrame(rows, "g string, v int"), ["g"], [F.desc_nulls_last("v")]).collect()
    assert {(r["g"], r["v"], r["rank"], r["group_rows"]) for r in got} == {(g, v, k, 4) for g in ("a", "b", None) for k, v in enumerate((3, 2, 1, None), 1)}
    assert ranked(spark.createDataFrame([], "g string, v int"), ["g"], ["v"]).count() == 0


def test_limits_of_classes_are_partial_or_ranged(spark):
    df = spark.range(12_000).select((F.col("id") % 2).alias("c"), "id")
    few = sampling.per_class_limit(df, "c", ["id"], 40, 2)
    assert few._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2  # before the shuffle and after
    assert few.groupBy("c").count().collect()[0][1] == 20
    many = sampling.per_class_limit(df, "c", ["id"], 5000, 2)
    assert {tuple(r) for r in many.groupBy("c").agg(F.count("*"), F.max("id")).collect()} == {(0, 2500, 4998), (1, 2500, 4999)}


def test_weighted_samples_of_groups(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id", F.when(F.col("id") % 5 == 0, 0.0).otherwise(F.col("id") * 1.0).alias("w"))
    out = sampling.weighted_sample(df, "id", "w", 0.1, 5, group=["g"])
    assert {(r["g"], r["count"]) for r in out.groupBy("g").count().collect()} == {(0, 33), (1, 33), (2, 33)}
    assert out.where("w <= 0").isEmpty()


# ---- relays and triggers


def test_a_record_by_two_routes_comes_once(spark):
    rows = [(i, dt.datetime(2024, 1, 1 + i // 10, i % 10)) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, ts timestamp")
    folders = [gather.replay(df, "ts", n, "t-relay") for n in (5, 2)]
    routes = [spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "2").parquet(f) for f in folders]
    out = context.relayed_view(routes, ["k"], "ts", "6 days")
    path = new_path(spark, "t-sink")
    gather.sink(out, path, new_path(spark, "t-state")).awaitTermination()
    assert sorted(r["k"] for r in gather.read_sink(spark, path, out.schema).collect()) == list(range(100))


def test_rescoring_takes_the_models_of_its_trigger(spark):
    features = spark.createDataFrame([(i,) for i in range(6)], "k long")
    models, labelled, scored = [("m1",)], [(0,)], []

    def load():
        return features, spark.createDataFrame(labelled, "k long"), spark.createDataFrame(models, "name string")

    def write(df, batch):
        scored.append(sorted((r["model"], r["k"]) for r in df.collect()))
        labelled.extend((k,) for _, k in scored[-1] if k < 3)
        models[:] = [("m2",), ("broken",)]

    def score(todo, model):
        if model["name"] == "broken":
            raise ValueError("no weights")
        return todo.select("k", F.lit(model["name"]).alias("model"))

    told = []
    job = context.rescore_every(spark, 0.5, load, ["k"], score, write, new_path(spark, "t-rescore"), told.append)
    until = time.time() + 90
    while len(scored) < 2 and time.time() < until:
        time.sleep(0.1)
    job.stop()
    assert scored[0] == [("m1", k) for k in range(1, 6)] and scored[1] == [("m2", k) for k in (3, 4, 5)]
    assert told and all("no weights" in x for x in told)


def test_rounds_of_a_shard_share_a_value_and_a_timer():
    """Calls to the state store do not grow with the rounds of a shard."""
    calls = []

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

        def clear(self):
            self.held = None

    class Handle:
        timers: set = set()

        def getValueState(self, *_):
            return Value()

        def listTimers(self):
            return iter(set(self.timers))

        def registerTimer(self, t):
            calls.append("timer")
            self.timers.add(t)

        def deleteTimer(self, t):
            self.timers.discard(t)

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    state = gather.Rounds(["user"], 2, True)
    state.init(Handle())
    answers = [(0, user, None, at * 1000, str(at), 50_000) for user in range(500) for at in ((9, 3, 5) if user % 2 else (60, 7))]
    rows = [gather.Row("_shard", "user", "_time", "_at", "_id", "_deadline")(*a) for a in answers]
    begun = list(state.handleInputRows((0,), iter(rows), Now(0)))
    assert len(begun) == 500 and len(calls) <= 3 and Handle.timers == {5}
    early = list(state.handleExpiredTimer((0,), Now(5), Now(5)))
    assert {(r["user"], r["status"], tuple(a["id"] for a in r["answers"])) for r in early} == {(u, "Complete", ("3", "5")) for u in range(1, 500, 2)}
    assert not list(state.handleInputRows((0,), iter(rows[2:3]), Now(5)))  # a round that is over does not begin again
    late = list(state.handleExpiredTimer((0,), Now(50), Now(50)))
    assert {(r["user"], r["status"], tuple(a["id"] for a in r["answers"])) for r in late} == {(u, "TimedOut", ("7",)) for u in range(0, 500, 2)}
    assert not state.rounds.exists() and len(calls) <= 12
