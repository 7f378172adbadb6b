"""Acquisition and propagation of context on streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.scalar import floor_bin
from graphloom.operators.joins import unmatched
from graphloom.operators.records import subject_hash
from graphloom.plans.storage import delete, exists, small

INTERNAL, EXTERNAL = "internal", "external"
EDGE, FOG, CLOUD = "edge", "fog", "cloud"


def stamp(records: DataFrame, node: Column, at: Column | None = None) -> DataFrame:
    """records with acquired_at, where it is not set already, and acquired_by."""
    now = F.current_timestamp() if at is None else at
    own = F.coalesce(F.col("acquired_at"), now) if "acquired_at" in records.columns else now
    return records.withColumn("acquired_at", own).withColumn("acquired_by", node)


def targets(layer: Column, public: Column) -> Column:
    """Where a record goes: public edge and fog records inward and outward, the others inward alone."""
    both = F.array(F.lit(INTERNAL), F.lit(EXTERNAL))
    return F.when((layer == FOG) | ((layer == EDGE) & public), both).otherwise(F.array(F.lit(INTERNAL)))


def route(records: DataFrame, schema: DataFrame, layer: str = "layer", cls: str = "cls") -> DataFrame:
    """A row per record and target; schema holds cls and visibility, and a class it lacks is private."""
    known = small(schema.select(F.col("cls").alias("_cls"), (F.col("visibility") == "Public").alias("_public")))
    joined = records.join(known, records[cls] == F.col("_cls"), "left")
    public = F.coalesce("_public", F.lit(False))
    return joined.select(*[records[c] for c in records.columns], F.explode(targets(F.col(layer), public)).alias("target"))


def fan_out(records: DataFrame, owners: Sequence[str]) -> DataFrame:
    """A copy for each subscriber, as the column owner."""
    return records.withColumn("owner", F.explode(F.array(*[F.lit(o) for o in owners])))


def global_view(parts: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """The union of what came by several routes, each record once: its subject is a hash of its content."""
    from graphloom.operators.derive import union_all

    all_parts = union_all(parts)
    return all_parts.withColumn("subject", subject_hash("record", *[F.col(k) for k in key])).dropDuplicates(["subject"])


def relayed_view(routes: Sequence[DataFrame], key: Sequence[str], at: str, delay: str) -> DataFrame:
    """The union of streams that bring the same records by several routes, each record once.

    A copy is known by the hash of its content for as long as the watermark, the slowest route's, is less than delay past
    its time; so the state is bounded, and a copy that comes later than that is dropped with other late rows.
    """
    from graphloom.operators.derive import union_all

    named = [r.withColumn("_time", F.col(at).cast("timestamp")).withWatermark("_time", delay) for r in routes]
    known = union_all([r.withColumn("subject", subject_hash("record", *[F.col(k) for k in key])) for r in named])
    return known.dropDuplicatesWithinWatermark(["subject"]).drop("_time")


def current_round(messages: DataFrame, round_no: int) -> DataFrame:
    """Messages of this round; those of another are stale."""
    return messages.where(F.col("round") == round_no)


def binned(events: DataFrame, at: str, width: float, by: Sequence[str], watermark: str | None = None) -> DataFrame:
    """bin, by and n; with a watermark over event time the state of past windows is dropped."""
    if watermark is None:
        seconds = F.unix_micros(F.col(at).cast("timestamp")) / F.lit(1_000_000.0)
        return events.groupBy(floor_bin(seconds, width).cast("bigint").alias("bin"), *by).agg(F.count(F.lit(1)).alias("n"))
    held = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, watermark)
    window = F.window(at, f"{width:g} seconds").alias("w")
    counted = held.groupBy(window, *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.unix_seconds("w.start").alias("bin"), *by, "n")


def sessions(events: DataFrame, at: str, gap: str, by: Sequence[str], watermark: str) -> DataFrame:
    """start, end, by and n of runs of events without a longer gap."""
    held = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, watermark)
    return held.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *by, "n")


def acquire(
    stream: DataFrame, schema: DataFrame, node: str, write: Callable[[DataFrame, str, int], None], checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Stamps and routes each micro-batch once, in a written table, and hands every target its rows of it.

    A batch that comes again is read from that table, so all copies of a record keep one stamp; tables of
    earlier batches are deleted.  write(df, target, batch) must take the same batch twice without harm;
    with the checkpoint that makes delivery exactly once.
    """
    base = f"{checkpoint.rstrip('/')}-routed"

    def flush(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{base}/batch={batch_id}"
        routed = route(stamp(batch, F.lit(node)), schema)
        if not exists(spark, f"{path}/_SUCCESS"):
            routed.write.mode("overwrite").partitionBy("target").parquet(path)
        kept = spark.read.schema(routed.schema).parquet(path)
        for target in (INTERNAL, EXTERNAL):
            write(kept.where(F.col("target") == target).drop("target"), target, batch_id)
        delete(spark, f"{base}/batch={batch_id - 1}")  # its end is in the checkpoint

    start = stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return start.trigger(**(trigger or {"availableNow": True})).start()


def run_for(query: StreamingQuery, seconds: float) -> bool:
    """Whether a query ended by itself within that time; else it is stopped after what it has taken in."""
    done = bool(query.awaitTermination(int(seconds) if seconds >= 1 else 1))
    if not done:
        query.stop()
    return done


def batch_writer(path: str) -> Callable[[DataFrame, str, int], None]:
    """A write for acquire: one folder per target and batch, written over if the batch comes again."""

    def write(df: DataFrame, target: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{target}/batch={batch_id}")

    return write


def rescore(features: DataFrame, labelled: DataFrame, keys: Sequence[str], models: DataFrame, score: Callable[[DataFrame, object], DataFrame]) -> tuple[list[DataFrame], list[str]]:
    """One pass of the periodic scoring: (results, faults) over the models; a fault of one does not stop the others.

    models are few (the latest of each layout); an empty prediction set gives no result.
    """
    todo = unmatched(features, labelled, keys)
    if todo.isEmpty():
        return [], []
    results, faults = [], []
    for model in models.collect():
        try:
            results.append(score(todo, model))
        except Exception as fault:  # noqa: BLE001  the loop goes on, the fault is told
            faults.append(f"{model}: {fault}")
    return results, faults


def rescore_every(
    spark: SparkSession,
    seconds: float,
    load: Callable[[], tuple[DataFrame, DataFrame, DataFrame]],
    keys: Sequence[str],
    score: Callable[[DataFrame, object], DataFrame],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    told: Callable[[str], None] = print,
) -> StreamingQuery:
    """Rescoring at a processing-time trigger: each batch loads features, labelled records and the newest models as of its start.

    write(df, batch) takes each result; it must take a batch twice without harm.  Faults of single models are told and
    do not stop the query.
    """

    def run(_: DataFrame, batch_id: int) -> None:
        features, labelled, models = load()
        results, faults = rescore(features, labelled, keys, models, score)
        for fault in faults:
            told(fault)
        if results:
            write(reduce(DataFrame.unionByName, results), batch_id)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", "1").load()
    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds:g} seconds").start()
