"""Rounds on streams: the first n answers of each round, or what came until its deadline.

A round is keyed state with an event-time timer, held with the other rounds of its shard.  It holds the n earliest answers so far and is
due when the watermark passes the n-th of them, so that no earlier one can come, or else its deadline.  The result hangs on
event times alone: neither the order of arrival nor a restart changes it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from graphloom.plans.storage import importable, new_path

RUNNING, COMPLETE, TIMED_OUT = "Running", "Complete", "TimedOut"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWERS = "array<struct<at: long, id: string>>"
#: Shards that rounds are dealt into; a checkpoint holds for one number.  A task holds the open rounds of one shard at a time, and a batch rewrites those it touches.
SHARDS = 256


def _ms(micros: int) -> int:
    return -(-micros // 1000)


class Rounds(StatefulProcessor):
    """State of the open rounds of one shard: each round's deadline and earliest answers (at in microseconds, id), None once it is over.

    The rounds of a shard are read and written as one value, with one timer at the first that is due; a
    value and a timer for each round would cost several calls to the state store for each.
    """

    def __init__(self, keys: Sequence[str], n: int, running: bool) -> None:
        self.keys, self.n, self.running = list(keys), n, running

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rounds = handle.getValueState("rounds", "held binary")

    def _held(self) -> dict[tuple, list]:
        return pickle.loads(self.rounds.get()[0]) if self.rounds.exists() else {}

    def _due(self, deadline: int, answers: list | None) -> int:
        return _ms(answers[-1][0] if answers and len(answers) == self.n else deadline)

    def _keep(self, held: dict[tuple, list]) -> None:
        """The shard's rounds and its timer from now on."""
        first = min((self._due(*r) for r in held.values()), default=None)
        for t in list(self.handle.listTimers()):
            if t != first:
                self.handle.deleteTimer(t)
        if first is None:
            self.rounds.clear()
        else:
            self.rounds.update((pickle.dumps(held, pickle.HIGHEST_PROTOCOL),))
            self.handle.registerTimer(first)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, touched, places = self._held(), set(), len(self.keys)
        for r in rows:
            own, (at, answer, deadline) = tuple(r[1 : places + 1]), r[-3:]
            if at > deadline:
                continue
            known = held.get(own)
            if known is None:
                held[own] = [deadline, [(at, answer)]]
                if self.running:
                    yield self._row(own, RUNNING, [])
            elif known[1] is not None:
                known[1].append((at, answer))
                touched.add(own)
        for own in touched:
            held[own][1] = sorted(held[own][1])[: self.n]
        self._keep(held)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, now = self._held(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        for own, (deadline, answers) in list(held.items()):
            if self._due(deadline, answers) > now:
                continue
            if answers is not None:
                yield self._row(own, COMPLETE if len(answers) == self.n else TIMED_OUT, answers)
            if _ms(deadline) <= now:  # nothing of it can come any more
                del held[own]
            else:
                held[own][1] = None
        self._keep(held)

    def _row(self, key: tuple, status: str, held: list) -> Row:
        return Row(*self.keys, "status", "answers")(*key, status, [Row(at=a, id=i) for a, i in held])

    def close(self) -> None:
        pass


def gather(
    answers: DataFrame, keys: Sequence[str], n: int, seconds: float, opened: Column, at: str, answer: str, watermark: str = "0 seconds", running: bool = False
) -> DataFrame:
    """keys, status and answers (at in microseconds and id) of each round of a stream, once it is decided.

    keys name a round, opened is when it began, at is an answer's time and answer its id.  The first n answers
    decide it (Complete), or seconds after its beginning those that came until then (TimedOut).  Answers after that
    change nothing, nor do those behind the watermark; a round without answers gives no row.  With
    running, a round's first answer gives a row as well.  Rows without a time or a key have no round.
    """
    spark = answers.sparkSession
    importable(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    limit = F.unix_micros(opened.cast("timestamp")) + int(seconds * 1_000_000)
    held = answers.withColumn("_time", F.col(at).cast("timestamp")).withWatermark("_time", watermark)
    known = F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull()
    # one condition on time and keys stays above the watermark, so rows without a key move it too
    whole = held.where(F.when(F.col("_time").isNotNull(), known).otherwise(F.lit(False)))
    shard = F.pmod(F.xxhash64(*keys), F.lit(SHARDS)).alias("_shard")
    rows = whole.select(shard, *keys, "_time", micros.alias("_at"), F.col(answer).cast("string").alias("_id"), limit.alias("_deadline"))
    fields = [T.StructField(k, rows.schema[k].dataType) for k in keys]
    out = T.StructType([*fields, T.StructField("status", T.StringType()), T.StructField("answers", T.StructType.fromDDL(f"a {ANSWERS}")["a"].dataType)])
    return rows.groupBy("_shard").transformWithState(Rounds(keys, n, running), out, "Append", "EventTime")


def replay(df: DataFrame, at: str, slices: int, name: str, until: Column | None = None) -> str:
    """A folder to which df is written as a stream would come: slice by slice in order of time, each one job.

    The files of one slice come in any order, so a watermark's delay must be as long as a slice.
    With until, a last slice holds one row of nulls at that time, which carries the watermark there.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    ends = df.agg(F.percentile_approx(F.unix_micros(F.col(at).cast("timestamp")), [i / slices for i in range(1, slices)], 1000).alias("e")).first()["e"] or []
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    for low, high in zip([None, *ends], [*ends, None], strict=True):
        part = df.where((F.lit(True) if low is None else micros > low) & (F.lit(True) if high is None else micros <= high))
        part.write.mode("append").parquet(path)
    if until is not None:
        nulls = spark.range(1).select(*[(until if f.name == at else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])
        nulls.write.mode("append").parquet(path)
    return path


def sink(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes each micro-batch to a folder of its own, over what a failed try left there."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:09d}")

    start = stream.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", checkpoint)
    return start.trigger(**(trigger or {"availableNow": True})).start()


def read_sink(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/batch=*")
