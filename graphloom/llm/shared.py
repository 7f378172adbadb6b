"""What the operators share: the folder for intermediate tables, size checks, row identity."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast; every operator counts the side first.
BROADCAST_ROWS = 200_000

#: A key with more rows than this, or than so small a share of all, is joined by a broadcast of its row.
HEAVY, HEAVY_KEYS = 128, 100_000


def tune(spark: SparkSession) -> None:
    """Session settings the operators rely on: UTC, and small Arrow batches so that long texts fit a Python worker.

    Python workers find this package where the driver did, if it is not installed for them.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, one of our own serves a session in local mode (tests); on a cluster it is an error,
    since each executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (base or "file:///tmp/checkpoints/graphloom").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and it is computed once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured_table(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``table`` and the metrics (aggregates) of its rows, taken while they are written."""
    seen = Observation()
    written = table(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name)
    return written, {k: seen.get.get(k) for k in metrics}


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``table`` wrote and nothing reads any more."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows; unchanged, to be shuffled, if it has more.

    The count stops one row beyond the bound, so a large side costs no full pass.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined to per_key, which has one row a key and in column n the rows of that key.

    Keys with more rows than ``HEAVY`` and a share of 1 / ``HEAVY_KEYS`` of all are broadcast, so they never
    meet in one task; by that bound there are fewer than ``HEAVY_KEYS`` of them.  All others are shuffled.
    per_key is written, in the shared folder.
    """
    per_key, seen = measured_table(per_key, f"per-{key}", total=F.sum(n), most=F.max(n))
    bound = max(HEAVY, (seen["total"] or 0) // HEAVY_KEYS)
    if (seen["most"] or 0) <= bound:
        return rows.join(per_key, key)
    heavy = per_key.where(F.col(n) > bound)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(per_key.where(F.col(n) <= bound), key))


def row_key(doc_id: str, text: str) -> Column:
    """With doc_id, identifies the rows that are equal for an operator (repeated ids with different texts stay apart)."""
    return F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text))


def input_partitions(df: DataFrame, least: int = 1) -> int:
    """A number of partitions for a shuffle that carries whole rows of df: the session's, which the deployment sizes to its data."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def in_ranges(df: DataFrame, key: str, tie: str, partitions: int) -> DataFrame:
    """df dealt into ascending ranges of a long key (nulls first) and, among equal keys, of the hash tie; sorted within.

    The bounds come from quantiles of key, for which the scan reads that column alone; a range
    partitioning by Spark would sample whole rows and so compute all of df twice.  A key that is
    several bounds at once, or null, is spread over their partitions by its ties.  The least long
    stands beside null in the order.
    """
    at = [i / partitions for i in range(1, partitions)]
    placed = F.coalesce(F.col(key), F.lit(-(2**63)))
    found = df.agg(F.percentile_approx(placed, at, max(10_000, 20 * partitions)).alias("b")).first()["b"] if at else []
    bounds = list(found or [])
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.lit(bounds[step - 1 :: step]) if bounds else F.array().cast("array<bigint>")
    fine = F.lit(bounds) if bounds else F.array().cast("array<bigint>")

    def below(inclusive: bool) -> Column:
        """How many bounds lie below key (or at it): whole steps first, then within one step."""

        def under(b: Column) -> Column:
            return (b <= placed) if inclusive else (b < placed)

        steps = F.size(F.filter(coarse, under))
        return steps * step + F.size(F.filter(F.slice(fine, steps * step + 1, F.lit(step)), under))

    ranged = df.withColumn("_low", below(False)).withColumn("_high", below(True))
    share = (F.col(tie).cast("double") + 2.0**63) / 2.0**64
    part = F.col("_low") + F.least(F.floor(share * (F.col("_high") - F.col("_low") + 1)), F.col("_high") - F.col("_low"))
    dealt = ranged.repartitionById(partitions, part.cast("int"))
    return dealt.drop("_low", "_high").sortWithinPartitions(key, tie)
