"""Run telemetry: log lines to rows, bins, rates and accuracies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalar import classify_prefix, floor_bin, seconds_since
from graphloom.plans.storage import small

# The forms of log lines, found anywhere in a line: time, writer, what it says.
TIME = r"\[([-:.\d ]+) UTC\]\s*"
PEER = r"\[metrics/Connection\]\[peer=([\d.]+):\d+\]\s*"
BYTES_LINE = f"(?i){TIME}{PEER}(sent|received) bytes:\\s*(\\d+)"
LATENCY_LINE = f"(?i){TIME}{PEER}latency \\(s\\):\\s*([\\d.]+)"
ACCURACY_LINE = f"(?i){TIME}\\[FlAlgorithm\\]\\s*round #(\\d+) global accuracy:\\s*([\\d.]+)"
START_LINE = "[EdgeApp] start"
EPOCH = "2026-01-01 00:00:00"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """value and path of every line below path."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("path"))


def parse_logs(lines: DataFrame, epoch: str = EPOCH) -> DataFrame:
    """t (seconds since epoch), kind, ip, layer, direction, bytes, latency, round, accuracy and path of the lines that have a form."""
    v = F.col("value")
    kind = F.when(v.rlike(BYTES_LINE), "bytes").when(v.rlike(LATENCY_LINE), "latency").when(v.rlike(ACCURACY_LINE), "accuracy")
    found = lines.withColumn("kind", kind).where("kind is not null")

    def of(name: str, line: str, group: int):
        return F.when(F.col("kind") == name, F.regexp_extract("value", line, group))

    ts = F.coalesce(of("bytes", BYTES_LINE, 1), of("latency", LATENCY_LINE, 1), of("accuracy", ACCURACY_LINE, 1))
    ip = F.coalesce(of("bytes", BYTES_LINE, 2), of("latency", LATENCY_LINE, 2))
    return found.select(
        seconds_since(F.try_to_timestamp(ts), epoch).alias("t"),
        "kind",
        ip.alias("ip"),
        F.when(ip.isNotNull(), classify_prefix(ip)).alias("layer"),
        F.lower(of("bytes", BYTES_LINE, 3)).alias("direction"),
        of("bytes", BYTES_LINE, 4).try_cast("bigint").alias("bytes"),
        of("latency", LATENCY_LINE, 3).try_cast("double").alias("latency"),
        of("accuracy", ACCURACY_LINE, 2).try_cast("bigint").alias("round"),
        of("accuracy", ACCURACY_LINE, 3).try_cast("double").alias("accuracy"),
        *[F.col(c) for c in lines.columns if c == "path"],
    )


def with_run_size(lines: DataFrame) -> DataFrame:
    """lines with n_edges, the number of start lines in their log file (path), on every row."""
    starts = lines.groupBy("path").agg(F.count_if(F.col("value").contains(START_LINE)).alias("n_edges"))
    return lines.join(small(starts), "path", "left")


def bin_mean(df: DataFrame, at: str, value: str, width: float, by: list[str]) -> DataFrame:
    """The bin's start, by, and the mean of value."""
    return df.groupBy(floor_bin(F.col(at), width).alias("bin"), *by).agg(F.avg(value).alias("mean"))


def bin_rate(df: DataFrame, at: str, amount: str, width: float, by: list[str], unit: float = 1000.0) -> DataFrame:
    """The bin's start, by, and the sum of amount in units (kilobytes)."""
    return df.groupBy(floor_bin(F.col(at), width).alias("bin"), *by).agg((F.sum(amount) / unit).alias("amount"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """actual, predicted, prob and n, the run's size from the file's name."""
    rows = spark.read.option("header", "true").schema("actual string, predicted string, prob double").csv(path)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)[^\d/]*\.csv$", 1).try_cast("int").alias("n"))


def write_predictions(df: DataFrame, path: str) -> None:
    df.select("actual", "predicted", "prob").write.option("header", "true").csv(path)


def accuracy_by(df: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))
