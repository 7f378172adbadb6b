"""Scalar functions as Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First marks of addresses and the layer they belong to.
LAYERS = (("10.42", "cloud"), ("10.23", "fog"), ("7.", "edge"))


def uniform(seed: int, key: Column) -> Column:
    """A number in (0, 1) from a hash of seed and key: 32 bits, never 0."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def bucket(seed: int, key: Column, n: int) -> Column:
    """One of n buckets from a hash of seed and key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") % n


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp with or without zone, in UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def seconds_since(ts: Column, start: str) -> Column:
    return epoch_seconds(ts) - epoch_seconds(F.lit(start).cast("timestamp"))


def floor_bin(value: Column, width: float) -> Column:
    """The start of the bin that holds value."""
    return F.floor(value / width) * width


def timeslot(unit: str, ts: Column) -> Column:
    """The start of the HOUR, DAY, ... that holds ts."""
    return F.date_trunc(unit, ts)


def classify_prefix(text: Column, classes: Sequence[tuple[str, str]] = LAYERS, other: str = "other") -> Column:
    """The class of the first prefix that text starts with."""
    out = F.lit(other)
    for prefix, name in reversed(classes):
        out = F.when(text.startswith(prefix), name).otherwise(out)
    return out


def capitalize(text: Column) -> Column:
    """The first letter as upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        out = out + (x - y) * (x - y)
    return out


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, stable for large ones."""
    shifted = F.transform(F.array(logits), lambda v: F.transform(v, lambda x: F.exp(x.cast("double") - F.array_max(v).cast("double"))))
    exps = F.get(shifted, 0)
    return F.get(F.transform(F.array(exps), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))), 0)


def argmax(values: Column) -> Column:
    """Place (from 0) of the greatest value; the first of equals."""
    return F.array_position(values, F.array_max(values)) - 1


def label_index(text: Column, labels: Sequence[str]) -> Column:
    """Place (from 0) of text in a fixed list; null if it is not there."""
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), text)
    return F.when(at > 0, at - 1)


def weights_bytes(weights: Column) -> Column:
    """Bytes of a map of float arrays."""
    return F.aggregate(F.map_values(weights), F.lit(0).cast("bigint"), lambda a, v: a + F.size(v) * 4)


def confusion_accuracy(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Share of right answers; null without any."""
    return F.try_divide(tp + tn, tp + tn + fp + fn)


def offset_clock(start: Column, seconds: Column) -> Column:
    """start plus a number of seconds."""
    return start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def parse_rfc3339(text: Column) -> Column:
    """A timestamp in UTC; null where the text is none."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(text))


def format_rfc3339(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
